"""Loading end to end, replacing tables, and continuous loading."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clearledger.operators import catalog as C
from clearledger.operators import records as X
from clearledger.operators.typing import resolve_types
from clearledger.plans.load import load_table, load_tables, mask_stored_table
from clearledger.session import shared_folder
from clearledger.sources import jdbc, tables
from clearledger.sources.files import scan
from clearledger.sources.tables import ensure_database, quoted, refresh_table
from clearledger.specs import MANIFEST, MASK_POLICIES, MaskPolicy, TableSpec
from clearledger.streaming import intake


def wide_source(spark, spec, rows=200):
    """A raw table with every column the specification and policy name."""
    policy = MASK_POLICIES.get(spec.table, MaskPolicy())
    columns = {"id": F.col("id").cast("double")}
    columns |= {n: F.lit("07:30:00") for n in spec.time_columns}
    columns |= {n: F.lit("9999-12-31 00:00:00") for n in spec.timestamp_columns}
    columns |= {n: F.lit("a_x0020_b") for n in spec.escaped_text_columns}
    columns |= {n: F.lit("_x0038_501_x0020_5936") for n in policy.escaped_phones}
    columns |= {n: F.lit("9875 5676") for n in policy.phones}
    columns |= {n: F.lit("Road 1") for n in policy.redacted}
    return spark.range(rows).select(*[c.alias(n) for n, c in columns.items()])


@pytest.fixture(scope="module")
def place(spark):
    return shared_folder(spark, "test")


def test_manifest_load(spark, place):
    for spec in MANIFEST:
        wide_source(spark, spec).write.parquet(f"{place}/raw/{spec.source}")
    report = load_tables(spark, f"{place}/raw", "loaded", f"{place}/tables").collect()
    assert {r.table_name for r in report} == {s.table for s in MANIFEST}
    assert all(r.n_rows == r.n_written == 200 and r.complete for r in report)
    counts = {r.table_name: (r.n_rejected, r.n_visited, r.n_masked) for r in report}
    assert counts == {
        "emd": (0, 400, 400), "inpatient_movement": (0, 800, 800), "surgery": (0, 0, 0), "soc": (0, 0, 0),
    }
    emd = spark.table("loaded.emd")
    row = emd.first()
    assert (row.PERIOD, row.RESIDENT_TEL, row.CONTACT_TEL) == ("a b", "8501 XXXX", "8501 XXXX")
    assert row.DATE_BIR.year == 9999
    assert dict(emd.dtypes)["id"] == "bigint"
    stay = spark.table("loaded.inpatient_movement").first()
    assert (stay.CONTACT_TEL, stay.ADDRESS1, stay.BLOCK_BUILD) == ("9875 XXXX", "XXXXX", "XXXXX")
    assert stay.MOVE_STIME == "07:30:00"
    again = load_tables(spark, f"{place}/raw", "loaded", f"{place}/tables").collect()
    assert all(r.n_rows == 200 for r in again)


def test_counts_taken_while_writing(spark, place):
    raw = spark.createDataFrame(
        [("07:00", "98765432", "x"), ("25:00", "123", ""), ("", "", None), (None, None, "y")],
        "at string, tel string, home string",
    )
    raw.write.parquet(f"{place}/visits.parquet")
    ensure_database(spark, "counted", f"{place}/counted")
    spec, policy = TableSpec("visits", time_columns=("at",)), MaskPolicy(phones=("tel",), redacted=("home",))
    loaded = load_table(spark, spec, place, "counted", f"{place}/tables", policy)
    assert (loaded.n_written, loaded.n_rejected, loaded.n_visited, loaded.n_masked) == (4, 1, 4, 3)
    assert sorted(map(tuple, spark.table("counted.visits").collect()), key=str) == [
        ("07:00:00", "9876 XXXX", "XXXXX"), (None, "123", None), (None, None, "XXXXX"), (None, None, None),
    ]


def test_tables_without_rows(spark, place):
    nothing = spark.createDataFrame([], "at string, tel string, x double")
    nothing.write.parquet(f"{place}/nothing.parquet")
    ensure_database(spark, "counted", f"{place}/counted")
    spec, policy = TableSpec("nothing", time_columns=("at",)), MaskPolicy(phones=("tel",))
    loaded = load_table(spark, spec, place, "counted", f"{place}/tables", policy)
    assert loaded.n_written == loaded.n_rejected == loaded.n_visited == 0
    assert spark.table("counted.nothing").dtypes == [("at", "string"), ("tel", "string"), ("x", "bigint")]


def test_masking_a_stored_table(spark, place):
    ensure_database(spark, "stored", f"{place}/stored")
    raw = spark.createDataFrame([("9875 5676", "a"), ("12", None), (None, None)], "tel string, home string")
    refresh_table(raw, "stored", place, "people")
    policy = MaskPolicy(phones=("tel",), redacted=("home",))
    first = mask_stored_table(spark, "stored", "people", place, policy)
    assert (first.n_rows, first.n_with_pii, first.n_visited, first.n_masked) == (3, 2, 3, 2)
    again = mask_stored_table(spark, "stored", "people", place, policy)
    assert (again.n_visited, again.n_masked) == (3, 1)
    assert sorted(map(tuple, spark.table("stored.people").collect()), key=str) == [
        ("12", None), ("9875 XXXX", "XXXXX"), (None, None),
    ]


def test_catalog_of_loaded_tables(spark, place):
    ensure_database(spark, "small", f"{place}/small")
    refresh_table(spark.sql("SELECT 1L AS a, 'x' AS b, 1.5D AS c"), "small", place, "t1")
    refresh_table(spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01' AS at"), "small", place, "t2")
    spark.range(1).createOrReplaceTempView("some_view")
    catalog = C.session_catalog(spark, "small")
    assert C.schema_text(catalog, "small") == (
        "Table: t1 (a BIGINT, b TEXT, c DOUBLE PRECISION)\nTable: t2 (at TIMESTAMP WITHOUT TIME ZONE)"
    )
    assert C.schema_text(catalog, "other") == "No tables found in the public schema."
    described = C.describe_table(spark, "t1", "small")
    assert [tuple(r) for r in described.columns.collect()] == [
        ("a", "bigint", True), ("b", "text", True), ("c", "double precision", True),
    ]
    assert described.sample_rows.count() == 1
    with pytest.raises(ValueError, match="not found in public schema"):
        C.describe_table(spark, "some_view", "small")


def test_not_null_is_shown(spark):
    catalog = C.catalog_of(spark, {"t": spark.range(1).schema}, "s")
    assert C.schema_text(catalog, "s") == "Table: t (id BIGINT NOT NULL)"


def test_replacing_a_table(spark, place):
    ensure_database(spark, "swaps", f"{place}/swaps")
    name = quoted("swaps", "t")
    refresh_table(spark.range(10), "swaps", place, "t")
    refresh_table(spark.range(20), "swaps", place, "t")
    assert spark.table(name).count() == 20
    refresh_table(spark.table(name).where("id < 5"), "swaps", place, "t")
    assert spark.table(name).count() == 5
    refresh_table(spark.sql("SELECT 'x' AS other"), "swaps", place, "t")
    assert [tuple(r) for r in spark.table(name).collect()] == [("x",)]
    refresh_table(spark.range(3), "swaps", f"{place}/it's here", "quoted")
    refresh_table(spark.range(4), "swaps", f"{place}/it's here", "quoted")
    assert spark.table(quoted("swaps", "quoted")).count() == 4


def test_failed_load_keeps_the_table(spark, place):
    ensure_database(spark, "kept", f"{place}/kept")
    refresh_table(spark.range(10), "kept", place, "t")
    broken = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception):
        refresh_table(broken, "kept", place, "t")
    assert spark.table(quoted("kept", "t")).count() == 10


def test_continuous_load_equals_batch(spark, place):
    spec = MANIFEST[0]
    policy = MASK_POLICIES[spec.table]
    raw = wide_source(spark, spec)
    raw.where("id < 80").write.parquet(f"{place}/arriving")
    types = resolve_types(raw, spec)

    def take_in():
        stream = intake.arriving(spark, f"{place}/arriving", raw.schema)
        cleaned = intake.clean_and_mask(stream, spec, types, policy)
        intake.append_to(cleaned, f"{place}/taken", f"{place}/progress").awaitTermination()
        return scan(spark, place, "taken")

    assert take_in().count() == 80
    assert take_in().count() == 80
    raw.where("id >= 80").write.mode("append").parquet(f"{place}/arriving")
    taken = take_in()
    load_tables(spark, f"{place}/raw", "loaded", f"{place}/tables", manifest=[spec])
    assert taken.exceptAll(spark.table("loaded.emd")).count() == 0
    assert taken.count() == 200


def test_records_on_a_stream(spark, place):
    bodies = spark.sql(
        """
        SELECT CAST(id AS STRING) AS id, '/one/v1/chat/completions' AS path,
               IF(id % 2 = 0, '{"messages":[{"role":"user","content":"x"}]}', 'broken') AS body
        FROM range(50)
        """
    )
    bodies.write.parquet(f"{place}/bodies")

    def process(df):
        routed = X.route_requests(df, "path", "body", X.Routes(("one",), "one", "m"))
        return X.request_log(X.session_context(routed, "body", "id"), "id")

    stream = process(intake.arriving(spark, f"{place}/bodies", bodies.schema))
    intake.append_to(stream, f"{place}/logged", f"{place}/logged-progress").awaitTermination()
    assert scan(spark, place, "logged").exceptAll(process(bodies)).count() == 0
    assert scan(spark, place, "logged").count() == 25


def test_shared_folder_lies_where_every_executor_reaches():
    class Session:
        def __init__(self, **settings):
            self.conf = {key.replace("_", "."): value for key, value in settings.items()}

    given = Session(spark_checkpoint_dir="s3a://work/", spark_sql_warehouse_dir="s3a://tables")
    assert shared_folder(given, "x").startswith("s3a://work/x-")
    assert shared_folder(Session(spark_sql_warehouse_dir="s3a://tables"), "x").startswith("s3a://tables/_between/x-")

def test_jdbc_options():
    connection = jdbc.Connection("jdbc:postgresql://host:5432/db", "me", "secret")
    assert "secret" not in repr(connection)
    slices = jdbc.Slices("id", "0", "1000", 8)
    options = jdbc.read_options(connection, 'odd"name', slices)
    assert options["dbtable"] == '"odd""name"'
    assert options["loginTimeout"] == "30"
    assert (options["partitionColumn"], options["numPartitions"]) == ("id", "8")
    assert "partitionColumn" not in jdbc.read_options(connection, "t", None)
    assert jdbc.write_options(connection, "t", 5000, 4)["batchsize"] == "5000"


def test_spec_without_source_reads_its_own_name(spark, folder, place):
    report = load_tables(spark, folder, "plain", f"{place}/plain", [TableSpec("nation")], {})
    assert [(r.table_name, r.n_rows, r.complete) for r in report.collect()] == [("nation", 25, True)]


def _version(spark, rows, schema="a long"):
    return spark.createDataFrame(rows, schema)


def test_changed_columns_never_leave_a_moment_without_a_table(spark, place, monkeypatch):
    ensure_database(spark, "swapped", f"{place}/swapped")
    refresh_table(_version(spark, [(1,)]), "swapped", f"{place}/swap", "t")
    real = tables._rename

    def failing(session, name, to):
        if "__new_" in name:
            raise RuntimeError("lost")
        real(session, name, to)

    monkeypatch.setattr(tables, "_rename", failing)
    with pytest.raises(RuntimeError, match="lost"):
        refresh_table(_version(spark, [(1.5,)], "a double"), "swapped", f"{place}/swap", "t")
    assert [tuple(r) for r in spark.table("swapped.t").collect()] == [(1,)]
    assert [t.name for t in spark.catalog.listTables("swapped") if not t.isTemporary] == ["t"]
    monkeypatch.undo()
    refresh_table(_version(spark, [(1.5,)], "a double"), "swapped", f"{place}/swap", "t")
    assert [tuple(r) for r in spark.table("swapped.t").collect()] == [(1.5,)]
    assert [t.name for t in spark.catalog.listTables("swapped") if not t.isTemporary] == ["t"]


def test_no_raw_value_is_left_after_masking_and_removal(spark, place):
    ensure_database(spark, "cleaned", f"{place}/cleaned")
    root = f"{place}/clean"
    refresh_table(spark.createDataFrame([("9875 5676",)], "phone string"), "cleaned", root, "t")
    mask_stored_table(spark, "cleaned", "t", root, MaskPolicy(phones=("phone",)))
    everything = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/t")
    assert {r.phone for r in everything.collect()} == {"9875 5676", "9875 XXXX"}
    assert tables.drop_old_versions(spark, "cleaned", root, "t") == 1
    assert tables.drop_old_versions(spark, "cleaned", root, "t") == 0
    everything = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/t")
    assert [r.phone for r in everything.collect()] == ["9875 XXXX"] == [r.phone for r in spark.table("cleaned.t").collect()]
    with pytest.raises(ValueError, match="published"):
        spark.createDataFrame([("x",)], "phone string").write.parquet(f"{root}-other/t/version-x")
        tables.drop_old_versions(spark, "cleaned", f"{root}-other", "t")


def test_a_fraction_arriving_late_is_null_not_cut(spark, place):
    source, out = f"{place}/late", f"{place}/late-out"
    spark.createDataFrame([(1.0,), (2.0,)], "a double").write.parquet(f"{source}/one")
    spec = TableSpec("late")
    types = resolve_types(spark.read.parquet(f"{source}/one"), spec)
    spark.createDataFrame([(1.5,), (3.0,)], "a double").write.parquet(f"{source}/two")
    raw = spark.read.parquet(f"{source}/one")
    stream = intake.clean_and_mask(intake.arriving(spark, f"{source}/*", raw.schema), spec, types)
    intake.append_to(stream, out, f"{place}/late-progress").awaitTermination()
    assert sorted((r.a for r in spark.read.parquet(out).collect()), key=str) == [1, 2, 3, None]
