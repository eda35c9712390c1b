"""Queries on masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearledger.functions import text
from clearledger.operators import masking as K
from clearledger.plans.load import mask_changed_rows, mask_stored_table
from clearledger.plans.registry import SCRATCH, query
from clearledger.session import shared_folder
from clearledger.sources.files import scan_table
from clearledger.sources.slices import refresh_sliced_table, update_by_key
from clearledger.sources.tables import ensure_database, quoted, refresh_table
from clearledger.specs import MaskPolicy

# Phone texts built from a key, valid in both SQL dialects: empty, foreign, joined or spaced.
PHONE_CASES = """
    CASE WHEN {key} % 7 = 0 THEN ''
         WHEN {key} % 11 = 0 THEN '+65' || lpad(CAST({key} * 7 % 100000000 AS STRING), 8, '0')
         ELSE lpad(CAST({key} % 10000 AS STRING), 4, '0')
              || CASE WHEN {key} % 5 = 0 THEN '' ELSE ' ' END
              || lpad(CAST({key} * 7 % 10000 AS STRING), 4, '0') END
"""
PHONE = PHONE_CASES.format(key="c_custkey")
OTHER_PHONE = PHONE_CASES.format(key="(c_custkey + 3)")
SUPPLIER_PHONE = PHONE_CASES.format(key="s_suppkey")


def _escaped(phone: str) -> str:
    return f"""
        CASE WHEN ({phone}) = '' THEN ''
             ELSE ' _x003' || substr(({phone}), 1, 1) || '_'
                  || replace(substr(({phone}), 2), ' ', '_x0020_') END
    """


ESCAPED = _escaped(PHONE)
OTHER_ESCAPED = _escaped(OTHER_PHONE)


def _duck_decoded(value: str) -> str:
    decoded = value
    for digit in range(10):
        decoded = f"replace({decoded}, '_x003{digit}_', '{digit}')"
    return f"trim(replace({decoded}, '_x0020_', ' '))"


def _duck_masked(value: str) -> str:
    return f"regexp_replace({value}, '^\\s*([0-9]{{4}})\\s?[0-9]{{4}}\\s*$', '\\1 XXXX')"


def _duck_fits(value: str) -> str:
    return f"regexp_matches({value}, '^\\s*[0-9]{{4}}\\s?[0-9]{{4}}\\s*$')"


def _customers(spark: SparkSession, folder: str, **columns: str) -> DataFrame:
    derived = [F.expr(sql).alias(name) for name, sql in columns.items()]
    return scan_table(spark, folder, "customer").select("c_custkey", *derived)


@query(
    f"""
    SELECT c_custkey, {_duck_decoded('raw')} AS phone
    FROM (SELECT c_custkey, {ESCAPED} AS raw FROM customer)
    """
)
def decode_phone(spark: SparkSession, folder: str) -> DataFrame:
    raw = _customers(spark, folder, raw=ESCAPED)
    return raw.select("c_custkey", text.decode_phone(F.col("raw")).alias("phone"))


@query(
    f"""
    SELECT c_custkey, {_duck_masked('raw')} AS phone
    FROM (SELECT c_custkey, {PHONE} AS raw FROM customer)
    """
)
def mask_phone(spark: SparkSession, folder: str) -> DataFrame:
    raw = _customers(spark, folder, raw=PHONE)
    return raw.select("c_custkey", text.mask_phone(F.col("raw")).alias("phone"))


ADDRESS = "CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 9 > 0 THEN c_name END"


@query(
    f"""
    SELECT c_custkey, CASE WHEN length(raw) > 0 THEN 'XXXXX' END AS address
    FROM (SELECT c_custkey, {ADDRESS} AS raw FROM customer)
    """
)
def redact_text(spark: SparkSession, folder: str) -> DataFrame:
    raw = _customers(spark, folder, raw=ADDRESS)
    return raw.select("c_custkey", text.redact(F.col("raw")).alias("address"))


DECODED_POLICY = MaskPolicy(escaped_phones=("home_tel", "contact_tel"))
REDACTED_POLICY = MaskPolicy(phones=("contact_tel",), redacted=("address1", "address2", "block"))


def _raw_contacts(spark: SparkSession, folder: str) -> DataFrame:
    home = f"CASE WHEN c_custkey % 13 > 0 THEN {ESCAPED} END"
    return _customers(spark, folder, home_tel=home, contact_tel=OTHER_ESCAPED)


DUCK_CONTACTS = f"""
    SELECT c_custkey, CASE WHEN c_custkey % 13 > 0 THEN {ESCAPED} END AS home_tel,
           {OTHER_ESCAPED} AS contact_tel
    FROM customer
"""


@query(
    f"""
    SELECT c_custkey, {_duck_masked(_duck_decoded('home_tel'))} AS home_tel,
           {_duck_masked(_duck_decoded('contact_tel'))} AS contact_tel
    FROM ({DUCK_CONTACTS})
    """
)
def policy_decode_mask(spark: SparkSession, folder: str) -> DataFrame:
    return K.apply_policy(_raw_contacts(spark, folder), DECODED_POLICY)


@query(
    f"""
    SELECT c_custkey, {_duck_masked(_duck_decoded('home_tel'))} AS home_tel,
           {_duck_masked(_duck_decoded('contact_tel'))} AS contact_tel
    FROM ({DUCK_CONTACTS})
    """
)
def mask_stored(spark: SparkSession, folder: str) -> DataFrame:
    root = shared_folder(spark, "mask")
    ensure_database(spark, SCRATCH, f"{root}/database")
    refresh_table(_raw_contacts(spark, folder), SCRATCH, root, "contacts")
    mask_stored_table(spark, SCRATCH, "contacts", root, DECODED_POLICY)
    return spark.table(quoted(SCRATCH, "contacts"))


@query(
    f"""
    SELECT c_custkey, {_duck_masked(_duck_decoded('home_tel'))} AS home_tel,
           {_duck_masked(_duck_decoded('contact_tel'))} AS contact_tel
    FROM (SELECT c_custkey, contact_tel, CASE WHEN c_custkey % 1000 < 20 THEN {OTHER_ESCAPED} ELSE home_tel END AS home_tel
          FROM ({DUCK_CONTACTS}))
    """
)
def mask_touched(spark: SparkSession, folder: str) -> DataFrame:
    """A masked table that gets new numbers by key and is masked again, where these are."""
    root = shared_folder(spark, "mask")
    ensure_database(spark, SCRATCH, f"{root}/database")
    contacts = _raw_contacts(spark, folder).repartitionByRange(16, "c_custkey")
    refresh_sliced_table(contacts, SCRATCH, root, "sliced_contacts")
    mask_changed_rows(spark, SCRATCH, "sliced_contacts", root, DECODED_POLICY)
    numbers = _customers(spark, folder, home_tel=OTHER_ESCAPED).where("c_custkey % 1000 < 20")
    update_by_key(spark, SCRATCH, root, "sliced_contacts", numbers, ["c_custkey"])
    mask_changed_rows(spark, SCRATCH, "sliced_contacts", root, DECODED_POLICY)
    return spark.table(quoted(SCRATCH, "sliced_contacts")).select("c_custkey", "home_tel", "contact_tel")


SUPPLIER_COLUMNS = {
    "contact_tel": SUPPLIER_PHONE,
    "address1": "CASE WHEN s_suppkey % 4 > 0 THEN s_name ELSE '' END",
    "address2": "CASE WHEN s_suppkey % 3 > 0 THEN s_name END",
    "block": "CAST(s_nationkey AS STRING)",
}


def _raw_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    derived = [F.expr(sql).alias(name) for name, sql in SUPPLIER_COLUMNS.items()]
    return scan_table(spark, folder, "supplier").select("s_suppkey", *derived)


DUCK_SUPPLIERS = (
    "SELECT s_suppkey, "
    + ", ".join(f"{sql} AS {name}" for name, sql in SUPPLIER_COLUMNS.items())
    + " FROM supplier"
)


@query(
    f"""
    SELECT s_suppkey, nullif({_duck_masked('contact_tel')}, '') AS contact_tel,
           CASE WHEN length(address1) > 0 THEN 'XXXXX' END AS address1,
           CASE WHEN length(address2) > 0 THEN 'XXXXX' END AS address2,
           CASE WHEN length(block) > 0 THEN 'XXXXX' END AS block
    FROM ({DUCK_SUPPLIERS})
    """
)
def policy_mask_redact(spark: SparkSession, folder: str) -> DataFrame:
    return K.apply_policy(_raw_suppliers(spark, folder), REDACTED_POLICY)


@query(
    f"""
    SELECT count(*) FILTER (WHERE home_tel IS NOT NULL OR contact_tel IS NOT NULL) AS rows_with_pii,
           count(*) AS rows_total
    FROM ({DUCK_CONTACTS})
    """
)
def pii_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return K.coverage(_raw_contacts(spark, folder), DECODED_POLICY)


def _duck_metrics(name: str) -> str:
    fits = _duck_fits(_duck_decoded(name))
    return f"""
        SELECT '{name}' AS column_name, count(*) FILTER (WHERE {name} <> '') AS n_visited,
               count(*) FILTER (WHERE {name} <> '' AND {fits}) AS n_masked,
               count(*) FILTER (WHERE {name} <> '' AND NOT {fits}) AS n_residue
        FROM contacts
    """


@query(
    f"""
    WITH contacts AS ({DUCK_CONTACTS})
    {_duck_metrics('home_tel')} UNION ALL {_duck_metrics('contact_tel')}
    """
)
def mask_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return K.mask_metrics(_raw_contacts(spark, folder), DECODED_POLICY)


@query(
    f"""
    SELECT c_custkey, {_duck_masked(_duck_decoded('home_tel'))} AS home_tel,
           {_duck_masked(_duck_decoded('contact_tel'))} AS contact_tel
    FROM ({DUCK_CONTACTS}) WHERE home_tel IS NOT NULL ORDER BY c_custkey LIMIT 3
    """
)
def mask_sample(spark: SparkSession, folder: str) -> DataFrame:
    masked = K.apply_policy(_raw_contacts(spark, folder), DECODED_POLICY)
    return K.masked_sample(masked, ["home_tel", "contact_tel"], "home_tel", "c_custkey")
