"""Rows as JSON, and truth of JSON values."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from clearledger.functions import jsonvalues as J

ROW = """
    SELECT 1 AS i, CAST(2.50 AS DECIMAL(10,2)) AS d, DATE'2024-01-02' AS day,
           TIMESTAMP_NTZ'2024-01-02 03:04:05' AS at, TIMESTAMP_NTZ'2024-01-02 03:04:05.000120' AS at_micros,
           TIMESTAMP'2024-01-02 03:04:05+00:00' AS zoned, CAST(NULL AS STRING) AS missing, true AS b,
           array(DATE'2024-01-02', NULL) AS days,
           named_struct('at', TIMESTAMP_NTZ'2024-01-02 03:04:05.5', 'price', 1.25BD) AS inner,
           CAST(NULL AS STRUCT<at: TIMESTAMP_NTZ>) AS no_inner, map('k', 1.5BD) AS m
"""


def test_strict(spark):
    assert json.loads(J.rows_as_json(spark.sql(ROW)).first()[0]) == {
        "i": 1, "d": 2.5, "day": "2024-01-02", "at": "2024-01-02T03:04:05",
        "at_micros": "2024-01-02T03:04:05.000120", "zoned": "2024-01-02T03:04:05+00:00",
        "missing": None, "b": True, "days": ["2024-01-02", None],
        "inner": {"at": "2024-01-02T03:04:05.500000", "price": 1.25}, "no_inner": None, "m": {"k": 1.5},
    }


def test_stringify(spark):
    found = json.loads(J.rows_as_json(spark.sql(ROW), stringify=True).first()[0])
    assert found["d"] == "2.50"
    assert found["at"] == "2024-01-02 03:04:05"
    assert found["at_micros"] == "2024-01-02 03:04:05.000120"
    assert found["inner"] == {"at": "2024-01-02 03:04:05.500000", "price": "1.25"}


def test_what_json_cannot_hold(spark):
    df = spark.sql("SELECT X'01' AS raw, INTERVAL '1' DAY AS span")
    with pytest.raises(TypeError, match="not JSON serializable"):
        J.rows_as_json(df)
    assert "span" in json.loads(J.rows_as_json(df, stringify=True).first()[0])


def test_repeated_names_keep_the_last_value(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b, 3 AS a")
    assert J.rows_as_json(df).first()[0] == '{"a":3,"b":2}'


TRUTH = {
    '{"p":null}': False, '{"p":""}': False, '{"p":[]}': False, '{"p":{}}': False, '{"p":0}': False,
    '{"p":0.0}': False, '{"p":false}': False, "{}": False, "[1]": False,
    '{"p":" "}': True, '{"p":"0"}': True, '{"p":"[]"}': True, '{"p":[null]}': True,
    '{"p":{"a":null}}': True, '{"p":0.5}': True, '{"p":-1}': True, '{"p":true}': True, '{"p":[[]]}': True,
}


def test_truth(spark):
    df = spark.createDataFrame(list(enumerate(TRUTH)), "i int, j string").withColumn("v", F.try_parse_json("j"))
    rows = df.orderBy("i").select("j", J.is_truthy(J.field(F.col("v"), "p")).alias("t")).collect()
    assert {r.j: r.t for r in rows} == TRUTH


def test_repeated_columns_of_a_join(spark):
    a = spark.range(3)
    joined = a.alias("x").join(a.alias("y"), F.col("x.id") == F.col("y.id"))
    assert [r[0] for r in J.rows_as_json(joined).collect()] == ['{"id":0}', '{"id":1}', '{"id":2}']


def test_names_that_repeat_or_differ_by_case(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS A, 3 AS a, named_struct('x', 1, 'X', 2) AS s")
    assert J.rows_as_json(df).first().row_json == '{"a":3,"A":2,"s":{"x":1,"X":2}}'
