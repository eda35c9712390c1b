"""Masking rules on known values and as properties."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clearledger.functions import text
from clearledger.operators import masking as K
from clearledger.specs import MASK_POLICIES, MaskPolicy

PHONES = {
    "9875 5676": "9875 XXXX",
    "98755676": "9875 XXXX",
    "9875\t5676": "9875 XXXX",
    "9875\u00a05676": "9875 XXXX",
    " 9875 5676\u3000": "9875 XXXX",
    "\x1c98755676\x1f": "9875 XXXX",
    "98755676\n": "9875 XXXX",
    "9875  5676": "9875  5676",
    "9875 XXXX": "9875 XXXX",
    "+6598755676": "+6598755676",
    " 123 ": " 123 ",
    "９８７５５６７６": "９８７５５６７６",
    "": "",
    None: None,
}
ESCAPED = {
    "_x0038_501_x0020_5936": "8501 XXXX",
    " _x0041_bc ": "_x0041_bc",
    "_x0_x0030_39_": "9",
    "_x00_x0033_0_": "_x0030_",
    "_x0020_9875 5676_x0020_": "9875 XXXX",
    " ": "",
    "": "",
    None: None,
}


def column(spark, values):
    rows = list(enumerate(values))
    return spark.createDataFrame(rows, "i int, v string").orderBy("i")


def test_mask_phone(spark):
    df = column(spark, PHONES).select(text.mask_phone(F.col("v")).alias("v"))
    assert [r.v for r in df.collect()] == list(PHONES.values())


def test_decode_then_mask(spark):
    df = K.apply_policy(column(spark, ESCAPED), MaskPolicy(escaped_phones=("v",)))
    assert [r.v for r in df.collect()] == list(ESCAPED.values())


def test_mask_and_redact_policy(spark):
    df = spark.createDataFrame(
        [("9875 5676", "Road 1", None, "1A"), ("", "", " ", ""), (None, None, None, None)],
        "tel string, a string, b string, c string",
    )
    policy = MaskPolicy(phones=("tel",), redacted=("a", "b", "c"))
    assert [tuple(r) for r in K.apply_policy(df, policy).collect()] == [
        ("9875 XXXX", "XXXXX", None, "XXXXX"),
        (None, None, "XXXXX", None),
        (None, None, None, None),
    ]
    assert K.coverage(df, policy).first().rows_with_pii == 2


def test_numbers_are_masked_as_text(spark):
    df = spark.sql("SELECT 98755676L AS a, 98755676L AS b, 12.5D AS c")
    policy = MaskPolicy(escaped_phones=("a",), phones=("b",), redacted=("c",))
    assert tuple(K.apply_policy(df, policy).first()) == ("9875 XXXX", "9875 XXXX", "XXXXX")
    assert [r.n_masked for r in K.mask_metrics(df, policy).collect()] == [1, 1, 1]


def test_metrics_add_up(spark):
    df = column(spark, PHONES)
    row = K.mask_metrics(df, MaskPolicy(phones=("v",))).first()
    assert (row.n_visited, row.n_masked, row.n_residue) == (12, 7, 5)
    assert row.n_visited == row.n_masked + row.n_residue


def test_policies_cover_the_declared_columns():
    assert MASK_POLICIES["emd"].columns == ("RESIDENT_TEL", "CONTACT_TEL")
    assert len(MASK_POLICIES["inpatient_movement"].columns) == 4


@pytest.fixture(scope="module")
def masked(spark):
    def run(values):
        df = column(spark, values)
        once = df.select("i", "v", text.mask_phone(F.col("v")).alias("m"), text.redact(F.col("v")).alias("r"))
        return once.select(
            "v", "m", text.mask_phone(F.col("m")).alias("mm"), "r", text.redact(F.col("r")).alias("rr")
        ).collect()

    return run


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.one_of(st.none(), st.from_regex(r"\s?[0-9]{4}\s?[0-9]{4}\s?", fullmatch=True), st.text(max_size=12)),
        min_size=1,
        max_size=50,
    )
)
def test_masking_twice_changes_nothing(masked, values):
    values = [v if v is None else v.encode("utf-8", "ignore").decode() for v in values]
    for row in masked(values):
        assert row.m == row.mm
        assert row.r == row.rr


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x1c\x85\u00a0\u2003\u3000ab1", max_size=8), min_size=1, max_size=50))
def test_strip_equals_python(spark, values):
    df = column(spark, values).select("v", text.strip(F.col("v")).alias("s"))
    assert all(r.s == r.v.strip() for r in df.collect())
