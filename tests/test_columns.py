"""Cleaning, encoding and vector expressions on odd values."""

import math
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemodels.functions import clean
from tablemodels.functions import vectors as V
from tablemodels.operators import features, profile

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
texts = st.one_of(
    st.none(),
    st.sampled_from(["", " ", "n/a", "-500 BC", " 12 ", "1d", "2.5f", "+3", "1e3", ".5", "-0", "abc12def7", "٣", "0x1F"]),
    st.text(alphabet="0123456789.-+eE dfx ", max_size=6),
)
numbers = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False)


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(df, expr):
    return [r[0] for r in df.select("i", expr.alias("r")).orderBy("i").select("r").collect()]


def plain_number(text):
    """A decimal numeral as a data file writes it."""
    if text is None or not re.fullmatch(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*", text):
        return 0.0
    return float(text)


@few
@given(st.lists(texts, min_size=1, max_size=60))
def test_to_number(spark, values):
    got = results(column(spark, values, "string"), clean.to_number(F.col("v")))
    assert got == [plain_number(v) for v in values]


@few
@given(st.lists(texts, min_size=1, max_size=60))
def test_first_digits(spark, values):
    got = results(column(spark, values, "string"), clean.first_digits(F.col("v")))
    want = [None if v is None else (re.search(r"[0-9]+", v) or [None])[0] for v in values]
    assert got == want


@few
@given(st.lists(texts, min_size=1, max_size=60))
def test_blank_and_complete_rows(spark, values):
    df = column(spark, values, "string")
    assert results(clean.blank_to_null(df, ["v"]), F.col("v")) == [None if v == "" else v for v in values]
    kept = clean.require_present(df, ["v"])
    again = clean.drop_incomplete(clean.blank_to_null(df, ["v"]))
    assert kept.count() == again.count() == sum(v not in (None, "") for v in values)


@few
@given(st.lists(st.one_of(st.none(), numbers, st.sampled_from([1.0, 2.0, 3.0])), min_size=1, max_size=60))
def test_bucket_boundaries(spark, values):
    df = column(spark, values, "double")
    open_, right = (results(df, clean.bucket_by_cuts(F.col("v"), [1.0, 2.0, 3.0], b)) for b in ("null", "right"))
    for v, o, r in zip(values, open_, right):
        if v is None:
            assert o is None and r is None
        else:
            assert r == 1 + sum(v >= c for c in (1.0, 2.0, 3.0))
            assert o == (None if v in (1.0, 2.0, 3.0) else r)


@few
@given(st.lists(numbers, min_size=1, max_size=60))
def test_cycle_floors_and_rounds_half_even(spark, values):
    values = values + [-0.5, 0.5, 1.5, 2.5, -11.5, 12.5]
    got = results(column(spark, values, "double"), clean.cycle(F.col("v")))
    assert got == pytest.approx([float(round(v % 12)) for v in values])


def test_strict_cast_fails_and_lenient_does_not(spark):
    df = column(spark, ["1.5", "x", ""], "string")
    assert results(clean.cast_columns(df, ["v"], "float"), F.col("v")) == [1.5, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean.cast_columns(df, ["v"], "float", strict=True).collect()


def test_overwrite_is_strict(spark):
    got = results(column(spark, [2017, 2018, 2019, None], "int"), clean.overwrite_above(F.col("v"), 2018))
    assert got == [2017, 2018, 0, None]


@few
@given(st.lists(st.one_of(st.none(), st.sampled_from("abcdexyz")), min_size=1, max_size=60))
def test_category_orders(spark, values):
    df = column(spark, values, "string")
    present = [v for v in values if v is not None]
    by_count = sorted(set(present), key=lambda v: (-present.count(v), v))
    assert features.frequency_labels(df, "v") == by_count
    assert features.alphabetical_labels(df, "v") == sorted(set(present))
    table = {r["value"]: r["index"] for r in features.frequency_index_table(df, "v").collect()}
    assert table == {v: i for i, v in enumerate(by_count)}
    if present:
        hot = features.one_hot_sorted(df.na.drop(), "v", "hot").select("v", "hot").collect()
        assert all(sum(r["hot"]) == 1 and r["hot"][sorted(set(present)).index(r["v"])] == 1 for r in hot)


def test_one_hot_outside_range_fails(spark):
    with pytest.raises(Exception, match="index outside 0..2"):
        column(spark, [3], "int").select(V.one_hot(F.col("v"), 3)).collect()


def test_reshape_needs_matching_size(spark):
    with pytest.raises(Exception, match="cannot reshape"):
        spark.range(1).select(V.reshape(F.array(F.lit(1.0), F.lit(2.0)), 1, 3)).collect()


@few
@given(st.lists(numbers, min_size=1, max_size=80))
def test_histogram_counts_every_row(spark, values):
    bars = profile.histogram(column(spark, values, "double"), "v", 7).orderBy("bin").collect()
    lo, hi = min(values), max(values)
    assert sum(b["n"] for b in bars) == len(values) and len(bars) == 7
    if hi - lo > 1e-3:
        assert bars[-1]["n"] >= sum(v == hi for v in values)
        assert [b["n"] for b in bars] == pytest.approx(np.histogram(values, 7)[0].tolist(), abs=1)


def test_scaler_keeps_constant_columns_at_zero(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "x array<double>")
    got = [r[0] for r in features.standardise(df, "x", "x").orderBy("x").collect()]
    assert got == [[-1.0, 0.0], [1.0, 0.0]]


def test_scaler_can_be_fitted_on_training_rows(spark):
    train = spark.createDataFrame([([0.0],), ([2.0],)], "x array<double>")
    test = spark.createDataFrame([([5.0],)], "x array<double>")
    assert features.standardise(test, "x", "x", fit_on=train).first()[0] == [4.0]


def test_log_sum_exp_does_not_overflow(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],)], "x array<double>")
    assert df.select(V.log_sum_exp(F.col("x"))).first()[0] == pytest.approx(1000 + math.log(2))
