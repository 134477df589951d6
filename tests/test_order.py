"""Ranks by counting, splits, draws and alignment."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemodels.operators import align, order, sampling

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3)


@few
@given(st.lists(st.floats(-1e9, 1e9) | st.sampled_from([0.0, 1.0]), min_size=1, max_size=80))
def test_counted_percentiles_equal_numpy(spark, values):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = order.percentiles(frame(spark, values), "v", probs, small_rows=0)
    assert got == pytest.approx(np.percentile(values, [100 * p for p in probs]).tolist(), rel=1e-12, abs=1e-12)


def test_order_statistics_narrow_down_over_several_passes(spark):
    values = list(range(1000)) + [10**12] + [500] * 700  # one far value, one value on many rows
    at = order.order_statistics(frame(spark, values, "bigint"), "v", [0, 499, 500, 1200, 1699, 1700], bins=4)
    ranked = sorted(values)
    assert at == {r: ranked[r] for r in at}


def test_ranks_outside_are_refused(spark):
    with pytest.raises(ValueError, match="outside"):
        order.order_statistics(frame(spark, [1.0, float("nan")]), "v", [1])
    with pytest.raises(TypeError, match="no ranks"):
        order.order_statistics(spark.range(2).select(F.array("id").alias("v")), "v", [0])


@pytest.mark.parametrize("small_rows", [0, 1000])
def test_null_and_nan_have_no_rank_on_either_path(spark, small_rows):
    df = frame(spark, [3.0, float("nan"), 1.0, None, 2.0, float("nan")])
    assert order.percentiles(df, "v", [0.0, 0.5, 1.0], small_rows) == [1.0, 2.0, 3.0]
    assert order.percentiles(frame(spark, [None, float("nan")]), "v", [0.5], small_rows) == [None]


WORDS = st.text(alphabet=st.sampled_from("ab\x00é中\U0001f642"), max_size=6) | st.sampled_from(["", "x" * 200, "x" * 200 + "a", "x" * 64, "x" * 63])


@few
@given(st.lists(WORDS, min_size=1, max_size=60), st.sampled_from(["string", "binary"]), st.sampled_from([2, 4096]))
def test_every_rank_of_strings_and_bytes(spark, values, kind, bins):
    values = values if kind == "string" else [v.encode() for v in values]
    got = order.order_statistics(frame(spark, [*values, None], kind), "v", range(len(values)), bins)
    want = sorted(values, key=lambda v: v.encode() if kind == "string" else v)
    assert [got[r] for r in range(len(values))] == want


@pytest.mark.parametrize("kind, values", [
    ("date", [dt.date(1969, 12, 31), dt.date(2024, 2, 29), dt.date(1, 1, 1), dt.date(2024, 2, 29)]),
    ("timestamp", [dt.datetime(1969, 12, 31, 23, 59, 59, 999_999, dt.timezone.utc), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc),
                   dt.datetime(2024, 1, 1, 0, 0, 0, 1, dt.timezone.utc)]),
    ("timestamp_ntz", [dt.datetime(2024, 3, 31, 2, 30), dt.datetime(2024, 3, 31, 2, 30, 0, 1), dt.datetime(1900, 1, 1)]),
    ("decimal(18, 4)", [Decimal("1.0001"), Decimal("-99999999999999.9999"), Decimal("1.0002"), Decimal("0.0000")]),
    ("boolean", [True, False, True]),
])
def test_every_rank_of_other_kinds(spark, kind, values):
    df = frame(spark, [*values, None], kind)
    got = order.order_statistics(df, "v", range(len(values)), bins=4)
    assert [got[r] for r in range(len(values))] == sorted(values)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("kind", ["string", "timestamp", "timestamp_ntz", "date", "bigint", "decimal(12, 2)"])
def test_splits_and_slices_on_any_key(spark, kind, zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        n = F.col("id") * 37 % 101
        key = {"string": F.concat(F.lit("key/"), F.lpad(n.cast("string"), 3, "0")), "timestamp": F.timestamp_micros(n * 10**12 + 7),
               "timestamp_ntz": F.timestamp_micros(n * 10**12 + 7).cast("timestamp_ntz"), "date": F.date_from_unix_date(n.cast("int"))}
        df = spark.range(101).select(n.alias("n"), key.get(kind, n.cast(kind)).alias("k")).repartition(3)
        train, test = (sorted(r["n"] for r in d.collect()) for d in order.prefix_split(df, "k", 0.6))
        assert train == list(range(61)) and test == list(range(61, 101))
        assert sorted(r["n"] for r in order.row_slice(df, "k", 10, 15).collect()) == [10, 11, 12, 13, 14]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def jobs_of(spark, work):
    """How many jobs a piece of work starts."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    try:
        before = len(sc.statusTracker().getJobIdsForGroup("counted"))
        work()
        return len(sc.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        sc._jsc.clearJobGroup()


def test_columns_share_their_counting_jobs(spark):
    df = spark.range(3000).select(*[((F.col("id") * (7 + 2 * i)) % 2999 / (1.0 + i)).alias(f"c{i}") for i in range(6)], F.col("id").cast("string").alias("s"))
    names = [f"c{i}" for i in range(6)]
    ranks = {c: [0, 1500, 2999] for c in [*names, "s"]}
    got = order.order_statistics_of(df, ranks, bins=64)
    for c in ranks:
        values = sorted(r[0] for r in df.select(c).collect())
        assert got[c] == {r: values[r] for r in ranks[c]}
    one = jobs_of(spark, lambda: order.order_statistics_of(df, {"c0": ranks["c0"]}, bins=64))
    assert jobs_of(spark, lambda: order.order_statistics_of(df, {c: ranks[c] for c in names}, bins=64)) <= one + 2


def test_one_pass_brings_back_a_bounded_number_of_cells(spark, monkeypatch):
    monkeypatch.setattr(order, "MAX_CELLS", 100)
    df = spark.range(500).select((F.col("id") * 13 % 499).alias("v"))
    values = sorted(r[0] for r in df.collect())
    got = order.order_statistics(df, "v", range(0, 500, 7))
    assert got == {r: values[r] for r in range(0, 500, 7)}


def test_number_rows_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    rows = order.number_rows(df, "place", F.desc("g"), F.asc("k")).collect()
    want = sorted(((-r["g"], r["k"]) for r in rows))
    assert sorted(r["place"] for r in rows) == list(range(1000))
    assert [(-r["g"], r["k"]) for r in sorted(rows, key=lambda r: r["place"])] == want
    assert order.number_rows(df.limit(0), "place", F.asc("k")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 10, 13])
def test_prefix_split_is_complete_and_ordered(spark, n):
    df = spark.range(n).select((F.col("id") * 37 % 1009).alias("k"))
    train, test = (sorted(r[0] for r in d.collect()) for d in order.prefix_split(df, "k"))
    assert len(train) == round(0.8 * n) and len(train) + len(test) == n
    assert not train or not test or max(train) < min(test)


def test_row_slice(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("k"))
    assert sorted(r[0] for r in order.row_slice(df, "k", 10, 13).collect()) == [30, 33, 36]
    assert order.row_slice(df, "k", 60).count() == 0


def test_hash_split_does_not_depend_on_partitions(spark):
    ids = spark.range(1000).withColumnRenamed("id", "k")
    parts = [{r[0] for r in sampling.hash_split(ids.repartition(p), "k")[0].collect()} for p in (1, 3, 7)]
    assert parts[0] == parts[1] == parts[2]
    both = sampling.hash_split(ids, "k", (60, 30, 10))
    assert sum(p.count() for p in both) == 1000
    assert 740 < len(parts[0]) < 860


def test_draws_are_uniform_and_partition_free(spark):
    ids = spark.range(20).withColumnRenamed("id", "k")
    draws = [
        [tuple(r) for r in sampling.draw_with_replacement(ids.repartition(p), "k", 4000, 3).orderBy("t").collect()]
        for p in (1, 5)
    ]
    assert draws[0] == draws[1] and [t for t, _ in draws[0]] == list(range(4000))
    counts = np.bincount([k for _, k in draws[0]], minlength=20)
    assert counts.min() > 140 and counts.max() < 260


def test_deeper_bits_draw_the_same_rows(spark):
    rows = spark.range(3000).select((F.col("id") * 7).alias("k"), F.col("id").cast("string").alias("p")).unionByName(
        spark.createDataFrame([(None, "never")], "k long, p string"))
    want = sorted(tuple(r) for r in sampling.draw_with_replacement(rows, "k", 500, 9, "p", handful=10**9).collect())
    assert [t for t, _, _ in want] == list(range(500)) and all(k == 7 * int(p) for _, k, p in want)
    for first, handful in ((1, 1), (4, 2), (8, 100)):
        got = sampling.draw_with_replacement(rows, "k", 500, 9, "p", handful=handful, first_bits=first)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_rows_ranked_go_with_the_draws(spark):
    """No more than a few rows a draw reach the ranking, whatever the size of the table."""
    for rows in (5_000, 80_000):
        ids = spark.range(rows).withColumnRenamed("id", "k")
        draws = sampling.draw_with_replacement(ids, "k", 40, 1, handful=8, first_bits=4)
        before = sampling._hash_bits(F.col("k"))
        drawn = draws.select(before.alias("h"))
        bits = 4
        while rows / 2**bits > 8:
            bits = min(bits + sampling.LEVEL_BITS, sampling.HASH_BITS)
        leaf = F.shiftright("h", sampling.HASH_BITS - bits).alias("b")
        ranked = ids.select(before.alias("h")).select(leaf).join(drawn.select(leaf).distinct(), "b", "left_semi").count()
        assert draws.count() == 40 and ranked <= 40 * 8


def test_more_draws_than_a_lookup_table_holds(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MAX_LOOKUP_ROWS", 50)
    ids = spark.range(200).withColumnRenamed("id", "k")
    many = sampling.draw_with_replacement(ids, "k", 700, 2, handful=2, first_bits=3)
    assert "BroadcastExchange" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["t"] for r in many.collect()) == list(range(700))
    with pytest.raises(ValueError, match="no rows"):
        sampling.draw_with_replacement(ids.limit(0), "k", 3, 2)


def test_normal_draws_on_either_side_agree(spark):
    start = sampling.normal_start(4, 300, 7)
    rows = spark.range(4).repartition(2).select("id", sampling.normal_vector(7, F.col("id"), 300).alias("z")).collect()
    assert np.allclose([r["z"] for r in sorted(rows)], start, atol=1e-12)
    assert abs(start.mean()) < 0.1 and abs(start.std() - 1) < 0.1


def test_weighted_draw_follows_the_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "k int, w double")
    hits = [sampling.weighted_draw(df, "k", F.col("w"), s).first()["k"] for s in range(60)]
    assert 3 not in hits and hits.count(2) > hits.count(1) > 0


def test_mini_batches_have_the_size_asked_for(spark):
    one, other = (
        {r["id"]: r["batch"] for r in sampling.mini_batches(spark.range(0, 103, 1, p), "id", 10).collect()} for p in (1, 4)
    )
    assert one == other  # by id, not by partition
    assert np.bincount(list(one.values())).tolist() == [10] * 10 + [3]


def test_cached_is_released(spark):
    with sampling.cached(spark.range(10)) as (held, n):
        assert n == 10 and held.is_cached
    assert not held.is_cached


def test_align_refuses_missing_and_duplicate_ids(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    missing = spark.createDataFrame([(1, "x")], "k int, q string")
    twice = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, q string")
    for bad in (missing, twice):
        with pytest.raises(ValueError, match="k 2 occurs"):
            align.align([a, bad], "k")
    assert align.align([a, a.withColumnRenamed("p", "r")], "k").count() == 2
