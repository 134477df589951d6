"""Plans and behaviour that matter on large, skewed input."""

import os
import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT, matrix
from pyspark.sql import functions as F

from checks import base
from tablemodels import session
from tablemodels.functions import clean
from tablemodels.operators import blocks, cluster, features, groups, order, profile, sampling


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot(points):
    """A third and more of all rows under one label."""
    return points.withColumn("label", F.when(F.col("vec_id") % 5 < 2, 0).otherwise(F.col("label"))).repartition(6)


def test_presence_filter_and_columns_reach_the_scan(spark, sf):
    rows = clean.require_present(base.read(spark, sf, "orders", "o_orderkey", "o_orderstatus"), ["o_orderstatus"])
    text = plan(rows)
    assert "IsNotNull(o_orderstatus)" in text and "Not(EqualTo(o_orderstatus,))" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_split_by_rank_is_a_pushed_filter(spark, sf):
    train, _ = order.prefix_split(base.read(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_orderkey")
    assert "LessThanOrEqual(o_orderkey," in plan(train) and "Window" not in plan(train)


def test_only_the_vector_leaves_the_jvm(points):
    text = plan(points.select("vec_id", "label", cluster.nearest(F.col("x"), np.zeros((2, 64))).alias("n")))
    assert "ArrowEval" in text and "[assign(x" in text


def test_group_aggregates_are_partial_before_the_shuffle(points):
    text = plan(groups.group_means(points, "label", "x"))
    assert text.count("ObjectHashAggregate") + text.count("SortAggregate") >= 2 and text.count("Exchange") == 1


def test_representatives_rank_few_rows(points, monkeypatch):
    monkeypatch.setattr(cluster, "RANK_SALT", 2)
    centres = np.array([[0.1 * k] * 64 for k in range(3)])
    ranked = cluster.representatives(points.repartition(9), "vec_id", "x", centres, 2)
    text = plan(ranked)
    assert "WindowGroupLimit" in text and text.index("WindowGroupLimit") > text.index("Window [") and "_salt" in text
    ids, x = matrix(points)
    for k, c in enumerate(centres):
        near = np.lexsort((ids, ((x - c) ** 2).sum(axis=1)))[:2]
        assert [r["vec_id"] for r in sorted(ranked.filter(f"cluster = {k}").collect(), key=lambda r: r["rank"])] == ids[near].tolist()


def test_start_looks_at_the_newest_centre_only(points, monkeypatch):
    seen, real = [], cluster.nearest
    monkeypatch.setattr(cluster, "nearest", lambda v, c: seen.append(len(c)) or real(v, c))
    monkeypatch.setattr(cluster, "CUT_ROUNDS", 3)
    start = cluster.plus_plus_start(points, "vec_id", "x", 8, 4)
    assert seen == [1] * 7
    monkeypatch.setattr(cluster, "CUT_ROUNDS", 100)
    assert np.array_equal(start, cluster.plus_plus_start(points.repartition(3), "vec_id", "x", 8, 4))


@pytest.mark.parametrize("few", [0, 10**6])
def test_covariances_of_many_groups(spark, monkeypatch, few):
    monkeypatch.setattr(groups, "FEW_GROUPS", few)
    monkeypatch.setattr(groups, "PART_ROWS", 50)
    x = F.array(*[F.sin(F.col("id") * (j + 1)) * 3 + 1000 for j in range(9)])
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 != 1, F.col("id") % 25)  # a third under one key, some under none
    df = spark.range(1500).select(key.alias("k"), x.alias("x")).repartition(4)
    rows = df.collect()
    got = {r["k"]: r for r in groups.group_covariances(df, "k", "x", 9).collect()}
    assert set(got) == {r["k"] for r in rows} and None in got
    for k, r in got.items():
        held = np.array([q["x"] for q in rows if q["k"] == k])
        assert r["n"] == len(held) and np.allclose(r["mean"], held.mean(0)) and np.allclose(r["cov"], np.cov(held.T))


def test_hot_label_gives_whole_results(points):
    df = hot(points)
    rows = df.select("label", "x").collect()
    x = {k: np.array([r["x"] for r in rows if r["label"] == k]) for k in {r["label"] for r in rows}}
    for r in groups.group_means(df, "label", "x").collect():
        assert r["n"] == len(x[r["label"]]) and np.allclose(r["mean"], x[r["label"]].mean(0))
    for r in groups.group_covariances(df, "label", "x").collect():
        assert np.allclose(r["cov"], np.cov(x[r["label"]].T))


def test_hot_value_in_order_statistics(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 10.0).alias("v")).repartition(5)
    values = np.array([r[0] for r in df.collect()])
    got = order.percentiles(df, "v", [0.01, 0.2, 0.5, 0.9], small_rows=0)
    assert np.allclose(got, np.percentile(values, [1, 20, 50, 90]))


def test_salted_and_plain_sums_agree(spark):
    df = spark.range(0, 400, 1, 40).select((F.col("id") % 3).alias("k"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("v"), F.lit(1).alias("n"))
    plain, salted = (
        {r["k"]: (r["v"], r["n"]) for r in blocks.sum_vectors(df, ["k"], "v", ["n"], salt).collect()} for salt in (0, 8)
    )
    assert plain.keys() == salted.keys()
    assert all(np.allclose(plain[k][0], salted[k][0]) and plain[k][1] == salted[k][1] for k in plain)


def test_partial_products_are_cut_into_pieces(points, monkeypatch):
    few = points.select("vec_id", F.slice("x", 1, 3).alias("x"))
    monkeypatch.setattr(blocks, "PARTIAL_CELLS", 20)
    got = {r["vec_id"]: (r["n"], r["gram"]) for r in blocks.gram(few, "x", "vec_id").collect()}
    ids, x = matrix(few)
    assert len(got) == len(ids)
    assert all(got[i][0] == 1 and np.allclose(got[i][1], np.outer(v, v).ravel()) for i, v in zip(ids, x))


def test_ragged_and_null_vectors_are_refused(spark):
    for bad in ([([1.0],), ([1.0, 2.0],)], [([1.0],), (None,)]):
        df = spark.createDataFrame(bad, "x array<double>").coalesce(1)
        with pytest.raises(Exception, match="differ in length|holds nulls"):
            df.select(cluster.nearest(F.col("x"), np.zeros((1, 1)))).collect()


def test_empty_partitions_are_fine(points):
    wide = points.repartition(200).filter("vec_id < 20")
    model = cluster.kmeans_fit(wide, "vec_id", "x", 2, "++", rounds=2)
    assert model.centres.shape == (2, 64)
    assert features.standardise(wide, "x", "x").count() == wide.count()
    assert profile.histogram(wide.select("vec_id"), "vec_id", 4).agg(F.sum("n")).first()[0] == wide.count()


def test_sizes_are_checked_before_sending(spark, points, monkeypatch):
    monkeypatch.setattr(session, "MAX_MODEL_CELLS", 10)
    with pytest.raises(ValueError, match="centre table has 128 cells"):
        cluster.nearest(F.col("x"), np.zeros((2, 64)))
    monkeypatch.setattr(session, "MAX_LOOKUP_ROWS", 3)
    with pytest.raises(ValueError, match="too many"):
        session.small_table(spark, [(i,) for i in range(4)], "v int")
    with pytest.raises(ValueError, match="more than 3 rows"):
        session.collect_bounded(points.select("vec_id"), 3, "ids")


def test_scratch_folder_is_the_shared_one(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = session.scratch_dir(spark, "t")
    assert path.startswith((root or spark.conf.get("spark.checkpoint.dir")).rstrip("/"))
    assert path != session.scratch_dir(spark, "t")


def test_cached_inputs_are_released(spark, points):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    cluster.kmeans_fit(points, "vec_id", "x", 2, "++", rounds=1)
    sampling.draw_with_replacement(points, "vec_id", 5, 1).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_bench_prints_one_json_line():
    import json

    code = "import bench; bench.HEADLINE = ['a1_row_count']; bench.main()"
    env = {**os.environ, "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_RUNS": "1"}
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    line = json.loads(out.stdout.strip().splitlines()[-1])
    assert line["unit"] == "sec" and list(line["queries"]) == ["a1_row_count"] and line["sf"] == "0.001"


def test_small_image_files_share_tasks(spark, tmp_path):
    """A thousand small files are read by few tasks, not by one for every few dozen."""
    from checks import images
    from tablemodels.sources import readers

    rows = spark.range(1000).selectExpr("id AS vec_id", "CAST(id % 3 AS INT) AS label", "array_repeat(CAST(id % 256 AS DOUBLE), 4) AS pixels")
    images.write_image_folder(rows, str(tmp_path), 2, 2, 1)
    found = readers.read_image_folder(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert found.count() == 1000 and found.select("origin").distinct().count() == 1000
    assert sorted(tuple(r) for r in readers.class_file_counts(spark, str(tmp_path)).collect()) == [("0", 334), ("1", 333), ("2", 333)]
