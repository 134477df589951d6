"""Clustering, classifiers, regression, perceptrons, networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.base import SQL_HOLE, SQL_PLANE, SQL_POINTS, long_vector, plane, points, query, read, rnd, sql_long, sql_rnd, sql_uniform, with_holes
from checks.profiles import sql_draws, sql_normal
from checks.tables import GRID_SQL, WEIGHTS, sql_list
from tablemodels.functions import vectors as V
from tablemodels.operators import basis, cluster, generative, groups, perceptron, regions
from tablemodels.operators import softmax as sm
from tablemodels.session import scratch_dir, small_table
from tablemodels.sources import readers, writers

# ---- k-means

ROUNDS = 3
SQL_START = (
    f"p AS MATERIALIZED ({SQL_POINTS}), c0 AS MATERIALIZED (SELECT label AS k, x AS c FROM "
    "(SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM p) WHERE rn = 1)"
)


def sql_assign(i: int, centres: str) -> str:
    return (
        f"a{i} AS MATERIALIZED (SELECT vec_id, x, k, d FROM (SELECT vec_id, x, k, d, row_number() OVER "
        f"(PARTITION BY vec_id ORDER BY d, k) AS rn FROM (SELECT vec_id, x, k, pow(list_distance(x, c), 2) AS d FROM p, {centres})) WHERE rn = 1)"
    )


def sql_move(i: int) -> str:
    return (
        f"c{i} AS MATERIALIZED (SELECT c{i - 1}.k, coalesce(m.c, c{i - 1}.c) AS c FROM c{i - 1} LEFT JOIN (SELECT k, list(v ORDER BY j) AS c FROM "
        f"(SELECT k, j, avg(x[j]) AS v FROM a{i}, range(1, 65) t(j) GROUP BY k, j) GROUP BY k) m ON m.k = c{i - 1}.k)"
    )


def sql_lloyd(rounds: int) -> str:
    """One assignment and one move CTE per round, from the lowest id of each label."""
    return "WITH " + ", ".join([SQL_START] + [s for i in range(1, rounds + 1) for s in (sql_assign(i, f"c{i - 1}"), sql_move(i))])


def label_start(df) -> np.ndarray:
    firsts = [r[0] for r in df.groupBy("label").agg(F.min("vec_id")).select("min(vec_id)").collect()]  # ten labels
    rows = df.filter(F.col("vec_id").isin(firsts)).select("label", "x").collect()
    return np.array([r["x"] for r in sorted(rows)])


def lloyd(spark, sf):
    df = points(spark, sf)
    return df, cluster.kmeans_fit(df, "vec_id", "x", 10, start=label_start(df), rounds=ROUNDS)


@query("m1_kmeans_fit", sql_lloyd(ROUNDS) + " " + sql_long("k::INTEGER AS cluster", "c", f"c{ROUNDS}").replace("SELECT k::INTEGER AS cluster, (pos", "SELECT cluster, (pos"))
def _(spark, sf):
    return long_vector(lloyd(spark, sf)[1].centre_table(spark), "centre", "cluster")


SQL_NORMAL_START = SQL_START.split(", c0 AS")[0] + (
    f", c0 AS MATERIALIZED (SELECT k, list(z ORDER BY j) AS c FROM (SELECT k, j, {sql_normal(3, 'k', 'j')} AS z FROM range(10) t(k), range(64) u(j)) GROUP BY k)"
)


@query(
    "m2_kmeans_normal_start",
    sql_lloyd(ROUNDS).replace(SQL_START, SQL_NORMAL_START) + " " + " UNION ALL ".join(
        f"SELECT {2 * i - 2}::INTEGER AS step, {sql_rnd('sum(d)')} AS objective FROM a{i} UNION ALL "
        f"SELECT {2 * i - 1}::INTEGER, {sql_rnd('sum(pow(list_distance(x, c), 2))')} FROM a{i} JOIN c{i} USING (k)" for i in range(1, ROUNDS + 1)
    ),
)
def _(spark, sf):
    df = points(spark, sf)
    history = cluster.kmeans_fit(df, "vec_id", "x", 10, rounds=ROUNDS, seed=3).history_table(spark)
    return history.withColumn("objective", rnd("objective"))


SEED = 9


def sql_plus_plus(k: int) -> str:
    first = f"s0 AS MATERIALIZED (SELECT 0 AS k, vec_id, x AS c FROM p ORDER BY {sql_uniform(f"'{SEED}|0|' || vec_id")}, vec_id LIMIT 1)"
    steps = [first]
    for i in range(1, k):
        near = f"(SELECT p.vec_id, x, min(pow(list_distance(x, c), 2)) AS d FROM p, s{i - 1} GROUP BY p.vec_id, x)"
        clock = f"-ln({sql_uniform(f"'{SEED}|{i}|' || vec_id")}) / (d * d)"
        steps.append(
            f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL (SELECT {i}, vec_id, x FROM {near} WHERE d > 1e-18 ORDER BY {clock}, vec_id LIMIT 1))"
        )
    return f"WITH p AS MATERIALIZED ({SQL_POINTS}), " + ", ".join(steps)


@query("m3_plus_plus_start", sql_plus_plus(6) + " " + sql_long("k::INTEGER AS cluster", "c", "s5").replace("SELECT k::INTEGER AS cluster, (pos", "SELECT cluster, (pos"))
def _(spark, sf):
    start = cluster.plus_plus_start(points(spark, sf), "vec_id", "x", 6, SEED)
    return long_vector(cluster.KMeansModel(start).centre_table(spark), "centre", "cluster")


@query("m4_assign_points", sql_lloyd(ROUNDS) + ", " + sql_assign(9, f"c{ROUNDS}") + f" SELECT vec_id, k::INTEGER AS cluster, {sql_rnd('d')} AS dist FROM a9")
def _(spark, sf):
    df, model = lloyd(spark, sf)
    return cluster.assign(df, "x", model.centres).select("vec_id", "cluster", rnd("dist").alias("dist"))


@query("m5_centre_norms", sql_lloyd(ROUNDS) + f" SELECT k::INTEGER AS cluster, {sql_rnd('list_dot_product(c, c)')} AS squares FROM c{ROUNDS}")
def _(spark, sf):
    table = lloyd(spark, sf)[1].centre_table(spark)
    return table.select("cluster", rnd(V.dot(F.col("centre"), F.col("centre"))).alias("squares"))


SQL_TOP = (
    sql_lloyd(ROUNDS) + f" SELECT k::INTEGER AS cluster, vec_id, rank::INTEGER AS rank, {sql_rnd('d')} AS dist FROM (SELECT k, vec_id, d, row_number() OVER "
    f"(PARTITION BY k ORDER BY d, vec_id) AS rank FROM (SELECT vec_id, k, pow(list_distance(x, c), 2) AS d FROM p, c{ROUNDS})) WHERE rank <= 4"
)


@query("m6_representatives", SQL_TOP)
def _(spark, sf):
    df, model = lloyd(spark, sf)
    return cluster.representatives(df, "vec_id", "x", model.centres, 4).withColumn("dist", rnd("dist"))


SQL_HISTORY = " UNION ALL ".join(
    f"SELECT {2 * i - 2}::INTEGER AS step, {sql_rnd('sum(d)')} AS objective FROM a{i} UNION ALL "
    f"SELECT {2 * i - 1}::INTEGER, {sql_rnd(f'sum(pow(list_distance(a{i}.x, c{i}.c), 2))')} FROM a{i} JOIN c{i} USING (k)"
    for i in range(1, ROUNDS + 1)
)


@query("m7_objective_history", sql_lloyd(ROUNDS) + " " + SQL_HISTORY)
def _(spark, sf):
    return lloyd(spark, sf)[1].history_table(spark).withColumn("objective", rnd("objective"))


@query("a14_objective", sql_lloyd(1) + ", " + sql_assign(9, "c1") + f" SELECT {sql_rnd('sum(d)')} AS objective FROM a9")
def _(spark, sf):
    df = points(spark, sf)
    model = cluster.kmeans_fit(df, "vec_id", "x", 10, start=label_start(df), rounds=1)
    return cluster.objective(df, "x", model.centres).select(rnd("objective").alias("objective"))


SQL_PAIRS = f"WITH {SQL_START}, j AS (SELECT vec_id, k, pow(list_distance(x, c), 2) AS d FROM p, c0)"


@query("j2_point_centre_distances", SQL_PAIRS + f" SELECT vec_id, k::INTEGER AS cluster, {sql_rnd('d')} AS dist FROM j")
def _(spark, sf):
    df = points(spark, sf)
    every = df.select("vec_id", F.posexplode_outer(cluster.distances(F.col("x"), label_start(df))).alias("cluster", "d"))
    return every.select("vec_id", "cluster", rnd("d").alias("dist"))


@query("j5_gather_own_centre", f"WITH {SQL_START} SELECT vec_id, {sql_rnd('pow(list_distance(x, c), 2)')} AS dist FROM p JOIN c0 ON k = label")
def _(spark, sf):
    df = points(spark, sf)
    centres = cluster.KMeansModel(label_start(df)).centre_table(spark).withColumnRenamed("cluster", "label")
    joined = df.join(F.broadcast(centres), "label")
    return joined.select("vec_id", rnd(V.squared_distance(F.col("x"), F.col("centre"))).alias("dist"))


@query("w1_row_argmin", SQL_PAIRS + " SELECT vec_id, arg_min(k, (d, k))::INTEGER AS cluster FROM j GROUP BY vec_id")
def _(spark, sf):
    df = points(spark, sf)
    return df.select("vec_id", V.first_argmin(cluster.distances(F.col("x"), label_start(df))).alias("cluster"))


@query("w3_row_min", SQL_PAIRS + f" SELECT vec_id, {sql_rnd('min(d)')} AS dist FROM j GROUP BY vec_id")
def _(spark, sf):
    df = points(spark, sf)
    return df.select("vec_id", rnd(cluster.nearest(F.col("x"), label_start(df))["dist"]).alias("dist"))


@query("w4_smallest_per_cluster", SQL_TOP.replace("rank <= 4", "rank <= 9"))
def _(spark, sf):
    df, model = lloyd(spark, sf)
    return cluster.representatives(df, "vec_id", "x", model.centres, 9).withColumn("dist", rnd("dist"))


# ---- Gaussian generative classifier on the plane

SQL_GAUSS = (
    "g AS (SELECT label, count(*) AS n, ln(count(*) / (SELECT count(*) FROM p)) AS prior, avg(x1) AS m1, avg(x2) AS m2, "
    "var_samp(x1) AS a, covar_samp(x1, x2) AS b, var_samp(x2) AS d FROM p GROUP BY label)"
)
SQL_SHARED = (
    "h AS (SELECT label, prior, m1, m2, sum(n * a) OVER () / sum(n) OVER () AS a, sum(n * b) OVER () / sum(n) OVER () AS b, "
    "sum(n * d) OVER () / sum(n) OVER () AS d FROM g)"
)


def sql_score(x1: str, x2: str) -> str:
    quad = f"(d * pow({x1} - m1, 2) - 2 * b * ({x1} - m1) * ({x2} - m2) + a * pow({x2} - m2, 2)) / (a * d - b * b)"
    return f"(prior - ln(2 * pi()) - 0.5 * ln(a * d - b * b) - 0.5 * {quad})"


@query(
    "m8_gaussian_fit",
    f"WITH p AS ({SQL_PLANE}), {SQL_GAUSS} SELECT label, n::BIGINT AS n, {sql_rnd('prior')} AS prior, {sql_rnd('m1')} AS m1, {sql_rnd('m2')} AS m2, "
    f"{sql_rnd('a')} AS a, {sql_rnd('b')} AS b, {sql_rnd('d')} AS d FROM g",
)
def _(spark, sf):
    t = generative.gaussian_fit(plane(spark, sf), "x", "label").table(spark)
    mean, cov = F.col("mean"), F.col("cov")
    cells = {"prior": F.col("log_prior"), "m1": mean[0], "m2": mean[1], "a": cov[0][0], "b": cov[0][1], "d": cov[1][1]}
    return t.select("label", "n", *[rnd(c).alias(k) for k, c in cells.items()])


def sql_gaussian_predict(model: str) -> str:
    ctes = f"WITH p AS ({SQL_PLANE}), {SQL_GAUSS}, {SQL_SHARED} "
    return ctes + (
        f"SELECT vec_id, arg_max(m.label, (s, -m.label))::INTEGER AS prediction, {sql_rnd('max(s)')} AS score FROM "
        f"(SELECT vec_id, {model}.label, {sql_score('p.x1', 'p.x2')} AS s FROM p, {model}) m GROUP BY vec_id"
    )


def gaussian_prediction(spark, sf, shared: bool):
    df = plane(spark, sf)
    model = generative.gaussian_fit(df, "x", "label", shared)
    scored = df.withColumn("s", generative.gaussian_scores(F.col("x"), model))
    return scored.select("vec_id", V.first_argmax(F.col("s")).alias("prediction"), rnd(F.array_max("s")).alias("score"))


@query("m9_gaussian_predict", sql_gaussian_predict("g"))
def _(spark, sf):
    return gaussian_prediction(spark, sf, shared=False)


@query("m9_gaussian_predict_shared", sql_gaussian_predict("h"))
def _(spark, sf):
    return gaussian_prediction(spark, sf, shared=True)


@query(
    "m9_gaussian_predict_with_nulls",
    f"SELECT vec_id, CASE WHEN NOT {SQL_HOLE} THEN prediction END AS prediction FROM ({sql_gaussian_predict('g')})",
)
def _(spark, sf):
    df = plane(spark, sf)
    model = generative.gaussian_fit(df, "x", "label")
    return generative.gaussian_predict(with_holes(df), "x", model).select("vec_id", "prediction")


SQL_FLAGS = (
    "WITH p AS (SELECT (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INTEGER AS label, l_quantity AS x1, "
    "l_extendedprice / 1000 AS x2 FROM lineitem), "
)


def flags(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    x = F.array("l_quantity", F.col("l_extendedprice") / 1000)
    return read(spark, sf, "lineitem").select(kind.alias("label"), x.alias("x"))


@query(
    "m9_gaussian_on_lineitem",
    SQL_FLAGS + SQL_GAUSS + ", w AS (SELECT DISTINCT x1, x2 FROM p), s AS (SELECT w.x1, w.x2, arg_max(g.label, ("
    + sql_score("w.x1", "w.x2") + ", -g.label))::INTEGER AS prediction FROM w, g GROUP BY w.x1, w.x2) "
    "SELECT label, prediction, count(*)::BIGINT AS n FROM p JOIN s USING (x1, x2) GROUP BY 1, 2",
)
def _(spark, sf):
    df = flags(spark, sf)
    model = generative.gaussian_fit(df, "x", "label")
    out = generative.gaussian_predict(df, "x", model)
    return out.groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query(
    "j7_score_plus_prior",
    f"WITH p AS ({SQL_PLANE}), {SQL_GAUSS} SELECT vec_id, {sql_rnd('x1 + prior')} AS score FROM p JOIN g USING (label)",
)
def _(spark, sf):
    df = plane(spark, sf)
    priors = groups.log_priors(df, "label")
    return df.join(F.broadcast(priors), "label").select("vec_id", rnd(F.col("x")[0] + F.col("log_prior")).alias("score"))


@query(
    "w2_row_argmax",
    f"SELECT vec_id, (list_position(x, list_max(x)) - 1)::INTEGER AS best FROM ({SQL_POINTS})",
)
def _(spark, sf):
    return points(spark, sf).select("vec_id", V.first_argmax(F.col("x")).alias("best"))


@query(
    "m27_gaussian_regions",
    f"WITH p AS ({SQL_PLANE}), {SQL_GAUSS}, " + GRID_SQL.format(pad=3, step=0.05).replace("g AS (SELECT i", "q AS (SELECT i")
    + f" SELECT grid_id::BIGINT AS grid_id, arg_max(label, (s, -label))::INTEGER AS prediction FROM "
    f"(SELECT grid_id, g.label, {sql_score('gx', 'gy')} AS s FROM q, g) GROUP BY grid_id",
)
def _(spark, sf):
    df = plane(spark, sf)
    model = generative.gaussian_fit(df, "x", "label")
    out = regions.decision_regions(df, "x", lambda pts, x: generative.gaussian_predict(pts, x, model), pad=3)
    return out.select("grid_id", "prediction")


# ---- softmax regression on the plane

ETA, LAM, STEPS = 0.01, 0.1, 4


def sql_softmax(steps: int, eta: float = ETA) -> str:
    """Full-batch steps from zero; the weight list of a class has the bias last."""
    out = [f"p AS MATERIALIZED (SELECT vec_id, label, [x1, x2, 1.0::DOUBLE] AS x FROM ({SQL_PLANE}))",
           "w0 AS (SELECT c, [0.0, 0.0, 0.0]::DOUBLE[] AS w FROM range(3) t(c))"]
    for i in range(steps + 1):
        out.append(
            f"z{i} AS MATERIALIZED (SELECT vec_id, label, x, c, w, list_dot_product(w, x) AS z FROM p, w{i}), "
            f"l{i} AS MATERIALIZED (SELECT *, z - m - ln(sum(exp(z - m)) OVER (PARTITION BY vec_id)) AS lp FROM "
            f"(SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z{i}))"
        )
        out.append(
            f"g{i} AS MATERIALIZED (SELECT c, any_value(w) AS w, [sum(e * x[1]) + {2 * LAM} * any_value(w[1]), sum(e * x[2]) + {2 * LAM} * any_value(w[2]), "
            f"sum(e * x[3]) + {2 * LAM} * any_value(w[3])] AS g FROM (SELECT *, exp(lp) - (label = c)::INTEGER AS e FROM l{i}) GROUP BY c)"
        )
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT c, list_transform(range(1, 4), lambda j: w[j] - {eta} * g[j]) AS w FROM g{i})")
    return "WITH " + ", ".join(out)


def descend(spark, sf):
    df = plane(spark, sf)
    return df, sm.softmax_fit(df, "x", "label", lam=LAM, eta=ETA, solver="gd", max_steps=STEPS)


@query("m10_softmax_descent", sql_softmax(STEPS) + " " + sql_long("c::INTEGER AS label", "w", f"w{STEPS}").replace("SELECT c::INTEGER AS label, (pos", "SELECT label, (pos").replace("AS pos,", "AS feature,").replace("AS value FROM (SELECT c", "AS weight FROM (SELECT c"))
def _(spark, sf):
    return descend(spark, sf)[1].table(spark).withColumn("weight", rnd("weight"))


@query("m10_softmax_newton")
def _(spark, sf):
    return sm.softmax_fit(plane(spark, sf), "x", "label", lam=LAM).table(spark)


@query(
    "m10_softmax_newton_gradient",
    "SELECT c::INTEGER AS label, j::INTEGER AS feature, 0.0::DOUBLE AS gradient FROM range(3) t(c), range(3) u(j)",
)
def _(spark, sf):
    """At the fitted weights the penalised gradient, taken again with column expressions, is zero."""
    df = flags(spark, sf)
    w = sm.softmax_fit(df, "x", "label", lam=LAM).weights
    p = df.withColumn("p", V.softmax(sm.class_scores(F.col("x"), w))).withColumn("b", V.append_bias(F.col("x")))
    n = df.count()
    cells = [
        (F.sum((F.col("p")[c] - F.when(F.col("label") == c, 1.0).otherwise(0.0)) * F.col("b")[j]) + 2 * LAM * float(w[c, j])) / n
        for c in range(3) for j in range(3)
    ]
    rows = F.array(*[F.struct(F.lit(i // 3).alias("label"), F.lit(i % 3).alias("feature"), F.col(f"g{i}").alias("g")) for i in range(9)])
    totals = p.agg(*[cell.alias(f"g{i}") for i, cell in enumerate(cells)])
    return totals.select(F.inline(rows)).select("label", "feature", rnd("g").alias("gradient"))


@query("m10_softmax_newton_on_lineitem")
def _(spark, sf):
    return sm.softmax_fit(flags(spark, sf), "x", "label", lam=LAM).history_table(spark)


@query("m11_softmax_predict", sql_softmax(STEPS) + f" SELECT vec_id, arg_max(c, (z, -c))::INTEGER AS prediction FROM z{STEPS} GROUP BY vec_id")
def _(spark, sf):
    df, model = descend(spark, sf)
    return sm.softmax_predict(df, "x", model).select("vec_id", "prediction")


@query(
    "m11_softmax_predict_with_nulls",
    f"SELECT vec_id, CASE WHEN NOT {SQL_HOLE} THEN prediction END AS prediction FROM ("
    + sql_softmax(STEPS) + f" SELECT vec_id, arg_max(c, (z, -c))::INTEGER AS prediction FROM z{STEPS} GROUP BY vec_id)",
)
def _(spark, sf):
    df, model = descend(spark, sf)
    return sm.softmax_predict(with_holes(df), "x", model).select("vec_id", "prediction")


SQL_LOSS = " UNION ALL ".join(
    f"SELECT {i + 1}::INTEGER AS step, {sql_rnd(f'(SELECT -sum(lp) FROM l{i} WHERE c = label) + {LAM} * (SELECT sum(list_dot_product(w, w)) FROM g{i})')} AS loss, "
    f"{sql_rnd(f'(SELECT sqrt(sum(list_dot_product(g, g))) FROM g{i})')} AS gradient_norm"
    for i in range(STEPS)
)


@query("m12_softmax_loss_and_gradient", sql_softmax(STEPS) + " " + SQL_LOSS)
def _(spark, sf):
    history = descend(spark, sf)[1].history_table(spark)
    return history.select("step", rnd("loss").alias("loss"), rnd("gradient_norm").alias("gradient_norm"))


@query(
    "a24_scores",
    sql_softmax(STEPS) + f", b AS (SELECT vec_id, any_value(label) AS label, arg_max(c, (z, -c)) AS hat, sum(lp) FILTER (WHERE c = label) AS lp, "
    f"sum(pow(exp(lp) - (c = label)::INTEGER, 2)) AS sq FROM l{STEPS} GROUP BY vec_id) SELECT {sql_rnd('avg(-lp)')} AS cross_entropy, "
    f"{sql_rnd('avg(sq) / 3')} AS squared_error, {sql_rnd('avg((hat = label)::INTEGER)')} AS accuracy FROM b",
)
def _(spark, sf):
    df, model = descend(spark, sf)
    scored = df.withColumn("lp", V.log_softmax(sm.class_scores(F.col("x"), model.weights)))
    truth = V.one_hot(F.col("label"), 3)
    right = V.first_argmax(F.col("lp")) == F.col("label")
    return scored.agg(
        rnd(F.avg(-F.get("lp", F.col("label")))).alias("cross_entropy"),
        rnd(F.avg(V.squared_distance(F.transform("lp", F.exp), truth)) / 3).alias("squared_error"),
        rnd(F.avg(F.when(right, 1.0).otherwise(0.0))).alias("accuracy"),
    )


@query(
    "m27_softmax_regions_after_descent",
    sql_softmax(STEPS) + ", q AS (SELECT x[1] AS x1, x[2] AS x2 FROM p), "
    + GRID_SQL.format(pad=2, step=0.05).replace("FROM p)", "FROM q)").replace("g AS (SELECT i", "cells AS (SELECT i")
    + f" SELECT grid_id::BIGINT AS grid_id, arg_max(c, (s, -c))::INTEGER AS prediction FROM (SELECT grid_id, c, "
    f"w[1] * gx + w[2] * gy + w[3] AS s FROM cells, w{STEPS}) GROUP BY grid_id",
)
def _(spark, sf):
    df, model = descend(spark, sf)
    out = regions.decision_regions(df, "x", lambda pts, x: sm.softmax_predict(pts, x, model), pad=2)
    return out.select("grid_id", "prediction")


@query("m27_softmax_regions")
def _(spark, sf):
    df = plane(spark, sf)
    model = sm.softmax_fit(df, "x", "label", lam=LAM)
    out = regions.decision_regions(df, "x", lambda pts, x: sm.softmax_predict(pts, x, model), pad=2)
    return out.groupBy("prediction").agg(F.count("*").alias("n"))


# ---- regression on a basis

SQL_LINE = "SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part"


def line(x):
    return V.prepend_bias(V.assemble(x))


@query("m13_least_squares_line", f"SELECT {sql_rnd('a', 5)} AS intercept, {sql_rnd('b', 5)} AS slope FROM ({SQL_LINE})")
def _(spark, sf):
    w = basis.basis_fit(read(spark, sf, "part"), line("p_size"), "p_retailprice")
    return small_table(spark, [tuple(map(float, w))], "intercept double, slope double").select(
        rnd("intercept", 5).alias("intercept"), rnd("slope", 5).alias("slope")
    )


@query("m13_sine_basis_fit")
def _(spark, sf):
    w = basis.basis_fit(read(spark, sf, "lineitem"), V.sine_basis(F.col("l_quantity"), 7), "l_extendedprice", 8)
    return small_table(spark, [(j, float(v)) for j, v in enumerate(w)], "term int, weight double")


@query("m13_sine_basis_residual", "SELECT i::INTEGER AS term, 0.0::DOUBLE AS share FROM range(8) t(i)")
def _(spark, sf):
    """The residual of the fitted curve is orthogonal to every basis column."""
    rows = read(spark, sf, "lineitem", "l_quantity", "l_extendedprice")
    curve = V.sine_basis(F.col("l_quantity"), 7)
    w = basis.basis_fit(rows, curve, "l_extendedprice", 8)
    fitted = basis.basis_predict(rows.withColumn("b", curve), F.col("b"), w)
    gap = F.col("l_extendedprice") - F.col("prediction")
    sums = fitted.agg(*[(F.sum(F.col("b")[j] * gap) / F.sum("l_extendedprice")).alias(f"s{j}") for j in range(8)])
    rows = F.array(*[F.struct(F.lit(j).alias("term"), F.col(f"s{j}").alias("s")) for j in range(8)])
    return sums.select(F.inline(rows)).select("term", rnd("s").alias("share"))


@query(
    "m14_curve_on_grid",
    f"SELECT i AS id, {sql_rnd('x')} AS x, {sql_rnd('a + b * x', 4)} AS prediction FROM ({SQL_LINE}), (SELECT i, lo + i * (hi - lo) / 199.0 AS x FROM "
    "(SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part), range(200) t(i))",
)
def _(spark, sf):
    part = read(spark, sf, "part")
    w = basis.basis_fit(part, line("p_size"), "p_retailprice")
    lo, hi = part.agg(F.min("p_size"), F.max("p_size")).first()
    curve = basis.basis_predict(readers.linspace(spark, lo, hi, 200), line("x"), w)
    return curve.select("id", rnd("x").alias("x"), rnd("prediction", 4).alias("prediction"))


SINES = ["1.0::DOUBLE", *[f"sin(l_quantity / {j}.0)" for j in range(1, 8)]]


@query(
    "a15_normal_sums",
    f"WITH b AS (SELECT [{', '.join(SINES)}, l_extendedprice] AS v FROM lineitem) SELECT (a - 1)::INTEGER AS i, (c - 1)::INTEGER AS j, "
    f"{sql_rnd('sum(v[a] * v[c])', 2)} AS value FROM b, range(1, 9) t(a), range(1, 10) u(c) GROUP BY a, c",
)
def _(spark, sf):
    rows = read(spark, sf, "lineitem").select(V.sine_basis(F.col("l_quantity"), 7).alias("b"), "l_extendedprice")
    xtx, xty = groups.normal_sums(rows, "b", "l_extendedprice", 8)
    cells = [(i, j, float(v)) for i, row in enumerate(np.column_stack([xtx, xty])) for j, v in enumerate(row)]
    return small_table(spark, cells, "i int, j int, value double").withColumn("value", rnd("value", 2))


# ---- perceptrons

DRAWS, ROUND, PSEED = 60, 16, 21


def signed_points(spark, sf):
    return points(spark, sf).select("vec_id", "x", F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"))


SQL_SIGNED = "(SELECT vec_id, embedding::DOUBLE[] AS x, (CASE WHEN label < 5 THEN 1 ELSE -1 END) AS y FROM embeddings)"
# One state per round or removal: the support after it. Removals come first, then the next round's mistakes join.
SQL_WORST = (
    "list_sort(list_transform(s, lambda i: {'v': -i.a * (coalesce(list_sum(list_transform(s, lambda j: j.a * list_dot_product(j.x, i.x))), 0) "
    "- i.a * list_dot_product(i.x, i.x)), 'id': i.id}))[1].id"
)


def sql_perceptron(budget: int) -> str:
    return (
        f"WITH RECURSIVE d AS MATERIALIZED (SELECT t // {ROUND} AS r, list(DISTINCT {{'id': vec_id, 'a': y, 'x': x}}) AS l "
        f"FROM {sql_draws(SQL_SIGNED, 'vec_id', ', x, y', DRAWS, str(PSEED))} GROUP BY r), "
        "st AS (SELECT -1 AS r, 0 AS step, []::STRUCT(id BIGINT, a INTEGER, x DOUBLE[])[] AS s UNION ALL "
        f"SELECT CASE WHEN len(s) > {budget} THEN st.r ELSE st.r + 1 END, step + 1, CASE WHEN len(s) > {budget} "
        f"THEN list_filter(s, lambda e: e.id <> {SQL_WORST}) ELSE list_concat(s, list_filter(d.l, lambda n: "
        "n.a * coalesce(list_sum(list_transform(s, lambda e: e.a * list_dot_product(e.x, n.x))), 0) <= 0 "
        "AND NOT list_contains(list_transform(s, lambda e: e.id), n.id))) END "
        f"FROM st LEFT JOIN d ON d.r = st.r + 1 WHERE len(s) > {budget} OR d.r IS NOT NULL), "
        "last AS (SELECT arg_max(s, step) AS s FROM st)"
    )


SQL_ROUNDS = sql_perceptron(10**9)
SQL_DECISION = "coalesce(list_sum(list_transform(s, lambda e: e.a * list_dot_product(e.x, x))), 0)"


SQL_PERCEPTRON = (
    f"WITH RECURSIVE d AS MATERIALIZED (SELECT * FROM {sql_draws(SQL_SIGNED, 'vec_id', ', x, y', DRAWS, str(PSEED))}), "
    "st AS (SELECT 0 AS t, list_transform(range(64), lambda i: 0.0::DOUBLE) AS w, []::BIGINT[] AS s UNION ALL SELECT st.t + 1, "
    "CASE WHEN hit THEN list_transform(range(1, 65), lambda i: w[i] + y * x[i]) ELSE w END, CASE WHEN hit THEN list_append(s, vec_id) ELSE s END "
    "FROM (SELECT st.t, w, s, x, y, vec_id, y * list_dot_product(w, x) <= 0 AND NOT list_contains(s, vec_id) AS hit FROM st JOIN d ON d.t = st.t) st), "
    f"last AS (SELECT w, s FROM st WHERE t = {DRAWS})"
)


def support(spark, sf, **kw):
    return perceptron.perceptron_fit(signed_points(spark, sf), "vec_id", "x", "y", DRAWS, PSEED, block=ROUND, **kw)


@query("m15_kernel_perceptron", SQL_PERCEPTRON + " SELECT unnest(s) AS id FROM last")
def _(spark, sf):
    return support(spark, sf, in_order=True).table(spark).select("id")


@query("m17_kernel_predict", SQL_PERCEPTRON + f" SELECT vec_id, (list_dot_product(w, x) > 0)::INTEGER AS prediction FROM {SQL_SIGNED}, last")
def _(spark, sf):
    df = signed_points(spark, sf)
    return perceptron.perceptron_predict(df, "x", support(spark, sf, in_order=True)).select("vec_id", "prediction")


@query("j3_kernel_sums", SQL_ROUNDS + f" SELECT vec_id, {sql_rnd(SQL_DECISION)} AS collapsed, {sql_rnd(SQL_DECISION)} AS pairwise FROM {SQL_SIGNED}, last")
def _(spark, sf):
    model = support(spark, sf)
    one, all_pairs = (perceptron.decision(F.col("x"), model, collapse=c) for c in (True, False))
    return signed_points(spark, sf).select("vec_id", rnd(one).alias("collapsed"), rnd(all_pairs).alias("pairwise"))


BUDGET = 5
SQL_BUDGET = (
    f"WITH RECURSIVE d AS MATERIALIZED (SELECT * FROM {sql_draws(SQL_SIGNED, 'vec_id', ', x, y', DRAWS, str(PSEED))}), "
    "st AS (SELECT 0 AS t, []::STRUCT(id BIGINT, a INTEGER, x DOUBLE[])[] AS s UNION ALL SELECT t + 1, "
    f"CASE WHEN len(s2) <= {BUDGET} THEN s2 ELSE list_filter(s2, lambda e: e.id <> list_sort(list_transform(s2, lambda i: "
    "{'v': -i.a * (coalesce(list_sum(list_transform(s2, lambda j: j.a * list_dot_product(j.x, i.x))), 0) - i.a * list_dot_product(i.x, i.x)), 'id': i.id}))[1].id) END "
    "FROM (SELECT st.t, CASE WHEN y * coalesce(list_sum(list_transform(s, lambda e: e.a * list_dot_product(e.x, x))), 0) <= 0 "
    "AND NOT list_contains(list_transform(s, lambda e: e.id), vec_id) THEN list_append(s, {'id': vec_id, 'a': y, 'x': x}) ELSE s END AS s2 "
    f"FROM st JOIN d ON d.t = st.t)), last AS (SELECT s FROM st WHERE t = {DRAWS})"
)


@query("m16_budget_perceptron", SQL_BUDGET + " SELECT unnest(list_transform(s, lambda e: e.id)) AS id, unnest(list_transform(s, lambda e: e.a))::INTEGER AS a FROM last")
def _(spark, sf):
    return support(spark, sf, budget=BUDGET, in_order=True).table(spark).select("id", "a")


@query(
    "m18_worst_support",
    SQL_BUDGET + ", e AS (SELECT unnest(s) AS e FROM last), v AS (SELECT i.e.id AS id, sum(i.e.a * j.e.a * list_dot_product(i.e.x, j.e.x)) "
    "- any_value(list_dot_product(i.e.x, i.e.x)) AS score FROM e i, e j GROUP BY 1) "
    f"SELECT id, {sql_rnd('score')} AS score, id = (SELECT arg_max(id, (score, -id)) FROM v) AS worst FROM v",
)
def _(spark, sf):
    out = perceptron.worst_supports(support(spark, sf, budget=BUDGET, in_order=True), spark)
    return out.select("id", rnd("score").alias("score"), "worst")
