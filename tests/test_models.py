"""Models against invariants and small NumPy recomputations."""

import numpy as np
import pytest
from conftest import matrix
from pyspark.sql import functions as F

from checks import base
from tablemodels.functions import vectors as V
from tablemodels.operators import basis, cluster, fusion, generative, groups, mlp, order, perceptron, regions
from tablemodels.operators import softmax as sm
from tablemodels.operators.blocks import gram
from tablemodels.sources import writers


@pytest.fixture(scope="module")
def plane(spark, sf):
    return base.plane(spark, sf).persist()


def labels_of(df):
    return np.array([r[1] for r in sorted(df.select("vec_id", "label").collect())])


# ---- k-means


def test_kmeans_rounds_equal_numpy(points):
    _, x = matrix(points)
    start = x[:6].copy()
    model = cluster.kmeans_fit(points, "vec_id", "x", 6, start=start, rounds=4)
    centres, history = start.copy(), []
    for _ in range(4):
        d = ((x[:, None] - centres[None]) ** 2).sum(-1)
        best = d.argmin(1)
        history.append(d.min(1).sum())
        centres = np.array([x[best == k].mean(0) if (best == k).any() else centres[k] for k in range(6)])
        history.append(((x - centres[best]) ** 2).sum())
    assert np.allclose(model.centres, centres, atol=1e-10)
    assert np.allclose(model.history, history, rtol=1e-10)


def test_kmeans_objective_never_rises_and_partitions_do_not_matter(points):
    runs = [cluster.kmeans_fit(points.repartition(p), "vec_id", "x", 8, "++", rounds=6, seed=2) for p in (1, 3, 7)]
    for run in runs:
        assert len(run.history) == 12
        assert all(b <= a + 1e-9 for a, b in zip(run.history, run.history[1:]))
        assert np.allclose(run.centres, runs[0].centres, atol=1e-9)


def test_empty_cluster_keeps_its_centre(points):
    _, x = matrix(points)
    far = np.full(64, 50.0)
    model = cluster.kmeans_fit(points, "vec_id", "x", 2, start=np.array([x[0], far]), rounds=2)
    assert np.array_equal(model.centres[1], far)


def test_equidistant_centres_go_to_the_lowest(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id int, x array<double>")
    centres = np.array([[0.0, 2.0], [2.0, 0.0], [-2.0, 0.0]])
    assert cluster.assign(df, "x", centres).first()["cluster"] == 0


def test_tolerance_stops_early(points):
    model = cluster.kmeans_fit(points, "vec_id", "x", 4, "++", rounds=50, tol=1e-9, seed=1)
    assert len(model.history) < 100


def test_plus_plus_on_identical_points(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "vec_id int, x array<double>")
    assert np.array_equal(cluster.plus_plus_start(df, "vec_id", "x", 3, 0), np.ones((3, 2)))


def test_plus_plus_prefers_far_points(spark):
    rows = [(i, [0.001 * i]) for i in range(50)] + [(99, [10.0])]
    df = spark.createDataFrame(rows, "vec_id int, x array<double>")
    for seed in range(3):
        for weight in ("d4", "d2"):
            assert [10.0] in cluster.plus_plus_start(df, "vec_id", "x", 2, seed, weight).tolist()


def test_representatives_equal_brute_force(points):
    ids, x = matrix(points)
    centres = x[[3, 50]] + 0.01
    got = cluster.representatives(points.repartition(5), "vec_id", "x", centres, 7).collect()
    for c in range(2):
        d = ((x - centres[c]) ** 2).sum(1)
        want = ids[np.lexsort((ids, d))[:7]].tolist()
        assert [r["vec_id"] for r in sorted((r for r in got if r["cluster"] == c), key=lambda r: r["rank"])] == want


# ---- groups and the Gaussian classifier


def test_narrow_and_wide_covariances_agree(points, monkeypatch):
    few = points.select("label", F.slice("x", 1, 5).alias("x"))
    narrow = {r["label"]: r for r in groups.group_covariances(few, "label", "x").collect()}
    monkeypatch.setattr(groups, "NARROW", 0)
    wide = {r["label"]: r for r in groups.group_covariances(few, "label", "x").collect()}
    assert set(narrow) == set(wide)
    for k in narrow:
        assert narrow[k]["n"] == wide[k]["n"]
        assert np.allclose(narrow[k]["cov"], wide[k]["cov"]) and np.allclose(narrow[k]["mean"], wide[k]["mean"])


def test_one_row_class_has_no_covariance(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [2.0, 0.0])], "label int, x array<double>")
    with pytest.raises(Exception, match="covariance needs two rows"):
        generative.gaussian_fit(df, "x", "label")


@pytest.mark.parametrize("shared", [False, True])
def test_gaussian_scores_equal_numpy(plane, shared):
    _, x = matrix(plane)
    y = labels_of(plane)
    model = generative.gaussian_fit(plane, "x", "label", shared)
    cov = np.array([np.cov(x[y == c].T) for c in range(3)])
    if shared:
        cov = np.repeat((cov * np.bincount(y)[:, None, None]).sum(0)[None] / len(y), 3, axis=0)
    scores = np.empty((len(x), 3))
    for c in range(3):
        diff = x - x[y == c].mean(0)
        quad = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov[c]), diff)
        scores[:, c] = -0.5 * (quad + np.log(np.linalg.det(2 * np.pi * cov[c]))) + np.log((y == c).mean())
    _, got = matrix(plane.withColumn("s", generative.gaussian_scores(F.col("x"), model)), "s")
    assert np.allclose(got, scores)


def test_gaussian_expression_and_batches_agree(plane, monkeypatch):
    model = generative.gaussian_fit(plane, "x", "label")
    _, a = matrix(plane.withColumn("s", generative.gaussian_scores(F.col("x"), model)), "s")
    monkeypatch.setattr(generative, "EXPRESSION_TERMS", 0)
    _, b = matrix(plane.withColumn("s", generative.gaussian_scores(F.col("x"), model)), "s")
    assert np.allclose(a, b)


def test_far_points_keep_a_finite_score(plane, spark):
    model = generative.gaussian_fit(plane, "x", "label")
    far = spark.createDataFrame([([1e6, -1e6],)], "x array<double>")
    assert np.isfinite(far.select(generative.gaussian_scores(F.col("x"), model)).first()[0]).all()


# ---- softmax


def test_newton_ends_at_the_minimum(plane):
    model = sm.softmax_fit(plane, "x", "label", lam=0.1)
    assert model.history[-1][2] < 1e-6 and len(model.history) < 15
    _, x = matrix(plane)
    y, x = labels_of(plane), np.hstack([x, np.ones((len(x), 1))])
    z = np.exp(x @ model.weights.T)
    p = z / z.sum(1, keepdims=True)
    assert np.abs((p - np.eye(3)[y]).T @ x + 0.2 * model.weights).max() < 1e-6


def test_descent_approaches_newton(plane):
    best = sm.softmax_fit(plane, "x", "label", lam=5.0).weights
    near = sm.softmax_fit(plane, "x", "label", lam=5.0, eta=0.01, solver="gd", max_steps=40)
    # the penalty alone contracts the distance by 1 - 2·lam·eta a step
    assert np.linalg.norm(near.weights - best) <= 0.9**40 * np.linalg.norm(best)
    assert len(near.history) == 40
    stopped = sm.softmax_fit(plane, "x", "label", lam=5.0, eta=0.01, solver="gd", check_every=5, tol=5.0)
    assert len(stopped.history) % 5 == 0 and stopped.history[-1][2] < 5.0


def test_softmax_without_bias_agrees_with_the_built_in(plane):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    # a huge penalty-free comparison is impossible (the bias is penalised here), so compare on centred two-class data
    df = plane.filter("label < 2").withColumn("y", F.col("label").cast("double"))
    mirrored = df.unionByName(df.withColumn("x", V.scale(F.col("x"), -1.0)).withColumn("label", 1 - F.col("label")))
    ours = sm.softmax_fit(mirrored, "x", "label", lam=0.3)
    n = mirrored.count()
    rows = mirrored.select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    theirs = LogisticRegression(
        family="multinomial", fitIntercept=False, standardization=False, regParam=2 * 0.3 / n, tol=1e-12, maxIter=200
    ).fit(rows)
    assert np.allclose(ours.weights[:, 2], 0, atol=1e-6)
    assert np.allclose(ours.weights[:, :2], theirs.coefficientMatrix.toArray(), atol=1e-5)


@pytest.mark.parametrize("hessian", [False, True])
def test_gradient_expression_and_blocks_agree(plane, hessian, monkeypatch):
    w = np.arange(9.0).reshape(3, 3) / 7 - 0.5
    a = sm.loss_and_gradient(plane, "x", "label", w, 0.2, hessian)
    monkeypatch.setattr(sm, "MAX_EXPRESSION_SUMS", 0)
    b = sm.loss_and_gradient(plane, "x", "label", w, 0.2, hessian)
    assert len(a) == len(b) == 2 + hessian and all(np.allclose(p, q) for p, q in zip(a, b))


def test_score_expression_and_batches_agree(plane, monkeypatch):
    w = np.arange(9.0).reshape(3, 3)
    _, a = matrix(plane.withColumn("s", sm.class_scores(F.col("x"), w)), "s")
    monkeypatch.setattr(sm, "EXPRESSION_TERMS", 0)
    _, b = matrix(plane.withColumn("s", sm.class_scores(F.col("x"), w)), "s")
    assert np.allclose(a, b)


# ---- basis regression


@pytest.mark.parametrize("terms", [3, 7, 20])
def test_residual_is_orthogonal_to_the_basis(spark, sf, terms):
    rows = base.read(spark, sf, "lineitem", "l_quantity", "l_extendedprice")
    curve = V.sine_basis(F.col("l_quantity"), terms)
    if terms == 20:  # nearly dependent columns: the equations still hold, to the precision left
        curve = V.concat_blocks(V.prepend_bias(V.assemble(*[F.sin(F.col("l_quantity") * j) for j in range(1, 13)])))
    w = basis.basis_fit(rows, curve, "l_extendedprice")
    pred = basis.basis_predict(rows.withColumn("b", curve), F.col("b"), w)
    gap = F.col("l_extendedprice") - F.col("prediction")
    r = pred.agg(*[F.sum(F.col("b")[j] * gap) for j in range(len(w))], F.sum("l_extendedprice")).first()
    assert np.abs(np.array(r[:-1])).max() < 1e-7 * r[-1]


def test_singular_basis_is_refused(spark, sf):
    rows = base.read(spark, sf, "part")
    with pytest.raises(np.linalg.LinAlgError):
        basis.basis_fit(rows, V.assemble("p_size", "p_size"), "p_retailprice")


def test_gram_of_a_hot_key_equals_numpy(points):
    hot = points.withColumn("k", F.when(F.col("vec_id") % 3 > 0, -1).otherwise(F.col("label"))).repartition(4)
    rows = hot.select("vec_id", "k", "x").collect()
    for r in gram(hot, "x", "k").collect():
        x = np.array([p["x"] for p in rows if p["k"] == r["k"]])
        assert r["n"] == len(x) and np.allclose(np.array(r["gram"]).reshape(64, 64), x.T @ x)


# ---- perceptrons


def in_rounds(ids, x, y, draws, block, budget=None, beta=0.0, kernel=lambda a, b: a @ b):
    """Mistakes of a round join together, then the support is cut back, recomputing every score."""
    support = {}
    for start in range(0, len(draws), block):
        held = dict(support)
        for t in draws[start : start + block]:
            score = sum(a * kernel(x[i], x[t]) for i, a in held.items())
            if y[t] * score <= (beta if budget else 0.0):
                support[t] = y[t]
        while budget and len(support) > budget:
            def value(i):
                return support[i] * sum(a * kernel(x[j], x[i]) for j, a in support.items() if j != i)

            del support[max(sorted(support), key=value)]
    return {int(ids[t]): int(a) for t, a in support.items()}


def signed_points(points):
    return points.withColumn("y", F.when(F.col("label") < 5, 1).otherwise(-1))


@pytest.mark.parametrize("budget,beta", [(None, 0.0), (6, 0.0), (1, 0.05)])
def test_rounds_equal_plain_training(points, budget, beta):
    from tablemodels.operators.sampling import draw_with_replacement

    signed = signed_points(points)
    ids, x = matrix(signed)
    y = np.array([r[1] for r in sorted(signed.select("vec_id", "y").collect())])
    place = {v: i for i, v in enumerate(ids)}
    draws = [place[r[1]] for r in sorted(draw_with_replacement(points, "vec_id", 40, 8).collect())]
    for block in (1, 7, 64):  # one draw a round is the order of a single trainer
        model = perceptron.perceptron_fit(signed, "vec_id", "x", "y", 40, 8, budget, beta, block=block)
        assert dict(zip(model.ids, model.signs.tolist())) == in_rounds(ids, x, y, draws, block, budget, beta)
        assert budget is None or len(model.ids) <= budget
        assert [r for r, _ in model.updates] == list(range(-(-40 // block)))


@pytest.mark.parametrize("budget,beta", [(None, 0.0), (6, 0.0), (1, 0.05)])
def test_in_order_equals_one_draw_after_the_other(points, budget, beta):
    from tablemodels.operators.sampling import draw_with_replacement

    signed = signed_points(points)
    ids, x = matrix(signed)
    y = np.array([r[1] for r in sorted(signed.select("vec_id", "y").collect())])
    place = {v: i for i, v in enumerate(ids)}
    draws = [place[r[1]] for r in sorted(draw_with_replacement(points, "vec_id", 40, 8).collect())]
    want = in_rounds(ids, x, y, draws, 1, budget, beta)
    assert want != in_rounds(ids, x, y, draws, 64, budget, beta)
    for block in (7, 64):
        model = perceptron.perceptron_fit(signed, "vec_id", "x", "y", 40, 8, budget, beta, block=block, in_order=True)
        assert dict(zip(model.ids, model.signs.tolist())) == want


@pytest.mark.parametrize("name,budget", [("m15_kernel_perceptron", None), ("m16_budget_perceptron", 5)])
def test_queries_take_every_draw_against_the_support_before_it(spark, sf, points, name, budget):
    from tablemodels.operators.sampling import draw_with_replacement

    import __spark_entry__ as entry

    signed = signed_points(points)
    ids, x = matrix(signed)
    y = np.array([r[1] for r in sorted(signed.select("vec_id", "y").collect())])
    place = {v: i for i, v in enumerate(ids)}
    draws = [place[r[1]] for r in sorted(draw_with_replacement(points, "vec_id", 60, 21).collect())]
    found = {r["id"] for r in entry.queries()[name](spark, sf).collect()}
    assert found == set(in_rounds(ids, x, y, draws, 1, budget))


def test_rows_without_values_are_never_drawn(spark, points):
    signed = signed_points(points)
    holes = signed.select("vec_id", "x", "y").unionByName(spark.createDataFrame(
        [(None, [0.0] * 64, 1), (10**6, None, 1), (10**6 + 1, [0.0] * 64, None), (10**6 + 2, [None] + [0.0] * 63, -1)],
        "vec_id bigint, x array<double>, y int"))
    one, other = (perceptron.perceptron_fit(d, "vec_id", "x", "y", 60, 3, block=20, width=64) for d in (signed, holes))
    assert one.ids == other.ids


def test_other_kernels_train_and_predict(points):
    def quadratic(a, b):
        return (a @ b.T + 1.0) ** 2

    signed = signed_points(points)
    model = perceptron.perceptron_fit(signed, "vec_id", "x", "y", 60, 1, kernel=quadratic)
    out = perceptron.perceptron_predict(signed, "x", model, signed=True)
    assert {r[0] for r in out.select("prediction").distinct().collect()} <= {-1, 1}
    with pytest.raises(ValueError):
        perceptron.decision(F.col("x"), model, collapse=True)


# ---- networks


def rows_of(points):
    return points.withColumn("y", V.one_hot(F.col("label"), 10))


def batches_of(ids, seed, steps):
    """Batch of each id, recomputed without Spark."""
    from hashlib import md5

    bits = [int(md5(f"{seed}|batch|{i}".encode()).hexdigest()[:12], 16) for i in ids]
    return np.array([int((b + 0.5) / 2.0**48 * steps) for b in bits])


def two_branches(seed=1, hidden=(5, 4)):
    parts = [mlp.new_network([3, 4, 2], "cross_entropy", seed), mlp.new_network([2, 3], "mse", seed + 1)]
    return fusion.branched(parts, 3, hidden, seed + 2)


@pytest.mark.parametrize("net", [mlp.new_network([3, 5, 4, 3], "mse", 1), mlp.new_network([3, 5, 4, 3], "cross_entropy", 1), two_branches()])
@pytest.mark.parametrize("dropout", [0.0, 0.5])
def test_gradient_equals_finite_differences(net, dropout):
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(6, w)) for w in net.n_in]
    y = np.eye(3)[rng.integers(0, 3, 6)]
    net = net.with_params(net.params + rng.normal(size=net.params.size) / 10)  # no sum at the kink of a unit
    masks = mlp.drop_masks(rng.integers(0, 2**28, 6), net.dropped, dropout) if dropout else None
    _, _, grad = net.gradient_sums(x, y, masks)
    for k in range(0, net.params.size, 5):
        step = np.zeros_like(net.params)
        step[k] = 1e-6
        up, down = (net.with_params(net.params + s).gradient_sums(x, y, masks)[0] for s in (step, -step))
        assert grad[k] == pytest.approx((up - down) / 2e-6, abs=1e-4)


@pytest.mark.parametrize("optimizer", ["rmsprop", "adam"])
@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_training_equals_plain_steps(points, optimizer, dropout):
    from hashlib import md5

    rows = rows_of(points)
    ids, x = matrix(rows)
    _, y = matrix(rows, "y")
    spec = mlp.TrainSpec(epochs=2, steps=3, optimizer=optimizer, l2=0.001, dropout=dropout, seed=5)
    start = mlp.new_network([64, 8, 10], "cross_entropy", seed=3)
    net, history = mlp.train(rows, "vec_id", "x", "y", start, spec)
    plain, slots, step, batch = start, np.zeros((2, start.params.size)), 0, batches_of(ids, 5, 3)
    losses = []
    for epoch in (1, 2):
        losses.append(0.0)
        for b in sorted(range(3), key=lambda s: md5(f"5|{epoch}|{s}".encode()).hexdigest()):
            pick, step = batch == b, step + 1
            keys = np.array([int(md5(f"5|drop|{step}|{i}".encode()).hexdigest()[:7], 16) for i in ids[pick]])
            loss, _, grad = plain.gradient_sums([x[pick]], y[pick], mlp.drop_masks(keys, [8], dropout) if dropout else None)
            penalty = plain.penalised()
            losses[-1] += loss + pick.sum() * 0.001 * (penalty * plain.params**2).sum()
            grad = grad / pick.sum() + 0.002 * penalty * plain.params
            plain = plain.with_params(mlp._update(optimizer, 0.001, plain.params, grad, slots, step))
    assert np.allclose(net.params, plain.params, atol=1e-9)
    assert [r[1] for r in history.rows] == [1, 2] and history.seconds > 0
    assert np.allclose([r[2] for r in history.rows], np.array(losses) / len(ids))


def test_training_ignores_partitions_and_rows_without_values(spark, points):
    rows = rows_of(points).select("vec_id", "x", "y")
    holes = spark.createDataFrame(
        [(7, None, [0.0] * 10), (8, [0.0] * 64, None), (9, [None] + [0.0] * 63, [0.0] * 10), (10, [0.0] * 64, [None] + [0.0] * 9)],
        "vec_id bigint, x array<double>, y array<double>")
    spec = mlp.TrainSpec(epochs=1, steps=2, dropout=0.5, seed=4)
    start = mlp.new_network([64, 8, 10], "cross_entropy", seed=3)
    nets = [mlp.train(d, "vec_id", "x", "y", start, spec)[0] for d in (rows.repartition(1), rows.repartition(7), rows.unionByName(holes))]
    assert all(np.allclose(nets[0].params, n.params, atol=1e-9) for n in nets)
    assert not np.allclose(nets[0].params, start.params)
    with pytest.raises(Exception, match="expected a x of 64 cells"):
        mlp.train(rows.withColumn("x", F.slice("x", 1, 63)), "vec_id", "x", "y", start, spec)


def test_empty_batches_and_empty_tables(points):
    few = rows_of(points).filter("vec_id < 3")
    start = mlp.new_network([64, 4, 10], "cross_entropy", seed=3)
    net, _ = mlp.train(few, "vec_id", "x", "y", start, mlp.TrainSpec(steps=50))
    assert np.isfinite(net.params).all()
    with pytest.raises(ValueError, match="no rows"):
        mlp.train(few.limit(0), "vec_id", "x", "y", start, mlp.TrainSpec(steps=2))
    with pytest.raises(ValueError, match="at most"):
        mlp.train(few, "vec_id", "x", "y", start, mlp.TrainSpec(steps=10**6))


def test_batch_size_sets_the_steps():
    assert mlp.TrainSpec(batch=64).steps_for(1000) == 16
    assert sorted(mlp.batch_order(3, 2, 9)) == list(range(9)) != mlp.batch_order(3, 2, 9)


def test_loss_falls_and_weights_survive_saving(spark, points, tmp_path):
    rows = rows_of(points)
    spec = mlp.TrainSpec(epochs=6, batch=128, optimizer="adam", rate=0.01)
    net, history = mlp.train(rows, "vec_id", "x", "y", mlp.new_network([64, 16, 10], "cross_entropy", 1), spec, rows)
    losses = [r[2] for r in history.rows]
    assert losses[-1] < losses[0] and history.rows[-1][4] < history.rows[0][4]
    writers.save_model({"weights": net.table(spark)}, str(tmp_path / "model"))
    back = mlp.network_from_table(writers.load_model(spark, str(tmp_path / "model"), "weights")["weights"], net.loss)
    assert back.widths == net.widths and np.array_equal(back.params, net.params)


def test_regression_learns_a_line(spark):
    df = spark.range(2000).select("id", F.array((F.col("id") % 100) / 100.0).alias("x"))
    df = df.withColumn("y", F.array(F.col("x")[0] * 2 - 1))
    spec = mlp.TrainSpec(epochs=8, steps=6, rate=0.02)
    _, history = mlp.train(df, "id", "x", "y", mlp.new_network([1, 16, 1], "mse", 1), spec)
    assert history.rows[-1][2] < 0.02 < history.rows[0][2] and history.rows[0][3] is None


def test_sweep_and_comparison(points):
    rows = rows_of(points)
    train, test = order.prefix_split(rows, "vec_id")
    spec = mlp.TrainSpec(epochs=2, steps=2)
    table = mlp.sweep(
        train, "vec_id", "x", "y", "cross_entropy", {"small": ([4], spec), "big": ([512, 512], spec)}, validation=test
    )
    wide = mlp.compare_models(table, "val_loss", ["small", "big"]).orderBy("epoch").collect()
    assert [r["epoch"] for r in wide] == [1, 2] and all(r["small"] > 0 and r["big"] > 0 for r in wide)


def test_fused_head_sees_both_branches(points):
    rows = rows_of(points)
    half = [rows.select("vec_id", F.slice("x", s, 32).alias("h"), "y") for s in (1, 33)]
    nets = [mlp.new_network([32, 8, 10], "cross_entropy", s) for s in (1, 2)]
    fused = fusion.fuse(half[0], "h", nets[0], half[1], "h", nets[1], "vec_id")
    _, got = matrix(fused, "fused")
    sides = [matrix(h.withColumn("p", mlp.forward(F.col("h"), n)), "p")[1] for h, n in zip(half, nets)]
    assert np.allclose(got, np.hstack(sides))
    head, history = fusion.train_head(fused, "vec_id", "y", 10, 20, mlp.TrainSpec(epochs=1, steps=2))
    assert head.widths == [20, 64, 64, 64, 10] and len(history.rows) == 1


def test_training_reaches_the_branches_below_the_head(points):
    rows = rows_of(points)
    half = [rows.select("vec_id", F.slice("x", s, 32).alias("h"), "y") for s in (1, 33)]
    both = fusion.join_blocks(*half, "vec_id", "h", "left", "right")
    parts = [mlp.new_network([32, 8, 10], "cross_entropy", s) for s in (1, 2)]
    start = fusion.branched(parts, 10, (16,), 3)
    spec = mlp.TrainSpec(epochs=4, steps=3, optimizer="adam", rate=0.01)
    net, history = mlp.train(both, "vec_id", ["left", "right"], "y", start, spec, both)
    assert all(not np.allclose(a.params, b.params) for a, b in zip(net.parts, parts))
    assert history.rows[-1][4] < history.rows[0][4]
    _, out = matrix(both.withColumn("p", mlp.forward([F.col("left"), F.col("right")], net)), "p")
    assert np.allclose(out.sum(axis=1), 1)


# ---- regions


def test_decision_regions_cover_the_padded_range(plane):
    model = generative.gaussian_fit(plane, "x", "label")
    out = regions.decision_regions(plane, "x", lambda p, x: generative.gaussian_predict(p, x, model), pad=1, step=0.25)
    lo0, hi0, lo1, hi1 = plane.agg(F.min(F.col("x")[0]), F.max(F.col("x")[0]), F.min(F.col("x")[1]), F.max(F.col("x")[1])).first()
    want = len(np.arange(lo0 - 1, hi0 + 1, 0.25)) * len(np.arange(lo1 - 1, hi1 + 1, 0.25))
    assert out.count() == want
