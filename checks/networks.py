"""Dense networks; their SQL unrolls every training step: forward, backward, gradient sums, optimizer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.base import SQL_POINTS, long_vector, points, query, read, rnd, sql_long, sql_rnd, sql_uniform
from checks.profiles import SQL_WIDE, customers
from checks.tables import WEIGHTS, sql_list
from tablemodels.functions import vectors as V
from tablemodels.functions.clean import bucket_by_cuts
from tablemodels.operators import features, fusion, mlp, order
from tablemodels.operators.align import pair_modalities
from tablemodels.plans.preparation import feature_rows
from tablemodels.session import scratch_dir
from tablemodels.sources import writers

PLACES = 6


# ---- training in SQL


class SqlTraining:
    """CTEs that train ``net`` on ``rows`` (id, x0, x1..., y), one after the other for each optimizer step.

    ``{tag}p{t}`` holds the weights and optimizer slots after t steps, ``{tag}q{t}`` the same as lists per layer,
    ``{tag}f{t}`` the rows of the step's batch with activations, derivatives and gradients, ``{tag}g{t}`` their sums.
    """

    def __init__(self, tag: str, rows: str, net, spec: mlp.TrainSpec, held_out: str | None = None):
        self.tag, self.net, self.spec = tag, net, spec
        self.parts = [*net.parts, net.head] if isinstance(net, mlp.Branches) else [net]
        self.size = net.params.size
        self.held_out = held_out is not None
        slot = f"floor({sql_uniform(f"'{spec.seed}|batch|' || id")} * {spec.steps})::INTEGER"
        self.ctes = [f"{tag}rows AS MATERIALIZED (SELECT *, {slot} AS slot FROM ({rows}))"]
        if self.held_out:
            self.ctes.append(f"{tag}held AS MATERIALIZED ({held_out})")
        zeros = f"list_transform(range({self.size}), lambda i: 0.0::DOUBLE)"
        start = ", ".join(repr(float(v)) for v in net.params)
        self.ctes.append(f"{tag}p0 AS MATERIALIZED (SELECT '[{start}]'::DOUBLE[] AS p, {zeros} AS s0, {zeros} AS s1)")
        self.lists(0)
        self.epoch_steps, t = [], 0
        for epoch in range(1, spec.epochs + 1):
            self.epoch_steps.append([])
            for slot in mlp.batch_order(spec.seed, epoch, spec.steps):
                self.step(t, slot)
                self.epoch_steps[-1].append(t)
                t += 1
            if self.held_out:
                self.ctes.append(f"{tag}v{epoch} AS MATERIALIZED ({self.losses(self.forward(f'{tag}held', t, False))})")
        self.last = t

    def penalised(self) -> str:
        spans, at = [], 0
        for net in self.parts:
            for a, b in zip(net.widths, net.widths[1:]):
                spans.append(f"i BETWEEN {at + 1} AND {at + a * b}")
                at += a * b + b
        return " OR ".join(spans)

    def lists(self, t: int):
        """Kernel columns c, kernel rows r and biases b of every layer."""
        out, at = [], 0
        for m, net in enumerate(self.parts):
            for k, (a, b) in enumerate(zip(net.widths, net.widths[1:])):
                out.append(f"list_transform(range({b}), lambda j: list_transform(range({a}), lambda i: p[{at} + i * {b} + j + 1])) AS c{m}_{k}")
                out.append(f"list_transform(range({a}), lambda i: p[{at} + i * {b} + 1 : {at} + i * {b} + {b}]) AS r{m}_{k}")
                out.append(f"p[{at + a * b + 1} : {at + a * b + b}] AS b{m}_{k}")
                at += a * b + b
        penalty = f"{self.spec.l2!r}::DOUBLE * list_sum(list_transform(p, lambda v, i: CASE WHEN {self.penalised()} THEN v * v ELSE 0.0 END))"
        self.ctes.append(f"{self.tag}q{t} AS MATERIALIZED (SELECT {', '.join(out)}, {penalty} AS penalty FROM {self.tag}p{t})")

    def masks(self, t: int) -> list[str]:
        keep = 1.0 - self.spec.dropout
        key = f"('0x' || substr(md5('{self.spec.seed}|drop|{t + 1}|' || id), 1, 7))::BIGINT"
        out = [f"{key} AS drop_key"]
        for k, width in enumerate(self.net.dropped):
            h = f"((drop_key + {(k + 1) * 40_503} + u * 1327217 % 2147483647) * 48271 % 2147483647)"
            h = f"(({h} * {h} + 12345) % 2147483647 * 16807 % 2147483647)"
            out.append(f"list_transform(range(1, {width + 1}), lambda u: CASE WHEN {h} < {keep!r}::DOUBLE * 2147483647 THEN 1 / {keep!r}::DOUBLE ELSE 0.0 END) AS mask{k}")
        return out

    def layer(self, sql: str, m: int, net, dropped: bool) -> str:
        depth = len(net.widths) - 1
        for k in range(depth):
            z = f"list_dot_product(a{m}_{k}, c) + b{m}_{k}[j]"
            if k < depth - 1:
                z = f"greatest(0.0::DOUBLE, {z})" + (f" * mask{k}[j]" if dropped else "")
            end = net.loss == "cross_entropy" and k == depth - 1
            sql = f"SELECT *, list_transform(c{m}_{k}, lambda c, j: {z}) AS {'z' if end else 'a'}{m}_{k + 1} FROM ({sql})"
            if end:
                z = f"z{m}_{k + 1}"
                sql = f"SELECT *, list_transform({z}, lambda v: exp(v - list_max({z}))) AS e{m} FROM ({sql})"
                sql = f"SELECT *, list_transform(e{m}, lambda v: v / list_sum(e{m})) AS a{m}_{depth} FROM ({sql})"
        return sql

    def forward(self, source: str, t: int, training: bool) -> str:
        dropped = training and self.spec.dropout > 0
        *below, top = self.parts
        first = ", ".join(f"x{m} AS a{m}_0" for m in range(max(len(below), 1)))
        sql = f"SELECT *, {first} FROM {source}, {self.tag}q{t}"
        if dropped:
            for column in self.masks(t):
                sql = f"SELECT *, {column} FROM ({sql})"
        for m, net in enumerate(below):
            sql = self.layer(sql, m, net, False)
        if below:
            joined = " || ".join(f"a{m}_{len(net.widths) - 1}" for m, net in enumerate(below))
            sql = f"SELECT *, {joined} AS a{len(below)}_0 FROM ({sql})"
        return self.layer(sql, len(below), top, dropped)

    @property
    def out(self) -> str:
        return f"a{len(self.parts) - 1}_{len(self.parts[-1].widths) - 1}"

    def losses(self, sql: str) -> str:
        out = self.out
        if self.net.loss == "mse":
            loss = f"list_sum(list_transform({out}, lambda v, j: pow(v - y[j], 2))) / len(y)"
        else:
            loss = f"-list_sum(list_transform({out}, lambda v, j: y[j] * ln(greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, v)))))"
        right = f"list_position({out}, list_max({out})) = list_position(y, list_max(y))"
        return f"SELECT *, {loss} AS row_loss, ({right})::INTEGER AS hit FROM ({sql})"

    def backward(self, sql: str, m: int, net, dropped: bool) -> str:
        for k in range(len(net.widths) - 2, 0, -1):
            mask = f" * mask{k - 1}[i]" if dropped else ""
            d = f"CASE WHEN a{m}_{k}[i] > 0 THEN list_dot_product(r, d{m}_{k + 1}){mask} ELSE 0.0 END"
            sql = f"SELECT *, list_transform(r{m}_{k}, lambda r, i: {d}) AS d{m}_{k} FROM ({sql})"
        return sql

    def step(self, t: int, slot: int):
        tag, spec, top = self.tag, self.spec, len(self.parts) - 1
        dropped = spec.dropout > 0
        sql = self.losses(self.forward(f"(SELECT * FROM {tag}rows WHERE slot = {slot})", t, True))
        depth, out = len(self.parts[-1].widths) - 1, self.out
        first = f"2.0::DOUBLE * (v - y[j]) / len(y)" if self.net.loss == "mse" else "v - y[j]"
        sql = f"SELECT *, list_transform({out}, lambda v, j: {first}) AS d{top}_{depth} FROM ({sql})"
        sql = self.backward(sql, top, self.parts[-1], dropped)
        if top:
            sql = f"SELECT *, list_transform(r{top}_0, lambda r: list_dot_product(r, d{top}_1)) AS below FROM ({sql})"
            at = 0
            for m, net in enumerate(self.parts[:-1]):
                k, d = len(net.widths) - 1, f"below[{at + 1} : {at + net.n_out}]"
                at += net.n_out
                if net.loss == "cross_entropy":
                    d = f"list_transform(a{m}_{k}, lambda a, i: a * ({d}[i] - list_dot_product({d}, a{m}_{k})))"
                sql = self.backward(f"SELECT *, {d} AS d{m}_{k} FROM ({sql})", m, net, False)
        grads = [
            f"flatten(list_transform(a{m}_{k}, lambda a: list_transform(d{m}_{k + 1}, lambda d: a * d))) || d{m}_{k + 1}"
            for m, net in enumerate(self.parts) for k in range(len(net.widths) - 1)
        ]
        self.ctes.append(f"{tag}f{t} AS MATERIALIZED (SELECT row_loss, hit, penalty, {' || '.join(grads)} AS grad FROM ({sql}))")
        sums = f"SELECT pos, sum(v) AS v FROM (SELECT unnest(grad) AS v, generate_subscripts(grad, 1) AS pos FROM {tag}f{t}) GROUP BY pos"
        self.ctes.append(
            f"{tag}g{t} AS MATERIALIZED (SELECT * FROM (SELECT list(v ORDER BY pos) AS g FROM ({sums})), "
            f"(SELECT count(*)::DOUBLE AS n, sum(row_loss) AS loss, sum(hit) AS hits, any_value(penalty) AS penalty FROM {tag}f{t}))"
        )
        every, l2 = f"range(1, {self.size + 1})", f"{2 * spec.l2!r}::DOUBLE"
        mean = f"list_transform({every}, lambda i: g[i] / n + CASE WHEN {self.penalised()} THEN {l2} * p[i] ELSE 0.0 END) AS m"
        sql = f"SELECT p, s0, s1, {mean} FROM {tag}p{t}, {tag}g{t}"
        if spec.optimizer == "rmsprop":
            d = mlp.RMSPROP_DECAY
            sql = f"SELECT p, m, list_transform({every}, lambda i: {d!r}::DOUBLE * s0[i] + {1 - d!r}::DOUBLE * m[i] * m[i]) AS s0, s1 FROM ({sql})"
            moved = f"p[i] - {spec.rate!r}::DOUBLE * m[i] / sqrt(s0[i] + 1e-7::DOUBLE)"
        else:
            b1, b2 = mlp.ADAM_DECAYS
            rate = float(spec.rate * np.sqrt(1 - b2 ** (t + 1)) / (1 - b1 ** (t + 1)))
            sql = (
                f"SELECT p, m, list_transform({every}, lambda i: {b1!r}::DOUBLE * s0[i] + {1 - b1!r}::DOUBLE * m[i]) AS s0, "
                f"list_transform({every}, lambda i: {b2!r}::DOUBLE * s1[i] + {1 - b2!r}::DOUBLE * m[i] * m[i]) AS s1 FROM ({sql})"
            )
            moved = f"p[i] - {rate!r}::DOUBLE * s0[i] / (sqrt(s1[i]) + 1e-7::DOUBLE)"
        self.ctes.append(f"{tag}p{t + 1} AS MATERIALIZED (SELECT list_transform({every}, lambda i: {moved}) AS p, s0, s1 FROM ({sql}))")
        self.lists(t + 1)

    def history(self, name: str) -> str:
        """One row per epoch, as ``mlp.History`` gives it."""
        rows = []
        for epoch, steps in enumerate(self.epoch_steps, 1):
            sums = " UNION ALL ".join(f"SELECT n, loss + n * penalty AS loss, hits FROM {self.tag}g{t}" for t in steps)
            accuracy = "sum(hits) / sum(n)" if self.net.loss == "cross_entropy" else "NULL::DOUBLE"
            held = "NULL::DOUBLE AS val_loss, NULL::DOUBLE AS val_accuracy"
            if self.held_out:
                hit = "avg(hit)" if self.net.loss == "cross_entropy" else "NULL::DOUBLE"
                both = f"SELECT {{}} FROM {self.tag}v{epoch}"
                held = f"({both.format(f'{sql_rnd("avg(row_loss) + any_value(penalty)", PLACES)}')}) AS val_loss, ({both.format(sql_rnd(hit, PLACES))}) AS val_accuracy"
            rows.append(
                f"SELECT '{name}' AS model, {epoch}::INTEGER AS epoch, {sql_rnd('sum(loss) / sum(n)', PLACES)} AS loss, "
                f"{sql_rnd(accuracy, PLACES)} AS accuracy, {held} FROM ({sums})"
            )
        return " UNION ALL ".join(rows)

    def weights(self) -> str:
        """The trained network's weight table."""
        rows, at = [], 0
        for layer, (a, b) in enumerate(zip(self.net.widths, self.net.widths[1:])):
            rows.append(f"SELECT {layer}::INTEGER AS layer, i::INTEGER AS i, j::INTEGER AS j, {sql_rnd(f'p[{at} + i * {b} + j + 1]', PLACES)} AS value "
                        f"FROM {self.tag}p{self.last}, range({a}) t(i), range({b}) u(j)")
            rows.append(f"SELECT {layer}::INTEGER, -1::INTEGER, j::INTEGER, {sql_rnd(f'p[{at + a * b} + j + 1]', PLACES)} FROM {self.tag}p{self.last}, range({b}) u(j)")
            at += a * b + b
        return " UNION ALL ".join(rows)


def sql_histories(trainings: dict[str, SqlTraining], lead: str = "") -> str:
    ctes = ", ".join(c for t in trainings.values() for c in t.ctes)
    return f"WITH {lead}{ctes} " + " UNION ALL ".join(t.history(name) for name, t in trainings.items())


def rounded(history):
    return history.select("model", "epoch", *[rnd(c, PLACES).alias(c) for c in ("loss", "accuracy", "val_loss", "val_accuracy")])


def sql_one_hot(label: str, n: int) -> str:
    return f"list_transform(range({n}), lambda k: (k = {label})::INTEGER::DOUBLE)"


def sql_split(rows: str, train: bool) -> str:
    """First 80 % of rows by id, or the rest."""
    return (
        f"SELECT * EXCLUDE (split_place, split_rows) FROM (SELECT *, row_number() OVER (ORDER BY id) AS split_place, count(*) OVER () AS split_rows "
        f"FROM ({rows})) WHERE split_place {'<=' if train else '>'} round_even(0.8 * split_rows, 0)"
    )


# ---- queries


def price_rows(spark, sf):
    """(o_orderkey, x, y): price from date and status, all near unit scale."""
    orders = read(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    year = (F.year("o_orderdate") - 1995) / 3.0
    open_ = F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)
    return orders.select("o_orderkey", V.assemble(year, open_).alias("x"), F.array(F.col("o_totalprice") / 500_000).alias("y"))


SQL_PRICES = (
    "SELECT o_orderkey AS id, [(year(o_orderdate) - 1995) / 3.0::DOUBLE, (o_orderstatus = 'O')::INTEGER::DOUBLE] AS x0, "
    "[o_totalprice::DOUBLE / 500000] AS y FROM orders"
)
PRICE_NET = mlp.new_network([2, 16, 16, 1], "mse", seed=1)
PRICE_SPEC = mlp.TrainSpec(steps=4)


@query("m19_mlp_regression", sql_histories({"model": SqlTraining("t", SQL_PRICES, PRICE_NET, PRICE_SPEC)}))
def _(spark, sf):
    _, history = mlp.train(price_rows(spark, sf), "o_orderkey", "x", "y", PRICE_NET, PRICE_SPEC)
    return rounded(history.table(spark))


def label_rows(spark, sf):
    return features.one_hot_class(points(spark, sf), "label", "y", 10)


SQL_LABELS = f"SELECT vec_id AS id, x AS x0, {sql_one_hot('label', 10)} AS y FROM ({SQL_POINTS})"
LABEL_NET = mlp.new_network([64, 16, 16, 10], "cross_entropy", seed=1)
LABEL_SPEC = mlp.TrainSpec(epochs=3, steps=2, optimizer="adam")


@query(
    "m20_mlp_classifier",
    sql_histories({"model": SqlTraining("t", sql_split(SQL_LABELS, True), LABEL_NET, LABEL_SPEC, sql_split(SQL_LABELS, False))}),
)
def _(spark, sf):
    train, test = order.prefix_split(label_rows(spark, sf), "vec_id")
    _, history = mlp.train(train, "vec_id", "x", "y", LABEL_NET, LABEL_SPEC, validation=test)
    return rounded(history.table(spark))


def customer_rows(spark, sf):
    """Customer features with the balance quartile class as a four-way target."""
    base = customers(spark, sf)
    wide = feature_rows(base, "c_custkey", ["c_nationkey"], ["c_mktsegment", "n_name"])
    cuts = order.percentiles(base, "c_acctbal", (0.25, 0.5, 0.75))
    target = V.one_hot(bucket_by_cuts(F.col("c_acctbal"), cuts, "right") - 1, 4)
    return pair_modalities(wide, base.select("c_custkey", target.alias("y")), "c_custkey")


SQL_FEATURES = SQL_WIDE.format(lead="[c_nationkey::DOUBLE]").split(" SELECT c_custkey, (i - 1)")[0].removeprefix("WITH ")
SQL_CUSTOMERS = (
    SQL_FEATURES + ", cuts AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS q2, quantile_cont(c_acctbal, 0.75) AS q3 FROM b), "
    "wide AS MATERIALIZED (SELECT c_custkey, list(CASE WHEN d = 0 THEN 0 ELSE (x - m) / d END ORDER BY i) AS x0 FROM e JOIN s USING (i) GROUP BY c_custkey), "
    f"customers AS MATERIALIZED (SELECT c_custkey AS id, x0, {sql_one_hot('(CASE WHEN c_acctbal <= q1 THEN 0 WHEN c_acctbal <= q2 THEN 1 WHEN c_acctbal <= q3 THEN 2 ELSE 3 END)', 4)} AS y "
    "FROM wide JOIN b USING (c_custkey), cuts), "
)
N_FEATURES = 31  # nation key, five segments, 25 nations
VARIANTS = {
    "original": ([16, 16], mlp.TrainSpec(epochs=2, steps=2)),
    "smaller": ([4, 4], mlp.TrainSpec(epochs=2, steps=2)),
    "bigger": ([64, 64], mlp.TrainSpec(epochs=2, steps=2)),
    "l2": ([16, 16], mlp.TrainSpec(epochs=2, steps=2, l2=0.001)),
    "dropout": ([16, 16], mlp.TrainSpec(epochs=2, steps=2, dropout=0.5)),
}


def swept(spark, sf, *names):
    train, test = order.prefix_split(customer_rows(spark, sf), "c_custkey")
    chosen = {n: VARIANTS[n] for n in names}
    return mlp.sweep(train, "c_custkey", "features", "y", "cross_entropy", chosen, validation=test)


def sql_swept(*names: str) -> str:
    both, trainings = [sql_split("SELECT * FROM customers", t) for t in (True, False)], {}
    for n in names:
        hidden, spec = VARIANTS[n]
        net = mlp.new_network([N_FEATURES, *hidden, 4], "cross_entropy", spec.seed)
        trainings[n] = SqlTraining(n, both[0], net, spec, both[1])
    return sql_histories(trainings, SQL_CUSTOMERS)


@query("m21_capacity_sweep", sql_swept("smaller", "original", "bigger"))
def _(spark, sf):
    return rounded(swept(spark, sf, "smaller", "original", "bigger"))


@query("m22_l2_penalty", sql_swept("original", "l2"))
def _(spark, sf):
    return rounded(swept(spark, sf, "original", "l2"))


@query("m23_dropout", sql_swept("original", "dropout"))
def _(spark, sf):
    return rounded(swept(spark, sf, "original", "dropout"))


@query(
    "m24_model_comparison",
    "SELECT epoch, " + ", ".join(f"max(val_loss) FILTER (model = '{m}') AS {m}" for m in ("original", "l2", "dropout"))
    + f" FROM ({sql_swept('original', 'l2', 'dropout')}) GROUP BY epoch",
)
def _(spark, sf):
    models = ["original", "l2", "dropout"]
    wide = mlp.compare_models(swept(spark, sf, *models), "val_loss", models)
    return wide.select("epoch", *[rnd(m, PLACES).alias(m) for m in models])


SMALL_NET = mlp.new_network([64, 8, 10], "cross_entropy", seed=2)
SMALL_SPEC = mlp.TrainSpec(steps=3)
SMALL_SQL = SqlTraining("t", SQL_LABELS, SMALL_NET, SMALL_SPEC)


@query("m25_trained_weights", f"WITH {', '.join(SMALL_SQL.ctes)} {SMALL_SQL.weights()}")
def _(spark, sf):
    net, _ = mlp.train(label_rows(spark, sf), "vec_id", "x", "y", SMALL_NET, SMALL_SPEC)
    return net.table(spark).withColumn("value", rnd("value", PLACES))


@query(
    "k2_trained_model_save_load",
    f"WITH {', '.join(SMALL_SQL.ctes)} SELECT {sql_rnd('avg(row_loss)')} AS loss, {sql_rnd('avg(hit)')} AS accuracy "
    f"FROM ({SMALL_SQL.losses(SMALL_SQL.forward('trows', SMALL_SQL.last, False))})",
)
def _(spark, sf):
    net, _ = mlp.train(label_rows(spark, sf), "vec_id", "x", "y", SMALL_NET, SMALL_SPEC)
    path = scratch_dir(spark, "model")
    writers.save_model({"weights": net.table(spark)}, path)
    again = mlp.network_from_table(writers.load_model(spark, path, "weights")["weights"], "cross_entropy")
    scores = mlp.evaluate(label_rows(spark, sf), "x", "y", again)
    return scores.select(rnd("loss").alias("loss"), rnd("accuracy").alias("accuracy"))


# ---- two branches under one head

BASES = [mlp.new_network([32, 8, 10], "cross_entropy", i) for i in (0, 1)]
BRANCH_SPEC = mlp.TrainSpec(epochs=2, steps=2)
HEAD = (16, 16)


def halves(spark, sf):
    rows = label_rows(spark, sf)
    return [rows.select("vec_id", V.slice_vector(F.col("x"), s, 32).alias("h"), "y") for s in (0, 32)]


SQL_BLOCKS = f"SELECT id, x0[1:32] AS x0, x0[33:64] AS x1, y FROM ({SQL_LABELS})"
SQL_BRANCHES = SqlTraining(
    "t", sql_split(SQL_BLOCKS, True), fusion.branched(BASES, 10, HEAD, BRANCH_SPEC.seed), BRANCH_SPEC, sql_split(SQL_BLOCKS, False)
)


@query("m26_two_branch_training", sql_histories({"fused": SQL_BRANCHES}))
def _(spark, sf):
    both = fusion.join_blocks(*halves(spark, sf), "vec_id", "h", "left", "right")
    train, test = order.prefix_split(both, "vec_id")
    net = fusion.branched(BASES, 10, HEAD, BRANCH_SPEC.seed)
    _, history = mlp.train(train, "vec_id", ["left", "right"], "y", net, BRANCH_SPEC, test, "fused")
    return rounded(history.table(spark))


SQL_BASES = [SqlTraining(f"b{i}_", f"SELECT id, x0[{32 * i + 1}:{32 * i + 32}] AS x0, y FROM ({SQL_LABELS})", net, BRANCH_SPEC) for i, net in enumerate(BASES)]
SQL_FUSED = (
    "fused AS MATERIALIZED (SELECT id, l.a0_2 || r.a0_2 AS x0, l.y FROM "
    + " JOIN ".join(f"({t.forward(t.tag + 'rows', t.last, False)}) {side}" for t, side in zip(SQL_BASES, "lr")) + " USING (id)), "
)
HEAD_NET = mlp.new_network([20, *HEAD, 10], "cross_entropy", BRANCH_SPEC.seed)


@query(
    "m26_two_branch_head",
    sql_histories(
        {"fused": SqlTraining("t", sql_split("SELECT * FROM fused", True), HEAD_NET, BRANCH_SPEC, sql_split("SELECT * FROM fused", False))},
        ", ".join(c for t in SQL_BASES for c in t.ctes) + ", " + SQL_FUSED,
    ),
)
def _(spark, sf):
    left, right = halves(spark, sf)
    nets = [mlp.train(r, "vec_id", "h", "y", net, BRANCH_SPEC)[0] for r, net in zip((left, right), BASES)]
    fused = fusion.fuse(left, "h", nets[0], right, "h", nets[1], "vec_id")
    train, test = order.prefix_split(fused, "vec_id")
    return rounded(fusion.train_head(train, "vec_id", "y", 10, 20, BRANCH_SPEC, HEAD, validation=test)[1].table(spark))


# ---- fixed weights


def fixed_network() -> mlp.Network:
    kernel1, kernel2 = np.array(WEIGHTS).T, np.array([row[:3] for row in WEIGHTS])
    return mlp.Network([64, 3, 3], "cross_entropy", np.concatenate([kernel1.ravel(), [0.1, -0.2, 0.3], kernel2.ravel(), [0.0, 0.5, -0.5]]))


SQL_HIDDEN = ", ".join(f"greatest(0.0::DOUBLE, list_dot_product(x, {sql_list(w)}) + {b})" for w, b in zip(WEIGHTS, (0.1, -0.2, 0.3)))
SQL_OUT = ", ".join(f"list_dot_product(h, {sql_list([row[j] for row in WEIGHTS])}) + {b}" for j, b in enumerate((0.0, 0.5, -0.5)))
SQL_FORWARD = (
    f"WITH a AS (SELECT vec_id, [{SQL_HIDDEN}] AS h FROM ({SQL_POINTS})), z AS (SELECT vec_id, [{SQL_OUT}] AS z FROM a), "
    "e AS (SELECT vec_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z), "
    "f AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS v FROM e) " + sql_long("vec_id", "v", "f")
)


@query("m28_forward_pass", SQL_FORWARD)
def _(spark, sf):
    out = mlp.forward(F.col("x"), fixed_network())
    return long_vector(points(spark, sf).select("vec_id", out.alias("v")), "v", "vec_id")


@query("k2_model_save_load", SQL_FORWARD)
def _(spark, sf):
    path = scratch_dir(spark, "model")
    writers.save_model({"weights": fixed_network().table(spark)}, path)
    again = mlp.network_from_table(writers.load_model(spark, path, "weights")["weights"], "cross_entropy")
    return long_vector(points(spark, sf).select("vec_id", mlp.forward(F.col("x"), again).alias("v")), "v", "vec_id")
