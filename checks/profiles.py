"""Aggregates, ordering, sampling, alignment, feature transformers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.base import SQL_PLANE, SQL_POINTS, long_vector, plane, points, query, read, rnd, sql_long, sql_rnd, sql_uniform
from checks.tables import SQL_DIRTY, dirty_orders
from tablemodels.functions import vectors as V
from tablemodels.operators import align, features, groups, order, profile, sampling
from tablemodels.plans import preparation

# ---- aggregates


@query("a1_row_count", "SELECT count(*)::BIGINT AS n FROM lineitem")
def _(spark, sf):
    return profile.row_count(read(spark, sf, "lineitem"))


COUNTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
SQL_COUNTED = ", ".join(f"count(DISTINCT {c})::BIGINT AS {c}" for c in COUNTED)


@query("a2_distinct_counts", f"SELECT {SQL_COUNTED} FROM orders")
def _(spark, sf):
    return profile.distinct_counts(read(spark, sf, "orders"), COUNTED)


@query("a3_group_sizes", "SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return profile.group_sizes(read(spark, sf, "customer"), "c_mktsegment")


@query("a4_value_counts", "SELECT event_type AS value, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _(spark, sf):
    return profile.value_counts(read(spark, sf, "events"), "event_type")


@query(
    "a4_class_counts_with_empty",
    "SELECT c::INTEGER AS label, coalesce(n, 0)::BIGINT AS n FROM range(12) t(c) LEFT JOIN "
    "(SELECT label, count(*) AS n FROM embeddings GROUP BY 1) e ON e.label = c",
)
def _(spark, sf):
    return profile.class_counts(points(spark, sf), "label", 12)


@query("a5_distinct_values", "SELECT DISTINCT o_orderpriority AS value FROM orders")
def _(spark, sf):
    return profile.distinct_values(read(spark, sf, "orders"), "o_orderpriority")


@query(
    "a6_moments",
    f"SELECT n, min, max, {sql_rnd('mean', 4)} AS mean, {sql_rnd('variance / 1e6')} AS variance, {sql_rnd('m3 / pow(m2, 1.5)')} AS skewness, "
    f"{sql_rnd('kurtosis')} AS kurtosis FROM (SELECT count(*)::BIGINT AS n, min(p) AS min, max(p) AS max, any_value(mu) AS mean, "
    "var_samp(p) AS variance, avg(pow(p - mu, 2)) AS m2, avg(pow(p - mu, 3)) AS m3, kurtosis_pop(p) AS kurtosis "
    "FROM (SELECT o_totalprice AS p, (SELECT avg(o_totalprice) FROM orders) AS mu FROM orders))",
)
def _(spark, sf):
    m = profile.moments(read(spark, sf, "orders"), "o_totalprice")
    return m.select(
        "n", "min", "max", rnd("mean", 4).alias("mean"), rnd(F.col("variance") / 1e6).alias("variance"),
        rnd("skewness").alias("skewness"), rnd("kurtosis").alias("kurtosis"),
    )


SQL_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", stat, {sql_rnd('value', 4)} AS value FROM (SELECT unnest(['count', 'mean', 'std', 'min', '25%', "
    f"'50%', '75%', 'max']) AS stat, unnest([count({c})::DOUBLE, avg({c}), stddev_samp({c}), min({c})::DOUBLE, quantile_cont({c}, 0.25), "
    f"quantile_cont({c}, 0.5), quantile_cont({c}, 0.75), max({c})::DOUBLE]) AS value FROM lineitem)"
    for c in ("l_quantity", "l_extendedprice", "l_discount")
)


@query("a7_describe", SQL_DESCRIBE)
def _(spark, sf):
    out = profile.describe(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("value", rnd("value", 4))


SQL_QUANTILES = (
    "SELECT p AS prob, quantile_cont FROM (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS p, "
    f"unnest([{sql_rnd('quantile_cont({c}, 0.25)')}, {sql_rnd('quantile_cont({c}, 0.5)')}, {sql_rnd('quantile_cont({c}, 0.75)')}]) "
    "AS quantile_cont FROM {t})"
)


@query("a8_percentiles", SQL_QUANTILES.format(c="o_totalprice", t="orders").replace("quantile_cont FROM (", "quantile_cont AS value FROM ("))
def _(spark, sf):
    table = profile.percentile_table(read(spark, sf, "orders", "o_totalprice"), "o_totalprice")
    return table.withColumn("value", rnd("value"))


@query(
    "a8_percentiles_by_counting",
    SQL_QUANTILES.format(c="l_extendedprice", t="lineitem").replace("quantile_cont FROM (", "quantile_cont AS value FROM ("),
)
def _(spark, sf):
    table = profile.percentile_table(read(spark, sf, "lineitem", "l_extendedprice"), "l_extendedprice", small_rows=0)
    return table.withColumn("value", rnd("value"))


@query(
    "a9_histogram",
    "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), "
    "h AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 50))::INTEGER + 1, 50) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1) "
    f"SELECT i::INTEGER AS bin, {sql_rnd('lo + (i - 1) * (hi - lo) / 50', 4)} AS lower, {sql_rnd('lo + i * (hi - lo) / 50', 4)} AS upper, "
    "coalesce(n, 0)::BIGINT AS n FROM range(1, 51) t(i) CROSS JOIN b LEFT JOIN h ON h.bin = i",
)
def _(spark, sf):
    bars = profile.histogram(read(spark, sf, "lineitem", "l_extendedprice"), "l_extendedprice", 50)
    return bars.select("bin", rnd("lower", 4).alias("lower"), rnd("upper", 4).alias("upper"), "n")


SQL_MEANS = (
    f"SELECT label, n, (i - 1)::INTEGER AS pos, {sql_rnd('m')} AS value FROM (SELECT label, i, count(*)::BIGINT AS n, avg(x[i]) AS m "
    f"FROM ({SQL_POINTS}), range(1, 65) t(i) GROUP BY label, i)"
)


@query("a10_group_means", SQL_MEANS)
def _(spark, sf):
    return long_vector(groups.group_means(points(spark, sf), "label", "x"), "mean", "label", "n")


@query(
    "a11_group_covariances",
    f"SELECT l_returnflag, n, {sql_rnd('xx', 4)} AS xx, {sql_rnd('xy', 4)} AS xy, {sql_rnd('yy', 4)} AS yy FROM (SELECT l_returnflag, "
    "count(*)::BIGINT AS n, var_samp(l_quantity) AS xx, covar_samp(l_quantity, l_extendedprice / 1000) AS xy, "
    "var_samp(l_extendedprice / 1000) AS yy FROM lineitem GROUP BY 1)",
)
def _(spark, sf):
    rows = read(spark, sf, "lineitem").select(
        "l_returnflag", F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("x")
    )
    out = groups.group_covariances(rows, "l_returnflag", "x", 2)
    cell = {"xx": (0, 0), "xy": (1, 0), "yy": (1, 1)}
    return out.select("l_returnflag", "n", *[rnd(F.col("cov")[i][j], 4).alias(k) for k, (i, j) in cell.items()])


@query(
    "a11_wide_covariances_of_many_groups",
    "WITH g AS (SELECT vec_id % 120 AS k, x FROM (" + SQL_POINTS + ")), c AS (SELECT k, a, b, covar_samp(x[a], x[b]) AS v "
    "FROM g, range(1, 65) t(a), range(1, 65) u(b) GROUP BY k, a, b) "
    f"SELECT k, {sql_rnd('sum(v) FILTER (a = b)')} AS trace, {sql_rnd('sum(abs(v))')} AS total, {sql_rnd('sum(v * a / b)')} AS mixed FROM c GROUP BY k",
)
def _(spark, sf):
    rows = points(spark, sf).select((F.col("vec_id") % 120).alias("k"), "x")
    cells = groups.group_covariances(rows, "k", "x").select("k", F.posexplode_outer("cov").alias("a", "row")).select(
        "k", "a", F.posexplode_outer("row").alias("b", "v")
    )
    return cells.groupBy("k").agg(
        rnd(F.sum(F.when(F.col("a") == F.col("b"), F.col("v")))).alias("trace"), rnd(F.sum(F.abs("v"))).alias("total"),
        rnd(F.sum(F.col("v") * (F.col("a") + 1) / (F.col("b") + 1))).alias("mixed"),
    )


@query(
    "a11_wide_covariances",
    f"SELECT label, (a - 1)::INTEGER AS i, (b - 1)::INTEGER AS j, {sql_rnd('v')} AS value FROM (SELECT label, a, b, "
    f"covar_samp(x[a], x[b]) AS v FROM ({SQL_POINTS}), range(1, 65) t(a), range(1, 65) u(b) GROUP BY label, a, b)",
)
def _(spark, sf):
    cov = groups.group_covariances(points(spark, sf), "label", "x")
    rows = cov.select("label", F.posexplode_outer("cov").alias("i", "row"))
    return long_vector(rows, "row", "label", "i").withColumnRenamed("pos", "j")


@query(
    "a12_shared_covariance",
    f"WITH p AS ({SQL_PLANE}), c AS (SELECT label, count(*) AS n, var_samp(x1) AS a, covar_samp(x1, x2) AS b, var_samp(x2) AS d FROM p GROUP BY 1), "
    "s AS (SELECT sum(n * a) / sum(n) AS a, sum(n * b) / sum(n) AS b, sum(n * d) / sum(n) AS d FROM c) "
    "SELECT unnest([0, 0, 1, 1]::INTEGER[]) AS i, unnest([0, 1, 0, 1]::INTEGER[]) AS j, "
    f"unnest([{sql_rnd('a')}, {sql_rnd('b')}, {sql_rnd('b')}, {sql_rnd('d')}]) AS value FROM s",
)
def _(spark, sf):
    shared = groups.shared_covariance(groups.group_covariances(plane(spark, sf), "label", "x", 2))
    return shared.select("i", "j", rnd("value").alias("value"))


@query(
    "a13_log_priors",
    f"SELECT l_returnflag, n, {sql_rnd('ln(n / (SELECT count(*) FROM lineitem))')} AS log_prior FROM "
    "(SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY 1)",
)
def _(spark, sf):
    return groups.log_priors(read(spark, sf, "lineitem", "l_returnflag"), "l_returnflag").withColumn("log_prior", rnd("log_prior"))


@query(
    "a17_column_range",
    "SELECT unnest(['l_quantity', 'l_extendedprice']) AS \"column\", unnest([min(l_quantity), min(l_extendedprice)]) AS min, "
    "unnest([max(l_quantity), max(l_extendedprice)]) AS max FROM lineitem",
)
def _(spark, sf):
    return profile.value_range(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "a18_mean_std",
    "SELECT unnest(['l_quantity', 'l_extendedprice']) AS \"column\", "
    f"unnest([{sql_rnd('avg(l_quantity)')}, {sql_rnd('avg(l_extendedprice)', 4)}]) AS mean, "
    f"unnest([{sql_rnd('stddev_pop(l_quantity)', 4)}, {sql_rnd('stddev_pop(l_extendedprice)', 4)}]) AS std FROM lineitem",
)
def _(spark, sf):
    out = profile.mean_std(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    places = F.when(F.col("column") == "l_quantity", rnd("mean", 6)).otherwise(rnd("mean", 4))
    return out.select("column", places.alias("mean"), rnd("std", 4).alias("std"))


@query("a19_squared_norm", f"SELECT {sql_rnd('sqrt(sum(list_dot_product(x, x)))')} AS frobenius, {sql_rnd('sum(list_dot_product(x, x))')} AS squares FROM ({SQL_POINTS})")
def _(spark, sf):
    squares = points(spark, sf).agg(F.sum(V.dot(F.col("x"), F.col("x"))).alias("s"))
    return squares.select(rnd(F.sqrt("s")).alias("frobenius"), rnd("s").alias("squares"))


# ---- order


@query("w5_full_sort", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) <= 100 AS low FROM orders")
def _(spark, sf):
    orders = read(spark, sf, "orders", "o_orderkey", "o_totalprice")
    cut = order.order_statistics(orders, "o_totalprice", [99])[99]
    return orders.orderBy("o_totalprice", "o_orderkey").withColumn("low", F.col("o_totalprice") <= cut)


SQL_RANKED = "(SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)"


@query(
    "w6_prefix_split",
    f"SELECT o_orderkey, (CASE WHEN rn <= round_even(0.8 * n, 0) THEN 'train' ELSE 'test' END) AS part FROM {SQL_RANKED}",
)
def _(spark, sf):
    train, test = order.prefix_split(read(spark, sf, "orders", "o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("w7_row_slice", f"SELECT o_orderkey, o_totalprice FROM {SQL_RANKED} WHERE rn > n // 4 AND rn <= n - n // 4")
def _(spark, sf):
    orders = read(spark, sf, "orders", "o_orderkey", "o_totalprice")
    n = orders.count()
    return order.row_slice(orders, "o_orderkey", n // 4, n - n // 4)


# Keys as they come: words of unlike length that share their beginnings, and microseconds.
SQL_WORD = "('order/' || (o_orderkey % 7) || '/' || o_orderkey)"
SQL_MOMENT = "make_timestamp(o_orderkey * 1000003)"


def keyed_orders(spark, sf):
    word = F.concat(F.lit("order/"), (F.col("o_orderkey") % 7).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"))
    moment = F.timestamp_micros(F.col("o_orderkey") * 1000003)
    return read(spark, sf, "orders", "o_orderkey").select("o_orderkey", word.alias("word"), moment.alias("moment"))


def sql_parts(key: str) -> str:
    return (
        "SELECT o_orderkey, (CASE WHEN rn <= round_even(0.7 * n, 0) THEN 'train' ELSE 'test' END) AS part FROM "
        f"(SELECT o_orderkey, row_number() OVER (ORDER BY {key}) AS rn, count(*) OVER () AS n FROM orders)"
    )


def split_by(spark, sf, key):
    train, test = order.prefix_split(keyed_orders(spark, sf), key, 0.7)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("o_orderkey", "part")


@query("w6_prefix_split_by_word", sql_parts(SQL_WORD))
def _(spark, sf):
    return split_by(spark, sf, "word")


@query("w6_prefix_split_by_timestamp", sql_parts(SQL_MOMENT))
def _(spark, sf):
    return split_by(spark, sf, "moment")


@query(
    "w7_row_slice_by_word",
    f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {SQL_WORD}) AS rn FROM orders) WHERE rn BETWEEN 101 AND 1100",
)
def _(spark, sf):
    return order.row_slice(keyed_orders(spark, sf), "word", 100, 1100).select("o_orderkey")


@query(
    "x9_hold_out_tail_by_timestamp",
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY k) AS rn, count(*) OVER () AS n FROM "
    "(SELECT event_id, make_timestamp(event_id * 777) AS k FROM events)) WHERE rn > round_even(0.9 * n, 0)",
)
def _(spark, sf):
    events = read(spark, sf, "events", "event_id").withColumn("k", F.timestamp_micros(F.col("event_id") * 777))
    return order.prefix_split(events, "k", 0.9)[1].select("event_id")


SQL_HOLES = "(SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'nan'::DOUBLE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS v FROM lineitem)"


@query(
    "a8_percentiles_without_nan",
    "SELECT prob, value FROM (SELECT unnest([0.1, 0.5, 0.99]::DOUBLE[]) AS prob, unnest(quantile_cont(v, [0.1, 0.5, 0.99])) AS value "
    f"FROM {SQL_HOLES} WHERE NOT isnan(v))".replace("SELECT prob, value", f"SELECT prob, {sql_rnd('value')} AS value"),
)
def _(spark, sf):
    price = F.when(F.col("l_orderkey") % 5 == 0, F.lit(float("nan"))).when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice"))
    out = profile.percentile_table(read(spark, sf, "lineitem").select(price.alias("v")), "v", (0.1, 0.5, 0.99), small_rows=0)
    return out.withColumn("value", rnd("value"))


@query("w8_first_rows", "SELECT * FROM (SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 10)")
def _(spark, sf):
    return order.head(read(spark, sf, "events", "event_id", "event_type"), 10, "event_id")


@query(
    "w9_stack_rows",
    "SELECT c_nationkey AS nation, 'customer' AS role FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier "
    "UNION ALL SELECT c_nationkey, 'again' FROM customer",
)
def _(spark, sf):
    from tablemodels.operators.style import stack

    customers = read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    suppliers = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return stack({"customer": customers, "supplier": suppliers, "again": customers})


# ---- sampling

SQL_SLOT = "(('0x' || substr(md5('1234|' || o_orderkey), 1, 8))::BIGINT % 100)"


@query("x1_hash_split", f"SELECT o_orderkey, (CASE WHEN {SQL_SLOT} < 80 THEN 'train' ELSE 'test' END) AS part FROM orders")
def _(spark, sf):
    train, test = sampling.hash_split(read(spark, sf, "orders", "o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("x1_random_split", "SELECT o_orderkey, 1::BIGINT AS times FROM orders")
def _(spark, sf):
    train, test = sampling.random_split(read(spark, sf, "orders", "o_orderkey"))
    return train.unionByName(test).groupBy("o_orderkey").agg(F.count("*").alias("times"))


@query("x2_repartition", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _(spark, sf):
    rows = sampling.spread(read(spark, sf, "orders", "o_orderkey", "o_orderstatus"), 3)
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("x3_cache_and_count", "SELECT count(*)::BIGINT AS n FROM orders")
def _(spark, sf):
    from tablemodels.session import small_table

    with sampling.cached(read(spark, sf, "orders", "o_orderkey")) as (_, n):
        return small_table(spark, [(n,)], "n bigint")


@query(
    "x4_weighted_draw",
    "WITH d AS (SELECT o_orderkey, o_totalprice, -ln(" + sql_uniform("'7|' || o_orderkey") + ") / o_totalprice AS clock FROM orders) "
    "SELECT o_orderkey, o_totalprice FROM d ORDER BY clock, o_orderkey LIMIT 1",
)
def _(spark, sf):
    orders = read(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return sampling.weighted_draw(orders, "o_orderkey", F.col("o_totalprice"), 7, "o_totalprice")


@query(
    "x5_uniform_draw",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY " + sql_uniform("'7|' || o_orderkey") + ", o_orderkey LIMIT 1",
)
def _(spark, sf):
    orders = read(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return sampling.uniform_draw(orders, "o_orderkey", 7, "o_totalprice")


def sql_draws(table: str, id_col: str, cols: str, n: int, seed: str) -> str:
    """The n drawn rows: rows numbered by hash, then a uniform row number per draw."""
    return (
        f"(SELECT t.t::INTEGER AS t, {id_col}{cols} FROM (SELECT i AS t, floor({sql_uniform(f"'{seed}|' || i")} * "
        f"(SELECT count(*) FROM {table})) AS place FROM range({n}) r(i)) t JOIN (SELECT *, row_number() OVER (ORDER BY "
        f"('0x' || substr(md5({id_col}::VARCHAR), 1, 15))::BIGINT, {id_col}) - 1 AS place FROM {table}) d ON d.place = t.place)"
    )


@query("x6_draw_with_replacement", f"SELECT * FROM {sql_draws('orders', 'o_orderkey', ', o_totalprice', 5000, '11')}")
def _(spark, sf):
    return sampling.draw_with_replacement(read(spark, sf, "orders"), "o_orderkey", 5000, 11, "o_totalprice")


@query("x6_draws_by_deeper_bits", f"SELECT * FROM {sql_draws('events', 'event_id', ', event_type', 300, '12')}")
def _(spark, sf):
    events = read(spark, sf, "events", "event_id", "event_type")
    return sampling.draw_with_replacement(events, "event_id", 300, 12, "event_type", handful=4, first_bits=6)


def sql_normal(seed, key: str, place: str) -> str:
    radius, angle = (sql_uniform(f"'{seed}|{part}|' || {key} || '|' || {place}") for part in "ra")
    return f"sqrt(-2.0::DOUBLE * ln({radius})) * cos(2.0::DOUBLE * pi() * {angle})"


@query(
    "x7_normal_start",
    f"SELECT vec_id, j::INTEGER AS pos, {sql_rnd('x[j + 1] + 0.1::DOUBLE * ' + sql_normal(5, 'vec_id', 'j'))} AS value FROM ({SQL_POINTS}), range(64) t(j)",
)
def _(spark, sf):
    """Every vector with its own normal draws added to it."""
    draws = sampling.normal_vector(5, F.col("vec_id"), 64)
    noisy = points(spark, sf).select("vec_id", F.zip_with("x", draws, lambda v, z: v + 0.1 * z).alias("v"))
    return long_vector(noisy, "v", "vec_id")


@query(
    "x8_mini_batches",
    f"SELECT o_orderkey, (row_number() OVER (ORDER BY {sql_uniform("'3|' || o_orderkey")}, o_orderkey) - 1) // 64 AS batch FROM orders",
)
def _(spark, sf):
    return sampling.mini_batches(read(spark, sf, "orders", "o_orderkey"), "o_orderkey", 64, 3)


@query(
    "x9_hold_out_tail",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) "
    "WHERE rn > round_even(0.8 * n, 0)",
)
def _(spark, sf):
    return order.prefix_split(read(spark, sf, "documents", "doc_id"), "doc_id")[1]


# ---- alignment


@query(
    "j1_align_by_id",
    "SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders",
)
def _(spark, sf):
    orders = read(spark, sf, "orders")
    parts = [orders.select("o_orderkey", c) for c in ("o_totalprice", "o_orderstatus", "o_orderpriority")]
    return align.align(parts, "o_orderkey")


@query("j4_pair_modalities", "SELECT doc_id, n_chars, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def _(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "n_chars", "lang")
    return align.pair_modalities(docs, read(spark, sf, "labels"), "doc_id")


# ---- feature transformers


SQL_INDEX = (
    "(SELECT {c}, (row_number() OVER (ORDER BY count(*) DESC, {c}) - 1)::DOUBLE AS idx FROM {t} GROUP BY {c})"
)
IDX_PRIORITY = SQL_INDEX.format(c="o_orderpriority", t="orders")


@query("f1_index_by_frequency", f"SELECT o_orderkey, idx FROM orders JOIN {IDX_PRIORITY} USING (o_orderpriority)")
def _(spark, sf):
    rows = read(spark, sf, "orders", "o_orderkey", "o_orderpriority")
    return features.index_by_frequency(rows, "o_orderpriority", "idx").select("o_orderkey", "idx")


@query(
    "f1_index_table_many_categories",
    "SELECT o_custkey AS value, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS \"index\" FROM orders GROUP BY 1",
)
def _(spark, sf):
    return features.frequency_index_table(read(spark, sf, "orders", "o_custkey"), "o_custkey")


@query(
    "f2_sparse_one_hot",
    sql_long("o_orderkey", "v", f"(SELECT o_orderkey, list_transform(range(4), lambda i: (i = idx)::INTEGER::DOUBLE) AS v FROM orders JOIN {IDX_PRIORITY} USING (o_orderpriority))"),
)
def _(spark, sf):
    rows = read(spark, sf, "orders", "o_orderkey", "o_orderpriority")
    coded = features.one_hot_sparse(features.index_by_frequency(rows, "o_orderpriority", "idx"), "idx", "hot")
    return long_vector(coded.withColumn("v", vector_to_array("hot")), "v", "o_orderkey")


@query(
    "f3_dense_one_hot",
    sql_long("o_orderkey", "v", f"(SELECT o_orderkey, list_transform(range(9), lambda i: (i = idx)::INTEGER::DOUBLE) AS v FROM orders JOIN {IDX_PRIORITY} USING (o_orderpriority))"),
)
def _(spark, sf):
    rows = features.index_by_frequency(read(spark, sf, "orders", "o_orderkey", "o_orderpriority"), "o_orderpriority", "idx")
    return long_vector(rows.withColumn("v", V.one_hot(F.col("idx"), 9)), "v", "o_orderkey")


@query(
    "f4_one_hot_sorted",
    sql_long(
        "c_custkey", "v",
        "(SELECT c_custkey, list_transform((SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) FROM customer), "
        "lambda s: (s = c_mktsegment)::INTEGER::DOUBLE) AS v FROM customer)",
    ),
)
def _(spark, sf):
    rows = features.one_hot_sorted(read(spark, sf, "customer", "c_custkey", "c_mktsegment"), "c_mktsegment", "v")
    return long_vector(rows, "v", "c_custkey")


@query(
    "f5_one_hot_class",
    sql_long("vec_id", "v", "(SELECT vec_id, list_transform(range((SELECT max(label) + 1 FROM embeddings)), lambda i: (i = label)::INTEGER::DOUBLE) AS v FROM embeddings)"),
)
def _(spark, sf):
    return long_vector(features.one_hot_class(points(spark, sf), "label", "v"), "v", "vec_id")


@query(
    "f6_standardise",
    f"WITH s AS (SELECT i, avg(x[i]) AS m, stddev_pop(x[i]) AS d FROM ({SQL_POINTS}), range(1, 65) t(i) GROUP BY i) "
    f"SELECT vec_id, (i - 1)::INTEGER AS pos, {sql_rnd('(x[i] - m) / d')} AS value FROM ({SQL_POINTS}), s",
)
def _(spark, sf):
    return long_vector(features.standardise(points(spark, sf), "x", "x"), "x", "vec_id")


@query(
    "f7_fixed_range_rescale",
    f"SELECT doc_id, {sql_rnd('n_chars / 250.0::DOUBLE', 9)} AS scaled FROM documents",
)
def _(spark, sf):
    x = V.rescale(V.assemble("n_chars"), 0.0, 1.0, 0.0, 250.0)
    return read(spark, sf, "documents").select("doc_id", rnd(x[0], 9).alias("scaled"))


SQL_PREPARED = (
    f"WITH d AS (SELECT * REPLACE (try_cast(price AS DOUBLE) AS price) FROM {SQL_DIRTY} WHERE price <> ''), "
    "r AS (SELECT * FROM d WHERE price IS NOT NULL), "
    f"s AS {SQL_INDEX.format(c='o_orderstatus', t='r')}, q AS {SQL_INDEX.format(c='o_orderpriority', t='r')} "
)


@query(
    "f8_classification_preparation",
    SQL_PREPARED + f"SELECT o_orderkey, o_orderpriority, q.idx AS label_index, {sql_rnd('price / 500000', 12)} AS f0, {sql_rnd('s.idx / 500000', 9)} AS f1, "
    f"(list_position(list_transform(range((SELECT count(*) FROM q)), lambda i: i = q.idx), true) - 1)::INTEGER AS hot, {SQL_SLOT} < 80 AS train "
    "FROM r JOIN s USING (o_orderstatus) JOIN q USING (o_orderpriority)",
)
def _(spark, sf):
    train, test = preparation.prepare_classification(
        dirty_orders(spark, sf), "o_orderkey", ["price"], "o_orderstatus", "o_orderpriority", scale_max=500_000.0
    )
    both = train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))
    return both.select(
        "o_orderkey", "o_orderpriority", "label_index",
        rnd(F.col("matrix")[0][0], 12).alias("f0"), rnd(F.col("matrix")[0][1], 9).alias("f1"),
        V.first_argmax(F.col("label_encoded")).alias("hot"), "train",
    )


SQL_HOTS = " || ".join(
    f"list_transform((SELECT list(DISTINCT {c} ORDER BY {c}) FROM {t}), lambda s: (s = {c})::INTEGER::DOUBLE)"
    for c, t in (("c_mktsegment", "customer"), ("n_name", "b"))
)
SQL_WIDE = (
    "WITH b AS (SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "w AS MATERIALIZED (SELECT c_custkey, {lead} || " + SQL_HOTS + " AS v FROM b), "
    "e AS MATERIALIZED (SELECT c_custkey, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM w), "
    "s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM e GROUP BY i) "
    "SELECT c_custkey, (i - 1)::INTEGER AS pos, " + sql_rnd("CASE WHEN d = 0 THEN 0 ELSE (x - m) / d END") + " AS value FROM e JOIN s USING (i)"
)


def customers(spark, sf):
    nation = F.broadcast(read(spark, sf, "nation", "n_nationkey", "n_name"))  # 25 rows by definition
    rows = read(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")


@query("f9_feature_rows", SQL_WIDE.format(lead="[c_acctbal, c_nationkey::DOUBLE]"))
def _(spark, sf):
    rows = preparation.feature_rows(
        customers(spark, sf), "c_custkey", ["c_acctbal", "c_nationkey"], ["c_mktsegment", "n_name"]
    )
    return long_vector(rows, "features", "c_custkey")


@query(
    "f9_feature_rows_with_cycle",
    SQL_WIDE.format(lead="[c_acctbal] || list_transform(range(12), lambda k: (k = c_nationkey % 12)::INTEGER::DOUBLE)"),
)
def _(spark, sf):
    rows = preparation.feature_rows(
        customers(spark, sf), "c_custkey", ["c_acctbal", "c_nationkey"], ["c_mktsegment", "n_name"], cycle_of="c_nationkey"
    )
    return long_vector(rows, "features", "c_custkey")


@query(
    "flagship_class_share",
    "WITH r AS (SELECT try_cast(price AS DOUBLE) AS p FROM " + SQL_DIRTY + " WHERE price <> ''), v AS (SELECT p FROM r WHERE p IS NOT NULL), "
    "q AS (SELECT quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.5) AS b, quantile_cont(p, 0.75) AS c FROM v) "
    "SELECT (CASE WHEN p < a THEN 1 WHEN p > a AND p < b THEN 2 WHEN p > b AND p < c THEN 3 WHEN p > c THEN 4 END)::INTEGER AS class, "
    "count(*)::BIGINT AS n FROM v, q GROUP BY 1",
)
def _(spark, sf):
    return preparation.class_share_by_quartile(dirty_orders(spark, sf), "price")
