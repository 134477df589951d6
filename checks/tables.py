"""Sources, sinks, cleaning and scalar expressions."""

from __future__ import annotations

from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from checks.base import (
    SQL_DIRTY_PRICE, SQL_HOLE, SQL_POINTS, dirty_price, long_vector, points, query, read, rnd, sql_long, sql_rnd, with_holes,
)
from tablemodels.functions import clean
from tablemodels.functions import vectors as V
from tablemodels.operators.order import head, percentiles
from tablemodels.session import scratch_dir, small_table
from tablemodels.sources import files, readers, writers

# ---- sources


@query("s1_parquet_select", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(spark, sf):
    return readers.read_parquet(spark, f"{sf}/orders.parquet", "o_orderkey", "o_totalprice", "o_orderstatus")


@query("s2_delimited_latin1", "SELECT c_custkey, 'Café ' || c_name AS c_name, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch_dir(spark, "latin1")
    src = read(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    named = src.withColumn("c_name", F.concat(F.lit("Café "), "c_name"))
    named.write.csv(path, sep="\t", header=True, encoding="ISO-8859-1")
    return readers.read_delimited(
        spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string"
    )


@query("s3_curve_csv", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
def _(spark, sf):
    path = scratch_dir(spark, "curve")
    read(spark, sf, "lineitem", "l_quantity", "l_extendedprice").write.csv(path, header=True)
    return readers.read_curve(spark, path)


@query(
    "s4_matrix_csv",
    "SELECT embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, "
    "CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM embeddings",
)
def _(spark, sf):
    path = scratch_dir(spark, "matrix")
    sign = F.when(F.col("label") < 5, 1.0).otherwise(-1.0)
    points(spark, sf).select(F.col("x")[0], F.col("x")[1], sign).write.csv(path)
    rows = readers.read_matrix(spark, path, 3)
    both = V.slice_vector(F.col("row"), 0, 2)
    return rows.select(both[0].alias("x1"), both[1].alias("x2"), F.col("row")[2].alias("y"))


@query(
    "s5_labelled_csv",
    "SELECT l_quantity AS width, l_extendedprice AS height, "
    "(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INTEGER AS label FROM lineitem",
)
def _(spark, sf):
    path = scratch_dir(spark, "labelled")
    kind = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    src = read(spark, sf, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice")
    src.select(kind.alias("fruit"), F.col("l_quantity").alias("width"), F.col("l_extendedprice").alias("height")).write.csv(
        path, header=True
    )
    df = readers.read_labelled_points(spark, path, "fruit int, width double, height double", "fruit", ["width", "height"])
    return df.select(F.col("x")[0].alias("width"), F.col("x")[1].alias("height"), "label")


def npy_folder(spark, sf):
    """The vectors as 8 × 8 tensor files, one per batch of a task."""
    folder = scratch_dir(spark, "tensors")

    def write(batches):
        for batch in batches:
            if batch.num_rows:
                out = BytesIO()
                np.save(out, batch.column(1).flatten().to_numpy().reshape(-1, 8, 8), allow_pickle=False)
                files.write_file(folder, f"{batch.column(0)[0].as_py()}.npy", out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    points(spark, sf).select("vec_id", "x").mapInArrow(write, "n bigint").agg(F.sum("n")).first()
    return folder


SQL_CELL_SUMS = (
    f"SELECT height, width, (pos - 1)::INTEGER AS pos, n, {sql_rnd('total')} AS total FROM (SELECT 8::INTEGER AS height, "
    "8::INTEGER AS width, pos, count(*)::BIGINT AS n, sum(x[pos]) AS total "
    f"FROM ({SQL_POINTS}), range(1, 65) t(pos) GROUP BY pos)"
)


def cell_sums(images):
    cells = images.select("height", "width", F.posexplode_outer("pixels").alias("pos", "v"))
    return cells.groupBy("height", "width", "pos").agg(F.count("*").alias("n"), rnd(F.sum("v")).alias("total"))


@query("s6_tensor_shards", SQL_CELL_SUMS)
def _(spark, sf):
    return cell_sums(readers.read_npy(spark, npy_folder(spark, sf), range_bytes=20_000))


@query("s6_tensors_in_a_column", SQL_CELL_SUMS)
def _(spark, sf):
    held = spark.read.format("binaryFile").load(npy_folder(spark, sf))
    return cell_sums(readers.decode_npy(held))


@query("s9_named_rows", "SELECT r_regionkey AS key, r_name AS name FROM region")
def _(spark, sf):
    return read(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))


@query(
    "s10_even_grid",
    f"SELECT i AS id, {sql_rnd('lo + i * (hi - lo) / 199.0')} AS x FROM "
    "(SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part), range(200) t(i)",
)
def _(spark, sf):
    lo, hi = read(spark, sf, "part").agg(F.min("p_size"), F.max("p_size")).first()
    return readers.linspace(spark, lo, hi, 200).select("id", rnd("x").alias("x"))


GRID_SQL = (
    "b AS (SELECT min(x1) - {pad} AS x0, max(x1) + {pad} AS x9, min(x2) - {pad} AS y0, max(x2) + {pad} AS y9 FROM p), "
    "g AS (SELECT i, j, i + j * nx AS grid_id, x0 + i * {step} AS gx, y0 + j * {step} AS gy FROM "
    "(SELECT *, ceil((x9 - x0) / {step})::BIGINT AS nx, ceil((y9 - y0) / {step})::BIGINT AS ny FROM b), "
    "LATERAL (SELECT unnest(range(nx)) AS i), LATERAL (SELECT unnest(range(ny)) AS j))"
)


@query(
    "s11_padded_grid",
    "WITH p AS (SELECT embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2 FROM embeddings), "
    + GRID_SQL.format(pad=3, step=0.05)
    + f" SELECT grid_id::BIGINT AS grid_id, {sql_rnd('gx')} AS gx, {sql_rnd('gy')} AS gy FROM g",
)
def _(spark, sf):
    flat = points(spark, sf).select(F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"))
    return readers.grid(flat, "x1", "x2", pad=3).select("grid_id", rnd("gx").alias("gx"), rnd("gy").alias("gy"))


# ---- sinks and inspection


@query("k1_matrix_csv_roundtrip", sql_long("vec_id", "x", f"({SQL_POINTS})"))
def _(spark, sf):
    path = scratch_dir(spark, "savetxt")
    writers.write_matrix(points(spark, sf), "x", 64, path, id_col="vec_id")
    rows = readers.read_matrix(spark, path, 65)
    back = rows.select(F.col("row")[0].cast("bigint").alias("vec_id"), V.slice_vector(F.col("row"), 1, 64).alias("x"))
    return long_vector(back, "x", "vec_id")


@query("k3_shape", "SELECT count(*)::BIGINT AS n_rows, 6::INTEGER AS n_cols FROM orders")
def _(spark, sf):
    return writers.shape(read(spark, sf, "orders"))


SQL_TYPE_NAMES = (
    "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
    "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"
)


@query(
    "k4_schema_listing",
    f"SELECT (row_number() OVER () - 1)::INTEGER AS position, column_name AS name, {SQL_TYPE_NAMES} AS type FROM (DESCRIBE orders)",
)
def _(spark, sf):
    return writers.schema_table(read(spark, sf, "orders"))


@query("k5_show_rows", "SELECT * FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20)")
def _(spark, sf):
    return head(read(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice"), 20, "o_orderkey")


# ---- projection, filter, cleaning


@query("p1_column_subset", "SELECT o_totalprice, o_orderkey FROM orders")
def _(spark, sf):
    return read(spark, sf, "orders").select("o_totalprice", "o_orderkey")


def dirty_orders(spark, sf):
    return read(spark, sf, "orders").withColumn("price", dirty_price())


SQL_DIRTY = f"(SELECT *, {SQL_DIRTY_PRICE} AS price FROM orders)"


@query("p2_blank_to_null", f"SELECT o_orderkey, nullif(price, '') AS price FROM {SQL_DIRTY}")
def _(spark, sf):
    return clean.blank_to_null(dirty_orders(spark, sf), ["price"]).select("o_orderkey", "price")


@query("p3_drop_incomplete", f"SELECT o_orderkey, price FROM {SQL_DIRTY} WHERE price <> ''")
def _(spark, sf):
    return clean.drop_incomplete(clean.blank_to_null(dirty_orders(spark, sf), ["price"])).select("o_orderkey", "price")


@query(
    "p3_require_present_pushed",
    "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> '' GROUP BY 1",
)
def _(spark, sf):
    rows = clean.require_present(read(spark, sf, "orders", "o_orderstatus", "o_orderpriority"), ["o_orderpriority"])
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("p4_cast_columns", f"SELECT o_orderkey, try_cast(price AS FLOAT)::DOUBLE AS price FROM {SQL_DIRTY}")
def _(spark, sf):
    cast = clean.cast_columns(dirty_orders(spark, sf), ["price"], "float")
    return cast.select("o_orderkey", F.col("price").cast("double").alias("price"))


@query("p5_numeric_coercion", f"SELECT o_orderkey, coalesce(try_cast(price AS DOUBLE), 0.0) AS price FROM {SQL_DIRTY}")
def _(spark, sf):
    return dirty_orders(spark, sf).select("o_orderkey", clean.to_number(F.col("price")).alias("price"))


@query(
    "p6_fill_null",
    f"SELECT o_orderkey, coalesce(try_cast(price AS DOUBLE), 0.0) AS number, nullif(price, '') AS price FROM {SQL_DIRTY}",
)
def _(spark, sf):
    df = clean.blank_to_null(dirty_orders(spark, sf), ["price"]).withColumn("number", F.col("price").try_cast("double"))
    return clean.fill_null(df.select("o_orderkey", "number", "price"), 0)


@query(
    "p7_first_digits",
    "SELECT doc_id, nullif(regexp_extract(source, '[0-9]+'), '') AS source_digits, "
    "nullif(regexp_extract(text, '[0-9]+'), '') AS text_digits FROM documents",
)
def _(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "source", "text")
    return docs.select(
        "doc_id",
        clean.first_digits(F.col("source")).alias("source_digits"),
        clean.first_digits(F.col("text")).alias("text_digits"),
    )


@query("p8_overwrite_above", "SELECT doc_id, (CASE WHEN n_chars > 2018 THEN 0 ELSE n_chars END)::BIGINT AS n_chars FROM documents")
def _(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "n_chars")
    return docs.select("doc_id", clean.overwrite_above(F.col("n_chars"), 2018).alias("n_chars"))


CUTS = (10.0, 25.0, 40.0)  # l_quantity holds these values, so the boundary rules show
SQL_CUT = (
    "(CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity {op} 10 AND l_quantity < 25 THEN 2 "
    "WHEN l_quantity {op} 25 AND l_quantity < 40 THEN 3 WHEN l_quantity {op} 40 THEN 4 END)::INTEGER"
)


@query(
    "p9_threshold_classes",
    f"SELECT open_class, right_class, count(*)::BIGINT AS n FROM (SELECT {SQL_CUT.format(op='>')} AS open_class, "
    f"{SQL_CUT.format(op='>=')} AS right_class FROM lineitem) GROUP BY 1, 2",
)
def _(spark, sf):
    q = F.col("l_quantity")
    classed = read(spark, sf, "lineitem", "l_quantity").select(
        clean.bucket_by_cuts(q, CUTS).alias("open_class"), clean.bucket_by_cuts(q, CUTS, "right").alias("right_class")
    )
    return classed.groupBy("open_class", "right_class").agg(F.count("*").alias("n"))


SQL_QUARTERS = (
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, "
    "quantile_cont(o_totalprice, 0.75) AS c FROM orders), classed AS (SELECT o_orderkey, (CASE WHEN o_totalprice < a THEN 1 "
    "WHEN o_totalprice > a AND o_totalprice < b THEN 2 WHEN o_totalprice > b AND o_totalprice < c THEN 3 "
    "WHEN o_totalprice > c THEN 4 END)::INTEGER AS class FROM orders, q) "
)


@query("p10_quartile_classes", SQL_QUARTERS + "SELECT o_orderkey, class FROM classed")
def _(spark, sf):
    orders = read(spark, sf, "orders", "o_orderkey", "o_totalprice")
    cuts = percentiles(orders, "o_totalprice", (0.25, 0.5, 0.75))
    return orders.select("o_orderkey", clean.bucket_by_cuts(F.col("o_totalprice"), cuts).alias("class"))


@query(
    "p11_cycle",
    "SELECT c_custkey, ((floor(c_acctbal)::BIGINT % 12 + 12) % 12)::BIGINT AS whole, "
    "round_even(c_acctbal - 12 * floor(c_acctbal / 12), 0) AS part FROM customer",
)
def _(spark, sf):
    bal = F.col("c_acctbal")
    return read(spark, sf, "customer", "c_custkey", "c_acctbal").select(
        "c_custkey", clean.cycle(F.floor(bal)).alias("whole"), clean.cycle(bal).alias("part")
    )


# ---- vectors

SQL_P = f"({SQL_POINTS})"


@query("p12_bias_columns", sql_long("vec_id", "[1.0::DOUBLE] || x || [1.0::DOUBLE]", SQL_P))
def _(spark, sf):
    both = points(spark, sf).withColumn("x", V.prepend_bias(V.append_bias(F.col("x"))))
    return long_vector(both, "x", "vec_id")


@query(
    "p13_mask_filter",
    "SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1",
)
def _(spark, sf):
    rows = read(spark, sf, "lineitem", "l_returnflag").filter(F.col("l_returnflag") == "A")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "p14_assemble",
    sql_long("p_partkey", "v", "(SELECT p_partkey, [p_size::DOUBLE, p_retailprice] AS v FROM part)"),
)
def _(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", V.assemble("p_size", "p_retailprice").alias("v"))
    return long_vector(rows, "v", "p_partkey")


@query("p15_concat_blocks", sql_long("vec_id", "[label::DOUBLE] || x || [vec_id::DOUBLE]", SQL_P))
def _(spark, sf):
    wide = V.concat_blocks(V.assemble("label"), F.col("x"), V.assemble("vec_id"))
    return long_vector(points(spark, sf).withColumn("x", wide), "x", "vec_id")


SQL_POLY = ", ".join(["1.0::DOUBLE", *[f"pow(p_size / 10.0::DOUBLE, {j})" for j in range(1, 8)]])
SQL_SINE = ", ".join(["1.0::DOUBLE", *[f"sin(p_size / {j}.0::DOUBLE)" for j in range(1, 8)]])


@query("p16_polynomial_basis", sql_long("p_partkey", "v", f"(SELECT p_partkey, [{SQL_POLY}] AS v FROM part)"))
def _(spark, sf):
    basis = V.polynomial_basis(F.col("p_size") / 10.0, 7)
    return long_vector(read(spark, sf, "part").select("p_partkey", basis.alias("v")), "v", "p_partkey")


@query("p17_sine_basis", sql_long("p_partkey", "v", f"(SELECT p_partkey, [{SQL_SINE}] AS v FROM part)"))
def _(spark, sf):
    basis = V.sine_basis(F.col("p_size"), 7)
    return long_vector(read(spark, sf, "part").select("p_partkey", basis.alias("v")), "v", "p_partkey")


@query("p18_flatten", sql_long("vec_id", "x", SQL_P))
def _(spark, sf):
    square = points(spark, sf).withColumn("m", V.reshape(F.col("x"), 8, 8))
    return long_vector(square.withColumn("x", V.flatten_matrix(F.col("m"))), "x", "vec_id")


@query(
    "p19_reshape",
    "SELECT vec_id, ((pos - 1) // 8)::INTEGER AS r, ((pos - 1) % 8)::INTEGER AS c, x[pos] AS value "
    f"FROM {SQL_P}, range(1, 65) t(pos)",
)
def _(spark, sf):
    square = points(spark, sf).select("vec_id", F.posexplode_outer(V.reshape(F.col("x"), 8, 8)).alias("r", "row"))
    return square.select("vec_id", "r", F.posexplode_outer("row").alias("c", "value"))


@query("p20_slice", sql_long("vec_id", "x[3:5]", SQL_P))
def _(spark, sf):
    return long_vector(points(spark, sf).withColumn("x", V.slice_vector(F.col("x"), 2, 3)), "x", "vec_id")


@query(
    "p21_elementwise",
    f"SELECT vec_id, (pos - 1)::INTEGER AS pos, {sql_rnd('3.0::DOUBLE * pow(x[pos] - x[65 - pos], 2) + x[pos] * x[pos]')} AS value "
    f"FROM {SQL_P}, range(1, 65) t(pos)",
)
def _(spark, sf):
    x, y = F.col("x"), F.reverse("x")
    value = V.add(V.scale(V.power(V.subtract(x, y), 2), 3.0), V.multiply(x, x))
    return long_vector(points(spark, sf).withColumn("x", value), "x", "vec_id")


WEIGHTS = [[((7 * i + 3 * j) % 11 - 5) / 5 for j in range(64)] for i in range(3)]


def sql_list(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


@query(
    "p22_dot_products",
    f"SELECT vec_id, {sql_rnd('list_dot_product(x, x)')} AS own, "
    + ", ".join(f"{sql_rnd(f'list_dot_product(x, {sql_list(w)})')} AS w{i}" for i, w in enumerate(WEIGHTS))
    + f" FROM {SQL_P}",
)
def _(spark, sf):
    out = points(spark, sf).withColumn("z", V.mat_vec(WEIGHTS, F.col("x")))
    z = [rnd(F.col("z")[i]).alias(f"w{i}") for i in range(3)]
    return out.select("vec_id", rnd(V.dot(F.col("x"), F.col("x"))).alias("own"), *z)


@query(
    "p22_dot_products_with_nulls",
    f"SELECT vec_id, CASE WHEN NOT {SQL_HOLE} THEN {sql_rnd(f'list_dot_product(x, {sql_list(WEIGHTS[0])})')} END AS wide, "
    f"CASE WHEN NOT {SQL_HOLE} THEN {sql_rnd(f'list_dot_product(x[1:3], {sql_list(WEIGHTS[0][:3])})')} END AS narrow FROM {SQL_P}",
)
def _(spark, sf):
    holes = with_holes(points(spark, sf))
    wide, narrow = V.mat_vec(WEIGHTS, F.col("x")), V.mat_vec([WEIGHTS[0][:3]], F.slice("x", 1, 3))
    return holes.select("vec_id", rnd(F.get(wide, F.lit(0))).alias("wide"), rnd(F.get(narrow, F.lit(0))).alias("narrow"))


@query(
    "p23_kernels",
    f"SELECT vec_id, {sql_rnd('list_dot_product(x, r)')} AS linear, {sql_rnd('pow(list_dot_product(x, r) + 1, 2)')} AS quadratic "
    f"FROM (SELECT vec_id, x, list_reverse(x) AS r FROM {SQL_P})",
)
def _(spark, sf):
    def with_kernel(kernel: V.Kernel):
        return rnd(kernel(F.col("x"), F.reverse("x")))

    linear = with_kernel(V.linear_kernel).alias("linear")
    quadratic = with_kernel(lambda a, b: F.pow(V.dot(a, b) + 1.0, F.lit(2.0))).alias("quadratic")
    return points(spark, sf).select("vec_id", linear, quadratic)


@query(
    "p24_log_softmax",
    "WITH z AS (SELECT vec_id, x, list_max(x) AS m FROM " + SQL_P + "), l AS (SELECT vec_id, x, "
    "m + ln(list_sum(list_transform(x, lambda v: exp(v - m)))) AS lse FROM z) "
    + f"SELECT vec_id, (pos - 1)::INTEGER AS pos, {sql_rnd('lse')} AS lse, {sql_rnd('x[pos] - lse')} AS log_p, "
    f"{sql_rnd('exp(x[pos] - lse)')} AS p FROM l, range(1, 65) t(pos)",
)
def _(spark, sf):
    x = F.col("x")
    rows = points(spark, sf).withColumn("lse", V.log_sum_exp(x)).withColumn("lp", V.log_softmax(x, F.col("lse")))
    rows = rows.withColumn("p", F.transform("lp", F.exp))
    cells = rows.select("vec_id", "lse", F.posexplode_outer(F.arrays_zip("lp", "p")).alias("pos", "v"))
    return cells.select("vec_id", "pos", rnd("lse").alias("lse"), rnd("v.lp").alias("log_p"), rnd("v.p").alias("p"))


@query(
    "p25_clip_to_byte",
    "SELECT vec_id, (pos - 1)::INTEGER AS pos, trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE, x[pos] * 900 + 100)))::INTEGER AS value "
    f"FROM {SQL_P}, range(1, 65) t(pos)",
)
def _(spark, sf):
    bytes_ = V.clip_to_byte(F.transform("x", lambda v: v * 900 + 100))
    return points(spark, sf).select("vec_id", F.posexplode_outer(bytes_).alias("pos", "value"))
