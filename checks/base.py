"""Registry and the expressions that queries and their SQL share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; without SQL only its rows are checked by the driver."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def rnd(col: Column | str, places: int = 6) -> Column:
    """Rounded, with minus zero made zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, places) + F.lit(0.0)


def sql_rnd(expr: str, places: int = 6) -> str:
    return f"(round({expr}, {places}) + 0.0::DOUBLE)"


def long_vector(df: DataFrame, vector: str, *keys: str, places: int = 6) -> DataFrame:
    """One row per vector element: keys, pos, value.

    The outer form, because the plain one works the vector out a second time to
    drop empty ones first.
    """
    return df.select(*keys, F.posexplode_outer(vector).alias("pos", "value")).select(*keys, "pos", rnd("value", places).alias("value"))


def sql_long(keys: str, vector: str, source: str, places: int = 6) -> str:
    """The same in SQL: one row per element with 0-based pos."""
    lead = keys + ", " if keys else ""
    return (
        f"SELECT {lead}(pos - 1)::INTEGER AS pos, {sql_rnd('value', places)} AS value FROM "
        f"(SELECT {lead}unnest({vector}) AS value, generate_subscripts({vector}, 1) AS pos FROM {source})"
    )


# Text as it comes from a dirty file: blanks, padding, junk; the same in both engines.
def dirty_price() -> Column:
    return F.expr(
        "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'n/a' "
        "WHEN o_orderkey % 13 = 0 THEN concat('  ', CAST(o_totalprice AS STRING), ' ') "
        "ELSE CAST(o_totalprice AS STRING) END"
    )


SQL_DIRTY_PRICE = (
    "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'n/a' "
    "WHEN o_orderkey % 13 = 0 THEN '  ' || CAST(o_totalprice AS VARCHAR) || ' ' "
    "ELSE CAST(o_totalprice AS VARCHAR) END"
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x): the embeddings as double vectors."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


SQL_POINTS = "SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings"


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label 0..2, x): the first two embedding dimensions in three classes."""
    return points(spark, sf_dir).select("vec_id", (F.col("label") % 3).alias("label"), F.slice("x", 1, 2).alias("x"))


def with_holes(df: DataFrame, vector: str = "x") -> DataFrame:
    """Every seventh vector null, every eleventh with a null cell in second place."""
    hole = F.transform(vector, lambda v, i: F.when(i != 1, v))
    kept = F.when(F.col("vec_id") % 7 == 0, None).when(F.col("vec_id") % 11 == 0, hole).otherwise(F.col(vector))
    return df.withColumn(vector, kept)


SQL_HOLE = "(vec_id % 7 = 0 OR vec_id % 11 = 0)"

SQL_PLANE = (
    "SELECT vec_id, (label % 3)::INTEGER AS label, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2 FROM embeddings"
)

SQL_UNIFORM = "((('0x' || substr(md5({text}), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0"


def sql_uniform(text: str) -> str:
    return SQL_UNIFORM.format(text=text)
