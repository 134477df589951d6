"""Sinks and inspection: CSV matrices, model tables, shape, schema, first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemodels.session import small_table


def write_matrix(df: DataFrame, vector: str, width: int, path: str, id_col: str | None = None) -> None:
    """A vector column as headerless comma-separated lines, one file per task.

    Rows keep no order in a folder of part files; name an ``id_col`` to have it
    as the first field.
    """
    lead = [F.col(id_col)] if id_col else []
    cells = [F.col(vector)[i].alias(f"v{i}") for i in range(width)]
    df.select(*lead, *cells).write.mode("errorifexists").csv(path)


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """A fitted model as named parquet tables under one folder."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def schema_table(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return small_table(df.sparkSession, rows, "position int, name string, type string")
