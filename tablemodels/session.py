"""Session helpers: shared scratch folders, size checks, hash-based uniforms."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A model that travels to every task must stay small; 4 M doubles are 32 MB.
MAX_MODEL_CELLS = 4_000_000
# Lookup tables (category lists, class tables) held by the driver.
MAX_LOOKUP_ROWS = 100_000


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder; a temporary one only if driver and tasks share a machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tablemodels-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def check_model_size(cells: int, what: str) -> None:
    if cells > MAX_MODEL_CELLS:
        raise ValueError(f"{what} has {cells} cells, more than {MAX_MODEL_CELLS} can be sent to every task")


def small_table(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    """Named in-memory rows with an explicit schema; refuses anything that is not small."""
    if len(rows) > MAX_LOOKUP_ROWS:
        raise ValueError(f"{len(rows)} rows are too many for an in-memory table")
    return spark.createDataFrame(list(rows), schema)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that must have at most ``limit`` rows; raise if it has more."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def hash_uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform in (0, 1) from md5 of ``seed`` and the keys; same value on any partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**48))
