"""What several of these operators share: written intermediate tables, task-side files, text slices."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tablemodels.session import scratch_dir


def saved(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared scratch folder and read back: lineage ends here and survives lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(file system, path) behind a URI or an absolute path, usable on the driver and inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, empty, shared folder for files that tasks write themselves."""
    uri = scratch_dir(spark, label)
    system, path = file_system(uri)
    system.create_dir(path, recursive=True)
    return uri


def write_whole(uri: str, name: str, data: bytes, attempt: str) -> None:
    """One file, written under a private name and moved into place, so that a repeated task only replaces it."""
    system, path = file_system(uri)
    hidden = f"{path}/_{name}.{attempt}"
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, f"{path}/{name}")


def attempt_id() -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{task.stageId()}-{task.taskAttemptId()}-{os.getpid()}"


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def chunks(rows: list, weight, most: int) -> Iterator[list]:
    """Runs of rows whose summed weight stays near ``most``."""
    run, total = [], 0
    for row in rows:
        run.append(row)
        total += weight(row)
        if total >= most:
            yield run
            run, total = [], 0
    if run:
        yield run


def per_worker(key, make):
    """A value made once per worker process. Functions of this package travel by value, so it is kept outside of them."""
    held = sys.modules.setdefault("_llm_worker_values", types.ModuleType("_llm_worker_values")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
