"""Table reading and lineage cuts shared by the operators of this package."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from adperf.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Tables that :func:`cut` writes inside are deleted at the end, also after a failure; the
    block takes those that must stay out of the list it is given."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        if made:
            discard(*made)


def cut(df: DataFrame, name: str, heavy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    The written table cuts the lineage and survives lost executors. Folders are unique, so a
    retried job never reads a half-written one. ``heavy`` frees the shuffle files of the step
    at once, where they are large beside the table.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/adperf-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if (made := _made.get()) is not None:
        made.append(out)
    if heavy:
        tidy(spark)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote once nothing reads them any more, and let Spark's
    cleaner drop the shuffle files of the finished steps (it follows the JVM's collector)."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no DataFrame refers to any more.

    Right after a step its plan is still held by the events that tell of its end, so one
    collection alone frees each step's files only after the next one has written its own.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.3)
    spark._jvm.System.gc()


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``rows`` rows.

    Batches are bounded by rows, and the default of 10,000 whole texts can be a gigabyte in
    each of a task's buffers. A smaller setting of the caller stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def free_name(df: DataFrame, *names: str) -> list[str]:
    """``names``, each prefixed until it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
