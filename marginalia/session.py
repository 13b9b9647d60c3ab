"""Session helpers: ship the package to executors, open a scratch area, read tables."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_marginalia_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="marginalia-"), "marginalia.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(target)
    context._marginalia_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marginalia-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written below the shared folder; they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.names: set[str] = set()
        self.root = f"{shared_dir(spark)}/marginalia/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.names.add(name)
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Save the result and remove all other tables."""
        out = self.save(df, name)
        for other in self.names - {name}:
            self.drop(other)
        return out

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        with contextlib.suppress(Exception):  # what is gone already is no loss
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def hand_back(spark: SparkSession) -> None:
    """Each executor collects its garbage whole, so that the heap that shuffles left goes back to the system: what runs next in Python needs it."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


#: Bytes that small batches send to Python at once, about.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Within this, what is run sends at most so many rows to Python at once, and a batch ends when it holds BATCH_BYTES."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    old = {name: spark.conf.get(name) for name in limits}
    for name, most in limits.items():
        now = int(old[name].removesuffix("b"))
        spark.conf.set(name, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


#: Bytes of a batch that are Python objects at once, about.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], *sized: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most about SLICE_BYTES in the named columns (binary, text, or lists of text); a larger row stands alone.
    What a part makes is gone before the next, so a worker holds one batch and what one part needs, however many rows a batch has."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for name in sized:
            column = batch.column(batch.schema.get_field_index(name))
            if pa.types.is_list(column.type):
                starts = column.offsets.to_numpy()
                inner = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column.values), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 50)])
                ends += np.diff(inner[starts])
            else:
                ends += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(ends + 50)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch


def input_partitions(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Shuffle partitions for an operator that moves about as much as df holds: the session's number, or more where the estimated size asks for it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(n, min(size // bytes_each, 200_000)) if size < 1 << 58 else n
