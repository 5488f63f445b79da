"""Small helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: ASCII white space: the word separators of the shingle and language-model operators.
BLANK = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    Where the session has none, as in tests, one beneath the warehouse is set.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Spark removes a written query's shuffle files at its end, as only the written table is read later.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def settle(df: DataFrame, purpose: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def settle_dealt(df: DataFrame, purpose: str, by: list[str], options: dict[str, str] | None = None) -> DataFrame:
    """As settle, but dealt out by a key into a bucketed table: later groupings and joins by that key read it without a shuffle."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    name, parts = f"t_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_removed(spark):
        writer = df.repartition(parts, *by).write.format("parquet").option("compression", "zstd").options(**(options or {}))
        writer.bucketBy(parts, *by).sortBy(*by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._settled_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that no later job reads."""
    for df in tables:
        jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the rows don't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """The rows without the columns of these names in any letter case, as results take their place."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone)) if gone & {c.lower() for c in df.columns} else df


#: Rows of an Arrow batch where whole texts go to Python: batches of long texts stay small.
TEXT_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends at most TEXT_ROWS rows at a time to Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


#: Bytes of an Arrow batch where rows are large and as many as fit would fill a worker.
BATCH_BYTES = 8 << 20


def small_bytes(spark: SparkSession) -> None:
    """From now on the session sends about BATCH_BYTES at a time to Python workers, at most."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give the system back what this Python worker holds and doesn't use, so that it is small while idle."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # the C library of Linux
        libc.malloc_trim(0)


def hash_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


class Remembered(dict):
    """Values worked out once per key, up to a bounded number; a full memory is emptied."""

    def __init__(self, work_out, most: int):
        super().__init__()
        self.work_out, self.most = work_out, most

    def __missing__(self, key):
        value = self.work_out(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


def let(value: Column, body) -> Column:
    """Bind a value once for use inside lambdas.

    Catalyst may inline a projected column into a lambda that refers to it and then
    evaluates it for each element; a one-element transform keeps it a bound variable.
    """
    return F.transform(F.array(value), body)[0]
