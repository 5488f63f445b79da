"""Session helpers: settled tables in the shared folder, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder in spark.checkpoint.dir, which all executors share.

    Where the session has no such folder, as in tests, one beneath the warehouse is set.
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


def settle(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write to the shared folder, with the writer's options, and read back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, purpose)
    with _shuffles_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def settle_rows(df: DataFrame, purpose: str) -> DataFrame:
    """A settled table that grows with the input: joins with it are sort-merge joins.

    Positions and ranks take so little room in a file that Spark would take millions of rows
    for a small table, bring them to the driver and send them to all tasks.
    """
    settled = settle(df, purpose)
    out = settled.hint("merge")
    out._settled_at = settled._settled_at
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt out evenly by a key, however few files or row groups they come from."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


#: Bytes of an Arrow batch where rows are large and as many as fit would fill a worker.
BATCH_BYTES = 8 << 20


def small_bytes(spark: SparkSession) -> None:
    """From now on the session sends about BATCH_BYTES at a time to Python workers, at most."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that its functions can be unpickled."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp()) / f"{root.name}.zip"  # on the driver; Spark sends it to the executors
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(name))
