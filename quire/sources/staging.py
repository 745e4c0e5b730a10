"""Tables written once in the shared folder, so that what made them runs once, rows keep their numbers and lineage ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Written tables by path, with the owner each was written for.
_written: dict[str, str | None] = {}
_owners: list[str | None] = [None]
_at_end: list = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a folder of our own only where it is unset on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows of an Arrow batch: whole texts and pages cross to Python a few megabytes at a time.
BATCH_ROWS = "300"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS unless somebody has set them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def claimed(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files that go with release() or at the end of the driver's process."""
    if not _at_end:
        _at_end.append(atexit.register(_clear, spark))
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    _written[path] = _owners[-1]
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own, which outlives lost executors; it goes with discard(), release() or at the end of the driver's process."""
    spark, path = df.sparkSession, claimed(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """What is written meanwhile belongs to the owner, whose release() it waits for."""
    _owners.append(owner)
    try:
        yield
    finally:
        _owners.pop()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    del _written[path]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.staged_at)


def release(spark: SparkSession, owner: str | None = None) -> None:
    """Deletes an owner's tables, or without one all: call it once nothing reads them."""
    for path in [p for p, o in _written.items() if owner is None or o == owner]:
        _delete(spark, path)


def _clear(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session's store may be out of reach by now
        release(spark)
