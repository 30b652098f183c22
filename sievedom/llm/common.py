"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship

#: Rows whose keys may be broadcast: 2 million longs are 16 MB.  Beyond that a join shuffles.
BROADCAST_ROWS = 2_000_000
#: Bytes of one Arrow batch at most (or one row), so that a batch of long documents stays small.
ARROW_BYTES = 4 << 20


def release() -> None:
    """Gives memory that a task no longer uses back to the system; a worker that waits for other tasks keeps none."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over a task's batches, with its memory given back at the end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset and Spark runs in one process (tests), a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sievedom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when each is over, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors; its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievedom-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sievedom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: whatever was made of them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._sievedom_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_arrow_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch for the Python operators, unless the session has a smaller bound, and makes the package known to the executors."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def with_row_id(docs: DataFrame, name: str) -> DataFrame:
    """Adds a row number that is unique and, over files, the same in each pass.

    A row's number is its partition and its place there.  Both are fixed for a
    scan of files; other inputs should be written first (``written``).
    """
    return docs.withColumn(name, F.monotonically_increasing_id())


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it differ from the columns of ``docs`` in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed by place, so that names of an operator's own can't clash, and each one's new name."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def rejoin(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins ``right``, which has one row per key, to ``left``, where a key may be hot.

    The hash of the keys as one more join key makes both sides get an exchange
    of their own even if ``right`` is already dealt by the keys, so that
    adaptive execution can split a hot key's partition on the left.
    """
    mark = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
    a, b = left.withColumn("_jk", mark), right.withColumn("_jk", mark)
    renamed = b.select("_jk", *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = a["_jk"] == renamed["_jk"]
    for k in keys:
        on = on & a[k].eqNullSafe(renamed[f"_r_{k}"])
    out = a.join(renamed, on, how)
    return out.drop(a["_jk"]).drop(renamed["_jk"]).drop(*[f"_r_{k}" for k in keys])


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, but for those numbered (``with_row_id``) in ``gone``'s row_id."""
    name = unused(docs, "_row_id")
    ids = written(gone.select(F.col("row_id").alias(name)))
    return only_rows(with_row_id(docs, name), ids, name, keep=False).select(*[F.col(f"`{c}`") for c in docs.columns])


def only_rows(docs: DataFrame, ids: DataFrame, name: str, keep: bool) -> DataFrame:
    """The rows of ``docs`` whose ``name`` is among ``ids`` (``keep``) or is not.

    ``ids`` is counted: up to BROADCAST_ROWS it is broadcast, beyond that the join shuffles.
    """
    how = "left_semi" if keep else "left_anti"
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge"), name, how)
