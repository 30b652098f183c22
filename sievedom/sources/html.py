"""Sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import decode_bytes
from ..plans.ship import ship

#: Bytes of a file that the command line's limit lets through.
MAX_FILE = 10 * 1024 * 1024


def read_html(spark: SparkSession, path: str, encoding: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Whole files as rows: path, html, error.

    Bytes are read by byte order mark, by ``encoding``, by a meta element, else
    as UTF-8.  Files are read whole, whatever their size; with ``max_bytes`` a
    longer one has a null html and says so in error.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    long = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    html = decode_bytes(F.when(~long, F.col("content")), encoding)
    return files.select("path", html.alias("html"), F.when(long, F.format_string("%d bytes, over the limit", "length")).alias("error"))


def write_html(df: DataFrame, path: str, id_col: str, column: str = "html") -> None:
    """Documents as JSON lines of id and html, so that line feeds stay as they are."""
    df.select(F.col(id_col).alias("id"), F.col(column).alias("html")).write.mode("overwrite").json(path)


#: What one task gets on average at most: rows, bytes of text, and signs "<", which are about as many rows of nodes.
TASK_ROWS, TASK_BYTES, TASK_MARKS = 5_000, 4 << 20, 50_000
#: Rows and bytes of one Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _lower(spark: SparkSession, key: str, most: int, least: int = 1) -> None:
    """Sets a size or number of the session to ``most`` where it is larger, or under ``least``, as 0 for no limit."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)b?", spark.conf.get(key).strip().lower()).groups()
    if not least <= int(number) * _UNITS[unit] <= most:
        spark.conf.set(key, str(most))


def spread(df: DataFrame) -> DataFrame:
    """Deals rows anew unless there are as many partitions as their size asks for, and at least one for each core.

    One small job counts rows, bytes and signs "<" of the text columns.  More
    rows give more tasks, not longer ones; for what is made of them later, the
    session's number of shuffle partitions is raised and its Arrow batches are
    bounded likewise.  Rows are dealt by a hash, since dealing in turn would
    sort each task's input first.
    """
    spark = df.sparkSession
    texts = [F.col(f"`{c}`") for c, kind in df.dtypes if kind == "string"]
    total = lambda f: F.coalesce(F.sum(sum((F.coalesce(f(c), F.lit(0)).cast("long") for c in texts), F.lit(0))), F.lit(0))
    rows, size, marks = df.agg(F.count("*"), total(F.octet_length), total(lambda c: F.length(c) - F.length(F.replace(c, F.lit("<"), F.lit(""))))).first()
    least = spark.sparkContext.defaultParallelism
    n = max(least, -(-rows // TASK_ROWS), -(-size // TASK_BYTES))
    later = max(n, -(-marks // TASK_MARKS))
    if later > least:
        if int(spark.conf.get("spark.sql.shuffle.partitions")) < later:
            spark.conf.set("spark.sql.shuffle.partitions", str(later))
        _lower(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", 1 << 20)
    _lower(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    _lower(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.repartition(n, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])) if df.rdd.getNumPartitions() < n else df
