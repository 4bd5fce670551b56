"""What the operators share: reading tables, shared-folder tables, bounded caches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Characters outside A-Z that ``lower`` may change (unassigned ones: it may know newer characters).
OTHER_CAPITALS = r"[\x{80}-\x{10FFFF}&&[\p{IsUppercase}\p{IsTitlecase}\p{Cn}]]"  # the range is looked at first: most characters are ASCII


def lower_ascii(col):
    """Lower-case A-Z only. ``lower`` is several times as fast as ``translate`` and does the same where
    a text has no other capitals."""
    return F.when(col.rlike(OTHER_CAPITALS), F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(col))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset
    in a session on one machine, as in tests, a temporary folder is set."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(got)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(got)
    return got


_open: list[list[str]] = []  # the tables of each ``intermediate`` block that is being run


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside the block go at its end. What is to be kept has to be written
    before that, outside the block's own tables (``keep``)."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, keep: bool = False, by: str | None = None, options: dict | None = None) -> DataFrame:
    """Cut the lineage with a written table in the shared folder: a lost executor costs no
    recomputation of what lies before it, and every later read sees the same rows. ``by`` names a
    column whose values get folders of their own, ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open and not keep:
        _open[-1].append(path)
    out = df.write.option("compression", "zstd").options(**(options or {}))
    # Shuffle files go with the query that made them, not when the driver happens to collect its garbage.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def few_rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside the block reads Parquet and sends Arrow batches of at most ``rows`` rows: for rows that are large,
    whose usual batches (4,096 and 10,000 rows) would hold a whole split in the executor and once more in Python."""
    keys = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, min(rows, int(before[k])))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """To be broadcast if it is counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Keys that are broadcast in a skewed join, at most.
WIDE = 100_000


def wide_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left join right, whose ``keys`` are unique. Keys of more than a ``WIDE``-th of the left rows, of which there are
    at most ``WIDE``, are broadcast; no other key has more rows than that. Neither side may have columns __wide or __n."""
    counts = stored(left.groupBy(*keys).agg(F.count("*").alias("__n")), "counts")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    wide = counts.where(F.col("__n") > max(1000, total / WIDE)).select(*keys)
    marked = left.join(F.broadcast(wide.withColumn("__wide", F.lit(True))), keys, "left")
    few = F.broadcast(right.join(F.broadcast(wide), keys, "left_semi"))
    of_wide = marked.where("__wide").drop("__wide").join(few, keys, how)
    others = marked.where("__wide is null").drop("__wide").join(right, keys, how)
    return of_wide.unionByName(others)


class Generations:
    """Bounded map of two generations: when the young one is full it becomes the old one, so
    what is in use stays and memory holds at most 2 * size entries."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: Iterable) -> list:
        """The keys that have no value yet; values of the old generation move up."""
        young, old, out = self.young, self.old, []
        for k in set(keys).difference(young):
            if k in old:
                young[k] = old[k]
            else:
                out.append(k)
        return out

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


def single_threaded() -> None:
    """Spark's tasks are the parallelism; libraries inside them run one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
