"""A store of notices that knows which it has, however late one comes.

Rows lie in ``buckets`` folders by a hash of their key (chat, date, time, text). A batch is combined to one row a key, and
reads the buckets of its own keys only; its rows and the bucket's meet by bucket and key. Bloom filters on the
key's hash, in the files themselves, let Spark skip what a small batch cannot hit. Only what the store lacks is appended, so a
batch that comes again, from whatever stream, adds nothing, and one that was interrupted adds what is missing. There is no
streaming state and no watermark: a first-time notice gets in at any age, a repeat never. One stream at a time writes to a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltbook.operators.notices import clean, dedup_notices, notice_key

#: Keys of a batch that are looked up by value, beyond their buckets.
FEW = 200


def keyed(notices: DataFrame, buckets: int) -> DataFrame:
    h = F.xxhash64(F.coalesce("chat_key", F.lit("")), F.col("chat_key").isNull(), notice_key())
    return notices.withColumn("key_hash", h).withColumn("bucket", F.pmod(F.col("key_hash"), F.lit(buckets)).cast("int"))


def read_store(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The stored notices with bucket and key_hash; None before the first batch."""
    try:
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def new_notices(store: DataFrame | None, incoming: DataFrame, buckets: int) -> DataFrame:
    """The first of each key of ``incoming`` that the store lacks, with bucket and key_hash (S14). Blank texts go."""
    batch = keyed(dedup_notices(clean(incoming)), buckets)
    if store is None:
        return batch
    hit = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most ``buckets``
    there = store.where(F.col("bucket").isin(hit))
    few = [r.key_hash for r in batch.select("key_hash").limit(FEW + 1).collect()]
    if len(few) <= FEW:
        there = there.where(F.col("key_hash").isin(few))
    there = there.select("bucket", "key_hash", F.col("chat_key").alias("__chat"), notice_key().alias("__key"))
    same = F.col("chat_key").eqNullSafe(F.col("__chat")) & (notice_key() == F.col("__key"))
    return batch.alias("b").join(there.alias("s"), (F.col("b.bucket") == F.col("s.bucket")) & (F.col("b.key_hash") == F.col("s.key_hash")) & same, "left_anti")


def store_sink(path: str, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """foreachBatch: append what the store lacks. ``buckets`` is fixed for a store's life."""

    def append(batch: DataFrame, _: int) -> None:
        schema = keyed(batch, buckets).schema
        new = new_notices(read_store(batch.sparkSession, path, schema), batch, buckets).select(*schema.names)
        written(new.repartition("bucket"), path)

    return append


def written(rows: DataFrame, path: str) -> None:
    rows.write.option("parquet.bloom.filter.enabled#key_hash", "true").mode("append").partitionBy("bucket").parquet(path)


def compact_store(spark: SparkSession, path: str, to: str) -> None:
    """The same store with one file (or few) a bucket; streams go on at ``to``."""
    written(read_store(spark, path).repartition("bucket").sortWithinPartitions("bucket", "key_hash"), to)
