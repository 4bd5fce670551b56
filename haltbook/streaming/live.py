"""Live notices with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltbook.functions.timecols import instant
from haltbook.operators.notices import notice_key
from haltbook.operators.pairing import pair_incidents
from haltbook.sources.manifest import commit

NOTICE = "chat_key string, pos long, date date, time string, text string"


def stream_notices(spark: SparkSession, folder: str, schema: str = NOTICE, late: str = "30 days", per_batch: int = 64) -> DataFrame:
    """A feed of notice files without repeats of a key within ``late``, for consumers that need rows at once (X1). Its
    watermark drops what is more than ``late`` behind the newest notice; ``notice_store.store_sink`` takes the same files
    without that bound: there every first-time notice gets in."""
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)
    keyed = feed.withColumns({"at": instant(F.col("date").cast("string"), F.col("time")), "notice_key": F.concat_ws("|", "chat_key", notice_key())})
    return keyed.withWatermark("at", late).dropDuplicatesWithinWatermark(["notice_key"]).drop("at", "notice_key")


def refresh_days(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Incidents of the days that a batch touches, from the whole store (X3); to be committed with
    ``manifest.commit``. The store is read between the batch's first and last day."""
    days = batch.select(F.col("date").alias("__d")).distinct()
    first, last = batch.agg(F.min("date"), F.max("date")).first()
    near = store.where(F.col("date").between(F.lit(first), F.lit(last)))
    return pair_incidents(near.join(days, F.col("date") == F.col("__d"), "left_semi"))


def refresh_sink(store: Callable[[], DataFrame], root: str, columns: list[str], stream: str | None = None, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """foreachBatch: pair the days that a batch touches again and replace them in the stop log (X3). A batch rewrites the
    months of its days. With ``stream``, a name that belongs to the stream's checkpoint, a batch that comes again finds its
    version committed; without, it gives the same rows once more."""

    def refresh(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            commit(refresh_days(batch, store()).select(*columns), root, batch.select("date").distinct(), stream, number, keep)

    return refresh
