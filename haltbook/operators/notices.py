"""Notice tables: numbering, dates, bodies, dedup, ranges, coverage, transcripts (S2, M5-M11, S14,
A10, C1, C2). A notice has chat_key, pos, date, time, text; days and chats may be of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltbook.functions.timecols import blank_to_null, clock, label_date, squash
from haltbook.operators.scans import carry_last, number_rows


def index_notices(notices: DataFrame, day: Sequence[str] = ("chat_key", "date")) -> DataFrame:
    """message_index: 1-based place in the day, in file order (S2). A day may be of any size."""
    return number_rows(notices, day, "pos", "message_index").withColumn("message_index", F.col("message_index").cast("int"))


def carry_dates(blocks: DataFrame, as_of: Column, chat: str = "chat_key", **labels) -> DataFrame:
    """A block without own date takes the last header's before it; headers go (M5). ``label`` is a
    block's header text or NULL."""
    marked = blocks.withColumn("__header", label_date(F.col("label"), as_of, **labels))
    return carry_last(marked, [chat], "pos", "__header", "carried_date").where("__header is null").drop("__header")


def resolve_date(df: DataFrame, columns: Sequence[str], carried: str = "carried_date") -> DataFrame:
    """message_date: the first non-blank own date, else the carried one (M6)."""
    own = [blank_to_null(squash(F.col(c))) for c in columns]
    return df.withColumn("message_date", F.coalesce(*own, F.date_format(carried, "yyyy-MM-dd")))


def pick_body(df: DataFrame) -> DataFrame:
    """text: the longest part that is neither author nor time, the first of equals; without parts
    the whole text without author in front and time behind. Shorter than two goes (M7). Takes
    parts array<string>, author, time, full_text."""
    author, time = F.coalesce(squash(F.col("author")), F.lit("")), F.coalesce(squash(F.col("time")), F.lit(""))
    parts = F.filter(F.array_distinct(F.transform("parts", squash)), lambda p: (p != "") & (p != author) & (p != time))
    longest = F.aggregate(parts, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    whole = F.coalesce(squash(F.col("full_text")), F.lit(""))
    headless = F.when((author != "") & F.startswith(whole, author), squash(F.substr(whole, F.length(author) + 1))).otherwise(whole)
    tailless = F.when((time != "") & F.endswith(headless, time), squash(F.left(headless, F.length(headless) - F.length(time)))).otherwise(headless)
    text = F.coalesce(F.nullif(longest, F.lit("")), tailless)
    return df.withColumn("text", text).where(F.length("text") >= 2)


def notice_key() -> Column:
    return F.concat_ws("|", F.coalesce(F.col("date").cast("string"), F.lit("")), F.coalesce("time", F.lit("")), F.coalesce("text", F.lit("")))


def dedup_notices(notices: DataFrame, chat: str = "chat_key") -> DataFrame:
    """The first notice of each date, time and text in a chat (M8). The row that stays is an
    aggregate, combined in the tasks before the shuffle, so a notice repeated many times is cheap."""
    row = F.struct(*(F.col(c) for c in notices.columns))
    return notices.groupBy(F.col(chat).alias("__chat"), notice_key().alias("__key")).agg(F.min_by(row, "pos").alias("__row")).select("__row.*")


def in_range(notices: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Notices of an inclusive range of days; undated ones only without bounds (M9)."""
    if start and end and start > end:
        raise ValueError("the range ends before it starts")
    out = notices
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out


def order_notices(notices: DataFrame) -> DataFrame:
    """By date, time, position."""
    return notices.orderBy(F.coalesce(F.col("date").cast("string"), F.lit("")), F.coalesce("time", F.lit("")), "pos")


def coverage(notices: DataFrame, chat: str = "chat_key") -> DataFrame:
    """Dated days, first and last day of each chat."""
    return notices.groupBy(chat).agg(F.countDistinct("date").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def clean(incoming: DataFrame) -> DataFrame:
    text = squash(F.col("text"))
    return incoming.withColumns({"text": text, "time": squash(F.col("time"))}).where(text != "")


def append_notices(store: DataFrame, incoming: DataFrame, chat: str = "chat_key") -> tuple[DataFrame, DataFrame]:
    """(new rows, added and total by chat) of a batch against a store (S14). Blank texts go, keys
    that are stored or come earlier in the batch too; applying a batch twice adds nothing."""
    batch = dedup_notices(clean(incoming), chat).withColumn("__key", notice_key())
    stored = store.select(F.col(chat).alias("__chat"), notice_key().alias("__k"))
    new = batch.join(stored, F.col(chat).eqNullSafe(F.col("__chat")) & (F.col("__key") == F.col("__k")), "left_anti").drop("__key")
    counts = store.select(F.col(chat), F.lit(0).alias("added")).unionByName(new.select(F.col(chat), F.lit(1).alias("added")))
    return new, counts.groupBy(chat).agg(F.sum("added").cast("long").alias("added"), F.count("*").alias("total"))


def select_days(notices: DataFrame, date: str | None = None, month: str | None = None, limit: int | None = None) -> DataFrame:
    """Notices of a date, a month, or the first days (A10); the days are ranked, not the notices."""
    if date:
        return notices.where(F.col("date") == F.lit(date).cast("date"))
    if month:
        first = F.to_date(F.lit(month + "-01"))
        return notices.where((F.col("date") >= first) & (F.col("date") <= F.last_day(first)))
    if not limit:
        raise ValueError("no period given")
    days = notices.where("date is not null").select(F.col("date").alias("__d")).distinct().orderBy("__d").limit(limit)
    return notices.join(days, F.col("date") == F.col("__d"), "left_semi")


def line(numbered: bool) -> Column:
    text, time = F.coalesce("text", F.lit("")), blank_to_null(F.col("time"))
    if numbered:
        return F.trim(F.concat(F.lit("#"), F.col("message_index").cast("string"), F.lit(". "), F.coalesce(time, F.lit("--:--")), F.lit(" "), text))
    return F.trim(F.concat_ws(" ", time, text))


def transcripts(notices: DataFrame, numbered: bool = False, day: Sequence[str] = ("chat_key", "date")) -> DataFrame:
    """One text per day, a line per notice (C1); bounded by a day's traffic of one chat."""
    lines = index_notices(notices, day).select(*day, F.struct("message_index", line(numbered).alias("line")).alias("x"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n")
    return lines.groupBy(*day).agg(joined.alias("transcript"))


def chunk(notices: DataFrame, size: int = 12, day: Sequence[str] = ("chat_key", "date")) -> DataFrame:
    """Fixed-size runs of a day's notices with first and last index and their text."""
    size = max(1, size)
    indexed = index_notices(notices, day).withColumn("chunk", F.floor((F.col("message_index") - 1) / size).cast("int"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n")
    rows = indexed.withColumn("x", F.struct("message_index", line(True).alias("line")))
    return rows.groupBy(*day, "chunk").agg(F.min("message_index").alias("first_index"), F.max("message_index").alias("last_index"), joined.alias("transcript"))


def dated(blocks: DataFrame, as_of: Column, own: Sequence[str], **labels) -> DataFrame:
    """Blocks to notices: carried and own dates, clocks, bodies (M3, M5-M7)."""
    found = resolve_date(carry_dates(blocks, as_of, **labels), own)
    return pick_body(found.withColumn("time", clock(F.col("time_raw"))))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
