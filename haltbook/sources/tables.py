"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haltbook import defaults as D
from haltbook.functions.timecols import as_date, blank_to_null, parse_clock, strip
from haltbook.operators.assets import normalize_asset
from haltbook.operators.notices import in_range, order_notices
from haltbook.operators.scans import number_rows

EXPORT = "exportedAt string, sourceUrl string, count int, messages array<struct<text:string, messageDate:string, time:string>>"

#: Ends a document where files hold many; JSON escapes it in texts.
RECORD_END = "\x1e"


def read_chat_export(spark: SparkSession, paths, multi_line: bool = True, separator: str | None = None) -> DataFrame:
    """(chat_key, pos, raw_date, date, time, text) of export documents, one a file or (without ``multi_line``) one a
    line; undated notices go, file order is kept (S1). With a ``separator``, a character that JSON escapes in texts, documents of
    any number of lines end with it: files then hold many, and Spark splits them."""
    reader = spark.read.schema(EXPORT)
    docs = (reader.option("lineSep", separator) if separator else reader.option("multiLine", multi_line)).json(paths)
    each = docs.select(F.col("sourceUrl").alias("chat_key"), F.posexplode("messages").alias("pos", "m"))
    raw = strip(F.col("m.messageDate"))
    found = each.select("chat_key", F.col("pos").cast("long").alias("pos"), raw.alias("raw_date"), as_date(F.left(raw, F.lit(10))).alias("date"), strip(F.col("m.time")).alias("time"), strip(F.col("m.text")).alias("text"))
    return found.where(F.coalesce("raw_date", F.lit("")) != "")


def read_stop_log(spark: SparkSession, path: str, month: str | None = None, year: int | None = None) -> DataFrame:
    """Dated rows of a month (S3) or year (S4); only the partitions of its months are read."""
    df = spark.read.parquet(path).where("date is not null")
    if month:
        df = df.where(F.col("month") == month)
    elif year:
        df = df.where(F.col("month").between(f"{year}-01", f"{year}-12"))
    return df.drop("month")


def write_stop_log(df: DataFrame, path: str) -> None:
    """Full replacement (S7), partitioned by month: days are too small for partitions of their own.
    Rows are rebalanced by month, so that a month has few files and a large one is split."""
    dated = df.withColumn("month", F.date_format("date", "yyyy-MM"))
    dated.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)


def write_quarantine(df: DataFrame, path: str) -> bool:
    """Full replacement if there are rejects (S8); date_time from date and time, the raw text where
    they are no instant."""
    if df.isEmpty():
        return False
    joined = F.concat_ws(" ", F.col("date").cast("string"), blank_to_null(F.col("time")))
    df.withColumns({"date_time": F.try_to_timestamp(joined, F.lit("yyyy-MM-dd HH:mm")), "date_time_text": joined}).write.mode("overwrite").parquet(path)
    return True


def day_docs(
    notices: DataFrame,
    events: DataFrame,
    rows: DataFrame,
    raw_events: DataFrame | None = None,
    quarantine: DataFrame | None = None,
    keys: Sequence[str] = ("date",),
    runs: DataFrame | None = None,
) -> DataFrame:
    """One document per date (or finer ``keys``): notices, events, rows and, where given, raw events and
    rejected events as sorted arrays, and their counts (S9). ``runs`` (keys, then model, prompt, raw_model or what else
    tells how the events were made) is kept with the document. Days that are too large for a row: ``fragments``."""

    def packed(df: DataFrame, order: str, name: str) -> DataFrame:
        own = F.struct(order, *(c for c in df.columns if c not in (*keys, order)))
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(own)).alias(name))

    parts = [(notices, "pos", "messages"), (events, "event_seq", "events"), (rows, "incident", "rows"), (raw_events, "event_seq", "raw_events"), (quarantine, "event_seq", "quarantine")]
    given = [packed(*p) for p in parts if p[0] is not None]
    out = reduce(lambda a, b: a.join(b, list(keys), "full"), given)
    count = {f"n_{p[2]}": F.greatest(F.coalesce(F.size(p[2]), F.lit(0)), F.lit(0)) for p in parts if p[0] is not None}
    if runs is not None:
        out = out.join(runs, list(keys), "left")
    return out.withColumns(count)


def fragments(parts: dict[str, tuple[DataFrame, str]], keys: Sequence[str] = ("date",), size: int = 1000) -> DataFrame:
    """The documents of ``keys`` in pieces of at most ``size`` entries (S9, S10, S11): (keys, part, piece, first, last, entries), where part is a name
    of ``parts``, which gives each its rows and the number that orders them, and entries is a JSON list. Read in the order of part
    and piece they are the document, however large it is."""
    out = []
    for name, (df, order) in parts.items():
        own = F.struct(F.col(order).cast("long").alias("at"), F.to_json(F.struct(*(c for c in df.columns if c not in keys))).alias("entry"))
        piece = F.floor((F.col("__n") - 1) / size).cast("int").alias("piece")
        numbered = number_rows(df, keys, order, "__n").select(*keys, F.lit(name).alias("part"), piece, own.alias("x"))
        texts = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["entry"])
        found = numbered.groupBy(*keys, "part", "piece").agg(F.min("x.at").alias("first"), F.max("x.at").alias("last"), F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("entries"))
        out.append(found)
    return reduce(DataFrame.unionByName, out)


def write_day_docs(docs: DataFrame, path: str) -> None:
    docs.repartition("date").write.mode("overwrite").partitionBy("date").json(path)


def month_doc(docs: DataFrame) -> DataFrame:
    """One document per month with its days and all their rows (S10); offered for parity, the flat
    tables are the normal form."""

    def joined(name: str) -> Column:
        none = F.expr("array()").cast(docs.schema[name].dataType)
        return F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("date", name))), lambda x: F.coalesce(x[name], none))).alias(name)

    lists = [c for c in ("rows", "quarantine") if c in docs.columns]
    counts = [c for c in docs.columns if c.startswith("n_")]
    return docs.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.sort_array(F.collect_list("date")).alias("dates"), *map(joined, lists), *(F.sum(c).cast("long").alias(c) for c in counts))


def month_rows(docs: DataFrame, name: str = "rows") -> DataFrame:
    """The rows (or rejected events) of all days as a flat table with its month, for months that are too
    large for one document."""
    return docs.select(F.date_format("date", "yyyy-MM").alias("month"), "date", F.explode(name).alias("__x")).select("month", "date", "__x.*")


def export_chat(notices: DataFrame, chat_key: str, start: str | None = None, end: str | None = None, exported_at: str = "") -> DataFrame:
    """The export document of one chat and range, as one JSON text."""
    chosen = in_range(notices.where(F.col("chat_key") == chat_key), start, end)
    day, time = F.coalesce(F.col("date").cast("string"), F.lit("")), F.coalesce("time", F.lit(""))
    rows = chosen.select(F.struct(day.alias("d"), time.alias("t"), "pos", F.struct("text", day.alias("messageDate"), time.alias("time")).alias("m")).alias("x"))
    messages = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["m"])
    doc = rows.agg(F.count("*").cast("int").alias("count"), messages.alias("messages"))
    return doc.select(F.to_json(F.struct(F.lit(exported_at).alias("exportedAt"), F.lit(chat_key).alias("sourceUrl"), "count", "messages")).alias("value"))


def export_line() -> Column:
    header = F.concat_ws(" ", blank_to_null(F.col("date").cast("string")), blank_to_null(F.col("time")))
    return F.concat(F.when(header != "", F.concat(F.lit("["), header, F.lit("] "))).otherwise(""), F.coalesce("text", F.lit("")))


def text_export(notices: DataFrame, prompt: str | None = None, header: bool = False) -> DataFrame:
    """One line per notice, in order (S12). With ``header`` or a prompt the header's lines come first;
    without any notice, a line that says so stands in their place."""
    if prompt is None and not header:
        return order_notices(notices).select(export_line().alias("value"))
    spark, head = notices.sparkSession, text_header(prompt)
    if notices.isEmpty():
        return spark.createDataFrame([(x,) for x in [*head[:-1], D.EMPTY_RANGE]], "value string")
    before = spark.createDataFrame([(k, x) for k, x in enumerate(head)], "__at long, value string")
    first = [F.coalesce(F.col("date").cast("string"), F.lit("")).alias("__d"), F.coalesce("time", F.lit("")).alias("__t"), F.col("pos").alias("__p")]
    lines = notices.select(F.lit(len(head)).cast("long").alias("__at"), export_line().alias("value"), *first)
    return before.unionByName(lines, allowMissingColumns=True).orderBy("__at", "__d", "__t", "__p").select("value")


def text_header(prompt: str | None = None) -> list[str]:
    """The lines before an export's notices."""
    head = ["# === PROMPT ===", prompt, ""] if prompt else []
    return [*head, "# === MESSAGES ==="]


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def day_text_report(df: DataFrame) -> DataFrame:
    """(date, value): each day's text below its heading, by date (S13). Takes date, report."""
    head = F.concat(F.lit("===== "), F.col("date").cast("string"), F.lit(" =====\n"))
    return df.select("date", F.concat(head, strip(F.col("report")), F.lit("\n")).alias("value")).orderBy("date")


def pending_days(notices: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Notices of days without a stored event document (S15); stored events of the other days go
    through the deterministic steps again."""
    if force:
        return notices
    return notices.join(done.select(F.col("date").alias("__d")).distinct(), F.col("date") == F.col("__d"), "left_anti")


def write_rows(df: DataFrame, path: str) -> None:
    """Flat rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def keep_rows(df: DataFrame, none: str) -> DataFrame:
    """Rows that report something (R1): no "worked without stops", and any of five fields."""
    fields = ["reason", "note", "downtime", "stop_time", "start_time"]
    said = F.lower(F.concat_ws(" ", *(F.coalesce(strip(F.col(c)), F.lit("")) for c in fields[:3])))
    some = F.concat(*(F.coalesce(strip(F.col(c)), F.lit("")) for c in fields)) != ""
    return df.where(~F.contains(said, F.lit(none)) & some)


def prepare_rows(df: DataFrame, assets: DataFrame, none: str, unknown: int = 999) -> DataFrame:
    """Typed rows in the stop log's order (R2): date, asset order, stop time (missing 00:00)."""
    kept = normalize_asset(keep_rows(df, none), "attraction_name", assets, guard_blank=False)
    order = assets.select(F.col("name").alias("__n"), F.col("ord").alias("__o"))
    typed = kept.join(order, F.col("attraction") == F.col("__n"), "left").withColumns(
        {
            "date": as_date(F.left(strip(F.col("date").cast("string")), F.lit(10))),
            "stop_min": parse_clock(F.col("stop_time")),
            "start_min": parse_clock(F.col("start_time")),
            "asset_order": F.coalesce("__o", F.lit(unknown)),
            **{c: F.coalesce(strip(F.col(c)), F.lit("")) for c in ("downtime", "reason", "note")},
        }
    )
    return typed.drop("__n", "__o").orderBy("date", "asset_order", F.coalesce("stop_min", F.lit(0)))

