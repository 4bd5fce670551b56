"""Stops and starts into incidents, by windows only.

A day's general starts divide it into epochs; inside (day, attraction, epoch) a stop begins a new
incident unless the last relevant event before it is a stop. An epoch's general start closes the last
incident of each attraction that is still open. No state machine, no loop over days: the day is in
every key, so many days and chats are one plan. ``day`` names the columns that keep days apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltbook import defaults as D
from haltbook.functions.timecols import strip
from haltbook.operators.alias_index import same
from haltbook.operators.scans import ranged_count

STOP, START, TEST, GENERAL, INFO = "STOP_UNPLANNED", "START", "TEST_RUN", "START_GENERAL", "INFO"


def order_key() -> Column:
    """Message index, then minute (unreadable last), then arrival."""
    index = F.coalesce(F.col("message_index").try_cast("int"), F.lit(0))
    minute = F.coalesce(F.floor(F.col("time_s") / 60).cast("int"), F.lit(10_000))
    return F.struct(index.alias("index"), minute.alias("minute"), F.col("event_seq").alias("seq"))


def with_order(events: DataFrame) -> DataFrame:
    return events.withColumn("ord", order_key())


def with_epochs(events: DataFrame, day: Sequence[str], few: int) -> tuple[DataFrame, DataFrame]:
    """(events of incidents, general starts), each with the number of its day's general starts before it."""
    keyed = with_order(events)
    wanted = F.col("event_type").isin(STOP, START, TEST)
    general = keyed.where(F.col("event_type") == GENERAL)
    if general.limit(few + 1).count() > few:
        counted = ranged_count(keyed.where(wanted | (F.col("event_type") == GENERAL)), day, "ord", F.col("event_type") == GENERAL, "epoch")
        return counted.where(wanted), counted.where(F.col("event_type") == GENERAL)
    closers = general.withColumn("epoch", F.row_number().over(Window.partitionBy(*day).orderBy("ord")) - 1)
    marks = general.groupBy(*day).agg(F.collect_list("ord").alias("__marks"))
    own = keyed.where(wanted).alias("e").join(F.broadcast(marks).alias("m"), same("e", "m", day), "left").select("e.*", "m.__marks")
    before = F.size(F.filter("__marks", lambda x: x < F.col("ord")))
    return own.withColumn("epoch", F.when(F.col("__marks").isNull(), 0).otherwise(before)).drop("__marks"), closers


def with_islands(events: DataFrame, day: Sequence[str] = ("date",), few: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(events of incidents with epoch and island, general starts by epoch). Up to ``few`` general starts are broadcast; more are
    counted by a scan in ranges of the order. Either way no task holds all events of a day."""
    own, closers = with_epochs(events, day, few)
    by_asset = Window.partitionBy(*day, "attraction", "epoch").orderBy("ord")
    untimed = (F.col("event_type") == TEST) & F.col("time_s").isNull()
    before = F.last(F.when(~untimed, F.col("event_type")), ignorenulls=True).over(by_asset.rowsBetween(Window.unboundedPreceding, -1))
    opens = ((F.col("event_type") == STOP) & F.coalesce(before != STOP, F.lit(True))).cast("int")
    islands = own.withColumn("opens", opens).withColumn("island", F.sum("opens").over(by_asset.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.where("island > 0").drop("opens"), closers


def pair_incidents(events: DataFrame, day: Sequence[str] = ("date",), extra: Sequence[str] = (), stops: Column | None = None, few: int = 5000) -> DataFrame:
    """One row per incident (P1, P2): ``day``, attraction, incident, stop_s, start_s, n_stops,
    closed_by, and stop_/start_/test_ structs with the ``extra`` columns of the deciding events.
    With ``stops``, this value of all its stops as a sorted array."""
    islands, closers = with_islands(events, day, few)
    picked = F.struct(F.col("ord"), F.col("time_s"), *(F.col(c) for c in extra))
    kind, timed = F.col("event_type"), F.col("time_s").isNotNull()
    grouped = islands.groupBy(*day, "attraction", "epoch", "island").agg(
        F.min(F.when(kind == STOP, picked)).alias("stop"),
        F.min(F.when(kind == START, picked)).alias("start"),
        F.min(F.when((kind == TEST) & timed, picked)).alias("test"),
        F.max(F.when((kind == TEST) & ~timed, picked)).alias("untimed"),
        F.count_if(kind == STOP).alias("n_stops"),
        *([F.sort_array(F.collect_list(F.when(kind == STOP, stops))).alias("stops")] if stops is not None else []),
    )
    last = F.max("island").over(Window.partitionBy(*day, "attraction", "epoch")) == F.col("island")
    closing = closers.select(*(F.col(c).alias(f"g_{c}") for c in day), F.col("epoch").alias("g_epoch"), picked.alias("general"))
    same_day = F.col("epoch") == F.col("g_epoch")
    for c in day:
        same_day = same_day & (F.col(c) == F.col(f"g_{c}"))
    joined = grouped.withColumn("last", last).join(closing, same_day, "left")
    general = F.when(F.col("last"), F.col("general"))
    closer = F.coalesce("start", general, "test")
    how = F.when(F.col("start").isNotNull(), START).when(general.isNotNull(), GENERAL).when(F.col("test").isNotNull(), TEST)
    order = Window.partitionBy(*day, "attraction").orderBy("epoch", "island")
    return joined.select(
        *day,
        "attraction",
        F.row_number().over(order).cast("long").alias("incident"),
        F.col("stop.time_s").alias("stop_s"),
        closer["time_s"].alias("start_s"),
        F.col("n_stops").cast("long").alias("n_stops"),
        how.alias("closed_by"),
        "epoch", "island", "stop", closer.alias("closer"), F.when(closer.isNull(), F.col("untimed")).alias("tried"),
        *(["stops"] if stops is not None else []),
    )


def closing_of_general(incidents: DataFrame) -> DataFrame:
    """The incidents that a general start closed."""
    return incidents.where(F.col("closed_by") == GENERAL)


def run_days(events: DataFrame, day: Sequence[str] = ("date",), since=None, until=None) -> DataFrame:
    """Incidents of all days of a range (P5); the day is a key, so nothing is looped."""
    chosen = events
    if since is not None:
        chosen = chosen.where(F.col(day[-1]) >= F.lit(since))
    if until is not None:
        chosen = chosen.where(F.col(day[-1]) <= F.lit(until))
    return pair_incidents(chosen, day)


def _append(acc: Column, text: Column) -> Column:
    return F.when(acc == "", text).otherwise(F.concat(acc, F.lit("; "), text))


def incident_detail(events: DataFrame, day: Sequence[str] = ("date",), test_prefix: str = D.TEST_PREFIX) -> DataFrame:
    """Folded reasons, notes, sources and evidence, and the closing event's part."""
    extra = ("message_index", "event_seq", "quote")
    text = strip(F.coalesce("quote", F.lit("")))
    stop = F.struct("ord", "message_index", "event_seq", text.alias("quote"), F.coalesce("reason", F.lit("")).alias("reason"))
    incidents = pair_incidents(events, day, extra, stop).withColumnRenamed("stops", "s")
    closer = F.coalesce("closer", "tried")
    shown = strip(F.coalesce(closer["quote"], F.lit("")))
    by_test = closer.isNotNull() & (F.coalesce("closed_by", F.lit(TEST)) == TEST)
    quotes = F.filter(F.transform("s", lambda x: x["quote"]), lambda q: q != "")
    reasons = F.aggregate("s", F.lit(""), lambda a, x: F.when((x["reason"] == "") | F.contains(a, x["reason"]), a).otherwise(_append(a, x["reason"])))
    refs = F.array_distinct(F.transform("s", lambda x: F.concat(F.lit("#"), x["message_index"].cast("string"))))
    closing_ref = F.when(closer.isNotNull() & ~by_test, F.array(F.concat(F.lit("#"), closer["message_index"].cast("string")))).otherwise(F.array().cast("array<string>"))
    closing_quote = F.when(closer.isNotNull() & ~by_test & (shown != ""), F.array(shown)).otherwise(F.array().cast("array<string>"))
    return incidents.select(
        *day, "attraction", "incident", "stop_s", "start_s", "closed_by",
        reasons.alias("reason"),
        F.array_join(quotes, "; ").alias("note"),
        F.when(by_test, F.concat(F.lit(test_prefix), shown)).otherwise(shown).alias("start_quote"),
        F.array_distinct(F.concat(refs, closing_ref)).alias("source"),
        F.array_distinct(F.concat(quotes, closing_quote)).alias("evidence"),
        F.element_at("s", 1).alias("stop_event"),
        F.slice("s", 2, F.size("s")).alias("update_events"),
        closer.alias("start_event"),
    )
