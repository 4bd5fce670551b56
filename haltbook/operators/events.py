"""Normalization of labelled events (E1, E2, E4-E7, E11, A5). ``key`` names what identifies a notice:
by default the day and the notice's number in it."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltbook import defaults as D
from haltbook.functions.timecols import WHITE, blank_to_null, contains_any, strip
from haltbook.operators.alias_index import containing, same
from haltbook.operators.pairing import INFO, START, STOP, TEST

KEY = ("date", "message_index")


def _with_notice(events: DataFrame, notices: DataFrame, key: Sequence[str], **columns: str) -> DataFrame:
    side = notices.select(*(F.col(c).alias(f"__{c}") for c in key), *(strip(F.col(v)).alias(k) for k, v in columns.items()))
    on = [F.col(c) == F.col(f"__{c}") for c in key]
    return events.join(side, on, "left").drop(*(f"__{c}" for c in key))


def drop_future(events: DataFrame, notices: DataFrame, markers=None, today: str = D.TODAY_MARKER, key: Sequence[str] = KEY) -> DataFrame:
    """Without events whose notice speaks of a later day, unless the quote says today."""
    joined = _with_notice(events, notices, key, __text="text")
    future = contains_any(F.lower("__text"), D.FUTURE_MARKERS if markers is None else markers)
    keep = ~F.coalesce(future, F.lit(False)) | F.contains(F.lower(F.coalesce("quote", F.lit(""))), F.lit(today))
    return joined.where(keep).drop("__text")


def fill_times(events: DataFrame, notices: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """A blank time becomes the notice's; a differing notice time is kept as message_time."""
    joined = _with_notice(events.drop("message_time"), notices, key, __time="time")
    own, header = strip(F.col("time")), blank_to_null(F.col("__time"))
    blank = F.coalesce(own.isin("", "--:--"), F.lit(True))
    return joined.withColumns({"message_time": F.when(~blank & (own != header), header), "time": F.when(blank, header).otherwise(own)}).drop("__time")


def drop_test_conflicts(events: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Without starts of a notice that also reports a test run of the attraction."""
    on = [*key, "attraction"]
    tests = events.where(F.col("event_type") == TEST).select(*on).distinct()
    starts = events.where(F.col("event_type") == START).join(tests, on, "left_anti")
    return starts.unionByName(events.where(F.coalesce(F.col("event_type") != START, F.lit(True)))).select(*events.columns)


def rule_starts(events: DataFrame, notices: DataFrame, aliases: DataFrame, markers=None, reach: int = 80, cut: int = 140, key: Sequence[str] = KEY) -> DataFrame:
    """Events with starts that a rule finds: an alias, then a start marker at a word's beginning
    within ``reach`` characters; one for each notice and asset without a start (E5). aliases has
    (name, alias); notices without a marker never meet it."""
    markers = D.START_MARKERS if markers is None else markers
    either = "|".join(re.escape(m) for m in markers)
    marked = notices.select(*key, "time", "text", F.lower("text").alias("__t")).where(contains_any(F.col("__t"), markers))
    escaped = F.regexp_replace(F.col("__a"), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    names = aliases.where(F.length("alias") > 0).select("name", F.lower("alias").alias("__a"))
    met = containing(marked, names, key).join(names, "__a").withColumn("__p", F.concat(F.lit("(?iuUs)"), escaped, F.lit(f".{{0,{reach}}}\\b(?:{either})")))
    hits = marked.alias("n").join(met.alias("m"), same("n", "m", key)).where(F.rlike(F.col("n.__t"), F.col("m.__p"))).select(*(F.col(f"n.{c}") for c in key), "name", "time", "text").distinct()
    have = events.where(F.col("event_type") == START).select(*key, F.col("attraction").alias("name")).distinct()
    new = hits.join(have, [*key, "name"], "left_anti")
    made = new.select(
        *key, strip(F.col("time")).alias("time"), F.col("name").alias("attraction_name"), F.col("name").alias("attraction"), F.lit(START).alias("event_type"),
        F.lit("").alias("reason"), F.left(strip(F.col("text")), F.lit(cut)).alias("quote"),
    )
    return events.unionByName(made, allowMissingColumns=True)


def enrich_stops(events: DataFrame, notices: DataFrame, generic=None, words: int = 3, key: Sequence[str] = KEY) -> DataFrame:
    """A stop's generic quote becomes its notice; the notice is kept as source_text."""
    joined = _with_notice(events.drop("source_text"), notices, key, __text="text")
    quote = strip(F.coalesce("quote", F.lit("")))
    short = F.size(F.split(quote, WHITE)) <= words
    for marker in D.GENERIC_QUOTES if generic is None else generic:
        short = short | F.endswith(F.lower(quote), F.lit(marker))
    source = F.when(F.col("event_type") == STOP, blank_to_null(F.col("__text")))
    return joined.withColumns({"source_text": source, "quote": F.when(source.isNotNull() & ((quote == "") | short), source).otherwise(F.col("quote"))}).drop("__text")


def override_tests(events: DataFrame, markers=None) -> DataFrame:
    """A start or info that speaks of a test run becomes one (E7); to be applied after E4."""
    markers = D.TEST_MARKERS if markers is None else markers
    says = contains_any(F.lower(F.coalesce("quote", F.lit(""))), markers)
    if "source_text" in events.columns:
        says = says | contains_any(F.lower(F.coalesce("source_text", F.lit(""))), markers)
    return events.withColumn("event_type", F.when(F.col("event_type").isin(START, INFO) & says, TEST).otherwise(F.col("event_type")))


def targets_only(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Events of configured assets (A5)."""
    return events.join(assets.select(F.col("name").alias("__n")), F.col("attraction") == F.col("__n"), "left_semi")


def quarantine_reason(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds rejected and quarantine_reason (E11); ``cause`` is the stop's technical cause or NULL."""
    known = assets.select(F.col("name").alias("__n")).distinct()
    stop, info = F.col("event_type") == STOP, F.col("event_type") == INFO
    foreign = stop & F.col("__n").isNull()
    bare = stop & F.coalesce(strip(F.col("cause")) == "", F.lit(True))
    reason = F.when(foreign, F.concat(F.lit("Not target attraction: "), F.coalesce("attraction", F.lit("")))).when(bare, "No technical cause")
    joined = events.join(known, F.col("attraction") == F.col("__n"), "left")
    return joined.withColumns({"quarantine_reason": reason, "rejected": F.coalesce(foreign | bare | info, F.lit(False))}).drop("__n")


def rejects(marked: DataFrame) -> DataFrame:
    return marked.where("rejected")


def accepted(marked: DataFrame) -> DataFrame:
    """The complement, which goes to pairing."""
    return marked.where("not rejected").drop("rejected", "quarantine_reason")


def normalize_events(events: DataFrame, notices: DataFrame, aliases: DataFrame | None = None, key: Sequence[str] = KEY, **options) -> DataFrame:
    """The deterministic steps from raw events to those that are judged and paired: E1, E2, E4, E7, E5
    (with ``aliases``), E6. Options: future, today, tests, starts, quotes (marker lists)."""
    got = drop_future(events, notices, options.get("future"), options.get("today", D.TODAY_MARKER), key)
    got = override_tests(drop_test_conflicts(fill_times(got, notices, key), key), options.get("tests"))
    if aliases is not None:
        got = rule_starts(got, notices, aliases, options.get("starts"), key=key)
    return enrich_stops(got, notices, options.get("quotes"), key=key)


def stored_events(docs: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """The events that day documents hold (S15): raw_events, or events where those are none or empty.
    They go through ``normalize_events`` again."""
    has = F.coalesce(F.size("raw_events") > 0, F.lit(False))
    return docs.select(*keys, F.explode(F.when(has, F.col("raw_events")).otherwise(F.col("events"))).alias("__e")).select(*keys, "__e.*")
