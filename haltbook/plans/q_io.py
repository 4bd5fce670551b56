"""Queries of sources, sinks, extraction, repair and streams (S1, S3, S4, S6-S13, S15-S17, C3, C5-C7,
U1, T1-T4, R1-R7, X1-X3). What is written goes to fresh folders below the shared one."""

from __future__ import annotations

from pyspark.sql import functions as F

from haltbook import defaults as D
from haltbook.functions import repair as r
from haltbook.functions import timecols as t
from haltbook.operators import model_io as m
from haltbook.operators.notices import chunk
from haltbook.operators.pairing import incident_detail
from haltbook.plans.q_pairing import COLUMNS, PAIRS
from haltbook.plans.register import collector
from haltbook.plans.views import LOG, NOTICES, SIGNALS, assets, log, notices, signals, table
from haltbook.sources import manifest
from haltbook.sources import tables as io
from haltbook.sources.scratch import scratch
from haltbook.streaming import live
from haltbook.streaming.notice_store import read_store, store_sink

QUERIES, ORACLES, query = collector()

# --- stop log ---------------------------------------------------------------------------------


def log_path(spark, sf_dir):
    path = scratch(spark, "stop_log")
    io.write_stop_log(log(spark, sf_dir), path)
    return path


@query("s7_write_log", f"with {LOG} select date, seq, attraction, stop_s, start_s from log")
def s7_write_log(spark, sf_dir):
    return io.read_stop_log(spark, log_path(spark, sf_dir)).select("date", "seq", "attraction", "stop_s", "start_s")


@query("s3_read_month", f"with {LOG} select date, seq, attraction from log where strftime(date, '%Y-%m') = '1997-02'")
def s3_read_month(spark, sf_dir):
    return io.read_stop_log(spark, log_path(spark, sf_dir), month="1997-02").select("date", "seq", "attraction")


@query("s4_read_year", f"with {LOG} select date, seq, attraction from log where year(date) = 1996")
def s4_read_year(spark, sf_dir):
    return io.read_stop_log(spark, log_path(spark, sf_dir), year=1996).select("date", "seq", "attraction")


@query("s6_replace", f"with {LOG} select date, seq, attraction from log where month(date) <> 5 or day(date) % 2 = 0")
def s6_replace(spark, sf_dir):
    """The days of May are replaced; odd ones have no rows any more."""
    rows = log(spark, sf_dir).where("month(date) = 5")
    root = scratch(spark, "log")
    manifest.commit(log(spark, sf_dir), root)
    manifest.commit(rows.where("day(date) % 2 = 0"), root, rows.select("date").distinct())
    return manifest.read_log(spark, root).select("date", "seq", "attraction")


@query("s8_quarantine", f"with {SIGNALS} select event_seq, case when time_s is null then null else strftime(date, '%Y-%m-%d') || ' ' || lpad((time_s // 3600)::varchar, 2, '0') || ':' || lpad((time_s // 60 % 60)::varchar, 2, '0') end as at from signals where event_type = 'INFO' or event_seq % 10 = 0 and event_type = 'TEST_RUN'")
def s8_quarantine(spark, sf_dir):
    rows = signals(spark, sf_dir).where("event_type = 'INFO' or event_seq % 10 = 0 and event_type = 'TEST_RUN'")
    time = F.concat_ws(":", F.lpad(F.floor(F.col("time_s") / 3600).cast("string"), 2, "0"), F.lpad((F.floor(F.col("time_s") / 60) % 60).cast("string"), 2, "0"))
    path = scratch(spark, "quarantine")
    io.write_quarantine(rows.withColumn("time", F.when(F.col("time_s").isNull(), "").otherwise(time)), path)
    return spark.read.parquet(path).select("event_seq", F.date_format("date_time", "yyyy-MM-dd HH:mm").alias("at"))


# --- documents --------------------------------------------------------------------------------


def documents(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int"))
    c = table(spark, sf_dir, "conversations").select(day.alias("date"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), "text")
    s = signals(spark, sf_dir)
    rows = incident_detail(s).select("date", "incident", "attraction", "stop_s", "start_s")
    return io.day_docs(c, s.select("date", "event_seq", "event_type", "attraction"), rows)


PIECE = 20
PIECES = f"""with {SIGNALS}, {NOTICES}, e as (select date, 'messages' as part, chat_key::bigint * 100 + pos as place from notices union all select date, 'events', event_seq from signals),
 k as (select *, (row_number() over (partition by {{keys}}part order by place) - 1) // {PIECE} as piece from e)
 select {{keys}}part, piece::int as piece, min(place) as first, max(place) as last, count(*)::int as n from k group by all"""


def pieces(spark, sf_dir, keys, back):
    n = notices(spark, sf_dir).select("date", (F.col("chat_key").cast("long") * 100 + F.col("pos")).alias("pos"), "text")
    e = signals(spark, sf_dir).select("date", "event_seq", "event_type", "attraction")
    path = scratch(spark, "pieces")
    io.fragments({"messages": (n, "pos"), "events": (e, "event_seq")}, keys, PIECE).write.json(path)
    read = spark.read.schema(f"{back}part string, piece int, first long, last long, entries string").json(path)
    return read.select(*keys, "part", "piece", "first", "last", F.size(F.from_json("entries", "array<map<string,string>>")).alias("n"))


@query("s9_day_docs", PIECES.format(keys="date, "))
def s9_day_docs(spark, sf_dir):
    """The day documents in pieces, written and read again."""
    return pieces(spark, sf_dir, ["date"], "date date, ")


MONTH_ROWS = PAIRS + " select strftime(date, '%Y-%m') as month, date, incident, attraction, stop_s, start_s from pairs"


@query("s10_month_doc", MONTH_ROWS)
def s10_month_doc(spark, sf_dir):
    """The month's rows from its day documents, flat."""
    return io.month_rows(documents(spark, sf_dir)).select("month", "date", "incident", "attraction", "stop_s", "start_s")


EXPORTED = f"with {NOTICES} select chat_key, (row_number() over (order by date, time, pos) - 1) as pos, date, time, trim(text) as text from notices where chat_key = '3'"


@query("s11_export", EXPORTED.replace("select chat_key,", "select chat_key,"))
def s11_export(spark, sf_dir):
    """Written as a document and read again."""
    path = scratch(spark, "export")
    io.write_text(io.export_chat(notices(spark, sf_dir), "3", "2024-01-01", "2024-01-31"), path)
    return io.read_chat_export(spark, path).select("chat_key", "pos", "date", "time", "text")


@query("s1_read_export", f"with {NOTICES} select chat_key, pos, date, trim(text) as text from notices where pos % 3 > 0")
def s1_read_export(spark, sf_dir):
    """One document per chat; every third notice is undated and goes."""
    day = F.when(F.col("pos") % 3 > 0, F.col("date").cast("string")).otherwise(" ")
    m = F.struct("pos", F.struct("text", day.alias("messageDate"), "time").alias("m"))
    each = notices(spark, sf_dir).groupBy("chat_key").agg(F.sort_array(F.collect_list(m)).alias("x"))
    docs = each.select(F.to_json(F.struct(F.col("chat_key").alias("sourceUrl"), F.transform("x", lambda x: x["m"]).alias("messages"))).alias("value"))
    path = scratch(spark, "exports")
    docs.write.text(path)
    return io.read_chat_export(spark, path, multi_line=False).select("chat_key", "pos", "date", "text")


@query("s12_text", f"with {NOTICES} select '[' || strftime(date, '%Y-%m-%d') || ' ' || time || '] ' || replace(text, chr(10), ' ') as value from notices")
def s12_text(spark, sf_dir):
    flat = notices(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    path = scratch(spark, "text")
    io.write_text(io.text_export(flat), path)
    return spark.read.text(path)


@query("s13_report", f"with {NOTICES} select date, '===== ' || strftime(date, '%Y-%m-%d') || ' =====' || chr(10) || count(*) || ' notices' || chr(10) as value from notices group by date")
def s13_report(spark, sf_dir):
    days = notices(spark, sf_dir).groupBy("date").agg(F.concat(F.count("*").cast("string"), F.lit(" notices ")).alias("report"))
    return io.day_text_report(days)


@query("s15_pending", f"with {NOTICES} select chat_key, pos, date from notices where date not in (select date from notices where pos >= 5)")
def s15_pending(spark, sf_dir):
    n = notices(spark, sf_dir)
    return io.pending_days(n, n.where("pos >= 5").select("date")).select("chat_key", "pos", "date")


@query("s16_rows", f"with {LOG} select strftime(date, '%Y-%m-%d') as date, seq, attraction from log")
def s16_rows(spark, sf_dir):
    path = scratch(spark, "rows")
    io.write_rows(log(spark, sf_dir).select("date", "seq", "attraction"), path)
    return spark.read.schema("date string, seq long, attraction string").json(path)


@query("s17_month", f"with {LOG} select seq, case when seq % 3 = 2 then null else strftime(date, '%Y-%m') end as month from log")
def s17_month(spark, sf_dir):
    k = F.col("seq") % 3
    path = F.concat(F.lit("/a/01.1999/"), F.when(k == 0, F.date_format("date", "MM.yyyy")).when(k == 1, F.date_format("date", "'x_'yyyy-MM'-y'")).otherwise("none"), F.lit(".json"))
    return log(spark, sf_dir).select("seq", t.month_from_path(path).alias("month"))


# --- clocks, dates, rows ----------------------------------------------------------------------


def clocks(spark, sf_dir):
    h, mi = (F.col("seq") % 30).cast("string"), F.lpad((F.col("seq") % 70).cast("string"), 2, "0")
    sep = F.when(F.col("seq") % 2 == 0, ":").otherwise(".")
    return log(spark, sf_dir).select("seq", F.concat(h, sep, mi).alias("clock"))


@query("r3_lenient", f"with {LOG} select seq, case when seq % 30 <= 23 and seq % 70 <= 59 then ((seq % 30) * 60 + seq % 70)::int end as minutes from log")
def r3_lenient(spark, sf_dir):
    return clocks(spark, sf_dir).select("seq", t.parse_clock(F.concat(F.lit("at "), "clock")).alias("minutes"))


@query("r4_strict", f"with {LOG} select seq, case when seq % 2 = 0 and seq % 30 <= 23 and seq % 70 <= 59 then ((seq % 30) * 60 + seq % 70)::int end as minutes from log")
def r4_strict(spark, sf_dir):
    return clocks(spark, sf_dir).select("seq", t.strict_clock(F.col("clock")).alias("minutes"))


def date_texts(spark, sf_dir):
    raw = F.when(F.col("seq") % 4 == 3, "no date at all").otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
    return log(spark, sf_dir).select("seq", raw.alias("raw"))


@query("r5_key", f"with {LOG} select seq, case when seq % 4 = 3 then 'no date at' else strftime(date, '%Y-%m-%d') end as date_key from log")
def r5_key(spark, sf_dir):
    return date_texts(spark, sf_dir).select("seq", t.date_key(F.col("raw")).alias("date_key"))


@query("r6_readable", f"with {LOG} select seq, seq % 4 <> 3 as can_date, seq % 2 = 0 and seq % 30 <= 23 and seq % 70 <= 59 as can_time from log")
def r6_readable(spark, sf_dir):
    both = date_texts(spark, sf_dir).join(clocks(spark, sf_dir), "seq")
    return both.select("seq", t.can_date(F.col("raw")).alias("can_date"), t.can_time(F.col("clock")).alias("can_time"))


@query("r6_time_of_day", "select event_id, (extract(hour from ts) * 3600 + extract(minute from ts) * 60 + extract(second from ts))::bigint as second from events")
def r6_time_of_day(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", t.time_of_day(F.col("ts")).alias("second"))


@query("r7_cell", f"with {LOG} select seq, case when start_s is not null then ((start_s - stop_s) % 86400 + 86400) % 86400 end as downtime_s, case when start_s is null and seq % 2 = 0 then 'all day' end as downtime_text from log")
def r7_cell(spark, sf_dir):
    text = F.when(F.col("seq") % 2 == 0, " all day ").otherwise(" ")
    d, x = t.downtime_cell(F.col("stop_s"), F.col("start_s"), text)
    return log(spark, sf_dir).select("seq", d.alias("downtime_s"), x.alias("downtime_text"))


def raw_rows(spark, sf_dir):
    k, blank = F.col("seq") % 7, F.lit(" ")
    return log(spark, sf_dir).select(
        "seq", "date", F.concat(F.lit(" "), F.lower("attraction")).alias("attraction_name"),
        F.when(k == 0, D.NO_STOPS.upper()).when(k == 1, "x").otherwise(blank).alias("reason"), F.when(k == 2, "n").otherwise(blank).alias("note"), F.when(k == 3, "all").otherwise("").alias("downtime"),
        F.when(k == 4, "9.05").otherwise(F.lit(None).cast("string")).alias("stop_time"), F.when(k == 5, "10:15").otherwise("").alias("start_time"),
    )


@query("r1_keep", f"with {LOG} select seq from log where seq % 7 between 1 and 5")
def r1_keep(spark, sf_dir):
    return io.keep_rows(raw_rows(spark, sf_dir), D.NO_STOPS).select("seq")


@query("r2_prepare", f"with {LOG} select seq, date, attraction, left(attraction, 1)::int as asset_order, case when seq % 7 = 4 then 545 end as stop_min, case when seq % 7 = 5 then 615 end as start_min from log where seq % 7 between 1 and 5")
def r2_prepare(spark, sf_dir):
    dim = assets(spark).withColumns({"full_name": F.col("name"), "aliases": F.array().cast("array<string>")})
    return io.prepare_rows(raw_rows(spark, sf_dir), dim, D.NO_STOPS).select("seq", "date", "attraction", "asset_order", "stop_min", "start_min")


# --- extraction -------------------------------------------------------------------------------


@query("c3_render", f"with {NOTICES} select chat_key, pos, 'On ' || strftime(date, '%Y-%m-%d') || ' {{x}} said: ' || text as prompt from notices".replace("{{x}}", "{x}"))
def c3_render(spark, sf_dir):
    return m.render(notices(spark, sf_dir), "On {date} {x} said: {text}", ["date", "text"]).select("chat_key", "pos", "prompt")


def outputs(spark, sf_dir):
    """Model output in several wrappings around props."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    row = F.concat(F.lit('{"date": "'), F.when(F.col("event_id") % 2 == 0, "").otherwise("2024-05-05"), F.lit('", "v": '), F.get_json_object("props", "$.k"), F.lit("}"))
    body = F.concat(F.lit('{"rows": ['), row, F.lit("]}"))
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("<think>a {b}\n</think>\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), body, F.lit(" done")))
    return e.select("event_id", F.to_date("ts").alias("date"), raw.when(k == 3, "no json").otherwise(F.concat(body, F.lit(" "))).alias("raw"))


@query("c5_rows", "select event_id, case when event_id % 2 = 0 then strftime(ts, '%Y-%m-%d') else '2024-05-05' end as row_date, json_extract(props, '$.k')::int as row_v from events where event_id % 5 <> 3")
def c5_rows(spark, sf_dir):
    return m.parse_rows(outputs(spark, sf_dir), "raw", "struct<date:string,v:int>")[0].select("event_id", "row_date", "row_v")


@query("c5_rejects", "select event_id from events where event_id % 5 = 3")
def c5_rejects(spark, sf_dir):
    return m.parse_rows(outputs(spark, sf_dir), "raw", "struct<date:string,v:int>")[1].select("event_id")


def results(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    one = F.concat(F.lit('{"message_index": '), F.get_json_object("props", "$.k"), F.lit(', "event_type": "INFO"}'))
    two = F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]"))
    quoted = F.to_json(F.struct(two.alias("events")))
    raw = F.when(k == 0, F.concat(F.lit('{"events": '), two, F.lit("}"))).when(k == 1, two).when(k == 2, quoted).otherwise("broken")
    return e.select("event_id", F.to_date("ts").alias("date"), (F.col("event_id") % 3).alias("chunk"), raw.alias("raw"))


@query("c6_events", "select event_id, p::int as event_pos, json_extract(props, '$.k')::int as message_index, 'INFO' as event_type from events, range(2) r(p) where event_id % 4 < 3")
def c6_events(spark, sf_dir):
    return m.parse_events(results(spark, sf_dir), "raw").select("event_id", "event_pos", "message_index", "event_type")


@query("c7_merge", "select cast(ts as date) as date, event_id % 3 as chunk, 2 * count(*)::bigint as events from events where event_id % 4 < 3 group by all")
def c7_merge(spark, sf_dir):
    events, counts = m.merge_chunks(m.parse_events(results(spark, sf_dir), "raw"), ["date"])
    last = events.groupBy("date").agg(F.max("event_seq").alias("n"))
    total = counts.groupBy("date").agg(F.sum("events").alias("t"))
    return counts.join(last.join(total, "date").where("n = t").select("date"), "date", "left_semi")


@query("c7_rows", "select cast(ts as date) as date, event_id as chunk, p::int as event_pos, row_number() over (partition by cast(ts as date) order by event_id, p) as event_seq from events, range(2) r(p) where event_id % 4 < 3")
def c7_rows(spark, sf_dir):
    own = results(spark, sf_dir).withColumn("chunk", F.col("event_id"))
    return m.merge_chunks(m.parse_events(own, "raw"), ["date"])[0].select("date", "chunk", "event_pos", "event_seq")


def find_tion(row: dict) -> list[dict]:
    """A rule extractor: an INFO for each line of the chunk that has the syllable."""
    return [{"message_index": i, "event_type": "INFO", "quote": x[:20]} for i, x in enumerate(row["transcript"].split("\n")) if "tion" in x]


@query(
    "u1_extract",
    f"""with {NOTICES}, i as (select *, row_number() over (partition by chat_key, date order by pos) as m from notices),
 c as (select chat_key, date, ((m - 1) // 3)::int as chunk, string_agg(trim('#' || m || '. ' || time || ' ' || text), chr(10) order by m) as x from i group by chat_key, date, (m - 1) // 3),
 l as (select chat_key, chunk, unnest(string_split(x, chr(10))) as line, generate_subscripts(string_split(x, chr(10)), 1) - 1 as k from c)
 select chat_key, chunk, k::int as message_index, left(line, 20) as quote from l where contains(line, 'tion')""",
)
def u1_extract(spark, sf_dir):
    found, _ = m.extract_events(chunk(notices(spark, sf_dir), 3), find_tion, ["chat_key", "chunk", "transcript"])
    return found.select("chat_key", "chunk", "message_index", "quote")


# --- repair -----------------------------------------------------------------------------------


def damaged(spark, sf_dir):
    bad = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", bad.alias("text"))


@query("t1_damage", "select doc_id, (length(text) - length(regexp_replace(text, '[À-ÿ]', '', 'g')))::int as score from documents")
def t1_damage(spark, sf_dir):
    return damaged(spark, sf_dir).select("doc_id", r.damage(F.col("text"), ["Ã"]).alias("score"))


@query("t2_repair", "select doc_id, text from documents")
def t2_repair(spark, sf_dir):
    return damaged(spark, sf_dir).select("doc_id", r.repair(F.col("text"), "latin-1", ["Ã", "Â"]).alias("text"))


@query("t3_best", "select doc_id, text from documents")
def t3_best(spark, sf_dir):
    return damaged(spark, sf_dir).select("doc_id", r.repair_best(F.col("text"), ["cp1251", "koi8-r", "latin-1"], ["Ã", "Â"]).alias("text"))


@query("t4_nested", "select doc_id, text, [text, 'x'] as parts from documents")
def t4_nested(spark, sf_dir):
    nested = damaged(spark, sf_dir).select("doc_id", F.array(F.struct("text"), F.struct(F.lit("x").alias("text"))).alias("s"))
    fixed = r.repair_nested(nested, ["s"], lambda c: r.repair(c, "latin-1", ["Ã", "Â"]))
    return fixed.select("doc_id", F.element_at("s", 1)["text"].alias("text"), F.transform("s", lambda x: x["text"]).alias("parts"))


# --- streams ----------------------------------------------------------------------------------


def feed(spark, sf_dir):
    """Notice files; the last repeats a part of the first."""
    base = notices(spark, sf_dir).select("chat_key", "pos", "date", "time", "text")
    path = scratch(spark, "feed")
    for part in (base.where("pos % 2 = 0"), base.where("pos % 2 = 1"), base.where("pos = 0")):
        part.write.mode("append").json(path)
    return path


def _run(writer, spark) -> None:
    writer.option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()


@query("x1_stream", f"with {NOTICES} select chat_key, pos, date, time, text from notices")
def x1_stream(spark, sf_dir):
    out = scratch(spark, "streamed")
    _run(live.stream_notices(spark, feed(spark, sf_dir), late="60 days", per_batch=1000).writeStream.format("parquet").option("path", out), spark)
    return spark.read.parquet(out).select("chat_key", "pos", "date", "time", "text")


@query("x2_store", f"with {NOTICES} select chat_key, pos, date, time from notices")
def x2_store(spark, sf_dir):
    out, path = scratch(spark, "store"), feed(spark, sf_dir)
    for _ in range(2):  # a replay from the beginning adds nothing
        raw = spark.readStream.schema(live.NOTICE).json(path)
        _run(raw.writeStream.foreachBatch(store_sink(out, 16)), spark)
    return read_store(spark, out).select("chat_key", "pos", "date", "time")


@query("x3_refresh", PAIRS + f" select {', '.join(COLUMNS)} from pairs where date in (select date from signals where event_seq % 1000 = 0)")
def x3_refresh(spark, sf_dir):
    s = signals(spark, sf_dir)
    return live.refresh_days(s.where("event_seq % 1000 = 0"), s).select(*COLUMNS)
