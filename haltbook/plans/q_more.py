"""Queries of whole documents, files and streams (S1, S9, S10, S12, S14, S15, C7, P3, X3): their real
columns, beside the counts of the queries in q_io and q_pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from haltbook.operators import events as ev
from haltbook.operators import pairing
from haltbook.plans import q_events
from haltbook.plans.q_io import _run
from haltbook.plans.q_pairing import COLUMNS, PAIRS
from haltbook.plans.register import collector
from haltbook.plans.views import NOTICES, SIGNALS, notices, signals
from haltbook.sources import manifest
from haltbook.sources import tables as io
from haltbook.sources.scratch import scratch
from haltbook.streaming import live

QUERIES, ORACLES, query = collector()


@query("s1_files", f"with {NOTICES} select chat_key, pos, strftime(date, '%Y-%m-%d') as raw_date, date, time, trim(text) as text from notices where pos % 3 > 0")
def s1_files(spark, sf_dir):
    """One multi-line document per chat, many to a file; every third notice is undated and goes."""
    day = F.when(F.col("pos") % 3 > 0, F.col("date").cast("string")).otherwise(" ")
    m = F.struct("pos", F.struct("text", day.alias("messageDate"), "time").alias("m"))
    each = notices(spark, sf_dir).groupBy("chat_key").agg(F.sort_array(F.collect_list(m)).alias("x"))
    doc = F.struct(F.col("chat_key").alias("sourceUrl"), F.transform("x", lambda x: x["m"]).alias("messages"))
    path = scratch(spark, "files")
    each.select(F.to_json(doc, {"pretty": "true"}).alias("value")).write.option("lineSep", io.RECORD_END).text(path)
    return io.read_chat_export(spark, path, separator=io.RECORD_END)


def documents(spark, sf_dir):
    """Day documents by chat group, with raw and rejected events."""
    s = signals(spark, sf_dir).withColumn("group", F.col("message_index") % 7)
    rows = pairing.incident_detail(s, ("group", "date")).select("group", "date", "incident", "attraction", "stop_s", "start_s")
    n = notices(spark, sf_dir).select((F.col("chat_key").cast("long") % 7).cast("int").alias("group"), "date", (F.col("chat_key").cast("long") * 100 + F.col("pos")).alias("pos"), "text")
    told = s.select("group", "date", "event_seq", "event_type", "attraction")
    return io.day_docs(n, told.where("event_type <> 'INFO'"), rows, told, told.where("event_type = 'INFO'"), ("group", "date"))


DOCS = f"""with {SIGNALS}, {NOTICES}, s as (select *, message_index % 7 as grp from signals), n as (select date, chat_key::bigint % 7 as grp, count(*) as n_messages from notices group by all),
 e as (select date, grp, count(*) as n_raw, count(*) filter (event_type = 'INFO') as n_info from s group by all)"""


@query(
    "s9_quarantine",
    DOCS + """ select coalesce(n.date, e.date) as date, coalesce(n.grp, e.grp)::int as "group", coalesce(n_messages, 0)::int as n_messages, coalesce(n_raw - n_info, 0)::int as n_events,
 coalesce(n_raw, 0)::int as n_raw_events, coalesce(n_info, 0)::int as n_quarantine from n full join e on n.date = e.date and n.grp = e.grp""",
)
def s9_quarantine(spark, sf_dir):
    """Written by date and read again; counts are those of the arrays read back."""
    path = scratch(spark, "days")
    io.write_day_docs(documents(spark, sf_dir), path)
    kinds = "array<struct<event_seq:long>>"
    back = spark.read.schema(f"date date, group int, messages array<struct<pos:long>>, events {kinds}, raw_events {kinds}, quarantine {kinds}").json(path)
    return back.select("date", "group", *(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(f"n_{c}") for c in ("messages", "events", "raw_events", "quarantine")))


@query("s10_quarantine", f"with {SIGNALS} select strftime(date, '%Y-%m') as month, date, event_seq, attraction from signals where event_type = 'INFO'")
def s10_quarantine(spark, sf_dir):
    return io.month_rows(documents(spark, sf_dir), "quarantine").select("month", "date", "event_seq", "attraction")


@query(
    "s10_counts",
    f"with {SIGNALS} select strftime(date, '%Y-%m') as month, count(*)::bigint as n_raw_events, count(*) filter (event_type = 'INFO')::bigint as n_quarantine from signals group by 1",
)
def s10_counts(spark, sf_dir):
    docs = io.month_doc(documents(spark, sf_dir))
    return docs.where("n_raw_events > 0").select("month", "n_raw_events", F.size("quarantine").cast("long").alias("n_quarantine"))


@query("s12_prompt", f"with {NOTICES} select '[' || strftime(date, '%Y-%m-%d') || ' ' || time || '] ' || replace(text, chr(10), ' ') as value from notices union all select unnest(['# === PROMPT ===', 'Say it.', '', '# === MESSAGES ==='])")
def s12_prompt(spark, sf_dir):
    flat = notices(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    path = scratch(spark, "text")
    io.write_text(io.text_export(flat, "Say it."), path)
    return spark.read.text(path)


@query(
    "s15_rerun",
    f"""with {q_events.BASE}, j as (select es.chat_key, es.event_seq, es.event_type, es.quote, es.time, ns.time as header, nullif(trim(ns.text), '') as body{q_events.JOIN}
  where not coalesce(contains(lower(ns.text), 'tion'), false) or contains(lower(es.quote), 'the')),
 t as (select *, case when event_type = 'START' and contains(lower(quote), 'que') then 'TEST_RUN' else event_type end as kind from j),
 u as (select *, case when kind = 'STOP_UNPLANNED' then body end as source_text from t)
 select chat_key, event_seq, kind as event_type, case when time in ('', '--:--') then header else time end as time, case when time not in ('', '--:--') and time <> header then header end as message_time, source_text,
 case when source_text is not null and (trim(quote) = '' or ends_with(lower(quote), 'stop') or len(regexp_split_to_array(trim(quote), '\\s+')) <= 3) then source_text else quote end as quote from u""",
)
def s15_rerun(spark, sf_dir):
    """Day documents, half of them with raw events and half with events only, go through the steps again."""
    e = q_events.events(spark, sf_dir)
    own = F.struct("event_seq", *(c for c in e.columns if c not in ("chat_key", "event_seq")))
    packed = e.groupBy("chat_key").agg(F.collect_list(own).alias("all"))
    half = F.col("chat_key").cast("long") % 2 == 0
    docs = packed.select("chat_key", F.when(half, F.col("all")).alias("raw_events"), F.when(half, F.slice("all", 1, 1)).otherwise(F.col("all")).alias("events"))
    again = ev.stored_events(docs, ("chat_key",)).select(*e.columns)
    done = ev.normalize_events(again, q_events.indexed(spark, sf_dir), key=q_events.KEY, future=["tion"], today="the", tests=["que"], quotes=["stop"])
    return done.select("chat_key", "event_seq", "event_type", "time", "message_time", "source_text", "quote")


@query(
    "p3_sources",
    PAIRS + """, d as (select h.date, h.attraction, h.incident, list('#' || h.message_index order by h.rn) as refs, list(h.quote order by h.rn) as quotes, list(h.message_index order by h.rn) as stops
  from h where event_type = 'STOP_UNPLANNED' and incident > 0 group by all)
 select p.date, p.attraction, p.incident, list_sort(list_distinct(case when p.closed_by in ('START', 'START_GENERAL') then list_append(refs, '#' || c.message_index) else refs end)) as source,
 list_sort(list_distinct(case when p.closed_by in ('START', 'START_GENERAL') then list_append(quotes, c.quote) else quotes end)) as evidence, stops[2:] as updates
 from pairs p join d on d.date = p.date and d.attraction = p.attraction and d.incident = p.incident left join o c on c.date = p.date and c.rn = p.closer_rn""",
)
def p3_sources(spark, sf_dir):
    d = pairing.incident_detail(signals(spark, sf_dir))
    return d.select("date", "attraction", "incident", F.sort_array("source").alias("source"), F.sort_array("evidence").alias("evidence"), F.transform("update_events", lambda x: x["message_index"]).alias("updates"))


@query("x3_stream", PAIRS + f" select {', '.join(COLUMNS)} from pairs")
def x3_stream(spark, sf_dir):
    """Event files arrive one by one; each batch replaces the days it touches."""
    s = signals(spark, sf_dir)
    path, root = scratch(spark, "signals"), scratch(spark, "log")
    for k in range(3):
        s.where(F.col("event_seq") % 3 == k).write.mode("append").json(path)
    schema = s.schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).json(path)
    _run(raw.writeStream.foreachBatch(live.refresh_sink(lambda: spark.read.schema(schema).json(path), root, COLUMNS)), spark)
    return manifest.read_log(spark, root).select(*COLUMNS)
