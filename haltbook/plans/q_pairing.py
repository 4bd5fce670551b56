"""Queries of event order, conflicts and incident pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from haltbook.operators import events as ev
from haltbook.operators import pairing
from haltbook.plans.register import collector
from haltbook.plans.views import SIGNALS, signals

QUERIES, ORACLES, query = collector()

#: General starts are fanned out to every attraction; a stop opens an incident unless the last
#: relevant event before it is a stop.
PAIRS = f"""with {SIGNALS}, o as (select *, row_number() over (partition by date order by message_index, coalesce(time_s // 60, 10000), event_seq) as rn from signals),
 rides as (select distinct date, attraction from o where event_type in ('STOP_UNPLANNED','START','TEST_RUN')),
 f as (select date, attraction, rn, time_s, event_type, quote, message_index, reason from o where event_type in ('STOP_UNPLANNED','START','TEST_RUN')
  union all select o.date, r.attraction, rn, time_s, event_type, quote, message_index, reason from o join rides r on o.date = r.date where event_type = 'START_GENERAL'),
 g as (select *, last_value(case when event_type = 'TEST_RUN' and time_s is null then null else event_type end ignore nulls)
  over (partition by date, attraction order by rn rows between unbounded preceding and 1 preceding) as before from f),
 h as (select *, sum(case when event_type = 'STOP_UNPLANNED' and coalesce(before, '') <> 'STOP_UNPLANNED' then 1 else 0 end)
  over (partition by date, attraction order by rn) as incident from g),
 i as (select date, attraction, incident, min(rn) filter (event_type = 'STOP_UNPLANNED') as first_rn, count(*) filter (event_type = 'STOP_UNPLANNED') as n_stops,
  min(rn) filter (event_type in ('START', 'START_GENERAL')) as close_rn, min(rn) filter (event_type = 'TEST_RUN' and time_s is not null) as test_rn,
  max(rn) filter (event_type = 'TEST_RUN' and time_s is null) as untimed_rn from h where incident > 0 group by all),
 pairs as (select i.date, i.attraction, cast(i.incident as bigint) as incident, s.time_s as stop_s, c.time_s as start_s, i.n_stops, c.event_type as closed_by, i.untimed_rn, c.rn as closer_rn
  from i join o s on s.date = i.date and s.rn = i.first_rn left join o c on c.date = i.date and c.rn = coalesce(i.close_rn, i.test_rn))"""
COLUMNS = ["date", "attraction", "incident", "stop_s", "start_s", "n_stops", "closed_by"]


@query("e3_order", f"with {SIGNALS} select date, event_seq, row_number() over (partition by date order by message_index, coalesce(time_s // 60, 10000), event_seq) as place from signals")
def e3_order(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("date").orderBy("ord")
    return pairing.with_order(signals(spark, sf_dir)).select("date", "event_seq", F.row_number().over(w).cast("long").alias("place"))


@query("p1_pair", PAIRS + f" select {', '.join(COLUMNS)} from pairs")
def p1_pair(spark, sf_dir):
    return pairing.pair_incidents(signals(spark, sf_dir)).select(*COLUMNS)


@query("p2_general", PAIRS + f" select {', '.join(COLUMNS)} from pairs where closed_by = 'START_GENERAL'")
def p2_general(spark, sf_dir):
    return pairing.closing_of_general(pairing.pair_incidents(signals(spark, sf_dir))).select(*COLUMNS)


@query(
    "p3_detail",
    PAIRS + """, d as (select h.date, h.attraction, h.incident, string_agg(h.quote, '; ' order by h.rn) as note, list('#' || h.message_index order by h.rn) as refs,
  list(h.reason order by h.rn) as reasons from h where event_type = 'STOP_UNPLANNED' and incident > 0 group by all)
 select d.date, d.attraction, cast(d.incident as bigint) as incident, d.note, array_to_string(list_reduce(reasons, (a, x) -> case when contains(a, x) then a else a || '; ' || x end)::varchar[], '') as reason,
  cast(len(list_distinct(refs)) as bigint) as n_refs, cast(len(refs) - 1 as bigint) as n_updates from d""".replace(
        "array_to_string(list_reduce(reasons, (a, x) -> case when contains(a, x) then a else a || '; ' || x end)::varchar[], '')",
        "list_reduce(reasons, lambda a, x: case when contains(a, x) then a else a || '; ' || x end)",
    ),
)
def p3_detail(spark, sf_dir):
    d = pairing.incident_detail(signals(spark, sf_dir))
    stops = F.transform("update_events", lambda x: x["message_index"])
    refs = F.size(F.array_distinct(F.concat(F.array("stop_event.message_index"), stops)))
    return d.select("date", "attraction", "incident", "note", "reason", refs.cast("long").alias("n_refs"), F.size("update_events").cast("long").alias("n_updates"))


@query(
    "p4_closing",
    PAIRS + """ select p.date, p.attraction, p.incident, p.start_s, p.closed_by, case when p.closed_by in ('START', 'START_GENERAL') then coalesce(c.quote, '')
  when coalesce(c.quote, u.quote) is not null then '[Тест] ' || coalesce(c.quote, u.quote) else '' end as start_quote
  from pairs p left join o c on c.date = p.date and c.rn = p.closer_rn left join o u on u.date = p.date and u.rn = p.untimed_rn""",
)
def p4_closing(spark, sf_dir):
    return pairing.incident_detail(signals(spark, sf_dir)).select("date", "attraction", "incident", "start_s", "closed_by", "start_quote")


@query("p5_days", PAIRS + f" select {', '.join(COLUMNS)} from pairs where date between date '2024-01-03' and date '2024-01-20'")
def p5_days(spark, sf_dir):
    return pairing.run_days(signals(spark, sf_dir), since="2024-01-03", until="2024-01-20").select(*COLUMNS)


@query(
    "e4_conflicts",
    f"""with {SIGNALS} select date, event_seq, event_type from signals s where not (event_type = 'START' and exists (select 1 from signals t
  where t.date = s.date and t.message_index = s.message_index and t.attraction = s.attraction and t.event_type = 'TEST_RUN'))""",
)
def e4_conflicts(spark, sf_dir):
    return ev.drop_test_conflicts(signals(spark, sf_dir)).select("date", "event_seq", "event_type")


@query("e7_override", f"with {SIGNALS} select event_seq, case when event_type in ('START', 'INFO') and contains(quote, '7') then 'TEST_RUN' else event_type end as event_type from signals")
def e7_override(spark, sf_dir):
    return ev.override_tests(signals(spark, sf_dir), markers=["7"]).select("event_seq", "event_type")


@query("a5_targets", f"with {SIGNALS} select event_seq, attraction from signals where attraction in ('ride_0', 'ride_1', 'ride_2', 'ride_3')")
def a5_targets(spark, sf_dir):
    return ev.targets_only(signals(spark, sf_dir), _rides(spark)).select("event_seq", "attraction")


def _rides(spark):
    return spark.createDataFrame([(i, f"ride_{i}") for i in range(4)], "ord int, name string")


@query(
    "e11_quarantine",
    f"""with {SIGNALS} select event_seq, case when event_type = 'INFO' then null when attraction not in ('ride_0', 'ride_1', 'ride_2', 'ride_3') then 'Not target attraction: ' || attraction
  else 'No technical cause' end as quarantine_reason from signals where event_type = 'INFO' or (event_type = 'STOP_UNPLANNED' and
  (attraction not in ('ride_0', 'ride_1', 'ride_2', 'ride_3') or not contains(reason, '7')))""",
)
def e11_quarantine(spark, sf_dir):
    cause = F.when(F.contains("reason", F.lit("7")), F.col("reason"))
    marked = ev.quarantine_reason(signals(spark, sf_dir).withColumn("cause", cause), _rides(spark))
    return ev.rejects(marked).select("event_seq", "quarantine_reason")
