"""Queries of calendar, totals, ledgers and yearly statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from haltbook.functions import timecols as t
from haltbook.plans import report, yearly
from haltbook.plans.register import collector
from haltbook.plans.views import ASSETS, DAYS, LOG, MONTH, PRIORITIES, YEAR, YEAR_DAYS, assets, log, month_log, schedule, year_log

QUERIES, ORACLES, query = collector()

FIRST = f"date '{MONTH}-01'"
GRID = f"grid as (select cast(range as date) as date, ord, name as attraction from range({FIRST}, {FIRST} + interval 1 month, interval 1 day), assets)"
MLOG = f"with {LOG}, {ASSETS}, {GRID}, mlog as (select *, case when stop_s is not null and start_s is not null then ((start_s - stop_s) % 86400 + 86400) % 86400 end as d from log where strftime(date, '%Y-%m') = '{MONTH}')"
MDAYS = MLOG + ", mdays as (select g.date, g.ord, g.attraction, coalesce(sum(d), 0)::bigint as downtime_s, count(d) as stops from grid g left join mlog using (date, attraction) group by all)"
SUMS = "sum(downtime_s)::bigint as downtime_s, sum(stops)::bigint as stops"
YM = "strftime(date, '%Y-%m')"


def all_days(spark, sf_dir):
    return report.asset_days(log(spark, sf_dir))


def month_grid(spark, sf_dir):
    return report.spine(MONTH, assets(spark))


def month_days(spark, sf_dir):
    return report.on_spine(month_grid(spark, sf_dir), month_log(spark, sf_dir))


def hours(rows):
    days = rows.select("date").distinct()
    return report.hours_for(days, schedule(days))


YHOURS = """, yd as (select distinct date from ylog), yh as (select date, case when day(date) = 1 then '10:00' else '09:00' end as open,
 case when day(date) = 1 then '20:00' when isodow(date) < 5 then '22:00' else '23:00' end as close from yd),
 yn as (select strftime(date, '%Y-%m') as month, sum((cast(left(close, 2) as int) - cast(left(open, 2) as int)) * 3600)::bigint as normative_s from yh group by 1)"""


@query("d1_downtime", f"with {LOG} select seq, case when start_s < stop_s then start_s + 86400 - stop_s else start_s - stop_s end as downtime_s from log")
def d1_downtime(spark, sf_dir):
    return log(spark, sf_dir).select("seq", t.downtime_s(F.col("stop_s"), F.col("start_s")).alias("downtime_s"))


@query("d2_hours", f"with {LOG} select distinct date, '09:00' as open, case when isodow(date) < 5 then '22:00' else '23:00' end as close from log")
def d2_hours(spark, sf_dir):
    a, b = t.opening(F.col("date"))
    return log(spark, sf_dir).select("date").distinct().select("date", a.alias("open"), b.alias("close"))


@query("d3_schedule", f"with {DAYS}{YHOURS} select date, open, close from yh")
def d3_schedule(spark, sf_dir):
    return hours(log(spark, sf_dir))


@query("d4_spine", MDAYS + ", n as (select date, attraction, count(*) as n from mlog group by all) select g.date, g.attraction, coalesce(n, 0) as n from grid g left join n using (date, attraction)")
def d4_spine(spark, sf_dir):
    n = month_log(spark, sf_dir).groupBy("date", "attraction").agg(F.count("*").alias("n"))
    return month_grid(spark, sf_dir).join(n, ["date", "attraction"], "left").select("date", "attraction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    "d5_slots",
    f"with {DAYS}, s as (select *, row_number() over (partition by date, attraction order by coalesce(stop_s, 86340), seq) as slot from ylog) select seq, slot, max(slot) over (partition by date) as day_slots from s",
)
def d5_slots(spark, sf_dir):
    return report.slots(log(spark, sf_dir)).select("seq", F.col("slot").cast("long").alias("slot"), F.col("day_slots").cast("long").alias("day_slots"))


@query("d6_day", f"with {DAYS} select date, attraction, {SUMS} from adays group by grouping sets ((date, attraction), (date))")
def d6_day(spark, sf_dir):
    return report.day_totals(all_days(spark, sf_dir))


@query("d7_positive", f"with {DAYS} select date, attraction, coalesce(sum(d), 0)::bigint as downtime_s, count(*) filter (d > 0) as stops from dlog group by all")
def d7_positive(spark, sf_dir):
    return report.asset_days(log(spark, sf_dir), count_zero=False)


@query("d8_week", f"with {DAYS} select {YM} as month, week(date)::int as week, attraction, min(date) as first_date, max(date) as last_date, {SUMS} from adays group by 1, 2, 3")
def d8_week(spark, sf_dir):
    return report.week_totals(all_days(spark, sf_dir))


@query("d9_month", f"with {DAYS} select {YM} as month, attraction, {SUMS} from adays group by grouping sets ((1, attraction), (1))".replace("grouping sets ((1, attraction), (1))", f"grouping sets (({YM}, attraction), ({YM}))"))
def d9_month(spark, sf_dir):
    return report.month_totals(all_days(spark, sf_dir))


@query(
    "d10_levels",
    f"""with {DAYS}, k as (select {YM} as month, week(date)::int as week, * from adays), parts as (
 select 'day' as level, month, week, date, attraction, {SUMS} from k group by all union all select 'day', month, week, date, null, {SUMS} from k group by month, week, date
 union all select 'week', month, week, null, attraction, {SUMS} from k group by month, week, attraction union all select 'week', month, week, null, null, {SUMS} from k group by month, week
 union all select 'month', month, null, null, attraction, {SUMS} from k group by month, attraction union all select 'month', month, null, null, null, {SUMS} from k group by month) select * from parts""",
)
def d10_levels(spark, sf_dir):
    return report.ledger_totals(all_days(spark, sf_dir))


LEDGER = (
    MDAYS
    + f""", hrs as (select date, case when day(date) = 1 then '10:00' else '09:00' end as open, case when day(date) = 1 then '20:00' when isodow(date) < 5 then '22:00' else '23:00' end as close from (select distinct date from grid)),
 num as (select *, row_number() over (partition by date, attraction order by coalesce(stop_s, 86340), seq) as slot from mlog where attraction in (select name from assets)),
 tall as (select date, max(slot) as n from num group by 1),
 fr as (select g.date, g.ord, g.attraction, unnest(range(1, coalesce(n, 1)::bigint + 1)) as slot from grid g left join tall using (date)),
 wk as (select max(date) as date, ord, attraction, {SUMS} from mdays group by week(date), ord, attraction),
 led as (select g.date, 0 as kind, 0 as slot, ord, attraction, null::bigint as stop_s, null::bigint as start_s, null::bigint as downtime_s, null::bigint as stops, open as clock from grid g join hrs using (date)
 union all select fr.date, 1, fr.slot, fr.ord, fr.attraction, stop_s, start_s, d, null, null from fr left join num on num.date = fr.date and num.attraction = fr.attraction and num.slot = fr.slot
 union all select g.date, 2, 0, ord, attraction, null, null, null, null, close from grid g join hrs using (date)
 union all select date, 3, 0, ord, attraction, null, null, downtime_s, stops, null from mdays
 union all select date, 4, 0, ord, attraction, null, null, downtime_s, stops, null from wk
 union all select last_day({FIRST}), 5, 0, ord, attraction, null, null, sum(downtime_s)::bigint, sum(stops)::bigint, null from mdays group by ord, attraction)"""
)


def month_ledger(spark, sf_dir):
    grid = month_grid(spark, sf_dir)
    days = report.month_days(assets(spark), MONTH)
    return report.ledger(grid, month_log(spark, sf_dir), report.hours_for(days, schedule(days)))


@query("d11_ledger", LEDGER + " select date, kind::int as kind, slot::int as slot, ord::int as ord, attraction, stop_s, start_s, downtime_s, stops, clock from led")
def d11_ledger(spark, sf_dir):
    return month_ledger(spark, sf_dir)


WIDE = ", ".join(f"max({c}) filter (attraction = '{n}') as \"{n}_{c}\"" for n in PRIORITIES for c in ("stop_s", "start_s", "downtime_s", "stops"))


@query("d12_wide", LEDGER + f" select date, kind::int as kind, slot::int as slot, {WIDE}, sum(downtime_s)::bigint as park_downtime_s, sum(stops)::bigint as park_stops from led group by 1, 2, 3")
def d12_wide(spark, sf_dir):
    return report.ledger_wide(month_ledger(spark, sf_dir), PRIORITIES)


SUMMARY = f"{SUMS}, floor((sum(downtime_s) + 18) / 36) / 100 as hours"


@query("d13_summary", f"with {DAYS}, k as (select {YM} as month, * from adays) select month, coalesce(attraction, 'Итого') as attraction, {SUMMARY} from k group by grouping sets ((month, attraction), (month))")
def d13_summary(spark, sf_dir):
    return report.month_summary(all_days(spark, sf_dir))


@query("d14_weeks", f"with {DAYS}, k as (select {YM} as month, week(date)::int as week, * from adays) select month, week, coalesce(attraction, 'Итого') as attraction, {SUMMARY} from k group by grouping sets ((month, week, attraction), (month, week))")
def d14_weeks(spark, sf_dir):
    return report.week_summaries(all_days(spark, sf_dir))


@query(
    "d15_labels",
    f"""with {DAYS}, m as (select date, attraction, downtime_s, downtime_s // 60 as a, cast(floor(downtime_s / 60.0 + 0.5) as bigint) as b from adays)
 select date, attraction, (a // 60) || ' ч. ' || (a % 60) || ' мин.' as label, case when b = 0 then '' when b < 60 then b || 'м' else (b // 60) || 'ч ' || (b % 60) || 'м' end as short from m""",
)
def d15_labels(spark, sf_dir):
    s = F.col("downtime_s")
    return all_days(spark, sf_dir).select("date", "attraction", t.duration_label(s).alias("label"), t.short_label(s).alias("short"))


@query(
    "d16_series",
    f"""with {DAYS}, {ASSETS}, k as (select {YM} as month, * from adays), s as (select month, attraction, sum(stops)::bigint as stops, floor((sum(downtime_s) + 18) / 36) / 100 as hours from k group by grouping sets ((month, attraction), (month)))
 select month, coalesce(ord, 1073741824)::bigint as ord, coalesce(attraction, 'Итого') as attraction, hours, stops from s left join assets on name = attraction""",
)
def d16_series(spark, sf_dir):
    return report.chart_series(all_days(spark, sf_dir), assets(spark))


@query("d17_normative", f"with {DAYS}{YHOURS} select month, normative_s from yn")
def d17_normative(spark, sf_dir):
    return report.normative(hours(log(spark, sf_dir)))


@query("d18_ratio", f"with {DAYS}{YHOURS}, p as (select {YM} as month, sum(downtime_s)::bigint as downtime_s from adays group by 1) select month, downtime_s, normative_s, downtime_s / normative_s as ratio from p join yn using (month)")
def d18_ratio(spark, sf_dir):
    return report.month_ratio(all_days(spark, sf_dir), report.normative(hours(log(spark, sf_dir))))


NAMES = "['Январь','Февраль','Март','Апрель','Май','Июнь','Июль','Август','Сентябрь','Октябрь','Ноябрь','Декабрь']"


@query("d19_months", f"with {LOG} select distinct month(date)::int as month, list_extract({NAMES}, month(date)) as name from log")
def d19_months(spark, sf_dir):
    return log(spark, sf_dir).select(F.month("date").alias("month")).distinct().select("month", t.month_name(F.col("month")).alias("name"))


MATRIX = f"with {YEAR_DAYS}, {ASSETS}, mx as (select m.range::int as month, ord::int as ord, name as attraction, coalesce(sum(downtime_s), 0)::bigint as downtime_s, coalesce(sum(stops), 0)::bigint as stops from range(1, 13) m cross join assets left join adays on month(date) = m.range and attraction = name group by all)"


def matrix(spark, sf_dir):
    return yearly.year_matrix(log(spark, sf_dir), YEAR, assets(spark))


@query("y1_matrix", MATRIX + " select * from mx")
def y1_matrix(spark, sf_dir):
    return matrix(spark, sf_dir)


@query("y1_wide", MATRIX + " select month, " + ", ".join(f"sum(downtime_s) filter (attraction = '{n}')::bigint as \"{n}\"" for n in PRIORITIES) + " from mx group by month")
def y1_wide(spark, sf_dir):
    return yearly.matrix_wide(matrix(spark, sf_dir), PRIORITIES)


@query("y2_totals", MATRIX + f" select month, attraction, {SUMS} from mx group by cube (month, attraction)")
def y2_totals(spark, sf_dir):
    return yearly.year_totals(matrix(spark, sf_dir))


@query("y3_summary", MATRIX + f" select {SUMS}, sum(downtime_s) filter (attraction <> '5-LOW')::bigint as other_downtime_s, sum(stops) filter (attraction <> '5-LOW')::bigint as other_stops from mx")
def y3_summary(spark, sf_dir):
    return yearly.year_summary(matrix(spark, sf_dir), "5-low")


@query("y4_ratio", MATRIX + YHOURS + " select d as downtime_s, (5 * n)::bigint as normative_s, d / (5 * n) as ratio from (select sum(downtime_s)::bigint as d from mx), (select sum(normative_s)::bigint as n from yn)")
def y4_ratio(spark, sf_dir):
    return yearly.year_ratio(matrix(spark, sf_dir), report.normative(hours(year_log(spark, sf_dir))))


@query("y5_series", MATRIX + " select month, attraction, floor((downtime_s + 18) / 36) / 100 as hours, null::bigint as stops from mx union all select null, attraction, null, sum(stops)::bigint from mx group by attraction")
def y5_series(spark, sf_dir):
    return yearly.year_series(matrix(spark, sf_dir))
