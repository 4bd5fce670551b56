"""Calendar, totals and ledgers of a downtime report.

Incidents are aggregated by (date, attraction) before they meet the calendar, so what is joined and
expanded into subtotal levels is as small as the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltbook import defaults as D
from haltbook.functions.timecols import DAY, downtime_s, hours_of, opening, strict_clock

#: Missing stop times in a day's order: as 23:59, after everything, or as 00:00.
LATE, LAST, EARLY = 86340, 1 << 30, 0


def month_days(df: DataFrame, month: str) -> DataFrame:
    """One row per day of a month ('YYYY-MM')."""
    first = F.to_date(F.lit(month + "-01"))
    return df.sparkSession.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("date"))


def spine(month: str, assets: DataFrame) -> DataFrame:
    """Every day of the month with every asset of the dimension (ord, name)."""
    kept = assets.select("ord", F.col("name").alias("attraction"))
    return month_days(assets, month).join(kept, how="cross")


def hours_for(days: DataFrame, schedule: DataFrame, rule=None) -> DataFrame:
    """Opening hours by weekday, either side overridden by the day's first schedule row (D3)."""
    first = schedule.groupBy(F.col("date").alias("on")).agg(
        F.min(F.when(F.col("open").isNotNull(), F.struct("row", "open")))["open"].alias("o"),
        F.min(F.when(F.col("close").isNotNull(), F.struct("row", "close")))["close"].alias("c"),
    )
    begin, end = opening(F.col("date"), rule)
    return days.join(first, F.col("date") == F.col("on"), "left").select(
        *(F.col(c) for c in days.columns), F.coalesce("o", begin).alias("open"), F.coalesce("c", end).alias("close")
    )


def slots(incidents: DataFrame, missing: int = LATE) -> DataFrame:
    """Incidents numbered in their day, and the day's number of slots."""
    own = Window.partitionBy("date", "attraction").orderBy(F.coalesce("stop_s", F.lit(missing)), "seq")
    numbered = incidents.withColumn("slot", F.row_number().over(own))
    height = incidents.groupBy("date", "attraction").count().groupBy("date").agg(F.max("count").cast("int").alias("day_slots"))
    return numbered.join(height, "date")


def complete() -> Column:
    return F.col("stop_s").isNotNull() & F.col("start_s").isNotNull()


def asset_days(incidents: DataFrame, count_zero: bool = True) -> DataFrame:
    """Downtime and stops of complete incidents by date and attraction."""
    d = F.when(complete(), downtime_s(F.col("stop_s"), F.col("start_s")))
    counted = d.isNotNull() if count_zero else d > 0
    return incidents.groupBy("date", "attraction").agg(
        F.coalesce(F.sum(d), F.lit(0)).cast("long").alias("downtime_s"), F.count_if(counted).cast("long").alias("stops")
    )


def on_spine(grid: DataFrame, incidents: DataFrame, count_zero: bool = True) -> DataFrame:
    found = asset_days(incidents, count_zero)
    zero = F.lit(0).cast("long")
    return grid.join(found, ["date", "attraction"], "left").select(
        "date", "ord", "attraction", F.coalesce("downtime_s", zero).alias("downtime_s"), F.coalesce("stops", zero).alias("stops")
    )


def _parts(c: str = "date") -> list[Column]:
    return [F.date_format(c, "yyyy-MM").alias("month"), F.weekofyear(c).alias("week")]


def _sums() -> list[Column]:
    return [F.sum("downtime_s").cast("long").alias("downtime_s"), F.sum("stops").cast("long").alias("stops")]


def totals(days: DataFrame, sets: list[list[str]], by: list[str]) -> DataFrame:
    """Sums over grouping sets of the columns ``by``."""
    keyed = days.select(*_parts(), "date", "attraction", "downtime_s", "stops")
    chosen = keyed.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in by))
    return chosen.agg(*_sums())


def day_totals(days: DataFrame) -> DataFrame:
    """By day: each attraction, and the park (attraction NULL)."""
    return totals(days, [["date", "attraction"], ["date"]], ["date", "attraction"])


def week_totals(days: DataFrame) -> DataFrame:
    """By ISO week, clipped to the month; last_date is the day on which the week is shown."""
    keyed = days.select(*_parts(), "date", "attraction", "downtime_s", "stops")
    grouped = keyed.groupBy("month", "week", "attraction")
    return grouped.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), *_sums())


def month_totals(days: DataFrame) -> DataFrame:
    """By month: each attraction, and the park."""
    return totals(days, [["month", "attraction"], ["month"]], ["month", "attraction"])


def ledger_totals(days: DataFrame) -> DataFrame:
    """All subtotal levels in one pass (D10); level names the period, attraction NULL is the park."""
    keyed = days.select(*_parts(), "date", "attraction", "downtime_s", "stops")
    names = ["month", "week", "date", "attraction"]
    sets = [["month", "week", "date"], ["month", "week"], ["month"]]
    sets = [s + ["attraction"] for s in sets] + sets
    bits = F.grouping_id(*names).alias("g")
    out = keyed.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in names)).agg(bits, *_sums())
    level = F.when(F.col("g").bitwiseAND(F.lit(2)) == 0, "day").when(F.col("g").bitwiseAND(F.lit(4)) == 0, "week").otherwise("month")
    return out.select(level.alias("level"), *names, "downtime_s", "stops")


def ledger(grid: DataFrame, incidents: DataFrame, hours: DataFrame) -> DataFrame:
    """The month in long form (D11): kind 0 opening, 1 incident slots, 2 closing, 3 day total,
    4 week total, 5 month total; rows sort by (date, kind, slot, ord)."""
    none = F.lit(None).cast("long")
    numbered = slots(incidents.join(grid.select("date", "attraction"), ["date", "attraction"], "left_semi"))
    height = numbered.groupBy("date").agg(F.max("day_slots").alias("n"))
    frame = grid.join(height, "date", "left").select("date", "ord", "attraction", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)))).alias("slot"))
    span = F.when(complete(), downtime_s(F.col("stop_s"), F.col("start_s")))
    filled = frame.join(numbered.select("date", "attraction", "slot", "stop_s", "start_s"), ["date", "attraction", "slot"], "left")
    days = on_spine(grid, incidents)
    weeks, months = week_totals(days), month_totals(days).where("attraction is not null")
    order = grid.select("attraction", "ord").distinct()
    last = F.last_day(F.to_date(F.concat("month", F.lit("-01"))))

    def rows(df: DataFrame, kind: int, **columns: Column) -> DataFrame:
        base = {"slot": F.lit(0), "stop_s": none, "start_s": none, "downtime_s": none, "stops": none, "clock": F.lit(None).cast("string")} | columns
        return df.select("date", F.lit(kind).alias("kind"), *(base[c].alias(c) for c in ("slot",)), "ord", "attraction", *(base[c].alias(c) for c in base if c != "slot"))

    edge = grid.join(hours, "date")
    total = {"downtime_s": F.col("downtime_s"), "stops": F.col("stops")}
    parts = [
        rows(edge, 0, clock=F.col("open")),
        rows(filled, 1, slot=F.col("slot"), stop_s=F.col("stop_s").cast("long"), start_s=F.col("start_s").cast("long"), downtime_s=span),
        rows(edge, 2, clock=F.col("close")),
        rows(days, 3, **total),
        rows(weeks.join(order, "attraction").withColumnRenamed("last_date", "date"), 4, **total),
        rows(months.join(order, "attraction").withColumn("date", last), 5, **total),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ledger_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """Four columns per attraction and two for the park (D12), all in one aggregate."""
    values = ("stop_s", "start_s", "downtime_s", "stops")
    cells = [F.max(F.when(F.col("attraction") == n, F.col(c))).alias(f"{n}_{c}") for n in names for c in values]
    return long.groupBy("date", "kind", "slot").agg(*cells, F.sum("downtime_s").alias("park_downtime_s"), F.sum("stops").alias("park_stops"))


def _summary(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("hours", hours_of(F.col("downtime_s"), digits)).withColumn("attraction", F.coalesce("attraction", F.lit(D.TOTAL_LABEL)))


def month_summary(days: DataFrame, digits: int = 2) -> DataFrame:
    """Hours, stops and total by month."""
    return _summary(month_totals(days), digits)


def week_summaries(days: DataFrame, digits: int = 2) -> DataFrame:
    """The same by week."""
    return _summary(totals(days, [["month", "week", "attraction"], ["month", "week"]], ["month", "week", "attraction"]), digits)


def chart_series(days: DataFrame, assets: DataFrame, digits: int = 2) -> DataFrame:
    """Month series in long form with the categories' order, the total last."""
    order = assets.select(F.col("name").alias("attraction"), "ord")
    n = month_summary(days, digits).join(order, "attraction", "left")
    return n.select("month", F.coalesce("ord", F.lit(1 << 30)).cast("long").alias("ord"), "attraction", "hours", "stops")


def normative(hours: DataFrame) -> DataFrame:
    """Scheduled seconds by month of (date, open, close)."""
    span = F.pmod(strict_clock(F.col("close")) * 60 - strict_clock(F.col("open")) * 60, F.lit(DAY))
    return hours.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum(span).cast("long").alias("normative_s"))


def month_ratio(days: DataFrame, planned: DataFrame) -> DataFrame:
    """The park's downtime by the scheduled time of one asset."""
    park = days.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("downtime_s").cast("long").alias("downtime_s"))
    return park.join(planned, "month").withColumn("ratio", F.try_divide("downtime_s", "normative_s"))
