"""Statistics of a year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltbook.functions.timecols import hours_of
from haltbook.plans.report import asset_days


def year_matrix(incidents: DataFrame, year: int, assets: DataFrame) -> DataFrame:
    """Downtime and stops of 12 months by asset, zero where nothing happened."""
    of_year = incidents.where(F.col("date").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")))
    found = asset_days(of_year).groupBy(F.month("date").alias("month"), "attraction").agg(
        F.sum("downtime_s").cast("long").alias("d"), F.sum("stops").cast("long").alias("n")
    )
    months = assets.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    grid = months.join(assets.select("ord", F.col("name").alias("attraction")), how="cross")
    zero = F.lit(0).cast("long")
    return grid.join(found, ["month", "attraction"], "left").select(
        "month", "ord", "attraction", F.coalesce("d", zero).alias("downtime_s"), F.coalesce("n", zero).alias("stops")
    )


def matrix_wide(matrix: DataFrame, names: list[str]) -> DataFrame:
    """One downtime column per asset."""
    return matrix.groupBy("month").pivot("attraction", names).agg(F.sum("downtime_s"))


def year_totals(matrix: DataFrame) -> DataFrame:
    """Cells, row totals, column totals and the year, by NULL keys (Y2)."""
    return matrix.cube("month", "attraction").agg(F.sum("downtime_s").cast("long").alias("downtime_s"), F.sum("stops").cast("long").alias("stops"))


def year_summary(matrix: DataFrame, exclude: str) -> DataFrame:
    """Downtime and stops of the year, with and without one asset."""
    other = F.lower("attraction") != exclude.lower()
    return matrix.agg(
        F.sum("downtime_s").cast("long").alias("downtime_s"),
        F.sum("stops").cast("long").alias("stops"),
        F.sum(F.when(other, F.col("downtime_s")).otherwise(0)).cast("long").alias("other_downtime_s"),
        F.sum(F.when(other, F.col("stops")).otherwise(0)).cast("long").alias("other_stops"),
    )


def year_ratio(matrix: DataFrame, planned: DataFrame) -> DataFrame:
    """Downtime by the scheduled time of all assets (Y4); planned is (month, normative_s)."""
    total = planned.agg(F.sum("normative_s").cast("long").alias("normative_s"))
    used = matrix.agg(F.sum("downtime_s").cast("long").alias("downtime_s"), F.countDistinct("attraction").alias("assets"))
    whole = (F.col("normative_s") * F.col("assets")).cast("long")
    return used.join(total, how="cross").select("downtime_s", whole.alias("normative_s"), F.try_divide("downtime_s", whole).alias("ratio"))


def year_series(matrix: DataFrame) -> DataFrame:
    """Chart tables (Y5): downtime hours by month and asset, stops by asset (month NULL)."""
    hours = matrix.select("month", "attraction", hours_of(F.col("downtime_s")).alias("hours"), F.lit(None).cast("long").alias("stops"))
    stops = matrix.groupBy("attraction").agg(F.sum("stops").cast("long").alias("stops"))
    return hours.unionByName(stops.select(F.lit(None).cast("int").alias("month"), "attraction", F.lit(None).cast("double").alias("hours"), "stops"))
