"""Views on the given tables that the registered queries start from, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltbook.operators.pairing import GENERAL, INFO, START, STOP, TEST

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
YEAR, MONTH = 1997, "1997-03"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled events of six rides, four to a notice."""
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "error", STOP)
        .when(F.col("event_type") == "view", TEST)
        .when(F.col("event_type") == "purchase", START)
        .when((F.col("event_type") == "signup") & (F.col("user_id") % 10 == 0), GENERAL)
        .otherwise(INFO)
    )
    second = (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("long")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.to_date("ts").alias("date"),
        F.col("event_id").alias("event_seq"),
        F.floor(F.col("event_id") / 4).cast("int").alias("message_index"),
        F.when(~((F.col("event_type") == "view") & (F.col("event_id") % 10 == 0)), second).alias("time_s"),
        F.concat(F.lit("ride_"), (F.col("user_id") % 6).cast("string")).alias("attraction"),
        kind.alias("event_type"),
        F.concat(F.lit("r"), k).alias("reason"),
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("quote"),
    )


SIGNALS = """signals as (select cast(ts as date) as date, event_id as event_seq, cast(event_id // 4 as int) as message_index,
 case when event_type = 'view' and event_id % 10 = 0 then null else cast(extract(hour from ts) * 3600 + extract(minute from ts) * 60 as bigint) end as time_s,
 'ride_' || (user_id % 6) as attraction,
 case event_type when 'error' then 'STOP_UNPLANNED' when 'view' then 'TEST_RUN' when 'purchase' then 'START'
  when 'signup' then case when user_id % 10 = 0 then 'START_GENERAL' else 'INFO' end else 'INFO' end as event_type,
 'r' || json_extract_string(props, '$.k') as reason, 'q' || event_id as quote from events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop log from orders."""
    o = table(spark, sf_dir, "orders")
    stop = (F.col("o_orderkey") * 37) % 86400
    start = F.when(F.col("o_orderkey") % 20 == 0, stop).when(F.col("o_orderstatus") != "P", (F.col("o_custkey") * 101) % 86400)
    return o.select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("attraction"), stop.alias("stop_s"), start.alias("start_s"))


LOG = """log as (select cast(o_orderdate as date) as date, o_orderkey as seq, o_orderpriority as attraction, (o_orderkey * 37) % 86400 as stop_s,
 case when o_orderkey % 20 = 0 then (o_orderkey * 37) % 86400 when o_orderstatus <> 'P' then (o_custkey * 101) % 86400 end as start_s from orders)"""


def assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(PRIORITIES)], "ord int, name string")


ASSETS = "assets as (select * from (values " + ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(PRIORITIES)) + ") t(ord, name))"


def month_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where(F.date_format("date", "yyyy-MM") == MONTH)


def year_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where(F.year("date") == YEAR)


YEAR_LOG = LOG + f", ylog as (select * from log where year(date) = {YEAR})"
#: Downtime and stops of complete incidents by date and attraction.
OF_DAYS = """, dlog as (select *, case when stop_s is not null and start_s is not null then ((start_s - stop_s) % 86400 + 86400) % 86400 end as d from ylog),
 adays as (select date, attraction, coalesce(sum(d), 0)::bigint as downtime_s, count(d) as stops from dlog group by all)"""
DAYS = LOG + ", ylog as (select * from log)" + OF_DAYS
YEAR_DAYS = YEAR_LOG + OF_DAYS


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("chat_key"),
        F.col("turn").alias("pos"),
        F.col("role").alias("author"),
        "text",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias("date"),
        F.concat(F.lpad((F.lit(9) + F.col("turn")).cast("string"), 2, "0"), F.lit(":00")).alias("time"),
    )


NOTICES = """notices as (select cast(conv_id as varchar) as chat_key, turn as pos, role as author, text, (date '2024-01-01' + cast(conv_id % 30 as int)) as date,
 lpad(cast(9 + turn as varchar), 2, '0') || ':00' as time from conversations)"""


def schedule(days: DataFrame) -> DataFrame:
    """First days of months open from 10:00 to 20:00."""
    first = days.where(F.dayofmonth("date") == 1).select("date").distinct()
    return first.select("date", F.lit(1).alias("row"), F.lit("10:00").alias("open"), F.lit("20:00").alias("close"))
