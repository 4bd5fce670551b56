"""Queries of notice preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from haltbook.functions import timecols as t
from haltbook.operators import notices as n
from haltbook.operators import pages
from haltbook.plans.register import collector
from haltbook.plans.views import LOG, NOTICES, log, notices, table

QUERIES, ORACLES, query = collector()

KEYS = ["chat_key", "pos"]
MONTHS = "['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря']"


@query("s2_index", f"with {NOTICES} select chat_key, pos, (row_number() over (partition by chat_key, date order by pos))::int as message_index from notices")
def s2_index(spark, sf_dir):
    return n.index_notices(notices(spark, sf_dir)).select(*KEYS, "message_index")


@query("m1_squash", r"select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from conversations")
def m1_squash(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.squash(F.col("text")).alias("text"))


@query(
    "m2_chat_key",
    r"""with p as (select page_id, trim(url) as u, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) as origin, regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) as path,
 regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) as q, regexp_extract(url, '(#.*)$', 1) as h from pages)
 select page_id, case when origin = '' then u else lower(origin) || case when path not in ('', '/') then path when length(h) > 1 then h when length(q) > 1 then q else '/' end end as chat_key from p""",
)
def m2_chat_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.chat_key(F.col("url")).alias("chat_key"))


@query(
    "m3_clock",
    f"with {LOG} select seq, case when seq % 24 < 24 and seq % 7 > 0 then lpad((seq % 24)::varchar, 2, '0') || ':' || lpad((seq % 60)::varchar, 2, '0') else 'at ' || (seq % 24) || 'h' end as clock from log",
)
def m3_clock(spark, sf_dir):
    h, m = (F.col("seq") % 24).cast("string"), F.lpad((F.col("seq") % 60).cast("string"), 2, "0")
    raw = F.when(F.col("seq") % 7 > 0, F.concat(F.lit("  about "), h, F.lit(":"), m, F.lit(" or so"))).otherwise(F.concat(F.lit("at  "), h, F.lit("h")))
    return log(spark, sf_dir).select("seq", t.clock(raw).alias("clock"))


@query("m4_label", f"with {LOG} select seq, case when seq % 6 = 5 then null when seq % 6 = 4 then date - 1 else date end as day from log")
def m4_label(spark, sf_dir):
    d = F.col("date")
    months = F.array(*map(F.lit, ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]))
    words = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(months, F.month(d)), F.year(d).cast("string"))
    k = F.col("seq") % 6
    label = F.when(k == 0, F.date_format(d, "dd.MM.yyyy")).when(k == 1, F.date_format(d, "d/M/yyyy")).when(k == 2, F.date_format(d, " d.M ")).when(k == 3, words)
    label = label.when(k == 4, "Вчера").otherwise("31.02")
    return log(spark, sf_dir).select("seq", t.label_date(label, d).alias("day"))


BLOCKS = f"{NOTICES}, blocks as (select *, case when (pos + length(chat_key)) % 3 = 0 then strftime(date, '%d.%m.%Y') end as label, case when pos % 2 = 1 then '' else '2023-05-0' || (pos % 9 + 1) end as own from notices)"


def blocks(spark, sf_dir):
    head = (F.col("pos") + F.length("chat_key")) % 3 == 0
    own = F.when(F.col("pos") % 2 == 1, " ").otherwise(F.concat(F.lit("2023-05-0"), (F.col("pos") % 9 + 1).cast("string")))
    return notices(spark, sf_dir).withColumns({"label": F.when(head, F.date_format("date", "dd.MM.yyyy")), "own": own})


CARRIED = BLOCKS + ", c as (select *, last_value(case when label is not null then date end ignore nulls) over (partition by chat_key order by pos rows between unbounded preceding and current row) as carried_date from blocks)"


@query("m5_carry", f"with {CARRIED} select chat_key, pos, carried_date from c where label is null")
def m5_carry(spark, sf_dir):
    return n.carry_dates(blocks(spark, sf_dir), F.lit("2024-01-01").cast("date")).select(*KEYS, "carried_date")


@query("m6_own_date", f"with {CARRIED} select chat_key, pos, coalesce(nullif(own, ''), strftime(carried_date, '%Y-%m-%d')) as message_date from c where label is null")
def m6_own_date(spark, sf_dir):
    return n.resolve_date(n.carry_dates(blocks(spark, sf_dir), F.lit("2024-01-01").cast("date")), ["own"]).select(*KEYS, "message_date")


@query(
    "m7_body",
    r"""with p as (select conv_id, turn, unnest(string_split(text, chr(10))) as part, generate_subscripts(string_split(text, chr(10)), 1) as i from conversations),
 q as (select conv_id, turn, trim(regexp_replace(part, '\s+', ' ', 'g')) as part, i from p), r as (select *, row_number() over (partition by conv_id, turn order by length(part) desc, i) as k from q where part <> '')
 select conv_id, turn, part as text from r where k = 1 and length(part) >= 2""",
)
def m7_body(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("author"), F.lit("10:00").alias("time"), F.split("text", "\n").alias("parts"), F.col("text").alias("full_text"))
    return n.pick_body(c).select("conv_id", "turn", "text")


DOUBLE = f"{NOTICES}, doubled as (select * from notices union all select chat_key, pos + 100, author, text, date, time from notices where pos % 2 = 0)"


def doubled(spark, sf_dir):
    base = notices(spark, sf_dir)
    return base.unionByName(base.where("pos % 2 = 0").withColumn("pos", F.col("pos") + 100))


@query("m8_dedup", f"with {DOUBLE}, r as (select *, row_number() over (partition by chat_key, date, time, text order by pos) as k from doubled) select chat_key, pos, date, time, text from r where k = 1")
def m8_dedup(spark, sf_dir):
    return n.dedup_notices(doubled(spark, sf_dir)).select(*KEYS, "date", "time", "text")


@query("m9_range", f"with {NOTICES} select chat_key, pos, date from notices where date >= '2024-01-05' and date <= '2024-01-20'")
def m9_range(spark, sf_dir):
    return n.in_range(notices(spark, sf_dir), "2024-01-05", "2024-01-20").select(*KEYS, "date")


@query("m10_order", f"with {NOTICES} select chat_key, pos, date, time from notices order by date, time, pos")
def m10_order(spark, sf_dir):
    return n.order_notices(notices(spark, sf_dir)).select(*KEYS, "date", "time")


@query("m11_coverage", f"with {NOTICES} select chat_key, count(distinct date) as days, min(date) as first_day, max(date) as last_day from notices group by 1")
def m11_coverage(spark, sf_dir):
    return n.coverage(notices(spark, sf_dir))


@query("m12_instant", f"with {NOTICES} select chat_key, pos, strftime(date, '%Y-%m-%d') || ' ' || time as instant from notices")
def m12_instant(spark, sf_dir):
    at = t.instant(F.col("date").cast("string"), F.col("time"))
    return notices(spark, sf_dir).select(*KEYS, F.date_format(at, "yyyy-MM-dd HH:mm").alias("instant"))


@query(
    "m13_blocks",
    r"""with p as (select page_id, regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1) as a, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) as b from pages),
 c as (select page_id, case when len(a) > 0 then a when len(b) >= 3 then b end as x from p) select page_id, (generate_subscripts(x, 1) - 1)::int as pos, unnest(x) as raw from c""",
)
def m13_blocks(spark, sf_dir):
    return pages.page_blocks(table(spark, sf_dir, "pages")).select("page_id", "pos", "raw")


APPEND = f"""with {DOUBLE}, store as (select * from notices where pos % 4 = 0), batch as (select *, row_number() over (partition by chat_key, date, time, trim(regexp_replace(text, '\\s+', ' ', 'g')) order by pos) as k from doubled),
 fresh as (select * from batch b where k = 1 and not exists (select 1 from store s where s.chat_key = b.chat_key and s.date = b.date and s.time = b.time and s.text = trim(regexp_replace(b.text, '\\s+', ' ', 'g')))),
 halves as (select chat_key, 0 as added from store union all select chat_key, 1 from fresh)"""


@query("s14_append", APPEND + " select chat_key, sum(added)::bigint as added, count(*) as total from halves group by 1")
def s14_append(spark, sf_dir):
    return n.append_notices(notices(spark, sf_dir).where("pos % 4 = 0"), doubled(spark, sf_dir))[1]


@query("s14_rows", APPEND + " select chat_key, pos, date, time, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from fresh")
def s14_rows(spark, sf_dir):
    return n.append_notices(notices(spark, sf_dir).where("pos % 4 = 0"), doubled(spark, sf_dir))[0].select(*KEYS, "date", "time", "text")


@query("a10_days", f"with {NOTICES}, d as (select *, dense_rank() over (order by date) as k from notices) select chat_key, pos, date from d where k <= 7")
def a10_days(spark, sf_dir):
    return n.select_days(notices(spark, sf_dir), limit=7).select(*KEYS, "date")


@query("c1_transcript", f"with {NOTICES} select chat_key, date, string_agg(trim(time || ' ' || text), chr(10) order by pos) as transcript from notices group by all")
def c1_transcript(spark, sf_dir):
    return n.transcripts(notices(spark, sf_dir))


@query(
    "c2_chunk",
    f"""with {NOTICES}, i as (select *, row_number() over (partition by chat_key, date order by pos) as m from notices)
 select chat_key, date, ((m - 1) // 3)::int as chunk, min(m)::int as first_index, max(m)::int as last_index, string_agg(trim('#' || m || '. ' || time || ' ' || text), chr(10) order by m) as transcript from i group by chat_key, date, (m - 1) // 3""",
)
def c2_chunk(spark, sf_dir):
    return n.chunk(notices(spark, sf_dir), 3)
