"""Queries of asset matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from haltbook.operators import assets as a
from haltbook.plans.register import collector
from haltbook.plans.views import table

QUERIES, ORACLES, query = collector()

#: Assets named after words of part names.
RIDES = [(1, "ring", "ring / small ring", ["rings"]), (2, "bolt", "bolt / big bolt", ["blue b", "widget"]), (3, "widget", "widget", []), (4, "gear", "gear / red gear", ["gr"])]
RIDE_SQL = "rides as (select * from (values " + ", ".join(f"({o}, '{n}', '{f}', {x}::varchar[])" for o, n, f, x in RIDES) + ") t(ord, name, full_name, aliases))"
NAME_SQL = RIDE_SQL + ", nm as (select ord, name, unnest([name, full_name] || aliases) as alias from rides)"
WORDS = [(1, "theat", "theat / oredat", []), (2, "onan", "onan", ["onani"]), (3, "stion", "stion", []), (4, "chten", "chten / pfen", [])]
WORD_SQL = "words as (select * from (values " + ", ".join(f"({o}, '{n}', '{f}', {x}::varchar[])" for o, n, f, x in WORDS) + """) t(ord, name, full_name, aliases)),
 w1 as (select ord, name, unnest([name, full_name] || aliases) as n from words), w2 as (select ord, name, n as alias from w1 union select ord, name, trim(p) from (select ord, name, unnest(string_split(n, '/')) as p from w1)),
 al as (select alias, arg_max(name, ord) as name from w2 where alias <> '' group by 1)"""
MARKERS, FOREIGN = ["idiot", "token ="], ["###"]


def rides(spark):
    return spark.createDataFrame(RIDES, "ord int, name string, full_name string, aliases array<string>")


def words(spark):
    return spark.createDataFrame(WORDS, "ord int, name string, full_name string, aliases array<string>")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("chat_key"), F.col("doc_id").alias("pos"), "text")


@query(
    "s5_assets",
    "select p_partkey::int as ord, trim(p_name) as name, case when p_size % 3 = 0 then trim(p_name) else p_brand end as full_name from part where p_size % 5 < 3",
)
def s5_assets(spark, sf_dir):
    flag = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, " Yes ").when(F.col("p_size") % 5 == 2, "да").when(F.col("p_size") % 5 == 3, "no").otherwise("0")
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("ord"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_brand")).alias("display"), flag.alias("include"))
    return a.load_assets(df)


@query(
    "a1_aliases",
    """with f as (select p_partkey as ord, p_brand as name, p_name || ' / ' || p_type as full_name from part), w1 as (select ord, name, unnest([name, full_name]) as n from f),
 w2 as (select ord, name, trim(n) as alias from w1 union all select ord, name, trim(p) from (select ord, name, unnest(string_split(n, '/')) as p from w1))
 select alias, max(ord) as ord, arg_max(name, ord) as name from w2 where alias <> '' group by 1""",
)
def a1_aliases(spark, sf_dir):
    return a.alias_table(part_assets(spark, sf_dir))


def part_assets(spark, sf_dir):
    full = F.concat("p_name", F.lit(" / "), "p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("name"), full.alias("full_name"), F.lit(None).cast("array<string>").alias("aliases"))


@query("a2_start_aliases", "select p_partkey as ord, p_brand as name, i::int as place, [p_brand, p_name][i + 1] as alias from part, range(2) r(i)")
def a2_start_aliases(spark, sf_dir):
    return a.start_aliases(part_assets(spark, sf_dir))


@query(
    "a3_normalize",
    f"""with {NAME_SQL}, hit as (select p_partkey, min(ord) as ord from part join nm on contains(lower(p_name), lower(alias)) or contains(lower(alias), lower(p_name)) group by 1)
 select p_partkey, coalesce(r.name, trim(p_name)) as attraction from part left join hit using (p_partkey) left join rides r on r.ord = hit.ord""",
)
def a3_normalize(spark, sf_dir):
    return a.normalize_asset(table(spark, sf_dir, "part"), "p_name", rides(spark)).select("p_partkey", "attraction")


@query("a4_match", f"with {RIDE_SQL}, p as (select p_partkey, upper(split_part(p_name, ' ', 2)) || ' ' as word from part) select p_partkey, ord from p left join rides on lower(trim(word)) = name")
def a4_match(spark, sf_dir):
    word = F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit(" "))
    return a.match_asset(table(spark, sf_dir, "part").select("p_partkey", word.alias("word")), "word", rides(spark)).select("p_partkey", "ord")


GLOBAL = "(contains(lower(text), 'idiot') or contains(lower(text), 'token =')) and not contains(lower(text), '###')"
MENTION = " or ".join(f"contains(lower(text), '{x}')" for x in ("theat", "theat / oredat", "oredat", "onan", "onani", "stion", "chten", "chten / pfen", "pfen"))


@query("a6_global", f"select doc_id, {GLOBAL} as is_global from documents")
def a6_global(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", a.is_global(F.col("text"), MARKERS, FOREIGN).alias("is_global"))


@query("a7_relevant", f"select doc_id as pos from documents where {MENTION} or ({GLOBAL})")
def a7_relevant(spark, sf_dir):
    return a.relevant(documents(spark, sf_dir), words(spark), MARKERS, FOREIGN).select("pos")


FRAGMENTS = f"""with {WORD_SQL}, f as (select doc_id as pos, text, name, alias, strpos(lower(text), lower(alias)) as loc from documents join al on contains(lower(text), lower(alias))),
 g as (select *, row_number() over (partition by pos order by loc, name, alias) as place, coalesce(lead(loc) over (partition by pos order by loc, name, alias), length(text) + 1) as stop from f),
 h as (select pos, place::int as place, name as attraction, regexp_replace(trim(name || substring(text, loc + length(alias), greatest(stop - loc - length(alias), 0)), ' .;'), '\\s+', ' ', 'g') as w from g),
 fr as (select pos, place, attraction, case when length(w) <= 180 then w when contains(left(w, 180), ' ') then regexp_replace(left(w, 180), ' [^ ]*$', '') else left(w, 180) end as fragment from h)"""


@query("a8_fragments", FRAGMENTS + " select * from fr")
def a8_fragments(spark, sf_dir):
    return a.fragments(documents(spark, sf_dir), words(spark)).select("pos", "place", "attraction", "fragment")


@query("a9_facts", FRAGMENTS + f" select pos, attraction as target_hint, fragment from fr union all select doc_id, 'Общее', text from documents where {GLOBAL} and not ({MENTION})")
def a9_facts(spark, sf_dir):
    return a.facts(documents(spark, sf_dir), words(spark), markers=MARKERS, foreign=FOREIGN).select("pos", "target_hint", "fragment")


@query("c4_lines", "select p_brand, p_size, string_agg(coalesce(nullif(trim(p_type), ''), p_name), chr(10) order by p_partkey) as lines from part group by 1, 2")
def c4_lines(spark, sf_dir):
    return a.asset_lines(table(spark, sf_dir, "part").select("p_brand", "p_size", F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("full_name")), ["p_brand", "p_size"])
