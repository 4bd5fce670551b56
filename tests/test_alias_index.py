"""Names in texts by the index, against comparing everything."""

import random

from pyspark.sql import functions as F

from haltbook.functions import timecols as t
from haltbook.operators import assets, events
from haltbook.operators.alias_index import containing


def naive(texts, names):
    return sorted((k, n) for k, t in texts for n in set(names) if t and n and n in t)


def pairs(spark, texts, names, few=0):
    got = containing(spark.createDataFrame(texts, "k long, __t string"), spark.createDataFrame([(n,) for n in names], "__a string"), ["k"], few=few)
    return sorted((r.k, r["__a"]) for r in got.collect())


def test_names_in_texts(spark):
    rng = random.Random(4)
    pool = ["ab", "abc", "bca", "é", "x", "cab a", "a  b", "b\tc", " ", "aé", "[.*]", "long word"]
    texts = [(i, "".join(rng.choice(pool) + rng.choice([" ", "", "\n", "  "]) for _ in range(rng.randrange(8)))) for i in range(120)] + [(900, None), (901, "")]
    names = ["".join(rng.choice(pool) + rng.choice([" ", "", ""]) for _ in range(rng.randrange(1, 4))) for _ in range(200)] + ["", None, "nowhere", " ", "a", "c"]
    wanted = [n for n in names if n and n.strip(" \t\n")]  # white space alone is no name
    assert pairs(spark, texts, names) == naive(texts, wanted)
    assert pairs(spark, texts, names, 500) == naive(texts, wanted)
    assert pairs(spark, texts, []) == [] and pairs(spark, [], ["a"]) == []


def test_a_hundred_thousand_aliases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.lit("c").alias("chat_key"), F.col("doc_id").alias("pos"), "text")
    made = spark.range(100_000).select((F.col("id") + 10).cast("int").alias("ord"), F.concat(F.lit("ride "), F.conv(F.col("id").cast("string"), 10, 36)).alias("name"))
    many = made.select("ord", "name", F.col("name").alias("full_name"), F.lit(None).cast("array<string>").alias("aliases"))
    few = spark.createDataFrame([(1, "theat", "theat / oredat", ["the th"]), (2, "onan", "onan", None)], many.schema)
    got = assets.relevant(docs, many.union(few))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    low = {r.pos: (r.text or "").lower() for r in docs.collect()}
    names = ["theat", "oredat", "the th", "onan", *(r.name.lower() for r in made.where("id < 2000").collect())]
    want = {p for p, x in low.items() if any(n in x for n in names)} | {r.pos for r in docs.where(assets.is_global(F.col("text"))).collect()}
    assert {r.pos for r in got.collect()} == want and want


def test_first_asset_either_way_round(spark):
    dim = spark.createDataFrame([(1, "Big Wheel", "Big Wheel / Wheel", ["wh"]), (2, "Dive", "Dive", None), (3, "Wheel", "Wheel", None)], "ord int, name string, full_name string, aliases array<string>")
    texts = ["wheel", "BIG", "diver", "dive wheel", "zzz", "", " \t", None, " Dive "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.attraction for r in assets.normalize_asset(df, "t", dim).orderBy("i").collect()]
    assert got == ["Big Wheel", "Big Wheel", "Dive", "Big Wheel", "zzz", "", "", "", "Dive"]
    loose = [r.attraction for r in assets.normalize_asset(df, "t", dim, guard_blank=False).orderBy("i").collect()]
    assert loose[5:8] == ["Big Wheel"] * 3


def test_notices_without_chat(spark):
    dim = spark.createDataFrame([(1, "Dive", "Dive", ["deep dive"])], "ord int, name string, full_name string, aliases array<string>")
    notices = spark.createDataFrame([(None, 1, "the Dive stands. Deep dive too"), ("a", 1, "none"), ("a", None, "dive")], "chat_key string, pos long, text string")
    assert sorted(str(r.pos) for r in assets.relevant(notices, dim).collect()) == ["1", "None"]
    got = sorted((str(r.pos), r.place, r.fragment) for r in assets.fragments(notices, dim).collect())
    assert got == [("1", 1, "Dive stands"), ("1", 2, "Dive too"), ("None", 1, "Dive")]
    facts = assets.facts(notices, dim, markers=["none"], foreign=["zzz"]).collect()
    assert sorted(r.fragment for r in facts) == ["Dive", "Dive stands", "Dive too", "none"]


def test_white_space_everywhere(spark):
    df = spark.createDataFrame([("  a b\t\n",), ("﻿",), (None,), ("x",)], "v string")
    got = df.select(t.strip(F.col("v")).alias("s"), t.blank_to_null(F.col("v")).alias("b")).collect()
    assert [(r.s, r.b) for r in got] == [("a b", "a b"), ("", None), (None, None), ("x", "x")]
    rows = spark.createDataFrame([("2024-01-01", 1, "STOP_UNPLANNED", "one two three")], "date string, message_index int, event_type string, quote string")
    notes = spark.createDataFrame([("2024-01-01", 1, " whole notice\n")], "date string, message_index int, text string")
    assert events.enrich_stops(rows, notes).first().quote == "whole notice"


def test_hours_are_rounded_on_integers(spark):
    df = spark.createDataFrame([(s,) for s in (0, 17, 18, 522, 3600, 5399, 1_999_998)], "s long")
    assert [r.h for r in df.select(t.hours_of(F.col("s")).alias("h")).collect()] == [0.0, 0.0, 0.01, 0.15, 1.0, 1.5, 555.56]
