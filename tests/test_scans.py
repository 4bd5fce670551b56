"""Numbers, carried values and epochs of keys of any size, against plain loops."""

import random
from collections import Counter
from datetime import date

from pyspark.sql import functions as F

from haltbook.operators import model_io, notices, pairing, scans
from haltbook.operators.pairing import GENERAL, START, STOP, TEST
from haltbook.sources import tables


def test_numbers_of_a_skewed_key(spark):
    rng = random.Random(1)
    rows = [("a", p, rng.random()) for p in rng.sample(range(-50, 5000), 900)] + [("b", 3, 0.1), ("b", 3, 0.2), (None, 1, 0.0), ("b", None, 0.5)]
    df = spark.createDataFrame(rows, "k string, p long, x double").repartition(4)
    got = scans.number_rows(df, ["k"], "p", "n", ["x"], size=16)
    want = {}
    for k in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            want[r] = n
    assert {(r.k, r.p, r.x): r.n for r in got.collect()} == want and got.columns == ["k", "p", "x", "n"]


def test_no_task_holds_a_key(spark):
    """A chat of many blocks: every exchange deals its rows over blocks."""
    df = spark.range(200_000).select(F.lit("c").alias("chat_key"), F.col("id").alias("pos"), F.when(F.col("id") % 50_000 == 7, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 50_000).cast("int"))).alias("v"))
    got = scans.carry_last(df, ["chat_key"], "pos", "v", "last").withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = got.groupBy("task").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 60_000
    counts = Counter(r.last for r in got.select("last").collect())
    assert counts == {None: 7, date(2024, 1, 1): 50_000, date(2024, 1, 2): 50_000, date(2024, 1, 3): 50_000, date(2024, 1, 4): 49_993}


def test_carried_values(spark):
    rng = random.Random(2)
    rows = [(k, p, rng.choice([None, None, None, rng.randrange(9)])) for k in ("a", None) for p in rng.sample(range(2000), 300)]
    got = scans.carry_last(spark.createDataFrame(rows, "k string, p long, v int").repartition(3), ["k"], "p", "v", "last", size=8)
    want, last = {}, {}
    for k, p, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        last[k] = v if v is not None else last.get(k)
        want[k, p] = last[k]
    assert {(r.k, r.p): r["last"] for r in got.collect()} == want


def test_many_general_starts_give_the_same_incidents(spark):
    rng = random.Random(3)
    rows = [
        (date(2024, 1, 1 + (k % 7 == 0)), rng.randrange(400), k, 60 * rng.randrange(1440), rng.choice("abc"), rng.choice([STOP, STOP, START, TEST, GENERAL]))
        for k in range(3000)
    ] + [(None, 1, 5000, 60, "a", STOP), (None, 2, 5001, 120, None, GENERAL)]
    events = spark.createDataFrame(rows, "date date, message_index int, event_seq long, time_s long, attraction string, event_type string").repartition(5)
    columns = ["date", "attraction", "incident", "stop_s", "start_s", "n_stops", "closed_by"]

    def found(few):
        return sorted(map(str, (tuple(r[c] for c in columns) for r in pairing.pair_incidents(events, few=few).collect())))

    assert found(0) == found(5000)


def test_chunks_keep_their_numbers(spark):
    n = spark.createDataFrame([("c", p, date(2024, 1, 1), "10:00", f"t{p}") for p in range(0, 20_000, 3)], "chat_key string, pos long, date date, time string, text string")
    got = notices.chunk(n, 100).orderBy("chunk").collect()
    assert [(r.chunk, r.first_index, r.last_index) for r in got] == [(k, 100 * k + 1, min(100 * k + 100, 6667)) for k in range(67)]
    assert got[66].transcript.startswith("#6601. 10:00 t19800\n")


def test_a_poisoned_chunk_is_a_reject(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def fn(row):
        with open(calls, "a") as f:
            f.write(f"{row['k']}\n")
        if row["k"] == 2:
            raise ValueError("poison")
        return [{"message_index": row["k"], "event_type": "INFO", "quote": "é"}] * row["k"]

    chunks, path = spark.createDataFrame([(0,), (1,), (2,), (3,)], "k int").coalesce(1), str(tmp_path / "kept")
    events, rejects = model_io.extract_events(chunks, fn, ["k"], 2, path)
    assert sorted((r.k, r.event_pos, r.message_index, r.quote) for r in events.collect()) == [(1, 0, 1, "é"), (3, 0, 3, "é"), (3, 1, 3, "é"), (3, 2, 3, "é")]
    assert [(r.k, r.error) for r in rejects.collect()] == [(2, "ValueError: poison")]
    assert Counter(open(calls).read().split()) == {"0": 1, "1": 1, "2": 2, "3": 1}
    more = chunks.union(spark.createDataFrame([(4,)], "k int"))
    assert model_io.extract_events(more, fn, ["k"], 2, path)[0].count() == 8
    assert Counter(open(calls).read().split()) == {"0": 1, "1": 1, "2": 2, "3": 1, "4": 1}
    again = model_io.extract_events(more, lambda row: [], ["k"], 2, path, again=True)
    assert again[0].count() == 8 and again[1].count() == 0


def test_fragments_of_a_large_day(spark):
    rows = spark.range(2500).select(F.lit(date(2024, 1, 1)).alias("date"), F.col("id").alias("pos"), F.concat(F.lit('t"'), "id").alias("text"))
    none = spark.createDataFrame([], "date date, event_seq long")
    got = tables.fragments({"messages": (rows, "pos"), "events": (none, "event_seq")}).orderBy("piece").collect()
    assert [(r.part, r.piece, r.first, r["last"]) for r in got] == [("messages", 0, 0, 999), ("messages", 1, 1000, 1999), ("messages", 2, 2000, 2499)]
    import json

    assert [x["text"] for r in got for x in json.loads(r.entries)] == [f't"{k}' for k in range(2500)]


def test_day_documents_keep_their_run(spark):
    d = date(2024, 1, 1)
    runs = spark.createDataFrame([(d, "m-1", "say", "{}")], "date date, model string, prompt string, raw_model string")
    one = spark.createDataFrame([(d, 1)], "date date, pos long")
    doc = tables.day_docs(one, one.withColumnRenamed("pos", "event_seq"), one.withColumnRenamed("pos", "incident"), runs=runs).first()
    assert (doc.model, doc.prompt, doc.raw_model, doc.n_rows) == ("m-1", "say", "{}", 1)
