"""Versions of a stop log and the store of notices."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from haltbook.operators.pairing import START, STOP
from haltbook.sources import manifest
from haltbook.streaming import live, notice_store

MONTHS = [(2024, m, 1) for m in range(1, 6)]


def log_of(spark, rows):
    return spark.createDataFrame([(date(*d), k) for d, k in rows], "date date, seq long")


def seqs(spark, root, **chosen):
    return sorted(r.seq for r in manifest.read_log(spark, root, **chosen).collect())


def files_of(root):
    return {os.path.join(at, f) for at, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def test_untouched_months_keep_their_files(spark, tmp_path):
    root = str(tmp_path)
    manifest.commit(log_of(spark, [(d, k) for k, d in enumerate(MONTHS)] + [((2024, 2, 9), 9)]), root)
    before = files_of(root)
    v = manifest.commit(log_of(spark, [((2024, 2, 1), 20), ((2023, 7, 1), 30)]), root, log_of(spark, [((2024, 2, 1), 0), ((2024, 3, 1), 0)]).select("date"))
    assert v.number == 1 and before <= files_of(root)
    first, second = manifest.versions(spark, root)
    assert {m for m in first.months if second.months.get(m) == first.months[m]} == {"2024-01", "2024-04", "2024-05"}
    assert seqs(spark, root) == [0, 3, 4, 9, 20, 30] and seqs(spark, root, version=0) == [0, 1, 2, 3, 4, 9]
    assert seqs(spark, root, month="2024-02") == [9, 20] and seqs(spark, root, year=2023) == [30] and seqs(spark, root, month="2024-03") == []
    read = manifest.read_log(spark, root, month="2024-02").inputFiles()
    assert read and all("month=2024-02" in f for f in read)


def test_old_versions_expire_and_a_dead_writer_harms_nothing(spark, tmp_path):
    root = str(tmp_path)
    manifest.commit(log_of(spark, [(d, k) for k, d in enumerate(MONTHS)]), root)
    for k in range(6):
        manifest.commit(log_of(spark, [((2024, 1, 1), 100 + k)]), root, log_of(spark, [((2024, 1, 1), 0)]).select("date"), keep=2)
    assert [v.number for v in manifest.versions(spark, root)] == [5, 6] and seqs(spark, root) == [1, 2, 3, 4, 105]
    assert len({f.split("/month=")[0] for f in files_of(root) if "month=2024-01" in f}) == 2
    log_of(spark, [((2024, 1, 1), 666)]).withColumn("month", F.lit("2024-01")).write.partitionBy("month").parquet(f"{root}/data/v=dead")
    assert seqs(spark, root) == [1, 2, 3, 4, 105]
    with pytest.raises(manifest.Conflict):
        manifest.Files(spark, root).put("versions/000000000006", "{}")
    assert seqs(spark, root) == [1, 2, 3, 4, 105] and not [n for n in os.listdir(root) if n.startswith("aside")]
    empty = manifest.commit(log_of(spark, []), root)
    assert empty.months == {} and seqs(spark, root) == [] and manifest.read_log(spark, root).columns == ["date", "seq"]
    with pytest.raises(ValueError):
        manifest.read_log(spark, root, version=0)


def test_a_batch_that_comes_again(spark, tmp_path):
    rows = [(date(2024, 1, 1), k, k, 60 * k, "a", kind) for k, kind in enumerate([STOP, START, STOP])] + [(date(2024, 3, 1), 9, 9, 600, "b", STOP)]
    events = spark.createDataFrame(rows, "date date, message_index int, event_seq long, time_s long, attraction string, event_type string")
    root = str(tmp_path)
    sink = live.refresh_sink(lambda: events, root, ["date", "attraction", "incident", "stop_s", "start_s"], stream="s")
    sink(events, 0)
    sink(events.where("event_seq = 9"), 1)
    got = manifest.versions(spark, root)
    sink(events.where("event_seq = 9"), 1)
    sink(events.limit(0), 2)
    assert manifest.versions(spark, root) == got and [v.batch for v in got] == [0, 1]
    assert sorted((r.attraction, r.stop_s, r.start_s) for r in manifest.read_log(spark, root).collect()) == [("a", 0, 60), ("a", 120, None), ("b", 600, None)]


NOTICES = "chat_key string, pos long, date date, time string, text string"


def test_notices_of_any_age_get_in_once(spark, tmp_path):
    path = str(tmp_path / "store")
    day, old = date(2024, 5, 1), date(2019, 1, 1)
    one = [("a", 1, day, "10:00", "x"), ("a", 2, day, "10:00", " x "), (None, 3, None, None, "y"), ("a", 4, day, "10:01", " ")]
    two = [("a", 5, day, "10:00", "x"), ("a", 6, old, "10:00", "late"), ("b", 7, day, "10:00", "x"), (None, 8, None, None, "y")]
    sink = notice_store.store_sink(path, 8)
    for k, rows in enumerate([one, two, two, one, []]):
        sink(spark.createDataFrame(rows, NOTICES), k)
    sink(spark.createDataFrame([("c", k, day, "10:00", f"n{k}") for k in range(300)], NOTICES), 9)
    sink(spark.createDataFrame([("c", k, day, "10:00", f"n{k}") for k in range(301)], NOTICES), 0)
    store = notice_store.read_store(spark, path)
    assert sorted(r.pos for r in store.where("coalesce(chat_key, '') <> 'c'").collect()) == [1, 3, 6, 7]
    assert sorted(r.pos for r in store.where("chat_key = 'c'").collect()) == list(range(301))
    notice_store.compact_store(spark, path, str(tmp_path / "packed"))
    packed = notice_store.read_store(spark, str(tmp_path / "packed"))
    assert packed.count() == 305 and len(packed.inputFiles()) == 8
    assert notice_store.new_notices(packed, spark.createDataFrame(one + two, NOTICES), 8).count() == 0


def test_a_small_batch_reads_its_buckets_only(spark, tmp_path):
    path = str(tmp_path)
    notice_store.store_sink(path, 32)(spark.createDataFrame([("c", k, None, None, f"n{k}") for k in range(1000)], NOTICES), 0)
    new = notice_store.new_notices(notice_store.read_store(spark, path), spark.createDataFrame([("c", 1, None, None, "n5")], NOTICES), 32)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert new.count() == 0 and "PartitionFilters: [isnotnull(bucket" in plan and "key_hash" in plan.split("PushedFilters")[1]
