"""Hand fixtures and properties that the given tables cannot show."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from haltbook import defaults as D
from haltbook.functions import causes, repair
from haltbook.functions import timecols as t
from haltbook.operators import assets, events, model_io, notices, pairing
from haltbook.plans import report
from haltbook.sources import manifest, tables

S, R, T, G, I = "STOP_UNPLANNED", "START", "TEST_RUN", "START_GENERAL", "INFO"


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def sequential(rows, cuts):
    """The pairing rules one event at a time."""
    out, open_ = [], {}
    for kind, asset, time in rows:
        if kind == S:
            row = open_.get(asset)
            if row is not None and row["start"] is None:
                row["n"] += 1
                continue
            open_[asset] = {"asset": asset, "stop": time, "start": None, "n": 1}
            out.append(open_[asset])
        elif kind == T and asset in open_ and open_[asset]["start"] is None:
            open_[asset]["start"] = time
        elif kind == R and asset in open_:
            open_.pop(asset)["start"] = time
        elif kind == G:
            for a in list(open_):
                open_.pop(a)["start"] = time
    return sorted((r["asset"], r["stop"], r["start"], r["n"]) for r in out)


def frame(spark, days):
    rows = [(date(2024, 1, 1 + d), i, i, None if time is None else time, asset, kind) for d, rows in enumerate(days) for i, (kind, asset, time) in enumerate(rows)]
    return spark.createDataFrame(rows, "date date, message_index int, event_seq long, time_s long, attraction string, event_type string")


def test_pairing_against_one_event_at_a_time(spark):
    rng = random.Random(7)
    days = []
    for _ in range(28):
        rows = []
        for k in range(rng.randint(0, 30)):
            kind = rng.choice([S, S, R, T, T, I] + [G] * (rng.random() < 0.3))
            rows.append((kind, rng.choice("abc") if kind != G else "", None if kind == T and rng.random() < 0.4 else 60 * k))
        days.append(rows)
    got = pairing.pair_incidents(frame(spark, days).repartition(5)).collect()
    for d, rows in enumerate(days):
        own = sorted((r.attraction, r.stop_s, r.start_s, r.n_stops) for r in got if r.date.day == d + 1)
        assert repr(own) == repr(sequential(rows, None)), rows


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(S, "a", 60), (R, "a", 120)], [("a", 60, 120, 1)]),
        ([(S, "a", 60), (S, "a", 90), (R, "a", 120)], [("a", 60, 120, 2)]),
        ([(S, "a", 60), (T, "a", 90), (R, "a", 120)], [("a", 60, 120, 1)]),
        ([(S, "a", 60), (T, "a", 90), (S, "a", 120)], [("a", 60, 90, 1), ("a", 120, None, 1)]),
        ([(S, "a", 60), (T, "a", None), (S, "a", 120)], [("a", 60, None, 2)]),
        ([(R, "a", 60), (T, "a", 90)], []),
        ([(S, "a", 60), (S, "b", 70), (G, "", 100), (S, "a", 110)], [("a", 60, 100, 1), ("a", 110, None, 1), ("b", 70, 100, 1)]),
        ([(S, "a", 60), (R, "a", 70), (G, "", 100)], [("a", 60, 70, 1)]),
    ],
)
def test_pairing_cases(spark, rows, want):
    got = pairing.pair_incidents(frame(spark, [rows])).collect()
    assert sorted(((r.attraction, r.stop_s, r.start_s, r.n_stops) for r in got), key=repr) == sorted(want, key=repr)


def test_clocks_and_dates(spark):
    texts = ["9:05", "09.05", "25:10", "до 18:30", "", "--:--", None]
    assert column(spark, texts, t.parse_clock) == [545, 545, None, 1110, None, None, None]
    assert column(spark, texts, t.strict_clock) == [545, None, None, None, None, None, None]
    assert column(spark, texts, t.clock)[:4] == ["09:05", "09.05", "25:10", "18:30"]
    labels = ["Сегодня", "вчера", "5 июня", "5 июня 2025", "05.06", "05.06.25", "5/6/2025", "31.02", "чушь", ""]
    day = F.lit("2026-07-10").cast("date")
    want = [date(2026, 7, 10), date(2026, 7, 9), date(2026, 6, 5), date(2025, 6, 5), date(2026, 6, 5), date(2025, 6, 5), date(2025, 6, 5), None, None, None]
    assert column(spark, labels, lambda c: t.label_date(c, day)) == want
    assert column(spark, [(85800, 600), (600, 600), (600, None)], lambda c: t.downtime_s(c["a"], c["b"]), "struct<a:long,b:long>") == [1200, 0, None]
    urls = ["https://a.b/c?d#e", "https://a.b/#x", "https://a.b?q=1", "https://A.b", " ", "no url", None]
    assert column(spark, urls, t.chat_key) == ["https://a.b/c", "https://a.b#x", "https://a.b?q=1", "https://a.b/", "__global__", "no url", "__global__"]
    assert column(spark, ["/x/06.2026.json", "/06.2025/2026-07 x.json", "/a.json"], t.month_from_path) == ["2026-06", "2026-07", None]


def test_causes(spark):
    rows = [
        ("Стоп из-за дождя, механик", ""), ("Ребёнок упал, стоп, вызвали механика", ""), ("Стоп по просьбе", ""), ("Астродром стоп, ошибка датчика, прошу закрыть", ""),
        ("Стоп", "замена колеса"), ("Внеплановый стоп. Механик в пути", "внеплановый стоп"), ("внеплан", "стоп аттракциона"), (None, None),
    ]
    df = spark.createDataFrame([(i, q, r) for i, (q, r) in enumerate(rows)], "i int, q string, r string")
    got = [r.x for r in df.select("i", causes.stop_cause(F.col("q"), F.col("r"), F.lit("")).alias("x")).orderBy("i").collect()]
    assert got == [None, None, None, "Ошибка датчика", "Замена колеса", "Внеплановый стоп", "Внеплановая техническая остановка", None]
    assert column(spark, ["  из-за сбоя связи. ", "по причине  ", "«Сбой»"], causes.clean_reason)[::2] == ["Сбоя связи", "Сбой"]


def test_repair(spark):
    right = "Авиатор остановлен, ждём механика"
    for codepage in ("cp1251", "cp866", "latin-1"):
        try:
            broken = right.encode().decode(codepage)
        except UnicodeDecodeError:
            continue
        markers = list({c for c in broken if c not in right})[:4]
        assert column(spark, [broken, right, "", None], lambda c, m=markers: repair.repair_best(c, markers=m)) == [right, right, "", None]
        assert column(spark, [broken], lambda c, m=markers, p=codepage: repair.repair(c, p, m)) == [right]
    assert column(spark, ["é Ð"], lambda c: repair.recode(c, "cp1251")) == [None]


def test_assets_and_global_notices(spark):
    dim = spark.createDataFrame([(1, "Лунный экспресс", "Лунный экспресс / Disko", ["Лунный экспересс"]), (2, "Торнадо", "Торнадо / Swinger", None)], "ord int, name string, full_name string, aliases array<string>")
    names = spark.createDataFrame([(1, "лунный экспересс"), (2, "аттракцион Торнадо стоп"), (3, "swinger"), (4, "о"), (5, "Неизвестный"), (6, "")], "i int, n string")
    got = {r.i: r.attraction for r in assets.normalize_asset(names, "n", dim).collect()}
    assert got == {1: "Лунный экспресс", 2: "Торнадо", 3: "Торнадо", 4: "Торнадо" if "о" not in "лунный экспресс" else "Лунный экспресс", 5: "Неизвестный", 6: ""}
    texts = ["Все аттракционы закрыты", "Все аттракционы: театр сказок", "Парк открыт", "Торнадо"]
    assert column(spark, texts, assets.is_global) == [True, False, True, False]
    rows = [("c", 1, "Торнадо стоп. Лунный экспресс в работе. В смене: Торнадо Иванов"), ("c", 2, "парк закрыт")]
    facts = assets.facts(spark.createDataFrame(rows, "chat_key string, pos long, text string"), dim).orderBy("pos", "target_hint").collect()
    assert [(r.target_hint, r.fragment) for r in facts] == [("Лунный экспресс", "Лунный экспресс в работе"), ("Торнадо", "Торнадо стоп"), (D.GENERAL_HINT, "парк закрыт")]


def test_rule_starts_and_future(spark):
    n = spark.createDataFrame([(1, 1, "10:00", "Торнадо снова в работе"), (1, 2, "11:00", "Завтра ремонт"), (1, 3, "12:00", "Торнадо (тест) готов к работе")], "date int, message_index int, time string, text string")
    e = spark.createDataFrame([(1, 3, "12:00", "Торнадо", R, "q"), (1, 2, "11:00", "Торнадо", S, "сегодня ремонт"), (1, 2, "11:00", "Торнадо", S, "ремонт"), (1, 9, "", "Торнадо", S, "нет")], "date int, message_index int, time string, attraction string, event_type string, quote string")
    alias = spark.createDataFrame([("Торнадо", "Торнадо"), ("Торнадо", "Торнадо (тест)")], "name string, alias string")
    found = events.rule_starts(e, n, alias).where("attraction_name is not null").collect()
    assert [(r.message_index, r.attraction, r.time) for r in found] == [(1, "Торнадо", "10:00")]
    assert sorted(r.quote for r in events.drop_future(e, n).collect()) == ["q", "нет", "сегодня ремонт"]


def test_model_output(spark):
    event = '{"message_index": 1, "event_type": "INFO", "quote": "q"}'
    raw = [f'{{"events": [{event}]}}', f"[{event}, 5]", '{"events": "[' + event.replace('"', '\\"') + ']"}', "broken", "{}", None]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    assert sorted(r.i for r in model_io.parse_events(df, "raw").collect() if r.quote == "q") in ([0, 1, 2], [0, 2])
    calls = {"n": 0}

    def shaky(row):
        calls["n"] += 1
        if calls["n"] == 1:
            raise RuntimeError("once")
        return [{"message_index": row["k"], "event_type": "INFO"}]

    chunks = spark.createDataFrame([(1,), (2,)], "k int").coalesce(1)
    assert [r.message_index for r in model_io.extract_events(chunks, shaky, ["k"])[0].collect()] == [1, 2]


def test_month_edges(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "ord int, name string")
    rows = [(date(2024, 12, 30), 1, "a", 0, 3600), (date(2024, 12, 31), 2, "zz", 0, 60), (date(2024, 12, 1), 3, "b", 10, 10), (date(2024, 12, 1), 4, "b", 10, None)]
    log = spark.createDataFrame(rows, "date date, seq long, attraction string, stop_s long, start_s long")
    days = report.on_spine(report.spine("2024-12", dim), log)
    assert days.count() == 62 and report.spine("2024-02", dim).count() == 58
    weeks = {(r.week, r.attraction): (r.first_date.day, r.last_date.day, r.downtime_s) for r in report.week_totals(days).collect()}
    assert weeks[1, "a"] == (30, 31, 3600) and weeks[48, "b"] == (1, 1, 0)
    level = {(r.level, r.attraction): 0 for r in report.ledger_totals(days).collect()}
    sums = {k: sum(r.downtime_s for r in report.ledger_totals(days).collect() if (r.level, r.attraction) == k) for k in level}
    assert sums["day", None] == sums["week", None] == sums["month", None] == 3600
    stops = {r.attraction: r.stops for r in report.month_totals(days).collect()}
    assert stops == {"a": 1, "b": 1, None: 2}
    assert {r.attraction: r.stops for r in report.asset_days(log, count_zero=False).collect()}["b"] == 0


def test_range_and_replace(spark, tmp_path):
    n = spark.createDataFrame([("c", 1, date(2024, 1, 1), "t"), ("c", 2, None, "t")], "chat_key string, pos long, date date, time string").withColumn("text", F.lit("x"))
    assert notices.in_range(n).count() == 2 and notices.in_range(n, end="2024-02-01").count() == 1
    with pytest.raises(ValueError):
        notices.in_range(n, "2024-02-01", "2024-01-01")
    log = spark.createDataFrame([(date(2024, 1, d), d) for d in (1, 2, 3)], "date date, seq long")
    manifest.commit(log, str(tmp_path / "log"))
    manifest.commit(log.where("seq = 2").withColumn("seq", F.lit(20).cast("long")), str(tmp_path / "log"), log.where("seq > 1").select("date"))
    assert sorted(r.seq for r in manifest.read_log(spark, str(tmp_path / "log")).collect()) == [1, 20]
    assert tables.write_quarantine(log.limit(0).withColumn("time", F.lit("")), str(tmp_path / "q")) is False


def test_white_space_of_chat_pages(spark):
    got = column(spark, ["\u00a0a\u00a0\u2003b\ufeff\n", "\u00a0", "x\ty", None], t.squash)
    assert got == ["a b", "", "x y", None]


def test_blank_reason_stays_blank(spark):
    """A model reason that cleans to nothing is not replaced by a default: E11 rejects it."""
    rules = causes.Rules(weather=["rain"], technical=["motor"], generic=["unknown"], patterns=[], visitors=[], phrases=[], prefix="^xx", tail="zz.*", default="Unknown cause")
    got = column(spark, ["...", "unknown", "belt torn"], lambda v: causes.stop_cause(F.lit("motor"), v, F.lit(""), rules))
    assert got == ["", "Unknown cause", "Belt torn"]


def test_empty_export(spark):
    none = spark.createDataFrame([], "chat_key string, pos long, date date, time string, text string")
    assert [r.value for r in tables.text_export(none, header=True).collect()] == [D.EMPTY_RANGE]
    assert [r.value for r in tables.text_export(none, "Say.").collect()] == ["# === PROMPT ===", "Say.", "", D.EMPTY_RANGE]
    one = spark.createDataFrame([("c", 0, date(2024, 1, 2), "09:00", "hi")], none.schema)
    assert [r.value for r in tables.text_export(one, header=True).collect()] == ["# === MESSAGES ===", "[2024-01-02 09:00] hi"]


def test_day_key_of_stored_events(spark):
    rows = spark.sql("select date'2024-01-02' as date, cast(array() as array<struct<event_seq:long>>) as raw_events, array(named_struct('event_seq', 5L)) as events union all select date'2024-01-03', array(named_struct('event_seq', 7L)), null")
    assert sorted((str(r.date), r.event_seq) for r in events.stored_events(rows).collect()) == [("2024-01-02", 5), ("2024-01-03", 7)]
