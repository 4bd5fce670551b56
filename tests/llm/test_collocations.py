import random
import re
from collections import Counter

import duckdb
import pytest

from haltbook.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_hand(rows, longest=3, least=10, held=50, top=2000):
    """Every phrase of every piece, counted in dictionaries."""
    counts = {}
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        rows = []
        for p, a in candidates.items():
            inside = [v for q, v in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * v >= held * a for v in inside):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((" ".join(p), a, left, right, n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "b", "ç", "Ä", "dd", "e", "\x1c", "zé", "\U0001f600", "—"]
    gaps = [" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "\x0b", "\x0c", ";", "!?"]
    return [(rng.choice(["en", "fr", None]), "".join(w for _ in range(rng.randrange(60)) for w in (rng.choice(words), rng.choice(gaps)))) for _ in range(n)]


@pytest.mark.parametrize("settings", [{}, {"longest": 4, "least": 3, "block": 50, "most": 1}, {"least": 2, "filter_bits": 1 << 15, "top": 7}, {"longest": 2, "least": 5}])
def test_against_brute_force(spark, settings):
    rows = texts(1, 80) + [("en", None), (None, None), ("en", ""), ("xx", " .,")]
    docs = spark.createDataFrame([(1, lang, t, "w1") for lang, t in rows], "doc_id long, lang string, text string, words string").repartition(5)
    got = rows_of(collocations.collocations(docs, **settings))
    assert got == by_hand(rows, **{k: v for k, v in settings.items() if k not in ("block", "filter_bits", "most")})
    assert got


def test_ties_repeats_and_empties(spark):
    rows = [("en", "p q. q p, p q; x y z! x y z")] * 12
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = rows_of(collocations.collocations(docs))
    assert got == by_hand(rows)
    assert [r[2] for r in got] == ["x y z", "p q", "q p"]
    for none in ([], [("en", None)], [(None, "a b. c")]):
        assert rows_of(collocations.collocations(spark.createDataFrame(none, "lang string, text string"))) == []


def test_a_long_text_without_piece_ends(spark):
    rows = [("en", " ".join(str(i % 997) for i in range(200_000)))]
    got = rows_of(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), top=None))
    assert len(got) == 997 and {r[3] for r in got} == {200, 201} and all(len(r[2].split()) == 3 for r in got)


def test_colliding_words_take_another_seed(spark, monkeypatch):
    real = collocations.occurrences

    def colliding(batches, block, seed):
        for b in real(batches, block, seed):
            if seed == 0 and b.column(0)[0].as_py() == 1:
                b = b.set_column(b.schema.get_field_index("h"), "h", collocations.pa.array([7] * len(b), collocations.pa.int64()))
            yield b

    monkeypatch.setattr(collocations, "occurrences", colliding)
    rows = texts(3, 40)
    assert rows_of(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=3)) == by_hand(rows, least=3)


def test_sql_on_small_tables(spark, tmp_path):
    path = "/root/testdata/sf0.001/documents.parquet"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        want = sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({collocations.oracle_sql()})").fetchall())
    assert rows_of(collocations.collocations(spark.read.parquet(path))) == want


def test_blocks_are_read_a_few_at_once(spark, monkeypatch):
    """The relation is read and sent to Python in few rows, however many a file has; the session's settings are as before."""
    keys = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, real = [spark.conf.get(k) for k in keys], [], collocations.stored

    def watched(df, name, **more):
        if name == "phrases" or (name == "occurrences" and not more):
            seen.append([int(spark.conf.get(k)) for k in keys])
        return real(df, name, **more)

    monkeypatch.setattr(collocations, "stored", watched)
    rows = texts(5, 200)
    assert rows_of(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), block=10)) == by_hand(rows)
    assert seen == [[collocations.ROWS_AT_ONCE] * 2] * 3
    assert [spark.conf.get(k) for k in keys] == before
