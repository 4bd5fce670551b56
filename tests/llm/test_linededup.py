import random
import re

from pyspark.sql import functions as F

from haltbook.llm import linededup

LAST = linededup.LAST_ID


def words(line):
    return frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)) if w)


def slow(rows, t=0.8, least=5):
    """(exact, similar) line numbers by id, from all pairs."""
    firsts, places = {}, []
    for d, text in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        for i, line in enumerate(text.split("\n") if text is not None else []):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
            if len(words(line)) >= least:
                key = (LAST if d is None else d, i)
                firsts[low] = min(firsts.get(low, key), key)
                places.append((d, i, key, low))
    listed = [(k, words(x), x) for x, k in firsts.items()]
    similar = {x for k, s, x in listed if any(j < k and len(s & r) >= t * len(s | r) - 1e-9 for j, r, _ in listed)}
    out = {d: (set(), set()) for d, _ in rows}
    for d, i, key, low in places:
        if key > firsts[low]:
            out[d][0].add(i)
        elif low in similar:
            out[d][1].add(i)
    return out


def compare(got, rows):
    wanted = slow(rows)
    for r in got:
        exact, similar = wanted[r.doc_id]
        assert (set(r.exact_lines), set(r.similar_lines)) == (exact, similar), r.doc_id


def test_random_lines(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "a"] * 5

    def line():
        return [rng.choice(vocab) for _ in range(rng.randint(3, 16))]

    pool = [line() for _ in range(40)]
    rows = []
    for d in range(120):
        own = []
        for _ in range(rng.randint(0, 5)):
            x = list(rng.choice(pool)) if rng.random() < 0.6 else line()
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = rng.choice(vocab)
            own.append(" ".join(x))
        rows.append((d * 7 % 121, "\n".join(own)))
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, exact_lines long")
    got = linededup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    compare(got, rows)
    compare(linededup.dedup_lines(docs, leaders=1, hot=2).collect(), rows)
    compare(linededup.dedup_lines(docs, hot=8).collect(), rows)


def test_edges(spark):
    long_line = " ".join(f"v{i}" for i in range(3000))
    rows = [(5, None), (4, ""), (3, "\n\n"), (2, "one two three four five\nONE two three four five\nshort line\nshort line"), (9, "five four three two one"),
            (None, "one two three four five\nnew words are in here now"), (7, long_line), (8, long_line + " v1"), (2, "one two three four five")]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, h string")
    got = linededup.dedup_lines(docs).collect()
    assert len(got) == len(rows) and linededup.dedup_lines(docs).columns[:3] == ["doc_id", "text", "h"]
    by = {(r.doc_id, r.text) for r in got}
    assert (5, None) in by and (4, "") in by and (3, "\n\n") in by
    assert (2, "one two three four five\nshort line\nshort line") in by and (2, "one two three four five") in by
    assert (9, "") in by and (None, "new words are in here now") in by and (7, long_line) in by and (8, "") in by
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(linededup.dedup_lines(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_near_copies_of_words_in_middle_numbers(spark, monkeypatch):
    """Lines of a word that up to ``hot`` lines post meet its first lines, not each other."""
    seen, stored = [], linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda df, name, *rest: (out := stored(df, name, *rest), seen.append((name, out.count())))[0])
    shared = [f"s{i}" for i in range(12)]
    rows = [(i, " ".join([*shared, f"own{i}"])) for i in range(200)] + [(900 + k, " ".join([w] * 300)) for k, w in enumerate(shared)]
    rows += [(1000 + i, " ".join([*shared[:6], *(f"x{j % 7}" for j in range(i, i + 5))])) for i in range(20)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), hot=250).collect()
    compare(got, rows)
    assert dict(seen)["mild"] > 200 and sum(n for name, n in seen if name in ("pairs", "others")) < 2000


def test_texts_are_cut_once(spark, monkeypatch):
    """Lines are stored with their distinct words, which rarity, postings and sets are read from."""
    seen, stored = {}, linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda df, name, *rest: seen.setdefault(name, stored(df, name, *rest)))
    text = "B b\ta  É\x0bc \r\nİ É b"
    linededup.Corpus(spark.createDataFrame([(1, text)], "doc_id long, text string"), 0.8, 1, "doc_id", "text", True, 100)
    got = {r.line_no: r for r in seen["lines"].collect()}
    assert [len(got[i].words) for i in (0, 1)] == [len(words(x)) for x in text.split("\n")] == [4, 3]
    assert len(set(got[0].words) & set(got[1].words)) == 2


def test_words_of_most_lines_are_met_in_twos(spark, monkeypatch):
    """Lines of words that more than ``hot`` lines have post two words at once; no posting of one such word is kept."""
    seen, stored = [], linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda df, name, *rest: (out := stored(df, name, *rest), seen.append((name, out.count())))[0])
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(rng.sample(vocab, 12))) for i in range(600)]  # each word in some 36 lines
    rows += [(1000 + i, " ".join([*rows[i][1].split()[1:], "new"])) for i in range(20)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), hot=10).collect()
    compare(got, rows)
    assert sum(len(r.similar_lines) for r in got) == 20 and sum(n for name, n in seen if name in ("met", "crowded", "mild", "heavy", "keyed", "rest")) < 2500


def test_shuffle_files_go_with_their_query(spark):
    """A written table leaves no shuffle files until the driver collects its garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    kept = linededup.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert files() <= before and kept.count() == 7
