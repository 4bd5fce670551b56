import random
import re
from collections import Counter
from math import log

from haltbook.llm import label_model, quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def slow(text):
    t = text or ""
    words = [w for w in SPACE.split(t) if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if SPACE.sub("", x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


CASES = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "a a a a a a", "one\ntwo\none\n\n \n \nthree two\none", "x\x1cy z\x85w",
         "#1 $ <b> é|ü 日本 " * 9, "w " * 5000 + "end", "the same five words here then the same five words here again " * 3]


def compare(got, texts):
    for r in got:
        want = slow(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r
        assert not (r.base_failed and r.kept)


def test_counts(spark):
    texts = dict(enumerate(CASES)) | {None: "alone"}
    rows = [(i, t, True) for i, t in texts.items()] + [(3, CASES[3], True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    compare(got, texts)
    assert quality.judge(docs.limit(0)).count() == 0


def test_label_model():
    """Two good labelers and one whose votes say nothing: the weights tell."""
    patterns = [((1, 1, 1), 800), ((1, 1, 0), 800), ((-1, -1, 1), 90), ((-1, -1, 0), 90), ((1, 0, 1), 10), ((-1, 0, 0), 10)]
    start, weights = label_model.fit(patterns)
    assert start > 1 and weights[0][1] - weights[0][-1] > 5 and abs(weights[2][1] - weights[2][0]) < 0.5
    assert label_model.fit([]) == (0.0, [])


def test_given_documents(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.judge(docs).collect()
    compare(got, {r.doc_id: r.text for r in docs.collect()})
    kept = {r.doc_id: r.kept for r in got}
    pairs = Counter((r.quality, kept[r.doc_id]) for r in labels.collect())
    print(pairs)
    assert pairs[1, True] / (pairs[1, True] + pairs[1, False]) > 0.95
    assert pairs[0, False] / (pairs[0, True] + pairs[0, False]) > 0.9


def test_known_reliabilities():
    """Independent rules: the estimated chances are the true ones; a copy of a rule does not count twice."""
    rng = random.Random(9)
    against = [(0.15, 0.8), (0.1, 0.6), (0.05, 0.7), (0.15, 0.5), (0.1, 0.75)]  # of good and of bad rows
    rows = []
    for _ in range(20_000):
        good = rng.random() < 0.7
        rows.append((good, tuple(-1 if rng.random() < a[not good] else rng.choice((0, 1)) for a in against)))
    start, weights = label_model.fit(list(Counter(v for _, v in rows).items()))
    for (g, b), w in zip(against, weights, strict=True):
        assert abs(w[-1] - (log(g) - log(b))) < 0.35
    said = [start + sum(w[x] for w, x in zip(weights, v, strict=True)) > 0 for _, v in rows]
    assert abs(sum(said) / len(rows) - 0.7) < 0.05
    assert sum(s == good for s, (good, _) in zip(said, rows, strict=True)) / len(rows) > 0.9
    once = [s for s, (_, v) in zip(said, rows, strict=True) if v.count(-1) == 1]
    assert sum(once) / len(once) > 0.5  # one negative vote alone seldom decides
    twice = [(good, (*v, v[0])) for good, v in rows]
    start, weights = label_model.fit(list(Counter(v for _, v in twice).items()))
    both = weights[0][-1] + weights[5][-1]
    assert abs(both - (log(0.15) - log(0.8))) < 0.6
    said = [start + sum(w[x] for w, x in zip(weights, v, strict=True)) > 0 for _, v in twice]
    assert sum(s == good for s, (good, _) in zip(said, twice, strict=True)) / len(rows) > 0.9


def test_a_kind_that_one_rule_sees():
    """Kind A is seen by two rules, kind B by one alone."""
    rng = random.Random(5)
    rows = []
    for _ in range(30_000):
        kind = rng.choices("GAB", [0.85, 0.1, 0.05])[0]
        hits = {"G": (0.05, 0.05, 0.05), "A": (0.8, 0.8, 0.05), "B": (0.05, 0.05, 0.9)}[kind]
        rows.append((kind, tuple(-1 if rng.random() < h else rng.choice((0, 1)) for h in hits)))
    models = label_model.fit_kinds(list(Counter(v for _, v in rows).items()))
    assert len(models) == 2

    def kept(v):
        return all(label_model.odds_of(m, v) > 0 for m in models)

    share = {k: sum(kept(v) for g, v in rows if g == k) / sum(g == k for g, _ in rows) for k in "GAB"}
    print(share)
    assert share["B"] < 0.2 and share["A"] < 0.4 and share["G"] > 0.85


def test_rules_that_never_object():
    patterns = [((1, 1, 0), 500), ((-1, -1, 0), 50), ((1, 0, 1), 200)]
    models = label_model.fit_kinds(patterns)
    assert len(models) == 1 and label_model.odds_of(models[0], (1, 1, 0)) > 0 > label_model.odds_of(models[0], (-1, -1, 0))
