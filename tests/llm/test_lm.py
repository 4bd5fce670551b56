import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from haltbook.llm import lm


def slow(rows):
    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [""]

    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(h, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for (_, t), h in zip(rows, held, strict=True)]


def compare(got, rows):
    wanted = {}
    for (d, _), w in zip(rows, slow(rows), strict=True):
        wanted.setdefault(d, []).append(w)
    assert len(got) == len(rows)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4])) for w in wanted[r.doc_id])
        assert r.score <= 0


def test_normalised():
    """Probabilities of all targets after any two sum to one, and so do those of all words and the unknown
    ones of each class."""
    rng = np.random.default_rng(1)
    own, targets = 5, 9
    listed = [b"w%d" % i for i in range(30)]
    place = {w: i for i, w in enumerate(listed)}
    count = np.arange(60, 30, -1)
    kind = np.array([i if i < targets else targets + lm.class_of(w.decode()) for i, w in enumerate(listed)])
    tokens, types = np.zeros(targets + lm.SHARED), np.zeros(targets + lm.SHARED)
    np.add.at(tokens, kind, count)
    np.add.at(types, kind, 1)
    words = lm.Words(place, kind, count, own, targets, int(count.sum()), 30, 0.5, tokens, types)
    n, near = targets + lm.SHARED, own + lm.SHARED
    m = lm.Bilinear(*(rng.normal(0, 0.5, s).astype("f4") for s in ((near, 4), (n, 4), (2, 4, 4), (n,))))
    s = lm.Scorer(words, m, lm.normalisers(m, np.arange(near), block=64))
    for a, b in ((0, 1), (7, 7), (300, 2)):
        chance = [10 ** s.log10(np.array([a, b, w])) for w in range(n)]
        assert sum(chance) == pytest.approx(1, abs=1e-4)
        inside = words.inside()
        known = sum(chance[k] * 10 ** i for k, i in zip(kind, inside, strict=True))
        unknown = sum(chance[targets + k] * (0.5 * types[targets + k] / tokens[targets + k] if tokens[targets + k] else 1) for k in range(lm.SHARED))
        assert known + unknown == pytest.approx(1, abs=1e-4)


def test_edges(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "A a b", "é É ñ", "x " * 20_000, "only here", "A a b"])] + [(None, "a b"), (2, "A a b")]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    compare(lm.score_documents(docs).collect(), rows)
    compare(lm.score_documents(docs, own=2, frequent=3).collect(), rows)
    assert lm.score_documents(docs.limit(0)).count() == 0
    alone = [(3, "held out text")]  # nothing to learn from
    assert zlib.crc32(b"3") % 5 == 1
    compare(lm.score_documents(spark.createDataFrame(alone, "doc_id long, text string")).collect(), alone)


def test_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score_documents(docs, frequent=2_000).collect()
    compare(got, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    base, score, n = (sum(getattr(r, k) for r in held) for k in ("base_score", "score", "n_tokens"))
    print(base / n, score / n)
    assert score / n > base / n + 0.1


def test_whole_model(spark, monkeypatch):
    """The defaults train 32 values a vector against 64 noise samples, in batches of 4,096; all words of a
    small vocabulary (here three and the end) are targets."""
    seen, train = [], lm.train

    def watched(docs, words, size, noise, *rest):
        model = train(docs, words, size, noise, *rest)
        seen.append((noise, model.context.shape, model.target.shape))
        return model

    monkeypatch.setattr(lm, "train", watched)
    lm.score_documents(spark.createDataFrame([(2, "a b c"), (4, "a b d")], "doc_id long, text string"))
    assert seen == [(64, (1536 + lm.SHARED, 32), (5 + lm.SHARED, 32))]
    share = np.full(4, 0.25)
    assert lm.Trainer(lm.Bilinear.start(share, 3, 2), share, np.zeros(4, int), 0.1, 2).batch == 4096
