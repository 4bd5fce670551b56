import zlib

import numpy as np

from haltbook.llm import toxicity as t


def weigh(text, lexicon):
    read = [lexicon.read(x) for x in t.TOKEN.findall(text.lower())]
    return t.clause_features([x for x in read if x[0]], t.grammar(), len(read))


def test_clauses():
    lex = t.Lexicon({"idio": 2.0}, {"scum": 1.0})
    plain, aimed, denied, quoted = (weigh(x, lex)[0] for x in ("an idiot", "you idiot", "not an idiot", "she said an idiot"))
    assert plain == 2.0 and aimed == 3.0 and denied < plain and quoted < aimed
    assert weigh("not now. idiot", lex)[0] == 2.0  # negation ends with its clause
    assert weigh("you will kill it", lex)[0] > weigh("will kill it", lex)[0] > 0
    assert weigh("nothing here", lex) == [0.0] * 4
    assert weigh("idiot. scum", lex)[0] == 2.0 and weigh("idiot scum", lex)[0] == 3.0


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "total idiot", "x"), (3, "word " * 60_000, "x"), (3, "word", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = t.toxicity(docs, none).collect()
    assert len(got) == len(rows) and all(r.predicted == 0 and 0 <= r.score < 0.01 for r in got)
    odd = spark.createDataFrame([(None, 1), (1, None), (5, 1), (1, 0), (1, 0)], "doc_id long, toxic int")
    assert t.toxicity(docs, odd).count() == len(rows)
    assert t.toxicity(docs.limit(0), odd).count() == 0


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in t.toxicity(docs, labels).collect()}
    held = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    s, y = np.array(held).T
    order = s.argsort().argsort()
    auc = (order[y == 1].mean() - order[y == 0].mean()) / len(y) + 0.5
    hit, said = (s >= 0.3) & (y == 1), s >= 0.3
    print("AUC", auc, "precision", hit.sum() / said.sum(), "recall", hit.sum() / (y == 1).sum())
    assert auc > 0.95 and hit.sum() / said.sum() > 0.9 and hit.sum() / (y == 1).sum() > 0.9


def test_logistic_on_separable_features():
    """Separable classes must not make the fit run away: later, stronger evidence scores higher."""
    rng = np.random.default_rng(3)
    y = (rng.random(4_000) < 0.1).astype(float)
    x = np.where(y[:, None] > 0, rng.gamma(3, 2, (4_000, 4)) + 1, 0.0)
    x[:, 2] = x[:, 1] * 2
    w, _ = t.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert (w[1:] >= 0).all() and (p[y == 1] >= 0.3).all() and (p[y == 0] < 0.1).all()


def slow_features(text, lexicon, aimed=1.5, denied=0.4, quoted=0.6, aimless=0.3):
    """The clause scores read off the rules, clause by clause, without machines."""
    tokens = t.TOKEN.findall(text.lower())
    clauses, now, hits = [], [], 0
    for token in [*tokens, "."]:
        kind, weight = lexicon.read(token)
        if kind != t.BREAK:
            now.append((kind, weight))
            continue
        seen, own = {k for k, _ in now}, 0.0
        for k, w in now:
            if k in (t.INSULT, t.THREAT):
                hits += 1
                factor = aimless if k == t.THREAT and t.TARGET not in seen else 1.0
                for of, by in ((t.TARGET, aimed), (t.NEGATION, denied), (t.REPORT, quoted)):
                    factor *= by if of in seen else 1.0
                own += w * factor
        clauses += [own] if own else []
        now = []
    if not clauses:
        return [0.0] * 4
    size = len(tokens) + 20
    return [max(clauses), *np.log1p([100 * sum(clauses) / size, 100 * sum(c * c for c in clauses) / size, 100 * hits / size])]


def test_both_ways():
    lex = t.Lexicon({"idio": 2.0, "kil": 1.7}, {})
    score = {x: weigh(x, lex)[0] for x in ("i will kill you", "kill the lights", "you will be killed", "idiot, you", "an idiot", "idiot, he said", "stable killers")}
    assert score["i will kill you"] == score["you will be killed"] > 4 * score["kill the lights"] > 0
    assert score["idiot, you"] == 3.0 > score["an idiot"] == 2.0 and score["idiot, he said"] < 3.0
    assert lex.read("stable") == (t.OTHER, 0.0) and lex.read("killed") == (t.THREAT, 1.7) and t.Lexicon({}, {}).read("killing") == (t.THREAT, 1.0)


def test_factors_follow_the_labels(spark):
    """Where only aimed insults are labelled, aiming weighs more than its first factor."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(1200):
        bad = k % 4 == 0
        filler = " ".join(rng.choice(["plain", "word", "text", "here"], 12))
        insult = f"{'you' if bad else 'some'} grubling" if k % 4 < 2 else "nothing"
        rows.append((k, f"{filler}. {insult} {filler}."))
        labels.append((k, int(bad)))
    model = t.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), odds=0.3)
    assert model.factors.get("aimed") == 2.5
    aimed, other = model.score(["text. you grubling here.", "text. some grubling here."])
    assert aimed > other


def test_against_plain_clauses(spark):
    """All given documents: the composed transducer gives what a plain reading of the clauses gives."""
    lex = t.Lexicon({"idio": 2.0, "scu": 1.0, "mor": 1.5}, {"the": 0.5, "of": 0.25})
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rng = np.random.default_rng(2)
    words = [*t.THREATS[:4], *t.TARGETS[:4], *t.NEGATIONS[:3], *t.REPORTS[:3], "idiot", "scum", "plain", ".", "!", "\n"]
    texts += [" ".join(rng.choice(words, 30)) for _ in range(500)] + ["", None]
    got = t._features(texts, lex, [t.grammar()], t.Generations(1000))
    want = np.array([slow_features(x or "", lex) for x in texts])
    assert np.allclose(got, want) and (got[:, 0] > 0).sum() > 500
