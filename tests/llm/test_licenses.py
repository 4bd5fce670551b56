import random
import re

import pytest

from haltbook.llm import licenses
from haltbook.llm.licenses import Automaton, Scanner, blocks_of, words_in


def words_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def base_by_hand(text):
    ws = words_by_hand(text)
    places = [(i, label) for label, p in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places}))


def test_automaton_matches_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        a = Automaton(seqs)
        text = [rng.randrange(4) for _ in range(60)]
        v = run = 0
        for i, t in enumerate(text):
            while v and t not in a.next[v]:
                v = a.link[v]
                run = a.length[v]
            if t in a.next[v]:
                v, run = a.next[v][t], run + 1
            want = max(n for n in range(i + 2) if n == 0 or any(text[i + 1 - n : i + 1] == s[j : j + n] for s in seqs for j in range(len(s))))
            assert run == want
            if run:
                cut = text[i + 1 - run : i + 1]
                assert a.places(v) == sorted((k, j + run) for k, s in enumerate(seqs) for j in range(len(s) - run + 1) if s[j : j + run] == cut)


TEXTS = [
    None, "", " \n", "Licensed under CC BY-NC 4.0.", "MIT LICENSE mit license", "gnu general public license", "the GNU General\nPublic\x7fLicense, apache-license",
    "xmit license mit licensex", "mit éa license ÀMIT license", "cc cc by by", "GNU general GNU general public license public license", "apache\x00license",
]


def test_base_on_random_texts(spark):
    rng = random.Random(2)
    pool = "gnu general public license apache cc by mit Mit LICENSE é 4 0 the under x".split() * 2 + [".", "-", "\n", "\x01", "—"]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(pool) for _ in range(rng.randrange(200)))) for i in range(150)] + [(None, TEXTS[4]), (1, TEXTS[4])]
    docs = spark.createDataFrame([(i, t, "l") for i, t in rows], "doc_id long, text string, labels string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_documents(docs, block=64).collect())
    want = sorted((str(i), *base_by_hand(t)) for i, t in rows)
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
    assert licenses.scan_documents(docs.limit(0)).count() == 0
    for r in licenses.scan_documents(docs).collect():
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) and (r.score == 1.0) >= (r.n_base > 0)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_blocks_cut_no_word(size):
    text = ("Ünder the mit-license, " + "x" * 200 + "  gnu\tgeneral public license é").encode() * 3
    import pyarrow as pa

    assert [w for b in blocks_of(pa.py_buffer(text), size) for w in b] == words_in(text)
    whole = Scanner().scan(iter([words_in(text)]))
    assert Scanner().scan(blocks_of(pa.py_buffer(text), size)) == whole and len(whole.places) == 6


def labels(text, **settings):
    s = Scanner(**settings)
    return s.labels(s.scan(iter([words_in(text.encode())])))[1]


def test_templates_with_edits():
    bsd = next(t for k, t in licenses.TEMPLATES if k == "bsd")
    ws = bsd.split()
    assert labels("a b " + bsd + " c d") == ["bsd"]
    assert labels(" ".join(ws[:9] + ["indeed", "so"] + ws[9:])) == ["bsd"]  # words put in
    assert labels(" ".join(ws[:7] + ws[9:])) == ["bsd"]  # words left out
    assert labels(" ".join(ws[10:] + ws[:10])) == []  # not in the template's order
    assert labels(" ".join(ws[:10] + ["x"] * 40 + ws[10:])) == []  # too far apart
    assert labels(" ".join(ws[:6])) == []  # too little of it
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by", "cc-by-nc"]
    for label, t in licenses.TEMPLATES:
        assert label in labels("so " + t + " it is") and Scanner().scan(iter([words_in(t.encode())])).best == 1.0


def test_clean_prose_has_no_label():
    assert labels("The terms of this work are free, and any person may use it in the hope that it will help; the source form is new.") == []


def test_spans_and_long_texts(spark):
    n = 3000
    text = ("foo bar. " + licenses.TEMPLATES[11][1] + " ") * n
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "the mit license")], "doc_id long, text string")
    found = licenses.license_spans(docs).collect()
    spans = [r for r in found if r.doc_id == 1]
    assert {(r.label, r.kind, r.n_words, r.score) for r in spans} == {("bsd", "template", 21, 1.0)}
    assert [r.first_word for r in sorted(spans, key=lambda r: r.first_word)] == [2 + 23 * i for i in range(n)]
    assert [(r.doc_id, r.label, r.kind, r.first_word) for r in found if r.doc_id != 1] == [(4, "mit", "base", 1)]
