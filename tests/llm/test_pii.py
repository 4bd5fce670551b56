import hashlib
import random
import re

from pyspark.sql import functions as F

from haltbook.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def slow(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                  "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    out.sort()
    names = list(KINDS)
    counts = [sum(x[1] == k for x in out) for k in range(4)]
    return counts, [f"{names[k]}:{a}:{b}" for a, k, b in out]


CASES = [
    None, "", "a@b.c", "x a.b+c@d-e.f.g, q@r a@b.cd+e@f.g @@ a@b@c.d.e..f", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.0003.4 1.2.3",
    "4111 1111 1111 1111 4111111111111111 4111-1111-1111-1112 é4111111111111111日", "+1 (555) 123-4567. +12 +1(((((((( +44 20 7946 0958 0",
    "日本 mail: é@x.y jo@x.y", "1" * 5000, "a" * 5000 + "@" + "b" * 5000 + ".c", "a.b" * 3000, "+1" + " " * 3000 + "2", "1 " * 4000, "9.9.9." * 2000,
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "call (212) 555-0123 or jane [at] site [dot] org",
]


def compare(got, texts):
    for r in got:
        counts, spans = slow(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert not set(spans) - set(r.spans.split(","))


def test_cases(spark):
    rng = random.Random(3)
    texts = dict(enumerate(CASES)) | {100 + k: "".join(rng.choice("ab@.+- 1234567890()é\n") for _ in range(400)) for k in range(150)} | {None: "b@c.d"}
    rows = [(i, t, "s") for i, t in texts.items()] + [(2, CASES[2], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find_personal(docs).collect()
    assert len(got) == len(rows)
    compare(got, texts)
    assert pii.find_personal(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pii.find_personal(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    compare(got, texts)
    secrets = {r.doc_id for r in got if "secret:" in r.spans}
    hidden = {i for i, t in texts.items() if re.search(r'(?i)token = "[0-9a-f]{40}"', t or "")}
    assert hidden <= secrets


def test_mask(spark):
    docs = spark.createDataFrame([(1, "to a@b.c from +1 (555) 123-4567.", "x", None), (2, None, "x", None), (3, "é plain", "x", None)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert got == {1: "to <EMAIL> from <PHONE>.", 2: None, 3: "é plain"}
    assert pii.mask(docs).columns == docs.columns


def test_spans_grow_linearly(spark):
    """Four times the addresses take about four times as long, not sixteen times."""
    import time

    def seconds(n):
        text = "".join(f"user{i}@mail.example.org token {'ab12' * 8} " for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        base = docs.select(pii.base_spans(F.col("text")).alias("base"), pii.candidates(F.col("text")).alias("cand"))
        r = base.select(F.size("base").alias("n"), F.size(pii.without_overlaps(F.col("cand"), F.col("base"))).alias("free")).first()
        assert (r.n, r.free) == (n, n)
        return time.time() - start

    seconds(1000)
    few = seconds(10_000)
    assert seconds(40_000) < 8 * few + 2


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(n, [rng.randrange(100) for _ in range(n)]) for n in (0, 1, 127, 128, 129, 1000)]
    df = spark.createDataFrame(rows, "n int, v array<int>")
    got = df.select("n", pii.scanned(F.col("v"), F.lit(0), lambda x, y: x + y).alias("s"), pii.scanned(F.col("v"), F.lit(0), lambda x, y: F.greatest(x, y)).alias("m")).collect()
    for (n, v), r in zip(rows, sorted(got, key=lambda r: r.n), strict=True):
        assert r.s == [sum(v[: i + 1]) for i in range(n)] and r.m == [max(v[: i + 1]) for i in range(n)]


def test_masked_texts(spark):
    rng = random.Random(4)
    parts = ["a@b.cd ", "é日 text ", "1.2.3.4", "+1 (555) 123-4567 ", "4111 1111 1111 1111 ", "x" * 700, "\n", "😀", "token = " + "a1b2" * 9 + " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", "a@b.cd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_personal(docs).collect()}
    got = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    for i, t in enumerate(texts):
        want, at = "", 0
        for kind, a, b in (s.split(":") for s in spans[i].split(",") if s):
            if int(a) >= at:
                want += t[at : int(a)] + f"<{kind.upper()}>"
            at = max(at, int(b))
        assert got[i] == (None if t is None else want + t[at:])


def test_a_table_of_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")
    assert [(r.n_email, r.spans) for r in pii.find_personal(docs).collect()] == [(0, "")] * 2
    assert [r.text for r in pii.mask(docs).collect()] == [None, None]
