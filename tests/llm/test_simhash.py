import random
import re
from collections import Counter

import numpy as np
import xxhash

from haltbook.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    listed = sorted(set(fps))
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if bin(a ^ b).count("1") <= radius:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in fps}


def near(rng, centre, bits):
    for b in rng.sample(range(64), bits):
        centre ^= 1 << b
    return centre


def sample(seed, centres, each, spread):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        out |= {near(rng, c, rng.randint(0, spread)) for _ in range(each)}
    return sorted(out)


def partition(pairs_or_map):
    groups = {}
    for k, v in pairs_or_map.items():
        groups.setdefault(v, set()).add(k)
    return sorted(map(sorted, groups.values()))


def test_explore_and_lags_equal_brute_force():
    for seed, centres, each, spread in ((1, 3, 150, 5), (2, 40, 3, 4), (3, 1, 400, 3)):
        fps = sample(seed, centres, each, spread)
        wanted = partition(brute_components(fps))
        root = simhash.explore(np.array(fps, np.uint64), 3)
        assert partition({f: fps[r] for f, r in zip(fps, root, strict=True)}) == wanted
        short = fps[:30]
        u, v = simhash.run_links(np.zeros(len(short), int), np.array(short, np.uint64), 3)
        assert all(bin(short[a] ^ short[b]).count("1") <= 3 for a, b in zip(u, v, strict=True))
        assert len(u) == sum(bin(a ^ b).count("1") <= 3 for i, a in enumerate(short) for b in short[:i])


def test_links_with_split_runs(spark):
    fps = sample(5, 4, 120, 4)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    from haltbook.llm.components import connected_components

    for chunk in (4096, 16):
        found = connected_components(simhash.fingerprint_links(frame, 3, simhash.block_masks(3, 5, 2), chunk)).collect()
        got = {r.node % 2**64: r.component % 2**64 for r in found}
        assert partition({f: got.get(f, f) for f in fps}) == partition(brute_components(fps))


def test_documents(spark):
    base = "one two three four five six seven eight nine ten " * 30
    rows = [(5, base, "c"), (3, base, "c"), (9, base + "eleven", "c"), (7, None, "c"), (8, "  \n", "c"), (None, "", "c"), (11, "A b", "c"), (12, "a B", "c"), (11, "A b", "c"), (20, "x " * 50_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    comp = brute_components(fps.values())
    least = {}
    for d, f in fps.items():
        if d is not None:
            least[comp[f]] = min(d, least.get(comp[f], d))
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == least[comp[fps[r.doc_id]]]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    comp = brute_components(fps.values())
    least = {}
    for d, f in fps.items():
        least[comp[f]] = min(d, least.get(comp[f], d))
    for r in simhash.near_duplicates(docs).collect():
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == least[comp[fps[r.doc_id]]]


def shingles(text, words=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [t for t in re.split("[\x20\x09-\x0d]+", low) if t]
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def similar_pairs(sets, threshold=0.8):
    """All pairs of ids whose sets are similar, through the ids of each shingle."""
    index, shared = {}, Counter()
    for i, s in sorted(sets.items()):
        for x in s:
            for j in index.setdefault(x, []):
                shared[j, i] += 1
            index[x].append(i)
    return {(i, j) for (i, j), n in shared.items() if n >= threshold * (len(sets[i]) + len(sets[j]) - n) - 1e-9}


def test_recall_and_precision_of_similar_texts(spark):
    rng = random.Random(6)
    texts = {}
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        texts[10 * k] = " ".join(words)
        for m in range(1, 4):  # similarities from 0.6 to 1
            edited = [w if rng.random() > 0.018 * m else "new" for w in words]
            texts[10 * k + m] = " ".join(edited)
    texts |= {10_000: "", 10_001: None, 10_002: " ", 10_003: "one", 10_004: "One", 10_005: "two words"}
    got = simhash.similar_links(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got = {(min(r), max(r)) for r in got}
    want = similar_pairs({i: shingles(t) for i, t in texts.items()})
    print("links", len(got), "of", len(want))
    assert got <= want and (10_003, 10_004) in got

    def groups(pairs):
        root = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {i: find(i) for p in pairs for i in p}

    found, whole = groups(got), groups(want)
    joined = sum(found.get(a, a) == found.get(b, b) for a, b in want)
    print("pairs in one group", joined / len(want))
    assert joined >= 0.95 * len(want) and len(whole) > 100


def test_few_pairs_are_verified(spark):
    """Sizes and parities rule out pairs that are not similar, before whole sets are joined, and no pair that is."""
    rng = random.Random(8)
    texts = {}
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 7, 60, 400, 2000]))]
        texts |= {10 * k + m: " ".join(w if rng.random() > 0.006 * m else "new" for w in words) for m in range(4)}
    texts |= {9_000: "", 9_001: None, 9_002: "one", 9_003: "One"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = sorted(texts)
    every = {(a, b) for a in ids for b in ids if a < b}
    sets = {i: shingles(t) for i, t in texts.items()}
    for threshold in (0.8, 1.0):
        left = simhash.may_be_similar(spark.createDataFrame(sorted(every), "a long, b long"), simhash.sketches(docs, 5), threshold)
        left = {tuple(r) for r in left.select("a", "b").collect()}
        want = similar_pairs(sets, threshold)
        assert want <= left <= every and len(left) < 2 * len(want) + 300
    assert (9_002, 9_003) in left


def test_chance_pairs_go_before_they_are_joined():
    """Similar sets stay, of unrelated ones of one size few do."""
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(300)]
    near = [np.concatenate([x[:378], rng.integers(0, 1 << 63, 22).astype(np.uint64)]) for x in sets]  # 378 of 422
    short = [x[:10] for x in sets] + [x[:8] for x in sets]
    a, b = (np.array([simhash.side_of(x) for x in some], np.uint64) for some in (sets, near))
    assert simhash.sides_alike(a, b, 0.8).all()
    assert simhash.sides_alike(a, np.roll(a, 1), 0.8).mean() < 0.2
    c = np.array([simhash.side_of(x) for x in short], np.uint64)
    assert simhash.sides_alike(c[:300], c[300:], 0.8).all() and not simhash.sides_alike(a, c[:300], 0.8).any()


def test_unrelated_texts_share_no_run(spark, monkeypatch):
    """Runs of equal keys do not grow with the number of unrelated texts, and similar texts share keys."""
    seen, stored = {}, simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name, *rest: seen.setdefault(name, stored(df, name, *rest)))
    rng = random.Random(9)
    texts = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(30))) for i in range(4000)]
    texts += [(5000 + i, t + " more") for i, t in texts[:50]]
    got = simhash.similar_links(spark.createDataFrame(texts, "doc_id long, text string"), chunk=2).collect()
    assert {(min(r), max(r)) for r in got} == {(i, 5000 + i) for i in range(50)}
    assert seen["hot"].count() == 0 and seen["links"].count() == 50


def test_outliers_of_a_crowd(spark):
    """A text that is similar to few of a long run of near copies is found with these."""
    rng = random.Random(10)
    base = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(w if rng.random() > 0.017 else f"x{i}" for w in base) for i in range(150)}
    for i in range(20):  # a long way from the base, near to one of the others
        texts[1000 + i] = " ".join(w if rng.random() > 0.017 else f"y{i}" for w in texts[i].split())
    got = simhash.similar_links(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = similar_pairs({i: shingles(t) for i, t in texts.items()})
    assert {(min(r), max(r)) for r in got} <= want
    assert {x for p in want for x in p} == {x for r in got for x in r} and any(x >= 1000 for p in want for x in p)
