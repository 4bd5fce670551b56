import random
from collections import Counter
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from haltbook.llm import urls


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def slow_rule(host, path):
    fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0])) if fit else (None, None)


CASES = [None, "", "no scheme", "http://a.example.net/en/1", "HTTP://X.Example.NET/en/1?x=/y", "http://net", "http://net/", "http://fishnet/a", "a://b://c/d",
         "https://example.com/de/1#top", "https://www.example.com/De/1", "ftp://org/fr/", "http://a.org?fr/", "http://ÄB.org/fr/ü", "://x/y", "http://a.net#/", "http://a.example.net/en"]


def test_parts_and_rules(spark):
    rows = [(i, u, "h") for i, u in enumerate(CASES)] + [(None, CASES[3], "h"), (3, CASES[3], "h")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = slow_parts(CASES[r.page_id if r.page_id is not None else 3])
        rule, verdict = slow_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(empty).count() == 0


def test_mined_rules(spark):
    """de pages are blocked wherever a rule speaks, so de pages elsewhere are blocked too."""
    made = [f"http://s{k % 7}.example.{tld}/{lang}/{k}" for k in range(300) for tld in ("net", "com", "org") for lang in ("de", "fr", "en")]
    got = urls.filter_urls(spark.createDataFrame(list(enumerate(made)), "page_id long, url string")).collect()
    other = [r for r in got if r.rule is None]
    assert {r.verdict for r in other if r.path.startswith("/de/")} == {"block"}
    assert all(r.confidence >= 0.9 for r in other if r.verdict == "block")


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    given = {r.page_id: r.url for r in pages.collect()}
    got = urls.filter_urls(pages).collect()
    assert len(got) == len(given)
    for r in got:
        assert (r.host, r.path) == slow_parts(given[r.page_id]) and r.rule == slow_rule(r.host, r.path)[0]


def slow_rules(rows, support, confidence, least):
    """All token sets that conclude a verdict, by counting every subset; those that say no more than a shorter one go."""
    need = max(least, support * len(rows))
    counts = Counter((s, v) for tokens, v in rows for k in range(1, len(tokens) + 1) for s in combinations(sorted(tokens), k))
    total = Counter()
    for (s, _), n in counts.items():
        total[s] += n
    found = {(s, v): n / total[s] for (s, v), n in counts.items() if n >= need - 1e-9 and n / total[s] >= confidence}
    shorter = {(s, v) for (s, v), c in found.items() if any(found.get((part, v), -1) >= c for k in range(1, len(s)) for part in combinations(s, k))}
    return {k: c for k, c in found.items() if k not in shorter and len(k[0]) <= 3}


def spelled(mined, tokens):
    """Rules of classes as rules of tokens."""
    of_class = {}
    for r in tokens.collect():
        of_class.setdefault(r["class"], []).append(r.token)
    return {(tuple(sorted(ts)), r.says): r.confidence for r in mined.collect() for ts in product(*(of_class[c] for c in r.classes))}


@pytest.mark.parametrize("width", [15, 3, 4])
def test_mining_against_all_subsets(spark, width):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        tokens = {rng.choice("abc"), rng.choice("def") + "x", rng.choice("gh"), rng.choice("ijklm"), str(rng.randrange(40))}
        tokens |= {"twin"} if "a" in tokens else set()
        bad = "a" in tokens and "dx" in tokens or "g" in tokens and "i" in tokens
        rows.append((sorted(tokens), "block" if bad != (rng.random() < 0.05) else "allow"))
    table = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = spelled(*urls.mine_rules(table, 0.01, 0.85, width=width))
    want = slow_rules(rows, 0.01, 0.85, 5)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) > 5


def test_every_telling_token_has_its_rule(spark):
    """Blocked pages of 14 segments that are found nowhere else; each segment alone blocks a page elsewhere."""
    made = [(i, "http://x.net/" + "/".join(f"t{chr(97 + k)}" for k in range(14)) + f"/v{i}") for i in range(200)]
    made += [(1000 + i, f"http://example.net/en/{i}") for i in range(200)] + [(2000 + k, f"http://y.com/t{chr(97 + k)}") for k in range(14)]
    got = urls.filter_urls(spark.createDataFrame(made, "page_id long, url string")).collect()
    assert [r.verdict for r in got if r.page_id >= 2000] == ["block"] * 14


def test_sets_meet_in_dealt_transactions(spark):
    items = [f"i{k:02}" for k in range(11)]
    got = [tuple(x) for x in spark.range(1).select(urls.dealt(F.array(*map(F.lit, items)), 6, 3).alias("d")).first().d]
    assert all(len(x) <= 6 for x in got) and all(any(set(c) <= set(x) for x in got) for c in combinations(items, 3))
    parts = spark.range(1).select(urls.parts_of(F.array(*map(F.lit, items[:4])), 4).alias("p")).first().p
    assert sorted(map(tuple, parts)) == sorted(c for k in (1, 2, 3) for c in combinations(items[:4], k))


def test_long_and_few(spark):
    """Long URLs and tables of a few labelled pages end soon, and ties and repeats are as many pages."""
    long_url = "http://a.example.com/de/" + "/".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(2_000))
    few = spark.createDataFrame([(1, long_url), (2, long_url + "/x y"), (3, "http://b.net/q")], "page_id long, url string")
    assert urls.filter_urls(few).count() == 3
    many = [(i, long_url) for i in range(30)] + [(100 + i, f"http://b{i % 3}.org/fr/a b/{i}") for i in range(30)] + [(200, "http://c.info/" + "/".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(2_000)))]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(many, "page_id long, url string")).collect()}
    assert got[0] == "block" and got[100] == "allow" and got[200] == "block"
    nothing = spark.createDataFrame([(None, None), (1, None)], "page_id long, url string")
    assert [r.verdict for r in urls.filter_urls(nothing).collect()] == ["allow", "allow"]
