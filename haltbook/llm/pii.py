"""Operator 4 [native]: personal data by weak supervision.

Base kinds (email, ip, card, phone) are found by pattern and always stay. Further candidates come
from one wider pattern. Labelers vote on each: patterns (shape of the candidate), gazetteers (words
on its left), context (what encloses it). Expectation-maximisation over the counted vote patterns
estimates the labelers' reliabilities; its posteriors train a logistic span classifier on counted
feature cells, and the candidates that it accepts are added.

All work on texts is SQL functions in the row: ``split`` by a pattern gives the gaps between its
matches, so offsets (in code points) are sums of lengths. Vote patterns (3**labelers) and feature
cells are bounded tables whatever the input; only they reach the driver. Patterns are written
possessively and start at the beginning of a run or where the last match ended, so that long runs
take linear time and no deep recursion.

Null texts count as empty. Repeated rows and null ids keep their rows. Without candidates nothing is
added. An empty table gives an empty result.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltbook.llm import label_model
from haltbook.llm.common import stored
from haltbook.llm.quality import let

#: Fixed base patterns, in listed order.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

CANDIDATE = (
    r"(?<![0-9A-Za-z])[0-9A-Za-z]{24,}+(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+.-])[0-9](?:[\x20-]?[0-9]){8,18}+(?![0-9A-Za-z])"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z]{2,}+"
)
#: Fixed word lists of the gazetteer labelers.
SECRET_WORDS = "token|secret|key|password|passwd|pwd|credential|bearer|auth"
CONTACT_WORDS = "phone|tel|call|mobile|fax|email|e-mail|mail|contact|card|account|iban|ssn|passport|id|konto|telefon|teléfono|téléphone|compte|cuenta"
PLAIN_WORDS = "isbn|version|page|figure|table|chapter|hash|commit|checksum|release|license"

MINE = ("v_mixed", "v_hex", "v_form", "v_secret", "v_contact", "v_plain", "v_assigned", "v_alone")
FEATURES = ("kind", "size", "digits", "variety", "left", "right", "secret", "contact", "plain")


def located(text: Column, pattern: str, fields) -> Column:
    """Leftmost non-overlapping matches of a pattern as structs (start, end, *fields(match, gap on
    the left, gap on the right))."""

    def matches(gaps: Column) -> Column:
        def entry(m, i):
            a, b = F.get(gaps, i), F.get(gaps, i + 1)
            return F.struct(F.length(a).alias("g"), F.length(m).alias("w"), *fields(m, a, b))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), entry)

    def offsets(entries: Column) -> Column:
        steps = F.transform(entries, lambda e: e["g"] + e["w"])
        return let(scanned(steps, F.lit(0), lambda x, y: x + y), lambda ends: F.transform(entries, lambda e, i: F.struct((F.get(ends, i) - e["w"]).alias("start"), F.get(ends, i).alias("end"), e.alias("of"))))

    return let(let(F.split(text, pattern, -1), matches), offsets)


BLOCK = 128


def scanned(values: Column, zero: Column, combine) -> Column:
    """The running results of an associative ``combine`` over an array, each with its own element. Appending copies an array, so the
    values are scanned in blocks: work grows with their number, save for one step a block."""

    def run(part: Column, first: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(first), lambda acc, v: F.array_append(acc, combine(F.element_at(acc, -1), v))), 2, BLOCK)

    def in_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, zero, combine))
        before = F.aggregate(whole, F.array(zero), lambda acc, v: F.array_append(acc, combine(F.element_at(acc, -1), v)))
        return let(before, lambda firsts: F.flatten(F.transform(blocks, lambda b, i: run(b, F.get(firsts, i)))))

    def cut(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(v, k * BLOCK + 1, BLOCK))

    return let(let(values, cut), in_blocks)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def value(c, i):
        n = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    marks = F.transform(F.array_remove(F.split(F.reverse(digits), ""), ""), value)
    return F.aggregate(marks, F.lit(0), lambda a, x: a + x) % 10 == 0


def _with_rank(k: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"))


def _has_rank(k: int):
    return lambda x: x["k"] == k


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end>> of all base kinds, by start, then kind as listed."""
    n = F.length
    right = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": lambda m: let(digits_of(m), lambda d: n(d).between(14, 19) & F.when(n(d).between(14, 19), luhn(d)).otherwise(F.lit(False))),
        "phone": lambda m: n(digits_of(m)).between(10, 15),
    }
    hint = {"email": "@", "phone": "+"}
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        some = located(text, pattern, lambda m, a, b, ok=right[kind]: [ok(m).alias("ok")])
        spans = F.transform(F.filter(some, lambda x: x["of"]["ok"]), _with_rank(k))
        there = F.contains(text, F.lit(hint[kind])) if kind in hint else text.rlike("[0-9]")
        found.append(F.when(there, spans).otherwise(none))
    return F.sort_array(F.concat(*found))


def candidates(text: Column) -> Column:
    """array<struct<start, end, of: struct<.., m, l, r>>> of the wider pattern."""
    return located(text, CANDIDATE, lambda m, a, b: [m.alias("m"), F.lower(F.right(a, F.lit(24))).alias("l"), F.left(b, F.lit(1)).alias("r")])


def _near(left: Column, words: str) -> Column:
    return left.rlike(rf"(?<![\p{{L}}])(?:{words})(?![\p{{L}}])")


def kind_of(m: Column) -> Column:
    return F.when(m.rlike(r"[\[(](?:at|AT)[\])]"), "email").when(m.rlike("[A-Za-z]"), "secret").when(m.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), "phone").otherwise("number")


def votes(m: Column, left: Column, right: Column) -> dict[str, Column]:
    """1 for personal data, -1 against, 0 abstains."""
    mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")

    def vote(good, bad=None):
        out = F.when(good, 1)
        return (out.when(bad, -1) if bad is not None else out).otherwise(0)

    number = kind_of(m) == "number"
    return {
        "v_mixed": vote(mixed & (F.length(m) >= 24), m.rlike("^[A-Za-z]+$")),
        "v_hex": vote(m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") & mixed),
        "v_form": vote(kind_of(m).isin("email", "phone"), number & ~F.length(digits_of(m)).isin(9, 10, 11, 12, 14, 15, 16, 18)),
        "v_secret": vote(_near(left, SECRET_WORDS)),
        "v_contact": vote(_near(left, CONTACT_WORDS)),
        "v_plain": vote(F.lit(False), _near(left, PLAIN_WORDS)),
        "v_assigned": vote(left.rlike(r"[=:]\s*[\"']?$")),
        "v_alone": vote(F.length(digits_of(m)).isin(15, 16) & number, F.lit(False)),
    }


def features(m: Column, left: Column, right: Column) -> dict[str, Column]:
    """Small categories; their combinations are the classifier's cells."""
    n = F.length(m)
    share = F.length(digits_of(m)) / n
    kinds = F.array_distinct(F.split(F.lower(m), ""))
    return {
        "kind": kind_of(m),
        "size": F.when(n < 12, "a").when(n < 20, "b").when(n < 32, "c").when(n < 48, "d").otherwise("e"),
        "digits": F.when(share == 0, "a").when(share < 0.3, "b").when(share < 0.9, "c").otherwise("d"),
        "variety": F.when(F.size(kinds) < 6, "a").when(F.size(kinds) < 11, "b").otherwise("c"),
        "left": F.when(left.rlike(r"[=:]\s*[\"']?$"), "a").when(left.rlike(r"\s$") | (left == ""), "s").otherwise("o"),
        "right": F.when((right == "") | right.rlike(r"\s"), "s").when(right.isin('"', "'"), "q").otherwise("o"),
        "secret": _near(left, SECRET_WORDS).cast("string"),
        "contact": _near(left, CONTACT_WORDS).cast("string"),
        "plain": _near(left, PLAIN_WORDS).cast("string"),
    }


def logistic(cells: list[tuple[tuple, float, float]], rounds: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> dict:
    """Weights of feature values from (values, rows, mean target), by gradient ascent."""
    total = sum(n for _, n, _ in cells) or 1.0
    w: dict = {}
    for _ in range(rounds):
        step: dict = {}
        for values, n, target in cells:
            p = 1 / (1 + exp(-max(-30, min(30, sum(w.get(v, 0.0) for v in values)))))
            for v in values:
                step[v] = step.get(v, 0.0) + n * (target - p) / total
        for v, g in step.items():
            w[v] = w.get(v, 0.0) + rate * (g - ridge * w.get(v, 0.0))
    return w


def fit(found: DataFrame) -> dict:
    """The span classifier's weights, from a column ``cand`` of candidates."""
    c = found.select(F.explode("cand").alias("c")).select("c.of.m", "c.of.l", "c.of.r")
    voted = c.select(
        *(v.cast("int").alias(k) for k, v in votes(F.col("m"), F.col("l"), F.col("r")).items()),
        *(v.alias(k) for k, v in features(F.col("m"), F.col("l"), F.col("r")).items()),
    )
    cells = voted.groupBy(*MINE, *FEATURES).agg(F.count("*").alias("n_rows")).collect()
    patterns: dict = {}
    for r in cells:
        key = tuple(r[k] for k in MINE)
        patterns[key] = patterns.get(key, 0) + r["n_rows"]
    start, weights = label_model.fit(list(patterns.items()))
    sure = {p: 1 / (1 + exp(-max(-30, min(30, start + sum(w[v] for w, v in zip(weights, p, strict=True)))))) if any(p) else 0.0 for p in patterns}
    rows: dict = {}
    for r in cells:
        key = tuple((k, r[k]) for k in FEATURES)
        n, t = rows.get(key, (0.0, 0.0))
        rows[key] = n + r["n_rows"], t + r["n_rows"] * sure[tuple(r[k] for k in MINE)]
    return logistic([(k, n, t / n) for k, (n, t) in rows.items()])


def accepted(cand: Column, base: Column, weights: dict, threshold: float) -> Column:
    """array<struct<start, end, kind>> of the candidates that the classifier accepts and that no
    base span overlaps."""

    def probability(x) -> Column:
        odds = F.lit(0.0)
        for name, value in features(x["of"]["m"], x["of"]["l"], x["of"]["r"]).items():
            term = None
            for (k, v), w in sorted(weights.items()):
                if k == name:
                    term = F.when(value == v, w) if term is None else term.when(value == v, w)
            if term is not None:
                odds = odds + term.otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    likely = F.filter(cand, lambda x: probability(x) >= threshold) if weights else F.slice(cand, 1, 0)
    kept = F.when(F.size(likely) * F.size(base) == 0, likely).otherwise(let(likely, lambda c: without_overlaps(c, base)))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), kind_of(x["of"]["m"]).alias("kind")))


def without_overlaps(cand: Column, base: Column) -> Column:
    """The candidates that overlap no base span. Base spans (at their start) and candidates (at their end, before base spans of this place)
    are put in one order; the furthest end of the base spans before a candidate's end tells whether one reaches into it."""
    marks = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("end"), F.lit(-1).alias("i"))),
        F.transform(cand, lambda x, i: F.struct(x["end"].alias("at"), F.lit(0).alias("base"), F.lit(0).alias("end"), i.alias("i"))),
    )

    def free(order: Column) -> Column:
        reach = scanned(F.transform(order, lambda m: m["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
        paired = let(reach, lambda r: F.transform(order, lambda m, k: F.struct(m["i"].alias("i"), F.get(r, k).alias("reach"))))
        own = F.filter(paired, lambda p: p["i"] >= 0)
        return F.transform(F.filter(own, lambda p: p["reach"] <= F.get(cand, p["i"])["start"]), lambda p: F.get(cand, p["i"]))

    return let(F.array_sort(marks), free)


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, cand) of every text."""
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return t.select("doc_id", base_spans(F.col("t")).alias("base"), candidates(F.col("t")).alias("cand"))


NAMES = list(BASE)
#: Characters of a text that are cut together when it is masked.
CHUNK = 1024


def _base_text(x) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, NAMES)), x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))


def all_spans(base: Column, added: Column) -> Column:
    """array<struct<start, rank, kind, end>> of base and added spans, by start, base kinds first."""
    a = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("rank"), F.element_at(F.array(*map(F.lit, NAMES)), x["k"] + 1).alias("kind"), x["end"].alias("end")))
    b = F.transform(added, lambda x: F.struct(x["start"].alias("start"), F.lit(len(NAMES)).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.sort_array(F.concat(a, b))


def find_personal(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""
    found = stored(found_in(docs), "spans")
    weights = fit(found)
    judged = found.select("doc_id", "base", accepted(F.col("cand"), F.col("base"), weights, threshold).alias("added"))
    counts = [F.size(F.filter("base", _has_rank(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(NAMES)]
    span = F.transform(all_spans(F.col("base"), F.col("added")), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return judged.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform("base", _base_text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(span, ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def mask(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns of ``docs`` with each span of the text replaced by its kind in angle brackets;
    overlapping spans become one. A null text stays null."""
    t = F.col(text_col)
    marked = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.struct(base_spans(F.coalesce(t, F.lit(""))).alias("base"), candidates(F.coalesce(t, F.lit(""))).alias("cand")).alias("__found"))
    marked = stored(marked, "found")  # spans are searched once, for the fit and for the mask
    weights = fit(marked.select("__found.cand"))
    f = F.col("__found")

    def rewrite(spans: Column) -> Column:
        # Text is cut in chunks once, since to find a place in a string takes as long as what precedes it.
        chunks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        reach = scanned(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda x, y: F.greatest(x, y))

        def pieces(c: Column, ends: Column) -> Column:
            def part(first: Column, last: Column) -> Column:
                k = F.floor(first / CHUNK).cast("int")
                near = F.array_join(F.slice(c, k + 1, F.floor((last - 1) / CHUNK).cast("int") - k + 1), "")
                return F.when(last > first, F.substr(near, first - k * CHUNK + 1, last - first)).otherwise("")

            def masked(x, i):
                before = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
                # a span that begins inside the last one only lengthens it
                return F.when(x["start"] < before, "").otherwise(F.concat(part(before, x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))

            return F.concat(F.array_join(F.transform(spans, masked), ""), part(F.element_at(ends, -1), F.length(t)))

        return let(F.struct(chunks.alias("c"), reach.alias("e")), lambda x: pieces(x["c"], x["e"]))

    spans = all_spans(f["base"], accepted(f["cand"], f["base"], weights, threshold))
    new = let(spans, lambda s: F.when(F.size(s) == 0, t).otherwise(rewrite(s)))
    return marked.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
