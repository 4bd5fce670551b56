"""Operator 9: URL filters from association rules.

Given rules (host and path beginning, block or allow) decide first; the longest that fits wins. For
the other pages Spark's FP-growth mines combinations of URL tokens from labelled transactions: the
pages that a given rule decides carry its verdict as one more item. Rules that conclude a verdict
are pruned by support and confidence, and those that say no more than a shorter rule go. They are
kept as an inverted index under their rarest token class; a page's classes look rules up there, a rule fires
where it has all classes met, the most confident one decides, and a page without a firing rule is
allowed.

1. Rules of one token come from plain counts of all tokens.
2. A token whose rule is certain is not mined further: longer rules with it say no more.
3. Tokens of exactly the same labelled pages are one item, a class: a rule with the class stands for the rules with any of its
   tokens. The pages are told by their number and two 64-bit hash sums.
4. FP-growth proposes sets of at most ``longest`` classes. A transaction of more than ``width`` classes is dealt into transactions of that
   size in which any ``longest`` of its classes meet, so its cost is bounded by powers of its length. Since a set may then be
   counted more than once, proposals are counted again on the pages.

A rule has to be met in ``support`` of the labelled pages and in ``least`` pages. All labelled pages, all tokens
of a page and all sets of that length are mined.

Pages with equal token sets are matched once; sets that many pages share are broadcast back (``wide_join``).
A null url, or one without "://", has an empty host and
path and no tokens; it is allowed. Repeated rows and null ids keep their rows. Without labelled pages,
or with fewer than ``least``, no rule is mined. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltbook.llm.common import bounded as at_most
from haltbook.llm.common import lower_ascii, stored, wide_join

#: Fixed rules of the registered query: host, path beginning, verdict.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def url_tokens(url, host, path) -> Column:
    """Distinct tokens: scheme, host labels by level from the right, path segments with runs of
    digits written as #, query keys."""
    url = F.coalesce(url, F.lit(""))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    levels = F.transform(F.reverse(labels), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), "[0-9]+", "#")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))))
    return F.sort_array(F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(scheme, levels, segments, keys))))


def decide_by_rules(host, path, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def token_classes(labelled: DataFrame, need: float) -> DataFrame:
    """(token, class, n, bad) of the tokens that ``need`` labelled pages have; class is the first of the tokens that have the same pages."""
    each = labelled.select("verdict", F.xxhash64("row").alias("a"), F.xxhash64("row", F.lit(1)).alias("b"), F.explode("tokens").alias("token"))
    bad = F.count_if(F.col("verdict") == "block")
    counts = each.groupBy("token").agg(F.count("*").alias("n"), bad.alias("bad"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    frequent = stored(counts.where(F.col("n") >= need), "tokens")
    first = frequent.groupBy("n", "bad", "a", "b").agg(F.min("token").alias("class"))
    return stored(frequent.join(first, ["n", "bad", "a", "b"]).select("token", "class", "n", "bad"), "classes")


def dealt(items: Column, width: int, longest: int) -> Column:
    """Arrays of at most ``width`` items (of an array of more) in which any ``longest`` of them meet: unions of ``longest`` blocks."""
    size = max(1, width // longest)
    n = F.ceil(F.size(items) / size).cast("int")
    chosen = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(i))
    for _ in range(longest - 1):
        chosen = F.flatten(F.transform(chosen, lambda c: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > F.element_at(c, -1)), lambda j: F.array_append(c, j))))
    return F.transform(chosen, lambda c: F.flatten(F.transform(c, lambda k: F.slice(items, k * size + 1, size))))


MINED = "rule_id long, classes array<string>, rarest string, says string, confidence double, support double"


def mine_rules(labelled: DataFrame, support: float, confidence: float, least: int = 5, longest: int = 3, width: int = 15) -> tuple[DataFrame, DataFrame]:
    """((rule_id, classes, rarest, says, confidence, support), (token, class)) from (tokens, verdict)."""
    spark = labelled.sparkSession
    pages = stored(labelled.select("tokens", "verdict", F.monotonically_increasing_id().alias("row")), "labelled")
    n = pages.count()
    need = max(least, support * n * (1 - 1e-9))
    if n < least:
        return spark.createDataFrame([], MINED), spark.createDataFrame([], "token string, class string")
    tokens = token_classes(pages, need)
    classes = tokens.where("token = class").select("class", "n", "bad")
    open_ = classes.where((F.col("bad") > 0) & (F.col("bad") < F.col("n"))).select("class")
    of_page = pages.select("row", "verdict", F.explode("tokens").alias("token")).join(bounded(tokens.select("token", "class")), "token")
    sets = stored(of_page.groupBy("row", "verdict").agg(F.sort_array(F.collect_set("class")).alias("classes")), "sets")
    undecided = of_page.join(bounded(open_), "class").groupBy("row", "verdict").agg(F.sort_array(F.collect_set("class")).alias("items"))
    undecided = stored(undecided.where(F.size("items") > 1), "undecided")
    few, many = undecided.where(F.size("items") <= width), undecided.where(F.size("items") > width)
    baskets = stored(few.select("items").union(many.select(F.explode(dealt(F.col("items"), width, longest)).alias("items"))), "items")
    found = classes.select(F.array("class").alias("classes"))
    total = baskets.count()
    if total >= need:
        model = FPGrowth(itemsCol="items", minSupport=need / total * (1 - 1e-9)).fit(baskets)
        found = found.union(model.freqItemsets.where(F.size("items").between(2, longest)).select(F.sort_array("items").alias("classes")))
    counted = stored(count_sets(sets, stored(found, "proposed"), classes), "counted")
    sure = F.greatest(F.col("bad"), F.col("n") - F.col("bad")) / F.col("n")
    says = F.when(F.col("bad") * 2 >= F.col("n"), "block").otherwise("allow")
    hits = F.greatest(F.col("bad"), F.col("n") - F.col("bad"))
    rules = counted.withColumns({"says": says, "confidence": sure, "hits": hits}).where((F.col("confidence") >= confidence) & (F.col("hits") >= need))
    # A rule stays unless it has a shorter part that concludes the same as surely.
    shorter = rules.where(F.size("classes") > 1).select(F.col("classes").alias("whole"), F.col("says").alias("same"), F.col("confidence").alias("sure"), F.explode(parts_of(F.col("classes"), longest)).alias("part"))
    idle = shorter.join(rules.select(F.col("classes").alias("part"), F.col("says").alias("same"), F.col("confidence").alias("known")), ["part", "same"]).where("known >= sure")
    kept = rules.join(idle.select(F.col("whole").alias("classes"), F.col("same").alias("says")).distinct(), ["classes", "says"], "left_anti")
    out = kept.select(F.xxhash64("classes", "says").alias("rule_id"), "classes", "rarest", "says", "confidence", (F.col("hits") / n).alias("support"))
    return stored(out, "mined"), tokens.select("token", "class")


def parts_of(items: Column, longest: int) -> Column:
    """The shorter non-empty parts of a set of at most ``longest`` items, in order."""
    out = F.transform(items, lambda x: F.array(x))
    for size in range(2, longest):
        bigger = F.flatten(F.transform(out, lambda c: F.transform(F.filter(items, lambda x: x > F.element_at(c, -1)), lambda x: F.array_append(c, x))))
        out = F.array_distinct(F.concat(out, F.filter(bigger, lambda c: F.size(c) <= F.lit(size))))
    return F.filter(out, lambda c: F.size(c) < F.size(items))


def indexed(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(classes, rarest): each set under its class of fewest pages."""
    each = sets.select("classes", F.explode("classes").alias("class")).join(bounded(classes.select("class", F.col("n").alias("m"))), "class")
    return each.groupBy("classes").agg(F.min(F.struct("m", "class"))["class"].alias("rarest"))


def count_sets(pages: DataFrame, proposed: DataFrame, classes: DataFrame) -> DataFrame:
    """(classes, rarest, n, bad): the pages that have each of the proposed sets."""
    index = indexed(proposed, classes).withColumnRenamed("classes", "need")
    met = pages.select("verdict", F.col("classes").alias("own"), F.explode("classes").alias("rarest")).join(bounded(index), "rarest")
    held = met.where(F.size(F.array_except("need", "own")) == 0)
    return held.groupBy(F.col("need").alias("classes"), "rarest").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("bad"))


def bounded(df: DataFrame, most: int = 200_000) -> DataFrame:
    return at_most(df, most)


def match_rules(sets: DataFrame, rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """(tokens, says, confidence) of the surest rule that fires, from distinct token sets."""
    known = sets.select("tokens", F.explode("tokens").alias("token")).join(bounded(tokens), "token")
    own = stored(known.groupBy("tokens").agg(F.collect_set("class").alias("own")), "own")
    index = rules.select("rarest", F.col("classes").alias("need"), "says", "confidence", "support")
    met = own.select("tokens", "own", F.explode("own").alias("rarest")).join(bounded(index), "rarest")
    fired = met.where(F.size(F.array_except("need", "own")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("need").alias("n"), "says"))
    return fired.groupBy("tokens").agg(best.alias("b")).select("tokens", "b.says", "b.confidence")


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | None = None,
    support: float = 0.002,
    confidence: float = 0.9,
    least: int = 5,
    longest: int = 3,
    width: int = 15,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence), one row for each row of ``pages``."""
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, given = decide_by_rules(F.col("host"), F.col("path"), RULES if rules is None else rules)
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), given.alias("given"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    judged = stored(judged, "judged")
    mined, tokens = mine_rules(judged.where("given is not null").select("tokens", F.col("given").alias("verdict")), support, confidence, least, longest, width)
    open_ = judged.where("rule is null")
    said = stored(match_rules(open_.select("tokens").distinct(), mined, tokens), "said")
    out = wide_join(open_, said.withColumnRenamed("confidence", "sure"), ["tokens"]).unionByName(judged.where("rule is not null"), allowMissingColumns=True)
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "says", F.lit("allow")).alias("verdict"), F.col("sure").alias("confidence"))
