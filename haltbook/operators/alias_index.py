"""Which texts contain which names, for any number of either.

A name inside a text has its longest word (white space parts words) inside one of the text's words. So
distinct words of all texts meet these anchors by a gram index: an anchor is posted under its rarest gram of three
characters (shorter ones under themselves) and meets the words that have this gram; texts then meet names by
equal words. Only names of several words have to be checked on the text. All joins are of equal keys, so Spark
spreads them; nothing is compared with everything. The few names of a small dimension are looked for in the text itself."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltbook.functions.timecols import let
from haltbook.sources.scratch import scratch

GRAM = 3
#: Up to so many names are looked for in each text at once, without any join.
FEW = 64


def words_of(text: Column) -> Column:
    """Distinct words between white space; blanks are put for all of it first, since to split at one character is fast."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.array_distinct(F.split(text, " ")), "")


def grams_of(word: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(word, i, n)))


def same(left: str, right: str, key: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in key))


def word_pairs(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """(word, anchor) where the anchor is in the word; both tables are distinct."""
    sizes = sorted(r.n for r in anchors.select(F.least(F.length("anchor"), F.lit(GRAM)).alias("n")).distinct().collect())  # three values at most
    if not sizes:
        return words.join(anchors, F.lit(False))
    of_word = F.concat(*(F.when(F.length("word") >= n, grams_of(F.col("word"), n)).otherwise(F.array().cast("array<string>")) for n in sizes))
    posted = words.select("word", F.explode(of_word).alias("gram"))
    of_anchor = anchors.select("anchor", F.explode(grams_of(F.col("anchor"), F.least(F.length("anchor"), F.lit(GRAM)))).alias("gram"))
    counts = posted.join(of_anchor.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = of_anchor.join(counts, "gram", "left").groupBy("anchor").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    return posted.join(rarest, "gram").where(F.contains("word", F.col("anchor"))).select("word", "anchor")


def _written(df: DataFrame) -> DataFrame:
    """As a table, whose size Spark knows: it is broadcast only if it is small."""
    path = scratch(df.sparkSession, "names")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def containing(texts: DataFrame, names: DataFrame, key: Sequence[str], text: str = "__t", name: str = "__a", few: int = FEW) -> DataFrame:
    """(key, name), distinct: the ``names`` that lie in the text of each key. A null or blank name lies in none."""
    known = [r[0] for r in names.select(name).distinct().limit(few + 1).collect()]
    if len(known) <= few:
        wanted = F.array(*(F.lit(n) for n in known if n and n.strip(" \t\n\x0b\x0c\r"))).cast("array<string>")
        hits = let(F.col(text), lambda t: F.filter(wanted, lambda n: F.contains(t, n)))
        return texts.select(*key, F.explode(hits).alias(name)).distinct()
    parts = words_of(F.col(name))
    longest = F.array_max(F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    # A name of one word that has white space at its ends is to be checked too.
    anchored = names.select(name).distinct().select(name, longest.alias("anchor")).where("anchor is not null").withColumn("__more", F.col(name) != F.col("anchor"))
    each = texts.select(*key, F.explode(words_of(F.col(text))).alias("word"))
    vocabulary = _written(each.select("word").distinct())  # it is read twice
    pairs = _written(word_pairs(vocabulary, anchored.select("anchor").distinct()).join(anchored, "anchor").select("word", name, "__more"))
    found = each.join(pairs, "word").select(*key, name, "__more").distinct()
    sure = found.where("not __more").select(*key, name)
    on_text = found.where("__more").alias("f").join(texts.select(*key, F.col(text).alias("__body")).alias("t"), same("f", "t", key))
    checked = on_text.where(F.contains("__body", F.col(name))).select(*(F.col(f"f.{c}") for c in key), F.col(f"f.{name}")).distinct()
    return sure.unionByName(checked)
