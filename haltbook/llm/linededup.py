"""Operator 3 [native]: removal of repeated and similar lines by an exact set-similarity join.

A line's set is its distinct words (A-Z lower-cased). A line goes if the same line, or one whose set
has a Jaccard similarity of at least ``threshold``, comes earlier: in a document of a smaller id, or
higher up in its own. Lines with fewer than ``min_words`` distinct words always stay.

1. Texts are cut once: each line is stored with the hashes of its distinct words, which all later steps
   read instead of the text. Rarity: the words of all lines are counted in ``BUCKETS`` hash buckets, once a
   line. The counts' levels are a table of fixed size (one byte a bucket) that plans read as a scalar
   subquery. A word's level, then its hash, orders the words of a line: rare words first. Any order that
   all lines share keeps the join exact.
2. Prefix filter: similar sets share a word among their first n - ceil(t n) + 1. Each distinct line
   posts these with its size, the word's place in it and a bitmap of its words. Positional, length and
   bitmap filters, evaluated inside the join, drop pairs that cannot reach the overlap.
3. A word whose bucket counts more than ``hot`` is not posted by itself. Lines whose first shared word is such a word
   share a second one not far behind (their prefixes longer by one have both): they post each two such words of the longer prefix as one key,
   which few lines share however large the table is. Prefixes are coded once and stored; postings meet by key, in ``TURNS`` turns. All lines of a word of at most ``hot / 2``
   meet each other. Those of any other key meet its earliest lines (``leaders`` of a word, one of a pair), so
   that a group of near copies costs as many pairs as it has lines; only lines that no leader
   explains meet others, those that do not stand after them.
4. Of the pairs that are left, each line's likeliest earlier partner (the one whose bitmap differs
   least) is verified first, on the whole sets; other pairs are verified only for lines that it does not
   explain.

Equal lines are told by 128 bits of hash and their length. Words are compared by 56 bits of hash and
their level. A pair of similar lines with equal 64-bit hashes (one in 2 ** 64) would be missed.

A null text has no lines and stays null. Rows that share an id (all null ids: one, the last) have the
same places, so a line is not removed for its own place in another of them; what is removed is known
by row. With ``apart``, as the registered query and the pipeline have it, such rows follow each other
by a hash of their text and repeats among them go too. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltbook.llm.common import lower_ascii, stored
from haltbook.llm.quality import let, spaced, words_of

BUCKETS = 1 << 20
PAGE = 1 << 11
#: Levels of counts for each doubling.
STEPS = 5
LAST_ID = (1 << 63) - 1
#: Postings are dealt in so many turns, a part of the keys each, since they take more room than all else.
TURNS = 2
#: White space other than blanks and line ends.
OTHER_SPACES = r"[\t\x0B\f\r]"
#: Many words come again and again: a dictionary of two million in a file takes less than their hashes.
DICTIONARY = {"parquet.dictionary.page.size": 16 << 20}


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(doc_key, row_hash): rows of the same id and text share it, others do not."""
    key = F.col(id_col).cast("long")
    return [F.coalesce(key, F.lit(LAST_ID)).alias("doc_key"), F.xxhash64(key, F.col(text_col)).alias("row_hash")]


def row_place(id_col: str, apart: bool) -> Column:
    """What orders the rows, times 2 ** 32 for the lines; needs row_hash. Apart, rows of one id follow each
    other by 31 bits of their hash (two texts of one id with equal bits share places), and rows without id, after all others, by 63."""

    def wide(c: Column) -> Column:
        return c.cast("decimal(38,0)")

    key = F.col(id_col).cast("long")
    if not apart:
        return wide(F.coalesce(key, F.lit(LAST_ID))) * F.lit(1 << 32)
    of_id = wide(wide(key) * F.lit(1 << 31) + F.shiftrightunsigned("row_hash", 33)) * F.lit(1 << 32)
    no_id = F.lit(str(1 << 126)).cast("decimal(38,0)") + wide(F.shiftrightunsigned("row_hash", 1)) * F.lit(1 << 32)
    return F.when(key.isNull(), wide(no_id)).otherwise(wide(of_id))


def lines_of(docs: DataFrame, id_col: str, text_col: str, apart: bool, min_words: int) -> DataFrame:
    """(doc_key, row_hash, line_no, h, g, pos, blank, words): lines, A-Z lower-cased, that can have ``min_words``
    words. (h, g) tells equal lines, pos orders all lines, words are 56 bits of hash of the line's distinct words."""
    keyed = docs.select(F.col(id_col), *row_key(id_col, text_col), F.col(text_col).alias("t"))
    placed = keyed.select("doc_key", "row_hash", row_place(id_col, apart).alias("row_at"), F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    # A line of so few characters cannot have min_words words.
    able = placed.where(F.length("line") >= 2 * min_words - 1).withColumn("line", lower_ascii(F.col("line")))
    pos = (F.col("row_at") + F.col("line_no")).cast("decimal(38,0)")
    # Few lines have white space other than blanks; one search for it costs less than to replace each kind.
    blanks = F.when(F.col("line").rlike(OTHER_SPACES), spaced(F.col("line"))).otherwise(F.col("line"))
    words = F.array_distinct(F.transform(F.array_remove(F.split(blanks, " "), ""), lambda w: F.shiftrightunsigned(F.xxhash64(w), 8)))
    told = able.select("doc_key", "row_hash", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.length("line"), "line").alias("g"), pos.alias("pos"), words.alias("words"))
    return told.select(*told.columns[:-1], (F.size("words") == 0).alias("blank"), "words")


def level_of(count: Column) -> Column:
    return F.least(F.floor(F.log2(count + 1) * STEPS), F.lit(126)).cast("tinyint")


def bucket_of(word: Column) -> Column:
    return word.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(lines: DataFrame) -> DataFrame:
    """One row, one column: for each hash bucket the logarithmic level of how many ``words`` of the lines
    fall in it. Every bucket is there, so its size is the same whatever the input."""
    words = lines.select(F.explode("words").alias("w")).select(bucket_of(F.col("w")).alias("b"))
    counts = words.union(lines.sparkSession.range(BUCKETS).select(F.col("id").cast("int"))).groupBy("b").agg((F.count("*") - 1).alias("n"))
    levels = counts.select(F.floor(F.col("b") / PAGE).alias("page"), F.struct("b", level_of(F.col("n")).alias("level")).alias("x"))

    def values(name: str, field: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(name)), lambda x: x[field])

    pages = levels.groupBy("page").agg(values("x", "level").alias("levels")).select(F.struct("page", "levels").alias("x"))
    return stored(pages.agg(F.flatten(values("x", "levels")).alias("levels")), "rarity")


def coded(lines: DataFrame, ranks: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and codes: the line's words as longs whose order is that of rarity."""

    def code(word: Column) -> Column:
        level = F.coalesce(F.get("ranks", bucket_of(word)), F.lit(0).cast("tinyint"))  # never null: longs are then sorted as such
        return F.shiftleft(level.cast("long"), 56).bitwiseOR(word)

    return lines.select(*keep, "words", ranks.scalar().alias("ranks")).select(*keep, F.sort_array(F.transform("words", code)).alias("codes"))


def first_code_of(count: int) -> int:
    """Words whose bucket counts at most ``count`` have smaller codes."""
    from math import floor, log2

    return (min(floor(log2(count + 1) * STEPS), 126) + 1) << 56


def least_overlap(a: Column, b: Column, t: float) -> Column:
    return F.ceil((a + b) * (t / (1 + t)) - F.lit(1e-9))


def differing() -> Column:
    return F.bit_count(F.col("x.low").bitwiseXOR(F.col("y.low"))) + F.bit_count(F.col("x.high").bitwiseXOR(F.col("y.high")))


def may_reach(t: float) -> Column:
    """Length, positional and bitmap filters for postings x and y of one word; r counts the words from
    this one on. At the first word that two lines share, the overlap is at most r in either, and one
    posting of each similar pair is that word. The length filter, least(n, m) >= t greatest(n, m), and
    the bound on what precedes both places follow from the two bounds on r. The bitmaps hold the parity
    of a line's words in 128 hash classes; each differing bit is a word that one line lacks. Written
    short: generated code of over 8,000 bytes a method would be interpreted."""
    rest = F.lit((1 << 32) - 1)
    both = F.shiftright("x.nr", 32) + F.shiftright("y.nr", 32)
    need = both * (t / (1 + t)) - 1e-9
    return (F.col("x.nr").bitwiseAND(rest) >= need) & (F.col("y.nr").bitwiseAND(rest) >= need) & (differing() <= both - need * 2)


def measured(sets: DataFrame, *keep: str) -> DataFrame:
    """n, low and high of each set: its size and two bitmaps of its words' parities."""
    one = F.lit(1).cast("long")

    def mark(bit: Column, c: Column) -> Column:
        return F.call_function("shiftleft", bit, c.bitwiseAND(F.lit(63)).cast("int"))

    every = F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(mark(one, c)))
    half = F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(mark(F.shiftright(c, 6).bitwiseAND(one), c)))
    n = F.size("codes")
    return sets.select(*keep, "codes", n.alias("n"), every.alias("every"), half.alias("low")).withColumn("high", F.col("every").bitwiseXOR(F.col("low"))).drop("every")


def prefix_size(n: Column, t: float) -> Column:
    return n - F.ceil(n * t - 1e-9).cast("int") + 1


POSTING = ["word", "h", "doc", "nr", "low", "high"]  # nr: n * 2 ** 32 + r; doc: the key of the row in which the line stands first


def paired() -> list[Column]:
    """(h, h2, differ, order) of postings x and y, h the smaller hash; order is 1 if line h comes after line h2, -1 if before, 0 if their rows'
    keys are equal."""
    order = F.when(F.col("x.doc") == F.col("y.doc"), 0).when((F.col("x.doc") > F.col("y.doc")) == (F.col("x.h") < F.col("y.h")), 1).otherwise(-1)
    return [F.least("x.h", "y.h").alias("h"), F.greatest("x.h", "y.h").alias("h2"), differing().cast("int").alias("differ"), order.alias("order")]


class Corpus:
    """The lines of one table and what the join needs of them."""

    def __init__(self, docs: DataFrame, threshold: float, min_words: int, id_col: str, text_col: str, apart: bool, small: int):
        self.t, self.min_words, self.small = threshold, min_words, small
        self.lines = stored(lines_of(docs, id_col, text_col, apart, min_words), "lines", False, None, DICTIONARY)
        self.distinct = stored(self.lines.groupBy("h", "g").agg(F.min("pos").alias("pos"), F.count("*").alias("times"), F.max("blank").alias("blank")), "distinct")
        self.ranks = rarity(self.lines)

    def bounded(self, df: DataFrame) -> DataFrame:
        """To be broadcast if it is counted to have at most ``small`` rows."""
        return F.broadcast(df) if df.limit(self.small + 1).count() <= self.small else df

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(h, g, pos, codes) of the distinct lines whose h is in ``wanted``."""
        places = self.bounded(stored(self.distinct.join(self.bounded(wanted.distinct()), "h", "left_semi").select("h", "g", F.col("pos").alias("at")), "wanted"))
        first = self.lines.join(places, ["h", "g"]).where("pos = at")
        return stored(coded(first, self.ranks, "h", "g", "pos").dropDuplicates(["h", "g"]), "sets")  # rows of the same id and text have the same places

    def prefixes(self) -> DataFrame:
        """(h, doc, n, low, high, codes) of all distinct lines: codes are those of the prefix and the one behind it, null for less than ``min_words`` words."""
        repeated = self.bounded(self.distinct.where("times > 1").select("h", F.col("pos").alias("at")))
        first = self.lines.select("h", "doc_key", "pos", "words").join(repeated, "h", "left").where("at is null or at = pos")
        codes = F.when(F.col("n") >= self.min_words, F.slice("codes", 1, prefix_size(F.col("n"), self.t) + 1))
        each = measured(coded(first, self.ranks, "h", "doc_key"), "h", "doc_key").select("h", F.col("doc_key").alias("doc"), "n", "low", "high", codes.alias("codes"))
        return stored(each, "prefixes", False, None, DICTIONARY)

    def postings(self, prefixes: DataFrame, hot: int, turn: int) -> DataFrame:
        """Of each prefix the words whose buckets count at most ``hot``, and keys (below zero) of two others. Of all keys, those of this ``turn``."""
        n, k, first = F.col("n"), F.col("k"), F.col("first")
        size = prefix_size(n, self.t)
        second = F.slice("codes", k + 2, size - k)
        second = F.when(F.ceil(n * self.t - 1e-9) == 1, F.concat(second, F.array(F.lit(-1).cast("long")))).otherwise(second)  # one shared word is enough
        two = F.transform(second, lambda other: F.xxhash64("first", other).bitwiseOR(F.lit(-1 << 63).cast("long")))
        alone, mine = first < first_code_of(hot), F.lit(turn)
        each = prefixes.select("*", F.posexplode_outer(F.slice("codes", 1, size)).alias("k", "first")).where(~alone | (F.pmod("first", F.lit(TURNS)) == mine))
        keyed = each.select("h", "doc", "n", "k", "low", "high", F.explode_outer(F.when(alone, F.array("first")).otherwise(two)).alias("word"))
        return keyed.select("word", "h", "doc", (F.shiftleft(n.cast("long"), 32) + n - k).alias("nr"), "low", "high").where(F.pmod("word", F.lit(TURNS)) == mine)

    def later(self, pairs: DataFrame) -> DataFrame:
        """(h, g) of the later line of each similar pair of ``pairs`` (h, h2, differ, order). A line's likeliest
        partner is verified first, so that a group of near copies costs about a comparison a line."""
        wanted = pairs.select("h").union(pairs.select(F.col("h2").alias("h")))
        sets = self.sets(wanted)
        place = self.bounded(sets.groupBy("h").agg(F.min("pos").alias("pos")))
        tied = pairs.where("order = 0").join(place, "h").join(place.select(F.col("h").alias("h2"), F.col("pos").alias("pos2")), "h2")
        told = pairs.where("order <> 0").select("h", "h2", "differ", (F.col("order") == 1).alias("after"))
        told = told.union(tied.select("h", "h2", "differ", F.col("pos") > F.col("pos2")))
        ordered = stored(told.select(F.when(F.col("after"), F.col("h")).otherwise(F.col("h2")).alias("h"), F.when(F.col("after"), F.col("h2")).otherwise(F.col("h")).alias("h2"), "differ"), "ordered")
        best = ordered.groupBy("h").agg(F.min(F.struct("differ", "h2"))["h2"].alias("h2"))
        found = stored(self.verified(best, sets), "verified")
        rest = ordered.join(found.select("h"), "h", "left_anti").join(best, ["h", "h2"], "left_anti").select("h", "h2")
        return found.union(self.verified(rest, sets)).distinct()

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("h").alias(f"h_{s}"), F.col("g").alias(f"g_{s}"), F.col("pos").alias(f"pos_{s}"), F.col("codes").alias(f"codes_{s}")) for s in "xy")
        both = pairs.join(x, F.col("h") == F.col("h_x")).join(y, F.col("h2") == F.col("h_y"))
        shared = F.size(F.array_intersect("codes_x", "codes_y"))
        alike = both.where((shared >= least_overlap(F.size("codes_x"), F.size("codes_y"), self.t)) & (F.col("pos_x") > F.col("pos_y")))
        return alike.select(F.col("h_x").alias("h"), F.col("g_x").alias("g")).distinct()

    def similar(self, leaders: int, hot: int) -> DataFrame:
        """(h, g) of the distinct lines that have a similar line before them."""
        prefixes = self.prefixes()
        met = self.met(prefixes, leaders, hot, 0)
        for turn in range(1, TURNS):
            met = met.union(self.met(prefixes, leaders, hot, turn))
        mild = stored(met.where("word is not null").select(*(F.col("of").alias(c) if c == "h" else c for c in POSTING)), "mild")
        pairs = stored(met.where("pair").select("h", "h2", "differ", "order").distinct(), "pairs")
        found = stored(self.later(pairs), "similar")
        # What no leader explains meets the others that do not stand after it.
        x, y = mild.join(found, "h", "left_anti").alias("x"), mild.alias("y")
        same = (F.col("x.word") == F.col("y.word")) & (F.col("x.h") != F.col("y.h")) & may_reach(self.t)
        others = stored(x.join(y, same & (F.col("x.doc") >= F.col("y.doc"))).select(*paired()).distinct(), "others")
        return found if others.isEmpty() else found.union(self.later(others)).distinct()

    def met(self, prefixes: DataFrame, leaders: int, hot: int, turn: int) -> DataFrame:
        """Pairs of lines that meet by a key of this turn (pair) and the postings of lines that do not lead their key's (word is not null)."""
        ranked = self.postings(prefixes, hot, turn).withColumn("rn", F.row_number().over(Window.partitionBy("word").orderBy("doc", "h")))

        def leading(word: Column) -> Column:
            return F.when(word < 0, 1).when(word < first_code_of(hot // 2), (1 << 31) - 1).otherwise(leaders)

        # No term names a column of the exchange alone: it would be pushed below, and the two sides would not share the exchange.
        x, y = ranked.alias("x"), ranked.where(F.col("rn") <= leading(F.col("word"))).alias("y")
        pair = (F.col("x.h") != F.col("y.h")) & may_reach(self.t)
        follows = (F.col("y.rn") == 1) & (F.col("x.rn") > leading(F.col("x.word")))  # once for each line that does not lead
        met = x.join(y, (F.col("x.word") == F.col("y.word")) & (F.col("x.rn") > F.col("y.rn")) & (pair | follows)).select(
            *paired(), (~follows | pair).alias("pair"), *(F.when(follows, F.col(f"x.{c}")).alias(c if c != "h" else "of") for c in POSTING)
        )
        return stored(met, "met")


def removed_lines(
    docs: DataFrame, threshold: float = 0.8, min_words: int = 5, leaders: int = 3, hot: int = 1024, id_col: str = "doc_id", text_col: str = "text", apart: bool = False, small: int = 400_000
) -> DataFrame:
    """(doc_key, row_hash, exact, similar): the numbers (from 0) of each row's removed lines."""
    corpus = Corpus(docs, threshold, min_words, id_col, text_col, apart, small)
    found = stored(corpus.similar(leaders, hot).withColumn("similar", F.lit(True)), "similar")
    enough = corpus.distinct.where("times > 1").join(found, ["h", "g"], "left_anti").withColumn("similar", F.lit(False))
    if min_words > 1:  # of repeated lines, only those of enough words are known to go
        sets = corpus.sets(enough.select("h")).where(F.size("codes") >= min_words)
        enough = enough.join(sets.select("h", "g"), ["h", "g"], "left_semi")
    else:
        enough = enough.where("not blank")
    gone = enough.select("h", "g", F.col("pos").alias("first"), "similar").union(corpus.distinct.join(found, ["h", "g"]).select("h", "g", "pos", "similar"))
    judged = corpus.lines.join(stored(gone, "gone"), ["h", "g"]).where("similar or pos > first")
    return judged.groupBy("doc_key", "row_hash").agg(
        F.array_sort(F.collect_set(F.when(F.col("pos") > F.col("first"), F.col("line_no")))).alias("exact"),
        F.array_sort(F.collect_set(F.when(F.col("pos") == F.col("first"), F.col("line_no")))).alias("similar"),
    )


def one_of_each(rows: DataFrame) -> DataFrame:
    """With __again, false for one row of each (__key, __hash). Rows are numbered in their task first, so that many equal
    rows do not meet in one."""
    of_task = F.row_number().over(Window.partitionBy("__key", "__hash", "__task").orderBy("__task"))
    of_all = F.row_number().over(Window.partitionBy("__key", "__hash", F.when(F.col("__in_task") == 1, -1).otherwise(F.col("__task"))).orderBy("__in_task"))
    numbered = rows.withColumn("__task", F.spark_partition_id()).withColumn("__in_task", of_task).withColumn("__n", of_all)
    return numbered.withColumn("__again", (F.col("__in_task") > 1) | (F.col("__n") > 1)).drop("__task", "__in_task", "__n")


def dedup_lines(
    docs: DataFrame, threshold: float = 0.8, min_words: int = 5, leaders: int = 3, hot: int = 1024, id_col: str = "doc_id", text_col: str = "text", apart: bool = False, small: int = 400_000
) -> DataFrame:
    """The columns of ``docs`` with the text's removed lines taken out, and ``exact_lines`` and
    ``similar_lines``, the numbers of these lines; columns of these names are replaced."""
    removed = removed_lines(docs, threshold, min_words, leaders, hot, id_col, text_col, apart, small).select(
        F.col("doc_key").alias("__key"), F.col("row_hash").alias("__hash"), F.col("exact").alias("__exact"), F.col("similar").alias("__similar")
    )
    none = F.array().cast("array<int>")
    kept = docs.drop("exact_lines", "similar_lines")
    key, row_hash = row_key(id_col, text_col)
    rows = kept.withColumns({"__key": key, "__hash": row_hash})
    exact, similar = F.coalesce("__exact", none), F.coalesce("__similar", none)
    if apart and not rows.groupBy("__key", "__hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # of rows of the same id and text, all lines of all but one are repeats
        rows = one_of_each(rows)
        numbers = F.transform(F.split(lower_ascii(F.col(text_col)), "\n"), lambda x, i: F.when(F.size(F.array_distinct(words_of(x))) >= min_words, i))
        exact = F.when(F.col("__again"), F.coalesce(F.array_compact(numbers), none)).otherwise(exact)
        similar = F.when(F.col("__again"), none).otherwise(similar)
    joined = rows.join(removed, ["__key", "__hash"], "left").withColumns({"__exact": exact, "__similar": similar})

    def remaining(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.concat("__exact", "__similar"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.size("__exact") + F.size("__similar") == 0, F.col(text_col)).otherwise(let(F.split(text_col, "\n"), remaining))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept.columns]
    return joined.select(*columns, F.col("__exact").alias("exact_lines"), F.col("__similar").alias("similar_lines"))
