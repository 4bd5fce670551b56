"""Operator 12: phrase collocations by SETM relational mining.

1. Occurrence relation R1: the words of all texts with their places, persisted as a table that is sorted
   by piece and position. Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these
   into words. A place (``at``) is the number of words and piece ends before it, so two places are of
   adjacent positions of one piece if they differ by one. Rows hold blocks of whole pieces of one
   language; a block is closed at the first piece end after ``block`` words. ``ROWS_AT_ONCE`` of them are read and
   sent to Python together, so a task's memory does not depend on the size of its split.
2. The relation of length k, semi-joined with the frequent groups (phrases) of that length, is merge-joined
   with itself by piece and adjacent position; that gives the relation of length k + 1, which Spark
   group-counts. Groups that occur at least ``least`` times are the phrases of that length. What of the relation they keep
   is persisted in the same order before the next round extends it.
3. Candidates get the lowest of their cuts' scores by joins with the counts of their parts, and go if a longer
   candidate that holds them is frequent enough.

The semi-join meets a bit table over the frequent groups, of 16 bits a group and ``filter_bits`` bits at
most: what is broadcast does not grow beyond that. Its false positives cost work only, since the
group-count of the next length is made of all occurrences that are left, and a phrase whose part is not
frequent cannot be frequent. Words are told by a 64-bit hash that is checked on the word counts to be free
of collisions (else the next seed is taken), so all counts are exact. A task counts a block before it shuffles
the counts; a language or a word that holds most rows is therefore no hot key.

Null texts are empty, a null language is ``und``. Repeated rows and null ids count as rows. An empty table, or
one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltbook.llm.common import bounded, few_rows_at_once, stored

END = b"."
ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to lower case, and every piece end to the same byte.
SHAPE = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + END * len(ENDS))

OCCURRENCES = "lang string, at array<int>, words array<long>"
#: Most distinct words that a task keeps before it sends their counts.
MAP_SIZE = 100_000
#: Rows of R1 that are read and sent to Python together; each has a block of words.
ROWS_AT_ONCE = 32


class WordIds(dict):
    """Ids of words, made when first met; 0 is that of a piece end."""

    def __init__(self, seed: int):
        super().__init__({END: 0})
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word, self.seed) - (1 << 63) or 1
        return got


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows), kind)) if rows else pa.array([], pa.list_(kind))


def occurrences(batches: Iterator[pa.RecordBatch], block: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows of R1 (kind 0) and word counts (kind 1) of one task."""
    ids = WordIds(seed)
    tokens: dict[str, list[bytes]] = {}
    counts: dict[str, Counter] = {}

    def relation(lang: str) -> pa.RecordBatch:
        words = np.fromiter(map(ids.__getitem__, tokens[lang]), np.int64, len(tokens[lang]))
        counts.setdefault(lang, Counter()).update(tokens[lang])
        at = np.flatnonzero(words)
        tokens[lang] = []
        return pack(0, [lang], at=[at], words=[words[at]])

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            c.pop(END, None)
            found = list(c)
            if found:
                yield pack(1, [lang] * len(found), word=[w.decode() for w in found], h=list(map(ids.__getitem__, found)), n=list(c.values()))
        counts.clear()
        ids.clear()
        ids[END] = 0

    def pack(kind: int, lang: list[str], at=None, words=None, word=None, h=None, n=None) -> pa.RecordBatch:
        m = len(lang)
        none = pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.list_(pa.int64()))
        occ = (lists(at, pa.int32()), lists(words, pa.int64())) if at is not None else none
        count = (pa.array(word, pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int64())) if word is not None else (pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int32()), pa.array(lang, pa.string()), *occ, *count], names=["kind", "lang", "at", "words", "word", "h", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = tokens.setdefault(lang, [])
            got += text.as_buffer().to_pybytes().translate(SHAPE).replace(END, b" . ").split()
            got.append(END)
            if len(got) >= block:
                yield relation(lang)
                if len(ids) > MAP_SIZE:
                    yield from counted()
    for lang in tokens:
        if tokens[lang]:
            yield relation(lang)
    yield from counted()


def mixed(lang: str, words: np.ndarray) -> np.ndarray:
    """Hashes of groups, one a row of ``words``."""
    key = np.full(len(words), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for k in range(words.shape[1]):
        key = (key ^ words[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


PAGE_BITS = 1 << 15


def bit_table(groups: DataFrame, width: int, most_bits: int) -> np.ndarray:
    """Bits of the hashes of ``groups`` (lang, w1 ...): a power of two of them, ``most_bits`` at most."""
    wanted = 16 * groups.count()
    bits = min(max(1 << wanted.bit_length(), PAGE_BITS), most_bits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, bool)
        for b in batches:
            words = np.stack([b.column(1 + k).to_numpy() for k in range(width)], 1)
            langs = b.column(0).dictionary_encode()
            codes = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                table[(mixed(lang, words[codes == i]) & np.uint64(bits - 1)).astype(np.int64)] = True
        pages = np.packbits(table, bitorder="little").reshape(-1, PAGE_BITS // 8)
        used = np.flatnonzero(pages.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([pages[i].tobytes() for i in used], pa.binary())], names=["page", "bits"])

    table = np.zeros((bits // PAGE_BITS, PAGE_BITS // 8), np.uint8)
    found = groups.select("lang", *(f"w{k + 1}" for k in range(width))).mapInArrow(task, "page long, bits binary")
    for r in found.groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits")).toLocalIterator():  # a table of fixed size
        table[r.page] = np.frombuffer(r.bits, np.uint8)
    return table.reshape(-1)


def kept(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(8 * len(table) - 1)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def grouped(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row of each distinct row of ``words``, their counts)."""
    code, size = np.zeros(len(words), np.int64), 1
    for k in range(words.shape[1]):
        values, of_word = np.unique(words[:, k], return_inverse=True)
        if size * len(values) >= 1 << 62:
            distinct, code = np.unique(code, return_inverse=True)
            size = len(distinct)
        code, size = code * len(values) + of_word, size * len(values)
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return words[first], n


def joined(row: tuple[str, pa.ListScalar, pa.ListScalar], width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, words) of the relation of ``width`` + 1 words, from a row of the one of ``width`` and the table of its frequent groups."""
    lang, at, words = row[0], row[1].values.to_numpy(), row[2].values.to_numpy().reshape(-1, width)
    good = kept(table, mixed(lang, words))  # the semi-join
    at, words = at[good], words[good]
    # The merge-join: places are sorted and unique, so what stands at ``at`` + 1 can only be the next row.
    left = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[left], np.concatenate([words[left], words[left + 1][:, -1:]], 1)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.ListScalar, pa.ListScalar]]:
    for i in range(len(batch)):
        yield batch.column(0)[i].as_py(), batch.column(1)[i], batch.column(2)[i]


def group_counts(batches: Iterator[pa.RecordBatch], width: int, table: np.ndarray, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Counts of the groups of ``width`` + 1 words, of up to ``most`` occurrences together."""
    names = ["lang", *(f"w{k + 1}" for k in range(width + 1)), "n"]
    waiting: dict[str, list[np.ndarray]] = {}

    def counted(lang: str) -> pa.RecordBatch:
        groups, n = grouped(np.concatenate(waiting.pop(lang)))
        return pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), *(pa.array(groups[:, k], pa.int64()) for k in range(width + 1)), pa.array(n, pa.int64())], names=names)

    for batch in batches:
        for row in rows_of(batch):
            at, words = joined(row, width, table)
            if len(at):
                waiting.setdefault(row[0], []).append(words)
                sizes = {lang: sum(map(len, got)) for lang, got in waiting.items()}
                if sum(sizes.values()) >= most:
                    yield counted(max(sizes, key=sizes.get))
    for lang in list(waiting):
        yield counted(lang)


def extended(batches: Iterator[pa.RecordBatch], width: int, table: np.ndarray, after: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the relation of ``width`` + 1 words, of frequent groups (``after`` is their table) only."""
    for batch in batches:
        for row in rows_of(batch):
            at, words = joined(row, width, table)
            good = kept(after, mixed(row[0], words))
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), lists([at[good]], pa.int32()), lists([words[good].reshape(-1)], pa.int64())], names=["lang", "at", "words"])


def word_relation(docs: DataFrame, lang_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(R1, (lang, word, w1, n)), with ids that tell all words apart."""
    slim = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    schema = f"kind int, {OCCURRENCES}, word string, h long, n long"
    for seed in range(100):
        both = stored(slim.mapInArrow(lambda b, s=seed: occurrences(b, block, s), schema), "occurrences", by="kind")
        counts = stored(both.where("kind = 1").groupBy("lang", "word", F.col("h").alias("w1")).agg(F.sum("n").alias("n")), "words")
        if counts.groupBy("w1").agg((F.min("word") != F.max("word")).alias("two")).where("two").isEmpty():
            return both.where("kind = 0").select("lang", "at", "words"), counts
    raise ValueError("no seed of 100 tells all words apart")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text", block: int = 1 << 13, filter_bits: int = 1 << 27) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """([(lang, w1 ... wk, n) of the phrases of k words that occur ``least`` times, for k from 1], (lang, n) of all words,
    (lang, w, word) of the frequent words)."""
    relation, words = word_relation(docs, lang_col, text_col, block)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    found = [frequent.select("lang", "w1", "n")]
    share = docs.sparkSession.sparkContext.broadcast
    table = share(bit_table(found[0], 1, filter_bits))
    for width in range(1, longest):
        of_group = [f"w{k + 1}" for k in range(width + 1)]
        counts = relation.mapInArrow(lambda b, k=width, t=table: group_counts(b, k, t.value), "lang string, " + "".join(f"{w} long, " for w in of_group) + "n long")
        with few_rows_at_once(docs.sparkSession, ROWS_AT_ONCE):
            found.append(stored(counts.groupBy("lang", *of_group).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases"))
        if width + 1 < longest:
            after = share(bit_table(found[-1], width + 1, filter_bits))
            with few_rows_at_once(docs.sparkSession, ROWS_AT_ONCE):
                relation = stored(relation.mapInArrow(lambda b, k=width, t=table, a=after: extended(b, k, t.value, a.value), OCCURRENCES), "occurrences")
            table = after
    return found, totals, frequent.select("lang", F.col("w1").alias("w"), "word")


def wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) in exact arithmetic."""
    top = f"(1000000 * cast({a} as decimal(38,0)) * cast({a} as decimal(38,0)))"
    return F.expr(f"{top} div (cast({left} as decimal(38,0)) * cast({right} as decimal(38,0)))")


def with_cuts(found: list[DataFrame], width: int, most: int) -> DataFrame:
    """Phrases of ``width`` words with (a, k, l, r, score) of the lowest-scoring cut."""
    own = [f"w{k + 1}" for k in range(width)]
    out = found[width - 1].withColumnRenamed("n", "a")
    for k in range(1, width):
        head, tail = found[k - 1].withColumnRenamed("n", f"l{k}"), found[width - k - 1]
        tail = tail.select("lang", *(F.col(f"w{i + 1}").alias(f"w{i + 1 + k}") for i in range(width - k)), F.col("n").alias(f"r{k}"))
        out = out.join(bounded(head, most), ["lang", *own[:k]]).join(bounded(tail, most), ["lang", *own[k:]])
    cuts = F.array(*(F.struct(score_of("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, width)))
    return out.select("lang", *own, "a", F.array_min(cuts).alias("x")).select("lang", *own, "a", "x.l", "x.r", "x.score")


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    held: int = 50,
    top: int | None = 2000,
    lang_col: str = "lang",
    text_col: str = "text",
    block: int = 1 << 13,
    filter_bits: int = 1 << 27,
    most: int = 300_000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases (None: all). A phrase goes if a longer
    one that holds it has at least ``held`` per cent of its count. Counts of at most ``most`` rows are broadcast in joins."""
    found, totals, words = phrase_counts(docs, longest, least, lang_col, text_col, block, filter_bits)
    ranked = []
    for width in range(2, longest + 1):
        own = [f"w{k + 1}" for k in range(width)]
        scored = with_cuts(found, width, most)
        inner = [
            found[size - 1].select("lang", *(F.col(f"w{at + i + 1}").alias(f"w{i + 1}") for i in range(width)), "n")
            for size in range(width + 1, longest + 1)
            for at in range(size - width + 1)
        ]
        if inner:
            longer = reduce(DataFrame.union, inner).groupBy("lang", *own).agg(F.max("n").alias("longer"))
            scored = scored.join(longer, ["lang", *own], "left").where((F.col("longer").isNull()) | (wide(F.col("longer")) * 100 < wide(F.col("a")) * held))
        ranked.append(scored.select("lang", F.array(*own).alias("ws"), "a", "l", "r", "score"))
    scored = reduce(DataFrame.union, ranked)
    if top is not None:  # ties at the end stay until they are ordered by their words
        by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        scored = scored.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place")
    scored = stored(scored, "scored")
    named = scored.select("*", *(F.get("ws", F.lit(k)).alias(f"w{k + 1}") for k in range(longest)))
    for k in range(1, longest + 1):
        named = named.join(bounded(words.select("lang", F.col("w").alias(f"w{k}"), F.col("word").alias(f"word{k}")), most), ["lang", f"w{k}"], "left")
    phrase = F.concat_ws(" ", *(f"word{k}" for k in range(1, longest + 1)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = named.select("lang", phrase.alias("phrase"), "a", "l", "r", "score").withColumn("rank", F.row_number().over(order))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.join(bounded(totals, most), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(longest: int = 3, least: int = 10, held: int = 50, top: int = 2000) -> str:
    """DuckDB SQL for the registered query: every run of words is a row."""
    del longest
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') AS ws FROM pieces),
runs AS (
  SELECT lang, len.k AS k, unnest(list_transform(range(1, len(ws) - len.k + 2), lambda i: array_to_string(ws[i:i + len.k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k) len WHERE len(ws) >= len.k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL),
total AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= {least}),
cuts AS (SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS cut FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.cut + 1:], ' ')),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, part AS phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM cand WHERE k = 3) GROUP BY ALL),
left_over AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR longer * 100 < low.a * {held})
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM left_over JOIN total USING (lang) QUALIFY rank <= {top}
"""
