"""Operator 1: SimHash near-duplicates by bit-sliced comparison.

A document's 64-bit fingerprint is the bitwise majority of its shingles' XXH64 hashes. Distinct
fingerprints are compared, not documents, so copies cost one row. Two fingerprints within the radius
agree on ``agree`` of ``blocks`` bit blocks (pigeonhole, hence blocks - agree >= radius), so the
rows of each choice of blocks are sorted by those bits and only runs of equal bits are compared.

Comparison is bit-sliced: the fingerprints of a run are stored as 64 bit planes, 64 rows to a word;
differing bits are counted for 64 rows at a time by carry-save adders, and columns whose rows all
exceed the radius are abandoned between groups of planes. A long run is explored breadth-first, which
yields its components without listing its pairs; short runs are compared together, row against the
row k places on. A run longer than ``chunk`` is split into chunks and each two chunks meet in a task.

``similar_links`` finds different texts that share most of their shingles. Their fingerprints differ in too many bits for blocks, so
candidates are texts that agree on one of ``bands`` keys, each made of the least of their shingles' hashes under ``rows`` multipliers (MinHash:
texts of similarity J agree on a key with probability J ** rows, unrelated ones on none, so runs of equal keys do not grow with the table). They
differ in at most ``radius`` bits, and their sizes and
second fingerprints are not too far apart (``sides_alike``, told in the task that compares them, so that chance pairs are not joined); those that the sizes and the
parities of their shingle sets do not rule out (``may_be_similar``, which loses no similar pair) are verified by exact Jaccard similarity
of the sets. README has the measured recall.

Component ids come back to documents by joins in which fingerprints and components of very many rows are broadcast (``wide_join``), so a
text of a million copies is no hot key.

Null and blank texts have fingerprint zero and link like any other. Repeated rows and null ids keep
their rows; the component id is the smallest id of the component, null if it has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltbook.llm.common import bounded, stored, wide_join
from haltbook.llm.components import connected_components

SHORT_RUN = 32
QUERIES_AT_ONCE = 64
PLANES_AT_ONCE = 16
#: Keys of long runs that are broadcast, at most.
MOST_HOT = 300_000
#: Classes of shingle hashes whose parities are compared before whole sets are.
MARKS = 1024
#: Bits of a second fingerprint and how many may differ (of unrelated texts one pair in 15, of pairs at a similarity of 0.8 all but
#: some 3 in 10 million, by the binomial law), and the step of the sizes' logarithm.
SIDE_BITS, SIDE_RADIUS, LEAST_SIDE, STEP = 54, 21, 128, 0.02


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return majority(shingle_hashes(text, words, seed))


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """Hashes of the text's shingles, repeats included; none if it has no words."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, "<u8")
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxh64_intdigest(line, seed)], "<u8")
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[: len(tokens) - words]]
    return np.array([xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds what a very long text unpacks at once
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or b"", words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8"))
    return chosen.mapInArrow(task, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Vertical storage: row b holds bit b of all fingerprints, 64 of them to a word."""
    wide = np.zeros((-len(fps) % 64 + len(fps), 8), np.uint8)
    wide[: len(fps)] = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.ascontiguousarray(np.unpackbits(wide, axis=1, bitorder="little").T)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def within(differ, shape: tuple, columns: int, radius: int) -> np.ndarray:
    """Bitset of the positions with at most ``radius`` differing bits. ``differ(b, cols)`` gives the
    differing bits of plane b for the given columns; shape is that of the full answer."""
    out = np.zeros(shape, np.uint64)
    cols = np.arange(columns)
    size = shape[:-1] + (columns,)
    digits = [np.zeros(size, np.uint64) for _ in range(max(1, radius).bit_length())]
    over = np.zeros(size, np.uint64)
    for first in range(0, 64, PLANES_AT_ONCE):
        for b in range(first, first + PLANES_AT_ONCE):
            carry = differ(b, cols)
            for k, d in enumerate(digits):
                digits[k], carry = d ^ carry, d & carry
            over |= carry
        above, equal = over, np.full(over.shape, ~np.uint64(0))
        for k in reversed(range(len(digits))):  # count > radius, from the highest digit down
            if radius >> k & 1:
                equal = equal & digits[k]
            else:
                above, equal = above | equal & digits[k], equal & ~digits[k]
        alive = (~above).reshape(-1, len(cols)).any(axis=0)
        if not alive.all():
            cols, above, over = cols[alive], above[..., alive], over[..., alive]
            digits = [d[..., alive] for d in digits]
            if not len(cols):
                return out
    out[..., cols] = ~above
    return out


def explore(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of one long run, the row of the first one of its component."""
    n, planes = len(fps), bit_planes(fps)
    words = planes.shape[1]
    ones = ~np.uint64(0)
    fresh = np.packbits(np.arange(64 * words) < n, bitorder="little").view("<u8").copy()
    root, todo, start = np.full(n, -1), [], 0
    while start < n or todo:
        if not todo:
            if root[start] >= 0:
                start += 1
                continue
            root[start] = start
            fresh[start // 64] &= ~(np.uint64(1) << np.uint64(start % 64))
            todo = [start]
        batch, todo = np.array(todo[:QUERIES_AT_ONCE]), todo[QUERIES_AT_ONCE:]
        flips = np.where((fps[batch][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ones, np.uint64(0))
        near = within(lambda b, cols, f=flips: planes[b, cols][None, :] ^ f[:, b, None], (len(batch), words), words, radius)
        found = np.bitwise_or.reduce(near, axis=0) & fresh
        fresh &= ~found
        new = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
        root[new] = root[batch[0]]  # all that waits belongs to one component
        todo += new.tolist()
    return root


def nearest(fps: np.ndarray, radius: int, block: int = 256, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row to the ``most`` that differ least in its block of rows, which are dealt by hash and anew for each run."""
    order = np.argsort((fps ^ np.bitwise_xor.reduce(fps)) * np.uint64(0x9E3779B97F4A7C15))
    us, vs = [], []
    for at in range(0, len(fps), block):
        rows = order[at : at + block]
        differ = np.bitwise_count(fps[rows][:, None] ^ fps[rows])
        np.fill_diagonal(differ, 65)
        near = np.argsort(differ, axis=1, kind="stable")[:, :most]
        hit = np.take_along_axis(differ, near, axis=1) <= radius
        us.append(np.broadcast_to(rows[:, None], near.shape)[hit])
        vs.append(rows[near[hit]])
    return np.concatenate(us), np.concatenate(vs)


def run_links(keys: np.ndarray, fps: np.ndarray, radius: int, more: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted runs of equal keys: row numbers (u, v), enough to connect what is linked. With ``more``, rows of long runs are
    linked to the ``nearest`` ones, too, for links that are looked at further may not all stay."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    length = np.diff(edge)
    us, vs = [], []
    for k in np.flatnonzero(length > SHORT_RUN):
        a, b = edge[k], edge[k + 1]
        root = explore(fps[a:b], radius)
        linked = np.flatnonzero(root != np.arange(b - a))
        us.append(a + linked)
        vs.append(a + root[linked])
        if more:
            u, v = nearest(fps[a:b], radius)
            us.append(a + u)
            vs.append(a + v)
    rows = np.repeat((length > 1) & (length <= SHORT_RUN), length)
    if rows.any():
        at = np.flatnonzero(rows)
        run = np.repeat(np.arange(len(length)), length)[at]
        planes = np.pad(bit_planes(fps[at]), ((0, 0), (0, 2)))
        words = planes.shape[1] - 2
        for lag in range(1, min(SHORT_RUN, int(length[length <= SHORT_RUN].max()))):
            same = np.zeros(64 * words, bool)
            same[: max(0, len(at) - lag)] = run[lag:] == run[:-lag]
            if not same.any():
                break
            valid = np.packbits(same, bitorder="little").view("<u8")
            low, high = np.uint64(lag), np.uint64(64 - lag)

            def differ(b, cols, low=low, high=high):
                p = planes[b]
                return p[cols] ^ ((p[cols] >> low) | (p[cols + 1] << high))

            near = within(differ, (words,), words, radius) & valid
            hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
            us.append(at[hit + lag])
            vs.append(at[hit])
    if not us:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(us), np.concatenate(vs)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(radius: int, blocks: int, agree: int) -> list[int]:
    """All choices of ``agree`` bit blocks: fingerprints within the radius agree on one of them."""
    if blocks - agree < radius:
        raise ValueError("blocks - agree must be at least the radius")
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    return [signed(sum(((1 << (bounds[k + 1] - bounds[k])) - 1) << bounds[k] for k in chosen)) for chosen in combinations(range(blocks), agree)]


def masked(masks: list[int]) -> Column:
    """A long for each mask that tells it and the bits of fp under it: keys that fall together only cost comparisons."""
    return F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for t, m in enumerate(masks)))


@cache
def multipliers(count: int, seed: int = 0) -> np.ndarray:
    """``count`` fixed odd numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 64, count, np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``bands`` longs, each of the least products of ``hashes`` with ``rows`` multipliers; none if there are no hashes."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    factors, least = multipliers(bands * rows)[:, None], np.full(bands * rows, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 10):  # stays in the cache
        np.minimum(least, (factors * hashes[at : at + (1 << 10)]).min(axis=1), out=least)
    keys = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def keyed_by(distinct: DataFrame, masks: list[int] | None, *columns: str) -> DataFrame:
    return distinct.select(*columns, F.explode("keys" if masks is None else masked(masks)).alias("bits"))


def long_runs(keyed: DataFrame, least: int) -> DataFrame:
    """(bits, n) of keys of more than ``least`` rows."""
    return stored(keyed.groupBy("bits").agg(F.count("*").alias("n")).where(F.col("n") > least), "hot")


def fingerprint_links(
    distinct: DataFrame, radius: int, masks: list[int] | None, chunk: int = 4096, alike: Callable | None = None, runs: DataFrame | None = None
) -> DataFrame:
    """(u, v) links of fingerprints (column fp, distinct) within the radius: they connect all of these that are equal under one
    of the masks or, without masks, share one of their longs in the column keys. With ``alike`` only links stay whose values of the column
    side it accepts (two arrays of unsigned longs). ``runs`` are ``long_runs`` of at most ``chunk`` rows, where these are known."""
    carried = ["fp"] if alike is None else ["fp", "side"]
    keyed = keyed_by(distinct, masks, *carried)
    # Counted first: their number is known, and few are broadcast instead of dealing all keys once more.
    hot = bounded((long_runs(keyed, chunk) if runs is None else runs).where(F.col("n") > chunk), MOST_HOT)
    spread = (
        keyed.join(hot, "bits", "left")
        .withColumn("parts", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bits", (F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other")).alias("part"), *carried)
    )
    dealt = spread.repartition("bits", "part").sortWithinPartitions("bits", "part")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None

        def links(k: np.ndarray, f: np.ndarray, *side: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(k) > 1:
                u, v = run_links(k, f.view(np.uint64), radius, alike is not None)
                if alike is not None:
                    own = side[0].view(np.uint64)
                    near = alike(own[u], own[v])
                    u, v = u[near], v[near]
                ends = f[u], f[v]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], names=["u", "v"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.any([c[1:] != c[:-1] for c in cols[:2]], axis=0)
            run = np.concatenate([[0], np.cumsum(new)])
            last = int(np.searchsorted(run, run[-1]))  # the last run may go on in the next batch
            yield from links(run[:last], *(c[:last] for c in cols[2:]))
            kept = tuple(c[last:] for c in cols)
        if kept is not None:
            yield from links(np.zeros(len(kept[0]), int), *kept[2:])

    return dealt.mapInArrow(task, "u long, v long")


def near_duplicates(
    docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", blocks: int = 5, agree: int = 2, chunk: int = 4096
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``."""
    marked = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    found = connected_components(fingerprint_links(distinct.select("fp"), radius, block_masks(radius, blocks, agree), chunk))
    labelled = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    of_root = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = wide_join(labelled, of_root, ["root"]).select("fp", "component_id")
    return wide_join(marked, of_fp, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def side_of(hashes: np.ndarray) -> int:
    """In one unsigned long, what two texts are compared by besides their fingerprints: the logarithm of the size of the set of
    ``hashes`` in steps of ``STEP``, and ``SIDE_BITS`` bits of a second fingerprint, of the set."""
    h = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    size = min(int(np.log(max(1, len(hashes))) / STEP), (1 << (64 - SIDE_BITS)) - 1)
    return size << SIDE_BITS | majority(h ^ (h >> np.uint64(31))) & ((1 << SIDE_BITS) - 1)


def sides_alike(u: np.ndarray, v: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs can be similar: sizes that rule it out go without loss, and of sets of ``LEAST_SIDE`` hashes or more pairs that differ
    in over ``SIDE_RADIUS`` bits (the bits of smaller sets scatter more, so these pass)."""
    bits = np.uint64(SIDE_BITS)
    steps = (u >> bits).astype(np.int64) - (v >> bits).astype(np.int64)
    differ = np.bitwise_count((u ^ v) & np.uint64((1 << SIDE_BITS) - 1))
    small = np.minimum(u >> bits, v >> bits) < np.uint64(np.log(LEAST_SIDE) / STEP)
    return (np.abs(steps) <= int(-np.log(threshold) / STEP) + 1) & (small | (differ <= SIDE_RADIUS))


def sketches(docs: DataFrame, words: int, bands: int = 24, rows: int = 4) -> DataFrame:
    """(doc_id, fp, side, n, marks, keys) of (doc_id, text): side is ``side_of``, n counts the distinct shingle hashes, marks are the parities of how many of
    them fall in each of ``MARKS`` classes, keys are their ``band_keys``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sides, sizes, marks, keys = [], [], [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py() or b"", words)
                fps.append(majority(hashes))
                every = np.unique(hashes)
                sizes.append(len(every))
                sides.append(side_of(every))
                odd = np.bincount((every & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
                marks.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                keys.append(band_keys(every, bands, rows).view(np.int64))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sides)]
            columns = [batch.column(0), *longs, pa.array(sizes, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (marks, keys))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "side", "n", "marks", "keys"])

    return docs.select("doc_id", F.encode("text", "UTF-8")).mapInArrow(task, "doc_id long, fp long, side long, n int, marks array<long>, keys array<long>")


def may_be_similar(pairs: DataFrame, marked: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (a, b) without those whose sizes or marks rule out that they are similar (``within_bounds``)."""
    x = marked.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("marks").alias("marks_a"))
    y = marked.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("marks").alias("marks_b"))
    need = (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9
    sizes = wide_join(pairs, x.drop("marks_a"), ["a"]).join(y.drop("marks_b"), "b").where((F.least("n_a", "n_b") >= need) & (F.least("n_a", "n_b") > 0))
    told = sizes.drop("n_a", "n_b").join(x, "a").join(y, "b")
    return told.where(within_bounds(threshold)).select("a", "b")


def shingle_sets(docs: DataFrame, words: int, most: int = 1 << 20) -> DataFrame:
    """(doc_id, hashes) of (doc_id, text binary): the distinct hashes of each text's shingles; rows of at most some ``most`` hashes are sent together."""

    def hashes(text: bytes) -> np.ndarray:
        from xxhash import xxh64_intdigest

        tokens = text.lower().split()
        found = {xxh64_intdigest(b" ".join(tokens[i : i + words]), 42) for i in range(max(1, len(tokens) - words + 1))} if tokens else ()
        return np.fromiter(found, np.uint64, len(found)).view(np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, held = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                rows.append(hashes(t.as_py() or b""))
                held += len(rows[-1])
                if held >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "hashes"])
                    ids, rows, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "hashes"])

    return docs.mapInArrow(task, "doc_id long, hashes array<long>")


def within_bounds(threshold: float) -> Column:
    """Whether sizes and marks (n_a, marks_a, n_b, marks_b) leave open that two sets are similar. Similar sets of n and m hashes share
    need = (n + m) t / (1 + t) at least, so neither is smaller and they differ in n + m - 2 need hashes at most; each class of
    unequal parity holds one of these. No similar pair is lost."""
    both = F.col("n_a") + F.col("n_b")
    need = both * (threshold / (1 + threshold)) - 1e-9
    differ = sum((F.bit_count(F.get("marks_a", F.lit(k)).bitwiseXOR(F.get("marks_b", F.lit(k)))) for k in range(MARKS // 64)), F.lit(0))
    return (F.least("n_a", "n_b") >= need) & (F.least("n_a", "n_b") > 0) & (differ <= both - need * 2)


def verified(pairs: DataFrame, slim: DataFrame, words: int, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) of ids whose texts' shingle sets have at least this Jaccard similarity, as (u, v)."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = slim.join(wanted, "doc_id", "left_semi").select("doc_id", F.encode("text", "UTF-8").alias("text"))
    sets = stored(shingle_sets(texts, words), "sets")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    both = wide_join(wide_join(pairs, left, ["a"]), right, ["b"])
    need = (F.size("x") + F.size("y")) * (threshold / (1 + threshold)) - 1e-9
    near = (F.size("x") > 0) & (F.least(F.size("x"), F.size("y")) >= need) & (F.size(F.array_intersect("x", "y")) >= need)
    return both.where(near).select(F.col("a").alias("u"), F.col("b").alias("v"))


def similar_links(
    docs: DataFrame, words: int = 5, threshold: float = 0.8, radius: int = 22, bands: int = 24, rows: int = 4, id_col: str = "doc_id", text_col: str = "text", chunk: int = 4096
) -> DataFrame:
    """(u, v): pairs of ids (unique, not null) whose texts' shingle sets have at least this Jaccard similarity. Texts without
    words are in no pair. Rows of long runs meet some of the run's rows first; those that are similar to none of them then meet all."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = stored(sketches(slim, words, bands, rows), "wide")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    one = marked.join(distinct.select(F.col("least_id").alias("doc_id")), "doc_id", "left_semi")
    runs = long_runs(keyed_by(one, None), min(chunk, SHORT_RUN))
    found = fingerprint_links(one.select("fp", "side", "keys"), radius, None, chunk, lambda u, v: sides_alike(u, v, threshold), runs)
    links = stored(found.distinct(), "links")
    ends = links.join(distinct.select(F.col("fp").alias("u"), F.col("least_id").alias("a")), "u").join(distinct.select(F.col("fp").alias("v"), F.col("least_id").alias("b")), "v")
    copies = wide_join(marked.select("doc_id", "fp"), distinct, ["fp"]).where("doc_id <> least_id").select(F.col("doc_id").alias("a"), F.col("least_id").alias("b"))
    pairs = stored(may_be_similar(stored(ends.select("a", "b").union(copies), "candidates"), marked, threshold), "maybe")
    similar = stored(verified(pairs, slim, words, threshold), "similar")
    if runs.isEmpty():
        return similar
    linked = similar.select(F.col("u").alias("doc_id")).union(similar.select(F.col("v").alias("doc_id"))).distinct()
    crowd = keyed_by(one, None, "doc_id", "n", "marks").join(bounded(runs.select("bits"), MOST_HOT), "bits", "left_semi")
    crowd = stored(crowd.join(bounded(linked.withColumn("linked", F.lit(True)), MOST_HOT), "doc_id", "left"), "crowd")
    alone = crowd.where("linked is null")
    x = alone.select("bits", F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("marks").alias("marks_a"))
    y = crowd.join(bounded(alone.select("bits").distinct(), MOST_HOT), "bits", "left_semi").select("bits", F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("marks").alias("marks_b"))
    left = x.join(y, (x.bits == y.bits) & (F.col("a") != F.col("b")) & within_bounds(threshold)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return similar.union(verified(stored(left.distinct(), "left"), slim, words, threshold))
