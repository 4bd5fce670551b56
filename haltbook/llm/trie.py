"""Operator 11: prefix trie of conversations over vertical bitmaps.

1. Turns are numbered by turn (null first), ties by role, then the text's first 200 characters, then two hashes of
   role and text. Equal turns of equal number are repeats and stay. A table that is range-partitioned by this order is
   numbered in two levels, so a conversation may be of any length. Rows without conv_id are no conversation's.
2. Every conversation takes its first turns from the head of its group (``rebuilt``).
3. Conversations of a group and up to 4096 of their positions are a unit; a task collects units into shards of
   bounded size. A shard indexes each (position, turn) to a bitset of its conversations. From a node's
   bitset, depth first, intersections with the postings of the next position that its conversations have yield the
   children; population counts give members, and what has no further turn is the end list.
4. A node is known over all shards by depth and a 128-bit hash of its path (the exclusive or of hashes of
   position and turn, so that a unit in the middle of a conversation starts from an entry key). Shards' nodes
   are merged by aggregation. End lists are sorted by range partitioning and digested as streams.
5. The smallest member of a node owns it, so what a conversation owns is a path down to its end, and paths hang
   on paths. Sums over path trees are taken by pointer jumping (a number of rounds logarithmic in the nesting),
   sums down a path by a two-level suffix sum. Joins on a key that many rows share (the root's children) broadcast that
   key's row alone: there are at most ``common.WIDE`` such keys, whatever the size.

Null role or text becomes empty. A conversation without turns of its own is none; one whose rebuilt form has no turn is a
member and an end of the root. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltbook.llm.common import WORD, stored, wide_join

#: Positions of a conversation that are in one unit.
SPAN = 4096
#: Ids of an end list in one chunk.
CHUNK = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

NODES = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, words long"
ENDS = "depth long, k1 long, k2 long, ends array<long>"


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with p, the number (from 1) in the order of its key. A key's rows may be in any number of range partitions."""
    ranged = stored(rows.repartitionByRange(F.col(key), *order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(key, "__part").agg(F.count("*").alias("n"))
    several = counts.groupBy(key).agg(F.count("*").alias("parts")).where("parts > 1").select(key)
    before = F.sum("n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.join(several, key).select(key, "__part", F.coalesce(before, F.lit(0)).alias("before"))  # two rows a partition at most
    p = F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order)) + F.coalesce("before", F.lit(0))
    return ranged.join(F.broadcast(offsets), [key, "__part"], "left").withColumn("p", p.cast("long")).drop("__part", "before")


def turns_of(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, p, t1, t2, words) of the original turns."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    slim = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        F.left(text, F.lit(200)).alias("start"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), F.length(text), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("start"), F.asc("t1"), F.asc("t2")]
    return numbered(slim, "conv_id", order).select("conv_id", "p", "t1", "t2", "words")


def rebuilt(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """(conv_id, pos, t1, t2, words, len): pos counts from 1, a row of pos 0 stands for every conversation. Conversation c begins with the
    first h turns of conversation c - c % ``group``, and goes on with its own after its first h; h = crc32(c) % ``heads``."""
    turns = stored(turns, "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("p") < heads)).groupBy(F.col("conv_id").alias("base"))
    head = first.agg(F.sort_array(F.collect_list(F.struct("p", "t1", "t2", "words"))).alias("head"))  # less than ``heads`` turns
    taken = F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast("array<struct<p:long,t1:long,t2:long,words:long>>"))
    convs = stored(convs.join(head, "base", "left").select("conv_id", "n", "h", taken.alias("head")), "convs")
    length = F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    every = convs.select("conv_id", F.explode(F.concat(F.array(F.struct(*(F.lit(0).cast("long").alias(c) for c in ("p", "t1", "t2", "words")))), "head")).alias("x"), length.alias("len"))
    of_head = every.select("conv_id", F.col("x.p").alias("pos"), "x.t1", "x.t2", "x.words", "len")
    after = turns.where(F.col("p") > h)
    own = wide_join(after, convs.select("conv_id", (F.size("head") - F.col("h")).alias("shift"), length.alias("len")), ["conv_id"])
    return of_head.union(own.select("conv_id", (F.col("p") + F.col("shift")).alias("pos"), "t1", "t2", "words", "len"))


def units(rows: DataFrame, group: int) -> DataFrame:
    """(base, block, conv_id, pos, x1, x2, words, len, entry): rows by unit. (x1, x2) tells position and turn; each conversation begins in a block
    with an entry row, whose (x1, x2) is the key of what precedes."""
    own = rows.select(
        "conv_id", "pos", F.floor((F.col("pos") - 1) / SPAN).alias("block"), F.xxhash64("pos", "t1", "t2").alias("x1"), F.xxhash64("t2", "pos", "t1").alias("x2"), "words", "len"
    )
    turns = own.where("pos > 0")
    sums = turns.where(F.col("len") > SPAN).groupBy("conv_id", "block", "len").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    w = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    later = sums.select("conv_id", "len", F.bit_xor("x1").over(w).alias("x1"), F.bit_xor("x2").over(w).alias("x2"), (F.col("block") + 1).alias("block")).where(F.col("block") * SPAN < F.col("len"))
    zero = F.lit(0).cast("long")
    entries = own.where("pos = 0").select("conv_id", zero.alias("block"), "pos", zero.alias("x1"), zero.alias("x2"), "words", "len")
    entries = entries.union(later.select("conv_id", "block", F.col("block") * SPAN, "x1", "x2", zero, "len"))
    both = turns.select("conv_id", "block", "pos", "x1", "x2", "words", "len", F.lit(False).alias("entry")).union(entries.select("*", F.lit(True)))
    return both.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)


class Shard:
    """Conversations of one depth-first search."""

    def __init__(self):
        self.convs: list[int] = []  # ascending within a unit; bit i stands for convs[i]
        self.first: list[int] = []  # depth of the entry
        self.length: list[int] = []
        self.paths: list[list[tuple[int, int, int]]] = []  # (x1, x2, words) of each turn from the entry on
        self.roots: dict[tuple[int, int, int], int] = {}
        self.postings: dict[tuple[int, int, int], int] = {}
        self.size = 0

    def add(self, conv: int, pos: int, x1: int, x2: int, words: int, length: int, entry: bool) -> None:
        self.size += 1
        if entry:
            bit = 1 << len(self.convs)
            self.roots[pos, x1, x2] = self.roots.get((pos, x1, x2), 0) | bit
            for column, v in ((self.convs, conv), (self.first, pos), (self.length, length), (self.paths, [])):
                column.append(v)
        else:
            bit = 1 << len(self.convs) - 1
            self.postings[pos, x1, x2] = self.postings.get((pos, x1, x2), 0) | bit
            self.paths[-1].append((x1, x2, words))

    def nodes(self) -> Iterator[tuple[tuple, list[int]]]:
        """((depth, k1, k2, p1, p2, smallest member, members, words of the last turn), ids that end here)."""
        convs, paths, first, postings = self.convs, self.paths, self.first, self.postings
        for (depth, k1, k2), bits in self.roots.items():
            # A root of depth 0 is a node; the entry of a later block is one of the block before.
            todo = [(depth, k1, k2, 0, 0, bits, 0, depth == 0)]
            while todo:
                depth, k1, k2, p1, p2, bits, words, own = todo.pop()
                members, ended, rest = [], [], bits
                while rest:
                    low = rest & -rest
                    rest ^= low
                    members.append(low.bit_length() - 1)
                going = 0
                for i in members:
                    if depth == self.length[i]:
                        ended.append(convs[i])
                    elif depth - first[i] < len(paths[i]):
                        going |= 1 << i
                if own:
                    yield (depth, k1, k2, p1, p2, min(convs[i] for i in members), bits.bit_count(), words), ended
                while going:
                    i = (going & -going).bit_length() - 1
                    x1, x2, w = paths[i][depth - first[i]]
                    child = going & postings[depth + 1, x1, x2]
                    going &= ~child
                    todo.append((depth + 1, k1 ^ x1, k2 ^ x2, k1, k2, child, w, True))


def shard_nodes(batches: Iterator[pa.RecordBatch], convs: int, turns: int) -> Iterator[pa.RecordBatch]:
    """Rows of NODES and ENDS from units that follow each other; a shard is closed after a unit that fills it."""
    node_names, end_names = ([c.split()[0] for c in s.split(", ")] for s in (NODES, ENDS))

    def rows(shard: Shard) -> Iterator[pa.RecordBatch]:
        found, ends = [], []
        for node, ended in shard.nodes():
            found.append(node)
            ends.append(sorted(ended) if ended else None)
        if found:
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ends, pa.list_(pa.int64()))], names=[*node_names, end_names[-1]])

    shard, unit = Shard(), None
    for batch in batches:
        for base, block, conv, pos, x1, x2, words, length, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (base, block) != unit:
                if len(shard.convs) >= convs or shard.size >= turns:
                    yield from rows(shard)
                    shard = Shard()
                unit = base, block
            shard.add(conv, pos, x1, x2, words, length, entry)
    yield from rows(shard)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha) from (depth, k1, k2, conv_id): digests of ascending ids. Each range partition digests the nodes that are whole in it; of those at its
    edges it sends chunks of text, which one task a node digests in order."""
    key = ["depth", "k1", "k2"]
    schema = "depth long, k1 long, k2 long, first long, chunk string, sha string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def parts(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[pa.RecordBatch]:
        """Of each node: its digest, or chunks if it is the partition's first or last one."""
        out: list[tuple] = []
        now, ids, edge = None, [], True
        for batch in batches:
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != now:
                    if now is not None:
                        text = ",".join(map(str, ids))
                        out.append((*now, ids[0], text, None) if edge else (*now, ids[0], None, hashlib.sha256(text.encode()).hexdigest()))
                        edge = False
                    now, ids = node, []
                elif len(ids) >= most:
                    out.append((*now, ids[0], ",".join(map(str, ids)), None))
                    ids, edge = [], True  # a long list is digested with those at the edges
                ids.append(conv)
                if len(out) >= 1000:
                    yield table(out)
                    out = []
        if now is not None:
            out.append((*now, ids[0], ",".join(map(str, ids)), None))
        if out:
            yield table(out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sha = None
        for batch in batches:
            for *node, _, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != now:
                    if now is not None:
                        yield table([(*now, None, None, sha.hexdigest())])
                    now, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(chunk.encode())
        if now is not None:
            yield table([(*now, None, None, sha.hexdigest())])

    ranged = stored(ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(parts, schema), "ends")
    chunks = ranged.where("sha is null").select(*key, "first", "chunk").repartition(*key).sortWithinPartitions(*key, "first")
    return ranged.where("sha is not null").select(*key, "sha").union(chunks.mapInArrow(digest, schema).select(*key, "sha"))


def merged(rows: DataFrame, group: int, convs: int, turns: int) -> DataFrame:
    """(depth, k1, k2, p1, p2, conv_id, n_convs, words, n_children, ends_sha256), one row a node."""
    dealt = units(rows, group).repartition("base", "block").sortWithinPartitions("base", "block", "conv_id", "pos", F.desc("entry"))
    chosen = dealt.select("base", "block", "conv_id", "pos", "x1", "x2", "words", "len", "entry")
    partial = stored(chosen.mapInArrow(lambda b: shard_nodes(b, convs, turns), f"{NODES}, ends array<long>"), "nodes")
    key = ["depth", "k1", "k2"]
    digests = end_digests(partial.where("ends is not null").select(*key, F.explode("ends").alias("conv_id")))
    children = partial.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.struct(F.col("k1").alias("a"), F.col("k2").alias("b")).alias("child"))
    children = children.distinct().groupBy(*key).agg(F.count("*").alias("n_children"))
    every = partial.drop("ends").unionByName(children, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    nodes = every.groupBy(*key).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"),
        F.coalesce(F.max("n_children"), F.lit(0)).alias("n_children"), F.coalesce(F.max("sha"), F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    return stored(nodes, "merged")


def path_sums(paths: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) summed over each path and all that hang on it, from (conv_id, on, leaves, saved). After k rounds ``on`` is 2 ** k
    paths up and the sums hold what is less than that below."""
    now = stored(paths, "paths")
    while not now.where("on is not null").isEmpty():
        hung = now.where("on is not null")
        given = hung.groupBy(F.col("on").alias("conv_id")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        up = wide_join(hung.select("conv_id", "on"), now.select(F.col("conv_id").alias("on"), F.col("on").alias("above")), ["on"]).select("conv_id", F.col("above").alias("on"))
        sums = now.select("conv_id", "leaves", "saved").union(given)
        every = sums.unionByName(up, allowMissingColumns=True)
        now = stored(every.groupBy("conv_id").agg(F.max("on").alias("on"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select("conv_id", "on", "leaves", "saved"), "paths")
    return now.drop("on")


def prefix_trie(
    conversations: DataFrame, group: int = 20, heads: int = 4, convs: int = 4096, turns: int = 200_000, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node. A shard is closed once it holds
    ``convs`` conversations or ``turns`` turns."""
    nodes = merged(rebuilt(turns_of(conversations, conv_col, turn_col, role_col, text_col), group, heads), group, convs, turns)
    own_of = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    linked = wide_join(nodes.where("depth > 0"), own_of, ["depth", "p1", "p2"]).unionByName(nodes.where("depth = 0"), allowMissingColumns=True)
    linked = stored(
        linked.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
        ),
        "linked",
    )
    top = F.min_by("parent_conv_id", "depth").alias("on"), F.min("depth").alias("at")
    paths = stored(linked.groupBy("conv_id").agg(*top, F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")), "tops")
    hung = path_sums(paths.drop("at")).join(paths.where("on is not null").select("conv_id", "on", "at"), "conv_id")
    hung = hung.groupBy(F.col("on").alias("conv_id"), (F.col("at") - 1).alias("depth")).agg(F.sum("leaves").alias("leaf"), F.sum("saved").alias("saved"))
    # What stands at each depth of a path: the node's own part, and the whole of what hangs there.
    amounts = linked.select("conv_id", "depth", "leaf", "saved").union(hung).groupBy("conv_id", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    amounts = stored(amounts.withColumn("block", F.floor(F.col("depth") / SPAN)), "amounts")
    below = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = amounts.where(F.col("block") > 0).select("conv_id").distinct()
    blocks = amounts.join(blocks, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    offsets = blocks.select("conv_id", "block", F.sum("l").over(below).alias("l"), F.sum("s").over(below).alias("s"))
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = amounts.join(offsets, ["conv_id", "block"], "left").select(
        "conv_id", "depth", (F.sum("leaf").over(down) + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.sum("saved").over(down) + F.coalesce("s", F.lit(0))).alias("saved_tokens")
    )
    return linked.join(summed, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def oracle_sql() -> str:
    """DuckDB SQL for the registered query. A prefix is the string of its turns' md5; crc32 goes bit by bit."""
    step = "xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda s, b: {step}), 4294967295::BIGINT)"
    return rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {crc} % 4 AS h FROM t),
heads AS (SELECT c.conv_id, t.p AS pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h),
m AS (SELECT conv_id, count(*) AS m FROM heads GROUP BY 1),
r AS (
  FROM heads
  UNION ALL SELECT conv_id, coalesce(m, 0) + p - h, role, text FROM t JOIN c USING (conv_id) LEFT JOIN m USING (conv_id) WHERE p > h),
s AS (
  SELECT conv_id, pos AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
    string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS pre FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
len AS (SELECT conv_id, max(d) AS d FROM s GROUP BY 1),
nodes AS (SELECT d, pre, left(pre, 32 * (d - 1)::INT) AS par, min(conv_id) AS conv_id, count(*) AS n, max(w) AS w FROM s GROUP BY ALL),
kids AS (SELECT par AS pre, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (pre)),
sub AS (
  SELECT x.pre, count(*) FILTER (WHERE y.k = 0) AS leaves, sum((y.n - 1) * y.w) AS saved
  FROM full_nodes x JOIN full_nodes y ON starts_with(y.pre, x.pre) GROUP BY 1),
ends AS (SELECT pre, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM s JOIN len USING (conv_id, d) GROUP BY 1)
SELECT x.conv_id::BIGINT AS conv_id, x.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, x.n::BIGINT AS n_convs, x.k::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM full_nodes x JOIN sub USING (pre) LEFT JOIN ends USING (pre) LEFT JOIN nodes p ON x.d > 0 AND p.pre = x.par
"""
