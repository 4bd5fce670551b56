"""Operator 10: hierarchical multi-length packing.

Each task packs the documents of its own partition, block by block, so no row is shuffled and no
state is larger than one block. Within a block

1. every document gives its full ``window``-token pieces, each a sequence of its own;
2. the remainders are routed to tiers (powers of two up to the window) by their length;
3. tiers are packed from the longest to the shortest: a window opens with the longest remainder of
   its tier, its gap is filled with the longest remainders that fit from the same and shorter tiers,
   and what is then left of the gap takes the head of the shortest remainder that is longer;
4. what cannot fill a window moves on to the next block; after the last block it is cut into
   power-of-two sequences, which need no padding.

Step groups hold sequences of one tier and block, about ``step_tokens`` tokens each. The groups of a tier
and block are equal in number of sequences to within one and balanced by attention cost. Groups do not
cross tasks, so a task with fewer tokens has shorter groups. The last tokens of a task (fewer than the
shortest tier) become sequences of smaller powers of two.

Null texts count as empty: their only id is the end id. A null document id is passed through.
Repeated rows are packed row by row. An empty table gives no pieces.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from heapq import heappop, heappush
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltbook.llm.common import Generations, single_threaded

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier long, step_group long"
)

#: Marks that end a chunk; none of them joins a letter before it.
MARKS = ".,;:!?%$#&*|"

_encoders: dict = {}


class ChunkEncoder:
    """Tokenizer ids of whole texts from the ids of their white-space chunks.

    The tokenizer drops white space before it merges, so a text's ids are its chunks' ids in a row;
    chunks repeat, so each is encoded once while it stays in the bounded map.
    """

    def __init__(self, path: str, size: int, longest: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known, self.longest = Generations(size), longest
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters only. Many are encoded as one text: each gives one piece, and the last
        id of a piece is one that ends a word. Should the counts differ, words are encoded one by one."""
        out: list[bytes] = []
        for first in range(0, len(words), 1024):
            part = words[first : first + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part) or len(ids) != ends[-1]:
                out += self._ids(part)
                continue
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        """Ids of unknown chunks. The tokenizer parts letters from marks, so a word and the marks
        behind it are looked up apart: far fewer words than chunks are new. A word whose normal or
        lower-case form has other than letters stays whole."""
        known, parts, plain = self.known, {}, set()
        for c in chunks:
            text = c.decode()
            word = text.rstrip(MARKS)
            if word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha()):
                if word != text:
                    at = len(word.encode())
                    parts[c] = c[:at], c[at:]
                    plain.add(c[:at])
                else:
                    plain.add(c)
        new = known.missing(x for c in chunks for x in parts.get(c, (c,)))
        words = [x for x in new if x in plain]
        other = [x for x in new if x not in plain]
        young = known.young
        young.update(zip(words, self._words(words), strict=True))
        young.update(zip(other, self._ids(other), strict=True))
        for c, (word, marks) in parts.items():
            young[c] = young[word] + young[marks]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        for first in range(0, len(texts), 256):
            split = [t.split() for t in texts[first : first + 256]]
            known.turn()
            new = known.missing(set().union(*split))
            young = known.young
            self._learn(new)
            for chunks in split:
                yield b"".join(map(young.__getitem__, chunks))
            for c in new:
                if len(c) > self.longest:
                    young.pop(c, None)


def _encoder(path: str, size: int) -> ChunkEncoder:
    if (path, size) not in _encoders:
        single_threaded()
        _encoders[path, size] = ChunkEncoder(path, size)
    return _encoders[path, size]


class Packer:
    """The sequences of one task."""

    def __init__(self, first_id: int, window: int, shortest: int, step_tokens: int):
        self.next_id, self.window, self.step_tokens, self.base = first_id, window, step_tokens, first_id
        self.tiers = []
        while window >= shortest:
            self.tiers.append(window)
            window //= 2
        self.waiting: dict[int, list[list[tuple[int, int, int]]]] = {tier: [] for tier in self.tiers}
        self.groups = 0
        self.rest: list[tuple[int, int, int]] = []  # (length, document, start), by length
        self.pieces: list[tuple] = []

    def add(self, doc: int, n: int) -> None:
        start = 0
        while n - start >= self.window:
            self._sequence([(doc, start, self.window)], self.window)
            start += self.window
        if n > start:
            insort(self.rest, (n - start, doc, start))

    def _sequence(self, parts: list[tuple[int, int, int]], tier: int) -> None:
        self.waiting.setdefault(tier, []).append(parts)

    def group(self) -> None:
        """Step groups of the sequences that wait: as many as fill them best, equal in number to within
        one sequence. Sequences are dealt by their attention cost (the sum of squared piece lengths),
        dearest first, each to the cheapest group that has room."""
        for tier, sequences in self.waiting.items():
            if not sequences:
                continue
            count = max(1, round(len(sequences) * tier / self.step_tokens))
            room = -(-len(sequences) // count)
            cost = [sum(n * n for _, _, n in parts) for parts in sequences]
            heap = [(0, g, 0) for g in range(count)]
            for k in sorted(range(len(sequences)), key=lambda k: -cost[k]):
                spent, g, held = heappop(heap)
                at, number = 0, self.base + self.groups + g
                for doc, start, length in sequences[k]:
                    self.pieces.append((doc, start, length, self.next_id, at, tier, number))
                    at += length
                self.next_id += 1
                if held + 1 < room:
                    heappush(heap, (spent + cost[k], g, held + 1))
            self.groups += count
            self.waiting[tier] = []

    def pack(self) -> None:
        """Fill all windows that can be filled; keep the rest."""
        rest, kept = self.rest, []
        for tier in self.tiers:
            while rest and (rest[-1][0] > tier // 2 or tier == self.tiers[-1]):
                n, doc, start = rest.pop()
                parts, gap = [(doc, start, n)], tier - n
                while gap and rest:
                    k = bisect_right(rest, (gap, float("inf"), 0)) - 1
                    if k >= 0:
                        n, doc, start = rest.pop(k)
                        parts.append((doc, start, n))
                        gap -= n
                    else:
                        n, doc, start = rest.pop(bisect_left(rest, (gap + 1, -1, 0)))
                        parts.append((doc, start, gap))
                        insort(rest, (n - gap, doc, start + gap))
                        gap = 0
                if gap:
                    kept += parts
                else:
                    self._sequence(parts, tier)
        self.rest = sorted((n, doc, start) for doc, start, n in kept)

    def finish(self) -> None:
        """Cut what is left into sequences whose lengths are powers of two."""
        left = [(doc, start, n) for n, doc, start in self.rest]  # taken from the end: the longest first
        self.rest = []
        size = self.window
        total = sum(n for _, _, n in left)
        while total:
            if size > total:
                size //= 2
                continue
            parts, need = [], size
            while need:
                doc, start, n = left.pop()
                take = min(n, need)
                parts.append((doc, start, take))
                if n > take:
                    left.append((doc, start + take, n - take))
                need -= take
            self._sequence(parts, size)
            total -= size


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 4096,
    shortest: int = 256,
    end_id: int = 2,
    block_tokens: int = 2_000_000,
    step_tokens: int = 1 << 20,
    cached_chunks: int = 400_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece. ``window`` and ``shortest`` are powers of two."""
    end = struct.pack("<I", end_id)

    def rows(packer: Packer, held: dict) -> Iterator[pa.RecordBatch]:
        packer.group()
        out = []
        for doc, start, length, seq, at, tier, group in packer.pieces:
            doc_id, ids = held[doc]
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
            out.append((doc_id, start, length, crc, len(ids) // 4, seq, at, tier, group))
        packer.pieces = []
        if out:
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, cached_chunks)
        packer = Packer(TaskContext.get().partitionId() << 40, window, shortest, step_tokens)
        held: dict[int, tuple] = {}
        tokens = count = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, encoded in zip(ids, encoder.encode([t or b"" for t in texts]), strict=True):
                held[count] = (doc_id, encoded + end)
                packer.add(count, len(encoded) // 4 + 1)
                tokens += len(encoded) // 4 + 1
                count += 1
                if tokens >= block_tokens:
                    packer.pack()
                    yield from rows(packer, held)
                    held = {doc: held[doc] for _, doc, _ in packer.rest}
                    tokens = sum(n for n, _, _ in packer.rest)
        packer.pack()
        packer.finish()
        yield from rows(packer, held)

    chosen = docs.select(F.col(id_col).cast("long"), F.encode(F.col(text_col), "UTF-8"))
    return chosen.mapInArrow(task, PIECES)
