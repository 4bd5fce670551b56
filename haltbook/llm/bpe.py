"""Operator 7: byte-level BPE encoding and decoding with a pair occurrence index.

The pieces of a partition's texts that are not yet known are laid out in one symbol list. An index
maps the rank of each mergeable pair to all its positions in that list; ranks are taken from a heap
in ascending order, all their positions are merged from left to right, and the lists of the pairs
that touch a merge are extended. Positions that a merge has made stale are recognised when read.

Null texts count as empty. Texts are processed whole; a piece of any length is merged in the same
way, only not kept in the bounded map of known pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltbook.llm.common import Generations

#: Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_loaded: dict = {}


def byte_names() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: bytes that print stand
    for themselves, the others take the code points from 256 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    def __init__(self, path: str, size: int, longest: int = 64):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        names = byte_names()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(map(names.__getitem__, s)) for s, i in vocab.items()}
        self.first = [vocab[c] for c, _ in sorted(names.items(), key=lambda x: x[1])]
        self.span = 1 << 17
        self.ranks, self.made = {}, []
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] * self.span + vocab[b]] = k
            self.made.append(vocab[a + b])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {s: struct.pack("<I", i) for s, i in special.items()}
        self.bytes_of |= {i: s.encode() for s, i in special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.known, self.longest = Generations(size), longest

    def merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, little-endian unsigned 32-bit."""
        symbols, starts = [], []
        first, ranks, made, span = self.first, self.ranks, self.made, self.span
        for p in pieces:
            starts.append(len(symbols))
            symbols.extend(map(first.__getitem__, p.encode()))
            symbols.append(-1)  # no pair reaches over it
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            if (r := ranks.get(symbols[i] * span + symbols[i + 1])) is not None:
                index.setdefault(r, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        get = ranks.get
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at.sort()
            new = made[r]
            for i in at:
                j = after[i]
                if symbols[i] < 0 or j >= n or get(symbols[i] * span + symbols[j]) != r:
                    continue  # changed since it was listed
                symbols[i], symbols[j] = new, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (s := get(new * span + symbols[k])) is not None:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heapq.heappush(heap, s)
                h = before[i]
                if h >= 0 and (s := get(symbols[h] * span + new)) is not None:
                    if s in index:
                        index[s].append(h)
                    else:
                        index[s] = [h]
                        heapq.heappush(heap, s)
        starts.append(n)
        return [
            struct.pack(f"<{len(own)}I", *own)
            for own in ([x for x in symbols[a : b - 1] if x >= 0] for a, b in zip(starts, starts[1:], strict=False))
        ]

    def split(self, text: str) -> list[str]:
        if self.at_special is None or not any(s in text for s in self.special):
            return self.pieces(text)
        out: list[str] = []
        for part in self.at_special.split(text):
            out += [part] if part in self.special else self.pieces(part)
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        known = self.known
        for first in range(0, len(texts), 2048):
            split = [self.split(t) for t in texts[first : first + 2048]]
            known.turn()
            young = known.young
            young.update(self.special)
            new = known.missing(p for pieces in split for p in pieces)
            young.update(zip(new, self.merge(new), strict=True))
            for pieces in split:
                yield b"".join(map(young.__getitem__, pieces))
            for p in new:
                if len(p) > self.longest:
                    del young[p]

    def decode(self, ids: bytes) -> str:
        codes = array("I")
        codes.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, codes)).decode("utf-8", "replace")


def _model(path: str, size: int) -> ByteBpe:
    if (path, size) not in _loaded:
        _loaded[path, size] = ByteBpe(path, size)
    return _loaded[path, size]


def encode_documents(
    docs: DataFrame, tokenizer_path: str, cached_pieces: int = 200_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids binary): the token ids of every text, little-endian unsigned 32-bit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer_path, cached_pieces)
        for batch in batches:
            ids = list(model.encode([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(task, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer_path, 200_000)
        for batch in batches:
            texts = [model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, cached_pieces: int = 200_000) -> DataFrame:
    """Digests of the ids and of the text decoded from them, in one pass over the documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer_path, cached_pieces)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for ids in model.encode([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(task, DIGEST)
