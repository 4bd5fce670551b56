import hashlib
import struct
import zlib
from collections import defaultdict

import pytest

from haltbook.llm import bpe, packing

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None,
    "",
    " ",
    "plain words, it's here and we'll go",
    "  two  spaces\n\n\tand tabs\r\n \x0b\x0c x\x1cy\x85z w v",
    "<|endoftext|>mid<|endoftext|> <|startoftext|>end",
    "déjà vu é ΟΔΟΣ ΣΣ. ñandú 日本語テキスト 🎉🎉 ٣٤ ½ a1b22",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40,
    "ababababab abab aab baa " * 30,
    "plain words, it's here and we'll go",
    "The end. " * 9000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "y", 2), (3, TEXTS[3], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").coalesce(1)


def test_bpe_equals_the_library(docs):
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.round_trip(docs, P.path("byte_bpe_50k.json")).collect()}
    assert bpe.round_trip(docs, P.path("byte_bpe_50k.json")).count() == len(TEXTS) + 2
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), repr(t)[:40]
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        text = tok.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_encode_then_decode(docs):
    back = bpe.decode_documents(bpe.encode_documents(docs, P.path("byte_bpe_50k.json")), P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.text for r in back.collect()}
    assert all(got[i] == (t or "") for i, t in enumerate(TEXTS))


def test_bpe_on_given_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(d, P.path("byte_bpe_50k.json")).collect()}
    for r in d.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def check_pieces(rows, wanted, window=4096):
    """wanted: ids of each document row, by id; rows of one id may be several."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, texts in wanted.items():
        assert sum(r.length for r in by_doc[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(by_doc[doc], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(texts[0])
                ids = texts[0][r.start : r.start + r.length]
                assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
                at += r.length
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and at & (at - 1) == 0
        assert {r.tier for r in seq} == {at} and len({r.step_group for r in seq}) == 1


def test_packing(docs, spark):
    path = P.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    wanted = defaultdict(list)
    for r in docs.collect():
        wanted[r.doc_id].append(tok.encode(r.text or "", add_special_tokens=False).ids + [2])
    check_pieces(packing.pack_documents(docs, path).collect(), wanted)
    check_pieces(packing.pack_documents(docs, path, block_tokens=64, window=64, shortest=8).collect(), wanted, 64)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_packing_given_documents(spark):
    path = P.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted = {r.doc_id: [tok.encode(r.text or "", add_special_tokens=False).ids + [2]] for r in d.collect()}
    rows = packing.pack_documents(d, path).collect()
    check_pieces(rows, wanted)
    groups = defaultdict(int)
    for r in rows:
        groups[r.step_group, r.tier] += r.length
    assert len(rows) < 2 * len(wanted)


def test_step_groups(spark):
    """Groups of one tier hold whole sequences; within a task and block they are equal to within one sequence
    and near each other in attention cost. Many small partitions give one short group a tier each."""
    path = P.path("word_bpe_49k.json")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def groups(parts, **sizes):
        rows = packing.pack_documents(d.repartition(parts), path, **sizes).collect()
        seq = defaultdict(list)
        for r in rows:
            seq[r.step_group, r.tier, r.sequence_id].append(r.length)
        out = defaultdict(list)
        for (g, tier, _), lengths in seq.items():
            out[g, tier].append(sum(n * n for n in lengths))
        assert len({g for g, _ in out}) == len(out)
        return out, sum(r.length for r in rows)

    whole, n = groups(1, window=512, step_tokens=16 * 512)
    full = [c for (_, tier), c in whole.items() if tier == 512]
    assert max(map(len, full)) - min(map(len, full)) <= 1 and max(map(len, full)) <= 18
    cost = [sum(c) / len(c) for c in full]
    assert max(cost) < 1.1 * min(cost)
    small, m = groups(40, window=512, step_tokens=16 * 512)
    assert m == n and max(len(c) * tier for (_, tier), c in small.items()) <= 1.6 * 16 * 512
