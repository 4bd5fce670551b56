import corpus_pipeline as cp
from haltbook.llm import simhash
from tests.llm.test_linededup import slow
from tests.llm.test_simhash import brute_components, brute_fingerprint, shingles, similar_pairs
from tests.llm.test_tokens import check_pieces

AT = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{AT}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = cp.stored(stage(spark, docs, AT), "stage")
        seen[name] = before, docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars == len(r.text) for r in seen[name][1])
    before, after = seen["toxicity"]
    assert 0.7 * len(before) < len(after) < len(before)
    before, after = seen["line dedup"]
    gone = slow([(r.doc_id, r.text) for r in before], least=1)
    want = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id][0] | gone[r.doc_id][1]) for r in before}
    assert {r.doc_id: r.text for r in after} == want
    before, after = seen["near duplicates"]
    fps = {r.doc_id: brute_fingerprint(r.text) for r in before}
    comp, least = brute_components(fps.values()), {}
    for d, f in fps.items():
        least[comp[f]] = min(d, least.get(comp[f], d))
    sets = {r.doc_id: shingles(r.text) for r in before if r.doc_id in set(least.values())}
    similar = similar_pairs(sets)
    kept = {r.doc_id for r in after}
    assert kept <= set(sets) and all(any((min(d, k), max(d, k)) in similar for k in sets) for d in set(sets) - kept)
    assert not any(a in kept and b in kept for a, b in similar)
    before, after = seen["personal data"]
    assert len(before) == len(after) and not any("@mail" in r.text for r in after)
    before, after = seen["packing"]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    check_pieces(after, {r.doc_id: [tok.encode(r.text, add_special_tokens=False).ids + [2]] for r in before})


def test_odd_rows(spark):
    rows = [(None, "same text of some length here", "l", "s", 1), (4, "same text of some length here", None, None, None), (4, "same text of some length here", None, None, None), (5, None, "l", None, 0), (6, "", "l", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.drop_near_copies(spark, docs, AT).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(4, "same text of some length here"), (5, "")]
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, AT).count() == 0
    assert cp.drop_lines(spark, docs, AT).count() == 5 and cp.mask_personal(spark, docs, AT).count() == 5
    assert simhash.near_duplicates(docs).count() == 5
