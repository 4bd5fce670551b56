import corpus_pipeline
from haltbook.llm import linededup, registry
from tests.llm.test_linededup import slow

AT = "/root/testdata/sf0.001"


def test_short_lines(spark):
    """The query and the pipeline remove repeats of lines of any number of words."""
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    wanted = slow([(r.doc_id, r.text) for r in docs.collect()], least=1)
    shown = {d: tuple(",".join(map(str, sorted(x))) for x in w) for d, w in wanted.items()}
    assert {r.doc_id: (r.exact_lines, r.similar_lines) for r in registry.op3_lines(spark, AT).collect()} == shown
    rows = [(1, "all rights reserved.\nspam\nspam spam\n\n \nof, edti"), (2, "spam\n\n \nedti of,\nall rights\nAll rights reserved.")]
    odd = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, odd, AT).collect()} == {1: "all rights reserved.\nspam\n\n \nof, edti", 2: "\n \nall rights"}


def test_rows_of_one_id(spark):
    """A row loses its own repeats only, and repeats among rows of one id go."""
    known, alone = "a known line of six words", "found nowhere else in this table"
    rows = [(1, known), (None, f"{known}\nx"), (None, f"{alone}\ny"), (7, f"{known}\nz"), (7, "one line of seven stands right here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for apart in (False, True):
        got = sorted((r.doc_id or 0, r.text) for r in linededup.dedup_lines(docs, apart=apart).collect())
        assert got == sorted([(0, "x"), (0, f"{alone}\ny"), (1, known), (7, "z"), (7, "one line of seven stands right here")])
    for i in (3, None, linededup.LAST_ID, -linededup.LAST_ID):
        same = spark.createDataFrame([(i, f"{known}\nx"), (i, f"{known}\nx"), (i, f"{known}\ny")], "doc_id long, text string")
        got = linededup.dedup_lines(same, min_words=1, apart=True).collect()
        lines = [x for r in got for x in r.text.split("\n") if x]
        assert len(got) == 3 and sorted(lines) == sorted([known, "x", "y"])
