"""Queries of cause rules on texts with characters at their ends that the given small tables do not show."""

import duckdb
import pytest
from pyspark.sql import functions as F

from haltbook.functions import causes
from haltbook.plans import registry

TEXTS = ['an error said "ab"', '"who went there"', "'quoted'", "«er» ", ' . token = "4c5b"', 'x token = "4c5b" the rest', '""', "ßheit er", "ŉo er", "élan er", "ǆ er", "ᾀ er", " \t\n", "", None,
         "er idiot \n", "er idiot \u2028", "er idiot \x0bof x", "er idiot \u3000x ofé", "er token = \r", "er ıdiot x", "er éthe\rmoron", "er to\u212aen = a"]


@pytest.mark.parametrize("name", ["e10_clean", "e9_cause"])
def test_outer_characters(spark, tmp_path, name):
    rows = [(i, t, s) for i, t in enumerate(TEXTS) for s in ("src1", 'the "er"', None)]
    docs = [(3 * i + k, t, s) for k in range(3) for i, t, s in rows[k::3]]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = dict(db.execute(registry.ORACLES[name]).fetchall())
    # A null is nothing to the SQL's joined text, and blank to the operator.
    known = {d for d, t, s in docs if name == "e10_clean" or (t is not None and s is not None)}
    got = {r[0]: r[1] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {d: got[d] for d in known} == {d: want[d] for d in known}


def test_outer_characters_of_the_rules(spark):
    """Double quotes go by default."""
    df = spark.createDataFrame([('"torn belt".',)], "v string")
    both = df.select(causes.clean_reason(F.col("v")), causes.clean_reason(F.col("v"), causes.Rules(outer=" .'"))).first()
    assert tuple(both) == ("Torn belt", '"torn belt"')
