"""The registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltbook.llm import bpe, collocations, licenses, linededup, lm, media, packing, pii, quality, simhash, toxicity, trie, urls
from haltbook.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    done = linededup.dedup_lines(docs.select("doc_id", "text", lines.alias("n_lines")), min_words=1, apart=True)
    return done.select(
        "doc_id",
        "n_lines",
        F.size("exact_lines").cast("long").alias("n_exact"),
        F.size("similar_lines").cast("long").alias("n_similar"),
        F.array_join("exact_lines", ",").alias("exact_lines"),
        F.array_join("similar_lines", ",").alias("similar_lines"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash, "op2_lm": op2_lm, "op3_lines": op3_lines, "op4_pii": op4_pii, "op5_quality": op5_quality, "op6_gif": op6_gif, "op7_bpe": op7_bpe, "op8_toxicity": op8_toxicity, "op9_urls": op9_urls, "op10_packing": op10_packing, "op11_trie": op11_trie, "op12_collocations": op12_collocations, "op13_licenses": op13_licenses}

ORACLES: dict[str, str] = {"op11_trie": trie.oracle_sql(), "op12_collocations": collocations.oracle_sql()}
