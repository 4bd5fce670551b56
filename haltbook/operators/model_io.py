"""What goes to an event extractor and what comes back."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haltbook.functions.timecols import strip
from haltbook.operators.alias_index import same
from haltbook.operators.scans import number_rows
from haltbook.sources.scratch import scratch

EVENT = "chain_of_thought string, message_index int, time string, attraction_name string, event_type string, reason string, quote string"
EVENT_TYPE = f"struct<{EVENT.replace(' string', ':string').replace(' int', ':int')}>"


def render(df: DataFrame, template: str, columns: list[str], into: str = "prompt") -> DataFrame:
    """Literal {column} replacement."""
    out = F.lit(template)
    for c in columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return df.withColumn(into, out)


def unwrapped(raw: Column) -> Column:
    """Model text without thinking spans and code fences."""
    t = strip(F.regexp_replace(raw, "(?is)<think>.*?</think>", ""))
    return F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def widest(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))


def parse_rows(df: DataFrame, column: str, row: str, field: str = "rows") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of texts that hold {"rows": [...]} (C5). ``row`` is the row's struct type. A
    row without date takes the day's; texts that no reading parses are rejects."""
    kind = f"struct<{field}:array<{row}>>"
    t = unwrapped(F.col(column))
    found = F.coalesce(F.from_json(t, kind)[field], F.from_json(widest(t), kind)[field])
    parsed = df.withColumn("__r", found)
    rows = parsed.where("__r is not null").select(*(c for c in df.columns if c != column), F.explode("__r").alias("__r"))
    day = [F.coalesce(F.nullif(F.col("__r.date"), F.lit("")), F.col("date").cast("string")).alias("row_date")] if "date" in df.columns and "date:" in row else []
    fields = [f.split(":")[0].strip() for f in row.removeprefix("struct<").removesuffix(">").split(",")]
    flat = rows.select(*(c for c in df.columns if c != column), *day, *(F.col(f"__r.{f}").alias(f"row_{f}") for f in fields if not (day and f == "date")))
    return flat, parsed.where("__r is null").drop("__r")


def parse_events(df: DataFrame, column: str) -> DataFrame:
    """Events of a model result: an object with events, a bare list, or either as a JSON string;
    nothing on failure (C6). The object form is tried first, since a list schema would take a bare
    object for a list of one."""
    t = strip(F.col(column))
    text = F.coalesce(F.when(F.startswith(t, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v")), t)
    boxed = F.from_json(F.when(F.startswith(text, F.lit("{")), text), f"struct<events:array<{EVENT_TYPE}>>")["events"]
    inner = F.get_json_object(text, "$.events")
    quoted = F.from_json(F.when(F.startswith(inner, F.lit("[")), inner), f"array<{EVENT_TYPE}>")
    bare = F.from_json(F.when(F.startswith(text, F.lit("[")), text), f"array<{EVENT_TYPE}>")
    found = F.filter(F.coalesce(boxed, quoted, bare), lambda x: x.isNotNull())
    return df.select(*(c for c in df.columns if c != column), F.posexplode(found).alias("event_pos", "__e")).select("*", "__e.*").drop("__e")


def merge_chunks(df: DataFrame, day: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events with event_seq in chunk order, counts by chunk) of (day, chunk, event_pos, ...)."""
    return number_rows(df, day, "chunk", "event_seq", ["event_pos"], size=64), df.groupBy(*day, "chunk").agg(F.count("*").alias("events"))


def extract_events(
    chunks: DataFrame, fn: Callable[[dict], list[dict]], keys: list[str], retries: int = 3, path: str | None = None, again: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of each chunk by a user function, called again up to ``retries`` times when it raises (U1). A chunk
    whose last call raises is a reject with its error; the job goes on. The only step that needs Python workers; a chunk's bound is
    its number of notices. With ``path`` results are kept there by chunk key: another run calls only chunks
    without a result, and with ``again`` those that were rejected too."""
    spark = chunks.sparkSession
    kept = chunks.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", found string, error string"

    def call(row: dict) -> tuple[str | None, str | None]:
        error = None
        for _ in range(max(1, retries)):
            try:
                return json.dumps(fn(row), ensure_ascii=False), None
            except Exception as e:  # what a user's function raises is the chunk's result
                error = f"{type(e).__name__}: {e}"
        return None, error

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [[row[k] for k in keys] + list(call(row)) for row in frame.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*keys, "found", "error"])

    at = path or scratch(spark, "extracted")
    todo = chunks
    if path is not None:
        done = _kept(spark, path, schema)
        if done is not None:
            had = done if not again else done.where("error is null")
            todo = chunks.alias("c").join(had.select(*keys).distinct().alias("d"), same("c", "d", keys), "left_anti")
    todo.mapInPandas(task, schema).write.mode("append").parquet(at)
    every = _kept(spark, at, schema)
    events = every.where("error is null").select(*keys, F.posexplode(F.from_json("found", f"array<{EVENT_TYPE}>")).alias("event_pos", "__e"))
    rejected = every.where("error is not null").groupBy(*keys).agg(F.max("error").alias("error"))
    good = every.where("error is null").select(*keys).distinct()
    return events.select(*keys, "event_pos", "__e.*"), rejected.alias("r").join(good.alias("g"), same("r", "g", keys), "left_anti")


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
