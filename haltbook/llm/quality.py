"""Operator 5 [native]: quality rules by weak supervision.

Rules do not have to agree: each votes for quality (1), against it (-1) or abstains (0). A label
model estimates their accuracies by expectation-maximisation on the counted vote patterns, with bad rows
of several kinds, and the posterior probability of quality decides. Two base conditions (too few words, too many words in
repeated passages) reject whatever the rules say.

All counts are made in the row by SQL functions on the whole text; nothing is shuffled but the
pattern counts. The counts are written once to the shared folder and read for both the patterns and
the verdict.

Null texts count as texts without words, which fail the base. Repeated rows and null ids keep their
rows. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltbook.llm import label_model
from haltbook.llm.common import WORD, stored

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spaced(text: Column) -> Column:
    """All ASCII white space as blanks. One ``replace`` a character is many times as fast as ``translate``."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(spaced(text), " "), "")


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def runs_of_three(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(without_runs(text, chars))


def without_runs(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c * 3), F.lit(""))
    return text


def _repeated(words: Column) -> Column:
    """Words in windows that occur at least twice in the text."""

    def cover(windows: Column) -> Column:
        marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(m: Column) -> Column:
            def twice(x, k):
                return F.coalesce(x["h"] == F.get(m, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(m, k + 1)["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(m, twice), lambda x: x["i"]))

        first = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        total = F.aggregate(
            let(marked, starts),
            first,
            lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + (i + WINDOW - F.greatest(i, a["end"]))).cast("long").alias("n")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), total).otherwise(F.lit(0).cast("long"))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(WINDOW))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    found = let(hashed, lambda h: F.when(F.size(h) > WINDOW, let(windows(h), cover)).otherwise(F.lit(0).cast("long")))
    return found


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    n = F.length("t")
    counted = base.select(
        "doc_id",
        let(words_of(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"))).alias("w"),
        F.length(without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (n - F.length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
        (n - F.length(without(F.col("t"), "!?"))).cast("long").alias("n_shouts"),
        (n - F.length(without(F.col("t"), ".,;:"))).cast("long").alias("n_stops"),
        (n - F.length(without(F.col("t"), "|"))).cast("long").alias("n_bars"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        runs_of_three(F.col("t"), SYMBOLS).cast("long").alias("n_in_runs"),
    )
    return counted.select(
        "doc_id", "w.n_words", "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"), "w.n_repeat_words",
        F.col("l.n").cast("long").alias("n_lines"), "n_shouts", "n_stops", "n_bars", "n_capitals", "n_digits", "n_in_runs",
    )


def share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def votes() -> dict[str, Column]:
    """The rules: 1 for quality, -1 against it, 0 abstains."""

    def vote(good: Column | None, bad: Column) -> Column:
        out = F.when(bad, -1)
        return (out.when(good, 1) if good is not None else out).otherwise(0).cast("int")

    mean = share("word_chars", "n_words")
    return {
        "v_length": vote(F.col("n_words") >= 30, F.col("n_words") < 10),
        "v_word": vote(mean.between(3, 9), (mean < 2.2) | (mean > 14)),
        "v_symbols": vote(share("n_symbols", "n_words") < 0.02, share("n_symbols", "n_words") > 0.2),
        "v_lines": vote(None, share("n_dup_lines", "n_lines") > 0.5),
        "v_repeats": vote(share("n_repeat_words", "n_words") < 0.05, share("n_repeat_words", "n_words") > 0.2),
        "v_shouts": vote(share("n_shouts", "n_words") < 0.05, share("n_shouts", "n_words") > 0.3),
        "v_stops": vote(share("n_stops", "n_words").between(0.04, 0.4), share("n_stops", "n_words") > 0.8),
        "v_bars": vote(None, share("n_bars", "n_words") > 0.15),
        "v_runs": vote(None, share("n_in_runs", "n_words") > 0.1),
        "v_capitals": vote(share("n_capitals", "word_chars") < 0.1, share("n_capitals", "word_chars") > 0.3),
        "v_digits": vote(None, share("n_digits", "word_chars") > 0.6),
    }


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    quality): quality is the posterior probability."""
    rules = votes()
    names = list(rules)
    voted = stored(measure(docs), "quality").withColumns(rules)
    model = label_model.fit_kinds(label_model.count_patterns(voted, names))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = voted.select(*counts, failed.alias("base_failed"), label_model.posterior(model, names).alias("quality"))
    return judged.select(*counts, "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality")
