"""Repair of text that was decoded with the wrong single-byte codepage.

A codepage's table comes from Python's codec once; the work itself is built-in functions: the text's
characters are mapped back to the codepage's bytes, those are read as UTF-8, and the result counts
only if it is valid and every character belonged to the codepage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from haltbook import defaults as D
from haltbook.functions.timecols import let


def occurrences(c, marker: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def damage(c, markers=None, weight: int = 1, box: int = 0) -> Column:
    """Weighted count of marker sequences, and of box-drawing characters."""
    markers = D.DAMAGE_SCORES["single"][0] if markers is None else markers
    total = reduce(lambda a, b: a + b, (occurrences(c, m) * weight for m in markers), F.lit(0))
    return total + F.regexp_count(c, F.lit("[─-╿]")) * box if box else total


def recode(c, codepage: str) -> Column:
    """The text's bytes in the codepage read as UTF-8; NULL where that cannot be."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(codepage)] = chr(b)
        except UnicodeDecodeError:
            pass
    moved = {k: v for k, v in table.items() if k != v}
    outside = "[^" + "".join(rf"\x{{{ord(k):x}}}" for k in table) + "]"
    raw = F.translate(c, "".join(moved), "".join(moved.values()))
    raw = F.when(~c.rlike(outside), raw)
    return F.try_validate_utf8(F.encode(raw, "ISO-8859-1").cast("string"))


def repair(c, codepage: str = "cp1251", markers=None) -> Column:
    """The recoded text if its damage score is lower."""
    new = recode(c, codepage)
    return F.when(damage(new, markers) < damage(c, markers), new).otherwise(c)


def repair_best(c, codepages=None, markers=None, weight: int = D.DAMAGE_SCORES["best"][1], box: int = D.BOX_SCORE) -> Column:
    """Lowest damage, then most Cyrillic, then the first codepage; untouched without damage."""
    codepages = D.CODEPAGES if codepages is None else codepages
    markers = D.DAMAGE_SCORES["best"][0] if markers is None else markers

    def ranked(text, at):
        score = F.struct(
            damage(text, markers, weight, box).alias("bad"), (-F.regexp_count(text, F.lit("[Ѐ-ӿ]"))).alias("less"), F.lit(at).alias("at"), text.alias("text")
        )
        return F.when(text.isNotNull(), score)

    options = F.array(ranked(c, 0), *(let(recode(c, p), lambda text, k=k: ranked(text, k + 1)) for k, p in enumerate(codepages)))
    best = F.array_min(F.filter(options, lambda x: x.isNotNull()))["text"]
    return F.when(damage(c, markers, weight, box) > 0, best).otherwise(c)


def repair_nested(df: DataFrame, columns: list[str], fix=repair_best) -> DataFrame:
    """Repair strings in string, struct and array columns at any depth (T4)."""

    def walk(c: Column, kind) -> Column:
        if isinstance(kind, StringType):
            return fix(c)
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*(walk(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return c

    return df.withColumns({n: walk(F.col(n), df.schema[n].dataType) for n in columns})
