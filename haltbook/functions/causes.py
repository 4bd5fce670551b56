"""Cause rules of a stop as one expression ladder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from haltbook import defaults as D
from haltbook.functions.timecols import WHITE, contains_any, let


@dataclass
class Rules:
    weather: list = field(default_factory=lambda: D.WEATHER_MARKERS)
    technical: list = field(default_factory=lambda: D.TECHNICAL_MARKERS)
    generic: list = field(default_factory=lambda: D.GENERIC_REASONS)
    patterns: list = field(default_factory=lambda: D.REASON_PATTERNS)
    visitors: list = field(default_factory=lambda: D.VISITOR_PATTERNS)
    phrases: list = field(default_factory=lambda: D.MECHANIC_PHRASES)
    prefix: str = D.REASON_PREFIX
    tail: str = D.REASON_TAIL
    outer: str = D.REASON_OUTER
    white: str = WHITE  # runs of it become one space
    ends: str = r"(?U)[\s\x{FEFF}]"  # goes at both ends
    flags: str = "iuU"
    default: str = D.DEFAULT_CAUSE


def visitor_incident(c, rules: Rules | None = None) -> Column:
    """A person word near a fall, injury or loss word, in either order."""
    out, r = F.lit(False), rules or Rules()
    for p in r.visitors:
        out = out | c.rlike(f"(?{r.flags})" + p)
    return out


def trimmed(c, rules: Rules) -> Column:
    return F.regexp_replace(c, f"^{rules.ends}+|{rules.ends}+\\z", "")


def capital(letter) -> Column:
    """The letter's capital of one character, as SQL has it; itself if it has none."""
    full, title = F.upper(letter), F.initcap(letter)
    return F.when(F.length(full) <= 1, full).when(letter == "ß", "ẞ").when(F.length(title) == 1, title).otherwise(letter)


def clean_reason(c, rules: Rules | None = None) -> Column:
    """Squashed, without outer punctuation and lead-in, first letter capital."""
    r = rules or Rules()
    squashed = trimmed(F.regexp_replace(c, r.white, " "), r)
    t = F.regexp_replace(F.btrim(squashed, F.lit(r.outer)), f"(?{r.flags})" + r.prefix, "")
    return let(t, lambda x: F.concat(capital(F.left(x, F.lit(1))), F.substr(x, F.lit(2))))


def trim_tail(c, rules: Rules | None = None) -> Column:
    r = rules or Rules()
    return F.regexp_replace(c, f"(?{r.flags}s)" + r.tail, "")


def stop_cause(quote, reason, rationale, rules: Rules | None = None) -> Column:
    """Technical cause of a stop; NULL if weather, visitors or nothing technical explains it."""
    r = rules or Rules()
    quote, reason = trimmed(F.coalesce(quote, F.lit("")), r), trimmed(F.coalesce(reason, F.lit("")), r)
    joined = F.lower(F.concat_ws(" ", quote, reason, F.coalesce(rationale, F.lit(""))))
    first = F.lit("")
    for p in reversed(r.patterns):
        first = let(F.regexp_extract(quote, f"(?{r.flags})" + p, 1), _unless_blank(first))
    specific = clean_reason(trim_tail(first, r), r)

    def said(x: Column) -> Column:
        own = (x != "") & (contains_any(F.lower(x), r.technical) | ~contains_any(F.lower(x), r.generic))
        return F.when(own, clean_reason(x, r))  # may be blank, which E11 rejects

    def ladder(j: Column) -> Column:
        phrase = F.lit(r.default)
        for marker, text in reversed(r.phrases):
            phrase = F.when(F.contains(j, F.lit(marker)), text).otherwise(phrase)
        excluded = contains_any(j, r.weather) | visitor_incident(j, r) | ~contains_any(j, r.technical)
        return F.when(~excluded, let(specific, _unless_blank(let(reason, lambda x: F.coalesce(said(x), phrase)))))

    return let(joined, ladder)


def _unless_blank(other: Column):
    return lambda x: F.when(x == "", other).otherwise(x)
