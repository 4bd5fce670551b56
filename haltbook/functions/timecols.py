"""Time expressions. Clocks are kept as text next to integers: minutes or seconds of the day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from haltbook import defaults as D

DAY = 86400


#: White space in the wide sense: tabs, line ends, no-break spaces and byte-order marks too.
WHITE = r"(?U)[\s\x{FEFF}]+"


def squash(c) -> Column:
    """Runs of white space become one space; none at the ends (M1)."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def strip(c) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+\z", "")


def let(value, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def chat_key(url) -> Column:
    """Key of a chat from its address (M2)."""
    u = squash(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#\s]", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    path = F.regexp_extract(u, r"^[^:]+://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(u, r"(#.*)$", 1)
    origin = F.concat(scheme, F.lit("://"), host)
    tail = F.coalesce(
        F.when(~path.isin("", "/"), path), F.when(F.length(fragment) > 1, fragment), F.when(F.length(query) > 1, query), F.lit("/")
    )
    return F.when(u == "", "__global__").when(scheme == "", u).otherwise(F.concat(origin, tail))


def clock(c) -> Column:
    """First H:MM as HH:MM, else the text itself (M3)."""
    text = squash(c)
    found = r"\b(?:[01]?\d|2[0-3]):[0-5]\d\b"
    hit = F.regexp_extract(text, f"({found})", 1)
    return F.when(hit != "", F.lpad(hit, 5, "0")).otherwise(text)


def parse_clock(c) -> Column:
    """Minutes of the first H:MM or H.MM, NULL out of range."""
    h = F.nullif(F.regexp_extract(c, r"(\d{1,2})[:.](\d{2})", 1), F.lit("")).cast("int")
    m = F.nullif(F.regexp_extract(c, r"(\d{1,2})[:.](\d{2})", 2), F.lit("")).cast("int")
    return F.when((h <= 23) & (m <= 59), h * 60 + m)


def strict_clock(c) -> Column:
    """Minutes of a text that is H:MM as a whole."""
    t = strip(c)
    h = F.nullif(F.regexp_extract(t, r"^(\d{1,2}):(\d{1,2})$", 1), F.lit("")).cast("int")
    m = F.nullif(F.regexp_extract(t, r"^(\d{1,2}):(\d{1,2})$", 2), F.lit("")).cast("int")
    return F.when((h <= 23) & (m <= 59), h * 60 + m)


def as_date(c) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")


def date_key(c) -> Column:
    """ISO date of a date, timestamp or text; the first ten characters if it is none."""
    t = F.left(strip(c.cast("string")), F.lit(10))
    return F.coalesce(F.date_format(as_date(t), "yyyy-MM-dd"), t)


def can_date(c) -> Column:
    return as_date(F.left(strip(c.cast("string")), F.lit(10))).isNotNull()


def can_time(c) -> Column:
    return strict_clock(c).isNotNull()


def time_of_day(ts) -> Column:
    """Seconds of the day of a timestamp."""
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def label_date(label, as_of, months=D.MONTHS_OF, today=D.TODAY_LABEL, yesterday=D.YESTERDAY_LABEL) -> Column:
    """Date of a day header: words, day and month name, or day.month[.year] (M4)."""
    t = F.lower(squash(label))
    words, digits = r"^(\d{1,2})\s+(\p{L}+)(?:\s+(\d{4}))?$", r"^(\d{1,2})[./](\d{1,2})(?:[./](\d{2,4}))?$"
    month = F.array_position(F.array(*map(F.lit, months)), F.regexp_extract(t, words, 2)).cast("string")

    def build(pattern, m):
        year = F.regexp_extract(t, pattern, 3)
        full = F.when(year == "", F.year(as_of).cast("string")).when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
        text = F.concat_ws("-", F.lpad(full, 4, "0"), F.lpad(m, 2, "0"), F.lpad(F.regexp_extract(t, pattern, 1), 2, "0"))
        return F.when(t.rlike(pattern), as_date(text))

    return F.when(t == today, as_of).when(t == yesterday, F.date_sub(as_of, 1)).otherwise(
        F.coalesce(build(words, month), build(digits, F.regexp_extract(t, digits, 2)))
    )


def instant(date, time) -> Column:
    """Timestamp of a date text and a clock text, NULL if invalid."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy-MM-dd HH:mm"))


def downtime_s(stop, start) -> Column:
    """Seconds from stop to start; a start before the stop is on the next day."""
    return F.pmod(start - stop, F.lit(DAY)).cast("long")


def downtime_cell(stop, start, text) -> tuple[Column, Column]:
    """(downtime_s, downtime_text): the difference if both times are there, else the text."""
    both = stop.isNotNull() & start.isNotNull()
    return F.when(both, downtime_s(stop, start)), F.when(~both, blank_to_null(text))


def opening(date, rule=None) -> tuple[Column, Column]:
    """(open, close) by weekday: Monday to Thursday, Friday to Sunday."""
    rule = rule or D.OPEN_CLOSE
    early = F.weekday(date) < 4
    return tuple(F.when(early, rule["weekday"][k]).otherwise(rule["weekend"][k]) for k in (0, 1))


def hours_of(seconds: Column, digits: int = 2) -> Column:
    """Hours rounded half up; the rounding is of integers, so 522 s are 0.15 h."""
    scale = 10**digits
    return F.floor((seconds * scale + 1800) / 3600) / scale


def duration_label(seconds, hour=D.HOUR_LABEL, minute=D.MINUTE_LABEL) -> Column:
    """Hours and whole minutes."""
    m = F.floor(seconds / 60).cast("long")
    return F.concat(F.floor(m / 60).cast("string"), F.lit(hour), (m % 60).cast("string"), F.lit(minute))


def short_label(seconds, hour=D.SHORT_HOUR, minute=D.SHORT_MINUTE) -> Column:
    """Short form with rounded minutes, blank for zero."""
    m = F.floor(seconds / 60.0 + 0.5).cast("long")
    h = F.floor(m / 60).cast("long")
    long = F.concat(h.cast("string"), F.lit(hour + " "), (m % 60).cast("string"), F.lit(minute))
    return F.when(m == 0, "").when(h == 0, F.concat(m.cast("string"), F.lit(minute))).otherwise(long)


def month_name(month, names=D.MONTHS) -> Column:
    return F.try_element_at(F.array(*map(F.lit, names)), month.cast("int"))


def month_from_path(path) -> Column:
    """YYYY-MM from a file name that has MM.YYYY or YYYY-MM."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    first = F.nullif(F.concat_ws("-", F.nullif(F.regexp_extract(name, r"(?<!\d)(0[1-9]|1[0-2])\.(\d{4})(?!\d)", 2), F.lit("")), F.nullif(F.regexp_extract(name, r"(?<!\d)(0[1-9]|1[0-2])\.(\d{4})(?!\d)", 1), F.lit(""))), F.lit(""))
    second = F.nullif(F.regexp_extract(name, r"(?<!\d)(\d{4}-(?:0[1-9]|1[0-2]))(?!\d)", 1), F.lit(""))
    return F.coalesce(first, second)


def contains_any(c, markers) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(m)) for m in markers), F.lit(False))
