"""Asset names and aliases in texts (S5, A1-A9, C4). The dimension (ord, name, full_name, aliases) may be
of any size: texts meet names through ``alias_index``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltbook import defaults as D
from haltbook.functions.timecols import WHITE, blank_to_null, contains_any, strip
from haltbook.operators.alias_index import containing, same

#: What names a notice.
NOTICE = ("chat_key", "pos")


def load_assets(df: DataFrame, flags=None) -> DataFrame:
    """Named rows whose include flag is blank or positive; the display name falls back to the
    name (S5). Takes ord, name, display, include."""
    flag = F.lower(strip(F.coalesce("include", F.lit(""))))
    named = df.where(strip(F.coalesce("name", F.lit(""))) != "").where(flag.isin(*(D.INCLUDE_FLAGS if flags is None else flags)))
    return named.select("ord", strip(F.col("name")).alias("name"), F.coalesce(blank_to_null(F.col("display")), strip(F.col("name"))).alias("full_name"))


def names_of() -> Column:
    """Name, full name and aliases in order."""
    return F.filter(F.transform(F.concat(F.array("name", "full_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: strip(x)), lambda x: F.coalesce(x != "", F.lit(False)))


def alias_table(assets: DataFrame) -> DataFrame:
    """(alias, ord, name): names, full names and aliases, whole and by their parts at a slash; a
    repeated alias belongs to the last asset (A1)."""
    parts = F.filter(F.flatten(F.transform(names_of(), lambda n: F.concat(F.array(n), F.transform(F.split(n, "/"), lambda x: strip(x))))), lambda x: x != "")
    each = assets.select("ord", "name", F.explode(F.array_distinct(parts)).alias("alias"))
    return each.groupBy("alias").agg(F.max(F.struct("ord", "name")).alias("a")).select("alias", "a.ord", "a.name")


def start_aliases(assets: DataFrame) -> DataFrame:
    """(ord, name, place, alias): name, full name before its slash, aliases (A2)."""
    front = strip(F.substring_index("full_name", "/", 1))
    listed = F.concat(F.array(strip(F.col("name")), front), F.coalesce(F.transform("aliases", lambda x: strip(x)), F.array().cast("array<string>")))
    kept = F.array_distinct(F.filter(listed, lambda x: F.coalesce(x != "", F.lit(False))))
    return assets.select("ord", "name", F.posexplode(kept).alias("place", "alias"))


def normalize_asset(df: DataFrame, column: str, assets: DataFrame, guard_blank: bool = True) -> DataFrame:
    """``attraction``: the first asset, in configured order, one of whose names equals, lies in, or
    contains the text; else the text (A3). Only distinct texts meet the dimension."""
    text = strip(F.coalesce(F.col(column), F.lit("")))
    texts = df.select(text.alias("__t")).distinct().withColumn("__low", F.lower("__t"))
    names = assets.select("ord", "name", F.explode(names_of()).alias("alias")).select("ord", "name", F.lower("alias").alias("__a"))
    own = names.groupBy("__a").agg(F.min(F.struct("ord", "name")).alias("__n"))
    low = texts.where("__low <> ''").select("__low").distinct()
    inside = containing(low, own, ["__low"], text="__low")
    around = containing(own.select("__a"), low, ["__a"], text="__a", name="__low")
    found = inside.unionByName(around).distinct().join(own, "__a").groupBy("__low").agg(F.min("__n").alias("__n"))
    if not guard_blank:  # a blank text lies in every name
        found = found.union(own.agg(F.min("__n").alias("__n")).select(F.lit("").alias("__low"), "__n"))
    named = texts.join(found, "__low").select("__t", F.col("__n")["name"].alias("__n"))
    return df.join(named, text == F.col("__t"), "left").withColumn("attraction", F.coalesce("__n", text)).drop("__t", "__n")


def match_asset(df: DataFrame, column: str, assets: DataFrame, exact: bool = False) -> DataFrame:
    """ord of the first asset of that name, exact or without case and outer spaces (A4)."""
    def key(c: Column) -> Column:
        return c if exact else F.lower(strip(c))

    first = assets.groupBy(key(F.col("name")).alias("__k")).agg(F.min("ord").alias("ord"))
    return df.join(first, key(F.col(column)) == F.col("__k"), "left").drop("__k")


def is_global(c: Column, markers=None, foreign=None) -> Column:
    """A park-wide notice: a general marker and no foreign venue."""
    low = F.lower(c)
    return contains_any(low, D.GLOBAL_MARKERS if markers is None else markers) & ~contains_any(low, D.FOREIGN_MARKERS if foreign is None else foreign)


def mentions(notices: DataFrame, assets: DataFrame, key: Sequence[str] = NOTICE, text: str = "text") -> DataFrame:
    """(key, alias): the aliases of the dimension in each notice, without regard to case."""
    aliases = alias_table(assets).select("alias", F.lower("alias").alias("__a"))
    low = notices.select(*key, F.lower(text).alias("__t"))
    return containing(low, aliases, key).join(aliases, "__a").select(*key, "alias")


def relevant(notices: DataFrame, assets: DataFrame, markers=None, foreign=None, key: Sequence[str] = NOTICE) -> DataFrame:
    """Notices that name an asset or concern the whole park; message_index is kept."""
    everywhere = is_global(F.col("text"), markers, foreign)
    named = mentions(notices, assets, key).select(*key).distinct().withColumn("__named", F.lit(True))
    joined = notices.alias("n").join(named.alias("m"), same("n", "m", key), "left")
    return joined.where(F.col("m.__named") | everywhere).select("n.*")


def fragments(notices: DataFrame, assets: DataFrame, tail: str = D.ROSTER_TAIL, longest: int = 180, key: Sequence[str] = NOTICE) -> DataFrame:
    """(notice columns, place, attraction, fragment): from each alias's first place to the next
    alias, begun with the asset's name, squashed, cut at a word (A8)."""
    body = notices.withColumn("__b", F.regexp_replace(F.col("text"), "(?iuUs)" + tail, ""))
    met = mentions(body, assets, key, "__b").join(alias_table(assets).select("alias", "name"), "alias")
    found = body.alias("n").join(met.alias("m"), same("n", "m", key)).select("n.*", "m.alias", "m.name")
    placed = found.withColumn("__at", F.position(F.lower("alias"), F.lower("__b")))
    w = Window.partitionBy(*key).orderBy("__at", "name", "alias")
    end = F.coalesce(F.lead("__at").over(w), F.length("__b") + 1)
    cut = placed.withColumns({"place": F.row_number().over(w), "__end": end})
    start = F.col("__at") + F.length("alias")
    raw = F.concat("name", F.substr("__b", start, F.greatest(F.col("__end") - start, F.lit(0))))
    whole = F.regexp_replace(F.btrim(raw, F.lit(" .;")), WHITE, " ")
    short = F.left(whole, F.lit(longest))
    kept = F.when(F.length(whole) <= longest, whole).otherwise(F.when(F.contains(short, F.lit(" ")), F.regexp_replace(short, " [^ ]*$", "")).otherwise(short))
    return cut.withColumn("fragment", kept).withColumnRenamed("name", "attraction").drop("__b", "__at", "__end", "alias")


def facts(notices: DataFrame, assets: DataFrame, hint: str = D.GENERAL_HINT, markers=None, foreign=None, key: Sequence[str] = NOTICE) -> DataFrame:
    """(key, target_hint, fragment): a row per fragment, and per park-wide notice that
    names no asset (A9)."""
    own = fragments(notices, assets, key=key).select(*key, F.col("attraction").alias("target_hint"), "fragment")
    everywhere = notices.where(is_global(F.col("text"), markers, foreign))
    named = mentions(everywhere, assets, key).select(*key).distinct()
    wide = everywhere.alias("n").join(named.alias("m"), same("n", "m", key), "left_anti")
    return own.unionByName(wide.select(*key, F.lit(hint).alias("target_hint"), F.col("text").alias("fragment")))


def asset_lines(assets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One text: full names, else names, in order; with ``by`` one for each of its values (C4)."""
    shown = F.coalesce(blank_to_null(F.col("full_name")), F.col("name"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", shown.alias("n")))), lambda x: x["n"]), "\n")
    return assets.groupBy(*by).agg(lines.alias("lines"))
