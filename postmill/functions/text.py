"""Text expressions: cleaning, tokens, keys. All are Catalyst expressions but ``unescape``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://\S+|www\.\S+"
DASHES = r"[\-\x{2013}\x{2014}]{2,}"
EMPTY_CHUNK = r"^[\-\x{2013}\x{2014}\.\*\x{2022}\s]*$"


def squeeze(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm(c: Column) -> Column:
    """Lower case, squeezed; null counts as empty."""
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def clean(c: Column, lower: bool = True) -> Column:
    """URLs, tags, bullets without content and dash runs go; white space is squeezed; null counts as empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), URL, " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[\r\n\t]+", " "), r"<[^>]+>", " ")
    chunks = F.filter(F.split(c, "•"), lambda x: ~x.rlike(EMPTY_CHUNK))
    c = squeeze(F.regexp_replace(F.array_join(chunks, " "), DASHES, "-"))
    return F.lower(c) if lower else c


def unescape(c: Column) -> Column:
    """Unicode NFC, then HTML character references; only strings that can change go through Arrow."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import html
        import unicodedata

        return s.map(lambda x: None if x is None else html.unescape(unicodedata.normalize("NFC", x)))

    return F.when(c.rlike(r"&|[^\x00-\x7F]"), run(c)).otherwise(c)


def tokens(c: Column) -> Column:
    """White-space tokens; none for null or blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def first_words(c: Column, n: int) -> Column:
    """The first n tokens; 0 means all."""
    return F.array_join(F.slice(tokens(c), 1, n) if n else tokens(c), " ")


def fuzzy_norm(c: Column) -> Column:
    """Titles for fuzzy comparison: lower, no points, hyphens as spaces."""
    return squeeze(F.replace(F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("."), F.lit("")), F.lit("-"), F.lit(" ")))


def canonical_key(*cols: Column) -> Column:
    """The first 16 hex digits of the fields' sha1."""
    return F.substring(F.sha1(F.concat_ws("|", *[norm(c) for c in cols])), 1, 16)


def make_uid(base: Column, title_norm: Column) -> Column:
    return F.concat(base.cast("string"), F.lit("|"), F.coalesce(title_norm, F.lit("")))


def uid_base(uid: Column) -> Column:
    return F.trim(F.substring_index(uid, "|", 1))


def snippet(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(" ..."))).otherwise(c)


def model_text(title: Column, cleaned: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(cleaned, F.lit("")))


def topic_text(mode: str, legacy: Column, **parts: Column) -> Column:
    """``legacy``: the column as it is; ``combo``: the named parts that aren't blank, each under its name."""
    if mode == "legacy":
        return F.coalesce(legacy, F.lit(""))
    if mode != "combo":
        raise ValueError(f"unknown topic text mode: {mode}")
    return F.concat_ws("  ", *[F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{name.upper()}: "), F.trim(c))) for name, c in parts.items()])


def union_pattern(patterns: list[str]) -> str | None:
    """One case-insensitive alternation of many patterns; none for an empty list."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns) if patterns else None


def matches_any(c: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found; false for null and for no patterns."""
    pattern = union_pattern(patterns)
    return F.coalesce(c.rlike(pattern), F.lit(False)) if pattern else F.lit(False)
