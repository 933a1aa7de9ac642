"""Weak labels by patterns, and the split into kept and dropped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import matches_any, token_count


def split_patterns(patterns: list[str], context: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Strong patterns, and those whose own text has a word that needs context."""
    words = fixed.CONTEXT_WORDS if context is None else context
    contextual = [p for p in patterns if any(w in p.lower() for w in words)]
    return [p for p in patterns if p not in contextual], contextual


def weak_labels(df: DataFrame, title: Column, text: Column, pos_title: list[str] | None = None, pos_text: list[str] | None = None, neg_title: list[str] | None = None, rule: str = "default") -> DataFrame:
    """Adds label_weak, pos_matches and neg_matches (flags).

    ``default``: a positive title or text, and no negative title. ``strict``: titles whose pattern needs context count
    only together with the text, and the text alone doesn't count.
    """
    pos_title = fixed.POSITIVE_TITLES if pos_title is None else pos_title
    pos_text = fixed.POSITIVE_DESCRIPTIONS if pos_text is None else pos_text
    neg = matches_any(title, fixed.NEGATIVE_TITLES if neg_title is None else neg_title)
    in_title, in_text = matches_any(title, pos_title), matches_any(text, pos_text)
    if rule == "strict":
        strong, contextual = split_patterns(pos_title)
        positive = matches_any(title, strong) | (matches_any(title, contextual) & in_text)
    elif rule == "default":
        positive = in_title | in_text
    else:
        raise ValueError(f"unknown rule: {rule}")
    flags = {"label_weak": positive & ~neg, "pos_matches": in_title | in_text, "neg_matches": neg}
    return df.withColumns({k: v.cast("int") for k, v in flags.items()})


def pu_labels(df: DataFrame, title: Column, strong: list[str], forced_negative: list[str]) -> DataFrame:
    """label_pu: a strong title and no forced negative."""
    return df.withColumn("label_pu", (matches_any(title, strong) & ~matches_any(title, forced_negative)).cast("int"))


def is_dropped(p: Column, neg: Column, tokens: Column, tau: float = 0.15, min_tokens: int = 15) -> Column:
    return F.coalesce((p < tau) & (neg > 0) & (tokens >= min_tokens), F.lit(False))


def split_rows(df: DataFrame, p: str = "p_rnd", neg: str = "neg_matches", text: str = "text_for_bertopic", tau: float = 0.15, min_tokens: int = 15) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): disjoint, and together all rows."""
    dropped = is_dropped(F.col(p), F.col(neg), token_count(F.col(text)), tau, min_tokens)
    return df.filter(~dropped), df.filter(dropped)


def topic_filter(text: Column, p: Column, label: Column | None = None, min_chars: int = 200, cutoff: float = 0.5, use_label: bool = False) -> Column:
    """Long enough, and probable enough (or, with the flag, labelled)."""
    core = F.coalesce(p >= cutoff, F.lit(False))
    if use_label and label is not None:
        core = core | F.coalesce(label == 1, F.lit(False))
    return (F.length(F.coalesce(text, F.lit(""))) >= min_chars) & core


def domain_filter(df: DataFrame, domain: str, wanted: str | None, fallback: bool = True) -> DataFrame:
    """Rows whose domain contains a literal; all rows where none does and ``fallback`` is set."""
    if not wanted:
        return df
    found = df.filter(F.lower(F.col(domain)).contains(wanted.lower()))
    return df if fallback and found.isEmpty() else found


def uncertain_dropped(dropped: DataFrame, n: int, low: float, high: float, p: str = "p_rnd", row_id: str = "uid") -> DataFrame:
    """The n most probable dropped rows within a range of probability."""
    return dropped.filter(F.col(p).between(low, high)).orderBy(F.desc(p), row_id).limit(n)
