"""Duplicates: exact (keep first by row order) and fuzzy titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, fuzzy_norm


def first_by(df: DataFrame, key: Column | list[Column], order: Column | list[Column]) -> DataFrame:
    """The first row of each key in a total order; nulls of a key are equal.

    A window limit of one row runs before the shuffle, so that each task sends one row of a hot key.
    """
    keys = key if isinstance(key, list) else [key]
    orders = order if isinstance(order, list) else [order]
    w = Window.partitionBy(*keys).orderBy(*orders)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def repeats(df: DataFrame, key: Column, order: Column, name: str = "repeated") -> DataFrame:
    """Marks rows after the first of their key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1)


def dedupe_two_phase(df: DataFrame, row_id: str, hard_id: str | None, company: Column, title: Column, text: Column, null_policy: str = "collapse") -> DataFrame:
    """First by a hard id (its nulls collapse to one row, or all stay with ``keep``), then by company, title and text."""
    if hard_id:
        key = F.col(hard_id) if null_policy == "collapse" else F.struct(F.col(hard_id), F.when(F.col(hard_id).isNull(), F.col(row_id)))
        df = first_by(df, key, F.col(row_id))
    canon = F.concat_ws("|", F.lower(F.coalesce(company, F.lit(""))), clean(title), F.md5(F.coalesce(text, F.lit(""))))
    return first_by(df, canon, F.col(row_id))


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    # bit-parallel: the set bits of the complement are the matched places of ``a``
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        u = row & at.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both, p, q = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not p or not q):
        return 100.0
    base = " ".join(both)
    s, t = " ".join(both + p), " ".join(both + q)
    return max(indel_ratio(base, s) if both else 0.0, indel_ratio(base, t) if both else 0.0, indel_ratio(s, t))


SCORERS = {"token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio}


def fuzzy_titles(df: DataFrame, title: str, row_id: str, threshold: int = 90, scorer: str = "token_sort_ratio") -> DataFrame:
    """Greedy clusters of titles in the order of their first rows; adds the normalised and canonical title, score, id, size.

    The greedy order is what defines the clusters, so distinct titles (one row each, counted before) go through one
    ordered task; the rows themselves are only joined with the outcome.
    """
    import hashlib

    score = SCORERS[scorer]
    named = df.withColumn("title_normalized", fuzzy_norm(F.col(title)))
    distinct = named.groupBy("title_normalized").agg(F.min(row_id).alias("first_row"), F.count(F.lit(1)).alias("n"))

    def cluster(batches):
        import pandas as pd

        canon: list[str] = []
        for pdf in batches:
            rows = []
            for t, n in zip(pdf["title_normalized"], pdf["n"], strict=True):
                best, at = -1.0, None
                for c in canon:
                    found = score(t, c)
                    if found > best:
                        best, at = found, c
                if at is None or best < threshold:
                    canon.append(t)
                    best, at = 100.0, t
                rows.append((t, at, int(best), hashlib.md5(at.encode()).hexdigest()[:12], n))
            yield pd.DataFrame(rows, columns=["title_normalized", "title_canonical", "title_fuzzy_score", "title_cluster_id", "n"])

    ordered = distinct.repartition(1).sortWithinPartitions("first_row").select("title_normalized", "n")
    clusters = ordered.mapInPandas(cluster, "title_normalized string, title_canonical string, title_fuzzy_score int, title_cluster_id string, n long")
    size = F.sum("n").over(Window.partitionBy("title_canonical")).cast("int")  # of distinct titles
    return named.join(clusters.withColumn("title_cluster_size", size).drop("n"), "title_normalized")


def collapse_titles(df: DataFrame, row_id: str, keep: str = "first", date: str | None = None, keep_columns: bool = True) -> DataFrame:
    """One row for each canonical title: the first, or the most recent."""
    order = [F.col(row_id)] if keep == "first" or date is None else [F.desc_nulls_last(date), F.col(row_id)]
    out = first_by(df, F.col("title_canonical"), order).withColumn("title_collapsed", F.lit(True))
    return out if keep_columns else out.drop("title_normalized", "title_canonical", "title_fuzzy_score", "title_cluster_id", "title_cluster_size")
