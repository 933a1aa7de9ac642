"""Every query of the library with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedupe
from . import label_queries, mining_queries, quality_queries, source_queries, text_queries
from .base import CLEAN, QUERIES, SQL, TOKENS, query, table

_MODULES = (label_queries, mining_queries, quality_queries, source_queries, text_queries)


@query(f"""
WITH c AS (SELECT doc_id, lang, {CLEAN.format(c='text')} AS cleaned FROM documents),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY md5(cleaned) ORDER BY doc_id) = 1)
SELECT lang, count(*) AS n_rows, avg({TOKENS.format(c='cleaned')}) AS avg_tokens FROM f WHERE {TOKENS.format(c='cleaned')} >= 15 GROUP BY lang""")
def clean_dedupe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, keep the first of equal texts, drop short ones, summarise by language."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", text.clean(F.col("text")).alias("cleaned"))
    rows = rows.select("doc_id", "lang", F.md5("cleaned").alias("md5"), text.token_count(F.col("cleaned")).alias("n_tokens"))
    first = dedupe.first_by(rows, F.col("md5"), F.col("doc_id")).filter("n_tokens >= 15")
    return first.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("n_tokens").alias("avg_tokens"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_dedupe_summary(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
