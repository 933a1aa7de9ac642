"""Shared inputs of the queries: the driver's tables in the roles of postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that it must agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A word of a list as a whole word, for engines whose word boundaries differ.
def word(*words: str) -> str:
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?:$|[^\p{{L}}\p{{N}}_])"


#: The cleaning chain in SQL, of a column ``{c}``.
CLEAN = r"""lower(trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(
  regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), 'https?://\S+|www\.\S+', ' ', 'g'), '[\r\n\t]+', ' ', 'g'), '<[^>]+>', ' ', 'g'), '•'),
  lambda x: NOT regexp_matches(x, '^[\-\x{{2013}}\x{{2014}}\.\*\x{{2022}}\s]*$')), ' '), '[\-\x{{2013}}\x{{2014}}]{{2,}}', '-', 'g'), '\s+', ' ', 'g')))"""
#: Squeezing and lowering in SQL.
NORM = r"trim(regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g'))"
#: The number of white-space tokens in SQL.
TOKENS = r"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '\s+'), lambda x: x <> ''))"
#: A probability for each document, by rule.
P_SQL = "(doc_id * 7919 % 1000) / 1000.0::DOUBLE"


def p_of(c: str = "doc_id"):
    return (F.col(c) * 7919 % 1000) / F.lit(1000.0)


def in_sql(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
