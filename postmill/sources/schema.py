"""Headers and schema of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import squeeze


def header_name(name: str, headers: dict[str, str] | None = None) -> str:
    plain = name.strip().lower().replace(" ", "_")
    return (fixed.HEADERS if headers is None else headers).get(plain, plain)


def normalize_headers(df: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """Known names for known synonyms; columns that get one name are coalesced from left to right."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(header_name(c, headers), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(name) if len(cs) > 1 else F.col(f"`{cs[0]}`").alias(name) for name, cs in groups.items()])


def ensure_core_text(df: DataFrame) -> DataFrame:
    """title, description, company and location exist, squeezed and not null; the cleanest description wins."""
    for c in ("cleaned_description_2", "cleaned_description"):
        if c in df.columns:
            df = df.withColumn("description", F.col(c))
            break
    names = ("title", "description", "company", "location")
    return df.withColumns({c: squeeze(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("") for c in names})


def coerce(df: DataFrame, core: dict[str, str] | None = None, missing: str = "error") -> tuple[DataFrame, DataFrame]:
    """Core columns cast to their types, and the violations: (column_name, value, n) of what couldn't be cast."""
    core = fixed.CORE if core is None else core
    absent = [c for c in core if c not in df.columns]
    if absent and missing == "error":
        raise ValueError(f"missing columns: {', '.join(absent)}")
    casts = {c: (F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)) for c, t in core.items()}
    bad = F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))) for c, t in core.items() if c in df.columns])
    found = df.select(F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("v")).select("v.*")
    return df.withColumns(casts), found.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
