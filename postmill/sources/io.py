"""Readers by suffix, unions, and sinks. Paths may be of any store that Spark reads."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: columns of the exports
KEPT = "uid title title_clean company location domain description text_for_bertopic min_amount max_amount currency site job_url date_posted p_rnd label_weak pos_matches neg_matches".split()
KEPT_JSON = [c for c in KEPT if c not in ("pos_matches", "neg_matches")]
FLAT = "uid title company domain p_rnd topic_id topic_prob".split()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """On the driver: workbooks are small. Needs pandas' optional reader; reads a local copy."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path.removeprefix("file://")))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".csv": read_csv,
    ".xlsx": read_excel,
    ".xls": read_excel,
    ".parquet": lambda spark, path: spark.read.parquet(path),
    ".json": lambda spark, path: spark.read.json(path),
    ".jsonl": lambda spark, path: spark.read.json(path),
    ".jsonl.gz": lambda spark, path: spark.read.json(path),
    ".orc": lambda spark, path: spark.read.orc(path),
}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The reader of the longest known suffix; an error for others."""
    for suffix in sorted(READERS, key=len, reverse=True):
        if path.rstrip("/").lower().endswith(suffix):
            return READERS[suffix](spark, path)
    if _exists(spark, path) and (inside := _tabular(spark, path)):
        return union_by_name([read_any(spark, p) for p in inside])
    raise ValueError(f"unsupported input: {path}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _tabular(spark: SparkSession, folder: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return []
    found = [s.getPath().toString() for s in fs.listStatus(p)]
    return sorted(f for f in found if f.lower().endswith(".xlsx")) + sorted(f for f in found if f.lower().endswith(".csv"))


def resolve(spark: SparkSession, path: str | None = None, combined: str | None = None, parts: tuple[str | None, ...] = ()) -> list[str]:
    """What to read: a file or a folder's workbooks and CSV files, else the combined file, else the parts."""
    if path:
        if not _exists(spark, path):
            raise FileNotFoundError(path)
        return _tabular(spark, path) or [path]
    if combined and _exists(spark, combined):
        return [combined]
    found = [p for p in parts if p and _exists(spark, p)]
    if not found:
        raise FileNotFoundError("no input is configured or there")
    return found


def union_by_name(frames: list[DataFrame], row_id: str | None = None) -> DataFrame:
    """A bag union; columns that one lacks are null. ``row_id``: numbers rows by frame and place in it."""
    marked = [df.withColumn(row_id, F.lit(i).cast("long") * (1 << 53) + F.monotonically_increasing_id()) for i, df in enumerate(frames)] if row_id else frames
    out = marked[0]
    for df in marked[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_domain(df: DataFrame, name: str = "Source.Name") -> DataFrame:
    """source_domain and domain from the part of the file's name before its first underscore, unless source_domain is there."""
    if "source_domain" in df.columns or name not in df.columns:
        return df
    domain = F.lower(F.substring_index(F.col(f"`{name}`"), "_", 1))
    return df.withColumn("source_domain", domain).withColumn("domain", domain)


def load(spark: SparkSession, path: str | None = None, combined: str | None = None, parts: tuple[str | None, ...] = (), row_id: str = "row_id") -> DataFrame:
    return with_domain(union_by_name([read_any(spark, p) for p in resolve(spark, path, combined, parts)], row_id))


def read_jsonl(spark: SparkSession, folder: str, name: str, override: str | None = None, required: tuple[str, ...] = ("uid", "text_for_bertopic")) -> DataFrame:
    """The compressed file where there is one, else the plain one."""
    choices = [override] if override else [f"{folder}/{name}.jsonl.gz", f"{folder}/{name}.jsonl"]
    path = next((p for p in choices if _exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(f"none of {choices}")
    df = spark.read.json(path)
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def tagged_pair(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """Both with ``source_bucket``."""
    return union_by_name([kept.withColumn("source_bucket", F.lit("kept")), dropped.withColumn("source_bucket", F.lit("dropped"))])


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the columns that are there, in the given order."""
    return df.select(*[c for c in names if c in df.columns])


def public_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def formatted(df: DataFrame, decimals: int = 8) -> DataFrame:
    """Doubles as text with fixed decimals, arrays of strings joined, other nested values as JSON: for CSV only."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            out[f.name] = F.when(F.col(f.name).isNotNull(), F.format_string(f"%.{decimals}f", F.col(f.name)))
        elif kind == "array<string>":
            out[f.name] = F.array_join(f.name, ", ")
        elif kind.startswith(("array", "map", "struct")):
            out[f.name] = F.to_json(f.name)
    return df.withColumns(out) if out else df


def write_csv(df: DataFrame, path: str, decimals: int = 8) -> str:
    formatted(df, decimals).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_jsonl(df: DataFrame, path: str, compressed: bool = True) -> str:
    """Nulls are written; NaN becomes null, as JSON has none."""
    doubles = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    writer = (df.withColumns(doubles) if doubles else df).write.mode("overwrite").option("ignoreNullFields", False)
    (writer.option("compression", "gzip") if compressed else writer).json(path)
    return path


def company_summary(df: DataFrame) -> DataFrame:
    """Postings and mean pay by company; the null company is a group."""
    return df.groupBy("company").agg(F.count("uid").alias("n_postings"), F.avg("min_amount").alias("avg_min_amount"), F.avg("max_amount").alias("avg_max_amount"))


def export_all(kept: DataFrame, out: str, dropped: DataFrame | None = None) -> dict[str, str]:
    """The kept table, the company summary, JSON lines, and the dropped rows."""
    paths = {
        "kept_csv": write_csv(project(kept, KEPT), f"{out}/kept_csv"),
        "company_summary_csv": write_csv(company_summary(kept), f"{out}/company_summary_csv"),
        "kept_jsonl": write_jsonl(project(kept, KEPT_JSON), f"{out}/kept_jsonl"),
    }
    if dropped is not None:
        paths["dropped_csv"] = write_csv(dropped, f"{out}/dropped_csv")
    return paths


def read_history(path: str) -> dict:
    """The run history, a small driver-side JSON file; empty where there is none."""
    try:
        with open(path) as file:
            return json.load(file)
    except FileNotFoundError:
        return {}


def write_history(path: str, history: dict) -> None:
    with open(path, "w") as file:
        json.dump(history, file)


def latex_summary(rows: list[tuple[str, float | None, float | None]], before: str = "Before", after: str = "After") -> str:
    """A table of metrics (name, before, after)."""
    show = lambda x: "--" if x is None else f"{x:,.0f}" if float(x).is_integer() else f"{x:,.2f}"
    body = "\n".join(f"{n.replace('_', ' ').replace('%', chr(92) + '%')} & {show(b)} & {show(a)} \\\\" for n, b, a in rows)
    return f"\\begin{{tabular}}{{lrr}}\n\\hline\nMetric & {before} & {after} \\\\\n\\hline\n{body}\n\\hline\n\\end{{tabular}}\n"
