"""Queries of headers, schema, sources and sinks: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import labels
from ..sources import io, schema
from .base import P_SQL, p_of, query, table
from .session import shared_dir

_SQUEEZE = r"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS title, c_name AS company, c_acctbal AS min_amount, c_nationkey AS other_name FROM customer""")
def schema_headers(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias(" Job Title"), F.col("c_mktsegment").alias("title"),
        F.col("c_name").alias("Company Name"), F.col("c_acctbal").alias("MIN_SALARY"), F.col("c_nationkey").alias("Other Name"),
    )
    return schema.normalize_headers(rows)


@query(f"""SELECT doc_id, {_SQUEEZE.format(c="CASE WHEN doc_id % 3 <> 0 THEN ' ' || lang || '  x ' END")} AS title, md5({_SQUEEZE.format(c='text')}) AS description_md5, CAST(doc_id AS VARCHAR) AS company, '' AS location FROM documents""")
def schema_core_text(spark, sf):
    title = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" "), "lang", F.lit("  x ")))
    rows = table(spark, sf, "documents").select("doc_id", title.alias("title"), F.col("source").alias("description"), F.col("text").alias("cleaned_description"), F.col("doc_id").alias("company"))
    return schema.ensure_core_text(rows).select("doc_id", "title", F.md5("description").alias("description_md5"), "company", "location")


_AMOUNT = "CASE o_orderkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN o_orderpriority WHEN 2 THEN CAST(o_orderkey AS VARCHAR) || '.5' END"


def _coerced(spark, sf):
    k = F.col("o_orderkey") % 4
    amount = F.when(k == 0, "n/a").when(k == 1, F.col("o_orderpriority")).when(k == 2, F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")))
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("title"), amount.alias("min_amount"))
    return schema.coerce(rows, missing="null")


@query(f"SELECT o_orderkey, o_orderstatus AS title, TRY_CAST({_AMOUNT} AS DOUBLE) AS min_amount, NULL::DOUBLE AS max_amount, NULL::VARCHAR AS site FROM orders")
def schema_coerced(spark, sf):
    return _coerced(spark, sf)[0].select("o_orderkey", "title", "min_amount", "max_amount", "site")


@query(f"SELECT 'min_amount' AS column_name, v AS value, count(*) AS n FROM (SELECT {_AMOUNT} AS v FROM orders) WHERE v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL GROUP BY v")
def schema_violations(spark, sf):
    return _coerced(spark, sf)[1]


@query("""SELECT doc_id, TRY_CAST(s AS DOUBLE) AS number, CASE WHEN c <> '' THEN c ELSE lang END AS job_title, CAST(coalesce(TRY_CAST(s AS DOUBLE), 0) AS INTEGER) AS label
FROM (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '0.0' WHEN 2 THEN 'x' END AS s, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source END AS c FROM documents)""")
def field_numbers(spark, sf):
    k, m = F.col("doc_id") % 4, F.col("doc_id") % 3
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.when(k == 0, "1").when(k == 1, "0.0").when(k == 2, "x").alias("s"), F.when(m == 0, "").when(m == 1, F.col("source")).alias("c"))
    return rows.select("doc_id", fields.to_number(F.col("s")).alias("number"), fields.job_title(F.col("c"), F.col("lang")).alias("job_title"), fields.label_int(F.col("s")).alias("label"))


@query("SELECT page_id, lower(split_part(n, '_', 1)) AS source_domain, lower(split_part(n, '_', 1)) AS domain FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Bio_2024_a.xlsx' WHEN 1 THEN 'PLAIN.csv' END AS n FROM pages)")
def source_domain(spark, sf):
    k = F.col("page_id") % 3
    rows = table(spark, sf, "pages").select("page_id", F.when(k == 0, "Bio_2024_a.xlsx").when(k == 1, "PLAIN.csv").alias("Source.Name"))
    return io.with_domain(rows).select("page_id", "source_domain", "domain")


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance, 'kept' AS source_bucket FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'dropped' FROM supplier")
def tagged_rows(spark, sf):
    kept = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    dropped = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return io.tagged_pair(kept, dropped)


@query("SELECT doc_id, source FROM documents")
def domain_filter_fallback(spark, sf):
    """No source has the wanted text, so all rows stay."""
    return labels.domain_filter(table(spark, sf, "documents").select("doc_id", "source"), "source", "no such source")


_KEPT = f"(SELECT doc_id, lang, source, text, {P_SQL} AS p FROM documents)"


def _exported(spark, sf, label):
    """Documents in the role of scored postings, written by the sinks; the folder they are in."""
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("uid"), F.col("lang").alias("title"), F.col("source").alias("company"), F.col("text").alias("text_for_bertopic"),
        F.col("n_chars").cast("double").alias("min_amount"), F.lit(None).cast("double").alias("max_amount"), p_of().alias("p_rnd"), F.lit(1).alias("extra"),
    )
    return io.export_all(rows.filter("p_rnd >= 0.15"), shared_dir(spark, label), rows.filter("p_rnd < 0.15").select("uid", "p_rnd", "extra"))


@query(f"SELECT doc_id AS uid, lang AS title, source AS company, round(p, 6) AS p_rnd FROM {_KEPT} k WHERE p >= 0.15")
def sink_kept_csv(spark, sf):
    """Resolved as a folder of CSV files, each read by its suffix."""
    found = io.load(spark, _exported(spark, sf, "kept_csv")["kept_csv"])
    return found.select(F.col("uid").cast("long").alias("uid"), "title", "company", F.round(F.col("p_rnd").cast("double"), 6).alias("p_rnd"))


@query(f"SELECT doc_id AS uid, round(p, 6) AS p_rnd, 1 AS extra FROM {_KEPT} k WHERE p < 0.15")
def sink_dropped_csv(spark, sf):
    found = io.read_csv(spark, _exported(spark, sf, "dropped_csv")["dropped_csv"])
    return found.select(F.col("uid").cast("long").alias("uid"), F.round(F.col("p_rnd").cast("double"), 6).alias("p_rnd"), F.col("extra").cast("int").alias("extra"))


@query("SELECT source AS company, count(*) AS n_postings, round(avg(n_chars::DOUBLE), 4) AS avg_min_amount, NULL::DOUBLE AS avg_max_amount FROM documents WHERE (doc_id * 7919 % 1000) / 1000.0::DOUBLE >= 0.15 GROUP BY source")
def sink_company_summary(spark, sf):
    found = io.read_csv(spark, _exported(spark, sf, "summary")["company_summary_csv"])
    return found.select("company", F.col("n_postings").cast("long").alias("n_postings"), F.round(F.col("avg_min_amount").cast("double"), 4).alias("avg_min_amount"), F.col("avg_max_amount").cast("double").alias("avg_max_amount"))


@query(f"SELECT doc_id AS uid, lang AS title, md5(text) AS text_md5, p AS p_rnd FROM {_KEPT} k WHERE p >= 0.15")
def sink_kept_jsonl(spark, sf):
    """Compressed JSON lines, whole texts included."""
    path = _exported(spark, sf, "kept_jsonl")["kept_jsonl"]
    found = io.read_jsonl(spark, path, "kept", override=path)
    return found.select(F.col("uid").cast("long").alias("uid"), "title", F.md5("text_for_bertopic").alias("text_md5"), "p_rnd")


@query(f"SELECT doc_id AS uid, p AS p_rnd FROM {_KEPT} k WHERE p BETWEEN 0.2 AND 0.9 ORDER BY p DESC, doc_id LIMIT 50")
def sink_uncertain_jsonl(spark, sf):
    rows = labels.uncertain_dropped(table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), p_of().alias("p_rnd")), 50, 0.2, 0.9)
    path = io.write_jsonl(rows, shared_dir(spark, "uncertain"), compressed=False)
    return spark.read.json(path).select("uid", "p_rnd")
