"""Queries of data-quality metrics: documents before and after a cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedupe, quality
from .base import NORM, P_SQL, TOKENS, p_of, query, table

# before: some fields of documents are taken away, ids and URLs repeat; after: rows that the cleaning kept
_B = f"""(SELECT doc_id AS row_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id // 3 * 2 + doc_id % 2 END AS id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'u' || (doc_id // 2) END AS job_url,
  CASE WHEN doc_id % 5 <> 0 THEN substr(text, 1, 30) END AS title, CASE doc_id % 6 WHEN 0 THEN 'Boston' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Austin, TX' WHEN 3 THEN NULL ELSE 'New York' END AS location,
  CASE WHEN doc_id % 9 <> 0 THEN lang ELSE ' ' END AS domain, CASE doc_id % 7 WHEN 0 THEN 'abc' WHEN 1 THEN CAST(45000 + doc_id % 300 AS VARCHAR) WHEN 2 THEN NULL ELSE '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') END AS date_posted,
  source AS company, text, {P_SQL} AS p FROM documents)"""
_A = f"(SELECT * FROM {_B} b WHERE row_id % 3 <> 0 AND title IS NOT NULL)"
_DATE = "CASE WHEN try_cast({c} AS DOUBLE) IS NOT NULL THEN CASE WHEN try_cast({c} AS DOUBLE) BETWEEN 20000 AND 80000 THEN CAST(DATE '1899-12-30' + CAST(try_cast({c} AS DOUBLE) AS INTEGER) AS TIMESTAMP) END ELSE try_cast({c} AS TIMESTAMP) END"
_D = _DATE.format(c="date_posted")
_LOC = f"coalesce(contains(lower(trim(location)), 'remote') OR contains(location, ',') OR {TOKENS.format(c='location')} >= 2, false)"
_DOM = "trim(coalesce(domain, '')) <> ''"


def before_rows(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    place = F.when(i % 6 == 0, "Boston").when(i % 6 == 1, "Remote").when(i % 6 == 2, "Austin, TX").when(i % 6 != 3, "New York")
    posted = F.when(i % 7 == 0, "abc").when(i % 7 == 1, (F.lit(45000) + i % 300).cast("string")).when(i % 7 != 2, F.concat(F.lit("2024-01-"), F.lpad((1 + i % 28).cast("string"), 2, "0")))
    return d.select(
        i.alias("row_id"),
        F.when(i % 11 != 0, F.floor(i / 3) * 2 + i % 2).alias("id"),
        F.when(i % 4 != 0, F.concat(F.lit("u"), F.floor(i / 2).cast("string"))).alias("job_url"),
        F.when(i % 5 != 0, F.substring("text", 1, 30)).alias("title"),
        place.alias("location"),
        F.when(i % 9 != 0, F.col("lang")).otherwise(" ").alias("domain"),
        posted.alias("date_posted"),
        F.col("source").alias("company"),
        "text",
        p_of().alias("p"),
    )


def after_rows(spark, sf):
    return before_rows(spark, sf).filter("row_id % 3 <> 0 and title is not null")


CORE = ["title", "location", "date_posted"]


@query(f"SELECT (count(title) * 100.0::DOUBLE / count(*) + count(location) * 100.0::DOUBLE / count(*) + count(date_posted) * 100.0::DOUBLE / count(*)) / 3 AS completeness FROM {_B} b")
def dq_completeness(spark, sf):
    return quality.completeness(before_rows(spark, sf), CORE)


@query(f"SELECT (count(title) * 100.0::DOUBLE / count(*) + count(location) * 100.0::DOUBLE / count(*)) / 3 AS completeness FROM {_B} b")
def dq_completeness_absent_zero(spark, sf):
    return quality.completeness(before_rows(spark, sf), ["title", "location", "not_there"], absent="zero")


@query(f"SELECT 'title' AS column_name, count(title) * 100.0::DOUBLE / count(*) AS completeness FROM {_B} b UNION ALL SELECT 'location', count(location) * 100.0::DOUBLE / count(*) FROM {_B} b UNION ALL SELECT 'date_posted', count(date_posted) * 100.0::DOUBLE / count(*) FROM {_B} b")
def dq_completeness_by_column(spark, sf):
    return quality.completeness_by_column(before_rows(spark, sf), CORE)


@query(f"SELECT 100.0::DOUBLE * (count_if({_D} IS NOT NULL) + count_if({_LOC}) + count_if({_DOM})) / (count(*) * 3) AS validity FROM {_B} b")
def dq_validity(spark, sf):
    return quality.validity(before_rows(spark, sf), quality.validity_checks("date_posted", "location", "domain"))


@query(f"SELECT 100.0::DOUBLE * (count_if({_D} IS NOT NULL) + count_if({_LOC})) / (count(*) * 3) AS validity FROM {_B} b")
def dq_validity_absent_column(spark, sf):
    return quality.validity(before_rows(spark, sf), {**quality.validity_checks("date_posted", "location"), "domain": None})


@query(f"SELECT (100.0::DOUBLE * count_if({_D} IS NOT NULL) / count(*) + 100.0::DOUBLE * count_if({_DOM}) / count(*)) / 2 AS validity FROM {_B} b")
def dq_validity_mean(spark, sf):
    return quality.validity_mean(before_rows(spark, sf), quality.validity_checks(date="date_posted", domain="domain"))


@query("SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5")
def dq_allowed_domains(spark, sf):
    return quality.allowed_domains(table(spark, sf, "documents"), "source", n=5)


@query(f"SELECT 100.0::DOUBLE * count(DISTINCT id) / count(*) AS uniqueness FROM {_B} b")
def dq_uniqueness(spark, sf):
    return quality.uniqueness(before_rows(spark, sf), "id")


@query(f"SELECT 100.0::DOUBLE * (count(DISTINCT id) + max(CAST(id IS NULL AS INTEGER))) / count(*) AS uniqueness FROM {_B} b")
def dq_uniqueness_null_counts(spark, sf):
    return quality.uniqueness(before_rows(spark, sf), "id", null_counts=True)


@query(f"SELECT 100.0::DOUBLE * count_if(trim(coalesce(title, '')) = '' OR trim(coalesce(domain, '')) <> '') / count(*) AS consistency FROM {_B} b")
def dq_consistency(spark, sf):
    return quality.consistency(before_rows(spark, sf), {"title": quality.title_consistent("title", "domain")})


@query(f"SELECT 100.0::DOUBLE * count(d) / count(*) AS parse_rate, min(d) AS min_date, max(d) AS max_date, 'ok' AS flag FROM (SELECT {_D} AS d FROM {_B} b)")
def dq_timeliness(spark, sf):
    return quality.timeliness(before_rows(spark, sf), quality.robust_date(F.col("date_posted")))


_BAD = f"""(SELECT *, (id_place > 1) OR (url_place > 1 AND trim(coalesce(job_url, '')) <> '') OR trim(coalesce(title, '')) = '' OR trim(coalesce(location, '')) = '' OR trim(coalesce(date_posted, '')) = ''
  OR ({_D}) IS NULL OR NOT ({_DOM}) OR NOT ({_LOC}) AS bad
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id) AS id_place, row_number() OVER (PARTITION BY job_url ORDER BY row_id) AS url_place FROM {_B} b))"""


def _flagged(spark, sf):
    return quality.bad_rows(before_rows(spark, sf), "row_id", CORE, "id", "job_url", "date_posted", "location", "domain")


@query("""SELECT 'none' AS side, 0.0::DOUBLE AS parse_rate, 'all_unparseable' AS flag UNION ALL
SELECT 'epoch', 100.0::DOUBLE, CASE WHEN min(y) = 1970 AND max(y) = 1970 THEN 'suspicious_all_1970' ELSE 'ok' END FROM (SELECT year(DATE '1970-01-01' + CAST(doc_id % 300 AS INTEGER)) AS y FROM documents)
UNION ALL SELECT 'orders', 100.0::DOUBLE * count(o_orderdate) / count(*), CASE WHEN min(year(o_orderdate)) = 1970 AND max(year(o_orderdate)) = 1970 THEN 'suspicious_all_1970' ELSE 'ok' END FROM orders""")
def dq_timeliness_flags(spark, sf):
    docs = table(spark, sf, "documents")
    epoch = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd")
    sides = {"none": (docs, F.lit("abc")), "epoch": (docs, epoch), "orders": (table(spark, sf, "orders"), F.date_format("o_orderdate", "yyyy-MM-dd"))}
    rows = [quality.timeliness(df, quality.robust_date(c)).select(F.lit(n).alias("side"), "parse_rate", "flag") for n, (df, c) in sides.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"SELECT row_id, bad FROM {_BAD} x")
def dq_bad_rows(spark, sf):
    return _flagged(spark, sf).select("row_id", "bad")


@query(f"""SELECT removed, bad_rows, both_n AS "both", coalesce(100.0::DOUBLE * both_n / nullif(removed, 0), 0) AS precision, coalesce(100.0::DOUBLE * both_n / nullif(bad_rows, 0), 0) AS recall
FROM (SELECT count_if(gone) AS removed, count_if(bad) AS bad_rows, count_if(gone AND bad) AS both_n FROM (SELECT bad, row_id NOT IN (SELECT row_id FROM {_A} a) AS gone FROM {_BAD} x))""")
def dq_precision_recall(spark, sf):
    after = after_rows(spark, sf).withColumn("uid", text.make_uid(F.col("row_id"), F.col("title")))
    return quality.precision_recall(_flagged(spark, sf), after, "row_id", "uid")


_SIDE = "SELECT unnest(['nulls:title', 'nulls:location', 'nulls:date_posted', 'duplicates:id']) AS issue, unnest([count_if(title IS NULL), count_if(location IS NULL), count_if(date_posted IS NULL), count(*) - count(DISTINCT id) - max(CAST(id IS NULL AS INTEGER))]) AS {n} FROM {t} s"


@query(f"SELECT issue, before_n, after_n, greatest(0, before_n - after_n) AS fixed FROM ({_SIDE.format(n='before_n', t=_B)}) x JOIN ({_SIDE.format(n='after_n', t=_A)}) y USING (issue)")
def dq_issues_fixed(spark, sf):
    return quality.issues_fixed(before_rows(spark, sf), after_rows(spark, sf), CORE, "id")


@query(f"SELECT count(*) AS n_after, count(b.id) AS n_both, 100.0::DOUBLE * count(b.id) / count(*) AS match_rate FROM (SELECT DISTINCT id FROM {_A} a WHERE id IS NOT NULL) k LEFT JOIN (SELECT DISTINCT id FROM {_B} b WHERE location IS NOT NULL) b USING (id)")
def dq_alignment(spark, sf):
    before, after = before_rows(spark, sf).filter("location IS NOT NULL"), after_rows(spark, sf)
    _, key = quality.alignment_key(before, after)
    return quality.key_match_rate(before, after, key)


_LEDGER = f"""(WITH b AS (SELECT id AS record_key, bool_or(trim(coalesce(title, '')) = '') AS mt, bool_or(trim(coalesce(location, '')) = '') AS ml, bool_or(NOT {_LOC}) AS il,
    arg_min(title, row_id) FILTER (title IS NOT NULL) AS vt, arg_min(location, row_id) FILTER (location IS NOT NULL) AS vl FROM {_B} x WHERE id IS NOT NULL GROUP BY id),
  a AS (SELECT id AS record_key, bool_or(trim(coalesce(title, '')) = '') AS mt, bool_or(trim(coalesce(location, '')) = '') AS ml, bool_or(NOT {_LOC}) AS il,
    arg_min(title, row_id) FILTER (title IS NOT NULL) AS vt, arg_min(location, row_id) FILTER (location IS NOT NULL) AS vl FROM {_A} x WHERE id IS NOT NULL GROUP BY id),
  r AS (SELECT record_key, 'title' AS column_name, 'missing' AS issue_type, b.mt AS before_has_issue, a.mt AS after_has_issue, b.vt AS before_value, a.vt AS after_value FROM b JOIN a USING (record_key)
    UNION ALL SELECT record_key, 'location', 'missing', b.ml, a.ml, b.vl, a.vl FROM b JOIN a USING (record_key)
    UNION ALL SELECT record_key, 'location', 'invalid', b.il, a.il, b.vl, a.vl FROM b JOIN a USING (record_key))
  SELECT *, before_has_issue AND NOT after_has_issue AS fixed FROM r WHERE before_has_issue OR after_has_issue)"""


def _ledger(spark, sf):
    return quality.error_ledger(before_rows(spark, sf), after_rows(spark, sf), "id", "row_id", ["title", "location"], {"location": quality.location_valid(F.col("location"))})


@query(f"SELECT * FROM {_LEDGER} l")
def dq_error_ledger(spark, sf):
    return _ledger(spark, sf)


@query(f"SELECT issue_type, count_if(before_has_issue) AS before_issues, count_if(after_has_issue) AS after_issues, count_if(fixed) AS fixed_issues FROM {_LEDGER} l GROUP BY issue_type")
def dq_ledger_totals(spark, sf):
    return quality.ledger_totals(_ledger(spark, sf))


@query(f"""WITH l AS (SELECT * FROM {_LEDGER} x), f AS (SELECT DISTINCT record_key + 1 AS record_key, column_name, issue_type FROM l WHERE fixed), g AS (SELECT DISTINCT record_key, column_name, issue_type, true AS again FROM l WHERE after_has_issue)
SELECT count(*) AS n_fixed, count(again) AS n_again, coalesce(100.0::DOUBLE * count(again) / nullif(count(*), 0), 0) AS recurrence FROM f LEFT JOIN g USING (record_key, column_name, issue_type)""")
def dq_recurrence(spark, sf):
    current = _ledger(spark, sf)
    return quality.ledger_recurrence(current.withColumn("record_key", F.col("record_key") + 1), current)


@query(f"SELECT CAST(trunc(median({TOKENS.format(c='text')})) AS INTEGER) AS median_tokens, 100.0::DOUBLE * count_if({TOKENS.format(c='text')} < 30) / count(*) AS short_pct FROM documents")
def dq_text_info(spark, sf):
    return quality.text_informativeness(table(spark, sf, "documents"), "text")


@query(f"SELECT count_if(hit) AS n_contaminated, 100.0::DOUBLE * count_if(hit) / count(*) AS contamination_pct FROM (SELECT length({NORM.format(c='w')}) > 2 AND contains(lower(coalesce(text, '')), {NORM.format(c='w')}) AS hit FROM (SELECT text, CASE WHEN doc_id % 3 = 0 THEN substr(text, 5, 6) ELSE source END AS w FROM documents))")
def dq_contamination(spark, sf):
    rows = table(spark, sf, "documents").select("text", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 5, 6)).otherwise(F.col("source")).alias("company"))
    return quality.contamination(rows, "text", "company")


_M = "SELECT unnest(['completeness', 'uniqueness']) AS metric, unnest([(count(title) * 100.0::DOUBLE / count(*) + count(location) * 100.0::DOUBLE / count(*) + count(date_posted) * 100.0::DOUBLE / count(*)) / 3, 100.0::DOUBLE * count(DISTINCT id) / count(*)]) AS {n} FROM {t} s"


def _metrics(df):
    return quality.completeness(df, CORE).join(F.broadcast(quality.uniqueness(df, "id")))


@query(f"SELECT metric, before_value, after_value, after_value - before_value AS improvement FROM ({_M.format(n='before_value', t=_B)}) b JOIN ({_M.format(n='after_value', t=_A)}) a USING (metric)")
def dq_metric_table(spark, sf):
    return quality.metric_table(_metrics(before_rows(spark, sf)), _metrics(after_rows(spark, sf)), ["completeness", "uniqueness"])


@query(f"SELECT metric, before_value AS before, after_value AS after FROM ({_M.format(n='before_value', t=_B)}) b JOIN ({_M.format(n='after_value', t=_A)}) a USING (metric)")
def dq_metric_pivot(spark, sf):
    t = dq_metric_table(spark, sf)
    long = t.select("metric", F.lit("before").alias("dataset"), F.col("before_value").alias("value")).unionByName(t.select("metric", F.lit("after").alias("dataset"), F.col("after_value").alias("value")))
    return quality.pivot_metrics(long, ["before", "after"])


@query("""SELECT coalesce(100.0::DOUBLE * f / nullif(t, 0), 0) AS resolution_pct, coalesce(100.0::DOUBLE * a / nullif(t, 0), 0) AS automation_pct, s / 60 AS minutes, s / 3600 AS hours, s * 1000.0::DOUBLE / nullif(t, 0) AS seconds_per_1000, s / 3600 * 50 / nullif(t, 0) AS cost_per_record
FROM (SELECT count(*) AS t, count_if(doc_id % 3 = 0) AS f, count_if(doc_id % 5 = 0) AS a, 90.0::DOUBLE AS s FROM documents)""")
def dq_process(spark, sf):
    totals = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("doc_id") % 3 == 0).alias("f"), F.count_if(F.col("doc_id") % 5 == 0).alias("a"), F.lit(90.0).alias("s"))
    return quality.process_metrics(totals, "t", "f", "a", "s")


@query("SELECT doc_id, lang, NULL::VARCHAR AS is_correct, NULL::VARCHAR AS audit_notes FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 40")
def dq_audit_sample(spark, sf):
    return quality.audit_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 40)


@query("SELECT doc_id, row_number() OVER (PARTITION BY source, n_chars // 100 ORDER BY doc_id) > 1 AS repeated FROM documents")
def repeat_marks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.struct("source", F.floor(F.col("n_chars") / 100)).alias("k"))
    return dedupe.repeats(rows, F.col("k"), F.col("doc_id")).select("doc_id", "repeated")
