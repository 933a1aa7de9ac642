"""Queries of weak labels, splits, label issues and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import issues, labels, model
from ..sources.io import company_summary as summary
from .base import P_SQL, TOKENS, p_of, query, table, word

POS, CONTEXT, POS_TEXT, NEG = [word("the", "der", "que")], [word("and", "und") + "|technician"], [word("of", "von", "les")], [word("with", "mit")]
_W = lambda c, ps: "regexp_matches(coalesce({0}, ''), '(?i){1}')".format(c, "|".join(f"(?:{p})" for p in ps))
_TITLE = "lower(substr(text, 1, 60))"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", F.lower(F.substring("text", 1, 60)).alias("title"), F.lower("text").alias("body"), p_of().alias("p_rnd"))


@query(f"""SELECT doc_id, CAST((pt OR pd) AND NOT ng AS INTEGER) AS label_weak, CAST(pt OR pd AS INTEGER) AS pos_matches, CAST(ng AS INTEGER) AS neg_matches
FROM (SELECT doc_id, {_W(_TITLE, POS)} AS pt, {_W("lower(text)", POS_TEXT)} AS pd, {_W(_TITLE, NEG)} AS ng FROM documents)""")
def weak_labels(spark, sf):
    return labels.weak_labels(_docs(spark, sf), F.col("title"), F.col("body"), POS, POS_TEXT, NEG).select("doc_id", "label_weak", "pos_matches", "neg_matches")


@query(f"""SELECT doc_id, CAST((st OR (ct AND pd)) AND NOT ng AS INTEGER) AS label_weak
FROM (SELECT doc_id, {_W(_TITLE, POS)} AS st, {_W(_TITLE, CONTEXT)} AS ct, {_W("lower(text)", POS_TEXT)} AS pd, {_W(_TITLE, NEG)} AS ng FROM documents)""")
def weak_labels_strict(spark, sf):
    return labels.weak_labels(_docs(spark, sf), F.col("title"), F.col("body"), POS + CONTEXT, POS_TEXT, NEG, rule="strict").select("doc_id", "label_weak")


@query(f"SELECT doc_id, CAST({_W(_TITLE, POS)} AND NOT {_W(_TITLE, NEG)} AS INTEGER) AS label_pu FROM documents")
def pu_labels(spark, sf):
    return labels.pu_labels(_docs(spark, sf), F.col("title"), POS, NEG).select("doc_id", "label_pu")


@query(f"""SELECT doc_id, CASE WHEN {P_SQL} < 0.15 AND {_W(_TITLE, NEG)} AND {TOKENS.format(c="text")} >= 15 THEN 'dropped' ELSE 'kept' END AS source_bucket FROM documents""")
def keep_drop_split(spark, sf):
    rows = labels.weak_labels(_docs(spark, sf), F.col("title"), F.col("body"), POS, POS_TEXT, NEG)
    kept, dropped = labels.split_rows(rows, text="body")
    return kept.select("doc_id", F.lit("kept").alias("source_bucket")).unionByName(dropped.select("doc_id", F.lit("dropped").alias("source_bucket")))


@query("""SELECT c_name AS company, count(o_orderkey) AS n_postings, avg(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END) AS avg_min_amount, avg(o_totalprice) AS avg_max_amount
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name""")
def company_summary(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", "c_name")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return summary(rows.select(F.col("c_name").alias("company"), F.col("o_orderkey").alias("uid"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("min_amount"), F.col("o_totalprice").alias("max_amount")))


@query("""SELECT nullif(c_mktsegment, 'BUILDING') AS company, count(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END) AS n_postings, avg(c_acctbal) AS avg_min_amount, avg(NULL::DOUBLE) AS avg_max_amount FROM customer GROUP BY 1""")
def null_group_summary(spark, sf):
    rows = table(spark, sf, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("company"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("uid"), F.col("c_acctbal").alias("min_amount"), F.lit(None).cast("double").alias("max_amount"))
    return summary(rows)


@query(f"SELECT doc_id, {P_SQL} AS p_rnd FROM documents WHERE {P_SQL} BETWEEN 0.2 AND 0.9 AND NOT (({_W(_TITLE, POS)} OR {_W("lower(text)", POS_TEXT)}) AND NOT {_W(_TITLE, NEG)}) ORDER BY p_rnd DESC, doc_id LIMIT 50")
def uncertain_dropped(spark, sf):
    rows = labels.weak_labels(_docs(spark, sf), F.col("title"), F.col("body"), POS, POS_TEXT, NEG).filter("label_weak = 0").select("doc_id", "p_rnd")
    return labels.uncertain_dropped(rows, 50, 0.2, 0.9, row_id="doc_id")


@query(f"SELECT doc_id FROM documents WHERE length(text) >= 200 AND ({P_SQL} >= 0.5 OR doc_id % 7 = 1) AND contains(lower(source), 'src1')")
def topic_filter(spark, sf):
    rows = labels.domain_filter(table(spark, sf, "documents"), "source", "src1")
    return rows.filter(labels.topic_filter(F.col("text"), p_of(), (F.col("doc_id") % 7).cast("int"), use_label=True)).select("doc_id")


_L = f"(SELECT doc_id, quality AS given, {P_SQL} AS p FROM labels)"
_T = f"(SELECT avg(CASE WHEN given = 0 THEN 1 - p END) AS t0, avg(CASE WHEN given = 1 THEN p END) AS t1 FROM {_L})"


def _labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("given"), p_of().alias("p"))


@query(f"SELECT t0, t1 FROM {_T}")
def class_thresholds(spark, sf):
    return issues.thresholds(_labels(spark, sf), "given", "p")


@query(f"""SELECT given, guess, count(*) AS n FROM (SELECT given, CASE WHEN p >= t1 AND 1 - p >= t0 THEN CAST(p >= 1 - p AS INTEGER) WHEN p >= t1 THEN 1 WHEN 1 - p >= t0 THEN 0 END AS guess FROM {_L}, {_T}) WHERE guess IS NOT NULL GROUP BY given, guess""")
def confident_joint(spark, sf):
    return issues.confident_joint(_labels(spark, sf), "given", "p")


_RANKED = f"""SELECT doc_id, given, p, self_confidence, row_number() OVER (ORDER BY self_confidence, doc_id) AS issue_rank FROM (
  SELECT *, CASE WHEN given = 1 THEN p ELSE 1 - p END AS self_confidence FROM {_L}, {_T})
WHERE CASE WHEN given = 1 THEN 1 - p >= t0 ELSE p >= t1 END AND self_confidence < 0.5"""


@query(_RANKED)
def label_issue_rank(spark, sf):
    return issues.ranked_issues(_labels(spark, sf), "given", "p", "doc_id")


@query(f"""SELECT doc_id, given, p, 1 - p AS self_confidence FROM {_L} WHERE given = 0 AND p BETWEEN 0.2 AND 0.9 ORDER BY self_confidence, doc_id LIMIT 20""")
def uncertain_rows(spark, sf):
    return issues.uncertain(_labels(spark, sf), "given", "p", "doc_id", 20, 0.2, 0.9)


@query(f"""SELECT l.doc_id, l.given, l.p, coalesce(issue_rank <= (SELECT floor(count(*) * 0.2) FROM labels) AND l.given = 0 AND l.p >= 0.4, false) AS likely_fn
FROM {_L} l LEFT JOIN ({_RANKED}) r USING (doc_id)""")
def false_negative_mask(spark, sf):
    return issues.false_negative_mask(_labels(spark, sf), "given", "p", "doc_id")


@query()
def classifier_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    fitted = model.train(rows, "text", "quality", "doc_id", mode="precise", iterations=1000)
    return fitted.score(docs, "text").select("doc_id", F.round("p_rnd", 6).alias("p_rnd"))


