"""Queries of skill phrases and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import norm
from ..operators import skills, topics
from .base import NORM, P_SQL, in_sql, p_of, query, table

STOP = [*fixed.STOP_WORDS, "de", "der", "die", "la", "le", "que", "el", "und", "et"]
_STOP = in_sql(STOP)
# the terms are ASCII words, for engines whose word boundaries differ
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')"
_TERMS = rf"""(WITH w AS (SELECT doc_id, list_filter(regexp_extract_all({NORM.format(c=_ASCII)}, '\b[A-Za-z][A-Za-z0-9+\-.#]+\b'), lambda x: x NOT IN ({_STOP})) AS w FROM documents)
  SELECT doc_id, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))) AS term FROM w)"""
_TF = f"SELECT doc_id, term, count(*) AS tf FROM {_TERMS} t GROUP BY ALL"


def _ascii(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text"))


@query(f"""
WITH tf AS ({_TF}), v AS (SELECT term, sum(tf) AS total, count(*) AS n_rows FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 200000),
x AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + n_rows)) + 1) AS raw FROM tf JOIN v USING (term)),
n AS (SELECT doc_id, sqrt(sum(raw * raw)) AS length FROM x GROUP BY doc_id)
SELECT doc_id, rank, term, round(raw / length, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 9) DESC, term) AS rank FROM x) JOIN n USING (doc_id) WHERE rank <= 15""")
def tfidf_top_terms(spark, sf):
    return skills.tfidf_top(_ascii(spark, sf), "doc_id", "text", 15, stop_words=STOP).withColumn("weight", F.round("weight", 6))


@query(rf"""
WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array({NORM.format(c="text")}, '[^A-Za-z0-9+\-.#]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM a),
c AS (SELECT *, sum(CAST(word IN ({_STOP}) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b),
d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS length FROM c WHERE word NOT IN ({_STOP})),
e AS (SELECT *, sum(length) OVER (PARTITION BY doc_id, word)::DOUBLE / count(*) OVER (PARTITION BY doc_id, word) AS ws FROM d),
f AS (SELECT doc_id, island, string_agg(word, ' ' ORDER BY pos) AS phrase, round(sum(ws), 9) AS score, min(pos) AS pos FROM e GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS place FROM f WHERE length(phrase) >= 3),
h AS (SELECT doc_id, phrase, min(place) AS place, max(score) AS score FROM g WHERE place <= 15 GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS INTEGER) AS rank, md5(phrase) AS phrase_md5, round(score, 6) AS score FROM h""")
def rake_phrases(spark, sf):
    found = skills.rake(table(spark, sf, "documents"), "doc_id", "text", STOP)
    return found.select("doc_id", "rank", F.md5("phrase").alias("phrase_md5"), F.round("score", 6).alias("score"))


_SKILLS = ["license", "Apache License", "rights reserved", "idiot", "the of", "MS Excel", "sql"]


def _grounded_sql(phrase: str) -> str:
    """Any variant stands whole, or word by word, in a text of which only ASCII letters and digits bound words."""
    p = phrase.lower()
    out = {p}
    for canon, values in fixed.SKILL_ALIASES.items():
        if p in {canon, *values}:
            out |= {canon, *values}
    whole = [rf"regexp_matches(t, '(^|[^A-Za-z0-9]){v.replace('-', chr(92) + '-')}([^A-Za-z0-9]|$)')" for v in sorted(out)]
    ordered = [r"regexp_matches(t, '(?s)(^|[^A-Za-z0-9])" + r"(?:[^A-Za-z0-9]|[^A-Za-z0-9].*?[^A-Za-z0-9]|[^A-Za-z0-9].*?)".join(v.split()) + r"([^A-Za-z0-9]|$)')" for v in sorted(out) if " " in v]
    return "(" + " OR ".join(whole + ordered) + ")"


@query(f"SELECT doc_id, {', '.join(f'{_grounded_sql(s)} AS s{i}' for i, s in enumerate(_SKILLS))} FROM (SELECT doc_id, {NORM.format(c='text')} AS t FROM documents)")
def ground_phrases(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", norm(F.col("text")).alias("t"))
    return rows.select("doc_id", *[skills.grounded_literal(F.col("t"), s).alias(f"s{i}") for i, s in enumerate(_SKILLS)])


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(a) <> '' THEN trim(a) END, CASE WHEN trim(b) <> '' AND lower(trim(b)) <> lower(trim(a)) THEN trim(b) END], lambda x: x IS NOT NULL), '|') AS items
FROM (SELECT doc_id, ' ' || lang AS a, CASE doc_id % 3 WHEN 0 THEN upper(lang) WHEN 1 THEN ' ' ELSE source END AS b FROM documents)""")
def ordered_dedupe(spark, sf):
    b = F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).when(F.col("doc_id") % 3 == 1, " ").otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(skills.ordered_distinct(F.array(F.concat(F.lit(" "), "lang"), b)), "|").alias("items"))


def _combined(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", F.array(F.lit("license"), F.lit("idiot")).alias("a"), F.array(F.lit("License"), F.lit("rights reserved"), F.lit("excel")).alias("b"))
    return skills.combine(rows, "text", ["a", "b"])


_G = f"""(SELECT doc_id, {_grounded_sql('license')}::INTEGER + {_grounded_sql('idiot')}::INTEGER + {_grounded_sql('rights reserved')}::INTEGER + {_grounded_sql('excel')}::INTEGER AS g FROM (SELECT doc_id, {NORM.format(c='text')} AS t FROM documents))"""


@query(f"SELECT count(*) AS n_rows, avg(g) AS avg_grounded_skills, avg(4 - g) AS avg_ungrounded_candidates, 100.0::DOUBLE * count_if(g > 0) / count(*) AS pct_rows_with_any_grounded_skills, 0 AS n_rows_flagged_excel_like, 0.0::DOUBLE AS pct_rows_flagged_excel_like FROM {_G} x")
def skill_metrics(spark, sf):
    return skills.skill_metrics(_combined(spark, sf))


_EXCEL = f"(SELECT {_grounded_sql('excellent')} AS g, {_grounded_sql('excel')} AS e FROM (SELECT {NORM.format(c='text')} || CASE doc_id % 3 WHEN 0 THEN ' excellent' WHEN 1 THEN ' excellent excel' ELSE '' END AS t FROM documents))"


@query(f"SELECT count(*) AS n_rows, count_if(g) AS n_grounded, count_if(g AND NOT e) AS n_flagged, 100.0::DOUBLE * count_if(g AND NOT e) / count(*) AS pct_flagged FROM {_EXCEL} x")
def skill_excel_flag(spark, sf):
    """A grounded phrase that only holds the letters of excel, in texts with and without the word."""
    k = F.col("doc_id") % 3
    rows = table(spark, sf, "documents").select(F.concat("text", F.when(k == 0, " excellent").when(k == 1, " excellent excel").otherwise("")).alias("text"), F.array(F.lit("Excellent")).alias("a"))
    found = skills.combine(rows, "text", ["a"])
    m = skills.skill_metrics(found)
    return m.select("n_rows", F.round(F.col("avg_grounded_skills") * F.col("n_rows")).cast("long").alias("n_grounded"), F.col("n_rows_flagged_excel_like").alias("n_flagged"), F.col("pct_rows_flagged_excel_like").alias("pct_flagged"))


@query(f"SELECT doc_id, g AS n_grounded, 4 - g AS n_ungrounded FROM {_G} x")
def combined_skills(spark, sf):
    return _combined(spark, sf).select("doc_id", F.size("skills_grounded").alias("n_grounded"), F.size("skills_ungrounded").alias("n_ungrounded"))


# topics: a vector's label is the topic of the document with the vector's number
_J = f"(SELECT doc_id, text, source, label - 1 AS topic_id, {P_SQL} AS p FROM documents JOIN embeddings ON doc_id = vec_id)"
_COUNTS = rf"(SELECT topic_id, word, count(*) AS n FROM (SELECT topic_id, unnest(list_filter(regexp_extract_all({NORM.format(c='text')}, '[a-z0-9]{{2,}}'), lambda x: x NOT IN ({_STOP}))) AS word FROM {_J} j) GROUP BY ALL)"
_WEIGHTS = f"""(WITH c AS (SELECT * FROM {_COUNTS} q), k AS (SELECT topic_id, sum(n) AS class_n FROM c GROUP BY topic_id), w AS (SELECT word, sum(n) AS word_n FROM c GROUP BY word)
  SELECT topic_id, word, sqrt(n::DOUBLE / class_n) * ln(1 + (SELECT floor(avg(class_n)) FROM k) / word_n::DOUBLE) AS weight FROM c JOIN k USING (topic_id) JOIN w USING (word))"""
_TABLE = f"""(SELECT topic_id, top_words, n_docs FROM (SELECT topic_id, count(*) AS n_docs FROM {_J} j WHERE topic_id <> -1 GROUP BY topic_id)
  LEFT JOIN (SELECT topic_id, string_agg(word, ', ' ORDER BY place) AS top_words FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, word) AS place FROM {_WEIGHTS} w) WHERE place <= 10 GROUP BY topic_id) USING (topic_id))"""


def _topic_rows(spark, sf):
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings").select("vec_id", (F.col("label") - 1).alias("topic_id"))
    return docs.join(vectors, docs["doc_id"] == vectors["vec_id"]).select("doc_id", "text", "source", "topic_id", p_of().alias("p"))


def _weights(spark, sf):
    return topics.class_tfidf(topics.class_words(_topic_rows(spark, sf), "topic_id", "text", STOP))


def _topics(spark, sf):
    return topics.topics_table(_topic_rows(spark, sf), "topic_id", _weights(spark, sf))


@query(f"SELECT topic_id, word, round(weight, 6) AS weight FROM {_WEIGHTS} w")
def ctfidf_words(spark, sf):
    return _weights(spark, sf).withColumn("weight", F.round("weight", 6))


@query(f"SELECT * FROM {_TABLE} t")
def topics_table(spark, sf):
    return _topics(spark, sf)


@query(f"SELECT doc_id, topic_id, CASE WHEN topic_id < 5 THEN 'Topic ' || topic_id END AS topic_label FROM {_J} j")
def topic_label_join(spark, sf):
    labels = spark.range(-1, 5).select(F.col("id").cast("int").alias("topic_id"), F.concat(F.lit("Topic "), F.col("id").cast("string")).alias("topic_label"))
    return topics.with_labels(_topic_rows(spark, sf).select("doc_id", "topic_id"), labels)


@query(f"SELECT topic_id, doc_id, place FROM (SELECT topic_id, doc_id, row_number() OVER (PARTITION BY topic_id ORDER BY doc_id) AS place FROM {_J} j) WHERE place <= 5")
def topic_examples_topk(spark, sf):
    return topics.topic_examples(_topic_rows(spark, sf), "topic_id", "doc_id").select("topic_id", "doc_id", "place")


@query(f"SELECT CAST(least(floor(p * 30) + 1, 30) AS INTEGER) AS bin, count(*) AS n FROM (SELECT (doc_id * 7919 % 1024) / 1024.0::DOUBLE AS p FROM documents) GROUP BY 1")
def topic_prob_hist(spark, sf):
    return topics.histogram(table(spark, sf, "documents").select((F.col("doc_id") * 7919 % 1024 / F.lit(1024.0)).alias("p")), "p")


@query(f"SELECT topic_id, count(*) AS n_jobs FROM {_J} j GROUP BY topic_id")
def topic_sizes(spark, sf):
    return topics.topic_sizes(_topic_rows(spark, sf), "topic_id")


@query(f"SELECT topic_id, avg(p) AS mean_p FROM (SELECT topic_id, CASE WHEN doc_id % 5 <> 0 THEN p END AS p FROM {_J} j) WHERE p IS NOT NULL GROUP BY topic_id")
def topic_means(spark, sf):
    return topics.topic_means(_topic_rows(spark, sf).withColumn("p", F.when(F.col("doc_id") % 5 != 0, F.col("p"))), "topic_id", "p")


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents WHERE md5(coalesce(text, '')) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src1' AND text IS NOT NULL)")
def embedding_cache_anti(spark, sf):
    docs = table(spark, sf, "documents")
    cache = docs.filter("source = 'src1' AND text IS NOT NULL").select(F.md5("text").alias("md5"))
    return topics.missing_embeddings(docs, "text", cache).select("doc_id", "md5")


@query(f"SELECT (SELECT count(*) FROM documents) AS n_before_all_filters, (SELECT count(*) FROM documents WHERE length(text) >= 200) AS n_after_len_core_filter, (SELECT least(100, count(*)) FROM documents WHERE length(text) >= 200) AS n_after_sampling, (SELECT count(DISTINCT topic_id) FROM {_J} j WHERE topic_id <> -1) AS n_topics, 'precise' AS mode")
def run_metadata(spark, sf):
    docs = table(spark, sf, "documents")
    filtered = docs.filter(F.length("text") >= 200)
    found = _topic_rows(spark, sf).filter("topic_id <> -1").select("topic_id").distinct()
    return topics.run_metadata(docs, filtered, topics.subsample(filtered, "doc_id", 100), found, mode="precise")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def topic_subsample(spark, sf):
    return topics.subsample(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


@query(f"SELECT topic_id, trim(string_split(top_words, ',')[1]) AS topic_label, 'Topic ' || topic_id || ': ' || top_words AS topic_label_long, 0.1::DOUBLE AS topic_label_confidence FROM {_TABLE} t")
def fallback_labels(spark, sf):
    return _topics(spark, sf).select("topic_id", *[c.alias(n) for n, c in topics.fallback_label(F.col("topic_id"), F.col("top_words")).items()])


_EXAMPLES = f"""(SELECT topic_id, list(CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || ' ...' ELSE text END ORDER BY place) AS examples
  FROM (SELECT topic_id, text, row_number() OVER (PARTITION BY topic_id ORDER BY doc_id) AS place FROM {_J} j) WHERE place <= 5 GROUP BY topic_id)"""


@query(f"SELECT topic_id, md5(top_words || chr(10) || coalesce(array_to_string(examples, chr(10)), '')) AS payload_md5, coalesce(len(examples), 0) AS n_examples FROM {_TABLE} t LEFT JOIN {_EXAMPLES} e USING (topic_id)")
def prompt_payload_parts(spark, sf):
    """The payloads' JSON taken apart again, as engines escape strings differently."""
    parts = F.from_json("payload", "topic_id int, top_words string, examples array<string>").alias("p")
    rows = topics.prompt_payloads(_topics(spark, sf), _topic_rows(spark, sf), "doc_id", "text").select("topic_id", parts)
    return rows.select("topic_id", F.md5(F.concat_ws("\n", "p.top_words", F.array_join("p.examples", "\n"))).alias("payload_md5"), F.size("p.examples").alias("n_examples"))


@query()
def prompt_payloads(spark, sf):
    return topics.prompt_payloads(_topics(spark, sf), _topic_rows(spark, sf), "doc_id", "text")


@query(f"SELECT topic_id, top_words, n_docs, trim(string_split(top_words, ',')[1]) AS topic_label, 'Topic ' || topic_id || ': ' || top_words AS topic_label_long, 0.1::DOUBLE AS topic_label_confidence FROM {_TABLE} t")
def labeled_topics(spark, sf):
    found = _topics(spark, sf)
    return topics.low_confidence(topics.label_topics(found, topics.prompt_payloads(found, _topic_rows(spark, sf), "doc_id", "text"), None))


@query()
def topic_fit(spark, sf):
    return topics.fit_topics(table(spark, sf, "embeddings"), "embedding", 10).select("vec_id", "topic_id", F.round("topic_prob", 6).alias("topic_prob"))
