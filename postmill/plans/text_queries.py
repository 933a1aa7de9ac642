"""Queries of text, fields and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, fixed, text
from ..operators import dedupe
from ..sources.io import union_by_name
from .base import CLEAN, NORM, TOKENS, in_sql, query, table
from .session import ship


@query(f"SELECT doc_id, md5({CLEAN.format(c='text')}) AS cleaned_md5, {TOKENS.format(c=CLEAN.format(c='text'))} AS n_tokens FROM documents")
def clean_text(spark, sf):
    c = text.clean(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", c.alias("c")).select("doc_id", F.md5("c").alias("cleaned_md5"), text.token_count(F.col("c")).alias("n_tokens"))


@query(f"SELECT page_id, md5({CLEAN.format(c='html')}) AS cleaned_md5, length({CLEAN.format(c='html')}) AS n_chars FROM pages")
def url_tag_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean(F.col("html")).alias("c")).select("page_id", F.md5("c").alias("cleaned_md5"), F.length("c").alias("n_chars"))


@query(f"SELECT lang, count(*) AS n, sum({TOKENS.format(c='text')}) AS n_tokens FROM documents WHERE {TOKENS.format(c='text')} >= 15 GROUP BY lang")
def token_count_filter(spark, sf):
    rows = table(spark, sf, "documents").select("lang", text.token_count(F.col("text")).alias("t")).filter("t >= 15")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("n_tokens"))


@query(f"SELECT min(doc_id) AS doc_id, md5({CLEAN.format(c='text')}) AS cleaned_md5 FROM documents GROUP BY 2")
def dedupe_exact_first(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.md5(text.clean(F.col("text"))).alias("cleaned_md5"))
    return dedupe.first_by(rows, F.col("cleaned_md5"), F.col("doc_id"))


@query(f"""
WITH a AS (SELECT doc_id, lang, text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id // 2 END AS url FROM documents),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1)
SELECT doc_id, lang, url FROM b
QUALIFY row_number() OVER (PARTITION BY concat_ws('|', lower(lang), {CLEAN.format(c='substr(text, 1, 20)')}, md5(text)) ORDER BY doc_id) = 1""")
def dedupe_two_phase(spark, sf):
    url = F.when(F.col("doc_id") % 3 != 0, F.floor(F.col("doc_id") / 2))
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text", url.alias("url"))
    return dedupe.dedupe_two_phase(rows, "doc_id", "url", F.col("lang"), F.substring("text", 1, 20), F.col("text")).select("doc_id", "lang", "url")


@query(f"""
WITH a AS (SELECT doc_id, lang, text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id // 2 END AS url FROM documents),
b AS (SELECT * FROM a QUALIFY url IS NULL OR row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1)
SELECT doc_id, lang, url FROM b
QUALIFY row_number() OVER (PARTITION BY concat_ws('|', lower(lang), {CLEAN.format(c='substr(text, 1, 20)')}, md5(text)) ORDER BY doc_id) = 1""")
def dedupe_two_phase_keep_nulls(spark, sf):
    url = F.when(F.col("doc_id") % 3 != 0, F.floor(F.col("doc_id") / 2))
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text", url.alias("url"))
    return dedupe.dedupe_two_phase(rows, "doc_id", "url", F.col("lang"), F.substring("text", 1, 20), F.col("text"), null_policy="keep").select("doc_id", "lang", "url")


@query(f"SELECT p_partkey || '|' || {NORM.format(c='p_name')} AS uid, CAST(p_partkey AS VARCHAR) AS base FROM part")
def uid_roundtrip(spark, sf):
    return table(spark, sf, "part").select(text.make_uid(F.col("p_partkey"), text.norm(F.col("p_name"))).alias("uid")).select("uid", text.uid_base(F.col("uid")).alias("base"))


@query("""SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def union_bag(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return union_by_name([a, b])


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || ' ...' ELSE text END AS snippet FROM documents")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), 40).alias("snippet"))


@query(f"SELECT p_partkey, substr(sha1(concat_ws('|', {NORM.format(c='p_name')}, {NORM.format(c='p_brand')}, {NORM.format(c='p_type')})), 1, 16) AS canonical FROM part")
def canonical_keys(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.canonical_key(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("canonical"))


@query("""SELECT doc_id, md5(concat_ws('  ', CASE WHEN trim(coalesce(lang, '')) <> '' THEN 'TITLE: ' || trim(lang) END,
  CASE WHEN doc_id % 4 <> 0 AND trim(source) <> '' THEN 'DOMAIN: ' || trim(source) END, CASE WHEN trim(text) <> '' THEN 'DESCRIPTION: ' || trim(text) END)) AS combo_md5 FROM documents""")
def topic_text_combo(spark, sf):
    domain = F.when(F.col("doc_id") % 4 != 0, F.col("source"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.topic_text("combo", F.col("text"), title=F.col("lang"), domain=domain, description=F.col("text"))).alias("combo_md5"))


@query(r"SELECT p_partkey, trim(regexp_replace(replace(replace(lower(trim(coalesce(p_type, ''))), '.', ''), '-', ' '), '\s+', ' ', 'g')) AS title_normalized FROM part")
def fuzzy_title_normalize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.fuzzy_norm(F.col("p_type")).alias("title_normalized"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')[1:12], ' ') AS first_words FROM documents")
def first_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_words(F.col("text"), 12).alias("first_words"))


@query("SELECT doc_id, md5(coalesce(lang, '') || ' ' || coalesce(text, '')) AS model_text_md5 FROM documents")
def model_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.model_text(F.col("lang"), F.col("text"))).alias("model_text_md5"))


LOCATIONS = ["", "nan", ",", "-", "Remote", "Remote, USA", "Remote - CA", "Remote, Boston", "Canada", "tx", "Boston", "Boston, MA", "London, UK", "Paris, France", "Austin, TX, USA", "Austin, TX, 78701", "Winston-Salem, NC", "Hybrid, Boston, MA", "Lyon, Rhone, France"]
_STATES = in_sql(fixed.STATES)
_COUNTRY = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.COUNTRIES.items()) + " END"


@query(rf"""
WITH given AS (
  SELECT row_number() OVER () AS id, l FROM (SELECT unnest([{in_sql(LOCATIONS)}, NULL]) AS l)
  UNION ALL SELECT 1000 + n_nationkey, n_name || ', ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT id, l, trim(l) AS raw, lower(trim(l)) AS low, regexp_matches(lower(trim(l)), '\b(remote|work\s*from\s*home|wfh|hybrid)\b') AS rem,
  trim(regexp_replace(regexp_replace(trim(l), '\s*[-/|]\s*', ', ', 'g'), '\s+', ' ', 'g')) AS plain FROM given),
b AS (SELECT *, trim(regexp_replace(plain, '(?i)\bremote\b[:, ]*', '', 'g'), ' ,') AS tail,
  list_filter(list_transform(string_split(plain, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM a),
c AS (SELECT *, {_COUNTRY.format(c="lower(tail)")} AS tail_country,
  CASE WHEN length(tail) <= 4 THEN nullif(regexp_extract(tail, '\b({"|".join(fixed.STATES)})\b', 1), '') END AS tail_state,
  len(parts) AS n, parts[1] AS one, parts[2] AS two, parts[-1] AS last FROM b),
d AS (SELECT *, CASE
  WHEN l IS NULL THEN 'missing' WHEN raw = '' OR low IN ('nan', 'none', 'null') THEN 'empty'
  WHEN rem AND contains(low, 'remote') THEN CASE WHEN tail_country IS NOT NULL OR tail_state IS NOT NULL THEN 'remote_with_region' ELSE 'remote_only' END
  WHEN n = 0 THEN 'empty'
  WHEN n = 1 THEN CASE WHEN {_COUNTRY.format(c="lower(one)")} IS NOT NULL THEN 'country_only' WHEN upper(one) IN ({_STATES}) THEN 'state_only' ELSE 'single_token_ambiguous' END
  WHEN n = 2 THEN CASE WHEN upper(two) IN ({_STATES}) THEN 'city_state' WHEN {_COUNTRY.format(c="lower(two)")} IS NOT NULL THEN 'city_country' ELSE 'city_region_ambiguous' END
  WHEN {_COUNTRY.format(c="lower(last)")} IS NOT NULL THEN 'city_state_country' WHEN upper(two) IN ({_STATES}) THEN 'city_state_assumed_us'
  ELSE 'multi_part_unverified' END AS quality FROM c)
SELECT id, l AS location,
  CASE WHEN quality IN ('city_state', 'city_country', 'city_region_ambiguous', 'city_state_country', 'city_state_assumed_us', 'multi_part_unverified') THEN one END AS city,
  CASE quality WHEN 'remote_with_region' THEN CASE WHEN tail_country IS NULL THEN tail_state END WHEN 'state_only' THEN upper(one) WHEN 'single_token_ambiguous' THEN one
    WHEN 'city_state' THEN upper(two) WHEN 'city_state_assumed_us' THEN upper(two) WHEN 'city_region_ambiguous' THEN two WHEN 'city_state_country' THEN two WHEN 'multi_part_unverified' THEN two END AS state,
  CASE quality WHEN 'remote_with_region' THEN coalesce(tail_country, 'United States') WHEN 'country_only' THEN {_COUNTRY.format(c="lower(one)")} WHEN 'state_only' THEN 'United States'
    WHEN 'city_state' THEN 'United States' WHEN 'city_state_assumed_us' THEN 'United States' WHEN 'city_country' THEN {_COUNTRY.format(c="lower(two)")}
    WHEN 'city_state_country' THEN {_COUNTRY.format(c="lower(last)")} WHEN 'multi_part_unverified' THEN last END AS country,
  CASE WHEN quality IN ('missing', 'empty') THEN false ELSE rem END AS is_remote, quality FROM d""")
def parse_location(spark, sf):
    given = spark.createDataFrame([(i + 1, x) for i, x in enumerate([*LOCATIONS, None])], "id long, location string")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.concat("n_name", F.lit(", "), "r_name").alias("location"))
    return given.unionByName(named).select("id", "location", fields.parse_location(F.col("location")).alias("loc")).select("id", "location", "loc.*")


@query(rf"""SELECT c_custkey, nullif(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim(n)), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
  lambda x: x NOT IN ({in_sql(fixed.COMPANY_SUFFIXES)})), ' '), '') AS company_normalized
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ', Inc.' WHEN 1 THEN 'Co' WHEN 2 THEN c_mktsegment || ' GmbH & Co' ELSE NULL END AS n FROM customer)""")
def company_normalize(spark, sf):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat("c_name", F.lit(", Inc."))).when(k == 1, "Co").when(k == 2, F.concat("c_mktsegment", F.lit(" GmbH & Co")))
    return table(spark, sf, "customer").select("c_custkey", fields.normalize_company(name).alias("company_normalized"))


@query("""SELECT site, n, CASE lower(trim(site)) WHEN 'src0' THEN 'Main Source' WHEN 'src1' THEN 'Second' ELSE upper(substr(site, 1, 1)) || lower(substr(site, 2)) END AS canonical
FROM (SELECT source AS site, count(*) AS n FROM documents GROUP BY source)""")
def site_canonical(spark, sf):
    rows = table(spark, sf, "documents").groupBy(F.col("source").alias("site")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("canonical", fields.canonical_site(F.col("site"), {"src0": "Main Source", "src1": "Second"}))


_RULES = [("Steel", "steel|tin"), ("Small", "small|economy"), ("Brass", "brass")]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_type, '(?i){r}') THEN '{n}'" for n, r in _RULES) + " ELSE 'Other' END AS title_family FROM part")
def title_family(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fields.title_family(F.col("p_type"), _RULES).alias("title_family"))


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS lo, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal + 100 END AS hi FROM customer)
SELECT c_custkey, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo + hi) / 2 ELSE coalesce(lo, hi) END AS salary_midpoint, lo IS NOT NULL OR hi IS NOT NULL AS has_salary FROM a""")
def salary_midpoint(spark, sf):
    low, high = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") + 100)
    middle = fields.salary_midpoint(low, high)
    return table(spark, sf, "customer").select("c_custkey", middle.alias("salary_midpoint"), middle.isNotNull().alias("has_salary"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS date_posted_year, strftime(o_orderdate, '%Y-%m') AS date_posted_month, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') AS posting_age_days FROM orders")
def date_parts_age(spark, sf):
    parts = fields.date_parts(F.col("o_orderdate"), "1998-12-01")
    return table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query("""WITH g AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(40000 + o_orderkey % 9000 AS VARCHAR) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'abc' WHEN 3 THEN '19999' END AS s FROM orders)
SELECT o_orderkey, CAST(CASE WHEN try_cast(s AS DOUBLE) IS NOT NULL THEN CASE WHEN CAST(s AS DOUBLE) BETWEEN 20000 AND 80000 THEN DATE '1899-12-30' + CAST(s AS INTEGER) END ELSE try_cast(s AS DATE) END AS DATE) AS parsed FROM g""")
def robust_date_parse(spark, sf):
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, (F.lit(40000) + F.col("o_orderkey") % 9000).cast("string")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, "abc").when(k == 3, "19999")
    return table(spark, sf, "orders").select("o_orderkey", fields.robust_date(s).cast("date").alias("parsed"))


@query()
def fuzzy_titles(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    return dedupe.fuzzy_titles(rows, "p_name", "p_partkey", 90).select("p_partkey", "title_normalized", "title_canonical", "title_fuzzy_score", "title_cluster_id", "title_cluster_size")


@query()
def fuzzy_titles_collapsed(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    return dedupe.collapse_titles(dedupe.fuzzy_titles(rows, "p_name", "p_partkey", 80, "token_set_ratio"), "p_partkey").select("p_partkey", "title_canonical", "title_cluster_size", "title_collapsed")


@query()
def unescape_pages(spark, sf):
    ship(spark)
    return table(spark, sf, "pages").select("page_id", F.md5(text.unescape(F.col("html"))).alias("unescaped_md5"))
