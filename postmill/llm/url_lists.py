"""URL filters by a temporal list join, in DataFrame functions alone.

List entries are dated: a pattern is added to a list or removed from it on a day. They become validity intervals, cut at
the turn of months. A capture's patterns (its host, the host's parent domains, its host with the first path segment)
join intervals of the same pattern and month, and the interval that holds the fetch day is the as-of match; the longest
active pattern decides, an allowing list before a blocking one. The month in the key keeps a hot pattern's intervals and
captures apart; what is hot within a month is one side of an inner or left join, which adaptive execution splits.

Cases: a null or hostless URL, or one without a fetch day, matches nothing and passes; the entries' repeated rows count once;
entries with a null list, pattern, event or day are void; an entry that is added and removed on one day isn't active
from that day; repeated captures each give a row; empty tables work on either side; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^/?#]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def patterns_of(url: Column) -> Column:
    """The host, its parent domains of two labels or more, and the host with the first path segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(url, SEGMENT, 1)
    with_path = F.when(segment != "", F.array(F.concat(host, segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains, with_path))


def validity(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, valid_from, valid_to): half-open intervals, the last one open (null)."""
    dated = entries.select("list_name", "pattern", "event", "on_day").dropna().groupBy("list_name", "pattern", "on_day")
    # of one day's events removal counts; no more rows of a pattern than days
    daily = dated.agg(F.max(F.col("event") == "remove").alias("removed"))
    order = Window.partitionBy("list_name", "pattern").orderBy("on_day")
    return daily.withColumn("valid_to", F.lead("on_day").over(order)).filter("not removed").select("list_name", "pattern", F.col("on_day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, allowing: tuple[str, ...] = ("allow",)) -> DataFrame:
    """Each capture (page_id, url, fetched_on) against the entries active then: n_active, action, pattern, list_name."""
    days = captures.agg(F.max("fetched_on").alias("last")).collect()[0]["last"]
    rows = captures.groupBy("page_id", "url", "fetched_on").agg(F.count(F.lit(1)).alias("copies"))
    intervals = validity(entries)
    ends = F.least(F.coalesce(F.col("valid_to"), F.lit(days)), F.lit(days))
    months = F.when(ends >= F.col("valid_from"), F.sequence(F.trunc("valid_from", "month"), F.trunc(ends, "month"), F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    monthly = intervals.select(F.col("pattern").alias("of_pattern"), "list_name", "valid_from", "valid_to", F.explode(months).alias("of_month"))
    asked = rows.withColumn("pattern", F.explode_outer(patterns_of(F.col("url")))).withColumn("month", F.trunc("fetched_on", "month"))
    active = (
        (F.col("pattern") == F.col("of_pattern"))
        & (F.col("month") == F.col("of_month"))
        & (F.col("fetched_on") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    )
    matched = asked.join(monthly, active, "left")
    allows = F.col("list_name").isin(*allowing)
    rank = F.when(F.col("list_name").isNotNull(), F.struct(F.length("of_pattern").alias("n"), allows.alias("allows"), F.col("of_pattern").alias("pattern"), F.col("list_name").alias("list_name")))
    best = matched.groupBy("page_id", "url", "fetched_on", "copies").agg(F.count("list_name").alias("n_active"), F.max(rank).alias("best"))
    action = F.when(F.col("best").isNull(), "pass").when(F.col("best.allows"), "allow").otherwise("block")
    shown = best.select("page_id", "url", "fetched_on", "n_active", action.alias("action"), F.col("best.pattern").alias("pattern"), F.col("best.list_name").alias("list_name"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return shown.drop("copy")


def fetched(pages: DataFrame) -> DataFrame:
    """Pages have no fetch day: a rule on their ids gives one of 2024's."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched_on"))


def example_entries(pages: DataFrame) -> DataFrame:
    """Dated entries by a rule on the hosts' hashes: added, removed and added again, on three lists."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", SEGMENT, 1).alias("segment")).filter("host <> ''").distinct()
    start = F.lit("2024-01-01").cast("date")

    def listed(rows: DataFrame, name: str, pattern: Column, digits: str) -> DataFrame:
        rows = rows.select(pattern.alias("pattern")).distinct().withColumn("hash", F.md5(F.concat(F.lit(f"{name}:"), F.col("pattern"))))
        rows = rows.filter(F.substring("hash", 1, 1).isin(*digits))
        day = lambda k, step: F.ascii(F.substring("hash", k, 1)) * step
        events = F.array(
            F.struct(F.lit("add").alias("event"), F.date_add(start, day(2, 1)).alias("on_day")),
            F.struct(F.lit("remove").alias("event"), F.date_add(start, day(2, 1) + day(3, 1)).alias("on_day")),
            F.struct(F.lit("add").alias("event"), F.date_add(start, day(2, 1) + day(3, 1) + day(4, 1)).alias("on_day")),
        )
        return rows.select(F.lit(name).alias("list_name"), "pattern", F.explode(events).alias("e")).select("list_name", "pattern", "e.event", "e.on_day")

    blocked = listed(hosts, "block", F.col("host"), "0123")
    paths = listed(hosts.filter("segment <> ''"), "path-block", F.concat("host", "segment"), "01")
    allowed = listed(hosts, "allow", F.col("host"), "45")
    return blocked.unionByName(paths).unionByName(allowed)


def op5_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return evaluate(fetched(pages), example_entries(pages))


_LISTED = """
  SELECT '{name}' AS list_name, pattern, event, on_day FROM (
    SELECT pattern, md5('{name}:' || pattern) AS hash FROM (SELECT DISTINCT {pattern} AS pattern FROM hosts WHERE {filter})) h,
    LATERAL (SELECT 'add' AS event, DATE '2024-01-01' + CAST(ascii(substr(hash, 2, 1)) AS INTEGER) AS on_day
      UNION ALL SELECT 'remove', DATE '2024-01-01' + CAST(ascii(substr(hash, 2, 1)) + ascii(substr(hash, 3, 1)) AS INTEGER)
      UNION ALL SELECT 'add', DATE '2024-01-01' + CAST(ascii(substr(hash, 2, 1)) + ascii(substr(hash, 3, 1)) + ascii(substr(hash, 4, 1)) AS INTEGER)) e
  WHERE substr(hash, 1, 1) IN ({digits})"""
OP5_SQL = f"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched_on,
    lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_extract(url, '{SEGMENT}', 1) AS segment, row_number() OVER () AS rn
  FROM pages),
hosts AS (SELECT DISTINCT host, segment FROM p WHERE host <> ''),
events AS ({_LISTED.format(name="block", pattern="host", filter="true", digits="'0','1','2','3'")}
  UNION ALL {_LISTED.format(name="path-block", pattern="host || segment", filter="segment <> ''", digits="'0','1'")}
  UNION ALL {_LISTED.format(name="allow", pattern="host", filter="true", digits="'4','5'")}),
daily AS (SELECT list_name, pattern, on_day, bool_or(event = 'remove') AS removed FROM events GROUP BY ALL),
intervals AS (
  SELECT list_name, pattern, on_day AS valid_from, valid_to FROM (
    SELECT *, lead(on_day) OVER (PARTITION BY list_name, pattern ORDER BY on_day) AS valid_to FROM daily) WHERE NOT removed),
labels AS (SELECT *, string_split(host, '.') AS l FROM p WHERE host <> ''),
asked AS (
  SELECT rn, fetched_on, array_to_string(l[i:], '.') AS pattern FROM labels, LATERAL (SELECT unnest(range(1, greatest(len(l), 2))) AS i) s
  UNION ALL SELECT rn, fetched_on, host || segment FROM labels WHERE segment <> ''),
ranked AS (
  SELECT rn, list_name, pattern, count(*) OVER (PARTITION BY rn) AS n_active,
    row_number() OVER (PARTITION BY rn ORDER BY length(pattern) DESC, list_name = 'allow' DESC, pattern DESC, list_name DESC) AS place
  FROM asked JOIN intervals USING (pattern) WHERE fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to))
SELECT page_id, url, fetched_on, coalesce(n_active, 0) AS n_active,
  CASE WHEN list_name IS NULL THEN 'pass' WHEN list_name = 'allow' THEN 'allow' ELSE 'block' END AS action, pattern, list_name
FROM p LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (rn)
"""
