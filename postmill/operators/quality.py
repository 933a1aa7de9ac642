"""Data-quality metrics of tables before and after cleaning. A side's metrics share one pass over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import robust_date
from ..functions.text import canonical_key, norm, token_count, uid_base

KEY_ORDER = ["uid", "Posting ID", "id", "job_url"]


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole, 0 where there is nothing."""
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def completeness(df: DataFrame, cols: list[str], absent: str = "skip") -> DataFrame:
    """The mean share of non-null values; columns that aren't there are skipped or count as 0."""
    there = [c for c in cols if c in df.columns]
    n = len(cols) if absent == "zero" else len(there)
    total = sum((percent(F.count(c), F.count(F.lit(1))) for c in there), F.lit(0.0))
    return df.agg((total / n if n else F.lit(0.0)).alias("completeness"))


def completeness_by_column(df: DataFrame, cols: list[str]) -> DataFrame:
    row = df.agg(*[percent(F.count(c), F.count(F.lit(1))).alias(c) for c in cols])
    return row.unpivot([], cols, "column_name", "completeness")


def location_valid(c: Column, exact: bool = False) -> Column:
    low = F.lower(F.trim(c))
    found = low.contains("remote") | c.contains(",") | (token_count(c) >= 2)
    return F.coalesce((found | low.isin("remote", "hybrid")) if exact else found, F.lit(False))


def validity_checks(date: str | None = None, location: str | None = None, domain: str | None = None) -> dict[str, Column]:
    out = {}
    if date:
        out["date"] = robust_date(F.col(date)).isNotNull()
    if location:
        out["location"] = location_valid(F.col(location))
    if domain:
        out["domain"] = F.trim(F.coalesce(F.col(domain), F.lit(""))) != ""
    return out


def validity(df: DataFrame, checks: dict[str, Column | None]) -> DataFrame:
    """Valid cells over rows times checks; a check without its column (None) stays in the denominator."""
    good = sum((F.count_if(c) for c in checks.values() if c is not None), F.lit(0))
    return df.agg(percent(good, F.count(F.lit(1)) * len(checks)).alias("validity"))


def validity_mean(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The mean of the checks' own shares."""
    total = sum((percent(F.count_if(c), F.count(F.lit(1))) for c in checks.values()), F.lit(0.0))
    return df.agg((total / len(checks)).alias("validity"))


def allowed_domains(df: DataFrame, domain: str, configured: list[str] | None = None, n: int = 25) -> DataFrame:
    """The configured list, else the n commonest values."""
    if configured:
        return df.sparkSession.createDataFrame([(x,) for x in configured], f"{domain} string")
    return df.filter(F.col(domain).isNotNull()).groupBy(domain).count().orderBy(F.desc("count"), domain).limit(n).select(domain)


def uniqueness(df: DataFrame, key: str, null_counts: bool = False) -> DataFrame:
    """Distinct values over rows; null is a value on request; 0 without the column."""
    if key not in df.columns:
        return df.agg(F.lit(0.0).alias("uniqueness"))
    values = F.count_distinct(key) + (F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0)) if null_counts else 0)
    return df.agg(percent(values, F.count(F.lit(1))).alias("uniqueness"))


def consistency(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The mean share of rows that keep a rule; 0 without rules."""
    total = sum((percent(F.count_if(F.coalesce(c, F.lit(False))), F.count(F.lit(1))) for c in rules.values()), F.lit(0.0))
    return df.agg((total / len(rules) if rules else F.lit(0.0)).alias("consistency"))


def title_consistent(title: str, cleaned: str) -> Column:
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return blank(title) | ~blank(cleaned)


def timeliness(df: DataFrame, date: Column) -> DataFrame:
    """Parse rate, first and last date, and a flag."""
    d = F.col("_d")
    row = df.select(date.alias("_d")).agg(percent(F.count(d), F.count(F.lit(1))).alias("parse_rate"), F.min(d).alias("min_date"), F.max(d).alias("max_date"), F.count(d).alias("n"), F.min(F.year(d)).alias("y0"), F.max(F.year(d)).alias("y1"))
    flag = F.when(F.col("n") == 0, "all_unparseable").when((F.col("y0") == 1970) & (F.col("y1") == 1970), "suspicious_all_1970").otherwise("ok")
    return row.select("parse_rate", "min_date", "max_date", flag.alias("flag"))


def bad_rows(df: DataFrame, row_id: str, core: list[str], id_col: str | None = None, url: str | None = None, date: str | None = None, location: str | None = None, domain: str | None = None) -> DataFrame:
    """Adds ``bad``: a repeated id or URL, a blank core field, a bad date, a blank domain or a bad location."""
    there = set(df.columns)
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    rules = [blank(c) for c in core if c in there]
    order = F.col(row_id)
    if id_col in there:
        df = df.withColumn("_id_place", F.row_number().over(Window.partitionBy(id_col).orderBy(order)))
        rules.append(F.col("_id_place") > 1)
    if url in there:
        df = df.withColumn("_url_place", F.row_number().over(Window.partitionBy(url).orderBy(order)))
        rules.append((F.col("_url_place") > 1) & ~blank(url))
    if date in there:
        rules.append(robust_date(F.col(date)).isNull())
    if location in there:
        rules.append(~location_valid(F.col(location)))
    if domain in there:
        rules.append(blank(domain))
    bad = F.lit(False)
    for r in rules:
        bad = bad | F.coalesce(r, F.lit(False))
    return df.withColumn("bad", bad).drop("_id_place", "_url_place")


def precision_recall(flagged: DataFrame, after: DataFrame, id_col: str, uid: str | None = None) -> DataFrame:
    """Of rows flagged ``bad`` before: how many removed rows were bad, and how many bad rows were removed."""
    there = after.select((uid_base(F.col(uid)) if uid else F.col(id_col).cast("string")).alias("_id")).distinct().withColumn("_kept", F.lit(True))
    rows = flagged.withColumn("_id", F.col(id_col).cast("string")).join(there, "_id", "left")
    removed = F.col("_kept").isNull()
    one = rows.agg(F.count_if(removed).alias("removed"), F.count_if(F.col("bad")).alias("bad_rows"), F.count_if(removed & F.col("bad")).alias("both"))
    return one.select("removed", "bad_rows", "both", percent(F.col("both"), F.col("removed")).alias("precision"), percent(F.col("both"), F.col("bad_rows")).alias("recall"))


def issues_fixed(before: DataFrame, after: DataFrame, cols: list[str], key: str | None = None) -> DataFrame:
    """Nulls and duplicates that went, at least 0 for each column: one row for each."""

    def side(df: DataFrame, name: str) -> DataFrame:
        counts = [F.count_if(F.col(c).isNull()).alias(f"nulls:{c}") for c in cols]
        if key:
            counts.append((F.count(F.lit(1)) - F.count_distinct(key) - F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))).alias(f"duplicates:{key}"))
        row = df.agg(*counts)
        return row.unpivot([], row.columns, "issue", name)

    both = side(before, "before_n").join(side(after, "after_n"), "issue")
    return both.select("issue", "before_n", "after_n", F.greatest(F.lit(0), F.col("before_n") - F.col("after_n")).alias("fixed"))


def process_metrics(df: DataFrame, total: str, fixed: str, auto: str, seconds: str, rate_per_hour: float = 50.0) -> DataFrame:
    """Rates and costs from columns of totals."""
    t, f, a, s = map(F.col, (total, fixed, auto, seconds))
    return df.select(
        percent(f, t).alias("resolution_pct"),
        percent(a, t).alias("automation_pct"),
        (s / 60).alias("minutes"),
        (s / 3600).alias("hours"),
        F.try_divide(s * 1000.0, t).alias("seconds_per_1000"),
        F.try_divide(s / 3600 * rate_per_hour, t).alias("cost_per_record"),
    )


def recurrence_rate(previous: Column, reappeared: Column) -> Column:
    return percent(F.least(reappeared, previous), previous)


def alignment_key(before: DataFrame, after: DataFrame, names: list[str] | None = None) -> tuple[str, Column]:
    """The first key column that both have, else a hash of the shared descriptive fields."""
    for c in names or KEY_ORDER:
        if c in before.columns and c in after.columns:
            return c, F.col(f"`{c}`").cast("string")
    shared = [c for c in ("title", "company", "location", "job_url") if c in before.columns and c in after.columns]
    return "canonical_hash", canonical_key(*[F.col(c) for c in shared])


def key_match_rate(before: DataFrame, after: DataFrame, key: Column) -> DataFrame:
    a = after.select(key.alias("k")).filter("k is not null").distinct()
    b = before.select(key.alias("k")).filter("k is not null").distinct().withColumn("_both", F.lit(True))
    return a.join(b, "k", "left").agg(F.count(F.lit(1)).alias("n_after"), F.count("_both").alias("n_both"), percent(F.count("_both"), F.count(F.lit(1))).alias("match_rate"))


def error_ledger(before: DataFrame, after: DataFrame, key: str, row_id: str, cols: list[str], checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """Per key, column and issue (missing, invalid): whether either side has it, and the first values.

    ``checks``: for a column, its own validity. Only keys that both sides have, and only rows with an issue.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        aggs = []
        for c in cols:
            aggs.append(F.bool_or(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(f"{p}_missing_{c}"))
            aggs.append(F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(row_id))).alias(f"{p}_value_{c}"))
        aggs += [F.bool_or(~F.coalesce(check, F.lit(False))).alias(f"{p}_invalid_{c}") for c, check in checks.items()]
        return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)

    both = side(before, "before").join(side(after, "after"), key)
    kinds = [("missing", c) for c in cols] + [("invalid", c) for c in checks]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(kind).alias("issue_type"),
                F.col(f"before_{kind}_{c}").alias("before_has_issue"),
                F.col(f"after_{kind}_{c}").alias("after_has_issue"),
                (F.col(f"before_value_{c}") if c in cols else F.lit(None).cast("string")).alias("before_value"),
                (F.col(f"after_value_{c}") if c in cols else F.lit(None).cast("string")).alias("after_value"),
            )
            for kind, c in kinds
        ]
    )
    long = both.select(F.col(key).alias("record_key"), F.explode(rows).alias("r")).select("record_key", "r.*")
    return long.filter("before_has_issue or after_has_issue").withColumn("fixed", F.col("before_has_issue") & ~F.col("after_has_issue"))


def ledger_recurrence(prior: DataFrame, current: DataFrame) -> DataFrame:
    """How many issues that were fixed before are there again, in percent."""
    at = ["record_key", "column_name", "issue_type"]
    fixed = prior.filter("fixed").select(*at).distinct()
    again = current.filter("after_has_issue").select(*at).distinct().withColumn("_again", F.lit(True))
    return fixed.join(again, at, "left").agg(F.count(F.lit(1)).alias("n_fixed"), F.count("_again").alias("n_again"), percent(F.count("_again"), F.count(F.lit(1))).alias("recurrence"))


def ledger_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("issue_type").agg(F.count_if("before_has_issue").alias("before_issues"), F.count_if("after_has_issue").alias("after_issues"), F.count_if("fixed").alias("fixed_issues"))


def text_informativeness(df: DataFrame, text: str, short: int = 30) -> DataFrame:
    n = token_count(F.col(text))
    return df.select(n.alias("n")).agg(F.median("n").cast("int").alias("median_tokens"), percent(F.count_if(F.col("n") < short), F.count(F.lit(1))).alias("short_pct"))


def contamination(df: DataFrame, text: str, *names: str) -> DataFrame:
    """Rows whose text contains one of the row's own names of three characters or more, in percent."""
    low, found = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(False)
    for c in names:
        name = norm(F.col(c))
        found = found | ((F.length(name) > 2) & low.contains(name))
    return df.agg(F.count_if(found).alias("n_contaminated"), percent(F.count_if(found), F.count(F.lit(1))).alias("contamination_pct"))


def audit_sample(df: DataFrame, key: str, n: int = 250, seed: int = 7) -> DataFrame:
    """n rows in the order of a seeded hash, with two blank columns for the auditor."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n).withColumns({"is_correct": F.lit(None).cast("string"), "audit_notes": F.lit(None).cast("string")})


def metric_table(before: DataFrame, after: DataFrame, names: list[str]) -> DataFrame:
    """One-row frames of metrics side by side: metric, before, after, improvement."""
    long = lambda df, side: df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", side)
    return long(before, "before_value").join(long(after, "after_value"), "metric").withColumn("improvement", F.col("after_value") - F.col("before_value"))


def pivot_metrics(long: DataFrame, datasets: list[str]) -> DataFrame:
    """(dataset, metric, value) to one column for each dataset."""
    return long.groupBy("metric").pivot("dataset", datasets).agg(F.first("value"))
