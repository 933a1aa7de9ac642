"""Label issues by confident learning, for two classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that confidence is cut into for ranking.
BINS = 4096


def confident_joint(df: DataFrame, label: str, p: str) -> DataFrame:
    """How many rows of each given label count confidently as each class.

    A class's threshold is the mean probability of the class over rows given it.
    """
    of = thresholds(df, label, p)
    rows = df.select(F.col(label).alias("given"), F.col(p).alias("p1"), (1 - F.col(p)).alias("p0")).join(F.broadcast(of))
    sure1, sure0 = F.col("p1") >= F.col("t1"), F.col("p0") >= F.col("t0")
    guess = F.when(sure1 & sure0, (F.col("p1") >= F.col("p0")).cast("int")).when(sure1, 1).when(sure0, 0)
    return rows.withColumn("guess", guess).filter("guess is not null").groupBy("given", "guess").agg(F.count(F.lit(1)).alias("n"))


def thresholds(df: DataFrame, label: str, p: str) -> DataFrame:
    """One row: t0 and t1."""
    return df.agg(F.avg(F.when(F.col(label) == 0, 1 - F.col(p))).alias("t0"), F.avg(F.when(F.col(label) == 1, F.col(p))).alias("t1"))


def ranked_issues(df: DataFrame, label: str, p: str, row_id: str) -> DataFrame:
    """Rows whose other class is confident, ranked by how little their own label is believed."""
    rows = df.join(F.broadcast(thresholds(df, label, p)))
    own = F.when(F.col(label) == 1, F.col(p)).otherwise(1 - F.col(p))
    other_sure = F.when(F.col(label) == 1, 1 - F.col(p) >= F.col("t0")).otherwise(F.col(p) >= F.col("t1"))
    found = rows.withColumn("self_confidence", own).filter(other_sure & (F.col("self_confidence") < 0.5))
    # ranked within narrow ranges of confidence; each range starts after the count of what lies below it
    found = found.withColumn("_bin", F.floor(F.col("self_confidence") * BINS).cast("int"))
    below = found.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    below = below.select("_bin", (F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n")).cast("int").alias("_below"))  # at most BINS rows
    place = F.row_number().over(Window.partitionBy("_bin").orderBy("self_confidence", row_id))
    ranked = found.withColumn("_place", place).join(F.broadcast(below), "_bin")
    return ranked.withColumn("issue_rank", F.col("_place") + F.col("_below")).drop("t0", "t1", "_bin", "_place", "_below")


def uncertain(df: DataFrame, label: str, p: str, row_id: str, n: int, low: float, high: float) -> DataFrame:
    """The n least believed weak negatives within a range of probability."""
    rows = df.join(F.broadcast(thresholds(df, label, p))).withColumn("self_confidence", F.when(F.col(label) == 1, F.col(p)).otherwise(1 - F.col(p)))
    return rows.filter((F.col(label) == 0) & F.col(p).between(low, high)).orderBy("self_confidence", row_id).limit(n).drop("t0", "t1")


def false_negative_mask(df: DataFrame, label: str, p: str, row_id: str, min_p: float = 0.4, max_fraction: float = 0.2) -> DataFrame:
    """Adds ``likely_fn``: among the top fraction of issues, a weak negative that is probable enough."""
    issues = ranked_issues(df, label, p, row_id).select(row_id, "issue_rank")
    total = df.agg(F.floor(F.count(F.lit(1)) * max_fraction).alias("_most"))
    marked = df.join(issues, row_id, "left").join(F.broadcast(total))
    hit = (F.col("issue_rank") <= F.col("_most")) & (F.col(label) == 0) & (F.col(p) >= min_p)
    return marked.withColumn("likely_fn", F.coalesce(hit, F.lit(False))).drop("issue_rank", "_most")
