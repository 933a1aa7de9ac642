"""Topics: clusters of vectors, class TF-IDF, tables of topics and rows, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm, snippet

OUTLIER = -1


def fit_topics(df: DataFrame, vector: str, k: int, seed: int = 42, outlier_share: float = 0.2, components: int = 5) -> DataFrame:
    """Adds topic_id, topic_prob and probs from a vector column: PCA, k-means, the farthest share as outliers.

    An approximation: density clustering with its own choice of k has no distributed equivalent here.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    wide = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = Pipeline(stages=[PCA(k=components, inputCol="_v", outputCol="_low"), KMeans(k=k, seed=seed, featuresCol="_low", predictionCol="_c")]).fit(wide)
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.stages[1].clusterCenters()])
    low = vector_to_array("_low")
    distance = F.transform(centers, lambda c: F.aggregate(F.zip_with(c, low, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    rows = model.transform(wide).withColumn("_d", distance).withColumn("_near", F.array_min("_d"))
    # a rank within a millionth, in bounded memory: an exact one would hold all distances in one task
    cut = rows.agg(F.percentile_approx("_near", 1 - outlier_share, 1_000_000).alias("_cut"))
    weights = F.transform("_d", lambda d: F.exp(F.col("_near") - d))
    rows = rows.join(F.broadcast(cut)).withColumn("_w", weights)
    probs = F.transform("_w", lambda w: w / F.aggregate("_w", F.lit(0.0), lambda s, x: s + x))
    rows = rows.withColumn("probs", probs).withColumn("topic_prob", F.array_max("probs"))
    rows = rows.withColumn("topic_id", F.when(F.col("_near") > F.col("_cut"), OUTLIER).otherwise(F.col("_c")))
    return rows.drop("_v", "_low", "_c", "_d", "_near", "_cut", "_w")


def project(df: DataFrame, vector: str, x: str = "x", y: str = "y") -> DataFrame:
    """Adds the first two principal components of a vector column, as a map of the rows; null without a vector."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    wide = df.filter(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    if wide.isEmpty():
        return df.withColumn(x, F.lit(None).cast("double")).withColumn(y, F.lit(None).cast("double"))
    low = vector_to_array("_low")
    found = PCA(k=2, inputCol="_v", outputCol="_low").fit(wide).transform(wide).withColumn(x, low[0]).withColumn(y, low[1]).drop("_v", "_low")
    return found.unionByName(df.filter(F.col(vector).isNull()), allowMissingColumns=True)


def class_words(df: DataFrame, topic: str, text: str, stop_words: list[str], pattern: str = r"[a-z0-9]{2,}") -> DataFrame:
    """(topic, word, n) counts of words in each topic."""
    words = F.filter(F.regexp_extract_all(norm(F.col(text)), F.lit(pattern), F.lit(0)), lambda w: ~w.isin(*stop_words))
    return df.select(F.col(topic).alias("topic_id"), F.explode(words).alias("word")).groupBy("topic_id", "word").agg(F.count(F.lit(1)).alias("n"))


def class_tfidf(counts: DataFrame) -> DataFrame:
    """(topic_id, word, weight): sqrt of the word's share of its class, times ``ln(1 + A / f)``; A is the mean class size."""
    per_class = counts.groupBy("topic_id").agg(F.sum("n").alias("class_n"))
    per_word = counts.groupBy("word").agg(F.sum("n").alias("word_n"))
    mean = per_class.agg(F.floor(F.avg("class_n")).alias("mean_n"))
    rows = counts.join(per_class, "topic_id").join(per_word, "word").join(F.broadcast(mean))
    return rows.select("topic_id", "word", (F.sqrt(F.col("n") / F.col("class_n")) * F.log(1 + F.col("mean_n") / F.col("word_n"))).alias("weight"))


def topics_table(df: DataFrame, topic: str, weights: DataFrame, k: int = 10) -> DataFrame:
    """topic_id, top_words and n_docs, without outliers."""
    ranked = weights.withColumn("place", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc(F.round("weight", 9)), "word"))).filter(F.col("place") <= k)
    words = ranked.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), ", ").alias("top_words"))
    sizes = df.filter(F.col(topic) != OUTLIER).groupBy(F.col(topic).alias("topic_id")).agg(F.count(F.lit(1)).alias("n_docs"))
    return sizes.join(words, "topic_id", "left").select("topic_id", "top_words", "n_docs")


def with_labels(df: DataFrame, labels: DataFrame, most: int = 100_000) -> DataFrame:
    """Left join of topic labels; broadcast while there are few topics."""
    few = labels.limit(most + 1).count() <= most
    return df.join(F.broadcast(labels) if few else labels, "topic_id", "left")


def topic_examples(df: DataFrame, topic: str, row_id: str, k: int = 5) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(topic).orderBy(row_id))).filter(F.col("place") <= k)


def topic_sizes(df: DataFrame, topic: str) -> DataFrame:
    return df.groupBy(F.col(topic).alias("topic_id")).agg(F.count(F.lit(1)).alias("n_jobs"))


def topic_means(df: DataFrame, topic: str, p: str) -> DataFrame:
    return df.filter(F.col(p).isNotNull()).groupBy(F.col(topic).alias("topic_id")).agg(F.avg(p).alias("mean_p"))


def histogram(df: DataFrame, c: str, bins: int = 30, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts by bin; the upper end is in the last bin."""
    at = F.least(F.width_bucket(F.col(c), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    return df.filter(F.col(c).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def run_metadata(loaded: DataFrame, filtered: DataFrame, sampled: DataFrame, topics: DataFrame, **settings: str) -> DataFrame:
    """One row of counts and settings."""
    out = loaded.agg(F.count(F.lit(1)).alias("n_before_all_filters"))
    for df, name in ((filtered, "n_after_len_core_filter"), (sampled, "n_after_sampling"), (topics, "n_topics")):
        out = out.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))
    return out.select("*", *[F.lit(v).alias(k) for k, v in settings.items()])


def subsample(df: DataFrame, row_id: str, most: int, seed: int = 42) -> DataFrame:
    """``most`` rows in the order of a seeded hash."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"))), row_id).limit(most)


def missing_embeddings(docs: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """Documents whose text's md5 isn't in the cache (md5, embedding)."""
    return docs.withColumn("md5", F.md5(F.coalesce(F.col(text), F.lit("")))).join(cache.select("md5"), "md5", "left_anti")


def prompt_payloads(topics: DataFrame, rows: DataFrame, row_id: str, text: str, k: int = 5, chars: int = 400) -> DataFrame:
    """topic_id and a JSON payload of its words and a few snippets."""
    few = topic_examples(rows, "topic_id", row_id, k).withColumn("snippet", snippet(F.col(text), chars))
    lists = few.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "snippet"))), lambda x: x["snippet"]).alias("examples"))
    joined = topics.join(lists, "topic_id", "left")
    return joined.select("topic_id", F.to_json(F.struct("topic_id", "top_words", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))).alias("payload"))


def fallback_label(topic: Column, words: Column) -> dict[str, Column]:
    """The label of a topic without rows: its first word."""
    return {"topic_label": F.trim(F.split(words, ",")[0]), "topic_label_long": F.concat(F.lit("Topic "), topic.cast("string"), F.lit(": "), words), "topic_label_confidence": F.lit(0.1)}


def sanitize_label(answer: str, topic: int, words: str) -> tuple[str, str, float]:
    """(short, long, confidence) from a labeller's answer, whatever it is."""
    import json

    first, long = words.split(",")[0].strip(), f"Topic {topic}: {words}"
    try:
        found = json.loads(answer)
    except (TypeError, ValueError):
        return (answer or "").strip()[:80] or first, long, 0.5
    if not isinstance(found, dict):
        return str(found)[:80] or first, long, 0.5
    try:
        sure = min(1.0, max(0.0, float(found.get("confidence", 0.7))))
    except (TypeError, ValueError):
        sure = 0.7
    return str(found.get("label") or "").strip() or first, str(found.get("label_long") or "").strip() or long, sure


def label_topics(topics: DataFrame, payloads: DataFrame, call: Callable[[str], str] | None) -> DataFrame:
    """Labels from a callable; one call for each topic, on the driver. Without one, or where it fails, the fallback."""
    rows = []
    for r in topics.join(payloads, "topic_id", "left").orderBy("topic_id").toLocalIterator():
        words = r["top_words"] or ""
        if call is None or r["payload"] is None or '"examples":[]' in r["payload"]:
            rows.append((r["topic_id"], words.split(",")[0].strip(), f"Topic {r['topic_id']}: {words}", 0.1))
            continue
        try:
            rows.append((r["topic_id"], *sanitize_label(call(r["payload"]), r["topic_id"], words)))
        except Exception:
            rows.append((r["topic_id"], words.split(",")[0].strip(), f"Topic {r['topic_id']}: {words}", 0.0))
    labels = topics.sparkSession.createDataFrame(rows, "topic_id int, topic_label string, topic_label_long string, topic_label_confidence double")
    return topics.join(labels, "topic_id", "left")


def low_confidence(labeled: DataFrame, at_most: float = 0.7) -> DataFrame:
    return labeled.filter(F.col("topic_label_confidence") <= at_most).orderBy("topic_label_confidence", "topic_id")
