"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over the beginnings of words (four and five letters; the
presence of each, so that a text's length doesn't matter); every model also gets the probabilities of the categories
before it. In training those come from out-of-fold predictions: a row's earlier probabilities are those of models whose
features, weak labels and weights come from the other folds alone. Equal texts (A-Z as a-z) stand in one fold.

The labels know one category, ``toxic``. The chain's earlier categories are weak labels of the labelled rows, degrees of
the same: ``insult`` (toxic, with a beginning of words that toxic rows use far more often) and ``harassment`` (toxic, with
three of them or more). An independent second category would need labels of its own (threats, slurs, sexual content),
which ``fit_chain`` takes as they are. Models are fitted on at most ``FIT_ROWS`` labelled rows, chosen by a hash of their
doc_id, and ``FEATURES`` beginnings chosen by association over those rows; both numbers bound what reaches the driver.

Cases: a null or empty text has no words and gets the intercepts' probabilities; texts of any length are read whole;
repeated rows are scored each for itself; without labels, or with one class only, all probabilities are 0 and nothing is
rejected; an empty table gives no rows; further columns are ignored or, on request, carried.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import text_groups
from .work import columns, delete, work_dir, written

FIT_ROWS, FEATURES, FOLDS = 12_000, 400, 5
CATEGORIES = ("insult", "harassment", "toxic")
WORDS = re.compile(r"[^\W\d_]+")


def beginnings(text: str | None) -> set[str]:
    """The first four and five letters of each word (a shorter word as it is)."""
    words = set(WORDS.findall((text or "").lower()))
    return {w[:4] for w in words} | {w[:5] for w in words}


def fit_logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, penalty: float = 0.05, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient steps; classes weigh the same, ``counts`` rows each."""
    n, m = counts.sum(), x.shape[1]
    weight = np.where(y, 0.5 / max(1, counts[y].sum()), 0.5 / max(1, counts[~y].sum())) * counts
    w, b, vw, vb = np.zeros(m), 0.0, np.zeros(m), 0.0
    # the loss's curvature is at most a quarter of the weighted mean square norm
    rate = 1.0 / (0.25 * float(weight @ ((x * x).sum(1) + 1)) + penalty / n)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30)))
        g = weight * (p - y)
        nw, nb = vw - rate * (x.T @ g + penalty / n * vw), vb - rate * g.sum()
        k = (t - 1) / (t + 2)
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w, float(b)


def _probability(x: np.ndarray, model: tuple[np.ndarray, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ model[0] + model[1], -30, 30)))


def _fitted(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    return fit_logistic(x, y, counts) if y.any() and not y.all() else (np.zeros(x.shape[1]), 30.0 if y.any() else -30.0)


def fit_chain(whole: Callable, parts: list[Callable], folds: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """A model for each category, and the out-of-fold probabilities.

    ``whole()`` gives features and categories of all rows (each row stands ``counts`` times); ``parts[f]()`` the same for
    fold f, chosen without looking at it. The k-th model has k weights more, for the probabilities before it.
    """
    models, earlier, x, targets = [], np.zeros((len(folds), 0)), *whole()
    for k in range(len(targets)):
        out_of_fold = np.zeros(len(folds))
        for f, part in enumerate(parts):
            inside = folds == f
            if inside.any():
                own, of_own = part()
                wide = np.hstack([own, earlier])
                out_of_fold[inside] = _probability(wide[inside], _fitted(wide[~inside], of_own[k][~inside], counts[~inside]))
        models.append(_fitted(np.hstack([x, earlier]), targets[k], counts))
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    return models, earlier


class Chain:
    """A fitted chain, small enough to travel with a task."""

    def __init__(self, features: list[str], models: list[tuple[np.ndarray, float]]) -> None:
        self.index = {f: i for i, f in enumerate(features)}
        self.weights = [m[0].tolist() for m in models]
        self.intercepts = [m[1] for m in models]

    def score(self, text: str | None) -> list[float]:
        if not self.weights:
            return [0.0] * len(CATEGORIES)
        at = [self.index[f] for f in beginnings(text) & self.index.keys()]
        out: list[float] = []
        for w, b in zip(self.weights, self.intercepts, strict=True):
            n = len(self.index)
            z = b + math.fsum([w[i] for i in at]) + math.fsum(w[n + k] * p for k, p in enumerate(out))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fits on documents (doc_id, text) and labels (doc_id, toxic)."""
    labels = columns(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, FIT_ROWS / max(1, labels.count()))
    chosen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003)).limit(2 * FIT_ROWS)
    # at most twice FIT_ROWS rows of two numbers
    texts = columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    fold = F.pmod(F.xxhash64(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), F.lit(FOLDS))
    texts = texts.select("doc_id", F.col("toxic").cast("long"), fold.cast("long"), "text")

    def run(batches):
        for batch in batches:
            found = pa.array([sorted(beginnings(t)) for _, group in text_groups([batch], 0, 3) for t in group], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).cast(pa.int64()) for k in range(3)], found], names=["doc_id", "toxic", "fold", "features"])

    home = work_dir(docs.sparkSession, "toxicity")
    sample = written(texts.mapInArrow(run, "doc_id long, toxic long, fold long, features array<string>"), f"{home}/sample")
    of_fold = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = [sum(n for (_, t), n in of_fold.items() if t == c) for c in (0, 1)]
    if not all(totals):
        return Chain([], [])
    seen = sample.select("doc_id", "toxic", "fold", F.explode("features").alias("feature"))
    inside = [F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(FOLDS)] + [F.count_if((F.col("fold") == f) & (F.col("toxic") == 1)).alias(f"a{f}") for f in range(FOLDS)]
    counts = written(seen.groupBy("feature").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count(F.lit(1)).alias("n"), *inside).filter("n >= 3"), f"{home}/counts")

    def ranked(without: int | None) -> list:
        """The features that all folds but one would choose, and their log odds."""
        a, n = (F.col(c) if without is None else F.col(c) - F.col(f"{c}{without}") for c in "an")
        clean, toxic = (total - of_fold.get((without, c), 0) for c, total in enumerate(totals))
        odds = F.log2((a + 0.5) / (toxic + 1.0)) - F.log2((n - a + 0.5) / (clean + 1.0))
        worth = F.abs(odds) * F.abs(a / F.lit(max(1, toxic)) - (n - a) / F.lit(max(1, clean)))
        return counts.filter(n >= 3).select("feature", odds.alias("odds"), worth.alias("worth")).filter("abs(odds) >= 2").orderBy(F.desc("worth"), "feature").limit(FEATURES).collect()

    splits = [ranked(f) for f in (None, *range(FOLDS))]
    union = sorted({r["feature"] for split in splits for r in split})
    listed = docs.sparkSession.createDataFrame(pa.table({"feature": pa.array(union, pa.string()), "at": pa.array(range(len(union)), pa.int32())}))
    rows = seen.join(F.broadcast(listed), "feature").groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("at"))
    rows = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("fold").alias("fold")).join(rows, "doc_id", "left")
    # rows with the same features are one with a count: most clean rows have none
    rows = rows.groupBy("at", "toxic", "fold").agg(F.count(F.lit(1)).alias("n")).orderBy("at", "toxic", "fold").collect()
    every = np.zeros((len(rows), len(union)), bool)
    for i, r in enumerate(rows):
        every[i, r["at"] or []] = True
    toxic, place = np.array([r["toxic"] == 1 for r in rows]), {f: i for i, f in enumerate(union)}

    def view(split: list) -> tuple[np.ndarray, list[np.ndarray]]:
        x = every[:, [place[r["feature"]] for r in split]].astype(float)
        hits = x @ np.array([float(r["odds"] > 3) for r in split])
        return x, [toxic & (hits >= 1), toxic & (hits >= 3), toxic]

    whole, *parts = [partial(view, split) for split in splits]
    models, _ = fit_chain(whole, parts, np.array([r["fold"] for r in rows]), np.array([r["n"] for r in rows]))
    delete(docs.sparkSession, home)
    return Chain([r["feature"] for r in splits[0]], models)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability for each category, and ``toxic``."""

    def run(batches):
        for ids, texts in text_groups(batches):
            found = [chain.score(t) for t in texts]
            parts = [pa.array([x[k] for x in found], pa.float64()) for k in range(len(CATEGORIES))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *parts, pa.array([x[-1] >= threshold for x in found], pa.bool_())], names=["doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic"])

    return columns(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'p_{c} double' for c in CATEGORIES)}, toxic boolean")


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, that the chain doesn't find toxic."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            k = 0
            for _, texts in text_groups([batch], at, at):  # few texts as Python objects at a time
                keep = [chain.score(t)[-1] < threshold for t in texts]
                yield batch.slice(k, len(texts)).filter(pa.array(keep, pa.bool_()))
                k += len(texts)

    return docs.mapInArrow(run, docs.schema)


def op10_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
