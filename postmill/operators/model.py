"""The text classifier: TF-IDF features, a linear model, sigmoid calibration over folds.

Terms are counted once for all folds, by 64-bit hashes; a fold's vocabulary comes from the counts of the others. A text's
counts of known terms are made once, too, and each fold's features are those counts times its own weights.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import terms
from ..plans.session import ship

# fixed values: settings of the two modes
MODES = {"fast": {"max_features": 50_000, "min_df": 5, "folds": 2}, "precise": {"max_features": 150_000, "min_df": 2, "folds": 3}}
MAX_DF = 0.95
#: Training rows to a partition where there are more than cores: each partition sends a gradient of all features in each iteration.
ROWS_OF_PART = 50_000
#: Bytes of all partitions' gradients that may come to the driver at once; beyond, they are added up by piece before.
SENT = 32 << 20
#: Of the linear models: the weight of the squares, and the tolerance.
PENALTY, TOLERANCE = 1e-3, 1e-6


def _hashed(df: DataFrame) -> DataFrame:
    """``_words``: the hashes of the words of ``_text``."""
    words = RegexTokenizer(inputCol="_text", outputCol="_list", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False).transform(df)
    return words.withColumn("_words", F.transform("_list", lambda w: F.xxhash64(w))).drop("_list", "_text")


def _base(kind: str, mode: str, iterations: int) -> tuple[dict[str, int], Callable[..., tuple[np.ndarray, list[float]]]]:
    return MODES[mode], partial(_logistic if kind == "logreg" else _hinge, iterations=iterations)


def _summed(found: DataFrame, parts: int, function, models: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of all partitions, of which there are ``parts``: by model and feature, and the two numbers of each model."""
    rows = found.mapInArrow(function, terms.SUMS)
    if parts * models * size * 8 > SENT:
        rows = rows.repartition(models * terms.PIECES, "model", "piece").mapInArrow(terms.added, terms.SUMS)
    sums, loss, slope = np.zeros((models, size)), np.zeros(models), np.zeros(models)
    pieces = [np.array_split(one, terms.PIECES) for one in sums]  # views
    got = rows.toArrow()
    for m, j, x, y, part in zip(*(got[c] for c in ("model", "piece", "loss", "slope", "features")), strict=True):
        m = m.as_py()
        pieces[m][j.as_py()] += np.frombuffer(part.as_buffer())
        loss[m] += x.as_py()
        slope[m] += y.as_py()
    return sums, loss, slope


def _minimised(x: np.ndarray, iterations: int, memory: int = 10):
    """L-BFGS with a weak Wolfe search. Yields points and is sent the value and gradient at each; returns the last point.

    It ends as Spark's models do: by the gradient, or when the value has hardly changed against the largest of the last 20.
    Steps are remembered in single precision, which only bends the ways that are tried.
    """
    value, grad = yield x
    first, values, pairs = value, [value], []
    for _ in range(iterations):
        if np.linalg.norm(grad) <= max(TOLERANCE * abs(value), 1e-8):
            break
        way, kept = -grad, []
        for s, y, rho in reversed(pairs):
            kept.append(rho * (s @ way))
            way -= kept[-1] * y
        if pairs:
            way *= 1 / (pairs[-1][2] * np.dot(pairs[-1][1].astype(float), pairs[-1][1]))
        for (s, y, rho), alpha in zip(pairs, reversed(kept), strict=True):
            way += (alpha - rho * (y @ way)) * s
        down = grad @ way
        step, low, high = 1.0 if pairs else min(1.0, 1 / np.linalg.norm(grad)), 0.0, np.inf
        for _ in range(40):
            point = x + step * way
            v, g = yield point
            if not v <= value + 1e-4 * step * down:
                high = step
            elif g @ way < 0.9 * down:
                low = step
            else:
                break
            step = 2 * step if np.isinf(high) else (low + high) / 2
        else:
            if not v < value:  # no step leads further down: as low as the numbers tell
                break
        s, y = (point - x).astype(np.float32), (g - grad).astype(np.float32)
        x, value, grad = point, v, g
        if (bend := np.dot(s.astype(float), y)) > 1e-12 * np.dot(y.astype(float), y):
            pairs = [*pairs, (s, y, 1 / bend)][-memory:]
        if max(values[-20:]) - value <= TOLERANCE * abs(first):
            break
        values.append(value)
    return x


def _logistic(found: DataFrame, parts: int, factors: np.ndarray, iterations: int) -> tuple[np.ndarray, list[float]]:
    """A logistic model for each fold, of features scaled to a deviation of 1; all folds take each step in the same pass."""
    spark, (size, folds) = found.sparkSession, factors.shape
    sums, weights, squares = _summed(found, parts, terms.moments(size, folds), 2 * folds, size)
    total, mean, scale = [], [], []
    for k in range(folds):
        others = [g for g in range(folds) if g != k]
        w, factor = weights[others].sum(), factors[:, k]
        mu = sums[others].sum(axis=0) / w
        variance = (sums[[folds + g for g in others]].sum(axis=0) - w * mu * mu) / max(w - squares[others].sum() / w, 1e-300)
        deviation = np.sqrt(np.maximum(variance, 0)) * factor
        scale.append(np.where(deviation > 0, factor / np.where(deviation > 0, deviation, 1), 0))  # of a count
        mean.append(mu * scale[-1])
        total.append(w)
    del sums

    def plain(k: int, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights of counts and the intercept, from those of centred features."""
        return x[:-1] * scale[k], float(x[-1] - mean[k] @ x[:-1])

    searches = {k: _minimised(np.zeros(size + 1), iterations) for k in range(folds)}
    at = {k: next(search) for k, search in searches.items()}
    done: dict[int, tuple[np.ndarray, float]] = {}
    while at:
        here = list(at)
        points = [plain(k, at[k]) for k in here]
        sent = spark.sparkContext.broadcast((here, np.stack([w for w, _ in points]), [b for _, b in points]))
        grads, losses, slopes = _summed(found, parts, terms.gradients(sent), len(here), size)
        sent.destroy()
        for m, k in enumerate(here):
            x, slope = at[k], slopes[m] / total[k]
            grad = np.append(grads[m] * scale[k] / total[k] - mean[k] * slope + PENALTY * x[:-1], slope)
            try:
                at[k] = searches[k].send((losses[m] / total[k] + PENALTY / 2 * (x[:-1] @ x[:-1]), grad))
            except StopIteration as end:
                done[k] = plain(k, end.value)
                del at[k]
    return np.stack([done[k][0] for k in range(folds)], axis=1), [done[k][1] for k in range(folds)]


def _hinge(found: DataFrame, parts: int, factors: np.ndarray, iterations: int) -> tuple[np.ndarray, list[float]]:
    """A linear support vector machine for each fold."""
    scales = found.sparkSession.sparkContext.broadcast(factors)
    schema = T.StructType([T.StructField("_label", T.DoubleType()), T.StructField("_weight", T.DoubleType()), T.StructField("_features", VectorUDT())])
    weights, intercepts = [], []
    for k in range(factors.shape[1]):
        base = LinearSVC(regParam=PENALTY, featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=iterations)
        model = base.fit(found.filter(F.col("_fold") != k).mapInArrow(terms.vectors(scales, k), schema))
        weights.append(model.coefficients.toArray() * factors[:, k])
        intercepts.append(float(model.intercept))
    return np.stack(weights, axis=1), intercepts


def _running(sizes: pa.Table, by: str, order: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a histogram in order, and how many there are up to each."""
    sizes = sizes.sort_by([(by, order)])
    return sizes[by].to_numpy(), sizes["size"].to_numpy().cumsum()


def _vocabulary(counted: DataFrame, fold: int, folds: int, rows: int, most: int, min_df: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a fold's training rows, ascending, the inverse document frequency of each, and its rows.

    Of words and of pairs the ``most`` frequent, those of a count that only some may have by their hashes. The cut is found
    in histograms, so no task has to sort all terms.
    """
    others = [k for k in range(folds) if k != fold]
    total = lambda c: sum((F.col(f"{c}{k}") for k in others), F.lit(0))
    kept = counted.select("term", F.col("term").bitwiseAND(F.lit(1)).alias("kind"), total("n").alias("n"), total("rows").alias("rows"))
    kept = kept.filter((F.col("rows") >= min_df) & (F.col("rows") <= MAX_DF * rows))
    sizes = kept.groupBy("kind", "n").agg(F.count(F.lit(1)).alias("size")).toArrow()
    wanted, ties = F.lit(False), {}
    for kind in (0, 1):
        counts, upto = _running(sizes.filter(pc.field("kind") == kind), "n", "descending")
        if not len(upto) or upto[-1] <= most:
            wanted |= F.col("kind") == kind
            continue
        at = int(np.searchsorted(upto, most, "right"))
        cut, rest = int(counts[at]), most - int(upto[at - 1] if at else 0)
        wanted |= (F.col("kind") == kind) & (F.col("n") > cut)
        if rest:
            head = F.shiftright("term", 48)
            tied = kept.filter((F.col("kind") == kind) & (F.col("n") == cut)).groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("size"))
            heads, upto = _running(tied.toArrow(), "head", "ascending")
            last = int(heads[np.searchsorted(upto, rest)])
            wanted |= (F.col("kind") == kind) & (F.col("n") == cut) & (head <= last)
            ties[kind] = cut, rest
    found = kept.filter(wanted).toArrow()
    term, kind, n, df = (found[c].to_numpy() for c in ("term", "kind", "n", "rows"))
    for k, (cut, rest) in ties.items():
        tied = np.flatnonzero((kind == k) & (n == cut))
        over = tied[np.argsort(term[tied])][rest:]
        term, kind, n, df = (np.delete(x, over) for x in (term, kind, n, df))
    order = np.argsort(term)
    return term[order], np.log((rows + 1) / (df[order] + 1)), df[order]


@dataclass
class CalibratedClassifier:
    """The mean of the folds' calibrated probabilities.

    names: hashes of the terms. weights: of one occurrence, by term and fold. lines: slope and intercept of each
    fold's curve.
    """

    names: np.ndarray
    weights: np.ndarray
    intercepts: list[float]
    lines: list[list[float]]

    def score(self, df: DataFrame, text: str, name: str = "p_rnd") -> DataFrame:
        spark = ship(df.sparkSession)
        known, intercepts, lines = spark.sparkContext.broadcast((terms.Lookup(self.names), self.weights)), self.intercepts, self.lines

        def probability(words: pa.Array) -> pa.Array:
            return terms.probabilities(words, *known.value, intercepts, lines)

        out = _hashed(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
        return out.withColumn(name, F.arrow_udf(probability, "double")("_words")).select(*(c for c in df.columns if c != name), name)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame(pa.table({"term": self.names, "weights": self.weights.tolist()})).write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame([(json.dumps([self.intercepts, self.lines]),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/calibration")

    @classmethod
    def load(cls, path: str) -> CalibratedClassifier:
        spark = SparkSession.active()
        intercepts, lines = json.loads(spark.read.text(f"{path}/calibration").first()[0])
        rows = spark.read.parquet(f"{path}/terms").orderBy("term").toArrow().to_pydict()
        return cls(np.array(rows["term"], np.int64), np.array(rows["weights"], float).reshape(-1, len(lines)), intercepts, lines)


def train(df: DataFrame, text: str, label: str, row_id: str, kind: str = "logreg", mode: str = "precise", iterations: int = 100) -> CalibratedClassifier:
    """Fits a base model on each fold's rest, and a one-dimensional logistic curve on the fold's margins."""
    m, base = _base(kind, mode, iterations)
    folds = m["folds"]
    spark = ship(df.sparkSession)
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(label).cast("double").alias("_label"), F.pmod(F.xxhash64(row_id), F.lit(folds)).cast("int").alias("_fold"))
    # texts are the weight of the work: spread over all cores, whatever the join before left
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _hashed(rows.repartition(wide)).persist()
    sizes = {(r["_label"], r["_fold"]): r["n"] for r in rows.groupBy("_label", "_fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, labels = sum(sizes.values()), {x for x, _ in sizes}
    if not labels <= {0.0, 1.0}:
        raise ValueError(f"{label} must be 0 or 1")
    weight = F.lit(1.0)
    for value in labels:
        weight = F.when(F.col("_label") == value, n / (len(labels) * sum(v for (x, _), v in sizes.items() if x == value))).otherwise(weight)

    sums = [f"{c}{k}" for k in range(folds) for c in ("n", "rows")]
    counted = rows.select("_words", "_fold").mapInArrow(terms.counter(folds), "term long, " + ", ".join(f"{c} long" for c in sums))
    counted = counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in sums)).filter(sum((F.col(f"rows{k}") for k in range(folds)), F.lit(0)) >= m["min_df"]).persist()
    counted.count()
    with ThreadPoolExecutor(folds) as pool:
        known = list(pool.map(lambda k: _vocabulary(counted, k, folds, sum(v for (_, f), v in sizes.items() if f != k), m["max_features"] // 2, m["min_df"]), range(folds)))
    counted.unpersist()
    names = np.unique(np.concatenate([x for x, _, _ in known]))
    if not len(names):
        raise ValueError(f"no term is in {m['min_df']} training rows")
    factors, often = np.zeros((len(names), folds)), np.zeros(len(names))
    for k, (found, idf, df) in enumerate(known):
        at = np.searchsorted(names, found)
        factors[at, k] = idf
        often[at] += df
    order = np.argsort(-often, kind="stable")  # what most rows have stands together, near in memory
    names, factors = names[order], factors[order]
    del known, often, order
    pa.default_memory_pool().release_unused()

    lookup = spark.sparkContext.broadcast(terms.Lookup(names))
    parts = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_OF_PART))
    found = rows.withColumn("_weight", weight).mapInArrow(terms.finder(lookup), "_fold int, _label double, _weight double, _places binary, _counts binary").persist()
    found.count()
    rows.unpersist()
    weights, intercepts = base(found.coalesce(parts), parts, factors)
    margins = found.mapInArrow(terms.margins(spark.sparkContext.broadcast(weights), intercepts), "_fold int, _label double, _margin double").coalesce(parts).persist()

    def line(fold: int) -> list[float]:
        one = margins.filter(F.col("_fold") == fold).select(array_to_vector(F.array("_margin")).alias("_features"), "_label")
        curve = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1e-6).fit(one)
        return [float(curve.coefficients[0]), float(curve.intercept)]

    with ThreadPoolExecutor(folds) as pool:
        lines = list(pool.map(line, range(folds)))
    margins.unpersist()
    found.unpersist()
    return CalibratedClassifier(names, weights, intercepts, lines)
