"""The classifier's terms, counted once for all folds, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from postmill.functions import terms
from postmill.operators import model


def _terms(text):
    words = re.findall(r"\w{2,}", text.lower())
    return words, list(zip(words, words[1:], strict=False))


def test_vocabulary_of_each_fold(spark, monkeypatch):
    """Words and pairs in two rows at least and in no more than 95 %, the most frequent first, of the other folds' rows."""
    monkeypatch.setattr(terms, "FLUSH", 40)  # a term's counts come in many parts
    rng = random.Random(7)
    texts = ["every " + " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(12))) for _ in range(90)] + ["", "Ümlaut x"]
    rows = spark.createDataFrame([(t, k % 3) for k, t in enumerate(texts)], "_text string, _fold int").repartition(3)
    sums = [f"{c}{k}" for k in range(3) for c in ("n", "rows")]
    counted = model._hashed(rows).select("_words", "_fold").mapInArrow(terms.counter(3), "term long, " + ", ".join(f"{c} long" for c in sums))
    counted = counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in sums)).persist()
    for fold in range(3):
        mine = [_terms(t) for k, t in enumerate(texts) if k % 3 != fold]
        for most in (10**6, 15):
            names, idf, _ = model._vocabulary(counted, fold, 3, len(mine), most, 2)
            expected, sure = [], 0
            for kind in (0, 1):
                n, df = Counter(), Counter()
                for both in mine:
                    n.update(both[kind])
                    df.update(set(both[kind]))
                kept = sorted((-n[t], math.log((len(mine) + 1) / (df[t] + 1))) for t in n if 2 <= df[t] <= 0.95 * len(mine))
                assert len(kept) > 15
                assert (names & 1 == kind).sum() == min(most, len(kept))
                cut = kept[:most][-1][0]
                expected += [x for c, x in kept[:most] if c < cut]
                sure += min(most, len(kept))
            left = Counter(np.round(idf, 9)) - Counter(np.round(expected, 9))
            assert len(idf) == sure and sum(left.values()) == len(idf) - len(expected)
            if most > 1000:
                continue
            again, _, _ = model._vocabulary(counted.repartition(5), fold, 3, len(mine), most, 2)
            assert sorted(again) == sorted(names)


def test_lookup_finds_each_term_and_no_other():
    rng = np.random.default_rng(3)
    names = np.unique(rng.integers(-(2**63), 2**63 - 1, 50_000))
    find = terms.Lookup(names)
    assert (find(names) == np.arange(len(names))).all()
    others = np.setdiff1d(rng.integers(-(2**63), 2**63 - 1, 50_000), names)
    assert (find(others) == -1).all() and (find(np.array([0])) == -1).all()


def test_saved_classifier_scores_the_same(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"{('alpha beta', 'gamma delta')[k % 2]} word{k % 5} more text", k % 2) for k in range(60)], "id long, t string, y int")
    fitted = model.train(rows, "t", "y", "id", mode="fast")
    fitted.save(f"file://{tmp_path}/m")
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "alpha beta"), (3, "gamma delta")], "id long, t string")
    first = {r["id"]: r["p_rnd"] for r in fitted.score(docs, "t").collect()}
    assert first == {r["id"]: r["p_rnd"] for r in model.CalibratedClassifier.load(f"file://{tmp_path}/m").score(docs, "t").collect()}
    assert first[0] == first[1] and first[3] > first[1] > first[2]


def _rows(n=240):
    rng = random.Random(5)
    far = lambda k: " w1" * 700 if k == 9 else ""
    pick = lambda y: f"w{min(int(rng.expovariate(0.08 if y else 0.11)), 70)}"
    return [(k, " ".join(pick(k % 4 > 0) for _ in range(rng.randrange(3, 40))) + far(k), int(k % 4 > 0)) for k in range(n)]


def test_linear_models_are_the_optimum(spark, monkeypatch):
    """Each fold's model against Spark's on the same features, both with a tight tolerance; sums by piece change nothing."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(model, "TOLERANCE", 1e-12)
    given = {}
    own = model._logistic

    def seen(found, parts, factors, iterations):
        given.update(rows=found.collect(), factors=factors, one=own(found, parts, factors, iterations))
        monkeypatch.setattr(model, "SENT", 0)
        given["other"] = own(found, parts, factors, iterations)
        return given["one"]

    monkeypatch.setattr(model, "_logistic", seen)
    model.train(spark.createDataFrame(_rows(), "id long, t string, y int").repartition(3), "t", "y", "id", mode="fast", iterations=1000)
    weights, intercepts = given["one"]
    assert np.allclose(weights, given["other"][0], atol=1e-6) and np.allclose(intercepts, given["other"][1], atol=1e-5)
    for k in range(2):
        rows = []
        for r in (r for r in given["rows"] if r["_fold"] != k):
            n = Counter()
            for i, c in zip(np.frombuffer(r["_places"], np.int32), r["_counts"], strict=True):
                n[int(i)] += c
            assert r["_counts"].count(255) == 0 or max(n.values()) > 650
            rows.append((r["_label"], r["_weight"], Vectors.sparse(len(weights), [(i, c * given["factors"][i, k]) for i, c in sorted(n.items()) if given["factors"][i, k]])))
        theirs = LogisticRegression(regParam=1e-3, weightCol="w", labelCol="y", featuresCol="x", maxIter=1000, tol=1e-12).fit(spark.createDataFrame(rows, ["y", "w", "x"]))
        assert abs(theirs.intercept - intercepts[k]) < 1e-3
        assert np.abs(theirs.coefficients.toArray() * given["factors"][:, k] - weights[:, k]).max() < 1e-4


def test_a_pass_serves_all_folds(spark, monkeypatch):
    """Training takes jobs by passes, not by passes and folds, and no more passes than a search of one fold needs."""
    passes = []
    own = model._summed
    monkeypatch.setattr(model, "_summed", lambda *a: passes.append(a[3]) or own(*a))
    fitted = model.train(spark.createDataFrame(_rows(), "id long, t string, y int"), "t", "y", "id", mode="precise", iterations=1000)
    assert passes[:2] == [6, 3] and passes[1:] == sorted(passes[1:], reverse=True)
    assert fitted.weights.shape[1] == len(fitted.lines) == 3


def test_support_vector_machine(spark):
    rows = spark.createDataFrame(_rows(), "id long, t string, y int")
    scored = model.train(rows, "t", "y", "id", kind="linear_svc", mode="fast").score(rows, "t")
    means = {r["y"]: r["p"] for r in scored.groupBy("y").agg(F.avg("p_rnd").alias("p")).collect()}
    assert means[1] > means[0]
