"""classifier_scores trains as the reference does: three folds, 150,000 features, at most 1000 iterations."""

from postmill.operators import model
from postmill.plans import label_queries


def test_classifier_scores_trains_in_full(spark, sf, monkeypatch):
    given = {}

    class Trained(Exception):
        pass

    def base(kind, mode, iterations):
        given.update(kind=kind, mode=mode, iterations=iterations)
        raise Trained

    monkeypatch.setattr(model, "_base", base)
    try:
        label_queries.classifier_scores(spark, sf)
    except Trained:
        pass
    assert given == {"kind": "logreg", "mode": "precise", "iterations": 1000}
    assert model.MODES["precise"] == {"max_features": 150_000, "min_df": 2, "folds": 3}
