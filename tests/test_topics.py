"""Topics from rows to labelled tables, by the functions behind the commands; history, LaTeX and character references."""

import html
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from postmill.config import Config
from postmill.functions import text
from postmill.operators import topics
from postmill.plans import pipeline
from postmill.plans.session import ship
from postmill.sources import io

SCHEMA = "uid string, title string, company string, domain string, text_for_bertopic string, p_rnd double, embedding array<double>"


def rows_of(spark):
    words = ("cell assay culture protein sample", "driver route truck delivery parcel")
    rows = [(f"u{i:02d}", f"t{i}", "c", "bio" if i % 2 else "Biotech", " ".join([words[i % 2]] * 8), 0.9, [float(i % 2) * 10 + i % 5 / 10, i % 3 / 10, i % 7 / 10, 0.1 * i, 1.0, 0.0]) for i in range(40)]
    rows += [("x1", "t", "c", "bio", "short", 0.9, [0.0] * 6), ("x2", "t", "c", "bio", rows[0][4], 0.1, [0.0] * 6), ("x3", "t", "c", "bio", rows[0][4], None, [0.0] * 6), ("x4", "t", "c", "bio", rows[0][4], 0.9, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_topics_end_to_end(spark, tmp_path):
    cfg = Config(embedding_model="m", label_examples=2, label_chars=20)
    found = pipeline.run_topics(rows_of(spark), cfg, "embedding", 2, "bio")
    meta = found["metadata"].first().asDict()
    assert list(meta) == ["n_before_all_filters", "n_after_len_core_filter", "n_after_sampling", "n_topics", "mode", "domain", "embedding_model", "bertopic_len_text_min", "bertopic_p_rnd_cutoff", "bertopic_require_label_weak"]
    assert (meta["n_before_all_filters"], meta["n_after_len_core_filter"], meta["n_after_sampling"], meta["n_topics"]) == (44, 40, 40, 2)
    paths = pipeline.export_topics(found, f"file://{tmp_path}/topics")
    assert json.loads(spark.read.text(paths["metadata"]).first()[0])["n_topics"] == 2
    assert spark.read.csv(paths["projection"], header=True).filter("x is not null and y is not null").count() == 40
    table = io.read_any(spark, paths["topics"]).withColumn("topic_id", F.col("topic_id").cast("int"))
    rows = io.read_any(spark, paths["rows"]).withColumn("topic_id", F.col("topic_id").cast("int"))
    assert rows.count() == 40 and table.agg(F.sum("n_docs")).first()[0] == rows.filter("topic_id <> -1").count()
    seen = []

    def call(payload):
        seen.append(json.loads(payload))
        return json.dumps({"label": "Lab", "label_long": "Laboratory", "confidence": 7}) if "cell" in payload else "no JSON"

    out = pipeline.label_topics(table, rows, cfg, call)
    labels = {(r["topic_label"], r["topic_label_confidence"]) for r in out["topics_labeled"].collect()}
    assert labels == {("Lab", 1.0), ("no JSON", 0.5)}
    assert all(len(p["examples"]) == 2 and all(len(e) == 24 for e in p["examples"]) for p in seen)
    assert [r["topic_label"] for r in out["low_confidence"].collect()] == ["no JSON"]
    flat = out["flat_labeled"]
    assert flat.count() == 40 and flat.filter("topic_id = -1 and topic_label is not null").isEmpty()


def test_no_rows_left(spark):
    with pytest.raises(ValueError):
        pipeline.run_topics(rows_of(spark).filter("uid like 'x%'"), Config(), "embedding", 2)


def test_projection_keeps_rows_without_vector(spark):
    found = topics.project(rows_of(spark), "embedding")
    assert found.count() == 44 and [r["uid"] for r in found.filter("x is null").collect()] == ["x4"]
    assert topics.project(rows_of(spark).limit(0), "embedding").count() == 0


@pytest.mark.parametrize(
    "answer, expected",
    [
        (None, ("a", "Topic 3: a, b", 0.5)),
        ("", ("a", "Topic 3: a, b", 0.5)),
        ("[1, 2]", ("[1, 2]", "Topic 3: a, b", 0.5)),
        ('{"label": "  ", "confidence": "x"}', ("a", "Topic 3: a, b", 0.7)),
        ('{"label": "L", "label_long": "LL", "confidence": -2}', ("L", "LL", 0.0)),
    ],
)
def test_sanitize_label(answer, expected):
    assert topics.sanitize_label(answer, 3, "a, b") == expected


def test_unescape(spark):
    given = ["a &amp; b", "é &eacute;", "&lt;p&gt;", "plain", "", None, "&#x41;&unknown;", "& " * 5000]
    df = ship(spark).createDataFrame(list(enumerate(given)), "i int, t string").select("i", text.unescape(F.col("t")).alias("u"))
    assert {r["i"]: r["u"] for r in df.collect()} == {i: None if t is None else html.unescape(unicodedata.normalize("NFC", t)) for i, t in enumerate(given)}


def test_history_and_latex(tmp_path):
    path = f"{tmp_path}/history.json"
    assert io.read_history(path) == {}
    io.write_history(path, {"n": 3})
    assert io.read_history(path) == {"n": 3}
    body = io.latex_summary([("date_rate %", 99.346, None), ("rows", 50411, 10379)])
    assert r"date rate \% & 99.35 & -- \\" in body and r"rows & 50,411 & 10,379 \\" in body


def test_csv_of_nulls_and_nested_values(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, [0.5], ["a", "b"]), (2, 1.5, None, None)], "i int, d double, v array<double>, w array<string>")
    lines = sorted(r[0] for r in spark.read.text(io.write_csv(rows, f"file://{tmp_path}/t")).collect())
    assert "1,,[0.5],\"a, b\"" in lines and "2,1.50000000,," in lines
