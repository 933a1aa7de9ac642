import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.config import Config
from postmill.functions import fixed
from postmill.operators import dedupe, issues, labels, quality, skills, topics


def test_hard_id_nulls(spark):
    df = spark.createDataFrame([(1, "u1"), (2, "u1"), (3, None), (4, None)], "row_id long, job_url string")
    df = df.withColumns({"company": F.lit("c"), "title": F.col("row_id").cast("string"), "text": F.lit("t")})
    run = lambda **k: sorted(r[0] for r in dedupe.dedupe_two_phase(df, "row_id", "job_url", F.col("company"), F.col("title"), F.col("text"), **k).collect())
    assert run() == [1, 3]
    assert run(null_policy="keep") == [1, 3, 4]


def test_dedupe_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "row_id long, k long")
    found = [sorted(map(tuple, dedupe.first_by(df.repartition(n), F.col("k"), F.col("row_id")).collect())) for n in (1, 8)]
    assert found[0] == found[1] == [(i, i) for i in range(7)]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_indel_ratio(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    expected = 100.0 if not a and not b else 200.0 * t[-1][-1] / (len(a) + len(b))
    assert dedupe.indel_ratio(a, b) == pytest.approx(expected)


def test_fuzzy_titles(spark):
    df = spark.createDataFrame([(1, "Data Scientist"), (2, "Scientist, Data"), (3, "scientist data"), (4, "Nurse")], "row_id long, title string")
    rows = {r["row_id"]: r for r in dedupe.fuzzy_titles(df, "title", "row_id", 90).collect()}
    assert rows[3]["title_canonical"] == rows[1]["title_canonical"] == "data scientist"
    assert rows[4]["title_cluster_size"] == 1
    collapsed = dedupe.collapse_titles(dedupe.fuzzy_titles(df, "title", "row_id", 90), "row_id")
    assert sorted(r["row_id"] for r in collapsed.collect()) == [1, 4]


CASES = [("senior scientist", None, 1, 1, 0, 1), ("sales scientist", None, 0, 1, 1, 0), ("lab technician", None, 1, 1, 0, 0), ("lab technician", "pcr", 1, 1, 0, 1), ("clerk", "hplc assay", 1, 1, 0, 0), ("driver", "pcr", 0, 1, 1, 0)]


def test_weak_labels(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, title string, text string")
    rows = labels.weak_labels(df, F.col("title"), F.col("text")).orderBy("i").collect()
    assert [(r["label_weak"], r["pos_matches"], r["neg_matches"]) for r in rows] == [c[2:5] for c in CASES]
    strict = labels.weak_labels(df, F.col("title"), F.col("text"), rule="strict").orderBy("i").collect()
    assert [r["label_weak"] for r in strict] == [c[5] for c in CASES]


def test_split(spark):
    words = "w " * 20
    df = spark.createDataFrame([(0.10, 1, words), (0.10, 0, words), (0.15, 1, words), (0.10, 1, "w " * 10), (None, 1, words)], "p_rnd double, neg_matches int, text_for_bertopic string")
    kept, dropped = labels.split_rows(df)
    assert (kept.count(), dropped.count()) == (4, 1)


def test_rake(spark):
    df = spark.createDataFrame([(1, "lead pcr assays and cell culture for pcr assays")], "i long, t string")
    assert [(r["phrase"], r["score"]) for r in skills.rake(df, "i", "t").orderBy("rank").collect()] == [("lead pcr assays", 8.0), ("pcr assays", 5.0), ("cell culture", 4.0)]


def test_terms(spark):
    df = spark.createDataFrame([(1, "c++ and c# t-sql node.js r sql.")], "i long, t string")
    found = [r["term"] for r in skills.terms(df, "i", "t", stop_words=[], longest=1).collect()]
    assert sorted(found) == ["and", "node.js", "sql", "t-sql"]


def test_grounding(spark):
    df = spark.createDataFrame([("uses power pivot and bi tools; t-sql",)], "t string")
    ok = lambda p: df.select(skills.grounded(F.col("t"), F.lit(p))).first()[0]
    assert ok("power bi") and ok("SQL") and not ok("excel") and not ok("bi power") and not ok("")


def test_parser_is_asked_for(spark):
    with pytest.raises(ValueError):
        skills.with_parser(spark.createDataFrame([("a",)], "t string"), "t", None)


def test_quality_arithmetic(spark):
    df = spark.createDataFrame([("2024-01-01", "Boston, MA"), ("45291", "remote")], "date_posted string, location string")
    assert quality.validity(df, {**quality.validity_checks("date_posted", "location"), "domain": None}).first()[0] == pytest.approx(66.6667, abs=1e-3)
    keys = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert quality.uniqueness(keys, "k").first()[0] == pytest.approx(33.3333, abs=1e-3)
    assert quality.uniqueness(keys, "absent").first()[0] == 0
    before = spark.createDataFrame([(None, 1)] * 5 + [(1, None)], "a int, b int")
    after = spark.createDataFrame([(None, None)] * 2 + [(1, None)], "a int, b int")
    assert {r["issue"]: r["fixed"] for r in quality.issues_fixed(before, after, ["a", "b"]).collect()} == {"nulls:a": 3, "nulls:b": 0}
    assert quality.timeliness(df.filter("false"), quality.robust_date(F.col("date_posted"))).first()["flag"] == "all_unparseable"


def test_precision_recall(spark):
    flagged = spark.createDataFrame([(i, i < 6) for i in range(10)], "id long, bad boolean")
    after = spark.createDataFrame([(i,) for i in (3, 4, 5, 7, 8, 9)], "id long")
    r = quality.precision_recall(flagged, after, "id").first()
    assert (r["removed"], r["both"], r["precision"], r["recall"]) == (4, 3, 75.0, 50.0)


def test_label_issues_on_separable_data(spark):
    df = spark.createDataFrame([(i, int(i < 50) if i != 7 else 0, 0.9 if i < 50 else 0.1) for i in range(100)], "id long, y int, p double")
    assert [r["id"] for r in issues.ranked_issues(df, "y", "p", "id").collect()] == [7]
    assert [r["id"] for r in issues.false_negative_mask(df, "y", "p", "id").filter("likely_fn").collect()] == [7]


def test_label_sanitising(spark):
    assert topics.sanitize_label("not json", 7, "a b, c") == ("not json", "Topic 7: a b, c", 0.5)
    assert topics.sanitize_label('{"label": "", "confidence": 1.7}', 7, "a b, c") == ("a b", "Topic 7: a b, c", 1.0)
    assert topics.sanitize_label('{"label": "x", "confidence": "x"}', 7, "a b, c")[2] == 0.7
    table = spark.createDataFrame([(7, "a b, c", 3)], "topic_id int, top_words string, n_docs long")
    payloads = spark.createDataFrame([(7, '{"examples":["x"]}')], "topic_id int, payload string")

    def broken(_):
        raise RuntimeError

    assert topics.label_topics(table, payloads, broken).first()["topic_label_confidence"] == 0.0
    assert topics.label_topics(table, payloads, None).first()["topic_label"] == "a b"


def test_config():
    cfg = Config.from_env({"POSTMILL_FUZZY_TITLES": "Yes", "POSTMILL_MIN_TOKENS": "3", "POSTMILL_MODE": "slow"})
    assert (cfg.fuzzy_titles, cfg.min_tokens, cfg.mode) == (True, 3, "precise")
    assert len(set(fixed.POSITIVE_TITLES)) == len(fixed.POSITIVE_TITLES) == 100 and len(fixed.POSITIVE_DESCRIPTIONS) == 31 and len(fixed.NEGATIVE_TITLES) == 35
