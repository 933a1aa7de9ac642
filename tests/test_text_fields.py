import pytest
from pyspark.sql import functions as F

from postmill.functions import fields, text
from postmill.sources import io, schema


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("r")).first()["r"]


US, UK = "United States", "United Kingdom"
LOCATIONS = [
    (None, None, None, None, False, "missing"),
    ("", None, None, None, False, "empty"),
    ("nan", None, None, None, False, "empty"),
    (",", None, None, None, False, "empty"),
    ("Remote", None, None, None, True, "remote_only"),
    ("Remote, USA", None, None, US, True, "remote_with_region"),
    ("Remote - CA", None, "CA", US, True, "remote_with_region"),
    ("Remote, Boston", None, None, None, True, "remote_only"),
    ("Canada", None, None, "Canada", False, "country_only"),
    ("tx", None, "TX", US, False, "state_only"),
    ("Boston", None, "Boston", None, False, "single_token_ambiguous"),
    ("Boston, MA", "Boston", "MA", US, False, "city_state"),
    ("London, UK", "London", None, UK, False, "city_country"),
    ("Paris, France", "Paris", "France", None, False, "city_region_ambiguous"),
    ("Austin, TX, USA", "Austin", "TX", US, False, "city_state_country"),
    ("Austin, TX, 78701", "Austin", "TX", US, False, "city_state_assumed_us"),
    ("Winston-Salem, NC", "Winston", "Salem", "NC", False, "multi_part_unverified"),
    ("Hybrid, Boston, MA", "Hybrid", "Boston", "MA", True, "multi_part_unverified"),
]


def test_parse_location(spark):
    rows = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LOCATIONS)], "i int, c string").select("i", fields.parse_location(F.col("c")).alias("r")).orderBy("i").collect()
    assert [tuple(r["r"]) for r in rows] == [x[1:] for x in LOCATIONS]


@pytest.mark.parametrize(("given", "expected"), [("Acme, Inc.", "acme"), ("Co", None), ("L'Oréal Company", "oréal"), (None, None)])
def test_company(spark, given, expected):
    assert one(spark, given, fields.normalize_company) == expected


@pytest.mark.parametrize(("given", "expected"), [("Senior Data Scientist", "Data Scientist"), ("scientist", "Research Scientist"), ("backend engineer", "Software Engineer"), ("PM", "Project / Program Manager"), ("nurse", "Other"), (None, None)])
def test_title_family(spark, given, expected):
    assert one(spark, given, fields.title_family) == expected


@pytest.mark.parametrize(("given", "expected"), [("45291", "2023-12-31"), ("2024-01-02", "2024-01-02"), ("19999", None), ("abc", None), (None, None)])
def test_robust_date(spark, given, expected):
    found = one(spark, given, fields.robust_date)
    assert (found and str(found.date())) == expected


def test_salary(spark):
    rows = spark.createDataFrame([(10.0, 20.0), (10.0, None), (None, 20.0), (None, None)], "a double, b double")
    assert [r[0] for r in rows.select(fields.salary_midpoint(F.col("a"), F.col("b"))).collect()] == [15, 10, 20, None]


def test_site_and_title_case(spark):
    assert one(spark, " LinkedIn ", fields.canonical_site) == "LinkedIn"
    assert one(spark, "ab-cd o'neil", fields.canonical_site) == "Ab-Cd O'Neil"


def test_clean(spark):
    assert one(spark, "See https://x.y/z <b>Now</b> • --- • A -- B\n c", text.clean) == "see now a - b c"
    assert one(spark, None, text.clean) == ""
    cleaned = one(spark, "A  b • … <i>", text.clean)
    assert one(spark, cleaned, text.clean) == cleaned


def test_unescape(spark):
    assert one(spark, "a &lt;b&gt; é", text.unescape) == "a <b> é"


def test_tokens(spark):
    assert one(spark, "", text.token_count) == 0
    assert one(spark, " a  b ", text.token_count) == 2


def test_topic_text_mode(spark):
    with pytest.raises(ValueError):
        text.topic_text("other", F.lit("x"))


def test_headers_and_coercion(spark):
    df = spark.createDataFrame([("t", None, "Boston", "12", "x")], "`Job Title` string, city string, location string, min_salary string, max_salary string")
    named = schema.normalize_headers(df)
    assert set(named.columns) == {"title", "location", "min_amount", "max_amount"}
    assert named.first()["location"] == "Boston"
    with pytest.raises(ValueError):
        schema.coerce(named)
    core, violations = schema.coerce(named, missing="null")
    assert core.first()["min_amount"] == 12.0
    assert [tuple(r) for r in violations.collect()] == [("max_amount", "x", 1)]


def test_union_and_domain(spark):
    a = spark.createDataFrame([("bio_x.csv", 1)], "`Source.Name` string, a int")
    b = spark.createDataFrame([(2,)], "b int")
    rows = io.with_domain(io.union_by_name([a, b], "row_id"))
    assert sorted((r["domain"], r["a"], r["b"]) for r in rows.collect() if r["domain"]) == [("bio", 1, None)]
    assert rows.select("row_id").distinct().count() == 2


def test_io_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u1", "acme", 1.5, None), ("u2", None, float("nan"), 2.0)], "uid string, company string, min_amount double, max_amount double")
    paths = io.export_all(df, f"file://{tmp_path}")
    back = spark.read.json(paths["kept_jsonl"]).orderBy("uid").collect()
    assert back[0]["min_amount"] == 1.5 and back[1]["min_amount"] is None
    with pytest.raises(ValueError):
        io.read_any(spark, "x.unknown")
    with pytest.raises(FileNotFoundError):
        io.resolve(spark, str(tmp_path / "none.csv"))
