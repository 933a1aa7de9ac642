"""Field expressions: locations, companies, sites, title families, dates, pay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import squeeze


def _null() -> Column:
    return F.lit(None).cast("string")


def _lookup(table: dict[str, str], c: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def parse_location(c: Column, states: list[str] | None = None, countries: dict[str, str] | None = None) -> Column:
    """A struct of city, state, country, is_remote and quality."""
    states, countries = states or fixed.STATES, countries or fixed.COUNTRIES
    state_list = "|".join(states)
    raw = F.trim(c)
    low = F.lower(raw)
    remote = low.rlike(r"\b(remote|work\s*from\s*home|wfh|hybrid)\b")
    plain = squeeze(F.regexp_replace(raw, r"\s*[-/|]\s*", ", "))
    tail = F.btrim(F.regexp_replace(plain, r"(?i)\bremote\b[:, ]*", ""), F.lit(" ,"))
    tail_country = _lookup(countries, F.lower(tail))
    tail_state = F.when(F.length(tail) <= 4, F.nullif(F.regexp_extract(tail, rf"\b({state_list})\b", 1), F.lit("")))
    parts = F.filter(F.transform(F.split(plain, ","), lambda x: F.trim(x)), lambda x: x != "")
    n, last = F.size(parts), F.try_element_at(parts, F.lit(-1))
    one, two = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    is_state = lambda x: F.upper(x).isin(*states)

    def out(city, state, country, is_remote, quality) -> Column:
        return F.struct(
            (_null() if city is None else city).alias("city"),
            (_null() if state is None else state).alias("state"),
            (_null() if country is None else country).alias("country"),
            (F.lit(is_remote) if isinstance(is_remote, bool) else is_remote).alias("is_remote"),
            F.lit(quality).alias("quality"),
        )

    us = F.lit("United States")
    region = F.coalesce(tail_country, F.when(tail_state.isNotNull(), us))
    return (
        F.when(c.isNull(), out(None, None, None, False, "missing"))
        .when((raw == "") | low.isin("nan", "none", "null"), out(None, None, None, False, "empty"))
        .when(remote & low.contains("remote") & region.isNotNull(), out(None, F.when(tail_country.isNull(), tail_state), region, True, "remote_with_region"))
        .when(remote & low.contains("remote"), out(None, None, None, True, "remote_only"))
        .when(n == 0, out(None, None, None, False, "empty"))
        .when((n == 1) & _lookup(countries, F.lower(one)).isNotNull(), out(None, None, _lookup(countries, F.lower(one)), remote, "country_only"))
        .when((n == 1) & is_state(one), out(None, F.upper(one), us, remote, "state_only"))
        .when(n == 1, out(None, one, None, remote, "single_token_ambiguous"))
        .when((n == 2) & is_state(two), out(one, F.upper(two), us, remote, "city_state"))
        .when((n == 2) & _lookup(countries, F.lower(two)).isNotNull(), out(one, None, _lookup(countries, F.lower(two)), remote, "city_country"))
        .when(n == 2, out(one, two, None, remote, "city_region_ambiguous"))
        .when(_lookup(countries, F.lower(last)).isNotNull(), out(one, two, _lookup(countries, F.lower(last)), remote, "city_state_country"))
        .when(is_state(two), out(one, F.upper(two), us, remote, "city_state_assumed_us"))
        .otherwise(out(one, two, last, remote, "multi_part_unverified"))
    )


def normalize_company(c: Column, suffixes: list[str] | None = None) -> Column:
    """Lower case without punctuation and legal suffixes; null where nothing is left."""
    words = F.split(squeeze(F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s]", " ")), " ")
    kept = F.filter(words, lambda x: ~x.isin(*(suffixes or fixed.COMPANY_SUFFIXES)))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def title_case(c: Column) -> Column:
    """Every letter that follows no letter in upper case, others in lower (as in ``ab-cd`` to ``Ab-Cd``)."""
    chars = F.split(F.lower(c), "")
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("after"))
    step = lambda acc, x: F.struct(F.concat(acc["s"], F.when(acc["after"], x).otherwise(F.upper(x))).alias("s"), x.rlike(r"\p{L}").alias("after"))
    return F.aggregate(chars, start, step, lambda acc: acc["s"])


def canonical_site(c: Column, sites: dict[str, str] | None = None) -> Column:
    low = F.lower(F.trim(c))
    return F.coalesce(_lookup(sites or fixed.SITES, low), title_case(low))


def title_family(c: Column, rules: list[tuple[str, str]] | None = None, default: str = "Other") -> Column:
    """The first rule that is found; null for null."""
    rules = fixed.TITLE_FAMILIES if rules is None else rules
    first = F.when(c.isNull(), _null())
    return reduce(lambda acc, rule: acc.when(c.rlike(f"(?i){rule[1]}"), rule[0]), rules, first).otherwise(default)


def robust_date(c: Column) -> Column:
    """Spreadsheet serials (20000 to 80000, days from 1899-12-30) or a date; null for all else, bare numbers too."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    serial = F.try_to_timestamp(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int")).cast("string"))
    fraction = F.round((number - F.floor(number)) * 86400).cast("long")
    moment = F.timestamp_seconds(F.unix_timestamp(serial) + fraction).cast("timestamp_ntz")
    parsed = F.coalesce(text.try_cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in ("M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d")])
    return F.when(number.isNotNull(), F.when(number.between(20000, 80000), moment)).otherwise(parsed)


def date_parts(c: Column, reference: str | None = None) -> dict[str, Column]:
    out = {"date_posted_year": F.year(c), "date_posted_month": F.date_format(c, "yyyy-MM")}
    if reference:
        out["posting_age_days"] = F.datediff(F.lit(reference).cast("date"), c)
    return out


def salary_midpoint(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(F.coalesce(low, high))


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def job_title(title_clean: Column, title: Column) -> Column:
    return F.when(title_clean != "", title_clean).otherwise(title)


def label_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").cast("int"), F.lit(0))
