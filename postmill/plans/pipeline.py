"""End-to-end stages over postings: preprocess, full run, quality report, skills, topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import fields, text
from ..operators import dedupe, issues, labels, model, quality, skills, topics
from ..sources import io, schema


def load(spark: SparkSession, cfg: Config) -> DataFrame:
    raw = io.load(spark, cfg.input_path, cfg.combined_path, (cfg.hourly_path, cfg.yearly_path))
    core, _ = schema.coerce(schema.ensure_core_text(schema.normalize_headers(raw)), missing="null")
    return core


def preprocess(df: DataFrame, cfg: Config, unescape: bool = True, lemmatize: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Cleans, derives, drops duplicates, optionally clusters titles, drops short rows. Needs ``row_id``."""
    plain = text.unescape if unescape else lambda c: c
    df = df.withColumn("title_clean", text.clean(plain(F.coalesce("title", F.lit("")))))
    df = df.withColumn("text_for_bertopic", text.clean(plain(F.coalesce("description", F.lit("")))))
    df = df.withColumn("date_posted", fields.robust_date(F.col("date_posted")))
    df = df.withColumns(fields.date_parts(F.col("date_posted"), cfg.reference_date))
    df = df.withColumn("_loc", fields.parse_location(F.col("location")))
    df = df.withColumns({c: F.col(f"_loc.{c}") for c in ("city", "state", "country", "is_remote")}).withColumn("location_parse_quality", F.col("_loc.quality")).drop("_loc")
    middle = fields.salary_midpoint(F.col("min_amount"), F.col("max_amount"))
    df = df.withColumns({"salary_midpoint": middle, "has_salary": middle.isNotNull(), "company_normalized": fields.normalize_company(F.col("company")), "site": fields.canonical_site(F.col("site"))})
    df = df.withColumn("job_title", fields.job_title(F.col("title_clean"), F.col("title"))).withColumn("title_family", fields.title_family(F.col("job_title")))
    if "label_weak" in df.columns:
        df = df.withColumn("label_weak_int", fields.label_int(F.col("label_weak"))).withColumn("label_weak_bool", F.col("label_weak_int") == 1)
    if lemmatize:
        df = lemmatize(df)
    if cfg.max_words:
        df = df.withColumn("text_first_words", text.first_words(F.col("text_for_bertopic"), cfg.max_words))
    hard = next((c for c in ("job_url", "posting_id", "id") if c in df.columns), None)
    df = dedupe.dedupe_two_phase(df, "row_id", hard, F.col("company"), F.col("title"), F.col("text_for_bertopic"))
    base = next((F.col(c) for c in ("uid", "id") if c in df.columns), F.col("row_id"))
    df = df.withColumn("uid", text.make_uid(base, text.norm(F.col("title")))).withColumn("token_count", text.token_count(F.col("text_for_bertopic")))
    if cfg.fuzzy_titles:
        df = dedupe.fuzzy_titles(df, "job_title", "row_id", cfg.fuzzy_similarity, cfg.fuzzy_scorer)
        if cfg.fuzzy_collapse:
            df = dedupe.collapse_titles(df, "row_id", cfg.fuzzy_keep, "date_posted", cfg.fuzzy_columns)
    return df.filter(F.col("token_count") >= cfg.min_tokens)


def weakly_labeled(df: DataFrame, cfg: Config) -> DataFrame:
    return labels.weak_labels(df, F.col("title_clean"), F.col("text_for_bertopic"), cfg.positive_titles, cfg.positive_descriptions, cfg.negative_titles, cfg.rule)


def train_and_score(df: DataFrame, cfg: Config) -> tuple[DataFrame, model.CalibratedClassifier]:
    rows = df.withColumn("_model_text", text.model_text(F.col("title"), F.col("text_for_bertopic")))
    fitted = model.train(rows, "_model_text", "label_weak", "uid", cfg.model_kind, cfg.mode)
    return fitted.score(rows, "_model_text").drop("_model_text"), fitted


def run_all(spark: SparkSession, cfg: Config) -> dict[str, str]:
    """Load, preprocess, label, score, split, export; the model is saved too."""
    rows = weakly_labeled(preprocess(load(spark, cfg), cfg), cfg).persist()
    scored, fitted = train_and_score(rows, cfg)
    kept, dropped = labels.split_rows(scored, tau=cfg.tau, min_tokens=cfg.min_tokens)
    paths = io.export_all(kept, cfg.out_dir, dropped)
    fitted.save(f"{cfg.out_dir}/model")
    rows.unpersist()
    return {**paths, "model": f"{cfg.out_dir}/model"}


def quality_report(before: DataFrame, after: DataFrame, row_id: str = "row_id", key: str = "id", uid: str | None = "uid") -> dict[str, DataFrame]:
    """All of the report's tables."""
    core = [c for c in ("title", "company", "location", "description", "date_posted") if c in before.columns and c in after.columns]
    checks = lambda df: {n: (c if n2 in df.columns else None) for (n, n2), c in zip((("date", "date_posted"), ("location", "location"), ("domain", "domain")), quality.validity_checks("date_posted", "location", "domain").values(), strict=True)}

    def metrics(df: DataFrame) -> DataFrame:
        rules = {"title": quality.title_consistent("title", "title_clean")} if {"title", "title_clean"} <= set(df.columns) else {}
        parts = [quality.completeness(df, core), quality.validity(df, checks(df)), quality.uniqueness(df, uid or key), quality.consistency(df, rules)]
        if "date_posted" in df.columns:
            parts.append(quality.timeliness(df, quality.robust_date(F.col("date_posted"))).select("parse_rate"))
        out = parts[0]
        for p in parts[1:]:
            out = out.join(F.broadcast(p))  # one row each
        return out

    b, a = metrics(before), metrics(after)
    names = [c for c in b.columns if c in a.columns]
    flagged = quality.bad_rows(before, row_id, core, key, "job_url", "date_posted", "location", "domain")
    return {
        "metrics": quality.metric_table(b, a, names),
        "precision_recall": quality.precision_recall(flagged, after, key, uid if uid in after.columns else None),
        "issues_fixed": quality.issues_fixed(before, after, core, key if key in before.columns and key in after.columns else None),
    }


def select_uncertain(kept: DataFrame, dropped: DataFrame, n: int = 5000, low: float = 0.2, high: float = 0.9) -> DataFrame:
    return issues.uncertain(io.tagged_pair(kept, dropped), "label_weak", "p_rnd", "uid", n, low, high)


def extract_skills(df: DataFrame, row_id: str = "uid", parse=None) -> tuple[DataFrame, DataFrame]:
    """Skill lists of each row, and their metrics; a language parser is the caller's."""
    column = next((c for c in ("text_for_bertopic", "description") if c in df.columns), None)
    if column is None:
        raise ValueError("no text column: text_for_bertopic or description")
    listed = lambda t, word, name: t.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", word))), lambda x: x[word]).alias(name))
    rows = df.join(listed(skills.tfidf_top(df, row_id, column), "term", "skills_tfidf"), row_id, "left").join(listed(skills.rake(df, row_id, column), "phrase", "skills_rake"), row_id, "left")
    lists = ["skills_tfidf", "skills_rake"]
    if parse is not None:
        rows, lists = skills.with_parser(rows, column, parse), [*lists, "skills_parsed"]
    rows = skills.combine(rows, column, lists)
    return rows, skills.skill_metrics(rows)


def run_topics(df: DataFrame, cfg: Config, vector: str, k: int, domain: str | None = None, most: int | None = None, row_id: str = "uid") -> dict[str, DataFrame]:
    """Filters, samples, clusters and describes rows that have a vector.

    Null vectors leave before the fit; an error where no row is left. Tables: topics, rows, flat, projection, metadata.
    """
    rows = labels.domain_filter(df, "domain", domain)
    loaded = rows
    body = text.topic_text(cfg.topic_text_mode, F.col("text_for_bertopic"), **{n: F.col(c) for n, c in (("title", "title"), ("domain", "domain"), ("seniority", "seniority"), ("function", "job_function"), ("description", "text_for_bertopic")) if c in df.columns})
    label = F.col("label_weak") if "label_weak" in df.columns else None
    rows = rows.withColumn("topic_text", body).filter(labels.topic_filter(F.col("topic_text"), F.col("p_rnd"), label, cfg.topic_min_chars, cfg.topic_cutoff, cfg.topic_use_label)).filter(F.col(vector).isNotNull())
    if rows.isEmpty():
        raise ValueError("no rows are left after the topic filter")
    sampled = topics.subsample(rows, row_id, most) if most else rows
    fitted = topics.fit_topics(sampled, vector, k)
    weights = topics.class_tfidf(topics.class_words(fitted, "topic_id", "topic_text", skills.fixed.STOP_WORDS))
    table = topics.topics_table(fitted, "topic_id", weights)
    settings = {
        "mode": cfg.mode, "domain": domain or "", "embedding_model": cfg.embedding_model, "bertopic_len_text_min": cfg.topic_min_chars,
        "bertopic_p_rnd_cutoff": cfg.topic_cutoff, "bertopic_require_label_weak": cfg.topic_use_label,
    }
    return {
        "topics": table, "rows": fitted.drop(vector), "flat": io.project(fitted, io.FLAT), "metadata": topics.run_metadata(loaded, rows, sampled, table, **settings),
        "projection": topics.project(fitted, vector).select(row_id, "topic_id", "x", "y"),
    }


def export_topics(found: dict[str, DataFrame], out: str) -> dict[str, str]:
    """Topics, rows, flat rows and projection as CSV; metadata as one JSON line."""
    paths = {name: io.write_csv(io.public_columns(found[name].orderBy("topic_id") if name == "topics" else found[name]), f"{out}/{name}") for name in ("topics", "rows", "flat", "projection")}
    return {**paths, "metadata": io.write_jsonl(found["metadata"], f"{out}/metadata", compressed=False)}


def label_topics(table: DataFrame, rows: DataFrame, cfg: Config, call: Callable[[str], str] | None, row_id: str = "uid") -> dict[str, DataFrame]:
    """Labels of topics by ``call`` (the fallback without one), the rows with their topic's label, and the labels to look at.

    ``cfg`` gives how many examples of how many characters a payload holds.
    """
    payloads = topics.prompt_payloads(table, rows.withColumn("_text", F.coalesce(*[F.col(c) for c in ("topic_text", "text_for_bertopic") if c in rows.columns])), row_id, "_text", cfg.label_examples, cfg.label_chars)
    labeled = topics.label_topics(table, payloads, call)
    names = labeled.select("topic_id", "topic_label", "topic_label_long", "topic_label_confidence")
    return {"topics_labeled": labeled, "flat_labeled": topics.with_labels(io.project(rows, io.FLAT), names), "low_confidence": topics.low_confidence(labeled)}
