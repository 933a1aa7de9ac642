"""Skill phrases: TF-IDF terms, RAKE phrases, grounding in the source text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import norm

BROADCAST_BYTES = 64 << 20
TOKEN = r"\b[A-Za-z][A-Za-z0-9+\-.#]+\b"


def terms(df: DataFrame, row_id: str, text: str, stop_words: list[str] | None = None, longest: int = 3, keep_symbols: bool = False) -> DataFrame:
    """(row_id, term) for each n-gram of the tokens that aren't stop words."""
    stop = fixed.STOP_WORDS if stop_words is None else stop_words
    pattern = r"[A-Za-z][A-Za-z0-9+\-.#]+" if keep_symbols else TOKEN
    words = F.filter(F.regexp_extract_all(norm(F.col(text)), F.lit(pattern), F.lit(0)), lambda w: ~w.isin(*stop))
    # words move once, by row: counts, norms and ranks of a row's terms then need no exchange of n-grams. The number is
    # given, as adaptive execution would merge partitions by the size of the words, not of the n-grams they become
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with_words = df.select(row_id, words.alias("w")).repartition(wide, row_id)

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    return with_words.select(row_id, F.explode(F.concat(*[grams(n) for n in range(1, longest + 1)])).alias("term"))


def tfidf_top(df: DataFrame, row_id: str, text: str, k: int = 15, max_features: int = 200_000, **options) -> DataFrame:
    """(row_id, rank, term, weight): smooth idf ``ln((1+n)/(1+df)) + 1``, L2 norm, the k heaviest of each row."""
    tf = terms(df, row_id, text, **options).groupBy(row_id, "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("total"), "term").limit(max_features).select("term", "n_rows").persist()
    # at most max_features terms, but a term may be of any length: broadcast only after its size is known
    size = vocabulary.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    n = df.agg(F.count(F.lit(1)).alias("n_all"))
    weighed = tf.join(F.broadcast(vocabulary) if size <= BROADCAST_BYTES else vocabulary, "term").join(F.broadcast(n)).withColumn("raw", F.col("tf") * (F.log((1 + F.col("n_all")) / (1 + F.col("n_rows"))) + 1))
    of_row = Window.partitionBy(row_id)
    ranked = weighed.withColumn("length", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(of_row))).withColumn("rank", F.row_number().over(of_row.orderBy(F.desc(F.round("raw", 9)), "term")))
    return ranked.filter(F.col("rank") <= k).select(row_id, "rank", "term", (F.col("raw") / F.col("length")).alias("weight"))


def rake(df: DataFrame, row_id: str, text: str, stop_words: list[str] | None = None, k: int = 15) -> DataFrame:
    """(row_id, rank, phrase, score): runs of words between stop words, words scored by (degree + frequency) / frequency."""
    stop = fixed.STOP_WORDS if stop_words is None else stop_words
    words = F.filter(F.split(norm(F.col(text)), r"[^A-Za-z0-9+\-.#]+"), lambda w: w != "")
    at = df.select(row_id, F.posexplode(words).alias("pos", "word")).withColumn("stop", F.col("word").isin(*stop).cast("int"))
    island = F.sum("stop").over(Window.partitionBy(row_id).orderBy("pos"))
    runs = at.withColumn("island", island).filter("stop = 0")
    in_run = Window.partitionBy(row_id, "island")
    runs = runs.withColumn("length", F.count(F.lit(1)).over(in_run))
    in_word = Window.partitionBy(row_id, "word")
    scored = runs.withColumn("word_score", F.sum("length").over(in_word) / F.count(F.lit(1)).over(in_word))
    phrases = scored.groupBy(row_id, "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.sum("word_score").alias("score"), F.min("pos").alias("pos"))
    phrases = phrases.filter(F.length("phrase") >= 3).withColumn("score", F.round("score", 9))
    top = phrases.withColumn("place", F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc("score"), "pos"))).filter(F.col("place") <= k)
    first = top.groupBy(row_id, "phrase").agg(F.min("place").alias("place"), F.max("score").alias("score"))
    return first.select(row_id, F.row_number().over(Window.partitionBy(row_id).orderBy("place")).cast("int").alias("rank"), "phrase", "score")


def ordered_distinct(items: Column) -> Column:
    """Phrases once each by their normal form, blank ones dropped, in their order."""
    named = F.filter(F.transform(items, lambda x: F.struct(norm(x).alias("n"), F.trim(x).alias("x"))), lambda s: s["n"] != "")
    start = F.array().cast("array<struct<n:string,x:string>>")
    once = F.aggregate(named, start, lambda acc, s: F.when(F.exists(acc, lambda a: a["n"] == s["n"]), acc).otherwise(F.concat(acc, F.array(s))))
    return F.transform(once, lambda s: s["x"])


def variants(phrase: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """A normalised phrase and what its alias groups hold."""
    aliases = fixed.SKILL_ALIASES if aliases is None else aliases
    out = F.array(phrase)
    for canon, values in aliases.items():
        group = sorted({canon, *values})
        out = F.when(phrase.isin(*group), F.array_union(out, F.array(*map(F.lit, group)))).otherwise(out)
    return out


def _bounded(text: Column, phrase: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"(^|[^A-Za-z0-9])\Q"), phrase, F.lit(r"\E([^A-Za-z0-9]|$)")))


def _in_order(text: Column, phrase: Column) -> Column:
    """Whether the phrase's words stand in the text one after another; each search begins where the last ended."""
    words = F.regexp_extract_all(phrase, F.lit(r"[a-z0-9][a-z0-9+\-.#]*"), F.lit(0))

    def step(rest: Column, w: Column) -> Column:
        pattern = F.concat(F.lit(r"^(?s).*?(?:^|[^A-Za-z0-9])\Q"), w, F.lit(r"\E(?:[^A-Za-z0-9]|$)"))
        return F.when(rest.isNotNull() & F.regexp_like(rest, pattern), F.regexp_replace(rest, pattern, F.lit("")))

    return (F.size(words) > 0) & F.aggregate(words, text, step).isNotNull()


def grounded(text: Column, phrase: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Whether a phrase, or an alias of it, stands in the text: whole, or word by word in order."""
    t = norm(text)
    return F.exists(variants(norm(phrase), aliases), lambda v: (v != "") & (_bounded(t, v) | _in_order(t, v)))


def grounded_literal(normalised: Column, phrase: str, aliases: dict[str, list[str]] | None = None) -> Column:
    """``grounded`` for a phrase that is known: its patterns are constants, tried only where all its words stand.

    ``normalised`` is the text's normal form; a null or empty text grounds nothing, nor does a blank phrase.
    """
    aliases = fixed.SKILL_ALIASES if aliases is None else aliases
    phrase = " ".join(phrase.lower().split())
    spelled = sorted({phrase} | {v for canon, values in aliases.items() if phrase in {canon, *values} for v in {canon, *values}})
    edge, end = "(?:^|[^A-Za-z0-9])", "(?:[^A-Za-z0-9]|$)"
    out = F.lit(False)
    for v in filter(None, spelled):
        words = re.findall(r"[a-z0-9][a-z0-9+\-.#]*", v)
        found = normalised.contains(v) & normalised.rlike(f"{edge}\\Q{v}\\E{end}")
        if len(words) > 1:
            # each word begins where the last one's end mark stood, or after a later mark
            ordered = normalised.rlike("(?s)" + edge + f"{end}(?:.*?[^A-Za-z0-9])?".join(f"\\Q{w}\\E" for w in words) + end)
            for w in words:
                ordered = normalised.contains(w) & ordered
            found = found | ordered
        elif words and words != [v]:
            found = found | (normalised.contains(words[0]) & normalised.rlike(f"{edge}\\Q{words[0]}\\E{end}"))
        out = out | found
    return out


def combine(df: DataFrame, text: str, lists: list[str], most: int = 25) -> DataFrame:
    """Adds skills_grounded and skills_ungrounded from candidate lists in their order, and the sanity flag for excel."""
    items = ordered_distinct(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists]))
    marked = F.transform(items, lambda x: F.struct(x.alias("x"), grounded(F.col(text), x).alias("good")))
    df = df.withColumn("_items", marked)  # each phrase is judged once
    good, rest = (F.slice(F.transform(F.filter("_items", keep), lambda m: m["x"]), 1, most) for keep in (lambda m: m["good"], lambda m: ~m["good"]))
    df = df.withColumn("skills_grounded", good).withColumn("skills_ungrounded", rest).drop("_items")
    flag = F.lower(F.array_join("skills_grounded", ", ")).contains("excel") & ~grounded_literal(norm(F.col(text)), "excel")
    return df.withColumn("sanity_flag_excel_like", flag)


def skill_metrics(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"),
        F.avg(F.size("skills_grounded")).alias("avg_grounded_skills"),
        F.avg(F.size("skills_ungrounded")).alias("avg_ungrounded_candidates"),
        F.try_divide(100.0 * F.count_if(F.size("skills_grounded") > 0), n).alias("pct_rows_with_any_grounded_skills"),
        F.count_if("sanity_flag_excel_like").alias("n_rows_flagged_excel_like"),
        F.try_divide(100.0 * F.count_if("sanity_flag_excel_like"), n).alias("pct_rows_flagged_excel_like"),
    )


def with_parser(df: DataFrame, text: str, parse: Callable[[list[str]], list[tuple[list[str], list[str]]]] | None) -> DataFrame:
    """Adds noun-phrase skills and responsibilities from a language parser that the caller supplies."""
    if parse is None:
        raise ValueError("no parser: give a function from texts to (skills, responsibilities)")
    schema = df.schema.simpleString()[7:-1] + ",skills_parsed:array<string>,responsibilities:array<string>"

    def run(batches):
        for pdf in batches:
            found = parse([x or "" for x in pdf[text]])
            yield pdf.assign(skills_parsed=[a for a, _ in found], responsibilities=[b for _, b in found])

    return df.mapInPandas(run, schema.replace(":", " "))


