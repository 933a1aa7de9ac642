"""Quality rules: text statistics as native expressions, and decision lists learned by sequential covering.

The statistics are Spark expressions over the text column alone (no Python on the executors). A list is learned from
labelled statistics on the driver: rules are conjunctions of thresholds, grown on two thirds of the rows by FOIL gain,
pruned on the other third, kept while they are precise there, and emitted as ordered conditional expressions. The
learner sees at most ``FIT_ROWS`` labelled rows, chosen by a hash of their doc_id.

Cases: a null or empty text has no words, so the base rule rejects it; a text of any length is read whole; repeated
rows are judged each for itself; without labels, or with one class only, the list is empty and the base rule alone
decides; an empty table gives no rows; further columns are ignored, or stay with the rows that ``passing`` returns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import columns, work_dir, written

#: Labelled rows that the learner sees at most.
FIT_ROWS = 20_000
SPACES, SYMBOLS, WINDOW = " \t\n\x0b\f\r", "#*$%&|<>", 5
RATES = ("mean_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "mark_rate")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column) -> Column:
    """Words that lie in five-word windows found twice or more in the text, the first included."""

    def positions(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            last = F.size(s) - 1
            at = F.filter(
                F.sequence(F.lit(0), last),
                lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == s[k]["h"])),
            )
            return F.sort_array(F.transform(at, lambda k: s[k]["i"]))

        return let(pairs, twins)

    def covered(at: Column) -> Column:
        return F.when(F.size(at) < 2, F.lit(0)).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(at) - 1, F.lit(1))), F.lit(WINDOW), lambda n, j: n + F.least(F.lit(WINDOW), at[j] - at[j - 1]))
        )

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0)))
        return F.transform(at, lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))

    several = let(words, lambda w: let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(positions(h), covered))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(several)


def text_statistics(text: Column) -> Column:
    """A struct of a text's counts and rates."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("n_distinct"), repeated_words(w).alias("n_repeat")))
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACES) != "")
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup")))
    chars = F.length(_without(text, SPACES))
    less = lambda characters: F.length(text) - F.length(_without(text, characters))

    def together(w: Column) -> Column:
        return let(
            of_lines,
            lambda x: F.struct(
                w["n"].cast("long").alias("n_words"),
                chars.cast("long").alias("word_chars"),
                less(SYMBOLS).cast("long").alias("n_symbols"),
                x["n_dup"].cast("long").alias("n_dup_lines"),
                w["n_repeat"].cast("long").alias("n_repeat_words"),
                F.try_divide(chars.cast("double"), w["n"]).alias("mean_chars"),
                F.try_divide(less(SYMBOLS).cast("double"), w["n"]).alias("symbol_rate"),
                F.try_divide(x["n_dup"].cast("double"), x["n"]).alias("dup_line_rate"),
                F.try_divide(w["n_repeat"].cast("double"), w["n"]).alias("repeat_rate"),
                F.try_divide(w["n_distinct"].cast("double"), w["n"]).alias("distinct_rate"),
                F.try_divide(less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("double"), chars).alias("upper_rate"),
                F.try_divide(less("!?").cast("double"), w["n"]).alias("mark_rate"),
            ),
        )

    return let(of_words, together)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold


def _mask(x: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, t in rule:
        column = x[:, names.index(name)]
        out &= (column <= t) if op == "<=" else (column > t)
    return out


def grow_rule(x: np.ndarray, y: np.ndarray, names: list[str], cuts: list[np.ndarray], longest: int = 4) -> list[Condition]:
    """The conjunction grown by the best FOIL gain at each step; ``y`` is true where a row is to be rejected."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest:
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        if not p or not n:
            break
        now, best = np.log2(p / (p + n)), (1e-9, None)
        for j, name in enumerate(names):
            column = x[inside, j]
            at = np.searchsorted(cuts[j], column, side="left")  # row lies at or below cuts[at]
            below = np.cumsum(np.bincount(at[y[inside]], minlength=len(cuts[j]) + 1))[:-1]
            below_n = np.cumsum(np.bincount(at[~y[inside]], minlength=len(cuts[j]) + 1))[:-1]
            for op, a, b in (("<=", below, below_n), (">", p - below, n - below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(a > 0, a * (np.log2(a / (a + b)) - now), -1.0)
                k = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (float(gain[k]), (name, op, float(cuts[j][k])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _mask(x, names, rule[-1:])
    return rule


def prune_rule(x: np.ndarray, y: np.ndarray, names: list[str], rule: list[Condition]) -> list[Condition]:
    """Drops conditions from the end while the rule's worth (p - n) / (p + n) on the pruning rows doesn't fall."""

    def worth(r: list[Condition]) -> float:
        m = _mask(x, names, r)
        p, n = int(y[m].sum()), int((~y[m]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_list(x: np.ndarray, y: np.ndarray, names: list[str], precision: float = 0.95, support: int = 10, rules: int = 12) -> list[list[Condition]]:
    """Sequential covering: rules in their order; the rows a rule takes are gone for the next."""
    if not len(y) or y.all() or not y.any():
        return []
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) <= 256 else np.unique(np.quantile(x[:, j], np.linspace(0, 1, 257)[1:-1])))
    held = np.arange(len(y)) % 3 == 2
    left, out = np.ones(len(y), bool), []
    while len(out) < rules:
        g, p = left & ~held, left & held
        rule = grow_rule(x[g], y[g], names, cuts)
        if not rule:
            break
        rule = prune_rule(x[p], y[p], names, rule)
        m = _mask(x, names, rule)
        if min(y[m & part].mean() if (m & part).any() else 0.0 for part in (g, p)) < precision or (y & m & left).sum() < support:
            break
        out.append(rule)
        left &= ~m
    return out


def list_expression(rules: list[list[Condition]], of: Callable[[str], Column], default: bool = True) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects."""
    verdict = F.lit(default)
    for rule in reversed(rules):
        holds = F.lit(True)
        for name, op, t in rule:
            value = F.coalesce(of(name), F.lit(0.0))
            holds = holds & ((value <= t) if op == "<=" else (value > t))
        verdict = F.when(holds, F.lit(not default)).otherwise(verdict)
    return verdict


def chosen_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of some ``FIT_ROWS`` labelled rows, by a hash of their doc_id."""
    labels = columns(labels, "doc_id", "quality").dropna().distinct()
    share = min(1.0, FIT_ROWS / max(1, labels.count()))
    return labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003))


def fit(statistics: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Learns from (doc_id, statistics) and (doc_id, quality); quality 0 is what is to be rejected.

    Rows that the base rule rejects already teach nothing and are left out.
    """
    open_rows = statistics.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    joined = open_rows.join(chosen_labels(labels), "doc_id").select("doc_id", *RATES, "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(FIT_ROWS)
    rows = joined.collect()
    x = np.array([[r[c] or 0.0 for c in RATES] for r in rows], float).reshape(len(rows), len(RATES))
    return learn_list(x, np.array([r["quality"] == 0 for r in rows], bool), list(RATES))


def verdict(of: Callable[[str], Column], rules: list[list[Condition]]) -> Column:
    """Whether a row is kept, from its statistics."""
    return ~base_failed(of("n_words"), of("n_repeat_words")) & list_expression(rules, of)


def with_verdict(statistics: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return statistics.withColumn("base_failed", failed).withColumn("kept", verdict(F.col, rules))


def statistics_table(docs: DataFrame) -> DataFrame:
    """The written statistics of every row."""
    rows = docs.select(docs["doc_id"], text_statistics(docs["text"]).alias("s")).select("doc_id", "s.*")
    return written(rows, work_dir(docs.sparkSession, "quality"))


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, that the base rule and the learned list keep.

    Statistics are written for the labelled sample alone; all rows are judged in one pass that copies no text.
    """
    asked = chosen_labels(labels).select("doc_id").distinct()  # some FIT_ROWS numbers
    rules = fit(statistics_table(columns(docs, "doc_id", "text").join(F.broadcast(asked), "doc_id")), labels)
    return docs.filter(let(text_statistics(docs["text"]), lambda s: verdict(lambda c: s[c], rules)))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = statistics_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rules = fit(statistics, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_verdict(statistics, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
