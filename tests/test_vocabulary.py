"""tfidf_top_terms with its whole vocabulary, by brute force."""

import math
import re
from collections import Counter, defaultdict

from postmill.plans import mining_queries, registry


def brute(rows, most):
    tf = {}
    for i, text in rows:
        words = [w for w in re.findall(r"\b[A-Za-z][A-Za-z0-9+\-.#]+\b", re.sub(r"\s+", " ", text.lower())) if w not in mining_queries.STOP]
        tf[i] = Counter(" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1))
    total, rows_of = Counter(), Counter()
    for counts in tf.values():
        total.update(counts)
        rows_of.update(counts.keys())
    kept = set(sorted(total, key=lambda t: (-total[t], t))[:most])
    out = defaultdict(list)
    for i, counts in tf.items():
        raw = {t: n * (math.log((1 + len(rows)) / (1 + rows_of[t])) + 1) for t, n in counts.items() if t in kept}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out[i] = [(t, round(raw[t] / length, 5)) for t in sorted(raw, key=lambda t: (-round(raw[t], 9), t))[:15]]
    return dict(out)


def test_vocabulary_is_whole(spark, tmp_path):
    """Some 29,600 terms: with 20,000 of them the last rows lose all of theirs."""
    rows = [(i, " ".join(f"t{i:03d}x{j:02d}" for j in range(50))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = defaultdict(list)
    for r in registry.queries()["tfidf_top_terms"](spark, str(tmp_path)).orderBy("doc_id", "rank").collect():
        found[r["doc_id"]].append((r["term"], round(r["weight"], 5)))
    expected = brute(rows, 200_000)
    assert dict(found) == expected
    assert brute(rows, 20_000) != expected
