"""Each operator against brute force on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import io
import json
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postmill.llm import bpe, cutting_stock, decision_list, golomb, html_text, licenses, pieces, planes, signature_tree, toxicity, url_lists
from postmill.llm.work import work_dir
from postmill.plans.session import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [
    (0, BASE), (1, BASE.upper()), (2, BASE + " twentyone"), (3, None), (4, ""), (5, " \n\t "), (6, "a b c"), (7, "A B C"), (8, LONG), (9, LONG + " end"),
    (10, "x  y\n\nz \x1c <|endoftext|> it's 日本 é́"), (11, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (12, "x" * 5000), (13, BASE), (13, BASE), (None, BASE), (14, "b\nb\nb\nc"),
    (15, "one <|endoftext|> two"), (16, "a<|startoftext|>b\n<|endoftext|>"), (17, "<|ENDOFTEXT|> <|endoftext|x"), (-(2**63), "least id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", len(t or ""), 1, b"x") for i, t in TEXTS]
    return ship(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, sig binary").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def tokenizer(name):
    out = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: out.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(" \n\t\r\x1c\x85　ab'st.,é日́Σ1🎉", max_size=30), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>"])), max_size=4).map("".join))
def test_pieces_are_the_whole_text(text):
    for name, words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = public_tokenizers.path(name)
        assert pieces.tokenizer_encoder(path, words)([text])[0].tolist() == tokenizer(name)(text)


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_plane_file_round_trip(kind, block):
    rng = np.random.default_rng(3)
    rows = [({2: None, 3: -(2**63)}.get(k, k), rng.integers(0, 2**rng.integers(1, 32), rng.integers(0, 40)).astype(np.uint32)) for k in range(9)]
    sink = io.BytesIO()
    writer = planes.PlaneWriter(sink, block, kind)
    for doc_id, ids in rows:
        writer.add(doc_id, ids)
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    start = 0
    for (doc_id, ids), (found, at, parts) in zip(rows, planes.PlaneReader(Source(sink.getvalue())).documents(), strict=True):
        assert found == doc_id and at == start
        assert np.array_equal(np.concatenate([np.zeros(0, "<u4"), *parts]), ids)
        start += len(ids)


def test_op1(spark, docs, empty):
    out = work_dir(spark, "test")
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [r for r in planes.read_planes(planes.write_planes(docs, path, out, block=1000), out).orderBy("start").collect()]
    encode = tokenizer("byte_bpe_50k.json")
    left = sorted(((i, crc([*encode(t), 2]), len(encode(t)) + 1) for i, t in TEXTS), key=str)
    assert sorted(((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in rows), key=str) == left
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: float("-inf") if x is None else x)
    assert rows[0]["doc_id"] is None and rows[1]["doc_id"] == -(2**63)
    assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1])
    out = work_dir(spark, "test")
    assert planes.read_planes(planes.write_planes(empty, path, out), out).count() == 0


def test_cutting_stock_plan():
    rng = np.random.default_rng(5)
    for n, high in ((0, 64), (1, 64), (50, 64), (3000, 63), (500, 8)):
        demand = np.bincount(rng.integers(1, high + 1, n), minlength=65)[1:65]
        laid, seen = defaultdict(int), defaultdict(list)
        for size, a, b, first, each, _, u0, u1 in cutting_stock.plan_sequences(demand, 64):
            for rank in range(a, b):
                laid[first + (rank - a) // each] += u1 - u0
                seen[size, rank].append((u0, u1))
        assert all(x <= 64 for x in laid.values())
        assert {k: sum(k2 == k for k2, _ in seen) for k in {s for s, _ in seen}} == {s + 1: int(d) for s, d in enumerate(demand) if d}
        for (size, _), parts in seen.items():
            edges = [u for p in sorted(parts) for u in p]
            assert edges[0] == 0 and edges[-1] == size and edges[1:-1:2] == edges[2:-1:2]
        if n == 3000:
            assert len(laid) <= 1 + 1.02 * (demand @ np.arange(1, 65)) / 64


def test_op2(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = cutting_stock.pack(docs.filter("doc_id is not null and doc_id <> 13"), path)
    encode, rows = tokenizer("word_bpe_49k.json"), [r.asDict() for r in packed.collect()]
    # of repeated rows and rows without a doc_id too, each id lies in one piece
    every, wanted = defaultdict(int), defaultdict(int)
    for r in cutting_stock.pack(docs, path).collect():
        ids = [*encode(dict(TEXTS)[r["doc_id"]]), 1]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        for k in range(r["start"], r["start"] + r["length"]):
            every[r["doc_id"], k] += 1
    for i, t in TEXTS:
        for k in range(len(encode(t)) + 1):
            wanted[i, k] += 1
    assert every == wanted
    for i, t in TEXTS:
        if i in (None, 13):
            continue
        ids, at = [*encode(t), 1], 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, crc(ids[at : at + r["length"]]), len(ids))
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    whole = cutting_stock.sequences(docs.filter("doc_id is not null and doc_id <> 13"), packed, path).collect()
    assert all(len(r["ids"]) == 2048 for r in whole) and len(whole) == len(sequences)
    assert cutting_stock.pack(docs, path).groupBy().sum("length").first()[0] == sum(len(encode(t)) + 1 for _, t in TEXTS)
    assert cutting_stock.pack(empty, path).count() == 0


def test_op3(docs, empty):
    scanned = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    r = scanned[11]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (10, 2, 2, 7, "cc-by,reserved", "cc-by,cc-by-nc-4.0,reserved", 1.0)
    assert (scanned[3]["n_words"], scanned[3]["first_word"], scanned[3]["labels"], scanned[3]["score"]) == (0, None, "", 0.0)
    assert licenses.scan(empty).count() == 0
    extra = [(30, "CC by cc-BY, General  Public\tLicense/general public license"), (31, "xcc by " * 300 + "all RIGHTS\n\nreserved"), (32, "all rights all rights reserved"), (33, "\xa0cc by\xa0")]
    both = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(extra, "doc_id int, text string"))
    found = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in licenses.scan(both).collect()), key=str)
    assert found == sorted((brute_phrases(i, t) for i, t in [*TEXTS, *extra]), key=str)
    for r in licenses.scan(both).collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["base_labels"].split(","))) | {x["label"] for x in r["spans"]}))


def brute_phrases(i, t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    at = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return i, len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_phrases_that_stand_twice_in_a_template():
    template = "you may copy the work if you keep this note and you may change the work if you keep this note too"
    automaton = licenses.Automaton({"x": [template]}, {})
    spans = licenses.chains(automaton, automaton.statistics(licenses.words_of(template.replace("copy", "COPY!")))[0])
    assert ("x", 0, len(template.split()), 1.0) in spans
    broken = template.replace(" and ", " but ")  # two runs; what the second begins with also stands in the first
    spans = licenses.chains(automaton, automaton.statistics(licenses.words_of(broken))[0])
    assert max(x[3] for x in spans) >= 0.9 and spans[0][1:3] == (0, len(template.split()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abc"), min_size=1, max_size=3))
def test_matching_statistics(templates, text, phrase):
    automaton = licenses.Automaton({str(i): [" ".join(t)] for i, t in enumerate(templates)}, {" ".join(phrase): "p"})
    sources = [*templates, phrase]
    inside = lambda w: any(s[k : k + len(w)] == w for s in sources for k in range(len(s) - len(w) + 1))
    longest = [max(n for n in range(i + 2) if inside(text[i + 1 - n : i + 1])) for i in range(len(text))]
    expected = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= licenses.SHORTEST and (i + 1 == len(text) or longest[i + 1] != n + 1)]
    runs, found = automaton.statistics([w.encode() for w in text])
    assert [(a, n) for a, n, _ in runs] == expected
    assert sorted(found) == [(i, "p") for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]
    for _, n, state in runs:
        for t, places in automaton.places[state].items():
            run = templates[t][places[0] + 1 - n : places[0] + 1]
            assert places == [k + n - 1 for k in range(len(templates[t]) - n + 1) if templates[t][k : k + n] == run]


def brute_components(rows):
    sets, parent = [], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def mutated():
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(rng.randint(4, 120))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"r{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [8192, 3])
def test_op4(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(signature_tree, "BLOCK", block)
    rows = mutated()
    df = ship(spark).createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in signature_tree.similar_documents(df).collect()), key=str)
    assert found == brute_components(rows)
    if block > 3:
        found = sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in signature_tree.similar_documents(docs).collect()), key=str)
        assert found == brute_components(TEXTS)
        assert signature_tree.similar_documents(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=1, max_size=40), st.integers(0, 3))
def test_dual_traversal_loses_nothing(sets, comps):
    sets = list({frozenset(s) for s in sets})
    hashed = [signature_tree._mixed(np.array(sorted(s), np.uint64) + np.uint64(1)) for s in sets]
    leaves = [signature_tree.Leaf(i, len(s), i % (comps + 1) if comps else i, signature_tree.signature(s)) for i, s in enumerate(hashed)]
    tree = signature_tree.build(leaves)
    found = set(signature_tree.dual(tree, tree, 80))
    for i, a in enumerate(sets):
        for j in range(i):
            if leaves[i].comp != leaves[j].comp and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                assert (j, i) in found


def test_op5(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    expected = sorted(map(str, con.execute(f"SELECT page_id, n_active, action, pattern, list_name FROM ({url_lists.OP5_SQL})").fetchall()))
    found = url_lists.op5_temporal_lists(spark, sf)
    assert sorted(str(tuple(r)) for r in found.select("page_id", "n_active", "action", "pattern", "list_name").collect()) == expected
    day = "2024-03-01"
    captures = spark.sql(f"select * from values (1, 'http://a.b.com/x/y', date '{day}'), (1, 'http://a.b.com/x/y', date '{day}'), (2, null, date '{day}'), (3, 'b.com', null), (4, 'https://u@b.com:80/', date '2024-04-01') t(page_id, url, fetched_on)")
    entries = spark.sql(
        "select * from values ('block', 'b.com', 'add', date '2023-01-01', 1), ('block', 'b.com', 'remove', date '2024-04-01', 1), ('allow', 'a.b.com/x', 'add', date '2024-03-01', 1), "
        "('block', 'a.b.com', 'add', date '2024-03-01', 1), ('block', 'a.b.com', 'remove', date '2024-03-01', 1), (null, 'b.com', 'add', date '2020-01-01', 1) t(list_name, pattern, event, on_day, url)"
    )
    rows = url_lists.evaluate(captures, entries).select("page_id", "n_active", "action", "pattern").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, 2, "allow", "a.b.com/x")] * 2 + [(2, 0, "pass", None), (3, 0, "pass", None), (4, 0, "pass", None)]
    assert url_lists.evaluate(captures.filter("false"), entries).count() == 0
    assert url_lists.evaluate(captures, entries.filter("false")).filter("action <> 'pass'").count() == 0


def test_op6(spark):
    page = (
        "<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><a>Home</a></nav><header>Head</header><div class='cookie-banner'>Ok?</div>"
        "<article><h1>Ti&amp;tle</h1><p><b>First   para\n graph<br><p>Second &copy; 1<aside>side</aside></p><ul><li>one<li>two</ul><section class='comments'><p>nice</p></section><p>&a</article>"
        "<form>Sign up</form><footer>Foot</footer>"
    )
    assert html_text.main_text(page) == "Ti&tle\nFirst para graph\nSecond © 1\none\ntwo\n&a"
    plain = "<body><div id='menu'><a>x</a></div><div><p>" + "word " * 40 + "</p><p>short</p></div><div><a>l1</a><a>l2</a></div></body>"
    assert html_text.main_text(plain) == ("word " * 40).strip() + "\nshort"
    df = ship(spark).createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "no tags", "x"), (3, "u", "no tags", "x"), (4, "u", "<p>" * 3000 + "deep", "x")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [(1, "", 0), (2, "", 0), (3, "no tags", 7), (3, "no tags", 7), (4, "deep", 4)]
    assert html_text.extract(df.filter("false")).count() == 0


ARTICLE_CASES = [
    ("<article><div class='entry-header'><h1>Title of it</h1></div><p>{t}</p></article>", "Title of it\n{t}"),
    ("<article><header><h1>Title</h1><p>By one</p></header><p>{t}</p><p class='related-work'>{t}</p></article>", "Title\nBy one\n{t}\n{t}"),
    ("<header><h1>Site</h1></header><article><p>{t}</p><div class='share-links'>Share this</div><div class='comments'><p>{t}</p></div></article>", "{t}"),
    # a region of links in the article is told from text by its ratios alone
    ("<article><p>{t}</p><p>{t}</p><div>" + "<p><a>more <b>x</b></a></p>" * 9 + "</div></article>", "{t}\n{t}"),
    ("<article><p>{t}</p><div><ul><li>one</li><li>two</li></ul></div></article>", "{t}\none\ntwo"),
    ("<article><p>" + "<b><i>" * 50 + "{t}</p><p>{t}</p></article>", "{t}\n{t}"),
]


@pytest.mark.parametrize("case", ARTICLE_CASES)
def test_regions_of_articles(case):
    text = ("word " * 50).strip()
    assert html_text.main_text("<body>" + case[0].format(t=text) + "<footer>Foot</footer></body>") == case[1].format(t=text)


def test_clusters_choose_regions(monkeypatch):
    """With every line taken for text, pages with lists of links in the article come out otherwise."""
    text = ("word " * 50).strip()
    page = "<body>" + ARTICLE_CASES[3][0].format(t=text) + "</body>"
    before = html_text.main_text(page)
    monkeypatch.setattr(html_text, "text_like", lambda lines: np.ones(len(lines), bool))
    assert html_text.main_text(page) != before


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=200), st.integers(0, 9)), min_size=1, max_size=30))
def test_smoothed_ratios(rows):
    lines = [html_text.Line(t, n, 0, 0, False) for t, n in rows]
    ratio = [np.log1p(len(t) / max(1, n)) for t, n in rows]
    smooth = []
    for i in range(len(rows)):
        near = [j for j in range(i - 2, i + 3) if 0 <= j < len(rows)]
        weight = [np.exp(-0.5 * (j - i) ** 2) for j in near]
        smooth.append(sum(w * ratio[j] for w, j in zip(weight, near)) / sum(weight))
    found = html_text.text_like(lines)
    if max(smooth) - min(smooth) < 0.5 - 1e-9:
        assert found.all()
    elif max(smooth) - min(smooth) > 0.5 + 1e-9:
        # two means: every line is with the nearer one
        means = [np.mean([s for s, f in zip(smooth, found) if f == side]) for side in (False, True)]
        assert all((abs(s - means[1]) < abs(s - means[0]) + 1e-9) if f else (abs(s - means[0]) <= abs(s - means[1]) + 1e-9) for s, f in zip(smooth, found))


def test_pages_longer_than_a_chunk(spark):
    words = [f"w{i}" + "x" * 40 for i in range(6000)]
    page = "<article>" + "".join(f"<p>{w} &amp; <b>{w}</b></p>" for w in words) + "</article>"
    assert len(page) > 3 * html_text.CHUNK and html_text.main_text(page) == "\n".join(f"{w} & {w}" for w in words)
    df = ship(spark).createDataFrame([(1, "u", page), (None, None, None)], "page_id int, url string, html string")
    assert sorted((r["n_chars"] for r in html_text.extract(df).collect())) == [0, sum(2 * len(w) + 4 for w in words) - 1]


@pytest.fixture(scope="module")
def multi():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(" \n\t\r\x1c\x85　ab'st.,é日́Σ1🎉", max_size=40))
def test_bpe_is_exact(multi, text):
    ranks, library = multi
    own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def naive_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[x] for x in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), unique=True, max_size=14), st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=6))
def test_merges_with_any_ranks(tokens, texts):
    """Ranks in no order of length: merges that make pairs of lower ranks, overlaps and neighbours."""
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + 37 * i for i, t in enumerate(tokens)}
    merges = bpe.Merges(ranks)
    pieces_ = [t.encode() for t in texts]
    expected = [naive_merge(p, ranks) for p in pieces_]
    assert merges(pieces_) == expected
    assert [bpe.merge(p, ranks) for p in pieces_] == expected


def test_caches_of_two_generations(multi, monkeypatch):
    ranks, library = multi
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    monkeypatch.setattr(bpe, "CACHE_TOKENS", 20)
    monkeypatch.setattr(bpe, "GROUP", 50)
    own, rng = bpe.ByteBpe(ranks, public_tokenizers.PATTERN), random.Random(6)
    for _ in range(40):
        texts = [" ".join(rng.choice("ab") * rng.randint(1, 90) for _ in range(rng.randint(0, 9))) + rng.choice(["", " ", "\n\nx"]) for _ in range(4)]
        for text, found in zip(texts, own.entries(texts), strict=True):
            assert b",".join([x[0] for x in found]).decode() == ",".join(map(str, library.encode_ordinary(text)))
            assert b"".join([x[1] for x in found]) == text.encode()


def test_op7(docs, empty, multi):
    ranks, library = multi
    expected = []
    for i, t in TEXTS:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.encode_table(docs, path, public_tokenizers.PATTERN)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert bpe.encode_table(empty, path, public_tokenizers.PATTERN).count() == 0
    long = "ab" * 20_000
    assert bpe.ByteBpe(ranks, public_tokenizers.PATTERN).encode(long) == library.encode_ordinary(long)
    assert bpe.merge(b"\xff\xfe\x00", ranks) and json.dumps(bpe.merge("日本語".encode(), ranks))


def brute_statistics(t):
    t = t or ""
    w, windows, covered = WORD.findall(t), defaultdict(list), set()
    for k in range(len(w) - 4):
        windows[tuple(w[k : k + 5])].append(k)
    for at in windows.values():
        if len(at) > 1:
            covered |= {k + j for k in at for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_op8(spark, docs, empty):
    extra = [(20, BASE + "\n" + BASE), (21, "a b a b a b a b a b a b"), (22, "#| é<>\x0b$ x\x1cy")]
    df = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(i, t, 1) for i, t in extra], "doc_id long, text string, n long"))
    table = decision_list.with_verdict(decision_list.statistics_table(df), [])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[c] for c in ("doc_id", *names)) for r in table.collect()), key=str) == sorted(((i, *brute_statistics(t)) for i, t in [*TEXTS, *extra]), key=str)
    assert table.filter("kept = base_failed").count() == 0
    assert decision_list.statistics_table(empty).count() == 0
    labels = spark.createDataFrame([(0, 1), (2, None)], "doc_id long, quality int")
    assert decision_list.fit(decision_list.statistics_table(docs), labels) == []


def test_decision_list_learns_conjunctions(spark):
    rng = np.random.default_rng(2)
    x = rng.random((6000, 3))
    y = (x[:, 0] > 0.7) & (x[:, 1] <= 0.4)
    rules = decision_list.learn_list(x[:3000], y[:3000], ["a", "b", "c"])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[3000:]], "a double, b double, c double")
    from pyspark.sql import functions as F

    kept = np.array([r[0] for r in df.select(decision_list.list_expression(rules, F.col)).collect()])
    assert (kept == ~y[3000:]).mean() > 0.98


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40 - 1), min_size=1, max_size=200), st.integers(0, 30))
def test_golomb_round_trip(values, k):
    gaps = np.diff(np.unique(np.array(values, np.uint64)), prepend=np.uint64(0))
    gaps = np.minimum(gaps, np.uint64((1 << k) * 50))
    assert np.array_equal(golomb.golomb_decode(golomb.golomb_encode(gaps, k), len(gaps), k), gaps)


def test_op9(spark, docs, empty):
    found = [r.asDict() for r in golomb.exact_duplicates(docs).collect()]
    low = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[low(t)].append(i)
    expected = sorted(((i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in TEXTS), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str) == expected
    assert sum(r["kept"] for r in found) == len(groups)
    assert golomb.exact_duplicates(empty).count() == 0
    whole = golomb.once_each(docs)
    stay = {(max((x for x in ids if x is not None), default=None), t) for t, ids in groups.items()}
    assert whole.columns == docs.columns and sorted(((r["doc_id"], low(r["text"])) for r in whole.collect()), key=str) == sorted(stay, key=str)


def test_op10(spark, docs, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + rng.choice("ab") for _ in range(40)]
        if i % 9 == 0:
            words += rng.sample(["grumblex", "snarlox", "spitefux"], rng.randint(1, 3))
        rows.append((i, " ".join(words), 1))
        if i < 600:
            labels.append((i, int(i % 9 == 0)))
    df = ship(spark).createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    chain = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held_out = [r for r in toxicity.score(df, chain).collect() if r["doc_id"] >= 600]
    assert all(r["toxic"] == (r["doc_id"] % 9 == 0) for r in held_out)
    assert all(0 <= r[f"p_{c}"] <= 1 for r in held_out for c in toxicity.CATEGORIES)
    assert toxicity.without_toxic(df, chain).count() == 800
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).filter("not toxic").count() == len(TEXTS)
    assert toxicity.score(empty, chain).count() == 0 and toxicity.score(docs, chain).count() == len(TEXTS)
    assert toxicity.score(docs.filter("doc_id >= 0").select(docs["doc_id"].cast("int"), "text"), chain).count() == len(TEXTS) - 2
    for r in toxicity.score(df, chain).collect():  # the chain by hand
        words = {w[:k] for w in rows[r["doc_id"]][1].split() for k in (4, 5)}
        earlier = []
        for c, w, b in zip(toxicity.CATEGORIES, chain.weights, chain.intercepts, strict=True):
            z = b + sum(w[i] for f, i in chain.index.items() if f in words) + sum(w[len(chain.index) + k] * p for k, p in enumerate(earlier))
            earlier.append(1 / (1 + np.exp(-z)))
            assert abs(earlier[-1] - r[f"p_{c}"]) < 1e-9


def test_out_of_fold_probabilities_have_not_seen_their_fold():
    """Labels that are noise can't be foretold, though features that are chosen on all rows would seem to."""
    rng = np.random.default_rng(3)
    words, y, folds = rng.random((600, 3000)) < 0.05, rng.random(600) < 0.3, rng.integers(0, 5, 600)

    def view(rows):
        best = np.argsort(-np.abs(words[rows & y].mean(0) - words[rows & ~y].mean(0)))[:60]
        return words[:, best].astype(float), [y, y]

    whole = view(np.ones(600, bool))
    models, honest = toxicity.fit_chain(lambda: whole, [lambda f=f: view(folds != f) for f in range(5)], folds, np.ones(600))
    leaking = toxicity.fit_chain(lambda: whole, [lambda: whole] * 5, folds, np.ones(600))[1]
    auc = lambda p: (p[y][:, None] > p[~y][None]).mean() + (p[y][:, None] == p[~y][None]).mean() / 2
    assert abs(auc(honest[:, 0]) - 0.5) < 0.1 < auc(leaking[:, 0]) - 0.5
    assert [len(m[0]) for m in models] == [60, 61]
