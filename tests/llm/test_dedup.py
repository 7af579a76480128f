"""Substring dedup and the Jaccard join against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from inkwright.llm import queries as q
from inkwright.llm.components import components
from inkwright.llm.jaccard_join import choose_bands, jaccard_classes, one_of_each
from inkwright.llm.substring_dedup import COVERS, dedup_substrings, period_for

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, note string, n_words string"


def wordlist(text):
    return WORD.findall(text or "")


def brute_removed(rows, window=20):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = wordlist(text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_covers_hold_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert period_for(20) == 13 and period_for(3) == 1


def test_substring_dedup_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in q.op4_substring_dedup(spark, sf_dir).collect()}
    want = brute_removed([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == want
    assert sum(x[1] for x in want.values()) > 0


def words_of(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


CASES = [
    (5, words_of(60), "a", "x"),
    (3, "lead in " + words_of(45, 7) + " tail", "b", None),
    (9, words_of(19), "c", "x"),
    (8, "a b c " * 30, "d", "x"),  # repeats itself
    (7, None, "e", "x"),
    (6, "", "f", "x"),
    (10, words_of(60), "g", "x"),
    (11, " \t " + words_of(20, 100) + "  \n" + words_of(20, 100), "h", "x"),
    (12, words_of(5000, 1000), None, "x"),
    (13, "z " * 31 + words_of(4000, 1500), None, "x"),
]


@pytest.mark.parametrize("window", [5, 20, 33])
def test_substring_dedup_of_planted_passages(spark, window):
    docs = spark.createDataFrame(CASES, DOCS)
    out = dedup_substrings(docs, window=window)
    assert set(out.columns) == {"doc_id", "text", "note", "n_words", "n_removed", "kept_text"}
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect()}
    assert got == brute_removed([(c[0], c[1]) for c in CASES], window)


def test_substring_dedup_edge_tables(spark):
    assert dedup_substrings(spark.createDataFrame([], DOCS)).collect() == []
    twice = spark.createDataFrame([(1, words_of(30), "a", "x")] * 2 + [(None, words_of(30), "a", "x")], DOCS)
    assert sorted((r.doc_id is None, r.n_removed) for r in dedup_substrings(twice).collect()) == [(False, 30), (False, 30), (True, 0)]


def test_substring_dedup_of_a_repeated_row(spark):
    """A row that comes twice repeats nothing, in one task or in several; what is found in one text of a key stays there."""
    rows = [(1, words_of(30), "a", "x")] * 3 + [(2, words_of(25, 500) + " " + words_of(20, 5), "b", "x")] * 2
    # One key, two texts: each has its own repeat of what the other documents hold.
    rows += [(3, words_of(40, 900) + " " + words_of(22, 503), "c", "x"), (3, words_of(24, 2) + " " + words_of(60, 2000), "d", "x")]
    want = sorted([(1, 30, 0)] * 3 + [(2, 45, 20)] * 2 + [(3, 62, 22), (3, 84, 24)])
    for n in (1, 5):
        got = dedup_substrings(spark.createDataFrame(rows, DOCS).repartition(n))
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == want
    alone = dedup_substrings(spark.createDataFrame(rows[:2], DOCS)).collect()
    assert [(r.n_removed, r.kept_text) for r in alone] == [(0, words_of(30))] * 2


def grams(text, n=5):
    words = wordlist(text)
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def brute_classes(rows, threshold=0.8):
    rows = [(k, grams(t)) for k, t in rows]
    links, parent = {k: 0 for k, _ in rows}, {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s and t and len(s & t) >= threshold * len(s | t) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (find(k), links[k]) for k, _ in rows}


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.9999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_bands_reach_the_recall_at_low_thresholds():
    for threshold in (0.95, 0.7, 0.5, 0.1, 0.05, 0.01, 0.001):
        bands, rows = choose_bands(threshold, 0.9999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9999
        assert bands * rows <= 128 or rows == 1
    assert choose_bands(0.8, 0.9999) == (24, 5) and choose_bands(1.0, 0.9999) == (1, 128)
    with pytest.raises(ValueError):
        choose_bands(0.0, 0.9999)


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_is_brute_force(spark, sf_dir, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(docs, block=block).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def family(n):
    """Near copies: each has one word of its own, at a place of its own."""
    base = [f"b{i}" for i in range(120)]
    return [" ".join(base[:i] + [f"own{i}"] + base[i + 1 :]) for i in range(0, n)]


@pytest.mark.parametrize("block", [1024, 7])
def test_jaccard_of_a_family_with_copies(spark, block):
    texts = family(20) + family(20)[:6] + ["short one", "short one", "other short", "", None, "  ", "b1 b2 b3 b4 b5 b6"]
    rows = [(100 + i, t, "n", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(docs, block=block).collect()}
    assert got == brute_classes([(r[0], r[1]) for r in rows])
    left = {r.doc_id for r in one_of_each(docs).collect()}
    assert left == {c for c, _ in got.values()}


@pytest.mark.parametrize("block", [1024, 1])
def test_jaccard_of_a_repeated_row_with_near_copies(spark, block):
    """A repeated row is one document, whether it stands for its copies (100), is one of them (103) or has none (102)."""
    texts = [*family(3), family(1)[0], "far " * 9]
    rows = [(100 + i, t, "n", "x") for i, t in enumerate(texts)]
    again = [rows[0]] * 2 + [(100, rows[0][1].replace(" ", "  "), "n", "x")] + [rows[2], rows[3], rows[4]]
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(spark.createDataFrame(rows + again, DOCS), block=block).collect()]
    want = brute_classes([(r[0], r[1]) for r in rows])
    assert sorted(got) == sorted((r[0], *want[r[0]]) for r in rows + again)


@pytest.mark.parametrize("rounds", [0, 2])
def test_jaccard_of_a_chain_of_unlinked_candidates(spark, monkeypatch, rounds):
    """Neighbours share half of their words: bands may propose them, but nothing chains them, and real copies are still found."""
    from inkwright.llm import jaccard_join

    chunk = lambda i: " ".join(f"c{i}_{k}" for k in range(60))
    texts = [f"{chunk(i)} {chunk(i + 1)} {chunk(i + 2)}" for i in range(60)]
    texts += [texts[7].replace("c8_3 ", "other "), texts[30].replace("c31_5 ", "another ")]
    docs = spark.createDataFrame([(i, t, "n", "x") for i, t in enumerate(texts)], DOCS)
    chained = []
    whole = jaccard_join._compared

    def spy(members, *rest):
        chained.append(members.groupBy("component").count().agg(F.max("count")).first()[0] or 0)
        return whole(members, *rest)

    monkeypatch.setattr(jaccard_join, "_compared", spy)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(docs, rounds=rounds).collect()}
    assert got == brute_classes(list(enumerate(texts)))
    assert chained[-1] <= 3


def complement_words(n):
    """Two words of n letters that a polynomial modulo 2**64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 8192])
def test_words_that_simple_hashes_confuse(spark, n):
    a, b = complement_words(n)
    rows = [(1, f"{a} {words_of(19)}", "x", "x"), (2, f"{b} {words_of(19)}", "x", "x"), (3, a, "x", "x"), (4, b, "x", "x"), (5, f"{b} {words_of(19)}", "x", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    pairs = [(r[0], r[1]) for r in rows]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_substrings(docs).collect()}
    assert got == brute_removed(pairs) and got[2][1] == 0 and got[5][1] == 20
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(docs).collect()} == brute_classes(pairs)


def test_substring_dedup_with_many_groups(spark, sf_dir, monkeypatch):
    """Many more groups than partitions change nothing."""
    from inkwright.llm import substring_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 4000)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_substrings(docs).collect()}
    assert got == brute_removed([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_edge_tables(spark):
    assert jaccard_classes(spark.createDataFrame([], DOCS)).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e f", "n", "x"), (4, "a b c d e f", "n", "x"), (4, "a b c d e f", "n", "x")], DOCS)
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in jaccard_classes(rows).collect()) == [(0, 0, 0), (4, 4, 0), (4, 4, 0)]
    assert one_of_each(rows).count() == 3


def test_components_of_a_long_path(spark):
    n = 200
    edges = spark.range(n - 1).select(((F.col("id") * 37) % n).alias("a"), (((F.col("id") + 1) * 37) % n).alias("b"))
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).collect() == []
