"""Mixing, quality rules, token counts."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwright.llm import mixing, quality_rules, token_counts
from inkwright.llm import queries as q
from inkwright.llm.textbytes import slices, words

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " \n ", "a", "a  b\tc\n", "é è 　x y", "#a * $ % & | < > b", "l one\nl one\n\nl one \nx", "x y z x y z q", "\n\n", "a b c a b c a b c " * 400, "\x1c a \x85 b", "ß" * 3000]


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, hit = Counter(tri), set()
    for i, t in enumerate(tri):
        if n[t] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_words_and_counts_are_brute_force(spark, sf_dir):
    import pyarrow as pa

    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = []
    for limit in (1 << 20, 50):
        got = []
        for _, _, data, offsets in slices(pa.array(texts), limit):
            c = quality_rules.text_counts(data, offsets)
            got += list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
        assert got == [brute_counts(t) for t in texts]
    for _, _, data, offsets in slices(pa.array(texts)):
        spans = words(data, offsets)
        found = [data[a:b].tobytes().decode() for a, b in zip(spans.starts, spans.ends, strict=True)]
        assert found == [w for t in texts for w in WORD.findall(t or "")]
        h = spans.hashes()
        assert len(set(h.tolist())) == len(set(found)) == len(set(zip(found, h.tolist(), strict=True)))


def test_quality_rules_verdict(spark, sf_dir):
    rows = {r.doc_id: r for r in q.op7_quality_rules(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    for r in rows.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.log_ratio >= quality_rules.LEAST_RATIO)
    # Good texts that pass the base rules stay; most poor ones go.
    good = [rows[x.doc_id] for x in labels if x.quality == 1 and x.toxic == 0]
    assert all(r.kept for r in good if not r.base_failed)
    poor = [rows[x.doc_id] for x in labels if x.quality == 0]
    assert not poor or sum(r.kept for r in poor) <= 0.2 * len(poor)


def test_log_ratios_are_brute_force(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "x"), (2, "### $$$ ###", "x"), (3, "the cat ran", "x"), (4, None, "x")], "doc_id long, text string, kept string")
    trusted = docs.filter("doc_id in (1, 3)").select("doc_id")
    ratios = quality_rules.fit_log_ratios(docs, trusted)

    def buckets(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return quality_rules.ngram_buckets(data, np.array([0, len(data)]))[0].tolist()

    raw = Counter(b for t in ("the cat sat", "### $$$ ###", "the cat ran") for b in buckets(t))
    good = Counter(b for t in ("the cat sat", "the cat ran") for b in buckets(t))
    size = len(ratios)
    for b in list(raw) + [0]:
        assert ratios[b] == pytest.approx(np.log((good[b] + 1) / (sum(good.values()) + size) / ((raw[b] + 1) / (sum(raw.values()) + size))))
    out = {r.doc_id: r.log_ratio for r in quality_rules.judge(docs, ratios).collect()}
    assert out[1] == pytest.approx(np.mean([ratios[b] for b in buckets("the cat sat")])) and out[4] == 0.0
    assert (quality_rules.fit_log_ratios(docs, trusted.limit(0)) == 0).all()
    assert quality_rules.judge(docs.limit(0), ratios).collect() == []


def test_token_counts_are_the_librarys(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_file("word_bpe_49k.json")
    odd = [*ODD, "don't I'LL <|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "é ́ İstanbul ΑΣ ﬁ 12345 日本 😀😀!?", "a b　c", "x" * 5000]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)] + [(5 * 10**6, "a")], "doc_id long, text string")
    every = docs.union(more).withColumn("n_tokens", F.lit("x"))
    cache = f"file://{tmp_path}/cache"
    got = {r.doc_id: r for r in token_counts.token_counts(every, tokenizer=path, cache=cache).collect()}
    library = Tokenizer.from_file(path)
    texts = every.select("doc_id", "text").collect()
    for r, e in zip(texts, library.encode_batch([r.text or "" for r in texts], add_special_tokens=False), strict=True):
        x = got[r.doc_id]
        assert (x.n_bytes, x.n_tokens, x.over_limit) == (len((r.text or "").encode()), len(e), len(e) > 2048), r
    # What is stored is not encoded again; what is new is appended.
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("digest").distinct().count()
    token_counts.token_counts(more.union(spark.createDataFrame([(7, "brand new")], more.schema)), tokenizer=path, cache=cache).collect()
    assert spark.read.parquet(cache).count() == n + 1
    assert token_counts.token_counts(more.limit(0), tokenizer=path, cache=cache).collect() == []


def test_token_counts_where_white_space_matters(spark, tmp_path):
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_file("byte_bpe_50k.json")
    texts = [None, "", " ", "a b", "a  b", " a b", "a b ", "a\nb", "a\n\nb", "a\r\nb", "a\tb", "a b", "x  =  1\n    y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(path)
    want = {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    assert want[3] != want[4]
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, tokenizer=path, cache=cache).collect()} == want
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts})


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped, target = share * sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(ceiling * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        target = {s: ceiling * sizes[s] for s in stopped} | {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if target[s] > ceiling * sizes[s]}
        if not over:
            return target
        stopped |= over


def test_mix_reaches_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(10**6 + i, t, s) for i, (t, s) in enumerate(zip(ODD, [None, None, "zero", "b", None, "é", "A", "A", "b", "zero", "A", "b", "b"], strict=True))], docs.schema)
    for every in (docs, odd, docs.union(odd)):
        rows = mixing.copies(every).collect()
        assert sorted(r.key for r in rows) == sorted(r.doc_id for r in every.collect())
        sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
        text = {r.doc_id: r.text for r in every.collect()}
        for r in rows:
            assert r.size == len(WORD.findall(text[r.key] or "")) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        want = brute_targets(dict(sizes))
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        for s in sizes:
            assert abs(taken[s] - want[s]) <= largest[s]
        assert sorted(rows, key=str) == sorted(mixing.copies(every.repartition(7)).collect(), key=str)
        mixed = mixing.mix(every)
        assert mixed.columns == every.columns
        n = Counter(r.doc_id for r in mixed.collect())
        assert n == Counter({r.key: r.copies for r in rows if r.copies})
    assert mixing.copies(docs.limit(0)).collect() == []


def test_mix_is_the_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(q.OP1_SQL).fetchall()
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in q.op1_mix(spark, sf_dir).collect()]
    assert sorted(got) == sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in want)


def test_mix_of_repeated_rows_and_clashing_names(spark):
    """Rows that share a key are drawn each; columns named like anything inside stay."""
    names = ["copies", "_copies", "_k", "key", "row", "id", "at", "first", "rate", "offset", "upto", "digest", "f0", "size", "again"]
    rows = [(1, "a b", "x")] * 3 + [(2, "c", "y"), (None, "d e f", "y"), (None, "g", None), (1, "other words here", "x"), (3, None, "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    counts = mixing.copies(docs).collect()
    assert Counter((r.key, r["size"], r.source) for r in counts) == Counter((k, len(WORD.findall(t or "")), s) for k, t, s in rows)
    want = Counter()
    for r in counts:
        want[(r.key, r["size"], r.source)] += r.copies
    for n in (1, 5):
        mixed = mixing.mix(docs.repartition(n))
        assert mixed.columns == docs.columns
        got = mixed.collect()
        assert Counter((r.doc_id, len(WORD.findall(r.text or "")), r.source) for r in got) == +want
        assert all([r[n] for n in names] == list(range(len(names))) for r in got)
    target = {r.source: r.target for r in counts}
    for s in target:
        mine = [r for r in counts if r.source == s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r["size"] for r in mine)


def complement_words(n=1024):
    """Two words of n letters that a polynomial modulo 2**64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 8192])
def test_counts_of_words_that_simple_hashes_confuse(n):
    import pyarrow as pa

    a, b = complement_words(n)
    texts = [f"{a}\n{b}", f"{a} x y {b} x y", f"{a}\n{a}\n{b}", f"{a} {b} {a} {b} {a}"]
    for _, _, data, offsets in slices(pa.array(texts)):
        c = quality_rules.text_counts(data, offsets)
        assert list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)) == [brute_counts(t) for t in texts]


def test_span_ids_where_hashes_collide(monkeypatch):
    """Equal hashes of different bytes are told apart by the bytes."""
    from inkwright.llm import textbytes

    data = np.frombuffer(b"abcabdabc" + b"x" * 300 + b"y" + b"x" * 300, dtype=np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 310, 9]), np.array([3, 6, 9, 309, 610, 308])
    for blind in (False, True):
        if blind:
            monkeypatch.setattr(textbytes, "span_hashes", lambda data, a, b, lane=0: np.zeros(len(a), dtype=np.uint64))
        ids, example = textbytes.span_ids(data, starts, ends)
        assert ids[0] == ids[2] and ids[3] == ids[4] and len(set(ids.tolist())) == 4
        assert all(data[starts[i] : ends[i]].tobytes() == data[starts[e] : ends[e]].tobytes() for i, e in enumerate(example[ids]))
