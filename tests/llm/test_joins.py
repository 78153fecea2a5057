"""The n-gram join, near copies, fingerprints and components against all pairs."""

import hashlib
import random

import numpy as np
import pytest

from kinweave.llm import common, minhash, ngramjoin, similarity
from kinweave.llm import components as stars
from kinweave.llm.catalog import QUERIES
from kinweave.llm.components import components
from tests.llm import brute, fixtures


def texts_with_copies(seed, n=60):
    """Texts, copies, copies with edits of all strengths, chains of edits, short texts."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))

    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            words = rng.choice(out).split() or ["x"]
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [word()] if rng.random() < 0.7 else []
            text = " ".join(words)
        else:
            text = " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 10, 40, 150, 400])))
        out.append(text.upper() if rng.random() < 0.1 else text)
    return out


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 50), (1, 100)])
def test_groups_equal_all_pairs(spark, size, percent):
    texts = texts_with_copies(size * percent) + fixtures.ODD_TEXTS
    got = {r["doc_id"]: r for r in ngramjoin.jaccard_join(fixtures.table(spark, texts), size, percent).collect()}
    wanted = brute.components(list(range(len(texts))), brute.linked(texts, size, percent))
    assert [got[i]["component_id"] for i in range(len(texts))] == wanted
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(brute.shingles(t, size)) for t in texts]


def test_large_group_of_near_copies(spark):
    """Buckets with many members take several rounds of leaders and lose no link."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.jaccard_join(fixtures.table(spark, texts), 1, 90).collect()}
    assert [got[i] for i in range(len(texts))] == brute.components(list(range(150)), brute.linked(texts, 1, 90))


def test_no_table_of_the_corpus_is_gathered_in_the_driver(spark, monkeypatch):
    plans = []

    def stored(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.stored(df, label)

    for module in (ngramjoin, similarity, stars):
        monkeypatch.setattr(module, "stored", stored)
    docs = fixtures.table(spark, texts_with_copies(3))
    frames = [ngramjoin.jaccard_join(docs), ngramjoin.one_of_each_group(docs, 5, 80)]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in frames]
    assert any("SortMergeJoin" in plan for plan in plans)
    assert not [plan for plan in plans if "Broadcast" in plan]


def test_odd_rows(spark):
    docs = fixtures.odd(spark)
    source = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts = [t for _, t in source]
    wanted = brute.components([i for i, _ in source], brute.linked(texts, 3, 90))
    expected = sorted((repr(i), len(brute.shingles(t, 3)), repr(c)) for (i, t), c in zip(source, wanted))
    got = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in ngramjoin.jaccard_join(docs).collect())
    assert got == expected
    assert ngramjoin.jaccard_join(fixtures.empty(spark)).count() == 0


def test_one_document_of_each_group(spark):
    texts = texts_with_copies(9, 40) + ["", None, "same text of a row"]
    docs = fixtures.table(spark, texts).union(fixtures.table(spark, ["same text of a row"], [len(texts) - 1]))
    roots = brute.components(list(range(len(texts))), brute.linked(texts, 5, 80))
    kept = sorted(r["doc_id"] for r in ngramjoin.one_of_each_group(docs, 5, 80).collect())
    assert kept == sorted(set(roots))
    odd = fixtures.odd(spark)
    assert ngramjoin.one_of_each_group(odd, 5, 80).columns == odd.columns
    assert ngramjoin.one_of_each_group(fixtures.empty(spark), 5, 80).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_similar_sets_share_a_signature(percent):
    """Every pair of similar sets shares a signature, for many sizes at the very limit."""
    rng = np.random.default_rng(percent)
    sign = ngramjoin.part_enum(percent)
    for size in [1, 2, 3, 5, 9, 10, 19, 20, 33, 64, 100, 257, 1000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            most = len(a) * (100 - percent) // (100 + percent) if rng.random() < 0.5 else 0
            dropped = rng.permutation(len(a))[: most or len(a) * (100 - percent) // 100]
            b = np.delete(a, dropped)
            if most:
                b = np.union1d(b, rng.integers(0, 2**63, most, dtype=np.uint64))
            shared = len(np.intersect1d(a, b))
            if not len(b) or 100 * shared < percent * (len(a) + len(b) - shared):
                continue
            sizes = np.array([len(a), len(b)])
            text, signature = sign(np.repeat([0, 1], sizes), np.concatenate([a, b]), sizes)
            assert set(signature[text == 0]) & set(signature[text == 1])


def test_bands_cover_partners():
    for percent in (50, 80, 90):
        edges = ngramjoin.band_edges(percent, 5000)
        for size in range(1, 2000):
            partner = size * 100 // percent
            assert np.searchsorted(edges, partner) - np.searchsorted(edges, size) in (0, 1)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (5000, 1), (1, 5000)]
    nodes = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    wanted = dict(zip(nodes, brute.components(nodes, [(at[a], at[b]) for a, b in edges])))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in wanted.items() if n in got} and set(nodes) - set(got) <= {n for n in nodes if all(a == b for a, b in edges if n in (a, b))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_have_no_false_links(spark):
    texts = texts_with_copies(21)
    exact = brute.components(list(range(len(texts))), brute.linked(texts, 5, 80))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_copies(fixtures.table(spark, texts)).collect()}
    assert all(exact[got[i]] == exact[i] for i in got)
    strong = brute.linked(texts, 5, 90)
    assert sum(got[a] == got[b] for a, b in strong) >= 0.97 * len(strong)


def test_near_copies_at_the_threshold_are_found(spark):
    """Pairs of a similarity of 0.8 and little more, each of words of its own."""
    texts = []
    for pair in range(400):
        words = [f"p{pair}w{i}" for i in range(104)]
        texts += [" ".join(words), " ".join(words[: 84 + pair % 3])]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_copies(fixtures.table(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_query_has_classes_of_near_copies(spark):
    texts = texts_with_copies(22)
    odd = fixtures.odd(spark).select("doc_id", "text")
    docs = fixtures.table(spark, texts, range(1000, 1000 + len(texts))).select("doc_id", "text").union(odd)
    source = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = brute.components([i for i, _ in source], brute.linked([t for _, t in source], 5, 80))
    expected = sorted((repr(i), len(t or ""), len(brute.shingles(t, 5)), repr(c)) for (i, t), c in zip(source, wanted))
    rows = minhash.fingerprints(docs).collect()
    assert sorted((repr(r["doc_id"]), r["n_chars"], r["n_shingles"], repr(r["class_id"])) for r in rows) == expected
    plain = [tuple(r) for r in minhash.edit_test(docs).collect()]
    assert sorted(map(repr, plain)) == sorted(repr(tuple(r)[:-1]) for r in rows)
    assert QUERIES["op10_fingerprints"](spark, "/root/testdata/sf0.001").columns[-2:] == ["n_shingles", "class_id"]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_fingerprints(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = fixtures.real(spark)
        result = {r["doc_id"]: r for r in minhash.edit_test(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = order([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    assert len(result) == len(rows)
    for (doc_id, text), (next_id, after) in zip(rows, rows[1:] + rows[:1]):
        row, cut = result[doc_id], len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (brute.shingles(t, 5) for t in (text, edited, after))
        assert abs(row["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
        assert abs(row["near_next"] - (len(a & c) / len(a | c) if a | c else 1)) < 0.25
        bytes_ = [bytes.fromhex(result[i]["fingerprint"]) for i in (doc_id, next_id)]
        if all(bytes_):
            same = sum(x == y for x, y in zip(*bytes_)) / minhash.PERMUTATIONS
            assert abs(row["near_next"] - max(0, (same - 1 / 256) / (1 - 1 / 256))) < 1e-9


def test_fingerprints_of_odd_rows(spark):
    docs = fixtures.odd(spark)
    rows = minhash.edit_test(docs).collect()
    assert len(rows) == docs.count()
    one = minhash.edit_test(fixtures.table(spark, ["a b c d e f g h i"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert minhash.edit_test(fixtures.empty(spark)).count() == 0
    by_text = {}
    for row in minhash.edit_test(fixtures.table(spark, ["x y z", "x y z", "", None, "X Y Z"])).collect():
        by_text.setdefault(row["fingerprint"], set()).add(row["doc_id"])
    assert sorted(map(sorted, by_text.values())) == [[0, 1, 4], [2, 3]]


def test_filter_has_no_false_negatives(spark):
    values = [-(2**63), -1, 0, 1, 2**63 - 1, 12345678901234, -987654321]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    from pyspark.sql import functions as F

    filled = similarity.filter_bits(F.col("v"), rows)
    assert similarity.may_hold(filled, np.array(values)).all()
    assert not similarity.may_hold(filled, np.arange(100, 1000)).any()
