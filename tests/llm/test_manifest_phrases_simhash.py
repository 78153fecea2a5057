"""Merkle manifest, collocations and SimHash groups against plain definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import collocations, merkle, simhash
from tests.llm import brute, fixtures


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    values = [row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + more, row.text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + 2])) for i in range(0, len(found[-1]), 2)])
    return found


def path(tree, at):
    """(siblings left, siblings right) a level."""
    steps = []
    for nodes in tree[:-1]:
        pair = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        steps.append((pair[:1], []) if at % 2 else ([], pair[1:]))
        at //= 2
    return steps


def manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row.lang].append(row)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[name] = levels([leaf(r) for r in groups[name]])
    top = levels([trees[name][-1][0] for name in names])
    for number, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            steps = path(trees[name], at) + path(top, number)
            changed = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0 and row.n_chars is not None
            folded = leaf(row, int(changed))
            for left, right in steps:
                folded = sha("".join([*left, folded, *right]))
            proof = sha("".join(d for left, right in steps for d in [*left, *right]))
            yield row.doc_id, leaf(row), trees[name][-1][0], top[-1][0], proof, folded, folded == top[-1][0]


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_by_blocks_of_any_size(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 1 << height)
    rng = random.Random(height)
    rows = [(i, f"text {i}é", rng.choice(["en", "de", "é", "", None, "zz"]), None if i % 9 == 0 else "s", i) for i in range(60)]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    assert rows_of(merkle.manifest(docs)) == sorted(manifest(docs.collect()), key=repr)


def test_manifest_of_odd_rows(spark):
    docs = fixtures.odd(spark)
    assert rows_of(merkle.manifest(docs)) == sorted(manifest(docs.collect()), key=repr)
    assert merkle.manifest(fixtures.empty(spark)).count() == 0
    one = docs.limit(1)
    assert rows_of(merkle.manifest(one)) == list(manifest(one.collect()))


def test_manifest_many_languages_and_wide_numbers(spark):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.col("id").cast("string").alias("lang"), F.lit(None).cast("string").alias("source"),
        F.lit(2**63 - 1).alias("n_chars"),
    )
    assert rows_of(merkle.manifest(docs)) == sorted(manifest(docs.collect()), key=repr)


def test_witnesses_grow_by_each_append():
    leaves = [bytes([i]) * 32 for i in range(21)]
    for n in range(1, 22):
        frontier = merkle.Frontier()
        for digest in leaves[:n]:
            frontier.append(digest)
        assert [height for height, _, _ in frontier.open] == [b for b in range(5, -1, -1) if n >> b & 1]
        root, witnesses = frontier.close(None)
        tree = [leaves[:n]]
        while len(tree[-1]) > 1:
            tree.append([merkle.node(*tree[-1][i : i + 2]) for i in range(0, len(tree[-1]), 2)])
        assert root == tree[-1][0] and all(merkle.fold(d, bytes(w)) == root for d, w in zip(leaves, witnesses))


def phrases(rows, threshold, top):
    words, counts = Counter(), defaultdict(Counter)
    for row in rows:
        lang = "und" if row.lang is None else row.lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(row.text)):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            for size in range(1, 5):
                counts[lang].update(tuple(found[i : i + size]) for i in range(len(found) - size + 1))
    result = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        gone = {
            longer[i : i + size]
            for longer, n in candidates.items()
            for size in range(2, len(longer))
            for i in range(len(longer) - size + 1)
            if 100 * n >= 80 * candidates[longer[i : i + size]]
        }
        ranked = []
        for p, a in candidates.items():
            if p in gone:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, name, left, right) in enumerate(sorted(ranked)[:top], 1):
            result.append((lang, rank, name.decode(), -a, left, right, words[lang], -score))
    return sorted(result, key=repr)


def babble(seed, n_texts, n_words=200):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdeÉ" for b in "xyz"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = []
    for _ in range(n_texts):
        words = rng.choices(vocabulary, weights, k=n_words)
        texts.append("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",\n"]) for w in words))
    return texts


def test_phrases_equal_plain_counts(spark):
    texts = [*babble(1, 40), None, "", "new york city " * 50, "A b. C"]
    rows = [(i, t, [None, "und", "en", "de"][i % 4], "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    assert rows_of(collocations.collocations(docs)) == phrases(docs.collect(), 30, 2000)
    assert rows_of(collocations.collocations(docs, 10, 7)) == phrases(docs.collect(), 10, 7)


def test_phrases_when_tasks_send_often(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "COUNTED", 20)
    docs = fixtures.table(spark, babble(2, 30)).repartition(7)
    assert rows_of(collocations.collocations(docs)) == phrases(docs.collect(), 30, 2000)


def test_phrases_of_odd_rows(spark):
    docs = fixtures.odd(spark)
    assert rows_of(collocations.collocations(docs, 2)) == phrases(docs.collect(), 2, 2000)
    assert collocations.collocations(fixtures.empty(spark)).count() == 0


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(3)
    values = np.concatenate([np.repeat(np.arange(40), 30), rng.integers(1000, 100_000, 20_000)]).astype(np.uint64)
    rng.shuffle(values)
    summary = collocations.Summary(len(values) // 30 + 1)
    for some in np.array_split(values, 50):
        summary.add(*collocations.summed(some, np.ones(len(some), np.int64)))
        summary.merge()
    exact = Counter(values.tolist())
    estimates = dict(zip(summary.value.tolist(), summary.count.tolist()))
    assert summary.taken < 30 and len(estimates) <= summary.capacity
    for value, n in exact.items():
        assert estimates.get(value, 0) <= n <= estimates.get(value, 0) + summary.taken
    assert all(estimates[v] + summary.taken >= 30 for v in range(40))


def test_entries_survive_packing():
    low = np.array([0, 1, 5, 2**31, 2**32 - 1], np.int64)
    got = collocations.unpack_entries(collocations.pack_entries(low, np.array([1, 2, 255, 256, 2**31])))
    assert got[0].tolist() == low.tolist() and got[1].tolist() == [1, 2, 255, 256, 2**31]


def fingerprint(text):
    words = brute.SPACE_WORD.findall(brute.lower(text))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(run, seed=42) for run in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(prints, ids):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for place, doc_id in enumerate(ids):
        if doc_id is not None:
            least[find(place)] = min(doc_id, least.get(find(place), doc_id))
    return [least.get(find(place)) for place in range(len(prints))]


def expected(docs):
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    found = groups(prints, [r.doc_id for r in rows])
    return sorted(((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, found)), key=repr)


def test_simhash_of_odd_rows_and_near_copies(spark):
    docs = fixtures.odd(spark)
    assert rows_of(simhash.near_copies(docs)) == expected(docs)
    rng = random.Random(5)
    base = [[f"w{rng.randrange(900)}" for _ in range(400)] for _ in range(6)]
    texts = []
    for i in range(90):
        words = list(base[i % 6])
        for _ in range(i % 4):
            words[rng.randrange(400)] = "edit"
        texts.append(" ".join(words))
    docs = fixtures.table(spark, texts)
    got = rows_of(simhash.near_copies(docs))
    assert got == expected(docs) and len({c for _, _, c in got}) < 30
    assert simhash.near_copies(fixtures.empty(spark)).count() == 0


def test_simhash_long_text_with_many_runs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_RUNS", 7)
    assert simhash.fingerprint(b"a b c d e f g h i j k l m n o p a b c d").hex() == f"{fingerprint('a b c d e f g h i j k l m n o p a b c d'):016x}"


def components_of(prints, links):
    parent = {p: p for p in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("small,large", [(16, 4096), (2, 8), (1, 40)])
def test_lists_of_every_size_link_the_same(spark, small, large):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(prints)[:4]:
        cloud = [centre]
        for _ in range(40):
            flipped = rng.choice(cloud)
            for _ in range(rng.randrange(1, 6)):
                flipped ^= 1 << rng.randrange(64)
            cloud.append(flipped)
        prints |= set(cloud)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    state = spark.createDataFrame([(p, p) for p in signed], "print long, root long").repartition(3)
    found = components_of(signed, [tuple(r) for r in simhash.links(state, 4, small, large).collect()])
    plain = groups(sorted(prints), list(range(len(prints))))
    assert len(set(found.values())) == len(set(plain))
    ordered = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    assert len({(found[p], c) for p, c in zip(ordered, plain)}) == len(set(plain))
