"""Packing as an exact cover of the tokens; toxicity by full scans and held-out rows."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinweave.llm import packing, toxicity
from kinweave.llm.common import documents
from tests.llm import fixtures

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check_cover(rows, ids):
    """Pieces cover each document once; sequences are gapless; gives lengths by sequence."""
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row["doc_id"], []).append(row)
        by_sequence.setdefault(row["sequence_id"], []).append(row)
    assert set(by_doc) == set(ids)
    for doc_id, pieces in by_doc.items():
        at = 0
        for piece in sorted(pieces, key=lambda p: p["start"]):
            assert piece["start"] == at and piece["doc_tokens"] == len(ids[doc_id])
            at += piece["length"]
            assert piece["ids_crc32"] == zlib.crc32(np.array(ids[doc_id][piece["start"] : at], "<u4").tobytes())
        assert at == len(ids[doc_id])
    lengths = {}
    for sequence, pieces in by_sequence.items():
        at = 0
        for piece in sorted(pieces, key=lambda p: p["offset"]):
            assert piece["offset"] == at and piece["length"] > 0
            at += piece["length"]
        assert at <= packing.WINDOW and (at & (at - 1)) == 0
        lengths[sequence] = at
    return lengths, by_sequence


@pytest.mark.parametrize("shard_windows,targets", [(1024, None), (2, None), (3, {"s0": 0.7, "s1": 0.3})])
def test_packing_covers_all_tokens(spark, tokenizer, monkeypatch, shard_windows, targets):
    monkeypatch.setattr(packing, "SHARD_WINDOWS", shard_windows)
    monkeypatch.setattr(packing.Schedule.__init__, "__defaults__", (packing.WINDOW * shard_windows,))
    docs = fixtures.real(spark).drop("source").union(fixtures.table(spark, fixtures.ODD_TEXTS, range(10**6, 10**6 + len(fixtures.ODD_TEXTS))).drop("source"))
    from pyspark.sql import functions as F

    docs = docs.withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)))
    ids = {r["doc_id"]: ids_of(tokenizer, r["text"]) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    lengths, sequences = check_cover(packing.pack(docs, targets).collect(), ids)
    if targets is None and shard_windows == 1024:
        total = {}
        for doc_id, values in ids.items():
            total[source[doc_id]] = total.get(source[doc_id], 0) + len(values)
        given, whole = dict.fromkeys(total, 0), sum(total.values())
        behind = 2 * packing.RUN * sum(1 / i for i in range(1, len(total) + 1))
        for sequence in sorted(sequences):
            for piece in sorted(sequences[sequence], key=lambda p: p["offset"]):
                given[source[piece["doc_id"]]] += piece["length"]
                for name, n in total.items():
                    assert -behind < given[name] - sum(given.values()) * n / whole < 2 * packing.RUN
        assert sum(map(len, sequences.values())) < 4 * len(ids)


def plain_packer(queues, shares):
    """(doc, start, length) in order, by exact fractions and a step at a time."""
    deficit, out, waiting = [Fraction(0)] * len(queues), [], [[[doc, 0, n] for doc, n in queue] for queue in queues]
    while any(waiting):
        live = [q for q, queue in enumerate(waiting) if queue]
        queue = max(live, key=lambda q: (deficit[q], -q))
        doc, start, left = waiting[queue][0]
        run = left if left < 2 * packing.RUN else packing.RUN
        out.append((doc, start, run))
        waiting[queue][0] = [doc, start + run, left - run]
        if run == left:
            waiting[queue].pop(0)
        deficit = [d + share * run for d, share in zip(deficit, shares)]
        deficit[queue] -= run  # queues that have ended are out of `live`
    return out


def test_shards_equal_a_plain_packer():
    rng = random.Random(4)
    for _ in range(30):
        shares = [Fraction(n, 16) for n in rng.choice([(8, 4, 2, 2), (16,), (1, 15), (4, 4, 4, 4), (13, 1, 1, 1)])]
        queues, pieces, number = [], [], 0
        for share in shares:
            sizes = [rng.choice([1, 2, 30, 511, 1023, 1024, 1025, 5000]) for _ in range(rng.randrange(1, 9))]
            queues.append([(number + i, n) for i, n in enumerate(sizes)])
            pieces.append([(number + i, 0, n, np.arange(n).astype(np.uint16)) for i, n in enumerate(sizes)])
            number += len(sizes)
        got = list(packing.pack_shard(pieces, lambda n: n * np.array([float(s) for s in shares]), 7))
        runs, tokens = plain_packer(queues, shares), []
        for doc, start, n in runs:
            tokens += [(doc, start + i) for i in range(n)]
        assert [(row[0], row[1] + i) for row in got for i in range(row[2])] == tokens
        sequences = {}
        for row in got:
            assert row[6] == sum(r[2] for r in sequences.setdefault(row[5], []))
            sequences[row[5]].append(row)
        sizes = [sum(r[2] for r in rows) for _, rows in sorted(sequences.items())]
        full = len(tokens) // packing.WINDOW
        assert sizes[:full] == [packing.WINDOW] * full and sizes[full:] == [1 << b for b in range(9, -1, -1) if len(tokens) % packing.WINDOW >> b & 1]


def test_named_targets_have_queues_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 1)
    docs = fixtures.table(spark, ["word " * 3000] * 12 + ["few words " * 40] * 12, sources=["large"] * 12 + ["small"] * 6 + ["other"] * 6)
    rows = sorted(packing.pack(docs, {"large": 0.5, "small": 0.5}).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    small = {i for i in range(12, 18)}
    total = sum(r["length"] for r in rows if r["doc_id"] in small)
    held = {name: 0 for name in (True, False)}
    for row in rows:
        held[row["doc_id"] in small] += row["length"]
        if held[True] < total:
            assert abs(held[True] - held[False]) < 6 * packing.RUN
    assert {r["doc_id"] for r in rows[-6:]} & set(range(18, 24))


def test_special_strings_are_text(tokenizer):
    for text in ["<|endoftext|>", "a <|endoftext|> b", "퟿ \U0001f600", " \n\n  x", "it's  we'll"]:
        assert packing.encode(text).tolist() == ids_of(tokenizer, text)


def test_added_token_is_one_id(spark):
    """Documents as the tokenizer reads them by default, through the whole operator."""
    by_default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"{end}{end}", f"a  {end}\n\n{end} x", "<|endoftext|", f"<{end}>", f"it{end}'s", "plain", "", None]
    for text in texts:
        assert packing.document_ids(text).tolist() == ids_of(by_default, text)
    ids = {i: ids_of(by_default, text) for i, text in enumerate(texts)}
    assert ids[1][2] == 50256
    check_cover(packing.pack(fixtures.table(spark, texts)).collect(), ids)


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_long_runs_of_white_space(tokenizer, blank):
    text = f"a{blank * 1_200_000}x y"
    assert packing.encode(text).tolist() == ids_of(tokenizer, text)


def test_cut_runs_equal_uncut(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "LONG_BLANK", 2)
    monkeypatch.setattr(packing, "_BLANK", re.compile(packing._BLANK.pattern.replace("100000", "2")))
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t\r\x1c\x1f\x85\xa0\u2003\u200b\u3000\u180e  aé'1!s") for _ in range(rng.randrange(30)))
        assert packing.encode(text).tolist() == ids_of(tokenizer, text), repr(text)


def test_packing_of_odd_rows(spark, tokenizer):
    docs = fixtures.odd(spark)
    rows = packing.pack(docs).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(tokenizer, r["text"])) for r in docs.collect())
    assert packing.pack(fixtures.empty(spark)).count() == 0


def test_schedule_is_exact():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 50, 5000, 40_000]) for _ in range(6)]
        weights = [rng.choice([0, 1, 2.5]) for _ in sizes]
        schedule = packing.Schedule(sizes, weights, 1000)
        before = [schedule.before(s) for s in range(schedule.n_shards + 1)]
        assert (before[0] == 0).all() and (before[-1] == sizes).all()
        for shard, (a, b) in enumerate(zip(before, before[1:])):
            assert (b >= a).all() and (b - a).sum() <= 1000 + len(sizes)
            for queue in range(6):
                for place in {int(a[queue]), int(b[queue]) - 1} & set(range(int(a[queue]), int(b[queue]))):
                    assert schedule.shard_of(queue, place) == shard


def test_block_max_index_equals_full_scan():
    rng = np.random.default_rng(3)
    n_terms, n_examples = 30, 500
    number = np.repeat(np.arange(n_examples), rng.integers(0, 6, n_examples))
    term = rng.integers(0, n_terms, len(number))
    pair = np.unique(number * n_terms + term)
    number, term = pair // n_terms, pair % n_terms
    weight = rng.choice([0.25, 0.5, 1.0], len(pair))
    index = toxicity.BlockMaxIndex(number, term, weight, n_terms, n_examples)
    dense = np.zeros((n_examples, n_terms))
    dense[number, term] = weight
    for _ in range(200):
        asked = rng.choice(n_terms, rng.integers(1, 5), replace=False)
        values = rng.choice([0.5, 1.0], len(asked))
        without = int(rng.integers(-1, 5))
        full = dense[:, asked] @ values
        if without >= 0:
            full[without] = 0
        wanted = [i for i in np.lexsort((np.arange(n_examples), -np.round(full, 12))) if full[i] > 0][:20]
        found, cosine = index.nearest(asked, values, 20, without)
        assert found.tolist() == wanted and np.allclose(cosine, full[wanted])


def test_monotone_fit():
    raw = np.array([0.1, 0.2, 0.3, 0.4])
    steps, values = toxicity.monotone(raw, np.array([0.0, 1.0, 0.0, 1.0]))
    assert len(steps) == 3 and (np.diff(values) > 0).all() and (values >= 0).all() and (values <= 1).all()


def plain_scores(docs, labels):
    """{doc_id: score} by sets, dense products and full sorts, without hashes or an index."""
    word, lower = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {c: c + 32 for c in range(65, 91)}
    counts = {r["doc_id"]: Counter(word.findall((r["text"] or "").translate(lower))) for r in docs.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    copies = {}
    for r in docs.collect():
        if r["doc_id"] in marks:
            copies.setdefault(r["text"], []).append(r["doc_id"])
    marks = {min(same): max(marks[i] for i in same) for same in copies.values()}  # equal texts are one example
    ids = sorted(marks)
    toxic, n = sum(marks[i] for i in ids), len(ids)
    held, bad = Counter(w for i in ids for w in counts[i]), Counter(w for i in ids if marks[i] for w in counts[i])
    reach = [sum(k >= least for k in held.values()) for least in range(1, n + 1)]
    bar = next(np.log(k) for least, k in enumerate(reach, 1) if k <= (n / toxic) ** least)

    def surprise(w):
        a, b = bad[w], held[w] - bad[w]
        return sum(k * np.log(k * n / (held[w] * of)) for k, of in ((a, toxic), (b, n - toxic)) if k)

    terms = [w for w in held if bad[w] * n > held[w] * toxic and surprise(w) >= bar]
    idf = {w: np.log(1 + len(counts) / sum(w in c for c in counts.values())) for w in terms}
    vectors = {}
    for i, c in counts.items():
        v = np.array([(1 + np.log(c[w])) * idf[w] if c[w] else 0.0 for w in terms])
        vectors[i] = v / max(np.linalg.norm(v), 1e-300)
    share = toxic / n
    bare = [marks[i] for i in ids if not vectors[i].any()]
    indexed = [i for i in ids if vectors[i].any()]

    def raw(v, without=None):
        near = sorted(((v @ vectors[i], marks[i]) for i in indexed if i != without and v @ vectors[i] > 0), key=lambda x: -x[0])
        assert len(near) <= toxicity.NEIGHBOURS  # so that no tie is cut
        return (sum(c * y for c, y in near) + 0.25 * share) / (sum(c for c, _ in near) + 0.25)

    steps, values = toxicity.monotone(np.array([raw(vectors[i], i) for i in indexed]), np.array([float(marks[i]) for i in indexed]))
    without = np.mean(bare) if bare else share
    return terms, {i: np.interp(raw(v), steps, values) if v.any() else without for i, v in vectors.items()}


def test_scores_equal_plain_scores(spark):
    folder = SF.replace("0.01", "0.001")
    docs, labels = documents(spark, folder), documents(spark, folder, "labels")
    terms, wanted = plain_scores(docs, labels)
    assert terms  # few labels are enough for some
    found = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    assert found.keys() == wanted.keys()
    assert all(abs(found[i] - wanted[i]) < 1e-9 for i in wanted)


def test_surprise_bounds_the_chance(spark):
    cases = [(n, a) for n in (2, 5, 40) for a in range(n + 1) if a * 10 >= n]
    rows = spark.createDataFrame(cases, "n long, a long").withColumn("s", toxicity.surprise(10, 90)).collect()
    for r in rows:
        tail = sum(comb(r["n"], k) * 0.1**k * 0.9 ** (r["n"] - k) for k in range(r["a"], r["n"] + 1))
        assert tail <= np.exp(-r["s"]) * (1 + 1e-9)
    assert toxicity.chance_bar({1: 90, 2: 60, 3: 5}, 0.1) == np.log(65)
    assert toxicity.chance_bar({1: 5}, 0.9) == toxicity.chance_bar({}, 0.5) == float("inf")


def test_held_out_accuracy(spark):
    docs, labels = documents(spark, SF.replace("0.01", "0.1")), documents(spark, SF.replace("0.01", "0.1"), "labels")
    scored = toxicity.score_documents(docs, labels)
    assert scored.filter("score < 0 or score > 1 or score is null").isEmpty()
    rows = scored.filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hits = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hits >= 0.85 * sum(r["toxic"] for r in rows) and hits >= 0.85 * sum(r["predicted"] for r in rows)


def test_toxicity_of_odd_rows(spark):
    docs = fixtures.odd(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (90, None)], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, labels).count() == docs.count()
    nothing = labels.limit(0)
    assert {r["score"] for r in toxicity.score_documents(docs, nothing).collect()} == {0.0}
    assert toxicity.score_documents(fixtures.empty(spark), labels).count() == 0
    model = toxicity.fit(docs, labels)
    assert toxicity.with_scores(docs, model).columns == [*docs.columns, "toxic_score", "toxic_evidence"]
