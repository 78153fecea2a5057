"""Toxicity by the nearest labelled examples: exact TF-IDF cosine on a block-max index.

Examples are a random sample of about `EXAMPLES` labelled rows outside the held-out fold
(crc32 of the id, modulo 4, is not 2): this bounds the index, which every task gets. Terms
are the words that toxic examples have more often beyond chance: a word's surprise bounds
(Chernoff) the chance of so many toxic texts among its texts, and it has to be so small
that less than one of all words tested would get there without any difference (words in
too few texts to get there at all aren't tested). So the bar moves with the words and
isn't a fixed number; the `TERMS` most surprising are kept.
Their document frequencies come from all documents. A text is a vector of
(1 + log tf) * idf over these terms, scaled to length 1.

The index holds the examples that have a term and keeps postings by term in blocks of `BLOCK` examples with each block's largest
weight. A block's bound is the sum of query weight times block maximum; blocks are read
by falling bound until the k-th best cosine exceeds the next bound, so the k neighbours
are exactly those of a full scan (ties: lower example number). Their votes, weighted by
cosine, and the share of toxic examples make a raw score, which a monotone fit to the
examples' own leave-one-out scores calibrates. Texts without a term score the share of
toxic examples among those without one. Evidence are the ids of the nearest examples.

Labels, language, source and ids are no inputs of a score. Null and empty texts score as
texts without terms. Labels that are null are left out; of several for an id the largest
counts. Without any usable label all scores are 0. Repeated rows are scored again; rows
without an id aren't held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from kinweave.llm.common import arrow_map, id_and_text, record_batch, ship_code, stored, tidy
from kinweave.llm.words import ALNUM, LOWER, Texts, slices

EXAMPLES, TERMS = 20_000, 4_096
NEIGHBOURS, BLOCK, EVIDENCE = 25, 64, 3
THRESHOLD = 0.3
_PRIOR_WEIGHT = 0.25


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def words(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, word hash) of every word, in order."""
    part = Texts(part.offsets, LOWER[part.data])
    text, start, end = part.spans(ALNUM[part.data])
    return text, part.hashes(start, end)


def pairs(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) with counts."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


@dataclass
class Terms:
    """Selected words by hash, in order, with their inverse document frequencies."""

    hashes: np.ndarray
    idf: np.ndarray

    def count(self, part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, frequency) of the selected words in each text."""
        text, value = words(part)
        if not len(self.hashes):
            return text[:0], text[:0], text[:0]
        at = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
        hit = self.hashes[at] == value
        return pairs(text[hit], at[hit])

    def vectors(self, part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight), weights scaled to length 1 by text."""
        text, term, frequency = self.count(part)
        weight = (1 + np.log(frequency)) * self.idf[term]
        length = np.sqrt(np.bincount(text, weights=weight * weight, minlength=part.n))
        return text, term, weight / np.maximum(length[text], 1e-300)


class BlockMaxIndex:
    """Postings of the examples by term and block, with block maxima."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, n_examples: int):
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        self.n_blocks = -(-n_examples // BLOCK) if n_examples else 0
        cell = term[order] * self.n_blocks + self.example // BLOCK
        self.starts = np.searchsorted(cell, np.arange(n_terms * self.n_blocks + 1))
        self.most = np.zeros(n_terms * self.n_blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(n_terms, self.n_blocks) if n_terms else self.most

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k best positive cosines, but for one example."""
        bound = weight @ self.most[term]
        blocks = np.argsort(-bound, kind="stable")
        blocks = blocks[bound[blocks] > 0]
        found, score, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(blocks):
            if len(score) >= k and np.partition(score, -k)[-k] > bound[blocks[at]] + 1e-12:
                break
            some = blocks[at : at + step]
            at, step = at + len(some), 2 * step
            # All postings of the terms in these blocks at once.
            cells = (term[:, None] * self.n_blocks + some).ravel()
            first = self.starts[cells]
            size = self.starts[cells + 1] - first
            each = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            place = np.tile(np.arange(len(some)) * BLOCK, len(term))
            place = np.repeat(place, size) + self.example[each] % BLOCK
            product = np.repeat(np.repeat(weight, len(some)), size) * self.weight[each]
            total = np.bincount(place, weights=product, minlength=len(some) * BLOCK)
            new = np.flatnonzero(total)
            example = some[new // BLOCK] * BLOCK + new % BLOCK
            keep = example != without
            found, score = np.append(found, example[keep]), np.append(score, total[new[keep]])
        best = np.lexsort((found, -np.round(score, 12)))[:k]
        return found[best], score[best]


@dataclass
class Model:
    """All that scoring needs; its size is bounded by EXAMPLES and TERMS."""

    terms: Terms
    index: BlockMaxIndex
    label: np.ndarray
    ids: np.ndarray
    share: float
    share_without: float
    steps: np.ndarray
    values: np.ndarray

    def raw(self, term: np.ndarray, weight: np.ndarray, without: int = -1) -> tuple[float, np.ndarray]:
        found, cosine = self.index.nearest(term, weight, NEIGHBOURS, without)
        vote = (cosine @ self.label[found] + _PRIOR_WEIGHT * self.share) / (cosine.sum() + _PRIOR_WEIGHT)
        return float(vote), found

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, self.steps, self.values)) if len(self.steps) else raw

    def scores(self, part: Texts) -> tuple[np.ndarray, list[list[int]]]:
        text, term, weight = self.terms.vectors(part)
        score, evidence = np.full(part.n, self.share_without), [[] for _ in range(part.n)]
        first = np.searchsorted(text, np.arange(part.n + 1))
        for i in np.flatnonzero(np.diff(first)):
            raw, found = self.raw(term[first[i] : first[i + 1]], weight[first[i] : first[i + 1]])
            score[i] = self.calibrated(raw)
            evidence[i] = self.ids[found[:EVIDENCE]].tolist()
        return score, evidence


def monotone(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best non-decreasing fit (pool adjacent violators), slightly smoothed."""
    order = np.lexsort((-label, raw))  # equal raw scores become one pool
    pools: list[list[float]] = []  # sum of raw, sum of labels, number
    for r, y in zip(raw[order], label[order]):
        pools.append([r, float(y), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    mean = label.mean() if len(label) else 0.0
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + mean) / (p[2] + 1) for p in pools])


def surprise(toxic: int, clean: int) -> Column:
    """-log of the bound on the chance that of `n` texts with a word `a` or more are toxic.

    This is n times the divergence of the word's share of toxic texts from the share of all.
    """
    def part(k: Column, of: int) -> Column:
        expected = F.col("n") * F.lit(of / max(1, toxic + clean))
        return F.when((k > 0) & (expected > 0), k * F.log(k / expected)).otherwise(0.0)

    return part(F.col("a"), toxic) + part(F.col("n") - F.col("a"), clean)


def chance_bar(sizes: dict[int, int], share: float) -> float:
    """The surprise that less than one of the words tested reaches by chance; `sizes` is {texts: words}.

    A word in n texts can't get beyond -n log(share of toxic texts), so only words in
    enough texts to reach the bar count as tested.
    """
    tested = sum(sizes.values())
    for n in sorted(sizes):
        if np.log(tested) <= -n * np.log(max(share, 1e-300)):
            return float(np.log(tested))
        tested -= sizes[n]
    return float("inf")


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of about EXAMPLES labelled rows outside the held-out fold."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = max(1, usable.count())
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, EXAMPLES / n))
    # Bounded by EXAMPLES: about 20,000 rows of two numbers.
    return id_and_text(docs).join(F.broadcast(usable.filter(drawn)), "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    # Equal texts are one example: copies of a text would make all of its words look telling.
    drawn = training_sample(docs, labels)
    texts = drawn.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    sample = stored(texts.select("doc_id", "text", "toxic"), "toxicity-examples")

    def by_word(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, part in slices(batch):
            toxic = rows.column("toxic").to_numpy(zero_copy_only=False) > 0
            text, value, _ = pairs(*words(part))
            word, which = np.unique(value, return_inverse=True)
            n = np.bincount(which, minlength=len(word))
            yield {"word": word.view(np.int64), "n": n, "n_toxic": np.bincount(which[toxic[text]], minlength=len(word))}

    both, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    toxic = toxic or 0
    clean = both - toxic
    counted = arrow_map(sample, by_word, "word long, n long, n_toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("a"))
    counted = stored(counted, "toxicity-words")
    # Words of the larger part by label only dilute the votes: keep those of toxic texts.
    over = F.col("a") * F.lit(clean) > (F.col("n") - F.col("a")) * F.lit(toxic)
    # At most a row for each number of examples.
    sizes = {r["n"]: r["count"] for r in counted.groupBy("n").count().collect()}
    bar = chance_bar(sizes, toxic / max(1, both))
    chosen = counted.filter(over).withColumn("surprise", surprise(toxic, clean)).filter(F.col("surprise") >= bar)
    hashes = np.sort(np.array([r["word"] for r in chosen.orderBy(F.desc("surprise"), "word").limit(TERMS).collect()], np.int64).view(np.uint64))
    terms = Terms(hashes, np.ones(len(hashes)))
    terms.idf = inverse_frequencies(docs, terms)

    def vectors(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, part in slices(batch):
            text, term, weight = terms.vectors(part)
            cut = np.searchsorted(text, np.arange(part.n + 1))
            yield {
                "doc_id": rows.column("doc_id"), "toxic": rows.column("toxic"),
                "term": [term[a:b] for a, b in zip(cut, cut[1:])], "weight": [weight[a:b] for a, b in zip(cut, cut[1:])],
            }

    made = arrow_map(sample, vectors, "doc_id long, toxic int, term array<long>, weight array<double>")
    examples = made.collect()
    bare = [r["toxic"] > 0 for r in examples if not r["term"]]
    share = float(np.mean([r["toxic"] > 0 for r in examples])) if examples else 0.0
    share_without = float(np.mean(bare)) if bare else share

    def order(row) -> tuple:
        # Examples with the same leading term share blocks, which makes bounds tight.
        return row["term"][int(np.argmax(row["weight"]))], row["toxic"], row["doc_id"], row["term"], row["weight"]

    examples = sorted((r for r in examples if r["term"]), key=order)
    label = np.array([r["toxic"] > 0 for r in examples], float)
    size = [len(r["term"]) for r in examples]
    number = np.repeat(np.arange(len(examples)), size)
    term = np.array([t for r in examples for t in r["term"]], np.int64)
    weight = np.array([w for r in examples for w in r["weight"]], float)
    index = BlockMaxIndex(number, term, weight, len(hashes), len(examples))
    ids = np.array([r["doc_id"] for r in examples], np.int64)
    model = Model(terms, index, label, ids, share, share_without, np.zeros(0), np.zeros(0))
    cut = np.cumsum([0, *size])
    raw = np.array([model.raw(term[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]], i)[0] for i in range(len(examples))])
    model.steps, model.values = monotone(raw, label)
    return model


def inverse_frequencies(docs: DataFrame, terms: Terms) -> np.ndarray:
    """log(1 + N / df) over all documents; one row per term and task is summed."""
    ship_code(docs.sparkSession)
    kind = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(terms.hashes), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, part in slices(batch):
                seen += np.bincount(terms.count(part)[1], minlength=len(seen))
        held = np.flatnonzero(seen)
        yield record_batch({"term": np.append(held, -1), "n": np.append(seen[held], rows)}, kind)

    found = id_and_text(docs).mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    count = {r["term"]: r["n"] for r in found}
    df = np.array([count.get(t, 0) for t in range(len(terms.hashes))], float)
    return np.log(1 + count.get(-1, 0) / np.maximum(df, 1))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` with `toxic_score` and `toxic_evidence` (doc_ids); such columns are replaced."""
    ship_code(docs.sparkSession)
    own = docs.drop("toxic_score", "toxic_evidence")
    schema = StructType(own.schema.fields[:]).add("toxic_score", DoubleType()).add("toxic_evidence", ArrayType(LongType()))
    kind = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in slices(batch):
                score, evidence = sent.value.scores(part)
                columns = {name: rows.column(i) for i, name in enumerate(kind.names[:-2])}
                yield record_batch({**columns, "toxic_score": score, "toxic_evidence": evidence}, kind)

    return own.mapInArrow(tidy(run), schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for each row of `docs`."""
    scored = with_scores(id_and_text(docs), fit(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("toxic_evidence").alias("evidence"),
    )
