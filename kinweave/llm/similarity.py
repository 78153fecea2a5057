"""Sets of word shingles and the exact check of candidate pairs.

A document is known by the key of its set: a 64-bit hash of the set's shingle hashes, so
that documents with equal sets are one node from the start, however many they are. An
empty set has no key. Sets are made from whole texts in bounded slices, and only those
of candidates ever leave the executors' memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_map, id_and_text, meet, ship_code, stored, tidy
from kinweave.llm.components import components
from kinweave.llm.words import LOWER, NOT_SPACE, Texts, distinct, mix, shingles, slices

#: Bits of a filter: 4 MB, sent to every task; more entries only let more rows pass it.
FILTER_BITS = 25


def sets(part: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash) of distinct shingles in order, set sizes and keys by text."""
    part = Texts(part.offsets, LOWER[part.data])
    text, start, end = part.spans(NOT_SPACE[part.data])
    text, value = shingles(text, part.hashes(start, end), size, part.n)
    count = part.per_text(text)
    return text, value, count, set_keys(value, count)


def set_keys(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value), out=sums[1:])
    end = np.cumsum(count)
    total = sums[end] - sums[end - count]
    return mix(total + mix(count.astype(np.uint64))).view(np.int64)


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, key) for each row of `docs`; no key for an empty set."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, part in slices(batch):
            _, _, count, key = sets(part, size)
            yield {"doc_id": rows.column("doc_id"), "n_shingles": count, "key": pa.array(key, mask=count == 0)}

    return arrow_map(id_and_text(docs), work, "doc_id long, n_shingles long, key long")


def filter_bits(values: Column, rows: DataFrame) -> np.ndarray:
    """A filter of fixed size: the bits at the low bits of `values` are set.

    At most 1,024 rows of 4 KB come to the driver, whatever the size of `rows`.
    """
    place = rows.select(values.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("place"))
    maps = place.groupBy(F.shiftright("place", 15).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits")
    )
    filled = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for bucket, bits in maps.collect():
        filled[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return filled


def may_hold(filled: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values & np.int64((1 << FILTER_BITS) - 1)
    return (filled[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def filtered_sets(docs: DataFrame, size: int, keys: DataFrame, column: str, kind: str, make: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """(key, `column`): `make(items, n)` of each set in `keys`, and by chance of a few others.

    A task sends equal sets of a slice once; those of several slices are met with by the caller.
    """
    filled = docs.sparkSession.sparkContext.broadcast(filter_bits(F.col("key"), keys))

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, part in slices(batch):
            _, value, count, key = sets(part, size)
            hit = np.flatnonzero((count > 0) & may_hold(filled.value, key))
            hit = hit[np.unique(key[hit], return_index=True)[1]]
            end = np.cumsum(count)
            yield {"key": key[hit], column: [make(value[end[h] - count[h] : end[h]], int(count[h])) for h in hit]}

    return arrow_map(id_and_text(docs), work, f"key long, {column} {kind}")


#: Items for each counter of a sketch.
SKETCHED = 4


def sketch(items: np.ndarray, n: int) -> bytes:
    """Counts of items by hash, after their number; about a byte for each four items.

    The number of counters depends on a power of two near n; `apart` folds longer ones.
    """
    size = 1 << max(0, (n // SKETCHED).bit_length())
    counts = np.bincount((mix(items ^ np.uint64(0xABCD)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.concatenate([[n], counts]).astype("<u2" if counts.max(initial=0) < 65536 and n < 65536 else "<u4").tobytes() + bytes([n < 65536])


def _read_sketch(data: bytes) -> tuple[int, np.ndarray]:
    values = np.frombuffer(data[:-1], "<u2" if data[-1] else "<u4").astype(np.int64)
    return int(values[0]), values[1:]


def may_be_similar(one: bytes, two: bytes, percent: int) -> bool:
    """False only if the sets differ in more items than similar sets can."""
    (n_one, a), (n_two, b) = _read_sketch(one), _read_sketch(two)
    size = min(len(a), len(b))
    apart = np.abs(a.reshape(-1, size).sum(axis=0) - b.reshape(-1, size).sum(axis=0)).sum()
    return int(apart) * (100 + percent) <= (100 - percent) * (n_one + n_two)


def possible_pairs(docs: DataFrame, size: int, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys that their sketches don't rule out."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    sketches = filtered_sets(docs, size, keys, "sketch", "binary", sketch).groupBy("key").agg(F.min("sketch").alias("sketch"))
    sketches = stored(sketches, "sets-sketches")
    both = meet(pairs, sketches.select(F.col("key").alias("a"), F.col("sketch").alias("one")), "a")
    both = meet(both, sketches.select(F.col("key").alias("b"), F.col("sketch").alias("two")), "b")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        tested = zip(batch.column("one").to_pylist(), batch.column("two").to_pylist())
        keep = pa.array([may_be_similar(one, two, percent) for one, two in tested], pa.bool_())
        yield {name: batch.column(name).filter(keep) for name in ("a", "b")}

    return arrow_map(both, work, "a long, b long")


#: Sets in a block: two blocks at most are in a task's memory at once.
BLOCK = 512


def links_in_clusters(docs: DataFrame, size: int, clusters: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of similar sets that connect what is connected, within `clusters` (node, root).

    A cluster's sets are dealt into blocks by hash, and each pair of blocks is one tile, so
    a large cluster is spread over many tasks and each set goes to as many tiles as its
    cluster has blocks. A tile counts shared items by an inverted list and sends the links
    of a spanning forest.
    """
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = meet(clusters, sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", other)
    tiles = tiles.select(
        F.col("node").alias("key"), "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("first")
    )
    made = filtered_sets(docs, size, clusters.select(F.col("node").alias("key")), "items", "array<long>", lambda items, _: items.view(np.int64))
    placed = meet(made, tiles, "key").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            places = zip(*(batch.column(name).to_pylist() for name in ("root", "low", "high")))
            items = batch.column("items")
            for i, (place, key, first) in enumerate(zip(places, batch.column("key").to_pylist(), batch.column("first").to_pylist())):
                if place != tile:
                    if len(held) > 1:
                        yield _links(held, tile[1] == tile[2], percent)
                    tile, held = place, {}
                held[key] = first, items[i].values.to_numpy()
        if len(held) > 1:
            yield _links(held, tile[1] == tile[2], percent)

    return placed.mapInArrow(tidy(run), "a long, b long")


def _links(held: dict[int, tuple[bool, np.ndarray]], one_block: bool, percent: int) -> pa.RecordBatch:
    keys = list(held)
    count = np.array([len(held[key][1]) for key in keys])
    item, holder = np.concatenate([held[key][1] for key in keys]), np.repeat(np.arange(len(keys)), count)
    _, item = np.unique(item, return_inverse=True)
    order = np.argsort(item, kind="stable")
    holder_of = holder[order]
    starts = np.searchsorted(item[order], np.arange(item.max(initial=-1) + 2))
    cut = np.cumsum(count) - count
    root = np.arange(len(keys))
    found: list[tuple[int, int]] = []
    for i in range(len(keys)):
        if not one_block and not held[keys[i]][0]:
            continue
        own = item[cut[i] : cut[i] + count[i]]
        lengths = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(holder_of[at], minlength=len(keys))
        near = np.flatnonzero(100 * shared >= percent * (count[i] + count - shared))
        for j in near[root[near] != root[i]]:
            if root[j] != root[i]:
                found.append((keys[i], keys[j]))
                root[root == root[j]] = root[i]
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


Signatures = Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]
_TAG = np.uint64(24)


def memberships(docs: DataFrame, size: int, signatures: Signatures, round_: int = 0, keys: DataFrame | None = None, buffered: int = 1 << 20) -> DataFrame:
    """(bucket, tag): documents whose signature another document with another set has.

    `signatures` maps sets (text, shingle hash, sizes) and a round to (text, signature). With
    `keys` only those sets, and by chance a few others, are signed. A map task
    deals its signatures out to parts of the hash range and sends each part's as one
    binary row, nine bytes a signature: four of the signature and a tag of five, the top
    of the set's key. Equal sets of a task send theirs once. A reducer sorts a part by
    itself, so a bucket costs what it holds. Chance meetings in 40 bits and more only add
    candidates, which are checked.
    """
    spark = docs.sparkSession
    ship_code(spark)
    # Parts follow the number of partitions that the session was sized to.
    n_parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = None if keys is None else spark.sparkContext.broadcast(filter_bits(F.col("key"), keys))

    def deal(tag: np.ndarray, signature: np.ndarray) -> dict:
        part = ((signature >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
        low = signature & np.uint64(0xFFFFFFFF)
        # Equal signatures of equal sets next to each other, parts in order.
        order = np.lexsort((tag, low, part))
        part, low, tag = part[order], low[order], tag[order]
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (low[1:] != low[:-1]) | (tag[1:] != tag[:-1])
        part, low, tag = part[new], low[new], tag[new]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(cut[1:], len(part))
        low4, tag5 = low.astype("<u4"), tag.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        return {"part": part[cut], "entries": [low4[a:b].tobytes() + tag5[a:b].tobytes() for a, b in zip(cut, ends)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("part", pa.int64()), ("entries", pa.binary())])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, part in slices(batch):
                text, value, count, key = sets(part, size)
                first = np.zeros(part.n, bool)
                first[np.unique(key, return_index=True)[1]] = True
                if filled is not None:
                    first &= may_hold(filled.value, key)
                keep = first[text]
                text, signature = signatures(text[keep], value[keep], np.where(first, count, 0), round_)
                held.append(((key.view(np.uint64) >> _TAG)[text], signature))
                if sum(len(s) for _, s in held) >= buffered:
                    yield pa.RecordBatch.from_pydict(deal(*map(np.concatenate, zip(*held))), kind)
                    held = []
        if held:
            yield pa.RecordBatch.from_pydict(deal(*map(np.concatenate, zip(*held))), kind)

    dealt = id_and_text(docs).mapInArrow(tidy(run), "part long, entries binary")
    dealt = dealt.repartition("part").sortWithinPartitions("part")

    def met(part: int, entries: list[bytes]) -> pa.RecordBatch:
        lows, tags = [], []
        for entry in entries:
            n = len(entry) // 9
            lows.append(np.frombuffer(entry, "<u4", n))
            tag = np.zeros((n, 8), np.uint8)
            tag[:, :5] = np.frombuffer(entry, np.uint8, 5 * n, 4 * n).reshape(n, 5)
            tags.append(tag.view("<u8")[:, 0])
        low, tag = distinct(np.concatenate(lows), np.concatenate(tags))
        several = np.zeros(len(low), bool)
        several[1:] = low[1:] == low[:-1]
        several[:-1] |= several[1:]
        bucket = np.int64(part) * np.int64(1 << 32) + low[several].astype(np.int64)
        return pa.RecordBatch.from_pydict({"bucket": bucket, "tag": tag[several].astype(np.int64)})

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, entries = None, []
        for batch in batches:
            for number, entry in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist()):
                if number != part and entries:
                    yield met(part, entries)
                    entries = []
                part = number
                entries.append(entry)
        if entries:
            yield met(part, entries)

    return dealt.mapInArrow(tidy(reduce), "bucket long, tag long")


def tag_column() -> Column:
    return F.shiftrightunsigned("key", 24)


#: Buckets of more members are met with in another round.
SMALL_BUCKET, ROUNDS = 16, 3


def link_sets(docs: DataFrame, table: DataFrame, size: int, percent: int, signatures: Signatures, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) over keys of sets that links connect; sets without a link are left out.

    `table` is `set_table(docs, size)`, stored. Similar sets share a bucket in each round of
    signatures. Members of a small bucket are paired, so pairs stay linear in members; the
    pairs pass an exact lower bound of their distance, from sketches. Members of a large
    bucket (a common passage, or many near copies) are signed anew in the next round, where
    similar ones meet again and unlike ones scatter. What the last round still finds in
    large buckets is tied to one member of its bucket. Pairs and ties make clusters, and
    within each every pair is checked exactly (links_in_clusters). No bucket is capped or
    dropped: all pairs of a bucket are either tested or end in one cluster.
    """
    keys = stored(table.filter("key is not null").select("key").distinct(), "sets-keys").withColumn("tag", tag_column())
    edges, again = [], None
    for round_ in range(rounds):
        members = meet(memberships(docs, size, signatures, round_, again), keys, "tag").select("bucket", "key")
        members = stored(members, "sets-members")
        buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("least"))
        members = stored(meet(members, buckets, "bucket"), "sets-buckets")
        small, large = members.filter(F.col("n") <= SMALL_BUCKET), members.filter(F.col("n") > SMALL_BUCKET)
        left, right = small.select("bucket", F.col("key").alias("a")), small.select("bucket", F.col("key").alias("b"))
        pairs = stored(meet(left, right, "bucket").filter("a < b").select("a", "b").distinct(), "sets-pairs")
        edges.append(possible_pairs(docs, size, pairs, percent))
        if round_ + 1 == rounds:
            edges.append(large.filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct())
        again = large.select("key").distinct()
        if again.isEmpty():
            break
    every = edges[0]
    for more in edges[1:]:
        every = every.union(more)
    clusters = stored(components(every), "sets-clusters")
    return components(links_in_clusters(docs, size, clusters, percent))
