"""SimHash fingerprints and groups of documents whose fingerprints differ in few bits.

A text is lower-cased (A-Z) and cut into words at white space. Each run of `SHINGLE_WORDS`
words, repeats included, is hashed with XXH64; a bit of the fingerprint is set where more
than half of the hashes have it. A shorter text is one run; a text without words, or
without a text, has the fingerprint 0, which is linked like any other.

Fingerprints that differ in at most `BITS` bits differ in at most `BITS` of their eight
bytes, so they share at least four of eight (position, byte) pairs. The inverted index has
a list for each subset of positions with its bytes, so that a list holds the fingerprints
that already reach its number of matches: the count filter is part of the key, and no
pair with fewer matches is ever made. Pairs in a list are verified by their bits.

Seven shared bytes are looked up first, then six, then the guaranteed four: lists of seven
hold 256 fingerprints at most, of six 65,536, and what they tie is one group from then on.
Later lists only compare members of different groups, so a cloud of near copies isn't
compared with itself again and again. A list sends links that span its groups, not all
pairs. Lists of more than `LARGE` members are cut into blocks, and each pair of blocks is
a task's work of its own.

Documents of equal fingerprints are one node. A group's id is its smallest doc_id; rows
without one belong to their group but don't name it. Repeated rows are rows of their own.
An empty table gives no rows. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.llm.common import arrow_map, id_and_text, record_batch, ship_code, stored, tidy
from kinweave.llm.components import components
from kinweave.llm.words import LOWER, Texts, mix, slices

SHINGLE_WORDS, SEED, BITS = 4, 42, 4
#: Numbers of shared bytes that are looked up, the guaranteed one last.
SHARED = (7, 6, 8 - BITS)
#: Lists of up to SMALL members are compared together, of more than LARGE in tiles.
SMALL, LARGE = 16, 4096
_RUNS = 1 << 16
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)
_ENTRY = np.dtype([("subset", "u1"), ("print", "<u8"), ("root", "<i8")])

LINKS = "a long, b long, list long"


def fingerprint(text: bytes) -> bytes:
    """The eight bytes, the highest bit first, of a text that is in lower case."""
    words = text.split()
    if not words:
        return bytes(8)
    joined, size = b" ".join(words), min(SHINGLE_WORDS, len(words))
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    counts = np.zeros(2048, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _RUNS):
        places = zip(starts[at : min(at + _RUNS, n)].tolist(), ends[at + size - 1 : at + size - 1 + _RUNS].tolist())
        hashed = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in places]), np.uint8).reshape(-1, 8)
        counts += np.bincount((hashed + _PLACES).ravel(), minlength=2048)
    ones = counts.reshape(8, 256) @ _BYTE_BITS
    return np.packbits((2 * ones > n).ravel()).tobytes()


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, print) for each row of `docs`; `print` is the fingerprint as a signed number."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, part in slices(batch):
            data = LOWER[part.data].tobytes()
            found = b"".join([fingerprint(data[a:b]) for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist())])
            yield {"doc_id": rows.column("doc_id"), "print": np.frombuffer(found, ">i8").astype(np.int64)}

    return arrow_map(id_and_text(docs), work, "doc_id long, print long")


def masks(shared: int) -> np.ndarray:
    """A mask of the kept bytes for each subset of `shared` of the eight positions."""
    return np.array([sum(0xFF << 8 * place for place in kept) for kept in combinations(range(8), shared)], np.uint64)


def spanning(prints: np.ndarray, roots: np.ndarray, others: slice | None = None) -> list[tuple[int, int]]:
    """Pairs of roots that similar fingerprints link, as many as span the groups.

    With `others` only pairs of one member inside that slice and one outside are compared.
    """
    names, place = np.unique(roots, return_inverse=True)
    if len(names) < 2:
        return []
    parent = np.arange(len(names))
    # The largest group is compared with the rest, and the rest with each other.
    largest = place == np.argmax(np.bincount(place))
    rows = np.flatnonzero(~largest) if others is None else np.arange(len(prints))[others]
    columns = np.arange(len(prints)) if others is None else np.setdiff1d(np.arange(len(prints)), rows)
    links = []
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        near = np.bitwise_count(prints[some][:, None] ^ prints[columns][None, :]) <= BITS
        i, j = np.nonzero(near & (parent[place[some]][:, None] != parent[place[columns]][None, :]))
        for a, b in np.unique(np.stack([parent[place[some[i]]], parent[place[columns[j]]]], axis=1), axis=0).tolist():
            a, b = _find(parent, a), _find(parent, b)
            if a != b:
                parent[a] = b
                links.append((int(names[a]), int(names[b])))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return links


def _find(parent: np.ndarray, node: int) -> int:
    while parent[node] != node:
        node = int(parent[node])
    return node


def _meet(entries: np.ndarray, mask: np.ndarray, least: int, most: int) -> dict:
    """Links of a part's lists, and the members of its lists of more than `most`."""
    key = entries["print"] & mask[entries["subset"]]
    order = np.lexsort((entries["print"], key, entries["subset"]))
    subset, key, prints, roots = entries["subset"][order], key[order], entries["print"][order], entries["root"][order]
    new = np.ones(len(key), bool)
    new[1:] = (subset[1:] != subset[:-1]) | (key[1:] != key[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    number = np.repeat(np.arange(len(start)), size)
    small = size[number] <= least
    found = []
    for step in range(1, min(least, len(key))):
        i = np.flatnonzero((number[step:] == number[:-step]) & small[step:] & (roots[step:] != roots[:-step]))
        i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= BITS]
        found.append(np.stack([roots[i], roots[i + step]], axis=1))
    large = {"a": [], "b": [], "list": []}
    for at, n in zip(start[size > least].tolist(), size[size > least].tolist()):
        group = slice(at, at + n)
        if (roots[group] == roots[at]).all():
            continue
        if n <= most:
            found.append(np.array(spanning(prints[group], roots[group]), np.int64).reshape(-1, 2))
        else:
            name = mix(np.array([key[at] + np.uint64(subset[at])], np.uint64)).view(np.int64)[0]
            for column, values in (("a", prints[group].view(np.int64)), ("b", roots[group]), ("list", np.full(n, name))):
                large[column].append(values)
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    pairs = np.unique(np.stack([pairs.min(axis=1), pairs.max(axis=1)], axis=1), axis=0)
    big = {name: np.concatenate(values) if values else np.zeros(0, np.int64) for name, values in large.items()}
    of_list = pa.array(np.concatenate([np.zeros(len(pairs), np.int64), big["list"]]), mask=np.arange(len(pairs) + len(big["list"])) < len(pairs))
    return {"a": np.concatenate([pairs[:, 0], big["a"]]), "b": np.concatenate([pairs[:, 1], big["b"]]), "list": of_list}


def links(state: DataFrame, shared: int, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """(a, b): links between groups of `state` (print, root) by `shared` equal bytes.

    Postings travel as packed rows to parts of the range of their lists' hashes; a part's
    postings are sorted by themselves.
    """
    spark = state.sparkSession
    ship_code(spark)
    n_parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    mask = masks(shared)
    dealt_kind, kind = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in ("part long, entries binary", LINKS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                some = batch.slice(at, 10_000)
                prints, roots = some.column("print").to_numpy().view(np.uint64), some.column("root").to_numpy()
                entries = np.zeros(len(prints) * len(mask), _ENTRY)
                entries["subset"] = np.tile(np.arange(len(mask), dtype=np.uint8), len(prints))
                entries["print"], entries["root"] = np.repeat(prints, len(mask)), np.repeat(roots, len(mask))
                key = mix((entries["print"] & mask[entries["subset"]]) + entries["subset"].astype(np.uint64))
                part = ((key >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, entries = part[order], entries[order]
                cut = np.flatnonzero(np.diff(part, prepend=-1))
                packed = [entries[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(part)))]
                yield record_batch({"part": part[cut], "entries": packed}, dealt_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for number, entries in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist()):
                if number != part and held:
                    yield record_batch(_meet(np.frombuffer(b"".join(held), _ENTRY), mask, small, large), kind)
                    held = []
                part = number
                held.append(entries)
        if held:
            yield record_batch(_meet(np.frombuffer(b"".join(held), _ENTRY), mask, small, large), kind)

    dealt = state.mapInArrow(tidy(deal), "part long, entries binary").repartition("part").sortWithinPartitions("part")
    found = stored(dealt.mapInArrow(tidy(run), LINKS), "simhash-links")
    return found.filter("list is null").select("a", "b").union(_in_tiles(found.filter("list is not null"), large)).distinct()


def _in_tiles(members: DataFrame, block: int) -> DataFrame:
    """(a, b): links within large lists (a: fingerprint, b: root), by pairs of blocks."""
    sizes = members.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = placed.select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("first"), "a", "b")
    kind = to_arrow_schema(StructType.fromDDL("a long, b long"))

    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by([("first", "descending")])
        first = int(np.count_nonzero(tile.column("first").to_numpy()))
        one_block = tile.column("low")[0] == tile.column("high")[0]
        found = spanning(tile.column("a").to_numpy().view(np.uint64), tile.column("b").to_numpy(), None if one_block else slice(0, first))
        return pa.Table.from_arrays([pa.array([pair[i] for pair in found], pa.int64()) for i in range(2)], schema=kind)

    return tiles.groupBy("list", "low", "high").applyInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of `docs`."""
    prints = stored(fingerprint_table(docs), "simhash-prints")
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    state = stored(least.select("print", "least", F.col("print").alias("root")), "simhash-state")
    for shared in SHARED:
        tied = components(links(state.select("print", "root"), shared)).withColumnRenamed("root", "tied")
        tied = state.join(tied, state.root == F.col("node"), "left")
        state = stored(tied.select("print", "least", F.coalesce("tied", "root").alias("root")), "simhash-state")
    groups = state.groupBy("root").agg(F.min("least").alias("component_id"))
    named = state.select("print", "root").join(groups, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
