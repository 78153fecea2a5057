"""Document fingerprints by MinHash, likeness of fingerprints, and near copies by bands.

A text is lower-cased (A-Z), cut into words at white space and into distinct runs of
`SHINGLE_WORDS` words. `PERMUTATIONS` multiply-add-shift hash functions take the least
value over the runs in numpy. A fingerprint keeps the low byte of each, in hex; two
fingerprints' likeness is the share of equal bytes, less what chance makes equal. A text
without words has the empty fingerprint, like only itself.

`near_copies` hashes bands of full values, joins the bands in Spark and checks every pair
by its exact Jaccard similarity. `edit_test` holds each text against itself with its end
replaced by the next document's beginning: rows are dealt out in runs of the order, and
the first row of each run is also sent to the run before it, so no row needs a second
pass and no window holds the table. Texts travel compressed. `fingerprints` adds the
classes to the rows of `edit_test`: the class of a text that has near copies is sent, as a
row of some bytes, to its place in the order, so finished rows aren't shuffled again.

Null texts are empty ones. The order is by descending doc_id, then text hash, rows
without an id last; repeated rows stand next to each other. A single row is its own next.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.llm.common import arrow_map, id_and_text, record_batch, ship_code, stored, tidy
from kinweave.llm.similarity import link_sets, set_table, sets
from kinweave.llm.words import SLICE_BYTES, mix, slices, texts

SHINGLE_WORDS, PERCENT = 5, 80
PERMUTATIONS, BANDS = 128, 32
_OVERSAMPLE = 8
NO_ID = -(2**63)

_at = np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)
_FACTOR = mix(_at * np.uint64(0x51ED2701)) | np.uint64(1)
_TERM = mix(_at * np.uint64(0x7FEB352D))


#: Set items that are hashed together, so that they stay in a core's cache for all functions.
_BLOCK = 1 << 15


def least_values(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text the least value of each hash function; rows of empty sets are 0."""
    out = np.zeros((len(count), PERMUTATIONS), np.uint32)
    full = np.flatnonzero(count > 0)
    ends = np.cumsum(count[full])
    at = 0
    while at < len(full):
        before = int(ends[at - 1]) if at else 0
        stop = max(int(np.searchsorted(ends, before + _BLOCK, "right")), at + 1)
        part = value[before : ends[stop - 1]]
        starts = ends[at:stop] - count[full[at:stop]] - before
        hashed, least = np.empty_like(part), np.empty((PERMUTATIONS, stop - at), np.uint64)
        for i in range(PERMUTATIONS):
            np.multiply(part, _FACTOR[i], out=hashed)
            np.add(hashed, _TERM[i], out=hashed)
            np.minimum.reduceat(hashed, starts, out=least[i])
        out[full[at:stop]] = (least >> np.uint64(32)).astype(np.uint32).T
        at = stop
    return out


def fingerprints_of(column: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(low bytes of the least values, number of distinct runs)."""
    _, value, count, _ = sets(texts(pa.array(column, pa.large_string())), SHINGLE_WORDS)
    return (least_values(value, count) & np.uint32(255)).astype(np.uint8), count


def likeness(a: np.ndarray, full_a: np.ndarray, b: np.ndarray, full_b: np.ndarray) -> np.ndarray:
    same = (a == b).mean(axis=1)
    estimate = np.clip((same - 1 / 256) / (1 - 1 / 256), 0, 1)
    return np.where(full_a & full_b, estimate, (full_a == full_b).astype(float))


def bands(text: np.ndarray, item: np.ndarray, size: np.ndarray, round_: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes as signatures of sets, for similarity.link_sets; the same in each round."""
    least = least_values(item, size).astype(np.uint64)
    rows = PERMUTATIONS // BANDS
    full = np.flatnonzero(size > 0)
    signatures = np.zeros((len(full), BANDS), np.uint64)
    for band in range(BANDS):
        hashed = np.full(len(full), band + 1, np.uint64)
        for row in range(rows):
            hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + least[full, band * rows + row])
        signatures[:, band] = hashed
    return np.repeat(full, BANDS), signatures.ravel()


def _rooted(docs: DataFrame, table: DataFrame, size: int, percent: int) -> DataFrame:
    """`table`, which has the key of each text's set, with `root`: the same for the rows of one group."""
    table = stored(table, "minhash-sets")
    found = link_sets(docs, table, size, percent, bands, rounds=1).withColumnRenamed("node", "key")
    return table.join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))


def near_copies(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id): groups of texts linked by verified band candidates.

    Pairs are found with the bands' probability (over 0.9999999 from a similarity of 0.8);
    no pair below `percent` is linked. Rows as in ngramjoin.jaccard_join.
    """
    rooted = _rooted(docs, set_table(docs, size), size, percent)
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rooted.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    )


DEALT = "chunk long, guest boolean, rank long, hash long, doc_id long, packed binary, class_id long"
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_shingles long, class_id long"
)
#: Texts with near copies: place in the order of documents, and the least doc_id of the class.
MARKS = "rank long, hash long, class_id long"


def _ordered(docs: DataFrame) -> DataFrame:
    """Adds `rank` and `hash`, whose ascending order is the order of documents."""
    return id_and_text(docs).select(
        "doc_id", "text",
        F.bitwise_not(F.coalesce("doc_id", F.lit(NO_ID))).alias("rank"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
    )


def _cuts(ordered: DataFrame) -> tuple[tuple[int, int] | None, list[tuple[int, int]]]:
    """The first row's place, and the places at which runs of rows of similar length begin.

    The driver gets a random sample of about eight places for each shuffle partition.
    """
    n, first = ordered.agg(F.count("*"), F.min(F.struct("rank", "hash"))).first()
    runs = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not n:
        return None, []
    share = F.pmod(F.xxhash64("rank", "hash", F.lit(5)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, _OVERSAMPLE * runs / n))
    sample = sorted({(r["rank"], r["hash"]) for r in ordered.filter(share).select("rank", "hash").collect()})
    begin = (first["rank"], first["hash"])
    return begin, [cut for cut in sample[::_OVERSAMPLE] if cut > begin]


def _placed_keys(ordered: DataFrame, size: int) -> DataFrame:
    """(doc_id, rank, hash, key) of each row of `ordered`; no key for an empty set."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, part in slices(batch):
            _, _, count, key = sets(part, size)
            yield {**{name: rows.column(name) for name in ("doc_id", "rank", "hash")}, "key": pa.array(key, mask=count == 0)}

    return arrow_map(ordered, work, "doc_id long, rank long, hash long, key long")


def edit_test(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: fingerprints of the text and its edited form, and likenesses."""
    return _edited(_ordered(docs), docs.sparkSession.createDataFrame([], MARKS)).drop("class_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The rows of `edit_test` with `class_id`, the least doc_id of the text's near copies.

    Classes find their texts by place, which is doc_id and text, so repeated and null ids
    don't matter. A text without near copies is its own class.
    """
    ordered = _ordered(docs)
    rooted = _rooted(docs, _placed_keys(ordered, SHINGLE_WORDS), SHINGLE_WORDS, PERCENT).filter("key is not null")
    groups = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).filter("n > 1")
    marks = rooted.join(groups, "root").select("rank", "hash", "class_id").distinct()
    return _edited(ordered, stored(marks, "minhash-marks"))


def _edited(ordered: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of `fingerprints` for classes given in `marks`."""
    ship_code(ordered.sparkSession)
    first, cuts = _cuts(ordered)
    dealt_kind, kind = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (DEALT, SCHEMA))
    begins = set(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            places = list(zip(batch.column("rank").to_pylist(), batch.column("hash").to_pylist()))
            chunks = [bisect_right(cuts, place) for place in places]
            guests = [i for i, place in enumerate(places) if place in begins]
            firsts = [i for i, place in enumerate(places) if place == first]
            rows = [*range(len(places)), *guests, *firsts]
            packed = [pack.compress((text.as_py() or "").encode()) for text in batch.column("text")]
            yield record_batch(
                {
                    "chunk": [*chunks, *(chunks[i] - 1 for i in guests), *(len(cuts) for _ in firsts)],
                    "guest": [i >= len(places) for i in range(len(rows))],
                    "packed": [packed[i] for i in rows],
                    "class_id": pa.nulls(len(rows), pa.int64()),
                    **{name: batch.column(name).take(pa.array(rows, pa.int64())) for name in ("rank", "hash", "doc_id")},
                },
                dealt_kind,
            )

    def deal_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            places = zip(batch.column("rank").to_pylist(), batch.column("hash").to_pylist())
            yield record_batch(
                {
                    "chunk": [bisect_right(cuts, place) for place in places],
                    "guest": [False] * n,
                    "doc_id": pa.nulls(n, pa.int64()),
                    "packed": pa.nulls(n, pa.binary()),
                    **{name: batch.column(name) for name in ("rank", "hash", "class_id")},
                },
                dealt_kind,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        rows: list[tuple[int | None, str, int | None]] = []
        chunk, done, held, mark = None, False, 0, (None, None)
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("chunk", "guest", "rank", "hash", "doc_id", "packed", "class_id"))
            for number, guest, rank, hash_, doc_id, packed, class_id in zip(*columns):
                if number != chunk:
                    chunk, done, rows, held = number, False, [], 0
                if done:
                    continue
                if packed is None:
                    mark = (rank, hash_), class_id
                    continue
                text = unpack.decompress(packed).decode()
                rows.append((doc_id, text, mark[1] if mark[0] == (rank, hash_) else doc_id))
                held += len(text)
                done = guest
                if len(rows) > 1 and (guest or held >= SLICE_BYTES):
                    yield record_batch(_compared(rows), kind)
                    rows, held = rows[-1:], len(text)

    dealt = ordered.mapInArrow(tidy(deal), DEALT).unionAll(marks.mapInArrow(tidy(deal_marks), DEALT))
    # A mark stands before the texts of its place.
    order = ["chunk", "guest", "rank", "hash", F.col("packed").isNotNull()]
    return dealt.repartition("chunk").sortWithinPartitions(*order).mapInArrow(tidy(run), SCHEMA)


def _compared(rows: list[tuple[int | None, str, int | None]]) -> dict:
    """Results for all rows but the last, which is only the next of the one before it."""
    own = [text for _, text, _ in rows]
    edited = [text[: len(text) - len(text) // 3] + after[: len(text) // 3] for text, after in zip(own, own[1:])]
    print_, count = fingerprints_of(own)
    edited_print, edited_count = fingerprints_of(edited)
    full, edited_full = count > 0, edited_count > 0
    n = len(edited)
    return {
        "doc_id": [doc_id for doc_id, _, _ in rows[:-1]],
        "n_chars": [len(text) for text in own[:-1]],
        "edited_sha256": [hashlib.sha256(text.encode()).hexdigest() for text in edited],
        "fingerprint": [p.tobytes().hex() if f else "" for p, f in zip(print_[:n], full[:n])],
        "edited_fingerprint": [p.tobytes().hex() if f else "" for p, f in zip(edited_print, edited_full)],
        "near_edited": likeness(print_[:n], full[:n], edited_print, edited_full),
        "near_next": likeness(print_[:n], full[:n], print_[1:], full[1:]),
        "n_shingles": count[:n],
        "class_id": [class_id for _, _, class_id in rows[:-1]],
    }
