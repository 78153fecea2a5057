"""N-gram Jaccard join by PartEnum signatures, as groups of linked documents.

Documents are sets of word shingles. Sizes fall into bands so that similar sets lie in one
band or in neighbours; each set is signed for its band's joint and the next one. In a
joint whose sets have at most r items, similar sets differ in at most k = 2r(1-s)/(1+s)
items. The domain of items is split by a hash into n = k/2 + 1 + t partitions: at least
1 + t of them hold at most one of the differing items. Each partition is split again in
three, and the subsets of two of the three parts are enumerated: one of them holds no
differing item, so similar sets share at least 1 + t signatures, for certain.

A signature of an empty subset would gather unlike documents. It is left out, which is
safe as long as a set has at most t of them; t follows the number to be expected, and a
set with more sends them too. Sets for which k is 0 are one signature.

All signatures go to their buckets (similarity.link_sets), sets that met there are checked
by exact counts, and links make the groups. Equal sets are one node. Null and empty texts, or
texts without words, have no shingles and no links. A group's id is its smallest doc_id;
rows without an id count only through their text. Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructType

from kinweave.llm.common import meet, record_batch, ship_code, stored, tidy
from kinweave.llm.similarity import Signatures, filter_bits, link_sets, may_hold, set_table, sets
from kinweave.llm.words import mix, slices

#: Of the query's contract; stages of a pipeline take five words and 80.
SHINGLE_WORDS, PERCENT = 3, 90
_PARTS = 3


def band_edges(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """The largest size of each band; a set's partners lie in its band or a neighbour."""
    if percent >= 100:
        return np.array([largest, largest + 1], np.int64)  # only equal sets, which are one node anyway
    edges, low = [], 1
    while low <= largest:
        edges.append(low * 100 // percent)
        low = edges[-1] + 1
    return np.array(edges, np.int64)


def partitions(edge: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, n, t) for joints of sets with at most `edge` items."""
    k = 2 * edge * (100 - percent) // (100 + percent)
    n = k // 2 + 1
    # A partition of the smallest sets of the lower band, two of three parts of it.
    items = 2 / _PARTS * edge * (percent / 100) ** 2 / n
    expected = _PARTS * n * np.exp(-items)
    t = np.where((k == 0) | (expected < 0.01), 0, np.ceil(1.5 * expected + 1)).astype(np.int64)
    return k, n + t, t


def part_enum(percent: int) -> Signatures:
    """Signatures of sets: (text, item) in order and sizes to (text, signature)."""
    edges = band_edges(percent)
    k, n, t = partitions(edges, percent)

    def sign(text: np.ndarray, item: np.ndarray, size: np.ndarray, round_: int = 0) -> tuple[np.ndarray, np.ndarray]:
        texts, signatures = [], []
        for ahead in (0, 1):
            joint = np.searchsorted(edges, np.maximum(size, 1)) + ahead
            cells = np.where(size > 0, _PARTS * n[joint], 0)
            base = np.cumsum(cells) - cells
            salt = mix(joint.astype(np.uint64) + np.uint64(1 + 4096 * round_))
            value = mix(item ^ salt[text])
            which = (value >> np.uint64(32)) * n[joint].astype(np.uint64)[text] >> np.uint64(32)
            within = (value & np.uint64(0xFFFFFFFF)) * np.uint64(_PARTS) >> np.uint64(32)
            cell = np.zeros(int(cells.sum()), np.uint64)
            np.add.at(cell, base[text] + (_PARTS * which + within).astype(np.int64), mix(item + np.uint64(1)))
            cell = cell.reshape(-1, _PARTS)
            row_text = np.repeat(np.arange(len(size)), cells // _PARTS)
            place = (np.arange(len(cell)) - np.repeat(base // _PARTS, cells // _PARTS)).astype(np.uint64)
            whole = k[joint][row_text] == 0
            name = salt[row_text] + mix(place * np.uint64(_PARTS) + np.uint64(7))
            empty = np.zeros((len(cell), _PARTS), bool)
            signed = np.zeros((len(cell), _PARTS), np.uint64)
            for left_out in range(_PARTS):
                one, two = cell[:, (left_out + 1) % _PARTS], cell[:, (left_out + 2) % _PARTS]
                signed[:, left_out] = mix(mix(mix(one + name) + two) + np.uint64(left_out))
                empty[:, left_out] = (one == 0) & (two == 0)
            signed[whole, 0] = mix(cell[whole].sum(axis=1, dtype=np.uint64) + name[whole])
            keep = ~empty
            many = np.bincount(row_text, weights=empty.sum(axis=1), minlength=len(size)) > t[joint]
            keep |= many[row_text][:, None]
            keep[whole] = [True, False, False]
            texts.append(np.repeat(row_text, _PARTS)[keep.ravel()])
            signatures.append(signed.ravel()[keep.ravel()])
        return np.concatenate(texts), np.concatenate(signatures)

    return sign


def groups(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The table of sets (doc_id, n_shingles, key), stored, and (key, root) of linked sets."""
    table = stored(set_table(docs, size), "sets")
    return table, link_sets(docs, table, size, percent, part_enum(percent)).withColumnRenamed("node", "key")


def jaccard_join(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`."""
    table, found = groups(docs, size, percent)
    rooted = meet(table, found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return meet(rooted, least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each_group(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """`docs` with one document of each group: the smallest doc_id, then the least text.

    Rows without an id stay only where their group has no row with one. Rows that are in
    no group, or have no shingles, stay as they are and aren't shuffled: a filter of
    fixed size tells most of them apart, and the rest of the rows meet their group's
    keeper. All columns stay; `jj_key` and `jj_maybe` must not be among them.
    """
    table, found = groups(docs, size, percent)
    rooted = meet(table.filter("key is not null"), found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    kept = rooted.groupBy("root").agg(F.min(place).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    grouped = meet(rooted.select("key", "root").distinct(), kept, "root").select("key", "root", "kept")
    grouped = stored(grouped, "groups")
    filled = docs.sparkSession.sparkContext.broadcast(filter_bits(F.col("key"), grouped))
    keyed = _with_keys(docs, size, filled)
    alone = keyed.filter("not jj_maybe").select(*docs.columns)
    met = keyed.filter("jj_maybe").select(F.struct(*docs.columns).alias("row"), F.col("jj_key").alias("key"))
    met = meet(met, grouped, "key", "left")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept.doc_id")) & (F.col("key") == F.col("kept.key"))
    free = met.filter("root is null").select("row.*")
    first = met.filter("root is not null").filter(same).groupBy("root").agg(F.min_by("row", F.struct(F.col("row.text"))).alias("row"))
    return alone.unionByName(free).unionByName(first.select("row.*"))


def _with_keys(docs: DataFrame, size: int, filled) -> DataFrame:
    ship_code(docs.sparkSession)
    schema = StructType(docs.schema.fields[:]).add("jj_key", LongType()).add("jj_maybe", BooleanType())
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in slices(batch):
                _, _, count, key = sets(part, size)
                columns = {name: rows.column(i) for i, name in enumerate(kind.names[:-2])}
                yield record_batch({**columns, "jj_key": key, "jj_maybe": (count > 0) & may_hold(filled.value, key)}, kind)

    return docs.mapInArrow(tidy(run), schema)
