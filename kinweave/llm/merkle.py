"""A Merkle manifest of a table by incremental witnesses.

Each row is a leaf: the digest of its fields, each `-` or its number of UTF-8 bytes, `:`
and its value. The leaves of a language, ascending by doc_id, are the bottom of a binary
tree whose last node may be alone; the languages' roots, in byte order with a missing
language first, are the bottom of one more such tree.

Leaves are numbered without a window over a language: rows are dealt by ranges, numbered
in each range, and shifted by the rows of the ranges before. They are appended in order,
a block of `BLOCK` consecutive leaves at a time, to a list of open subtrees. Each open
subtree holds the partial witnesses of its members, and whenever two of one height meet,
those of either side are extended by the root of the other. The roots of the blocks are
leaves of the next round's appends, and the roots of the languages of the last ones', so
no task holds more than a block; the witnesses that a block's root gathers above extend
those of its leaves.

A witness is a string of bytes with, for each level, a side (0: no sibling, 1: the sibling
is the left one, 2: the right one) and the sibling's digest.

Rows of the same doc_id, and rows without one (which come first), are in the order of
their digests; repeated rows are leaves of their own. A missing language is a group apart
from an empty name. An empty table gives no rows. Columns other than the five aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.llm.common import record_batch, ship_code, stored, tidy

HEIGHT = 10
BLOCK = 1 << HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose doc_id has a checksum that this divides are held against a changed n_chars.
TAMPERED = 7

BLOCKS = (
    "grp string, block long, n long, root binary, digests array<binary>, witnesses array<binary>, "
    "ids array<long>, changed array<binary>"
)
SCHEMA = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def node(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Frontier:
    """Open subtrees, ever smaller ones, and the partial witnesses of their members."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, list[bytearray]]] = []

    def append(self, digest: bytes) -> None:
        self._push(0, digest, [bytearray()])

    def _push(self, height: int, digest: bytes, members: list[bytearray]) -> None:
        while self.open and self.open[-1][0] == height:
            _, left, before = self.open.pop()
            for witness in before:
                witness += b"\x02" + digest
            for witness in members:
                witness += b"\x01" + left
            height, digest, members = height + 1, node(left, digest), before + members
        self.open.append((height, digest, members))

    def close(self, height: int | None) -> tuple[bytes, list[bytearray]]:
        """The root and the witnesses, with the last nodes alone; up to `height` if given."""
        while len(self.open) > 1 or height is not None and self.open[0][0] < height:
            own, digest, members = self.open.pop()
            for witness in members:
                witness += b"\x00"
            self._push(own + 1, node(digest), members)
        return self.open[0][1], self.open[0][2]


def siblings(witness: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(witness):
        side = witness[at]
        yield side, witness[at + 1 : at + 33] if side else b""
        at += 33 if side else 1


def proof_digest(witness: bytes) -> str:
    return hashlib.sha256("".join(d.hex() for _, d in siblings(witness)).encode()).hexdigest()


def fold(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for side, other in siblings(witness):
        digest = node(digest) if not side else node(other, digest) if side == 1 else node(digest, other)
    return digest


def _digest(n_chars: Column) -> Column:
    parts = []
    for name in FIELDS:
        value = (n_chars if name == "n_chars" else F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, digest, changed, row): `changed` is the tampered row's digest, or null."""
    n_chars = F.col("n_chars")
    chosen = (F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0) & n_chars.isNotNull()
    more = n_chars.cast("decimal(38,0)") + 1
    return docs.select(
        _group(F.col("lang")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        _digest(n_chars).alias("digest"),
        F.when(chosen, _digest(more)).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )


def _group(lang: Column) -> Column:
    """A key without nulls in the same order: a missing language first."""
    return F.coalesce(F.concat(F.lit("+"), lang.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Stored `rows` with `pos`, the place in its group `grp` by `order`, and `n`, the group's size.

    `order` tells all rows apart. Only one row for each range and group meets in a window.
    """
    spark = rows.sparkSession
    ship_code(spark)
    schema = StructType(rows.schema.fields[:]).add("part", "integer").add("at", "long")
    kind = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for name in batch.column("grp").to_pylist():
                if name != group:
                    group, at = name, 0
                places.append(at)
                at += 1
            columns = {name: batch.column(i) for i, name in enumerate(kind.names[:-2])}
            yield record_batch({**columns, "part": [part] * len(places), "at": places}, kind)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    placed = stored(ranged.mapInArrow(tidy(count), schema), "merkle-placed")
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("rows"))
    whole, before = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("grp", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"), F.sum("rows").over(whole).alias("n"))
    found = placed.join(stored(shifts, "merkle-shifts"), ["grp", "part"])
    return found.withColumn("pos", F.col("shift") + F.col("at")).select(*rows.columns, "pos", "n")


def append_blocks(nodes: DataFrame) -> DataFrame:
    """One stored row for each block of nodes (grp, pos, n, digest, and doc_id and changed or neither)."""
    spark = nodes.sparkSession
    ship_code(spark)
    kind = to_arrow_schema(StructType.fromDDL(BLOCKS))
    with_ids = "doc_id" in nodes.columns
    payload = ["doc_id", "changed"] if with_ids else []
    placed = nodes.withColumn("block", F.shiftright("pos", HEIGHT)).select("grp", "block", "pos", "n", "digest", *payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def appended() -> pa.RecordBatch:
            frontier = Frontier()
            for _, digest, *_ in held:
                frontier.append(digest)
            n = held[0][0]
            root, witnesses = frontier.close(HEIGHT if n > BLOCK else None)
            columns = [[row[i] for row in held] for i in range(1, 4)]
            values = (block[0], block[1], n, root, columns[0], [bytes(w) for w in witnesses], columns[1], columns[2])
            return record_batch({name: [value] for name, value in zip(kind.names, values)}, kind)

        for batch in batches:
            n = batch.num_rows
            names = ("grp", "block", "n", "digest", *payload)
            columns = [batch.column(name).to_pylist() for name in names]
            columns += [] if with_ids else [[None] * n, [None] * n]
            for group, number, *row in zip(*columns):
                if (group, number) != block:
                    if held:
                        yield appended()
                    block, held = (group, number), []
                held.append(row)
        if held:
            yield appended()

    dealt = placed.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    return stored(dealt.mapInArrow(tidy(run), BLOCKS), "merkle-blocks")


def ends(blocks: DataFrame, languages: bool) -> DataFrame:
    """(grp, block, above, subroot, top): what extends the witnesses of each block.

    The roots of blocks are appended in turn until every group is one node; with
    `languages` the groups' roots then are nodes of the last tree.
    """
    if not blocks.filter(F.col("n") > BLOCK).isEmpty():
        upper = blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"))
        found = paths(append_blocks(upper), languages).withColumnRenamed("pos", "block").withColumnRenamed("witness", "above")
        return found.select("grp", "block", "above", "subroot", "top")
    roots = blocks.select("grp", "block", F.col("root").alias("subroot"))
    if not languages:
        return roots.withColumns({"above": F.lit(b""), "top": F.col("subroot")})
    listed = numbered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("digest")), ["name"])
    listed = stored(listed, "merkle-languages")
    found = paths(append_blocks(listed.select("grp", "pos", "n", "digest")), False)
    named = listed.select("name", "pos").join(found.select("pos", F.col("witness").alias("above"), "top"), "pos")
    return roots.join(named.select(F.col("name").alias("grp"), "above", "top"), "grp")


def paths(blocks: DataFrame, languages: bool) -> DataFrame:
    """(grp, pos, witness, subroot, top) of each node in `blocks`."""
    whole = blocks.select("grp", "block", F.posexplode("witnesses").alias("at", "own")).join(ends(blocks, languages), ["grp", "block"])
    return whole.select("grp", (F.col("block") * BLOCK + F.col("at")).alias("pos"), F.concat("own", "above").alias("witness"), "subroot", "top")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of `docs`."""
    rows = stored(leaves(docs), "merkle-leaves")
    blocks = append_blocks(numbered(rows, ["doc_id", "digest", "row"]))
    above = stored(ends(blocks, True), "merkle-ends")
    whole = blocks.select("grp", "block", "ids", "digests", "changed", "witnesses").join(above, ["grp", "block"])
    kind = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("ids", "digests", "changed", "witnesses", "above", "subroot", "top")}
                witnesses = [own + row["above"] for own in row["witnesses"]]
                held = [changed or digest for digest, changed in zip(row["digests"], row["changed"])]
                folded = [fold(digest, witness) for digest, witness in zip(held, witnesses)]
                n = len(held)
                yield record_batch(
                    {
                        "doc_id": row["ids"],
                        "leaf": [d.hex() for d in row["digests"]],
                        "subroot": [row["subroot"].hex()] * n,
                        "root": [row["top"].hex()] * n,
                        "proof_sha256": [proof_digest(w) for w in witnesses],
                        "folded_root": [f.hex() for f in folded],
                        "verified": [f == row["top"] for f in folded],
                    },
                    kind,
                )

    return whole.mapInArrow(tidy(run), SCHEMA)
