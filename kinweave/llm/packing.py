"""Mixture-controlled packing: deficit round-robin over source queues into windows.

Each source (or each of `OVERFLOW` shared queues for the sources that are neither named in
`targets` nor among the `MAX_QUEUES` largest) is a queue of tokens. Every token that is
packed pays each queue its target share into its deficit. The queue with the largest
deficit is served a run: the rest of its first document, or `RUN` tokens of a rest of
2 * `RUN` or more. The run is taken from its deficit, which may fall below zero, and what
is owed or ahead goes on to the next windows. So at every place a queue is ahead of its
share by less than 2 * `RUN` tokens, and behind by less than that times
1 + 1/2 + ... + 1/queues, the most that a queue waits when the largest deficit is served.

The deficits cross partitions without a serial pass. Windows are grouped into shards of
`SHARD_WINDOWS` windows. How much of a queue lies before a shard is a closed formula,
floor(share * tokens so far), whose fraction is the deficit that the shard begins with;
so every shard knows its slice of every queue from one number per queue. A document's
place in its queue is a sum of per-source and per-task totals and its place in the task.
Documents are cut at shard borders, shuffled once to their shards and packed there, a
shard at a time; windows are cut from the runs as they come, so all are full.

When a queue of a given mixture runs dry, the others go on in their proportions, in
phases. Without given targets the mixture is that of the corpus, which can be kept to the
end. A shard's last tokens, less than a window, are cut into powers of two, so nothing is
padded.

Tokens are the ids of a public byte-level vocabulary, with id 0 behind each document. The
ids are those that `tokenizers` gives for byte_bpe_50k.json by default: the string of its
added token is that token, all else is ordinary text. A null or empty text is one id 0. A
null source is a queue. Repeated rows are packed again. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.llm.common import bounded, record_batch, ship_code, stored, tidy

WINDOW, SHARD_WINDOWS, RUN = 1024, 1024, 512
MAX_QUEUES, OVERFLOW = 1000, 64
#: The vocabulary of byte_bpe_50k.json as ranks; ids are equal, reading is faster.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The added token of byte_bpe_50k.json, which the rank file doesn't hold.
END_OF_TEXT, END_ID = "<|endoftext|>", 50256
#: The pattern's backtracking stack overflows on runs of white space of about a million. Runs
#: of this length are cut out; the class is that of the pattern (Unicode white space).
LONG_BLANK = 100_000
_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_BLANK)

TOKENS = "doc_id long, source string, task int, before long, n_tokens long, ids binary"
SHARDED = "shard long, queue int, place long, doc_id long, start long, doc_tokens long, ids binary"
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, queue int"
)


@lru_cache(maxsize=2)
def encoding(name: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(name), "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ordinary(text: str, name: str = VOCABULARY) -> list[int]:
    """The ids of a text whose special strings are ordinary text.

    A long run of white space is one piece of the pattern, but for its last character where
    a word follows; it begins a piece, so the rest is read by itself.
    """
    coder = encoding(name)
    if len(text) < LONG_BLANK:
        return coder.encode_ordinary(text)
    ids, at = [], 0
    for run in _BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += coder.encode_ordinary(text[at : run.start()])
        ids += coder._encode_single_piece(text[run.start() : end])
        at = end
    return ids + coder.encode_ordinary(text[at:])


def encode(text: str | None, name: str = VOCABULARY) -> np.ndarray:
    """The ids of an ordinary text and the closing 0, as unsigned 16-bit numbers."""
    return np.array([*ordinary(text or "", name), 0], np.uint16)


def document_ids(text: str | None, name: str = VOCABULARY) -> np.ndarray:
    """The ids of a document and the closing 0; its strings of the added token are one id each.

    What stands between them is read by itself, as `tokenizers` does.
    """
    first, *others = (text or "").split(END_OF_TEXT)
    if not others:
        return encode(first, name)
    ids = ordinary(first, name)
    for other in others:
        ids.append(END_ID)
        ids += ordinary(other, name)
    return np.array([*ids, 0], np.uint16)


def tokenise(docs: DataFrame) -> DataFrame:
    """Each row's ids, with its place among the rows of its source in its task."""
    ship_code(docs.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[str | None, int] = {}
        for batch in batches:
            for part in bounded(batch, "text"):
                source = part.column("source").to_pylist()
                ids = [document_ids(text.as_py()) for text in part.column("text")]
                before = []
                for name, value in zip(source, ids):
                    before.append(so_far.get(name, 0))
                    so_far[name] = before[-1] + len(value)
                yield record_batch(
                    {
                        "doc_id": part.column("doc_id"), "source": source, "task": [TaskContext.get().partitionId()] * part.num_rows,
                        "before": before, "n_tokens": [len(v) for v in ids], "ids": [v.tobytes() for v in ids],
                    },
                    kind,
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return plain.mapInArrow(tidy(run), TOKENS)


class Schedule:
    """How many tokens of each queue lie before each shard."""

    def __init__(self, sizes: list[int], weights: list[float], shard_tokens: int | None = None):
        self.sizes, self.shard_tokens = [int(n) for n in sizes], shard_tokens or WINDOW * SHARD_WINDOWS
        live = [q for q, n in enumerate(self.sizes) if n]
        # Queues without weight follow when the others are empty.
        #: Phases as (tokens packed before, shares); given counts at their borders.
        self.borders, self.given, self.shares = [0.0], [np.zeros(len(self.sizes))], []
        while live:
            heavy = [q for q in live if weights[q] > 0] or live
            share = np.zeros(len(self.sizes))
            mass = [weights[q] if weights[q] > 0 else float(self.sizes[q]) for q in heavy]
            share[heavy] = np.array(mass) / sum(mass)
            left = np.array(self.sizes) - self.given[-1]
            length = min(left[q] / share[q] for q in heavy)
            ended = [q for q in heavy if left[q] / share[q] <= length * (1 + 1e-12)]
            given = self.given[-1] + share * length
            for q in ended:
                given[q] = self.sizes[q]
            live = [q for q in live if q not in ended]
            self.shares.append(share)
            self.borders.append(self.borders[-1] + length)
            self.given.append(given)
        total = sum(self.sizes)
        self.n_shards = max(1, -(-total // self.shard_tokens))

    def due(self, done: float) -> np.ndarray:
        """Tokens that each queue is to have among the first `done`."""
        phase = min(bisect_right(self.borders, done) - 1, len(self.shares) - 1)
        if phase < 0:
            return np.zeros(len(self.sizes))
        return self.given[phase] + self.shares[phase] * (done - self.borders[phase])

    def before(self, shard: int) -> np.ndarray:
        """Tokens of each queue before a shard."""
        if shard >= self.n_shards:
            return np.array(self.sizes, np.int64)
        given = self.due(float(shard) * self.shard_tokens)
        return np.minimum(np.floor(given + 1e-6).astype(np.int64), self.sizes)

    def shard_of(self, queue: int, place: int) -> int:
        """The shard that holds a token, from the inverse of the shares, then exactly."""
        at = [g[queue] for g in self.given]
        phase = min(max(bisect_right(at, place) - 1, 0), len(self.shares) - 1)
        share = self.shares[phase][queue]
        done = self.borders[phase] + ((place - at[phase]) / share if share else 0)
        shard = min(max(int(done // self.shard_tokens), 0), self.n_shards - 1)
        while shard and self.before(shard)[queue] > place:
            shard -= 1
        while shard + 1 < self.n_shards and self.before(shard + 1)[queue] <= place:
            shard += 1
        return shard


def pack_shard(pieces: list[list[tuple]], due: Callable[[int], np.ndarray], first_window: int) -> Iterator[tuple]:
    """Deficit round-robin over the queues of a shard.

    Takes per queue (doc_id, start, doc_tokens, ids) in order and gives result rows. `due`
    tells how many tokens each queue is to have among the shard's first n; the deficit is
    what it hasn't yet had of them.
    """
    served, deficit, done = np.zeros(len(pieces)), np.zeros(len(pieces)), 0
    at = [[0, 0] for _ in pieces]
    rest = sum(len(piece[3]) for queue in pieces for piece in queue)
    sequence, offset, room = first_window, 0, _room(rest)
    while rest:
        queue = int(np.argmax(deficit))
        index, used = at[queue]
        doc_id, start, doc_tokens, ids = pieces[queue][index]
        run = len(ids) - used
        run = RUN if run >= 2 * RUN else run
        rest, done = rest - run, done + run
        at[queue] = [index, used + run] if used + run < len(ids) else [index + 1, 0]
        # A queue that has given all of its slice waits for ever.
        served[queue] = served[queue] + run if at[queue][0] < len(pieces[queue]) else np.inf
        deficit = due(done) - served
        while run:
            got = min(run, room - offset)
            data = ids[used : used + got].astype("<u4").tobytes()
            yield doc_id, start + used, got, zlib.crc32(data), doc_tokens, sequence, offset, queue
            run, used, offset = run - got, used + got, offset + got
            if offset == room:
                sequence, offset, room = sequence + 1, 0, _room(rest + run)


def _room(rest: int) -> int:
    """A window, or at the end of a shard the largest power of two that it still fills."""
    return WINDOW if rest >= WINDOW else 1 << max(0, rest.bit_length() - 1)


def _queues(totals: DataFrame, targets: dict[str, float] | None) -> tuple[dict[str | None, int], list[float]]:
    """Queue numbers and weights of the sources in `targets` and of the largest others."""
    by_source = totals.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    order = [F.desc("tokens"), "source"]
    own = by_source.orderBy(*order).limit(MAX_QUEUES).collect()
    if targets:
        known = {row["source"] for row in own}
        own += [row for row in by_source.filter(F.col("source").isin(list(targets))).orderBy(*order).collect() if row["source"] not in known]
    number = {row["source"]: place for place, row in enumerate(own)}
    return number, [float(row["tokens"]) if targets is None else float(targets.get(row["source"], 0.0)) for row in own]


def _placed(totals: DataFrame, number: dict[str | None, int]) -> DataFrame:
    """Adds each source's `queue` and `ahead`, the tokens of the queue before those of the task.

    Sources follow each other in a queue; a window holds the tasks of one source or the
    sources of one queue, a row each.
    """
    spark = totals.sparkSession
    listed = spark.createDataFrame([(k, v) for k, v in number.items()], "name string, queue int")
    shared = (F.pmod(F.xxhash64("source"), F.lit(OVERFLOW)) + len(number)).cast("int")
    # At most MAX_QUEUES rows and the names in `targets`.
    queued = totals.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("name")), "left").withColumn("queue", F.coalesce("queue", shared))
    sources = queued.groupBy(F.col("queue").alias("of_queue"), F.col("source").alias("name")).agg(F.sum("tokens").alias("tokens"))
    before = "sum(tokens) OVER (PARTITION BY {} ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens"
    sources = sources.select("of_queue", "name", F.expr(before.format("of_queue", "name")).alias("sources_ahead"))
    tasks = queued.select("source", "task", "queue", "tokens", F.expr(before.format("queue, source", "task")).alias("tasks_ahead"))
    both = tasks.join(sources, (F.col("queue") == F.col("of_queue")) & F.col("source").eqNullSafe(F.col("name")))
    return both.select("source", "task", "queue", (F.col("sources_ahead") + F.col("tasks_ahead")).alias("ahead"), "tokens")


def pack(docs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece of a document in a sequence; `targets` are shares by source."""
    tokens = stored(tokenise(docs), "packing-tokens")
    totals = stored(tokens.groupBy("source", "task").agg(F.sum("n_tokens").alias("tokens")), "packing-totals")
    number, weights = _queues(totals, targets)
    own = len(number)
    offsets = stored(_placed(totals, number), "packing-offsets")
    sizes = [0] * (own + OVERFLOW)
    for row in offsets.groupBy("queue").agg(F.sum("tokens").alias("n")).collect():
        sizes[row["queue"]] = row["n"]
    weights += [float(n) if targets is None else 0.0 for n in sizes[own:]]
    schedule = Schedule(sizes, weights)
    left = offsets.select(F.col("source").alias("of"), F.col("task").alias("in_task"), "queue", "ahead")
    placed = tokens.join(left, F.col("source").eqNullSafe(F.col("of")) & (F.col("task") == F.col("in_task")))
    placed = placed.select("doc_id", "queue", (F.col("ahead") + F.col("before")).alias("place"), "ids")
    sharded_kind, kind = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (SHARDED, SCHEMA))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in bounded(batch, "ids")):
            rows: dict[str, list] = {name: [] for name in sharded_kind.names}
            for doc_id, queue, place, ids in zip(*(part.column(c).to_pylist() for c in ("doc_id", "queue", "place", "ids"))):
                n, used = len(ids) // 2, 0
                while used < n:
                    shard = schedule.shard_of(queue, place + used)
                    stop = min(n, int(schedule.before(shard + 1)[queue]) - place)
                    values = (shard, queue, place + used, doc_id, used, n, ids[2 * used : 2 * stop])
                    for name, value in zip(sharded_kind.names, values):
                        rows[name].append(value)
                    used = stop
            yield record_batch(rows, sharded_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queues = None, {}

        def packed() -> pa.RecordBatch:
            numbers = sorted(queues)
            begun = schedule.before(shard)
            # Sequence ids leave room for what floors add to a shard and its closing powers of two.
            ahead = int(begun.sum())
            found = list(pack_shard([queues[q] for q in numbers], lambda n: (schedule.due(ahead + n) - begun)[numbers], shard * (2 * SHARD_WINDOWS + 64)))
            columns = {name: [row[i] for row in found] for i, name in enumerate(kind.names)}
            columns["queue"] = [numbers[q] for q in columns["queue"]]
            return record_batch(columns, kind)

        for part in (part for batch in batches for part in bounded(batch, "ids")):
            for number, queue, doc_id, start, doc_tokens, ids in zip(
                *(part.column(c).to_pylist() for c in ("shard", "queue", "doc_id", "start", "doc_tokens", "ids"))
            ):
                if number != shard:
                    if queues:
                        yield packed()
                    shard, queues = number, {}
                queues.setdefault(queue, []).append((doc_id, start, doc_tokens, np.frombuffer(ids, np.uint16)))
        if queues:
            yield packed()

    dealt = placed.mapInArrow(tidy(deal), SHARDED)
    return dealt.repartition("shard").sortWithinPartitions("shard", "queue", "place").mapInArrow(tidy(run), SCHEMA)
