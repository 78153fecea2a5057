"""Phrase collocations: frequent word sequences that stay together, by language.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words
at blanks and tabs. A language's phrases of `LONGEST` words at most are counted wherever
they stand within a piece.

The first pass finds what may be frequent. Tasks send the hashes of their n-grams with
counts to hash partitions, each partition's as one packed row, its mass ahead of it. A
partition merges them into one Misra-Gries summary whose capacity is its mass divided by
the threshold: merged counters beyond the capacity are lowered by the first one that has
no place, which takes that much from each, so the sum of what was taken stays below the
threshold and every frequent n-gram survives. Summaries are as large as the mass over the
threshold, however many different n-grams there are.

The second pass counts the survivors exactly, by their words. A filter of fixed size
(`FILTER_BITS`) tells tasks which n-grams these are; one let through by chance is counted
like the others and falls below the threshold, if it is below.

Counts travel by hash partition too, a packed row for each.

Scores, the weakest cuts, longer phrases that hold shorter ones and the best of each
language are joins and aggregates of the counted phrases.

A null text is empty, a null language is `und`. Repeated rows count again. A table without
frequent phrases gives no rows. Columns other than text and lang aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.llm.common import record_batch, ship_code, stored, tidy
from kinweave.llm.words import LOWER, Texts, byte_class, mix, slices

LONGEST, THRESHOLD = 4, 30
#: A phrase goes if a longer one has this share, in percent, of its occurrences.
CONTAINED, SCALE, TOP = 80, 2_000_000, 2000
UNKNOWN = "und"

_ENDS_PIECE = byte_class([(ord(c), ord(c)) for c in ".,;:!?"] + [(0x0A, 0x0D)])
_INSIDE = ~(_ENDS_PIECE | byte_class([(0x20, 0x20), (0x09, 0x09)]))
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: N-grams that a task of the first pass holds before it sends them.
HELD = 2 << 20
#: Bits of a hash within its partition.
_LOW = 32
#: Bits of the filter (16 MB) and how many of them each n-gram sets.
FILTER_BITS, FILTER_HASHES = 27, 4
_SALTS = np.arange(1, FILTER_HASHES // 2 + 1, dtype=np.uint64) * _BASE
#: Bytes of text that are read at once.
SLICE = 1 << 20
#: Phrases that a task of the second pass counts before it sends them.
COUNTED = 400_000

DEALT = "part long, kind int, mass long, entries binary"
PACKED = "part long, lang string, n int, entries binary"
COUNTS = "lang string, phrase string, words int, f long"


class Grams:
    """The n-grams of some texts: hash, first word and number of words of each occurrence."""

    def __init__(self, part: Texts, langs: list[str], longest: int = LONGEST):
        data = LOWER[part.data]
        self.data = data
        self.text, self.start, self.end = part.spans(_INSIDE[data])
        word = Texts(part.offsets, data).hashes(self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        piece = np.cumsum(_ENDS_PIECE[data])[self.start] if len(self.start) else np.zeros(0, np.int64)
        seeds = np.array([xxhash.xxh64_intdigest(name) for name in langs], np.uint64)
        value, at = mix(seeds[self.text] + word), np.arange(len(word))
        values, firsts = [value], [at]
        for length in range(2, longest + 1):
            last = at + length - 1
            at = at[last < len(word)]
            last = at + length - 1
            inside = (self.text[at] == self.text[last]) & (piece[at] == piece[last])
            value = value[: len(at)][inside]
            at, last = at[inside], last[inside]
            value = mix(value * _BASE + word[last])
            values.append(value)
            firsts.append(at)
        self.value, self.first = np.concatenate(values), np.concatenate(firsts)
        self.length = np.repeat(np.arange(1, len(values) + 1), [len(v) for v in values])

    def phrase(self, i: int) -> str:
        words = range(int(self.first[i]), int(self.first[i] + self.length[i]))
        return b" ".join([self.data[self.start[w] : self.end[w]].tobytes() for w in words]).decode()


def _langs(rows: pa.RecordBatch) -> list[str]:
    return [UNKNOWN if name is None else name for name in rows.column("lang").to_pylist()]


def summed(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order with the sums of their counts."""
    order = np.argsort(value, kind="stable")
    value, count = value[order], count[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return value[start], np.add.reduceat(count, start) if len(start) else np.zeros(0, np.int64)


def placed(value: np.ndarray, n_parts: int) -> np.ndarray:
    """The number of the partition above the low bits: one number that names an n-gram."""
    part = ((value >> np.uint64(_LOW)) * np.uint64(n_parts)) >> np.uint64(64 - _LOW)
    return (part << np.uint64(_LOW)) | (value & np.uint64((1 << _LOW) - 1))


def _planes(values: np.ndarray) -> bytes:
    """Bytes of the same weight together, which compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def pack_entries(low: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending numbers as differences, and counts; counts beyond 32 bits don't occur in a task's part."""
    return zstandard.compress(_planes(np.diff(low, prepend=0)) + _planes(count), 1)


def unpack_entries(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(packed), np.uint8)
    planes = [half.reshape(4, -1).T.copy().view("<u4")[:, 0] for half in both.reshape(2, -1)]
    return np.cumsum(planes[0].astype(np.uint64), dtype=np.uint64), planes[1].astype(np.int64)


class Summary:
    """A Misra-Gries summary that others are merged into.

    Of a total mass m every value keeps at least its count less m / (capacity + 1); what was
    taken from each at most is `taken`.
    """

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.value, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, value: np.ndarray, count: np.ndarray) -> None:
        self._held.append((value, count))
        self._n += len(value)
        if self._n > max(1 << 18, self.capacity):
            self.merge()

    def merge(self) -> None:
        both = [(self.value, self.count), *self._held]
        self.value, self.count = summed(*map(np.concatenate, zip(*both)))
        self._held, self._n = [], 0
        if len(self.count) > self.capacity:
            at = len(self.count) - self.capacity - 1
            least = int(np.partition(self.count, at)[at])
            self.taken += least
            keep = self.count > least
            self.value, self.count = self.value[keep], self.count[keep] - least


def survivors(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """(name): every n-gram of `docs` (text, lang) with `threshold` occurrences or more, and a few others."""
    spark = docs.sparkSession
    n_parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt_kind, kind = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (DEALT, "name long"))

    def deal(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        name, count = summed(*map(np.concatenate, zip(*held)))
        part = (name >> np.uint64(_LOW)).astype(np.int64)
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        ends, low = np.append(cut[1:], len(part)), name & np.uint64((1 << _LOW) - 1)
        mass = np.add.reduceat(count, cut) if len(cut) else np.zeros(0, np.int64)
        packed = [pack_entries(low[a:b].astype(np.int64), count[a:b]) for a, b in zip(cut, ends)]
        n = len(cut)
        return record_batch(
            {"part": np.tile(part[cut], 2), "kind": [0] * n + [1] * n, "mass": np.tile(mass, 2), "entries": [None] * n + packed}, dealt_kind
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            for rows, part in slices(batch, limit=SLICE):
                name = placed(Grams(part, _langs(rows), longest).value, n_parts)
                held.append(summed(name, np.ones(len(name), np.int64)))
                n += len(held[-1][0])
                if n >= HELD:
                    yield deal(held)
                    held, n = [], 0
        if held:
            yield deal(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None

        def kept() -> pa.RecordBatch:
            summary.merge()
            return record_batch({"name": summary.value[summary.count + summary.taken >= threshold].view(np.int64)}, kind)

        for batch in batches:
            for i, (number, header, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "mass")))):
                if number != part:
                    if summary is not None:
                        yield kept()
                    part, mass, summary = number, 0, None
                if header == 0:
                    mass += own
                    continue
                if summary is None:
                    summary = Summary(mass // threshold + 1)
                low, count = unpack_entries(batch.column("entries")[i].as_py())
                summary.add((np.uint64(number) << np.uint64(_LOW)) | low, count)
        if summary is not None:
            yield kept()

    dealt = docs.mapInArrow(tidy(run), DEALT).repartition("part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(tidy(merge), "name long")


def filter_places(name: np.ndarray) -> list[np.ndarray]:
    """The bits of the filter that an n-gram sets."""
    mask, places = np.uint64((1 << FILTER_BITS) - 1), []
    for salt in _SALTS:
        hashed = mix(name + salt)
        places += [hashed & mask, (hashed >> np.uint64(FILTER_BITS)) & mask]
    return places


def filter_of(names: DataFrame) -> np.ndarray:
    """The filter's bytes: 4,096 rows of 4 KB at most come to the driver, a few at a time, whatever the size of `names`."""
    kind = to_arrow_schema(StructType.fromDDL("place long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = filter_places(batch.column("name").to_numpy().view(np.uint64))
            yield record_batch({"place": np.concatenate(places).view(np.int64)}, kind)

    maps = names.mapInArrow(tidy(run), "place long").groupBy(F.shiftright("place", 15).alias("bucket"))
    maps = maps.agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))
    filled = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for bucket, bits in maps.toLocalIterator():
        filled[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return filled


def may_hold(filled: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Places in `name` whose bits are all set."""
    at = np.arange(len(name))
    for place in range(FILTER_HASHES):
        bit = filter_places(name[at])[place]
        at = at[(filled[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


class Counter:
    """Exact counts of phrases, as many as fit, then sent on."""

    def __init__(self) -> None:
        self.value, self.count, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.phrases: list[str] = []
        self.langs: list[str] = []

    def add(self, grams: Grams, hit: np.ndarray, langs: list[str]) -> None:
        value, first, count = np.unique(grams.value[hit], return_index=True, return_counts=True)
        at = np.searchsorted(self.value, value)
        known = np.zeros(len(value), bool)
        inside = at < len(self.value)
        known[inside] = self.value[at[inside]] == value[inside]
        self.count[at[known]] += count[known]
        new = np.flatnonzero(~known)
        place = np.arange(len(self.phrases), len(self.phrases) + len(new))
        for i in hit[first[new]].tolist():
            self.phrases.append(grams.phrase(i))
            self.langs.append(langs[grams.text[grams.first[i]]])
        self.value = np.insert(self.value, at[new], value[new])
        self.count = np.insert(self.count, at[new], count[new])
        self.place = np.insert(self.place, at[new], place)

    def packed(self, n_parts: int) -> dict:
        """A row for each hash partition and language: its phrases, in order, with their counts."""
        part = (placed(self.value, n_parts) >> np.uint64(_LOW)).tolist()
        count, groups = self.count.tolist(), {}
        for k, place in enumerate(self.place.tolist()):
            groups.setdefault((part[k], self.langs[place]), []).append((self.phrases[place], count[k]))
        return _rows([(*key, sorted(found)) for key, found in groups.items()])


def _rows(found: list[tuple[int, str, list[tuple[str, int]]]]) -> dict:
    packed = [zstandard.compress(_planes(np.array([n for _, n in some])) + "\n".join(p for p, _ in some).encode(), 3) for _, _, some in found]
    return {"part": [f[0] for f in found], "lang": [f[1] for f in found], "n": [len(f[2]) for f in found], "entries": packed}


def counted(docs: DataFrame, filled: np.ndarray, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, f): n-grams in the filter with `threshold` occurrences or more; words 0: all words.

    Tasks send their counts to the hash partitions, a packed row for each; words have no
    line ends, which stand between the phrases.
    """
    spark = docs.sparkSession
    n_parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(filled)
    packed_kind, kind = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (PACKED, COUNTS))

    def totals_of(totals: dict[str, int]) -> dict:
        return _rows([(xxhash.xxh64_intdigest(name) % n_parts, name, [("", n)]) for name, n in totals.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, totals = Counter(), {}
        for batch in batches:
            for rows, part in slices(batch, limit=SLICE):
                langs = _langs(rows)
                grams = Grams(part, langs, longest)
                for name, n in zip(langs, part.per_text(grams.text).tolist()):
                    totals[name] = totals.get(name, 0) + n
                counter.add(grams, may_hold(sent.value, placed(grams.value, n_parts)), langs)
                if len(counter.value) >= COUNTED:
                    yield record_batch(counter.packed(n_parts), packed_kind)
                    counter = Counter()
            if len(totals) > COUNTED:
                yield record_batch(totals_of(totals), packed_kind)
                totals = {}
        yield record_batch(counter.packed(n_parts), packed_kind)
        yield record_batch(totals_of(totals), packed_kind)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, counts = None, {}

        def kept() -> pa.RecordBatch:
            found = [(phrase, n) for phrase, n in counts.items() if not phrase or n >= threshold]
            phrases = [phrase for phrase, _ in found]
            words = [phrase.count(" ") + 1 if phrase else 0 for phrase in phrases]
            return record_batch({"lang": [place[1]] * len(found), "phrase": phrases, "words": words, "f": [n for _, n in found]}, kind)

        for batch in batches:
            for i, (part, lang, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "n")))):
                if (part, lang) != place:
                    if counts:
                        yield kept()
                    place, counts = (part, lang), {}
                data = zstandard.decompress(batch.column("entries")[i].as_py())
                own = np.frombuffer(data, np.uint8, 4 * n).reshape(4, -1).T.copy().view("<u4")[:, 0].tolist()
                for phrase, more in zip(data[4 * n :].decode().split("\n"), own):
                    counts[phrase] = counts.get(phrase, 0) + more
        if counts:
            yield kept()

    dealt = docs.mapInArrow(tidy(run), PACKED).repartition("part").sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(tidy(add_up), COUNTS)


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, f), stored: all phrases of `longest` words at most with `threshold`
    occurrences or more; the row of words 0 and an empty phrase has the language's words."""
    ship_code(docs.sparkSession)
    read = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    names = stored(survivors(read, threshold, longest), "phrases-survivors")
    return stored(counted(read, filter_of(names), threshold, longest), "phrases-counts")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each candidate, by its weakest cut, the shortest first part among equals."""
    words = F.split("phrase", " ")
    cuts = counts.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"),
    )
    firsts = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    whole = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"])
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return whole.groupBy("lang", "phrase", "a").agg(cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def alone(counts: DataFrame) -> DataFrame:
    """(lang, phrase) of candidates that no longer candidate holds as often, by `CONTAINED`."""
    size = F.explode(F.sequence(F.lit(2), F.col("words") - 1))
    longer = counts.filter("words > 2").select("lang", F.split("phrase", " ").alias("w"), "f", "words", size.alias("size"))
    longer = longer.select("lang", "w", "f", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    longer = longer.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "f")
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    found = counts.filter("words > 1").join(most, ["lang", "phrase"], "left")
    return found.filter(f"most IS NULL OR CAST(most AS DECIMAL(20,0)) * 100 < CAST(f AS DECIMAL(20,0)) * {CONTAINED}").select("lang", "phrase")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """Adds `rank`: the first `top` of each language, first within salted parts, then of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return salted.drop("salt", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    counts = phrase_counts(docs, threshold)
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    ranked = best(scored(counts).join(alone(counts), ["lang", "phrase"]), top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
