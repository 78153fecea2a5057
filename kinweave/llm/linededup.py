"""Line dedup: repeated runs of lines by prefix doubling over line ids; later copies go.

Lines with a word, in order, are the text; a line's id is the class of its content. At
level k a position's rank names the class of the 2**k lines from there, and ranks of
level k+1 come from pairs of ranks 2**k lines apart, so two suffixes share 2**k lines
exactly if they share a rank: the classes are the intervals of the suffix array whose
longest common prefix reaches 2**k. Classes of one position are left out at once; a
suffix that is unique at 2**k lines stays unique. A rank is the first position of its
class, so no global sort is needed to name it, and none of the names depends on how
rows are dealt out.

A run of lines is removed where it stands again, if it has `min_words` words or more:
a line goes exactly if it lies in such a run with an equal run at an earlier position
(doc_id, then text hash, then line). It is enough to look at minimal runs, from each
line on and up to each line: they cover every longer run. A minimal run of m lines is
named by the ranks at level floor(log2(m)) of its first and its last 2**level lines,
which overlap and cover it. As each line has a word, m is at most `min_words`, and so
there are at most log2(min_words) doublings, however long the repeated runs are.

Only DataFrame functions. Rows with equal id and text are one document that stands
several times: all get the same result. A null text stays null, blank lines stay. An
empty table gives no rows. Each round is written to the shared folder, so that a lost
executor repeats one round at most. The operator's columns are `n_lines` and `n_removed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import stored

MIN_WORDS = 50
#: `[^\x20\x09-\x0D]+` as a pattern of Spark's expressions
WORD = r"[^\x20\x09-\x0D]+"
_DOC = ["d_id", "d_hash"]


def _keys() -> list[Column]:
    """Two numbers that tell documents apart; those without an id come last."""
    doc_id = F.col("doc_id").cast("long")
    return [
        F.coalesce(doc_id, F.lit(2**63 - 1)).alias("d_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), doc_id.isNull()).alias("d_hash"),
    ]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame) -> DataFrame:
    """(d_id, d_hash, seq, line, id1, id2, words, before, total): lines with a word.

    `line` counts all lines of the document from 0, `seq` those with a word from 1;
    `before` is the number of words before the line, `total` that of the document.
    """
    text = F.col("text").cast("string")
    content = F.transform(
        _lines(text),
        lambda line, at: F.struct(
            at.alias("line"), F.xxhash64(line).alias("id1"), F.hash(line, F.lit(1)).alias("id2"),
            F.regexp_count(line, F.lit(WORD)).alias("words"),
        ),
    )
    whole = docs.filter(text.isNotNull()).select(
        *_keys(), F.filter(content, lambda x: x["words"] > 0).alias("lines")
    )
    rows = whole.dropDuplicates(_DOC).select(*_DOC, F.inline("lines"))
    order = Window.partitionBy(*_DOC).orderBy("line")
    return rows.select(
        *_DOC, "line", "id1", "id2", "words",
        F.row_number().over(order).alias("seq"),
        (F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("before"),
        F.sum("words").over(Window.partitionBy(*_DOC)).alias("total"),
    )


def _position() -> Column:
    return F.struct(*_DOC, "seq")


def _named(rows: DataFrame, *by: str) -> DataFrame:
    """(d_id, d_hash, seq, rank) of rows whose values of `by` stand at several positions."""
    classes = rows.groupBy(*by).agg(F.min(_position()).alias("rank"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(classes, list(by)).select(*_DOC, "seq", "rank")


def ranks(lines: DataFrame, min_words: int) -> list[DataFrame]:
    """For each level the positions whose 2**level lines stand elsewhere too, with ranks."""
    levels = [stored(_named(lines, "id1", "id2"), "line-ranks")]
    while 2 ** len(levels) <= min_words and not levels[-1].isEmpty():
        step = 2 ** (len(levels) - 1)
        ahead = Window.partitionBy(*_DOC).orderBy("seq").rangeBetween(step, step)
        pairs = levels[-1].withColumn("further", F.max("rank").over(ahead)).filter("further is not null")
        pairs = pairs.withColumnRenamed("rank", "nearer")
        levels.append(stored(_named(pairs, "nearer", "further"), "line-ranks"))
    return levels


def minimal_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(d_id, d_hash, seq, last): the shortest run of enough words from and up to each line."""
    after = F.col("before") + F.col("words")
    # One running maximum answers both questions: the last line that begins at or below a word count.
    asked = lines.select(
        *_DOC, "seq", "total",
        F.inline(F.array(
            F.struct(F.lit(0).alias("kind"), F.col("before").alias("at")),
            F.struct(F.lit(1).alias("kind"), (F.col("before") + min_words - 1).alias("at")),
            F.struct(F.lit(2).alias("kind"), (after - min_words).alias("at")),
        )),
    )
    order = Window.partitionBy(*_DOC).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.withColumn("found", F.max(F.when(F.col("kind") == 0, F.col("seq"))).over(order))
    onward = found.filter((F.col("kind") == 1) & (F.col("total") > F.col("at")))
    upto = found.filter((F.col("kind") == 2) & (F.col("at") >= 0))
    return onward.select(*_DOC, "seq", F.col("found").alias("last")).union(
        upto.select(*_DOC, F.col("found").alias("seq"), F.col("seq").alias("last"))
    )


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d_id, d_hash, removed): numbers of the lines to remove, for documents that have any."""
    lines = stored(line_table(docs), "lines")
    levels = ranks(lines, min_words)
    level = F.floor(F.log2((F.col("last") - F.col("seq") + 1).cast("double")) + 1e-9).cast("int")
    # Most lines stand once: only runs whose first line is repeated go on.
    runs = minimal_runs(lines, min_words).join(levels[0].select(*_DOC, "seq"), [*_DOC, "seq"], "left_semi")
    runs = runs.distinct().withColumn("level", level)
    named = levels[0].withColumn("level", F.lit(0))
    for k, further in enumerate(levels[1:], 1):
        named = named.unionByName(further.withColumn("level", F.lit(k)))
    first = named.withColumnRenamed("rank", "nearer")
    tail = named.select(*_DOC, "level", F.col("seq").alias("tail"), F.col("rank").alias("further"))
    runs = runs.withColumn("tail", F.col("last") - F.pow(F.lit(2), F.col("level")).cast("int") + 1)
    runs = runs.withColumn("size", F.col("last") - F.col("seq"))
    runs = stored(runs.join(first, [*_DOC, "seq", "level"]).join(tail, [*_DOC, "tail", "level"]), "line-runs")
    kept = runs.groupBy("size", "nearer", "further").agg(F.min(_position()).alias("kept"))
    later = runs.join(kept, ["size", "nearer", "further"]).filter(_position() > F.col("kept"))
    gone = later.select(*_DOC, F.explode(F.sequence("seq", "last")).alias("seq")).distinct()
    numbers = gone.join(lines.select(*_DOC, "seq", "line"), [*_DOC, "seq"])
    return numbers.groupBy(*_DOC).agg(F.collect_set("line").alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of `docs`, `text` without later copies, with n_lines and n_removed."""
    gone = stored(removed_lines(docs, min_words), "lines-removed").alias("gone")
    keyed = docs.select(F.struct("*").alias("row"), *_keys()).alias("kept")
    # One plan at every size: documents that lose lines grow with the corpus.
    joined = keyed.join(gone.hint("merge"), (F.col("kept.d_id") == F.col("gone.d_id")) & (F.col("kept.d_hash") == F.col("gone.d_hash")), "left")
    text, removed = F.col("row.text").cast("string"), F.col("gone.removed")
    left = F.filter(_lines(text), lambda line, at: ~F.array_contains(removed, at))
    columns = {c: F.col("row")[c] for c in docs.columns if c not in ("n_lines", "n_removed")}
    columns["text"] = F.when(removed.isNull(), text).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[value.alias(name) for name, value in columns.items()],
        F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines"),
        F.when(removed.isNull(), 0).otherwise(F.size(removed)).cast("long").alias("n_removed"),
    )
