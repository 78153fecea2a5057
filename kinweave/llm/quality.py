"""Quality rules as a ledger: measure once, keep failure bits, apply policies later.

`measure` reads each text once and counts; `ledger` turns the counts into one bit per
rule; a policy is a named, versioned set of bits, so applying another policy, or asking
what a rule alone would remove, is bitwise work on the ledger without reading texts.

A null text has no words. Every row stays, also repeated ones and those without an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_map, id_and_text
from kinweave.llm.words import NOT_SPACE, byte_class, distinct, mix, slices, starts_code_point

WINDOW = 3
_SYMBOLS = byte_class([(ord(c), ord(c)) for c in "#*$%&|<>"])
_UPPER = byte_class([(65, 90)])

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_lines long, n_upper long"
)


def _rules() -> dict[str, Column]:
    """Conditions of failure; a rule's bit is its place, so rules are only ever appended."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 2 * c("n_symbols") > c("n_words"),
        "duplicate_lines": (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 50 * c("n_lines")),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "shouting": 100 * c("n_upper") > 60 * c("word_chars"),
    }


#: Versioned policies; a version never changes once published.
POLICIES = {
    "base-1": ["few_words", "repeated_words"],
    "web-1": ["few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "shouting"],
}


def policy_mask(policy: str) -> int:
    names = list(_rules())
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measure(docs: DataFrame) -> DataFrame:
    """Counts for each row of `docs`, from its whole text."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, part in slices(batch):
            inside = NOT_SPACE[part.data]
            text, start, end = part.spans(inside)
            word = part.hashes(start, end)
            line_text, line_start, line_end = part.spans(part.data != 10)
            sums = np.concatenate([[0], np.cumsum(inside)])
            full = sums[line_end] > sums[line_start]
            line_text = line_text[full]
            line = part.hashes(line_start[full], line_end[full])
            different, _ = distinct(line_text, line)
            n_lines = part.per_text(line_text)
            yield {
                "doc_id": rows.column("doc_id"),
                "n_words": part.per_text(text),
                "word_chars": part.count(inside & starts_code_point(part.data)),
                "n_symbols": part.count(_SYMBOLS[part.data]),
                "n_dup_lines": n_lines - part.per_text(different),
                "n_repeat_words": part.per_text(text, repeated(text, word)),
                "n_lines": n_lines,
                "n_upper": part.count(_UPPER[part.data]),
            }

    return arrow_map(id_and_text(docs), work, SCHEMA)


def repeated(text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """True for words within a window that its text holds twice or more."""
    covered = np.zeros(len(word), bool)
    n = len(word) - WINDOW + 1
    if n <= 0:
        return covered
    at = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    value = word[at]
    for step in range(1, WINDOW):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + word[at + step])
    order = np.lexsort((value, text[at]))
    same = (np.diff(value[order]) == 0) & (np.diff(text[at][order]) == 0)
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for step in range(WINDOW):
        covered[at[twice] + step] = True
    return covered


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and `failed`, the bits of the rules that a document fails."""
    bits = F.lit(0).cast("long")
    for place, condition in enumerate(_rules().values()):
        bits = bits.bitwiseOR(F.when(condition, F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: str, to: str = "kept") -> DataFrame:
    """A boolean column: no rule of the policy failed."""
    return rows.withColumn(to, F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: what fails it, what only it removes, what all remove.

    One aggregate over the ledger; (rule, n_failed, n_only, n_removed, n_documents).
    """
    mask, names = policy_mask(policy), list(_rules())
    of = F.col("failed").bitwiseAND(F.lit(mask))
    totals = [F.count("*").alias("n"), F.count_if(of != 0).alias("removed")]
    for rule in POLICIES[policy]:
        bit = F.lit(1 << names.index(rule))
        totals += [F.count_if(of.bitwiseAND(bit) != 0).alias(f"f_{rule}"), F.count_if(of == bit).alias(f"o_{rule}")]
    each = [
        F.struct(F.lit(rule).alias("rule"), F.col(f"f_{rule}").alias("n_failed"), F.col(f"o_{rule}").alias("n_only"))
        for rule in POLICIES[policy]
    ]
    return rows.agg(*totals).select(F.inline(F.array(*each)), F.col("removed").alias("n_removed"), F.col("n").alias("n_documents"))


def quality_rules(docs: DataFrame, policy: str = "web-1") -> DataFrame:
    """The ledger with the base verdict and the verdict of a policy."""
    rows = apply_policy(ledger(docs), "base-1", "base_kept")
    rows = apply_policy(rows, policy, "policy_kept")
    base_failed = ~F.col("base_kept")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (F.col("base_kept") & F.col("policy_kept")).alias("kept"),
        "failed", "n_lines", "n_upper",
    )
