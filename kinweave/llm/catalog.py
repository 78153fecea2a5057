"""The registered queries of this subpackage, each over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import collocations, licences, linededup, merkle, minhash, mixing, ngramjoin, packing, pieces, pii, quality, simhash, toxicity
from kinweave.llm.oracle import ORACLE  # noqa: F401
from kinweave.llm.common import documents, stored

Query = Callable[[SparkSession, str], DataFrame]


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(documents(spark, sf_dir))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def _mixed(docs: DataFrame) -> DataFrame:
    """Rates and keys are rounded only here, for comparison."""
    return mixing.mix_sources(docs).withColumns({"mix_rate": F.round("mix_rate", 6), "mix_key": F.round("mix_key", 9)})


def _ablations(docs: DataFrame) -> DataFrame:
    """The second half of the rule ledger: every policy's rules by what each removes."""
    ledger = stored(quality.ledger(docs).select("failed"), "quality-ledger")
    each = [quality.ablations(ledger, policy).select(F.lit(policy).alias("policy"), "*") for policy in quality.POLICIES]
    return reduce(DataFrame.unionByName, each)


QUERIES: dict[str, Query] = {
    "op1_pii": _on_documents(pii.find_pii),
    "op2_ngram_join": _on_documents(ngramjoin.jaccard_join),
    "op3_packing": _on_documents(packing.pack),
    "op4_line_dedup": _on_documents(linededup.dedup_lines),
    "op5_licences": _on_documents(licences.scan_licences),
    "op6_toxicity": _toxicity,
    "op7_mixing": _on_documents(_mixed),
    "op8_quality": _on_documents(quality.quality_rules),
    "quality_ablations": _on_documents(_ablations),
    "op9_pieces": _on_documents(pieces.piece_counts),
    "op10_fingerprints": _on_documents(minhash.fingerprints),
    "op11_manifest": _on_documents(merkle.manifest),
    "op12_collocations": _on_documents(collocations.collocations),
    "op13_simhash": _on_documents(simhash.near_copies),
}
