"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output, in characters,
over its characters in the input. A document's number of copies is the Poisson quantile
of a uniform number hashed from a seed and its id, so it depends on nothing else and a
lost executor repeats it exactly. Copies are exploded and shuffled globally by a second
hash, which also orders them within partitions.

Only DataFrame functions. The rates are one row per source; the join with them is left
to the optimiser, which knows their written size. Rows with a null id are seeded by
their text; equal rows get equal numbers of copies. A null source is a source of its
own. Sources without characters, for which no rate leads to a target, keep the mean
rate `size`. An empty table gives no rows. The operator's columns are `mix_copy` (from
1), `mix_rate` and `mix_key` (the shuffle order); columns of these names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import stored

SEED = 17
#: Without given targets a source's share is its characters to this power, scaled to 1.
EXPONENT = 0.5
_UNITS = 2.0**52


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_UNITS)


def _identity() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("string")), F.lit(""))


def rates(docs: DataFrame, targets: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """(mix_source, mix_rate): one row per source.

    `targets` gives weights by source, scaled to 1; sources not in it get none.
    """
    chars = F.sum(F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long"))
    per_source = docs.groupBy(F.col("source").cast("string").alias("mix_source")).agg(chars.alias("chars"))
    if targets is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(EXPONENT))
    else:
        given = [F.when(F.col("mix_source") == name, F.lit(float(w))) for name, w in targets.items()]
        weight = F.coalesce(*given, F.lit(0.0))
    weighted = per_source.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0)))
    weighted = stored(weighted, "mixing-sources")
    chars, weight = weighted.agg(F.sum("chars"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(weight) * F.lit(chars) / F.col("chars") * F.lit(size)
    return weighted.select("mix_source", F.when(F.col("chars") > 0, share).otherwise(F.lit(float(size))).alias("mix_rate"))


def thresholds(source_rates: DataFrame) -> DataFrame:
    """Adds `mix_steps`: the Poisson distribution function at 0, 1, 2, ... until it is 1.

    Terms are taken as exponentials of running sums of logarithms, which hold for large rates.
    """
    rate = F.col("mix_rate")
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    terms = source_rates.select("*", F.explode(F.sequence(F.lit(0), most)).alias("k"))
    upto = Window.partitionBy("mix_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_k = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0))).over(upto)
    power = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.col("k") * F.log(rate))
    term = F.when((rate == 0) & (F.col("k") > 0), F.lit(0.0)).otherwise(F.exp(power - rate - F.col("log_k")))
    steps = terms.withColumn("log_k", log_k).withColumn("term", term)
    steps = steps.withColumn("step", F.sum("term").over(upto))
    return steps.groupBy("mix_source", "mix_rate").agg(F.sort_array(F.collect_list("step")).alias("mix_steps"))


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, size: float = 1.0, seed: int = SEED) -> DataFrame:
    """All columns of `docs` once per copy, with mix_copy, mix_rate and mix_key."""
    per_source = stored(thresholds(rates(docs, targets, size)), "mixing-rates")
    joined = docs.drop("mix_copy", "mix_rate", "mix_key", "mix_source", "mix_steps").join(
        per_source, F.col("source").cast("string").eqNullSafe(F.col("mix_source"))
    )
    u = uniform(f"{seed}-copies", _identity())
    copies = F.size(F.filter("mix_steps", lambda step: step <= u))
    exploded = (
        joined.withColumn("mix_n", copies)
        .filter("mix_n > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_n"))))
        .withColumn("mix_key", uniform(f"{seed}-order", _identity(), F.col("mix_copy").cast("string")))
        .drop("mix_source", "mix_steps", "mix_n")
    )
    return exploded.repartition("mix_key").sortWithinPartitions("mix_key")
