"""Result documents: nested JSON files of measurements, read into a flat table and written back.

A document maps, for each engine, a query name to its measurements, and carries a
``metadata`` object.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions.ranking import positions


def _newest(spark: SparkSession, path: str, pattern: str, n: int) -> list[str]:
    """Paths of the n newest files; only the listing is read, not the contents."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "modificationTime")
    )
    newest = files.orderBy(F.desc("modificationTime"), "path").limit(n)
    return [row.path for row in newest.collect()]


#: Why a document isn't read.
NOT_JSON, NO_DATASET = "not_json", "no_dataset"


def _opened(spark: SparkSession, path: str, newest: int, pattern: str, multi_line: bool) -> DataFrame:
    """(file, file_time, doc, reason): each document as a VARIANT, without a schema of its own."""
    paths: str | list[str] = _newest(spark, path, pattern, newest) if newest > 0 else path
    if isinstance(paths, list) and not paths:
        return spark.createDataFrame([], "file string, file_time timestamp, doc variant, reason string")
    read = spark.read.option("pathGlobFilter", pattern).text(paths, wholetext=multi_line)
    if not multi_line:
        read = read.where(F.trim("value") != "")
    doc = F.try_parse_json("value")
    dataset = F.try_variant_get("doc", "$.metadata.dataset", "string")
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        doc.alias("doc"),
    ).withColumn("reason", F.when(F.col("doc").isNull(), NOT_JSON).when(dataset.isNull(), NO_DATASET))


def read_documents(
    spark: SparkSession,
    path: str,
    newest: int = 0,
    pattern: str = "results_*.json",
    multi_line: bool = True,
) -> DataFrame:
    """(file, file_time, doc, profile, size, users_n): readable documents below ``path``.

    ``newest=n`` takes the n newest files, 0 takes all. ``multi_line=False`` reads files
    with one document per line, which Spark splits. Documents that aren't JSON or don't
    name their dataset are in ``unreadable_documents``.
    """

    def field(name: str, kind: str):
        return F.try_variant_get("doc", f"$.metadata.{name}", kind)

    opened = _opened(spark, path, newest, pattern, multi_line).where(F.col("reason").isNull())
    size = field("dataset", "string")
    return opened.select(
        "file",
        "file_time",
        "doc",
        field("docker_config", "string").alias("profile"),
        size.alias("size"),
        F.coalesce(field("users", "long"), assumed_users(size)).alias("users_n"),
    )


def unreadable_documents(
    spark: SparkSession, path: str, newest: int = 0, pattern: str = "results_*.json", multi_line: bool = True
) -> DataFrame:
    """(file, file_time, reason): the documents that ``read_documents`` leaves out."""
    opened = _opened(spark, path, newest, pattern, multi_line)
    return opened.where(F.col("reason").isNotNull()).select("file", "file_time", "reason")


def _entries(documents: DataFrame, place: str, *kept) -> DataFrame:
    """One row (kept, name, entry) per member of the object at ``place``; what isn't an object has none."""
    members = F.try_variant_get("doc", place, "map<string,variant>")
    return documents.select(*kept, F.explode(members).alias("name", "entry"))


def assumed_users(dataset) -> F.Column:
    known = F.when(F.lit(False), F.lit(0).cast("long"))
    for name, users in schemas.ASSUMED_USERS.items():
        known = known.when(dataset == name, users)
    return known.otherwise(F.lit(0).cast("long"))


def runs_from_json(
    spark: SparkSession,
    path: str,
    engines: Sequence[str] = schemas.ENGINES,
    newest: int = 0,
    pattern: str = "results_*.json",
    multi_line: bool = True,
) -> DataFrame:
    """The documents as one row per measurement.

    (file, file_time, profile, size, users_n, engine, query, results_count,
    iteration, t). ``iteration`` numbers the stored times from 1. An entry is an object
    with ``times``, or with only a mean in ``avg_time``, which counts as one time, or a bare
    list of times. An entry without any time keeps one row with null ``iteration`` and ``t``.
    """
    documents = read_documents(spark, path, newest, pattern, multi_line)
    kept = ["file", "file_time", "profile", "size", "users_n"]
    engine = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), F.try_variant_get("doc", f"$.{e}", "map<string,variant>").alias("measured")) for e in engines]))
    sides = documents.select(*kept, engine.alias("side")).select(*kept, "side.engine", F.explode("side.measured").alias("query", "m"))
    mean = F.try_variant_get("m", "$.avg_time", "double")
    listed = F.coalesce(F.try_variant_get("m", "$.times", "array<double>"), F.try_variant_get("m", "$", "array<double>"))
    stored = F.filter(listed, lambda t: t.isNotNull())
    times = F.when(listed.isNull() & mean.isNotNull(), F.array(mean)).otherwise(stored)
    count = F.coalesce(F.try_variant_get("m", "$.results_count", "int"), F.lit(0))
    return sides.select(*kept, "engine", "query", count.alias("results_count"), F.posexplode_outer(times).alias("place", "t")).select(
        *kept, "engine", "query", "results_count", (F.col("place") + 1).alias("iteration"), "t"
    )


#: The member of an efficiency map that isn't a query; names that begin like it are reserved.
SUMMARY = "_summary"
#: Fields of a query's entry in a published map and of the summary, with a place for each engine's name.
RATIO_FIELDS = {
    "efficiency_coefficient": "double", "b_faster_times": "double", "improvement_percentage": "double", "{a}_time_ms": "double",
    "{b}_time_ms": "double", "significance": "string",
}
SUMMARY_FIELDS = {
    "average_efficiency": "double", "median_efficiency": "double", "max_efficiency": "double", "min_efficiency": "double",
    "{a}_wins_count": "long", "{b}_wins_count": "long", "total_comparisons": "long", "overall_winner": "string", "performance_advantage": "string",
}


def _fields(fields: dict[str, str], engines: Sequence[str]) -> list:
    """The members of ``entry`` as columns; engines' names become a and b."""
    a, b = engines
    return [
        F.try_variant_get("entry", f"$.{name.format(a=a, b=b)}", kind).alias(name.format(a="a", b="b")) for name, kind in fields.items()
    ]


def efficiency_from_json(
    spark: SparkSession,
    path: str,
    engines: Sequence[str] = schemas.ENGINES,
    newest: int = 0,
    pattern: str = "results_*.json",
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The published ratios of documents: those of each query, and the summaries.

    Both begin with (file, file_time, profile, size, users_n). Members of the map that
    begin with an underscore aren't queries; a document without the map has no rows.
    """
    kept = ["file", "file_time", "profile", "size", "users_n"]
    members = _entries(read_documents(spark, path, newest, pattern, multi_line), "$.efficiency", *kept)
    ratios = members.where(~F.col("name").startswith("_")).select(*kept, F.col("name").alias("query"), *_fields(RATIO_FIELDS, engines))
    return ratios, members.where(F.col("name") == SUMMARY).select(*kept, *_fields(SUMMARY_FIELDS, engines))


def _efficiency_members(ratios: DataFrame, summaries: DataFrame, engines: Sequence[str], document: str) -> DataFrame:
    """(document, size, profile, members): JSON text of an efficiency map and its summary, without braces."""
    a, b = engines
    keys = [document, "size", "profile"]

    def entry(fields: dict[str, str]):
        return F.struct(*[F.col(name.format(a="a", b="b")).alias(name.format(a=a, b=b)) for name in fields])

    entries = ratios.select(*keys, F.struct("query", F.to_json(entry(RATIO_FIELDS))).alias("member"))
    whole = entries.unionByName(summaries.select(*keys, F.struct(F.lit(SUMMARY).alias("query"), F.to_json(entry(SUMMARY_FIELDS))).alias("member")))
    # Members differ in their fields, so each is JSON text already.
    quoted = F.concat(F.to_json(F.array("member.query")), F.lit(":"), F.col("member.col2"))
    member = F.regexp_replace(quoted, r"^\[(.*?)\]:", "$1:")
    return whole.select(*keys, member.alias("member")).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("member")), ",").alias("members"))


def efficiency_documents(ratios: DataFrame, summaries: DataFrame, engines: Sequence[str], document: str = "source") -> DataFrame:
    """One row (document, size, json) per experiment: its efficiency map with the summary in it."""
    folded = _efficiency_members(ratios, summaries, engines, document)
    metadata = F.to_json(F.struct(F.col("size").alias("dataset"), F.col("profile").alias("docker_config")))
    body = F.concat(F.lit('{"efficiency":{'), "members", F.lit('},"metadata":'), metadata, F.lit("}"))
    return folded.select(document, "size", body.alias("json"))


def _measured(runs: DataFrame, engines: Sequence[str], document: str) -> DataFrame:
    """(document, size, users_n, profile, a map per engine): measurements of each experiment by query.

    A document holds one experiment, so the lists it collects have its size.
    """
    stats = [
        F.count("t").cast("int").alias("iterations"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("iteration", "run_no", "t"))), lambda r: r["t"]
        ).alias("times"),
        F.min("t").alias("min_time"),
        F.max("t").alias("max_time"),
        F.avg("t").alias("avg_time"),
        F.coalesce(F.stddev_samp("t"), F.when(F.count("t") == 1, 0.0)).alias("std_time"),
        F.max_by("results_count", "run_no").alias("results_count"),
    ]
    keys = [document, "size", "users_n", "profile"]
    per_query = runs.groupBy(*keys, "engine", "query").agg(*stats)
    measured = F.struct(
        F.col("query").alias("description"),
        *["iterations", "times", "min_time", "max_time", "avg_time", "std_time", "results_count"],
    )

    def side(engine: str):
        entry = F.when(F.col("engine") == engine, F.struct("query", measured.alias("m")))
        return F.map_from_entries(F.collect_list(entry)).alias(engine)

    return per_query.groupBy(*keys).agg(*[side(e) for e in engines])


def documents_of(runs: DataFrame, engines: Sequence[str], document: str = "source") -> DataFrame:
    """Flat measurements folded into documents: one row (document, size, json) per file and size."""
    folded = _measured(runs, engines, document)
    metadata = F.struct(
        F.col("size").alias("dataset"),
        F.col("profile").alias("docker_config"),
        F.col("users_n").alias("users"),
    )
    body = F.struct(*[F.col(e) for e in engines], metadata.alias("metadata"))
    return folded.select(document, "size", F.to_json(body).alias("json"))


def _ladder_entry(size: str) -> F.Column:
    """The fixed settings of a dataset size; null for a size that the ladder lacks."""
    entry = F.when(F.lit(False), F.struct(F.lit(0).alias("users"), F.lit(0).alias("avg_friends"), F.lit(0).alias("iterations")))
    for name, (users, friends, iterations) in schemas.SIZE_LADDER.items():
        fixed = F.struct(F.lit(users).alias("users"), F.lit(friends).alias("avg_friends"), F.lit(iterations).alias("iterations"))
        entry = entry.when(F.col(size) == name, fixed)
    return entry


COMPLETED, FAILED = "completed", "load_failed"


def complete_documents(
    runs: DataFrame,
    ratios: DataFrame,
    summaries: DataFrame,
    engines: Sequence[str],
    dataset_size: F.Column | None = None,
    document: str = "source",
) -> DataFrame:
    """(document, profile, size, json): whole result documents, one per experiment.

    Each holds the measurements of both engines, the efficiency map with its summary, a
    status, and metadata with the size's settings and, where given, ``dataset_size``, a
    struct of counts. An experiment without a ratio has an empty map and has failed.
    """
    keys = [document, "size", "profile"]
    members = _efficiency_members(ratios, summaries, engines, document)
    whole = _measured(runs, engines, document).join(members, keys, "left")
    sides = F.to_json(F.struct(*engines))
    status = F.when(F.col("members").isNull(), FAILED).otherwise(COMPLETED)
    metadata = [
        F.col("size").alias("dataset"),
        F.col("profile").alias("docker_config"),
        F.col("users_n").alias("users"),
        F.struct(_ladder_entry("size").alias("dataset_size_config")).alias("config"),
    ]
    if dataset_size is not None:
        metadata.append(dataset_size.alias("dataset_size"))
    body = F.concat(
        sides.substr(F.lit(1), F.length(sides) - 1),
        F.lit(',"efficiency":{'),
        F.coalesce("members", F.lit("")),
        F.lit('},"status":"'),
        status,
        F.lit('","metadata":'),
        F.to_json(F.struct(*metadata)),
        F.lit("}"),
    )
    return whole.select(document, "profile", "size", body.alias("json"))


#: Experiments in a document of a size; further ones are in documents of the same head.
PAGE = 1_000


def size_documents(trials: DataFrame, page: int = PAGE) -> DataFrame:
    """(profile, size, page, json): the experiments of each size with their counts.

    ``trials`` has (profile, size, seq, status, average_efficiency, overall_winner), in
    the order of the integer ``seq``. A document holds at most ``page`` experiments, so no
    list grows with the number of experiments of a size.
    """
    keys = ["profile", "size"]
    counts = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("iterations"), F.count_if(F.col("status") == COMPLETED).alias("successful_iterations")
    )
    result = F.struct("seq", "status", "average_efficiency", "overall_winner")
    paged = positions(trials.select(*keys, "seq", "status", "average_efficiency", "overall_winner"), keys, "seq")
    paged = paged.withColumn("page", F.floor((F.col("position") - 1) / page))
    listed = paged.groupBy(*keys, "page").agg(F.sort_array(F.collect_list(result)).alias("results"))
    config = _ladder_entry("size").alias("config")
    body = F.struct(
        F.col("profile").alias("infrastructure_config"), "size", config, "page", "iterations", "successful_iterations", "results"
    )
    return listed.join(counts, keys).select(*keys, "page", F.to_json(body).alias("json"))


def write_partitioned(documents: DataFrame, folder: str, *keys: str) -> None:
    """Documents as JSON text, one per line, in folders by ``keys``.

    Folders of the same keys are replaced and others stay, so a repeated run leaves
    each document once.
    """
    dealt = documents.select(*keys, "json").repartition(*keys, F.pmod(F.xxhash64("json"), F.lit(WRITERS)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).text(folder)


#: Tasks that share the documents of one folder.
WRITERS = 8


def write_documents(documents: DataFrame, folder: str) -> None:
    """Documents as JSON text, one per line."""
    documents.select("json").write.text(folder)


def write_results(df: DataFrame, folder: str) -> None:
    """Any result table as JSON lines."""
    df.write.json(folder)


def write_metadata(metadata: DataFrame, folder: str) -> None:
    """The one-row dataset metadata as JSON."""
    write_results(metadata, folder)
