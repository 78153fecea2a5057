"""What the operators of this subpackage share: reading, storing and Arrow maps."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.session import scratch_path


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back.

    This cuts the lineage so that it survives lost executors, and lets the optimiser
    see the true size: it then broadcasts small tables by itself and shuffles large ones.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """`left.join(right, on, how)` for tables that grow with the corpus.

    By the size of its compressed file a table may look small enough to be broadcast; the
    driver would then hold it whole and unpacked, ten times as large. One plan at every size.
    """
    return left.join(right.hint("merge"), on, how)


_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this package, where their search path lacks it.

    Workers that find it by PYTHONPATH or an installation need no copy; otherwise Spark
    distributes a zip of the sources, once per application.
    """
    context = spark.sparkContext
    searched = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT in searched or "site-packages" in _ROOT.parts or context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1].name
    folder = tempfile.mkdtemp(prefix=f"{package}-code-")
    context.addPyFile(shutil.make_archive(f"{folder}/{package}", "zip", _ROOT, package))
    _shipped.add(context.applicationId)


ArrowMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: ArrowMap) -> ArrowMap:
    """`run`, which at its end returns freed memory to the system.

    Python workers are used again by later stages; what the allocators keep of an earlier
    stage would come on top of what those need.
    """

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return tidied


def bounded(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes of a column, or of one longer value."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, before + limit, "right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Apply `work` to each record batch; it yields dicts of columns."""
    ship_code(df.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield record_batch(columns, kind)

    return df.mapInArrow(tidy(run), schema)


def record_batch(columns: dict, kind: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in kind:
        value = columns[field.name]
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        arrays.append(value.cast(field.type) if isinstance(value, pa.Array) else pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=kind)


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns most operators read; other columns never reach the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
