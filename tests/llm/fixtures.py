"""Small tables with everything that may go wrong in rows and columns."""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
     StructField("source", StringType()), StructField("n_chars", LongType())]
)

ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "a b", "a b c", "été ÉTÉ \U0001f600\U0001f600 x", "a" * 5000, "x y " * 3000,
    "tab\tand\x0bvertical\x0cfeed\rreturn\nline", " non-breaking em", "A B C a b c A B C", "same\nsame\nsame",
]


def table(spark, texts, ids=None, sources=None):
    rows = [
        (i if ids is None else ids[i], text, "en", f"s{i % 3}" if sources is None else sources[i], None if text is None else len(text))
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Odd texts, a repeated row, a repeated id, null ids and sources, clashing extra columns."""
    texts = [*ODD_TEXTS, "repeated row here", "repeated row here", "one id", "two texts", "no id", None]
    n = len(ODD_TEXTS)
    ids = [*range(n), 90, 90, 91, 91, None, None]
    rows = table(spark, texts, ids, [None if i % 4 == 0 else f"s{i % 3}" for i in range(len(texts))])
    clash = ["label", "hash", "shard", "copy", "line", "value", "key", "count", "part", "rank", "score", "pos", "node"]
    return rows.withColumns({name: F.lit("x") for name in clash})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def real(spark, sf="sf0.001", table="documents"):
    return spark.read.parquet(f"/root/testdata/{sf}/{table}.parquet")
