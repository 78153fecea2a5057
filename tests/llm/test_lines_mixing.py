"""Line dedup and mixing against plain definitions and their SQL."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.llm import linededup, mixing
from kinweave.llm.catalog import QUERIES
from kinweave.llm.oracle import ORACLE
from tests.compare import connect, difference
from tests.llm import brute, fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    assert difference(spark, connect(SF), name, SF, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("min_words", [1, 4, 9])
def test_lines_equal_all_runs(spark, min_words):
    rng = random.Random(min_words)
    pool = ["one", "two words", "a b c", "", " ", "four words in it"]
    texts = []
    for i in range(40):
        lines = [rng.choice(pool) + ("" if rng.random() < 0.6 else f" {i}") for _ in range(rng.randrange(0, 9))]
        texts.append("\n".join(texts[-1].split("\n")[1:4] + lines) if texts and rng.random() < 0.3 else "\n".join(lines))
    docs = [(i, t) for i, t in enumerate([*texts, None, "x\n" * 60])]
    wanted = brute.removed_lines(docs, min_words)
    result = linededup.dedup_lines(fixtures.table(spark, [t for _, t in docs]), min_words)
    for row in result.collect():
        text = dict(docs)[row["doc_id"]]
        if text is None:
            assert row["text"] is None and row["n_lines"] == 0
            continue
        left = [line for n, line in enumerate(text.split("\n")) if n not in wanted[row["doc_id"]]]
        assert row["text"] == "\n".join(left), (row["doc_id"], text)
        assert row["n_removed"] == len(wanted[row["doc_id"]]) and row["n_lines"] == len(text.split("\n"))


def test_passages_go_and_the_first_stays(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    two_lines = "\n".join([" ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))])
    texts = [f"start\n{passage}\nend", f"{passage}", f"other\n{two_lines}\nx", f"y\n{two_lines}", "clean text\nof two lines"]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(fixtures.table(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "", 2: texts[2], 3: "y", 4: texts[4]}


def test_line_dedup_of_odd_rows(spark):
    docs = fixtures.odd(spark)
    result = linededup.dedup_lines(docs, 1)
    assert result.count() == docs.count() and result.columns == [*docs.columns, "n_lines", "n_removed"]
    repeated = [r["text"] for r in result.filter("doc_id = 90").collect()]
    assert repeated == ["repeated row here"] * 2
    assert linededup.dedup_lines(fixtures.empty(spark)).count() == 0


def test_mixing_copies_equal_quantiles(spark):
    docs = fixtures.real(spark)
    rate = {r["mix_source"]: r["mix_rate"] for r in mixing.rates(docs).collect()}
    u = {r[0]: r[1] for r in docs.select("doc_id", mixing.uniform(f"{mixing.SEED}-copies", F.col("doc_id").cast("string"))).collect()}
    got = {}
    for row in mixing.mix_sources(docs).collect():
        got[row["doc_id"]] = max(got.get(row["doc_id"], 0), row["mix_copy"])
    for row in docs.collect():
        assert got.get(row["doc_id"], 0) == brute.poisson(u[row["doc_id"]], rate[row["source"]])


def test_mixing_meets_targets(spark):
    texts = ["x" * 100] * 3000
    sources = ["a"] * 2400 + ["b"] * 500 + [None] * 100
    docs = fixtures.table(spark, texts, sources=sources)
    counts = {r["source"]: r["count"] for r in mixing.mix_sources(docs, {"a": 1, "b": 3}).groupBy("source").count().collect()}
    assert None not in counts and abs(counts["a"] - 750) < 110 and abs(counts["b"] - 2250) < 200
    large = mixing.mix_sources(fixtures.table(spark, ["y", "z" * 999], sources=["a", "b"]), {"a": 900, "b": 100})
    n = large.filter("source = 'a'").count()
    assert abs(n - 900) < 150


def test_mixing_of_odd_rows(spark):
    docs = fixtures.odd(spark)
    mixed = mixing.mix_sources(docs)
    assert set(docs.columns) < set(mixed.columns)
    assert mixed.filter("mix_copy < 1 or mix_key < 0 or mix_key >= 1").count() == 0
    assert mixing.mix_sources(fixtures.empty(spark)).count() == 0
    assert mixing.mix_sources(fixtures.table(spark, [None, ""])).count() >= 0


def test_no_python_in_native_plans(spark):
    docs = fixtures.real(spark)
    for frame in (linededup.dedup_lines(docs), linededup.line_table(docs), mixing.mix_sources(docs)):
        plan = frame._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian"))
