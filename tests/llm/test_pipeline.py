"""The pipeline's stages by their own definitions, each on its predecessor's rows."""

import pytest

import corpus_pipeline as pipeline
from kinweave.llm import toxicity
from kinweave.llm.common import documents, stored
from tests.llm import brute, fixtures

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, made = documents(spark, SF), {}
    for name, stage in pipeline.STAGES:
        made[name] = (docs, stored(stage(spark, docs, SF), f"test-{name}"))
        docs = made[name][1]
    return made


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    assert all(stages[name][1].columns == COLUMNS for name in list(stages)[:-1])


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    scored = toxicity.score_documents(before, documents(spark, SF, "labels"))
    assert set(texts(after)) == {r["doc_id"] for r in scored.filter("predicted = 0").collect()}
    assert 0 < len(texts(after)) < len(texts(before))


def test_repeated_lines_go(stages):
    before, after = map(texts, stages["line_dedup"])
    gone = brute.removed_lines(list(before.items()), 50)
    wanted = {}
    for doc_id, text in before.items():
        left = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone[doc_id])
        if not gone[doc_id] or brute.SPACE_WORD.search(left):
            wanted[doc_id] = left
    assert after == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line_dedup"][1].collect() if gone[r["doc_id"]])


def test_one_of_each_group_stays(stages):
    before, after = map(texts, stages["ngram_join"])
    ids = sorted(before)
    roots = brute.components(ids, brute.linked([before[i] for i in ids], 5, 80))
    assert after == {i: before[i] for i in set(roots)}


def test_mixed_documents_are_unchanged(stages):
    before = texts(stages["mixing"][0])
    rows = stages["mixing"][1].collect()
    assert rows and all(before[r["doc_id"]] == r["text"] for r in rows)


def test_pieces_cover_the_copies(stages):
    copies = stages["packing"][0].groupBy("doc_id").count().collect()
    rows = stages["packing"][1].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    packed = {r["doc_id"]: r["sum(length)"] / r["max(doc_tokens)"] for r in rows}
    assert packed == {r["doc_id"]: r["count"] for r in copies}


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (fixtures.odd(spark).select(COLUMNS), fixtures.empty(spark)):
        for _, stage in pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), "test-odd")
        assert docs.columns[0] == "doc_id"
