"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import hashlib
import os

import pytest

import corpus_pipeline
from tests.llm.test_operators import classes_by_force

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == before.columns
        tables[name] = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = tables["quality_classifier"]
    assert sum(i in good for i, q in labels.items() if q == 1) >= 0.98 * sum(q == 1 for q in labels.values())
    assert sum(i in good for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    lines = tables["line_dedup"]
    assert lines.keys() == good.keys()
    for i, r in lines.items():
        rest = iter(good[i].text.split("\n"))
        assert r.n_chars == len(r.text) and all(line in rest for line in (r.text.split("\n") if r.text else []))
    near = tables["near_duplicates"]
    assert near.keys() == set(classes_by_force({i: r.text for i, r in lines.items()}).values())
    assert tables["mixing"].keys() <= near.keys()
    assert tables["pieces"].keys() == tables["mixing"].keys()
    for i, r in tables["pieces"].items():
        text = tables["mixing"][i].text or ""
        assert r.n_pieces == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    whole = corpus_pipeline.run(spark, FOLDER).count()
    assert whole == docs.count()


@pytest.fixture(scope="module")
def folder(spark, some_labels, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    some_labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_no_rows(spark, odd_documents, no_documents, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd_documents, folder)
    rows = out.collect()
    ids = {r.doc_id for r in odd_documents.collect()}
    assert {r.doc_id for r in rows} <= ids
    if name != "pieces":
        assert out.columns == odd_documents.columns
    if name in ("line_dedup", "pieces"):
        assert len(rows) == odd_documents.count()
    if name == "near_duplicates":  # equal texts, the near copies and the empty ones leave their smallest ids
        assert {r.doc_id for r in rows} == {1, 3, 5, 6, 7, 8}
    assert stage(spark, no_documents, folder).collect() == []


def test_texts_of_megabytes_and_without_spaces(spark, folder):
    """One giant line, and prose without spaces, through the stages that look inside texts."""
    giant = " ".join(f"word{i % 7919}" for i in range(300_000))
    dense = "".join(chr(0x4E00 + (i * i) % 3000) for i in range(20_000))
    docs = spark.createDataFrame([(1, giant, "en", "a", len(giant)), (2, dense, "zh", "a", len(dense))], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("line_dedup", "near_duplicates", "mixing"):
        assert {r.doc_id: r.text for r in stages[name](spark, docs, folder).collect()} == {1: giant, 2: dense}
    digests = {r.doc_id: r.decoded_sha256 for r in stages["pieces"](spark, docs, folder).collect()}
    assert digests == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in ((1, giant), (2, dense))}
