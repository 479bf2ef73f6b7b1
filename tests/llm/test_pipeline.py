"""The corpus pipeline, stage by stage, over a small table."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from tests.llm import brute


@pytest.fixture
def tables(spark, tmp_path):
    from tests.llm.test_pairs import made

    rows = made(7)
    item = "item words of the benchmark that nobody else ever wrote down in such an order as this"
    rows += [(900, "before it " + item + " after it"), (901, "1234 5678"), (902, None)]
    d = spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, str(tmp_path)


def test_pipeline(spark, tables):
    tokenizers = pytest.importorskip("tokenizers")
    tables_of = pytest.importorskip("public_tokenizers")
    rows, folder = tables
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    classes = brute.classes(kept)
    kept = [(i, t) for i, t in kept if classes[i][1] == i]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "suffix_dedup", "decontamination", "bpe_tokens"]
    second = stages["near_duplicates"](spark, stages["language_id"](spark, docs, folder), folder)
    assert {(r["doc_id"], r["text"]) for r in second.collect()} == set(kept)
    assert second.columns == list(corpus_pipeline.COLUMNS)
    third = stages["suffix_dedup"](spark, second, folder)
    texts = {r["doc_id"]: r["text"] for r in third.collect()}
    assert texts == {i: left.decode("utf-8", "ignore") for i, (_, _, _, left) in brute.kept_bytes(kept).items()}
    assert any(len(texts[i]) < len(t) for i, t in kept)
    library = tokenizers.Tokenizer.from_file(tables_of.path("word_bpe_49k.json"))
    last = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(last) == {i for i, _ in kept} - {900}
    for i, digest in last.items():
        ids = library.encode(texts[i], add_special_tokens=False).ids
        assert hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() == digest


def test_pipeline_of_nothing(spark, tables, tmp_path):
    _, folder = tables
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []
