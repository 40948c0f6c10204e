"""The registered queries over whole small tables, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import same  # noqa: E402

import corpus_pipeline  # noqa: E402
from prefixlake.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLES[name], SF) is None


COLUMNS = {
    "op4_html_text": ["page_id", "url", "text", "n_chars"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    key = df.columns[0]
    source = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert {r[0] for r in df.select(key).collect()} == {r[0] for r in source.select(key).collect()}


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {"start": docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = held[name] = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == before.dtypes and 0 < docs.count() <= before.count()
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert held["suffix_dedup"].count() == held["near_dedup"].count()
    assert {r.doc_id for r in held["packing"].select("doc_id").collect()} == {r.doc_id for r in held["suffix_dedup"].collect()}
    whole = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, r.start, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in held["packing"].collect()}


def test_pipeline_empty_and_odd_rows(spark, tmp_path):
    rows = [(None, None, "en", "s", 0), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "good words " * 30, "en", None, 9)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for frame in (docs, docs.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, SF)
            assert out.count() <= frame.count() + 5, name
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.dtypes == frame.dtypes
