"""The pipeline: stages keep the columns, decisions take effect, odd tables pass through."""

import hashlib

import pytest
from test_pii import DOCS, base

import corpus_pipeline
from tessera.llm import decontaminate, queries
from tessera.llm.byte_bpe import codec, default_vocabulary

SF = "/root/testdata/sf0.001"


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages_over_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = {}, docs.columns
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        state = written(stage(spark, state, SF), tmp_path / name)
        seen[name] = state
        if name != corpus_pipeline.STAGES[-1][0]:
            assert state.columns == columns
    sizes = [docs.count(), *[seen[n].count() for n, _ in corpus_pipeline.STAGES]]
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] == sizes[5]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.leaks(seen["decontamination"], benchmark).count() == 0
    assert all(base(r.text) == "" for r in seen["personal_data"].collect())
    own = codec(*default_vocabulary())
    text = {r.doc_id: r.text for r in seen["personal_data"].collect()}
    for r in seen["byte_bpe"].collect():
        assert r.ids == own.encode(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 20_000, "de", None, 9)]])
def test_odd_tables(spark, tmp_path, rows):
    state = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        state = written(stage(spark, state, SF), tmp_path / name)
    assert state.count() == (2 if rows else 0)


def test_contracts_of_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
