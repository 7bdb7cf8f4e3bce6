"""The pipeline's stages against brute force on their own inputs, and the registered queries on the smallest tables."""

import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm import near_dup, token_files
from barloom.session import fresh_dir
from tests.compare import compare, connect
from tests.llm.test_operators import groups_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_knn", "op9_mixing"])
def test_queries_equal_their_sql(spark, name):
    ok, message, _, _ = compare(name, spark, connect(SF), SF, entry.queries(), entry.oracle_sql())
    assert ok, message


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out, path = stage(spark, docs, SF), fresh_dir(spark, name)
        out.write.parquet(path)
        seen[name] = docs.collect(), spark.read.parquet(path)
        docs = seen[name][1]
        assert name == "token_files" or docs.columns == columns
    before, after = seen["toxicity"]
    assert 0.7 * len(before) < after.count() <= len(before)
    before, after = seen["near_duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, g in groups_of([(r.doc_id, r.text) for r in before]).items() if g[2])
    before, after = seen["decontamination"]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in before if any(i in " ".join((r.text or "").lower().split()) for i in items)}
    left = {r.doc_id for r in after.collect()}
    assert not whole & left and len(before) - len(left) <= len(whole) + 2
    before, after = seen["mixing"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before} and after.count() > 0.6 * len(before)
    before, after = seen["token_files"]
    tool, at = token_files.encoder(token_files.tokenizer_path()), 0
    texts = {r.doc_id: r.text or "" for r in before}
    rows = sorted(after.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in before)
    for r in rows:
        ids = np.array([*tool.whole([texts[r.doc_id]])[0], 0], dtype="<u4")
        assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_representatives_of_nothing(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert near_dup.representatives(empty).count() == 0
