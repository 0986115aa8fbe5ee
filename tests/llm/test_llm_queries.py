"""Registered queries against their SQL, and the pipeline against its stages' rules."""

from __future__ import annotations

import os
from collections import Counter

import pytest

import corpus_pipeline
from motionlake.llm import sharding
from motionlake.llm.queries import ORACLE_SQL, QUERIES, SHARDS
from tools.check import oracle_connection, ordered

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in ("op11_hard_negatives", "op12_collocations"):
        assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    if name in ORACLE_SQL:
        want = oracle_connection(FOLDER).execute(ORACLE_SQL[name]).df()
        a, b = ordered(got), ordered(want)
        assert list(a.columns) == list(b.columns)
        for column in a.columns:
            assert ((a[column] == b[column]) | (a[column].isna() & b[column].isna())).all(), column


def test_pipeline(spark):
    """Each stage keeps a part of its predecessor's rows and columns, and rerunning it alone changes nothing."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(r.doc_id for r in first.collect())
        out = spark.createDataFrame(stage(spark, first, FOLDER).collect(), docs.schema)
        after = Counter(r.doc_id for r in out.collect())
        assert out.columns == columns and set(after) <= set(before) and after
        assert max(after.values()) <= (2 if name == "source_mix" else 1)
        first = out
    placed = corpus_pipeline.STAGES[-1][1](spark, first, FOLDER).collect()
    assert len(placed) == first.count()
    table = sharding.lookup_table(SHARDS, sharding.table_size(len(SHARDS)))
    assert all(table[r.slot] == r.shard for r in placed)
    ran = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in ran) == Counter((r.doc_id, r.text, r.shard) for r in placed)
