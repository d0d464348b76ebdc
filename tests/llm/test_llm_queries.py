"""The registered queries over the smallest tables, against their SQL where there is one."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from attesta.llm import queries


def compare(spark, query, sql, sf_dir):
    import os

    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        path = f"{sf_dir}/{t}"
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) and any(f.endswith('.parquet') for f in os.listdir(path)) else path}')")
    want = con.execute(sql).fetchall()
    names = [d[0] for d in con.description]
    got = query(spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    got = queries.QUERIES[name](spark, sf_dir).count()
    assert got >= n if name == "op2_packing" else got == n


def test_pipeline_stages(spark, sf_dir):
    """Every stage keeps documents' columns and only rows of its input; the pieces hold all that the mix took."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        now = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert now and all(before[d] == t for d, t in now)
        if name != "mix_sources":
            assert len(now) == len(dict(now)) <= len(before)
        before = dict(now)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(before)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
