"""Every registered query of the engine runs over the smallest tables and, where SQL says it, agrees with DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from matchloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def in_order(found):
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, name):
    agrees(spark, small, name)


def agrees(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = [tuple(plain(x) for x in r) for r in df.select(*columns).collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    q = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(q.columns) == columns
    at = [q.columns.index(c) for c in columns]
    assert in_order(got) == in_order([tuple(plain(r[i]) for i in at) for r in q.fetchall()])


@pytest.mark.parametrize("partitions", ["3", "8"])
@pytest.mark.parametrize("name", ["feat_audio_z", "profile_numeric_stats", "feat_popularity"])
def test_ties_of_roundings(spark, name, partitions):
    """Where prices and their means lie between two roundings, at the larger scale and in any order of rows."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        agrees(spark, "/root/testdata/sf0.01", name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("name", ["feat_semantic", "feat_tags", "recommend_topk_semantic", "rerank_soft"])
def test_no_python_in_plans(spark, small, name):
    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = catalog.QUERIES["pushdown_scan"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(s_nationkey,7)" in plan and "s_acctbal" not in plan


def test_the_rest_does_not_import_the_corpus_subpackage():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "matchloom.llm" not in path.read_text()
