"""F1, F2, F4, F7, F8, F10, F12: best partners by products of matrices, as by a window over all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import vectors as vec
from matchloom.operators import nearest, pairs, rerank, sampling
from matchloom.plans import catalog, fit

DIM = 4


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i}", [float(round(a, 1)) for a in rng.normal(size=DIM)], i % 3) for i in range(150)]
    rows += [("none", None, 0), ("zero", [0.0] * DIM, 1), ("gap", [1.0, None, 0.0, 0.0], 2), ("nan", [1.0, float("nan"), 0.0, 0.0], 0)]
    return spark.createDataFrame(rows, "key string, v array<double>, part int").repartition(3)


@pytest.mark.parametrize("block", [64 << 20, 2000])
def test_best_is_the_window_over_all_pairs(sides, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", block)
    left = sides.select("key", "v", "part")
    right = sides.select(F.col("key").alias("other"), F.col("v").alias("w"), F.col("part").alias("theirs"))
    score = F.round(vec.cosine_of_norms(vec.dot(F.col("v"), F.col("w")), vec.norm(F.col("v")), vec.norm(F.col("w"))), 3)
    plain = lambda rows: {tuple(r) for r in rerank.top(rows.withColumn("score", score), 5, group="key", key="other").select("key", "other", "rank").collect() if r[0] != "nan" and r[1] != "nan"}
    a, b = left.withColumn("unit", nearest.unit_of(F.col("v"), DIM)), right.withColumn("unit", nearest.unit_of(F.col("w"), DIM))
    ranked = lambda rows: {tuple(r) for r in rerank.top(rows, 5, group="key", key="other").select("key", "other", "rank").collect() if r[0] != "nan" and r[1] != "nan"}
    every = left.crossJoin(right)
    assert ranked(nearest.best(a, b, 5, DIM, "key", "other", 3)) == plain(every)
    assert ranked(nearest.best(a, b, 5, DIM, "key", "other", 3, same=("part", "theirs"))) == plain(every.where("part = theirs"))
    assert ranked(nearest.best(a, b, 5, DIM, "key", "other", 3, differ=True)) == plain(every.where("key <> other"))


def refuse(*_, **__):
    raise AssertionError("all pairs are listed")


@pytest.mark.parametrize("name", ["full_catalog_pairs", "recommend_tier_filter", "recommend_topk_semantic", "neighbors_topk"])
def test_no_list_of_all_pairs(spark, small, monkeypatch, name):
    monkeypatch.setattr(pairs, "cross", refuse)
    monkeypatch.setattr(pairs, "cross_similar", refuse)
    if name == "neg_random_stratified":  # its random part may list pairs where probes don't suffice
        monkeypatch.setattr(sampling, "cross_similar", refuse, raising=False)
    else:
        monkeypatch.setattr(sampling, "cross", refuse)
        monkeypatch.setattr(sampling, "cross_similar", refuse, raising=False)
    assert catalog.QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("name", ["recommend_final", "rerank_conflict", "rerank_explicit_overlap", "rerank_breadth", "rerank_soft"])
def test_rules_meet_classes_not_rows(spark, small, monkeypatch, name):
    """a rule is applied to the pairs of distinct values."""
    met, plain = [], pairs.cross
    monkeypatch.setattr(pairs, "cross", lambda a, b, *rest: (met.append(({"item_id", "target_id"} & {*a.columns, *b.columns}, a.count() * b.count())), plain(a, b, *rest))[1])
    found = catalog.QUERIES[name](spark, small)
    assert met and all(not rows for rows, _ in met)
    n_items, n_targets = fit.prepared(spark, small).count(), fit.built(spark, small).count()
    if name != "recommend_final":
        assert found.agg(F.sum("n")).first()[0] == n_items * n_targets
    assert sum(n for _, n in met) < n_items * n_targets * (10 if name == "recommend_final" else 1)
