"""the grid ranks the pairs of an item as a matrix; no pair is copied for a combination."""

from __future__ import annotations

import math

from matchloom.operators import rerank, tuning
from matchloom.plans import domain as dm


def test_search_as_by_hand(spark):
    options = {"no_match": [0.02, 0.1], "untagged": [0.3], "secondary": [0.5], "breadth": [1, 4]}
    tags = [["hot"], ["cold"], ["hot", "bolt"], []]
    pairs = [(f"i{i}", f"t{j}", int((i * 7 + j) % 3 == 0), ((i * 31 + j * 17) % 11) / 11, ["hot"], tags[j % 4][:1], tags[j % 4]) for i in range(9) for j in range(1 + 6 * i)]
    df = spark.createDataFrame(pairs, "item_id string, target_id string, label int, score double, asked_tags array<string>, primary_tags array<string>, tags array<string>").repartition(3)
    found = tuning.search(df, tuning.grid(spark, options), dm.PARTS, ks=(2, 5))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["combo"]: r.asDict() for r in found.collect()}
    multiplier = df.select("item_id", "target_id", *[rerank.explicit_multiplier(df.asked_tags, df.primary_tags, df.tags, rerank.Penalties(no_match=n, untagged=0.3, secondary=0.5, breadth=b), dm.PARTS).alias(f"m{c}") for c, (n, b) in enumerate([(0.02, 1), (0.02, 4), (0.1, 1), (0.1, 4)])])
    m = {(r["item_id"], r["target_id"]): r for r in multiplier.collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for c in got:
        mrr, recall, ndcg, n = 0.0, 0.0, 0.0, 0
        for i in {p[0] for p in pairs}:
            mine = sorted((p for p in pairs if p[0] == i), key=lambda p: (-round(p[3] * m[p[0], p[1]][f"m{c}"], 9), p[1]))
            places = [r for r, p in enumerate(mine) if p[2] == 1]
            if places:
                n += 1
                mrr += 1 / (places[0] + 1)
                recall += sum(r < 5 for r in places) / len(places)
                ndcg += sum(1 / math.log2(r + 2) for r in places if r < 5) / sum(1 / math.log2(r + 2) for r in range(min(5, len(places))))
        assert got[c]["n_groups"] == n
        for name, value in (("mrr", mrr), ("recall_at_5", recall), ("ndcg_at_5", ndcg)):
            assert abs(got[c][name] - value / n) < 1e-9, (c, name)
