"""Queries: metrics, calibration, slices, lift, curves, tag relevance, grids, splits, samples, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import metrics, model, pairs, profiles, rerank, sampling, tuning
from matchloom.plans import domain as dm
from matchloom.plans import fit
from matchloom.plans.domain import CENTROID_SQL, HISTORY_SQL, ITEMS_SQL, TARGETS_SQL
from matchloom.workspace import keep, shared_dir


def scored(spark, d):
    """All pairs with an outcome: a hash score, the label and slice columns."""
    p = dm.labelled(spark, d).groupBy("item_id", "target_id").agg(F.max("label").alias("label"))
    i, t = F.col("item_id").cast("long"), F.col("target_id").cast("long")
    p = p.withColumn("score", ((i * 7919 + t * 104729) % 1009).cast("double") / 1009)
    items = dm.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), "p_type", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") * 2.0).alias("popularity"))
    return p.join(items, "item_id")


SCORED_SQL = f"""{HISTORY_SQL}, scored as (select item_id, target_id, max(label) as label, ((cast(item_id as bigint) * 7919 + cast(target_id as bigint) * 104729) % 1009)::double / 1009 score from labelled group by 1, 2),
sliced as (select s.*, p_type, case when p_partkey % 7 <> 0 then p_size * 2.0 end popularity from scored s join part on p_partkey = cast(item_id as bigint))"""


def group_sql(rel: str, by: str = "") -> str:
    """Macro-averaged metrics of groups (by, item_id) that have a positive."""
    keys = f"{by}, item_id" if by else "item_id"
    per = ", ".join(f"count(*) filter (where label = 1 and r <= {k}) h{k}, sum(case when label = 1 and r <= {k} then 1 / log2(r + 1) else 0 end) g{k}" for k in metrics.KS)
    ideal = lambda k: f"list_sum(list_transform(range(1, 1 + least({k}, p)), lambda x: 1 / log2(x + 1)))"
    out = ", ".join(f"round(avg(case when h{k} > 0 then 1.0 else 0.0 end), 6) hit_at_{k}, round(avg(h{k} / {k}), 6) precision_at_{k}, round(avg(h{k} / p), 6) recall_at_{k}, round(avg(g{k} / {ideal(k)}), 6) ndcg_at_{k}" for k in metrics.KS)
    return f"""ranked as (select *, row_number() over (partition by {keys} order by score desc, target_id) r from {rel}),
      per as (select {keys}, count(*) filter (where label = 1) p, min(case when label = 1 then r end) first, {per} from ranked group by {keys} having count(*) filter (where label = 1) > 0)
      select {by + ', ' if by else ''}count(*) n_groups, round(avg(1.0 / first), 6) mrr, {out} from per {'group by ' + by if by else ''}"""


def rank_metrics_at_k(spark, d):
    return dm.rounded(metrics.ranking(scored(spark, d)))


def mrr(spark, d):
    return dm.rounded(metrics.group_metrics(scored(spark, d), ["item_id"]).select("item_id", "mrr"))


def ndcg(spark, d):
    return dm.rounded(metrics.group_metrics(scored(spark, d), ["item_id"]).select("item_id", "ndcg_at_3", "ndcg_at_10"))


def quality(spark, d):
    """Document labels with a deterministic score."""
    docs = dm.read(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 98) / 97.0).alias("score"))
    return dm.read(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


QUALITY_SQL = "q as (select quality as label, (n_chars % 98) / 97.0::double score from labels join documents using (doc_id))"


def calibration_ece(spark, d):
    return dm.rounded(metrics.calibration_error(quality(spark, d)))


def calibration_bins(spark, d):
    return dm.rounded(metrics.bins(quality(spark, d)))


def slice_metrics(spark, d):
    rows = metrics.median_split(scored(spark, d), "popularity", "popularity_half")
    return dm.rounded(metrics.slices(rows, ["p_type", "popularity_half"]))


def median_split(spark, d):
    p = dm.read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") * 2.0).alias("popularity"))
    return metrics.median_split(p, "popularity", "half").select("p_partkey", "half")


def lift(spark, d):
    return dm.rounded(metrics.lift(scored(spark, d)))


def tag_precision_at_k(spark, d):
    rows = scored(spark, d).select("item_id", "target_id", "score")
    i = fit.prepared(spark, d).select("item_id", "item_tags")
    t = profiles.with_tags(dm.targets(spark, d), dm.PARTS).select("target_id", "tags", "primary_tags")
    best = rerank.top(rows, 5).join(i, "item_id").join(t, "target_id")
    return dm.rounded(metrics.tag_relevance(best, 5, dm.PARTS))


def auc_pr(spark, d):
    return dm.rounded(metrics.curve(quality(spark, d)).select("auc_pr"))


def auc_roc(spark, d):
    return dm.rounded(metrics.curve(quality(spark, d)).select("auc_roc"))


def penalty_grid(spark, d):
    """All six knobs, the quick choice of their values: 972 combinations."""
    i = fit.prepared(spark, d).select("item_id", F.col("item_tags").alias("asked_tags"), *[f"item_{a}" for a in profiles.ATTRIBUTES])
    t = profiles.with_tags(dm.targets(spark, d).repartition(4 * spark.sparkContext.defaultParallelism, "target_id"), dm.PARTS).select("target_id", "tags", "primary_tags", *profiles.ATTRIBUTES)
    rows = scored(spark, d).select("item_id", "target_id", "label", "score").join(i, "item_id").join(t, "target_id")
    return dm.rounded(tuning.search(rows, tuning.grid(spark, tuning.QUICK), dm.PARTS))


def overtag_impact(spark, d):
    return dm.rounded(metrics.overtagging(profiles.with_tags(dm.targets(spark, d), dm.PARTS), (0, 1, 2, 4)))


def median_impute(spark, d):
    p = dm.read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("size"))
    return model.impute(p, model.medians(p, ["size"]))


def group_split_no_leak(spark, d):
    return sampling.group_split(dm.labelled(spark, d).select("item_id", "target_id")).groupBy("item_id").agg(F.max("is_test").alias("is_test"), F.count(F.lit(1)).alias("n"))


def neighbors_topk(spark, d):
    c = profiles.centroids(dm.labelled(spark, d), dm.items(spark, d), dm.DIM).select("target_id", F.col("mean_vector").alias("centroid"))
    return sampling.neighbours(c, 5, dim=dm.DIM).select("target_id", "neighbour", "rank")


def negatives(spark, d, config, kind):
    history = dm.labelled(spark, d)
    t = profiles.with_tags(dm.targets(spark, d).repartition(4 * spark.sparkContext.defaultParallelism, "target_id"), dm.PARTS).select("target_id", "tags", "tier")
    i = fit.prepared(spark, d).select("item_id", "item_tags")
    near = sampling.neighbours(profiles.centroids(history, dm.items(spark, d), dm.DIM).select("target_id", F.col("mean_vector").alias("centroid")), 5, dim=dm.DIM)
    return sampling.draw(history, t, i, near, config).where(F.col("kind") == kind).select("item_id", "target_id")


def neg_conflict(spark, d):
    return negatives(spark, d, sampling.Negatives(0.5, 1.0, 0.0, False), "conflict")


def neg_near_miss(spark, d):
    return negatives(spark, d, sampling.Negatives(0.5, 0.0, 1.0, False), "near")


def neg_random_stratified(spark, d):
    """Of a mixed draw the random part: what conflicting and near pairs leave, evenly over tiers."""
    return negatives(spark, d, sampling.Negatives(0.5), "random")


def training(spark, d):
    rows = dm.labelled(spark, d).groupBy("item_id", "target_id").agg(F.max("label").alias("label"))
    split = sampling.group_split(rows)

    known = split.where(~F.col("is_test"))
    t = dm.targets(spark, d).repartition(4 * spark.sparkContext.defaultParallelism, "target_id")
    built = keep(profiles.build(t, known, dm.items(spark, d), dm.NUMBERS, dm.DIM, dm.PARTS), "profiles")
    return keep(pairs.featurize(split, fit.prepared(spark, d), pairs.small_enough(built), dm.NUMBERS, dm.PARTS).select("item_id", "target_id", "is_test", "label", *pairs.MODEL_FEATURES), "training")


def fitted(rows):
    """The ranker with its defaults, on all features of the training rows."""
    return model.Ranker(pairs.MODEL_FEATURES).fit(rows.where("not is_test").drop("is_test"))


def train_and_score(spark, d):
    """Split by item, profiles from training rows only, calibrated trees; metrics of the test rows."""
    rows = training(spark, d)
    test = keep(fitted(rows).score(rows.where("is_test").drop("is_test")), "test")
    return metrics.ranking(test).crossJoin(F.broadcast(metrics.curve(test)))


def permutation_importance(spark, d):
    """Loss of ROC area for every feature, five repeats."""
    rows = training(spark, d)
    return model.permutation_importance(fitted(rows), rows.where("is_test").drop("is_test"), pairs.MODEL_FEATURES)


def stream_upsert(spark, d):
    """The upsert of user events as a stream over files; an addition to the batch form."""
    from uuid import uuid4

    from matchloom.sources.tables import Store
    from matchloom.streaming.upsert import stream_upsert as start

    base = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    store = Store(spark, f"{base}/tables")
    rows = dm.read(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("updated_at"))
    rows.write.parquet(f"{base}/in")
    start(spark, f"{base}/in", rows.schema, store, "users", ["user_id"], f"{base}/state").awaitTermination()
    return store.read("users").select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (rank_metrics_at_k, mrr, ndcg, calibration_ece, calibration_bins, slice_metrics, median_split, lift, tag_precision_at_k, auc_pr, auc_roc, penalty_grid, overtag_impact, median_impute, group_split_no_leak, neighbors_topk, neg_conflict, neg_near_miss, neg_random_stratified, train_and_score, permutation_importance, stream_upsert)}

_EDGES = "[" + ", ".join(repr(e) + "::double" for e in metrics.EDGES) + "]"
_BINNED = f"with {QUALITY_SQL}, e as (select unnest(range(0, 10)) b), binned as (select b, score, label from e left join q on score >= {_EDGES}[b + 1] and (score < {_EDGES}[b + 2] or (b = 9 and score <= 1.0))), g as (select cast(b as integer) bin, count(score) n, coalesce(avg(score), 0) mean_score, coalesce(avg(label), 0) mean_label from binned group by b)"
_TAGGED = f"with {TARGETS_SQL}, {ITEMS_SQL}, {SCORED_SQL}"
_SCORES = f"with {QUALITY_SQL}, per as (select score, sum(label)::double p, count(*)::double n from q group by 1), run as (select *, sum(p) over (order by score desc) tp, sum(n) over (order by score desc) seen, sum(p) over () tot, sum(n - p) over () neg from per)"
_MEDIAN = "case when popularity >= (select median(popularity) from {rel}) then 'high' when popularity is not null then 'low' end"
_CLASS = fit._CLASS.format(a="item_tags")
_KNOBS = ", ".join(f"(values {', '.join(f'({x}::double)' for x in values)}) v{i}(g{i})" for i, values in enumerate(tuning.QUICK.values()))
_GRID = f"grid as (select cast(row_number() over (order by {', '.join(f'g{i}' for i in range(6))}) - 1 as integer) combo, * from {_KNOBS})"
_PITCHED = "pitched as (select distinct item_id, target_id from labelled), positive as (select item_id, target_id anchor from labelled where label = 1)"
_HASH = "md5('{seed}|' || item_id || '|' || target_id)"
_TOTAL = "(select cast(round_even(count(*) * 0.5, 0) as bigint) from positive)"
_NEAR = """pairsim as (select a.target_id, b.target_id neighbour, round(list_dot_product(a.c, b.c), 6) s from centroids a, centroids b where a.target_id <> b.target_id),
near as (select target_id, neighbour, row_number() over (partition by target_id order by s desc, neighbour) rank from pairsim qualify rank <= 5)"""

ORACLE_SQL = {
    "rank_metrics_at_k": f"with {SCORED_SQL}, {group_sql('scored')}",
    "mrr": f"with {SCORED_SQL}, r as (select *, row_number() over (partition by item_id order by score desc, target_id) r from scored) select item_id, round(1.0 / min(r), 6)::double mrr from r where label = 1 group by 1",
    "ndcg": f"""with {SCORED_SQL}, r as (select *, row_number() over (partition by item_id order by score desc, target_id) r from scored),
      g as (select item_id, count(*) p, sum(case when r <= 3 then 1 / log2(r + 1) else 0 end) g3, sum(case when r <= 10 then 1 / log2(r + 1) else 0 end) g10 from r where label = 1 group by 1)
      select item_id, round(g3 / list_sum(list_transform(range(1, 1 + least(3, p)), lambda x: 1 / log2(x + 1))), 6) ndcg_at_3, round(g10 / list_sum(list_transform(range(1, 1 + least(10, p)), lambda x: 1 / log2(x + 1))), 6) ndcg_at_10 from g""",
    "calibration_ece": f"{_BINNED} select round(sum(n * abs(mean_label - mean_score)) / sum(n), 6) ece, cast(sum(n) as bigint) n from g",
    "calibration_bins": f"{_BINNED} select bin, n, round(mean_score, 6) mean_score, round(mean_label, 6) mean_label from g",
    "slice_metrics": f"with {SCORED_SQL}, s as (select *, {_MEDIAN.format(rel='sliced')} half from sliced), flat as (select item_id, target_id, score, label, 'p_type' slice_dim, coalesce(p_type, 'unknown') slice_value from s union all select item_id, target_id, score, label, 'popularity_half', coalesce(half, 'unknown') from s), {group_sql('flat', 'slice_dim, slice_value')}",
    "median_split": f"with p as (select p_partkey, case when p_partkey % 7 <> 0 then p_size * 2.0 end popularity from part) select p_partkey, {_MEDIAN.format(rel='p')} half from p",
    "lift": f"with {SCORED_SQL} select target_id, round(avg(label), 6) observed, round(avg(score), 6) predicted, count(*) n, round(avg(score) / nullif(avg(label), 0), 6) lift from scored group by 1",
    "tag_precision_at_k": f"""{_TAGGED}, best as (select *, row_number() over (partition by item_id order by score desc, target_id) r from scored qualify r <= 5),
      b as (select item_id, count(*) filter (where list_has_any(item_tags, tags)) / 5 a, count(*) filter (where list_has_any(item_tags, primary_tags)) / 5 p, count(*) filter (where {fit._CONFLICT.format(a='item_tags', b='tags')}) / 5 c from best join items using (item_id) join tagged using (target_id) where len(item_tags) > 0 group by 1)
      select count(*) n_items, round(avg(a), 6) tag_precision_at_5, round(avg(p), 6) primary_tag_precision_at_5, round(avg(c), 6) conflict_rate_at_5 from b""",
    "auc_pr": f"{_SCORES} select round(sum(p / tot * tp / seen), 6) auc_pr from run",
    "auc_roc": f"{_SCORES} select round(sum(p * (neg - (seen - tp) + (n - p) / 2)) / (max(tot) * max(neg)), 6) auc_roc from run",
    "penalty_grid": f"""{_TAGGED}, {_GRID}, flat as (select s.*, {_CLASS} kind, {fit._BREADTH} wide, (case when len(moods) > 0 and not list_has_any(item_moods, moods) then 1 else 0 end) + (case when not list_has_any(item_activities, activities) then 1 else 0 end) n_other, case when len(languages) > 0 and not list_has_any(item_languages, languages) then 1 else 0 end n_spoken from scored s join items using (item_id) join tagged using (target_id)),
      each_ as (select item_id, target_id, label, combo, round(score * ((case kind when 'untagged' then g1 when 'primary' then 1.0 when 'none' then g0 else g2 end * case when kind <> 'untagged' and wide > g5 then sqrt(g5 / wide) else 1.0 end) * pow(g3, n_other) * pow(g4, n_spoken)), 9) score from flat, grid),
      ranked as (select *, row_number() over (partition by combo, item_id order by score desc, target_id) r from each_),
      per as (select combo, item_id, count(*) filter (where label = 1) p, min(case when label = 1 then r end) first, count(*) filter (where label = 1 and r <= 5) h, sum(case when label = 1 and r <= 5 then 1 / log2(r + 1) else 0 end) g from ranked group by 1, 2 having count(*) filter (where label = 1) > 0)
      select combo, count(*) n_groups, round(avg(1.0 / first), 6) mrr, round(avg(case when h > 0 then 1.0 else 0.0 end), 6) hit_at_5, round(avg(h / 5), 6) precision_at_5, round(avg(h / p), 6) recall_at_5, round(avg(g / list_sum(list_transform(range(1, 1 + least(5, p)), lambda x: 1 / log2(x + 1)))), 6) ndcg_at_5 from per group by 1""",
    "overtag_impact": f"with {TARGETS_SQL}, w as (select {fit._BREADTH} b from tagged) select cast(t as integer) threshold, count(*) targets, count(*) filter (where b > t) n_broad, round(count(*) filter (where b > t) * 100.0 / count(*), 6)::double percent from w, (values (0), (1), (2), (4)) x(t) group by t",
    "median_impute": "with p as (select p_partkey, case when p_partkey % 7 <> 0 then p_size::double end size from part) select p_partkey, coalesce(size, (select median(size) from p)) size from p",
    "group_split_no_leak": f"with {HISTORY_SQL}, g as (select item_id, md5('42|' || item_id) h, count(*) n from labelled group by 1) select item_id, row_number() over (order by h) <= ceil(0.2 * (select count(*) from g)) is_test, n from g",
    "neighbors_topk": f"with {ITEMS_SQL}, {HISTORY_SQL}, {CENTROID_SQL}, {_NEAR} select target_id, neighbour, cast(rank as integer) rank from near",
    "neg_conflict": f"""with {TARGETS_SQL}, {HISTORY_SQL}, {_PITCHED}, anchors as (select distinct item_id, anchor, a.tags side from positive join tagged a on a.target_id = anchor where len(a.tags) > 0),
      numbered as (select *, row_number() over (order by target_id) - 1 n from tagged),
      probes as (select item_id, side, ('0x' || substr(md5('42|' || item_id || '|' || anchor || '|' || j), 1, 8))::bigint % (select count(*) from tagged) n from anchors, range(0, 8) r(j)),
      probed as (select distinct item_id, t.target_id from probes join numbered t using (n) anti join pitched p on p.item_id = probes.item_id and p.target_id = t.target_id where len(t.tags) > 0 and not list_has_any(side, t.tags)),
      listed as (select distinct anchors.item_id, t.target_id from anchors join tagged t on len(t.tags) > 0 and not list_has_any(side, t.tags) anti join pitched p on p.item_id = anchors.item_id and p.target_id = t.target_id),
      cand as (select * from probed where (select count(*) from probed) >= {_TOTAL} union all select * from listed where (select count(*) from probed) < {_TOTAL})
      select item_id, target_id from cand order by {_HASH.format(seed=42)}, item_id, target_id limit {_TOTAL}""",
    "neg_near_miss": f"with {ITEMS_SQL}, {HISTORY_SQL}, {CENTROID_SQL}, {_NEAR}, {_PITCHED}, cand as (select distinct item_id, neighbour target_id from positive join near on near.target_id = anchor) select item_id, target_id from cand anti join pitched using (item_id, target_id) order by {_HASH.format(seed=43)}, item_id, target_id limit {_TOTAL}",
    "neg_random_stratified": f"""with {TARGETS_SQL}, {ITEMS_SQL}, {HISTORY_SQL}, {CENTROID_SQL}, {_NEAR}, {_PITCHED},
      quotas as (select t, cast(round_even(t * 0.5, 0) as bigint) qc, cast(round_even(t * 0.33, 0) as bigint) qn from (select {_TOTAL} t)),
      anchors as (select distinct item_id, anchor, a.tags side from positive join tagged a on a.target_id = anchor),
      numbered as (select *, row_number() over (order by target_id) - 1 n from tagged),
      probes as (select item_id, side, ('0x' || substr(md5('42|' || item_id || '|' || anchor || '|' || j), 1, 8))::bigint % (select count(*) from tagged) n from anchors, range(0, 8) r(j)),
      probed as (select distinct probes.item_id, t.target_id from probes join numbered t using (n) where len(side) > 0 and len(t.tags) > 0 and not list_has_any(side, t.tags)),
      fresh as (select * from probed anti join pitched using (item_id, target_id)),
      listed as (select distinct anchors.item_id, t.target_id from anchors join tagged t on len(side) > 0 and len(t.tags) > 0 and not list_has_any(side, t.tags)),
      cand as (select * from fresh where (select count(*) from fresh) >= (select qc from quotas) union all select * from (select * from listed anti join pitched using (item_id, target_id)) where (select count(*) from fresh) < (select qc from quotas)),
      conflict as (select item_id, target_id from cand order by {_HASH.format(seed=42)}, item_id, target_id limit (select qc from quotas)),
      close as (select distinct item_id, neighbour target_id from positive join near on near.target_id = anchor),
      near_ as (select item_id, target_id from close anti join pitched using (item_id, target_id) anti join conflict using (item_id, target_id) order by {_HASH.format(seed=43)}, item_id, target_id limit (select qn from quotas)),
      tiered as (select target_id, tier, row_number() over (partition by tier order by target_id) - 1 n, count(*) over (partition by tier) size from tagged),
      buckets as (select list(tier order by tier) b from (select distinct tier from tagged)),
      tries as (select item_id, b[j % len(b) + 1] tier, ('0x' || substr(md5('44|' || item_id || '|' || anchor || '|' || j), 1, 8))::bigint h from anchors, range(0, 8) r(j), buckets),
      other as (select distinct tries.item_id, t.target_id from tries join tiered t on t.tier = tries.tier and t.n = h % size)
      select item_id, target_id from other anti join pitched using (item_id, target_id) anti join conflict using (item_id, target_id) anti join near_ using (item_id, target_id)
      order by {_HASH.format(seed=44)}, item_id, target_id limit (select t from quotas) - (select count(*) from conflict) - (select count(*) from near_)""",
    "stream_upsert": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1",
}
