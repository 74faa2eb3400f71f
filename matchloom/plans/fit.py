"""Queries: profiles, pair features, re-ranking and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import vectors as vec
from matchloom.operators import nearest, pairs, profiles, rerank
from matchloom.plans import domain as dm
from matchloom.plans.domain import CENTROID_SQL, HISTORY_SQL, ITEMS_SQL, NUMERIC_SQL, TARGETS_SQL
from matchloom.workspace import keep


def profile_counts(spark, d):
    return dm.rounded(profiles.counts(dm.history(spark, d)))


def profile_centroid(spark, d):
    c = profiles.centroids(dm.labelled(spark, d), dm.items(spark, d), dm.DIM)
    return dm.rounded(c.select("target_id", F.posexplode(vec.unit(F.col("mean_vector"))).alias("i", "x")))


def profile_numeric_stats(spark, d):
    s = profiles.numeric_statistics(dm.labelled(spark, d), dm.items(spark, d), dm.NUMBERS)
    return dm.rounded(nudge=dm.NUDGE, df=s.select("target_id", *[F.col(f"num_{k}")[i].alias(f"{c}_{k}") for k in ("centroid", "std", "min", "max") for i, c in enumerate(dm.NUMBERS)]))


def profile_popularity(spark, d):
    return dm.rounded(profiles.popularity(dm.labelled(spark, d), dm.items(spark, d)), nudge=dm.NUDGE)


def profile_tags_primary_vs_all(spark, d):
    return profiles.with_tags(dm.targets(spark, d), dm.PARTS).select("target_id", "primary_tags", "tags", *profiles.ATTRIBUTES)


def built(spark, d):
    return profiles.build(dm.targets(spark, d).repartition(4 * spark.sparkContext.defaultParallelism, "target_id"), dm.labelled(spark, d), dm.items(spark, d), dm.NUMBERS, dm.DIM, dm.PARTS)


def prepared(spark, d):
    """Items with their tags; a text that many items have is tagged once, by all cores."""
    items, told = dm.items(spark, d), ["artist", "item_name", "album"]
    texts = items.select(*told).distinct().repartition(4 * spark.sparkContext.defaultParallelism)
    tags = pairs.prepare_items(texts.withColumn("embedding", F.lit(None).cast("array<double>")), [], dm.PARTS)
    tags = keep(tags.select(*[F.col(c).alias(f"of_{c}") for c in told], "item_tags"), "tags")
    if pairs.size_of(tags)[1] <= pairs.CLASS_BYTES:
        tags = F.broadcast(tags)
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in told]
    items = items.join(tags, same[0] & same[1] & same[2], "left").drop(*[f"of_{c}" for c in told])
    return pairs.prepare_items(items, dm.NUMBERS, dm.PARTS)


def profile_coverage(spark, d):
    return profiles.coverage(built(spark, d))


def featured(spark, d):
    """All interactions with an outcome and their features, in one plan."""
    p = dm.labelled(spark, d).groupBy("item_id", "target_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.featurize(p, prepared(spark, d), built(spark, d), dm.NUMBERS, dm.PARTS)


def feat(*names):
    return lambda spark, d: dm.rounded(featured(spark, d).select("item_id", "target_id", *names), nudge=dm.NUDGE)


FEATURES = {
    "feat_semantic": ["semantic_similarity", "title_text_similarity", "semantic_l2_distance", "title_semantic_diff"],
    "feat_audio_z": ["audio_centroid_cosine", "audio_centroid_l2", "audio_zscore_mean", "audio_zscore_max", "bpm_diff", "energy_diff", "danceability_diff"],
    "feat_audio_range": ["audio_range_ratio", "item_audio_available", "target_audio_available"],
    "feat_popularity": ["item_popularity_norm", "popularity_diff_norm", "popularity_zscore", "popularity_available"],
    "feat_tags": ["genre_jaccard", "genre_overlap_count", "genre_conflict_flag", "genre_precision_primary", "genre_precision_all", "item_tag_count", "target_tag_count"],
    "feat_soft_attrs": ["mood_match_flag", "language_match_flag", "activity_match_flag", "soft_attr_available", "target_n_soft_attrs", "target_has_language", "target_has_mood"],
    "feat_interactions": ["genre_semantic_interaction", "audio_genre_interaction"],
    "feat_structural": ["target_size_log", "target_genre_richness", "acceptance_rate", "accepted", "declined"],
}


def full_catalog_pairs(spark, d):
    """Scores of the whole catalogue with the label of each pair, in sum by target and label.

    A score depends on the item's vector only: each distinct vector meets each target once, and counts as often as items have it.
    """
    kinds, members = pairs.classed(dm.items(spark, d).select("item_id", "embedding"), ["embedding"])
    kinds = kinds.select("class", "n", nearest.unit_of(F.col("embedding"), dm.DIM).alias("unit"))
    positive = dm.labelled(spark, d).where("label = 1").select("item_id", "target_id").distinct()
    hits = positive.join(members, "item_id").groupBy("target_id", "class").agg(F.count(F.lit(1)).alias("n"))
    hits = hits.groupBy("target_id").agg(F.collect_list(F.struct("class", "n")).alias("hits"))
    t = built(spark, d).select("target_id", nearest.unit_of(F.col("centroid"), dm.DIM, F.col("centroid_norm")).alias("unit")).join(hits, "target_id", "left")
    found = nearest.totals(t, kinds, dm.DIM, "target_id", "class", dm.DIGITS)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("label"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s")) for i in (0, 1)])).alias("p")
    rows = found.select("target_id", each).select("target_id", "p.*").groupBy("target_id", "label").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    mean = F.col("s") / F.lit(10.0**dm.DIGITS) / F.col("n")
    return dm.rounded(rows.where("n > 0").select("target_id", "label", "n", mean.alias("mean_score")), 4)


def spread(found, members, digits=None):
    """The best targets of each class, ranked, for each item of the class."""
    return members.join(rerank.top(found, 5, group="class", digits=digits), "class")


def recommend_topk_semantic(spark, d):
    """Label, accepted centroids, all cosines, best five targets of each item."""
    kinds, members = pairs.classed(dm.items(spark, d).select("item_id", "embedding"), ["embedding"])
    i = kinds.select("class", nearest.unit_of(F.col("embedding"), dm.DIM).alias("unit"))
    c = profiles.centroids(dm.labelled(spark, d), dm.items(spark, d), dm.DIM).select("target_id", vec.unit(F.col("mean_vector")).alias("centroid"))
    t = keep(c.select("target_id", nearest.unit_of(F.col("centroid"), dm.DIM).alias("unit")), "centroids")
    return spread(nearest.best(i, t, 5, dm.DIM, "class", "target_id", dm.DIGITS), members).select("item_id", "target_id", "rank")


def asked(rows):
    """Requests ask for the tags of the item's name where its number is even."""
    even = F.col("item_id").cast("int") % 2 == 0
    return rows.withColumn("asked_tags", F.when(even, F.col("item_tags")).otherwise(F.array().cast("array<string>")))


def pair_counts(spark, d, mine, theirs, out, value):
    """How many items each target has by a value of the pair, which depends on the columns ``mine`` and ``theirs`` only: found
    once for each pair of their distinct values."""
    slices = 4 * spark.sparkContext.defaultParallelism
    i = dm.items(spark, d)
    told = [c for c in i.columns if c in mine] + (["artist", "item_name", "album"] if "item_tags" in mine else [])
    i = i.groupBy(*told).agg(F.count(F.lit(1)).alias("n")).repartition(slices)  # a text is tagged once
    i = pairs.prepare_items(i.withColumn("embedding", F.lit(None).cast("array<double>")), [], dm.PARTS)
    i = keep(i.groupBy(*mine).agg(F.sum("n").alias("n")), "sides")
    t = profiles.with_tags(dm.targets(spark, d).repartition(slices), dm.PARTS)
    kinds, members = pairs.classed(keep(t.select("target_id", *theirs), "targets"), theirs)
    kinds = kinds.drop("n").repartition(slices)
    found = pairs.cross(kinds, i, mine[0]).groupBy("class", value.alias(out)).agg(F.sum("n").alias("n"))
    return members.join(found, "class").groupBy("target_id", out).agg(F.sum("n").alias("n"))


TAGS = ["item_tags"], ["tags", "primary_tags"]
SOFT = [f"item_{a}" for a in profiles.ATTRIBUTES], list(profiles.ATTRIBUTES)


def rerank_conflict(spark, d):
    m = rerank.conflict_multiplier(F.col("item_tags"), F.col("tags"), words=dm.PARTS)
    return pair_counts(spark, d, *TAGS, "m", F.round(m, dm.DIGITS))


def rerank_explicit_overlap(spark, d):
    return pair_counts(spark, d, *TAGS, "kind", rerank.explicit_class(F.col("item_tags"), F.col("primary_tags"), F.col("tags"), dm.PARTS))


def rerank_breadth(spark, d):
    m = rerank.explicit_multiplier(F.col("item_tags"), F.col("primary_tags"), F.col("tags"), rerank.Penalties(breadth=1), dm.PARTS)
    return pair_counts(spark, d, *TAGS, "m", F.round(m, dm.DIGITS))


def rerank_soft(spark, d):
    return pair_counts(spark, d, *SOFT, "m", F.round(rerank.attribute_multiplier(), dm.DIGITS))


def recommend_tier_filter(spark, d):
    """Each item asks for a tier; the filter precedes scoring."""
    i = dm.items(spark, d).select("item_id", "embedding", (F.col("item_id").cast("int") % 4 + 1).alias("asked_tier"))
    kinds, members = pairs.classed(i, ["embedding", "asked_tier"])
    kinds = kinds.select("class", "asked_tier", nearest.unit_of(F.col("embedding"), dm.DIM).alias("unit"))
    t = keep(built(spark, d).select("target_id", "tier", nearest.unit_of(F.col("centroid"), dm.DIM, F.col("centroid_norm")).alias("unit")), "centroids")
    found = nearest.best(kinds, t, 3, dm.DIM, "class", "target_id", dm.DIGITS, half=True, same=("asked_tier", "tier"))
    return spread(found, members).where("rank <= 3").select("item_id", "target_id", "rank")


def recommend_final(spark, d):
    """Base scores, all multipliers, best five targets with their names.

    The multiplier of a pair depends on masks and attributes: it is found once for each pair of their distinct values.
    """
    soft, slices = profiles.ATTRIBUTES, 4 * spark.sparkContext.defaultParallelism
    i = dm.items(spark, d).withColumn("even", F.col("item_id").cast("int") % 2)
    told = [c for c in i.columns if c in ("embedding", "artist", "item_name", "album", "even") or c in {f"item_{a}" for a in soft}]
    texts, members = pairs.classed(i.select("item_id", *told), told, "text")  # a text is tagged once
    texts = asked(pairs.prepare_items(texts.repartition(slices), [], dm.PARTS).withColumn("item_id", F.col("even").cast("string")))
    texts = keep(rerank.item_masks(texts, dm.PARTS).select("text", "embedding", "item_mask", "asked_mask", *[f"item_{a}" for a in soft]), "texts")
    kinds, of_text = pairs.classed(texts, texts.columns[1:])
    members = members.join(of_text, "text").select("item_id", "class")
    some = kinds.agg(*[F.max(F.size(f"item_{a}") > 0).alias(a) for a in soft]).first()
    known = [a for a in soft if some[a]]  # an attribute that no item knows decides nothing
    rules, kinds = pairs.classed(kinds, ["item_mask", "asked_mask", *[f"item_{a}" for a in soft]], "rule")
    kinds = kinds.select("class", "rule", nearest.unit_of(F.col("embedding"), dm.DIM).alias("unit"))
    t = rerank.target_masks(built(spark, d), dm.PARTS)
    t = keep(t.select("target_id", "target_name", "target_mask", "primary_mask", "breadth", *known, nearest.unit_of(F.col("centroid"), dm.DIM, F.col("centroid_norm")).alias("unit")), "targets")
    sorts, t = pairs.classed(t, ["target_mask", "primary_mask", "breadth", *known], "kind")
    t = keep(t, "sorted")
    p = rerank.Penalties()
    weights = pairs.cross(rules.drop("n").repartition(slices), sorts.drop("n"), "kind")
    weights = weights.select("rule", "kind", rerank.masked_rules(p, dm.PARTS, True).alias("f0"), rerank.attribute_multiplier(p, known).alias("f1"))
    found = nearest.best_weighted(kinds, t, weights, 5, dm.DIM, "class", "target_id", dm.DIGITS)
    best = spread(found, members, 12).join(t.select("target_id", "target_name"), "target_id")
    return dm.rounded(best.select("item_id", "rank", "target_id", "target_name", "score"), 12)


QUERIES = {f.__name__: f for f in (profile_counts, profile_centroid, profile_numeric_stats, profile_popularity, profile_tags_primary_vs_all, profile_coverage)}
QUERIES |= {k: feat(*v) for k, v in FEATURES.items()}
QUERIES |= {f.__name__: f for f in (full_catalog_pairs, recommend_topk_semantic, rerank_conflict, rerank_explicit_overlap, rerank_breadth, rerank_soft, recommend_tier_filter, recommend_final)}

BASE = f"with {TARGETS_SQL}, {ITEMS_SQL}, {HISTORY_SQL}, {CENTROID_SQL}, {NUMERIC_SQL}"
_HIT = "list_has_any({a}, {b})"
_CONFLICT = "(not list_has_any({a}, {b}) and ((list_has_any({a}, ['cold','hot']) and list_has_any({b}, ['cold','hot'])) or (list_has_any({a}, ['new','old']) and list_has_any({b}, ['new','old']))))"
FULL = f"""{BASE},
f as (select p.item_id, p.target_id, i.*, t.primary_tags, t.tags, t.activities, t.languages, t.moods, t.countries,
  coalesce(n.accepted, 0) accepted, coalesce(n.declined, 0) declined, c.c, s.*,
  coalesce(list_cosine_similarity(emb, c.c), 0) semantic
  from (select distinct item_id, target_id from labelled) p left join items i using (item_id) left join tagged t using (target_id)
  left join counted n using (target_id) left join centroids c using (target_id) left join numeric_stats s using (target_id)),
z as (select *, abs(bpm - c1) / (s1 + 1e-3) z1, abs(energy - c2) / (s2 + 1e-3) z2,
  len(list_intersect(item_tags, tags)) inter, len(list_distinct(item_tags || tags)) uni,
  case when bpm is not null and c1 is not null and energy is not null and c2 is not null then (bpm * c1 + energy * c2) / (sqrt(bpm * bpm + energy * energy) * sqrt(c1 * c1 + c2 * c2))
       when energy is not null and c2 is not null then 1.0 else 0.0 end acos from f)"""
_FEATURES = {
    "feat_semantic": "round(semantic + 1e-9::double, 6) semantic_similarity, 0.0::double title_text_similarity, round(coalesce(list_distance(emb, c), 0) + 1e-9::double, 6) semantic_l2_distance, round(abs(semantic) + 1e-9::double, 6) title_semantic_diff",
    "feat_audio_z": "round(acos + 1e-9::double, 6) audio_centroid_cosine, round(coalesce(case when bpm is not null and c1 is not null then sqrt(((bpm - c1) ** 2 + (energy - c2) ** 2) / 2) else abs(energy - c2) end, 0) + 1e-9::double, 6) audio_centroid_l2, round(coalesce(case when z1 is null then z2 else (z1 + z2) / 2 end, 0) + 1e-9::double, 6) audio_zscore_mean, round(coalesce(greatest(z1, z2), 0) + 1e-9::double, 6) audio_zscore_max, round(coalesce(z1, 0) + 1e-9::double, 6) bpm_diff, round(coalesce(z2, 0) + 1e-9::double, 6) energy_diff, 0.0::double danceability_diff",
    "feat_audio_range": "round(coalesce(case when bpm is null or lo1 is null then cast(energy between lo2 and hi2 as int) else (cast(bpm between lo1 and hi1 as int) + cast(energy between lo2 and hi2 as int)) / 2 end, 0) + 1e-9::double, 6) audio_range_ratio, 1 item_audio_available, cast(c2 is not null as integer) target_audio_available",
    "feat_popularity": "round(case when popularity is null then 0 else greatest(0, least(1, popularity / 100)) end + 1e-9::double, 6)::double item_popularity_norm, round(case when popularity is null or pop_mean is null then 0 else greatest(0, least(1, abs(popularity - pop_mean) / 100)) end + 1e-9::double, 6) popularity_diff_norm, round(coalesce(abs(popularity - pop_mean) / greatest(pop_std, 5), 0) + 1e-9::double, 6) popularity_zscore, cast(popularity is not null and pop_mean is not null as integer) popularity_available",
    "feat_tags": f"round(case when len(item_tags) > 0 and len(tags) > 0 then inter / uni else 0 end + 1e-9::double, 6)::double genre_jaccard, cast(inter as integer) genre_overlap_count, cast({_CONFLICT.format(a='item_tags', b='tags')} as integer) genre_conflict_flag, round(case when len(primary_tags) > 0 then len(list_intersect(item_tags, primary_tags)) / len(primary_tags) else inter / len(tags) end + 1e-9::double, 6) genre_precision_primary, round(inter / len(tags) + 1e-9::double, 6) genre_precision_all, cast(len(item_tags) as integer) item_tag_count, cast(len(tags) as integer) target_tag_count",
    "feat_soft_attrs": """cast(list_has_any(item_moods, moods) as integer) mood_match_flag, cast(list_has_any(item_languages, languages) as integer) language_match_flag, round(len(list_intersect(item_activities, activities)) / len(list_distinct(item_activities || activities)) + 1e-9::double, 6) activity_match_flag, 1 soft_attr_available,
      cast(2 + (len(languages) > 0)::int + (len(moods) > 0)::int as integer) target_n_soft_attrs, cast(len(languages) > 0 as integer) target_has_language, cast(len(moods) > 0 as integer) target_has_mood""",
    "feat_interactions": "round(case when len(tags) > 0 then inter / uni else 0 end * semantic + 1e-9::double, 6) genre_semantic_interaction, round(acos * inter + 1e-9::double, 6) audio_genre_interaction",
    "feat_structural": "round(ln(1 + accepted) + 1e-9::double, 6) target_size_log, round(ln(1 + len(tags)) + 1e-9::double, 6) target_genre_richness, round(coalesce(accepted / nullif(accepted + declined, 0), 0) + 1e-9::double, 6) acceptance_rate, accepted, declined",
}
CATALOG = f"""{BASE}, scored as (select i.item_id, t.target_id, t.target_name, t.tier, i.k ik, i.item_tags, t.tags, t.primary_tags, i.item_moods, t.moods, i.item_languages, t.languages, i.item_activities, t.activities,
  coalesce(n.accepted, 0) accepted, i.popularity, round((coalesce(list_cosine_similarity(i.emb, c.c), 0) + 1) / 2, 6) score
  from items i cross join tagged t left join centroids c using (target_id) left join counted n using (target_id))"""
_CLASS = f"case when len(tags) = 0 then 'untagged' when list_has_any({{a}}, primary_tags) then case when {_CONFLICT.format(a='{a}', b='list_filter(primary_tags, lambda x: not list_contains({a}, x))')} then 'mixed' else 'primary' end when list_has_any({{a}}, tags) then 'secondary' else 'none' end"
_BREADTH = "case when len(primary_tags) > 0 then len(primary_tags) else len(tags) end"
_SOFT = "(case when len(moods) > 0 and not list_has_any(item_moods, moods) then 0.7 else 1.0 end * case when len(languages) > 0 and not list_has_any(item_languages, languages) then 0.3 else 1.0 end * case when not list_has_any(item_activities, activities) then 0.7 else 1.0 end)::double"
_CROSS = f"with {TARGETS_SQL}, {ITEMS_SQL}, crossed as (select * exclude (k) from items cross join tagged)".replace("select * exclude (k) from items cross join tagged", "select i.*, t.* exclude (k) from items i cross join tagged t")


def _multiplier(kind: str, threshold: int) -> str:
    base = f"case {kind} when 'untagged' then 0.3 when 'primary' then 1.0 when 'none' then 0.02 else 0.4 end"
    return f"({base} * case when {kind} <> 'untagged' and {_BREADTH} > {threshold} then sqrt({threshold}.0 / ({_BREADTH})) else 1.0 end)::double"


ORACLE_SQL = {
    "profile_counts": f"with {HISTORY_SQL} select target_id, count(*) filter (where label = 1) accepted, count(*) filter (where label = 0) declined, round(coalesce(count(*) filter (where label = 1) / nullif(count(*) filter (where label is not null), 0), 0), 6) acceptance_rate from history group by 1",
    "profile_centroid": f"with {ITEMS_SQL}, {HISTORY_SQL}, {CENTROID_SQL} select target_id, cast(i - 1 as integer) i, round(c[i], 6) x from centroids, dims",
    "profile_numeric_stats": f"with {ITEMS_SQL}, {HISTORY_SQL}, accepted as (select target_id, items.* from labelled join items using (item_id) where label = 1) select target_id, " + ", ".join(f"round({dm.exact_mean_sql(c) if k == 'centroid' else f'{f}({c})'} + 1e-9::double, 6) {c}_{k}" for k, f in (("centroid", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")) for c in ("bpm", "energy")) + " from accepted group by 1",
    "profile_popularity": f"with {ITEMS_SQL}, {HISTORY_SQL} select target_id, round({dm.exact_mean_sql('popularity')} + 1e-9::double, 6) pop_mean, round(stddev_pop(popularity) + 1e-9::double, 6) pop_std, count(popularity) pop_count from labelled join items using (item_id) where label = 1 group by 1",
    "profile_tags_primary_vs_all": f"with {TARGETS_SQL} select target_id, primary_tags, tags, activities, countries, languages, []::varchar[] tempos, moods from tagged",
    "profile_coverage": f"{BASE} select count(*) targets, count(c2) with_numbers, count(*) filter (where len(tags) > 0) with_tags, count(*) filter (where pop_count > 0) with_popularity, count(*) filter (where len(activities) > 0) with_activities, count(*) filter (where len(countries) > 0) with_countries, count(*) filter (where len(languages) > 0) with_languages, cast(0 as bigint) with_tempos, count(*) filter (where len(moods) > 0) with_moods from tagged left join numeric_stats using (target_id)",
    **{k: f"{FULL} select item_id, target_id, {v} from z" for k, v in _FEATURES.items()},
    "full_catalog_pairs": f"{CATALOG}, pos as (select distinct item_id, target_id from labelled where label = 1) select target_id, cast(pos.item_id is not null as integer) as label, count(*) n, round(avg(score), 4) mean_score from scored left join pos using (item_id, target_id) group by all",
    "recommend_topk_semantic": f"with {ITEMS_SQL}, {HISTORY_SQL}, {CENTROID_SQL}, s as (select item_id, target_id, round(coalesce(list_cosine_similarity(emb, c), 0), 6) score from items, centroids) select item_id, target_id, cast(rank as integer) rank from (select *, row_number() over (partition by item_id order by score desc, target_id) rank from s) where rank <= 5",
    "rerank_conflict": f"{_CROSS} select target_id, case when {_CONFLICT.format(a='item_tags', b='tags')} then 0.05 else 1.0 end::double m, count(*) n from crossed group by all",
    "rerank_explicit_overlap": f"{_CROSS} select target_id, {_CLASS.format(a='item_tags')} kind, count(*) n from crossed group by all",
    "rerank_breadth": f"{_CROSS}, c as (select *, {_CLASS.format(a='item_tags')} kind from crossed) select target_id, round({_multiplier('kind', 1)}, 6) m, count(*) n from c group by all",
    "rerank_soft": f"{_CROSS} select target_id, round({_SOFT}, 6) m, count(*) n from crossed group by all",
    "recommend_tier_filter": f"{CATALOG} select item_id, target_id, cast(rank as integer) rank from (select *, row_number() over (partition by item_id order by score desc, target_id) rank from scored where tier = ik % 4 + 1) where rank <= 3",
    "recommend_final": f"""{CATALOG}, c as (select *, {_CLASS.format(a='item_tags')} kind from scored),
      w as (select *, score * case when ik % 2 = 0 and len(item_tags) > 0 then {_multiplier('kind', 4)} when {_CONFLICT.format(a='item_tags', b='tags')} then 0.05 else 1.0 end::double * {_SOFT} s from c)
      select item_id, cast(rank as integer) rank, target_id, target_name, round(s, 12) score from (select *, row_number() over (partition by item_id order by round(s, 12) desc, target_id) rank from w) where rank <= 5""",
}
