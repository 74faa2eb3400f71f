"""Queries over the whole default vocabulary, text vectors of targets, three numbers, and the standard slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import tags as tg
from matchloom.functions import vectors as vec
from matchloom.functions import vocab
from matchloom.operators import metrics, pairs, profiles
from matchloom.plans import domain as dm
from matchloom.plans.domain import CENTROID_SQL, HISTORY_SQL, ITEMS_SQL, NUMERIC_SQL, TARGETS_SQL
from matchloom.plans.evaluation import SCORED_SQL, group_sql, scored

#: The labels that the vocabulary knows, in order; parts are given three each by their keys.
LABELS = sorted(set(vocab.GENRE_LABELS) | set(vocab.SUBGENRE_LABELS))
STEPS = (1, 7, 13)


def labels_of(key, step: int):
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), (key * step % len(LABELS) + 1).cast("int"))


def labelled_parts(spark, d):
    k = F.col("p_partkey")
    return dm.read(spark, d, "part").select(k, *[labels_of(k, s).alias(f"l{s}") for s in STEPS])


def tagger_music(spark, d):
    """Tags of texts made of labels, by the whole vocabulary's patterns."""
    text = F.concat_ws(" + ", *[f"l{s}" for s in STEPS])
    return labelled_parts(spark, d).select("p_partkey", tg.tag(text).alias("tags"))


def label_tags_music(spark, d):
    """Tags of lists of labels, by the whole label map."""
    return labelled_parts(spark, d).select("p_partkey", tg.labels_tags(F.array("l1", "l7"), F.array("l13")).alias("tags"))


def tag_conflict_music(spark, d):
    """Conflicts of one label's tags with another's, families of rock and pop included."""
    both = labelled_parts(spark, d).select("p_partkey", tg.label_tags(F.col("l1")).alias("a"), tg.label_tags(F.col("l7")).alias("b"))
    return both.select("p_partkey", tg.conflict(F.col("a"), F.col("b")).alias("conflict"), F.round(tg.jaccard(F.col("a"), F.col("b")), dm.DIGITS).alias("jaccard"))


def text_targets(spark, d):
    """Targets, two of three with a vector of their text (that of the embedding with their number)."""
    vectors = dm.read(spark, d, "embeddings")
    k = F.col("target_id").cast("long")
    found = dm.targets(spark, d).withColumn("vec_id", F.when(k % 3 != 0, k % vectors.count()))
    return found.join(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("text_embedding")), "vec_id", "left").drop("vec_id")


def profile_blend(spark, d):
    """Centroids of targets that have a text vector, accepted items, both, or neither."""
    built = profiles.build(text_targets(spark, d), dm.labelled(spark, d), dm.items(spark, d), dm.NUMBERS, dm.DIM, dm.PARTS)
    return dm.rounded(built.where("centroid is not null").select("target_id", F.posexplode("centroid").alias("i", "x")), nudge=dm.NUDGE)


def with_danceability(items):
    """A third number for the items; every 13th lacks it."""
    k = F.col("item_id").cast("long")
    return items.withColumn("danceability", F.when(k % 13 != 0, (k * 31 % 101) / 100.0))


def _featured(spark, d, *names):
    numbers = [*dm.NUMBERS, "danceability"]
    items = with_danceability(dm.items(spark, d))
    built = profiles.build(text_targets(spark, d), dm.labelled(spark, d), items, numbers, dm.DIM, dm.PARTS)
    known = dm.labelled(spark, d).select("item_id", "target_id").distinct()
    rows = pairs.featurize(known, pairs.prepare_items(items, numbers, dm.PARTS), built, numbers, dm.PARTS)
    return dm.rounded(rows.select("item_id", "target_id", *names), nudge=dm.NUDGE)


def feat_title_text(spark, d):
    return _featured(spark, d, "semantic_similarity", "title_text_similarity", "title_semantic_diff")


def feat_three_numbers(spark, d):
    return _featured(spark, d, "bpm_diff", "energy_diff", "danceability_diff", "audio_zscore_mean", "audio_zscore_max")


def standard_slices(spark, d):
    """Ranking metrics by the four standard slices."""
    known = dm.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), (F.col("p_partkey") % 11 != 0).cast("int").alias("item_audio_available"))
    rows = scored(spark, d).join(known, "item_id").withColumns({"popularity_available": F.col("popularity").isNotNull().cast("int"), "item_popularity_norm": F.coalesce(F.col("popularity") / 100, F.lit(0.0))})
    sides = profiles.with_tags(dm.targets(spark, d), dm.PARTS).select("target_id", "primary_tags").join(profiles.counts(dm.labelled(spark, d)).select("target_id", "accepted"), "target_id", "left")
    return dm.rounded(metrics.standard_slices(rows, sides.withColumn("accepted", F.coalesce("accepted", F.lit(0)))))


QUERIES = {f.__name__: f for f in (tagger_music, label_tags_music, tag_conflict_music, profile_blend, feat_title_text, feat_three_numbers, standard_slices)}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]::varchar[]"


def tags_sql(text: str) -> str:
    """The tagger in SQL: the tags whose patterns are found; a compound takes the place of the plain tag."""
    found = ", ".join(f"case when regexp_matches({text}, {quoted('|'.join(f'(?:{p})' for p in patterns))}) then {quoted(t)} end" for t, patterns in vocab.TAG_PATTERNS.items())
    some = f"list_filter([{found}], lambda x: x is not null)"
    return f"list_sort(list_filter({some}, lambda x: not (x = {quoted(vocab.PLAIN)} and list_has_any({some}, {listed(vocab.COMPOUNDS)}))))"


_PARTS = "parts as (select p_partkey, " + ", ".join(f"({listed(LABELS)})[p_partkey * {s} % {len(LABELS)} + 1] l{s}" for s in STEPS) + " from part)"
_KNOWN = {**{k: v for k, v in vocab.GENRE_LABELS.items()}, **vocab.SUBGENRE_LABELS}
_MAPPED = "known as (select * from (values " + ", ".join(f"({quoted(k)}, {listed(_KNOWN[k])})" for k in LABELS) + ") v(label, tags))"
_GROUPS = " or ".join(f"(list_has_any(a, {listed(sorted(g))}) and list_has_any(b, {listed(sorted(g))}))" for g in vocab.MUSIC.conflicts)
_TEXTS = """texts as (select target_id, cast(embedding as double[]) t from tagged join embeddings on vec_id = k % (select count(*) from embeddings) where k % 3 <> 0),
blended as (select target_id, case when t is null then v when v is null then t else list_transform(list_zip(t, v), lambda p: 0.25::double * p[1] + 0.75::double * p[2]) end b, t from tagged left join texts using (target_id) left join mean_vectors using (target_id)),
centres as (select target_id, t, case when n > 1e-12 then list_transform(b, lambda x: x / n) else b end c from (select *, sqrt(list_dot_product(b, b)) n from blended where b is not null))"""
_THREE = f"""{ITEMS_SQL.replace('select cast(p_partkey as varchar) item_id, p_partkey k,', 'select cast(p_partkey as varchar) item_id, p_partkey k, case when p_partkey % 13 <> 0 then (p_partkey * 31 % 101) / 100.0::double end danceability,')}, {HISTORY_SQL}, {CENTROID_SQL}, {NUMERIC_SQL},
thirds as (select target_id, {dm.exact_mean_sql('danceability')} c3, stddev_pop(danceability) s3 from accepted group by 1),
z as (select p.item_id, p.target_id, abs(bpm - c1) / (s1 + 1e-3) z1, abs(energy - c2) / (s2 + 1e-3) z2, abs(danceability - c3) / (s3 + 1e-3) z3
  from (select distinct item_id, target_id from labelled) p join items using (item_id) left join numeric_stats using (target_id) left join thirds using (target_id)),
zs as (select *, list_filter([z1, z2, z3], lambda x: x is not null) zz from z)"""
_HALF = "case when {c} >= (select median({c}) from {rel}) then 'high' when {c} is not null then 'low' end"

ORACLE_SQL = {
    "tagger_music": f"with {_PARTS}, t as (select p_partkey, l1 || ' + ' || l7 || ' + ' || l13 t from parts) select p_partkey, {tags_sql('t')} tags from t",
    "label_tags_music": f"with {_PARTS}, {_MAPPED} select p_partkey, list_sort(list_distinct(a.tags || b.tags || c.tags)) tags from parts join known a on a.label = l1 join known b on b.label = l7 join known c on c.label = l13",
    "tag_conflict_music": f"with {_PARTS}, {_MAPPED}, s as (select p_partkey, a.tags a, b.tags b from parts join known a on a.label = l1 join known b on b.label = l7) select p_partkey, len(a) > 0 and len(b) > 0 and not list_has_any(a, b) and ({_GROUPS}) conflict, round(case when len(a) > 0 and len(b) > 0 then len(list_intersect(a, b)) / len(list_distinct(a || b)) else 0 end, 6)::double jaccard from s",
    "profile_blend": f"with {TARGETS_SQL}, {ITEMS_SQL}, {HISTORY_SQL}, {CENTROID_SQL}, {_TEXTS} select target_id, cast(i - 1 as integer) i, round(c[i] + 1e-9::double, 6) x from centres, dims",
    "feat_title_text": f"""with {TARGETS_SQL}, {ITEMS_SQL}, {HISTORY_SQL}, {CENTROID_SQL}, {_TEXTS}, s as (select p.item_id, p.target_id, coalesce(list_cosine_similarity(emb, c), 0) a, coalesce(list_cosine_similarity(emb, t), 0) b
      from (select distinct item_id, target_id from labelled) p left join items using (item_id) left join centres using (target_id))
      select item_id, target_id, round(a + 1e-9::double, 6) semantic_similarity, round(b + 1e-9::double, 6) title_text_similarity, round(abs(a - b) + 1e-9::double, 6) title_semantic_diff from s""",
    "feat_three_numbers": f"with {_THREE} select item_id, target_id, round(coalesce(z1, 0) + 1e-9::double, 6) bpm_diff, round(coalesce(z2, 0) + 1e-9::double, 6) energy_diff, round(coalesce(z3, 0) + 1e-9::double, 6) danceability_diff, round(coalesce(list_sum(zz) / nullif(len(zz), 0), 0) + 1e-9::double, 6) audio_zscore_mean, round(coalesce(list_max(zz), 0) + 1e-9::double, 6) audio_zscore_max from zs",
    "standard_slices": f"""with {TARGETS_SQL}, {SCORED_SQL}, n as (select target_id, coalesce(accepted, 0) accepted, coalesce(list_sort(primary_tags)[1], 'untagged') tag from tagged left join (select target_id, count(*) filter (where label = 1) accepted from labelled group by 1) using (target_id)),
      s as (select s.*, popularity / 100 known, n.tag, case when n.accepted >= (select median(accepted) from n) then 'many_accepted' else 'few_accepted' end big, case when cast(item_id as bigint) % 11 <> 0 then 'with_audio' else 'without_audio' end audio from sliced s join n using (target_id)),
      h as (select *, {_HALF.format(c='known', rel='s')} half from s),
      flat as (select item_id, target_id, score, label, 'audio' slice_dim, audio slice_value from h union all select item_id, target_id, score, label, 'popularity', case when half is null then 'unknown_popularity' else half || '_popularity' end from h
        union all select item_id, target_id, score, label, 'target_size', big from h union all select item_id, target_id, score, label, 'primary_tag', tag from h), {group_sql('flat', 'slice_dim, slice_value')}""",
}
