"""The general tables in the roles of items, targets and interactions, for the registered queries.

supplier is the target, part the item, lineitem the interactions (A accepted, R declined, N no
label), embeddings the vectors of items. Words of part names are the tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import vocab
from matchloom.operators import rows

ADJECTIVES = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
NOUNS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
PARTS = vocab.Vocabulary(
    {**{w: [rf"\b{w}\b"] for w in ADJECTIVES + NOUNS}, "hot_rod": [r"\bhot\s*rod\b"]},
    vocab.widen([("cold", "hot"), ("new", "old")], {}),
    ("hot_rod",),
    "rod",
    (("hot rod", ("hot_rod",)), ("any gear", ())),
)
NUMBERS = ["bpm", "energy"]
DIM = 64
POSITIVE, NEGATIVE = ["a"], ["r"]
DIGITS = 6


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Added before rounding where a value can lie halfway between two roundings (differences of prices and their
#: means can), so that its last bit doesn't decide.
NUDGE = 1e-9


def rounded(df: DataFrame, digits: int = DIGITS, nudge: float = 0.0) -> DataFrame:
    """All doubles, also in arrays, to a number of places: sums differ in their last bits."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            c = F.round(c + F.lit(nudge), digits) + F.lit(0.0)
        elif kind == "array<double>":
            c = F.transform(c, lambda x: F.round(x + F.lit(nudge), digits) + F.lit(0.0))
        out.append(c.alias(name))
    return df.select(*out)


def word(words: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    one = lambda *c: F.array(*c).cast("array<string>")
    return read(spark, d, "supplier").select(
        k.cast("string").alias("target_id"),
        F.col("s_name").alias("target_name"),
        F.concat(word(ADJECTIVES, k), F.lit(" "), word(NOUNS, F.floor(k / 8))).alias("description"),
        F.when(k % 5 == 0, none).when(k % 3 == 0, one(word(ADJECTIVES, k), word(NOUNS, k))).otherwise(one(word(ADJECTIVES, k))).alias("genres"),
        F.when(k % 4 == 0, one(word(NOUNS, F.floor(k / 3)), F.lit("Hot Rod"))).otherwise(one(word(NOUNS, F.floor(k / 3)))).alias("subgenres"),
        F.when(k % 3 == 0, one(F.lit("Run"), F.lit("Any"))).otherwise(one(F.lit("Walk"))).alias("activity"),
        one(F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("countries"),
        F.when(k % 4 == 1, none).otherwise(one(F.when(k % 2 == 0, F.lit("EN")).otherwise(F.lit("fr")))).alias("languages"),
        none.alias("tempos"),
        F.when(k % 7 == 0, one(F.lit("ANY"))).otherwise(one(word(["Calm", "Bright", "Dark"], k))).alias("moods"),
        (k % 4 + 1).cast("int").alias("tier"),
    )


TARGETS_SQL = """
targets as (select cast(s_suppkey as varchar) target_id, s_name target_name,
  (['blue','cold','hot','large','new','old','red','small'])[s_suppkey % 8 + 1] adj,
  (['anvil','bolt','gear','gizmo','plate','ring','rod','widget'])[s_suppkey % 8 + 1] noun0,
  (['anvil','bolt','gear','gizmo','plate','ring','rod','widget'])[(s_suppkey // 8) % 8 + 1] noun1,
  (['anvil','bolt','gear','gizmo','plate','ring','rod','widget'])[(s_suppkey // 3) % 8 + 1] noun2,
  s_suppkey k, s_nationkey, cast(s_suppkey % 4 + 1 as integer) tier from supplier),
tagged as (select *,
  list_sort(list_distinct(case when k % 5 = 0 then []::varchar[] when k % 3 = 0 then [adj, noun0] else [adj] end)) primary_tags,
  list_sort(list_distinct(list_concat(list_concat(
    case when k % 5 = 0 then []::varchar[] when k % 3 = 0 then [adj, noun0] else [adj] end,
    case when k % 4 = 0 then [noun2, 'hot_rod'] else [noun2] end),
    list_filter(list_concat([adj, noun1], list_concat(case when k % 5 = 0 then []::varchar[] when k % 3 = 0 then [adj, noun0] else [adj] end, case when k % 4 = 0 then [noun2, 'hot', 'rod', 'hot_rod'] when adj = 'hot' and noun1 = 'rod' then [noun2, 'hot_rod'] else [noun2] end)),
      lambda x: not (x = 'rod' and (k % 4 = 0 or (adj = 'hot' and noun1 = 'rod'))))))) tags,
  list_sort(case when k % 3 = 0 then ['run'] else ['walk'] end) activities,
  ['n' || s_nationkey] countries,
  case when k % 4 = 1 then []::varchar[] when k % 2 = 0 then ['en'] else ['fr'] end languages,
  case when k % 7 = 0 then []::varchar[] else [(['calm','bright','dark'])[k % 3 + 1]] end moods
  from targets)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    vectors = read(spark, d, "embeddings")
    n = vectors.count()
    one = lambda c: F.array(c).cast("array<string>")
    parts = read(spark, d, "part").select(
        k.cast("string").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("album"),
        F.when(k % 7 != 0, F.col("p_size") * 2.0).alias("popularity"),
        F.when(k % 11 != 0, F.col("p_size").cast("double")).alias("bpm"),
        F.col("p_retailprice").alias("energy"),
        one(word(["calm", "bright", "dark"], k)).alias("item_moods"),
        one(F.when(k % 2 == 0, F.lit("en")).otherwise(F.lit("de"))).alias("item_languages"),
        F.when(k % 3 == 0, F.array(F.lit("run"), F.lit("walk"))).otherwise(F.array(F.lit("swim"))).alias("item_activities"),
        (k % n).alias("vec_id"),
    )
    return parts.join(vectors.select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")


ITEMS_SQL = """
items as (select cast(p_partkey as varchar) item_id, p_partkey k, p_name item_name, p_brand artist, p_type album,
  case when p_partkey % 7 <> 0 then p_size * 2.0 end popularity,
  case when p_partkey % 11 <> 0 then cast(p_size as double) end bpm, p_retailprice energy,
  [(['calm','bright','dark'])[p_partkey % 3 + 1]] item_moods,
  case when p_partkey % 2 = 0 then ['en'] else ['de'] end item_languages,
  case when p_partkey % 3 = 0 then ['run','walk'] else ['swim'] end item_activities,
  cast(embedding as double[]) emb,
  list_sort(list_filter(list_distinct(string_split(p_name, ' ') || case when p_name = 'hot rod' then ['hot_rod'] else []::varchar[] end || list_filter([lower(p_type)], lambda x: list_contains(['blue','cold','hot','large','new','old','red','small'], x))), lambda x: not (x = 'rod' and p_name = 'hot rod'))) item_tags
  from part left join embeddings on vec_id = p_partkey % (select count(*) from embeddings))"""


def history(spark: SparkSession, d: str) -> DataFrame:
    """All interactions with their label; null where the status is neither."""
    return read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("item_id"), F.col("l_suppkey").cast("string").alias("target_id"), rows.label("l_returnflag", POSITIVE, NEGATIVE).alias("label"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).where("label is not null")


HISTORY_SQL = """
history as (select cast(l_partkey as varchar) item_id, cast(l_suppkey as varchar) target_id,
  case l_returnflag when 'A' then 1 when 'R' then 0 end as label from lineitem),
labelled as (select * from history where label is not null)"""

CENTROID_SQL = """
dims as (select unnest(range(1, 65)) i),
accepted as (select target_id, items.* from labelled join items using (item_id) where label = 1),
means as (select target_id, i, avg(emb[i]) m from accepted, dims where emb is not null group by all),
mean_vectors as (select target_id, list(m order by i) v from means group by 1),
centroids as (select target_id, case when n > 1e-12 then list_transform(v, lambda x: x / n) else v end c from (select target_id, v, sqrt(list_dot_product(v, v)) n from mean_vectors))"""

def exact_mean_sql(column: str) -> str:
    return f"(cast(sum(cast({column} as decimal(18,6))) as double) / nullif(count({column}), 0))"


NUMERIC_SQL = f"""
numeric_stats as (select target_id, {exact_mean_sql('bpm')} c1, {exact_mean_sql('energy')} c2, stddev_pop(bpm) s1, stddev_pop(energy) s2, min(bpm) lo1, min(energy) lo2, max(bpm) hi1, max(energy) hi2,
  {exact_mean_sql('popularity')} pop_mean, stddev_pop(popularity) pop_std, count(popularity) pop_count from accepted group by 1),
counted as (select target_id, count(*) filter (where label = 1) accepted, count(*) filter (where label = 0) declined from labelled group by 1)"""
