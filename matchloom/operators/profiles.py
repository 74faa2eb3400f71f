"""Target profiles: what a target's accepted items say about it, one row a target.

All statistics are partial aggregates over interactions joined to items, once, so they combine before the
shuffle; repeated interactions count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import tags as tg
from matchloom.functions import vectors as vec
from matchloom.functions import vocab
from matchloom.functions.text import target_text

BLEND = 0.25
ATTRIBUTES = {"activities": "activity", "countries": "countries", "languages": "languages", "tempos": "tempos", "moods": "moods"}


def counts(interactions: DataFrame, key: str = "target_id") -> DataFrame:
    """accepted, declined, acceptance_rate of each target."""
    rows = interactions.groupBy(key).agg(F.count_if(F.col("label") == 1).alias("accepted"), F.count_if(F.col("label") == 0).alias("declined"))
    return rows.withColumn("acceptance_rate", F.coalesce(F.try_divide("accepted", F.col("accepted") + F.col("declined")), F.lit(0.0)))


def accepted_only(value: Column) -> Column:
    """The value in rows of accepted items; null, which aggregates leave out, in all others."""
    return F.when(F.col("label") == 1, value)


def exact_mean(value: Column) -> Column:
    """Mean of numbers taken to six places, summed as decimals: it doesn't depend on the order of the rows."""
    return F.try_divide(F.sum(value.cast("decimal(20,6)")).cast("double"), F.count(value))


def mean_vector(column: str, dim: int) -> Column:
    """Component-wise mean as an aggregate, without exploding the vectors."""
    means = F.array(*[F.avg(accepted_only(F.get(F.col(column), F.lit(i)).cast("double"))) for i in range(dim)])
    return F.when(F.count(accepted_only(F.col(column))) > 0, means)


def _numbers(columns: list[str]) -> list[Column]:
    each = lambda f: F.array(*[f(accepted_only(F.col(c))) for c in columns])
    some = F.count_if(F.col("label") == 1) > 0
    return [F.when(some, each(f)).alias(f"num_{name}") for name, f in (("centroid", exact_mean), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]


def _popularity() -> list[Column]:
    p = accepted_only(F.col("popularity"))
    return [exact_mean(p).alias("pop_mean"), F.stddev_pop(p).alias("pop_std"), F.count(p).alias("pop_count")]


def _joined(interactions: DataFrame, items: DataFrame, columns: list[str], key: str, item: str) -> DataFrame:
    return interactions.where("label = 1").select(key, item, "label").join(items.select(item, *columns), item)


def centroids(interactions: DataFrame, items: DataFrame, dim: int, key: str = "target_id", item: str = "item_id", vector: str = "embedding") -> DataFrame:
    """Mean vector of each target's accepted items, duplicates kept."""
    rows = _joined(interactions, items.where(F.col(vector).isNotNull()), [vector], key, item)
    return rows.groupBy(key).agg(mean_vector(vector, dim).alias("mean_vector"))


def blend(text: Column, mean: Column, weight: float = BLEND) -> Column:
    """Unit vector of ``weight`` text and the rest of the items' mean; the text's where there is no mean."""
    mixed = F.zip_with(vec.doubles(text), mean, lambda t, m: weight * t + (1 - weight) * m)
    return vec.unit(F.coalesce(F.when(text.isNull(), mean), F.when(mean.isNotNull(), mixed), vec.doubles(text)))


def numeric_statistics(interactions: DataFrame, items: DataFrame, columns: list[str], key: str = "target_id", item: str = "item_id") -> DataFrame:
    """num_centroid, num_std (population), num_min, num_max over accepted items, nulls left out."""
    return _joined(interactions, items, columns, key, item).groupBy(key).agg(*_numbers(columns))


def popularity(interactions: DataFrame, items: DataFrame, key: str = "target_id", item: str = "item_id") -> DataFrame:
    return _joined(interactions, items, ["popularity"], key, item).groupBy(key).agg(*_popularity())


def statistics(interactions: DataFrame, items: DataFrame, columns: list[str], dim: int, key: str = "target_id", item: str = "item_id", vector: str = "embedding") -> DataFrame:
    """All of the above, and the counts, from one join and one aggregation."""
    known = items.select(item, vector, "popularity", *[c for c in columns if c != "popularity"], F.lit(True).alias("__known"))
    rows = interactions.select(key, item, "label").join(known, item, "left")
    # Statistics of numbers need an item that is known; counts take all.
    rows = rows.withColumns({"__label": F.col("label"), "label": F.when(F.col("__known"), F.col("label"))})
    counted = [F.count_if(F.col("__label") == 1).alias("accepted"), F.count_if(F.col("__label") == 0).alias("declined")]
    found = rows.groupBy(key).agg(*counted, mean_vector(vector, dim).alias("mean_vector"), *_numbers(columns), *_popularity())
    return found.withColumn("acceptance_rate", F.coalesce(F.try_divide("accepted", F.col("accepted") + F.col("declined")), F.lit(0.0)))


def with_tags(targets: DataFrame, words: vocab.Vocabulary = vocab.MUSIC) -> DataFrame:
    """primary_tags from genres; tags from genres, subgenres and the target's whole text; attributes."""
    text = target_text(F.col("target_name"), F.col("description"), ["genres", "subgenres"], F.col("moods"), F.col("activity"))
    primary = tg.labels_tags("genres", words=words)
    every = F.array_sort(F.array_distinct(F.concat(tg.labels_tags("genres", "subgenres", words=words), tg.tag(text, words))))
    out = targets.withColumns({"target_text": text, "primary_tags": primary, "tags": every})
    return out.withColumns({name: tg.attributes(source) for name, source in ATTRIBUTES.items()})


def build(targets: DataFrame, interactions: DataFrame, items: DataFrame, columns: list[str], dim: int, words: vocab.Vocabulary = vocab.MUSIC, weight: float = BLEND) -> DataFrame:
    """The profile of every target; ``targets`` may carry ``text_embedding``, else centroids stand alone."""
    rows = with_tags(targets, words)
    if "text_embedding" not in rows.columns:
        rows = rows.withColumn("text_embedding", F.lit(None).cast("array<double>"))
    rows = rows.join(statistics(interactions, items, columns, dim), "target_id", "left")
    rows = rows.withColumn("centroid", blend(F.col("text_embedding"), F.col("mean_vector"), weight))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("accepted", "declined", "pop_count")} | {"acceptance_rate": F.coalesce("acceptance_rate", F.lit(0.0))}
    return rows.withColumns(zero).withColumns({"centroid_norm": vec.norm(F.col("centroid")), "text_norm": vec.norm(F.col("text_embedding"))}).drop("mean_vector")


def coverage(profiles: DataFrame) -> DataFrame:
    """How many profiles know numbers, tags, popularity, and each attribute."""
    some = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)
    return profiles.agg(F.count(F.lit(1)).alias("targets"), F.count("num_centroid").alias("with_numbers"), some("tags").alias("with_tags"), F.count_if(F.col("pop_count") > 0).alias("with_popularity"), *[some(a).alias(f"with_{a}") for a in ATTRIBUTES])
