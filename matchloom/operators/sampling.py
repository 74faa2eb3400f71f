"""Grouped splits and negative samples, decided by portable hashes instead of random numbers.

A hash of (seed, ids) orders candidates, so samples agree between reruns and partitionings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import vectors as vec
from matchloom.operators import nearest
from matchloom.operators.ordered import numbered
from matchloom.operators.pairs import cross
from matchloom.workspace import keep


@dataclass(frozen=True)
class Negatives:
    """How many negatives a positive has, and which shares are conflicting and near misses."""

    ratio: float = 5.0
    conflict: float = 0.5
    near_miss: float = 0.33
    stratified: bool = True
    neighbours: int = 20

    def __post_init__(self):
        clip = lambda x: min(1.0, max(0.0, float(x)))
        object.__setattr__(self, "ratio", max(0.0, float(self.ratio)))
        object.__setattr__(self, "conflict", clip(self.conflict))
        object.__setattr__(self, "near_miss", min(clip(self.near_miss), 1.0 - self.conflict))
        object.__setattr__(self, "neighbours", max(1, int(self.neighbours)))

    @classmethod
    def plain(cls, ratio: float, conflict: float = 0.5) -> Negatives:
        """Conflicting and random negatives only, not stratified."""
        return cls(ratio, conflict, 0.0, False)


def order_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def group_split(rows: DataFrame, group: str = "item_id", share: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with is_test: all rows of a share of the groups. Order is by hash, cut at ceil(share n)."""
    groups = rows.select(group).distinct().withColumn("h", order_key(seed, group))
    n = groups.count()
    cut = -int(-share * n // 1)
    last = numbered(groups, [F.col("h"), F.col(group)]).where(F.col("place") == cut).first() if cut > 0 else None
    return rows.withColumn("is_test", F.lit(False) if last is None else order_key(seed, group) <= last["h"])


def neighbours(vectors: DataFrame, k: int, key: str = "target_id", vector: str = "centroid", digits: int = 6, dim: int | None = None) -> DataFrame:
    """(key, neighbour, similarity, rank): the k most similar others, ties by key. All pairs are compared: with ``dim``
    as products of matrices, else as ``cross`` deals them."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("similarity").desc(), "neighbour"))
    if dim:
        unit = keep(vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, nearest.unit_of(F.col(vector), dim).alias("unit")), "units")
        found = nearest.best(unit, unit.withColumnRenamed(key, "neighbour"), k, dim, key, "neighbour", digits, differ=True)
        return found.withColumnRenamed("score", "similarity").withColumn("rank", place).where(F.col("rank") <= k)
    unit = vectors.where(F.col(vector).isNotNull()).select(F.col(key), vec.unit(F.col(vector)).alias("u"))
    other = unit.select(F.col(key).alias("neighbour"), F.col("u").alias("w"))
    pairs = cross(unit, other, "neighbour").withColumn("similarity", vec.dot(F.col("u"), F.col("w")))
    pairs = pairs.where(F.col(key) != F.col("neighbour")).select(key, "neighbour", F.round("similarity", digits).alias("similarity"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k)


def _quota(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """The first n candidate pairs by hash."""
    rows = candidates.withColumn("h", order_key(seed, "item_id", "target_id"))
    return numbered(rows, [F.col("h"), F.col("item_id"), F.col("target_id")]).where(F.col("place") <= n).drop("h", "place")


def _probes(anchors: DataFrame, pool: DataFrame, tries: int, seed: int) -> DataFrame:
    """Up to ``tries`` hashed targets for each anchor row, evenly over the pool's buckets.

    ``pool`` numbers the targets of a bucket: no item is paired with the whole catalogue.
    """
    buckets = pool.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    listed = buckets.agg(F.sort_array(F.collect_list(F.struct("bucket", "size"))).alias("buckets"))
    each = anchors.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).crossJoin(F.broadcast(listed))
    each = each.withColumn("b", F.element_at("buckets", (F.col("j") % F.size("buckets") + 1).cast("int")))
    number = F.conv(F.substring(order_key(seed, "item_id", "anchor", "j"), 1, 8), 16, 10).cast("long")
    each = each.select("item_id", "side", F.col("b.bucket").alias("bucket"), (number % F.col("b.size")).alias("n"))
    return each.join(pool, ["bucket", "n"])


def draw(interactions: DataFrame, targets: DataFrame, item_tags: DataFrame, near: DataFrame, config: Negatives = Negatives(), seed: int = 42) -> DataFrame:
    """(item_id, target_id, kind): negatives for the positives of ``interactions``, never a pair that was pitched.

    conflict: the target's tags are disjoint from the anchor's (the accepted target's, else the item's); near: a
    neighbour (``near``: target_id, neighbour) of an accepted target; random: all others, evenly over tiers when
    stratified. What a kind lacks is drawn at random.

    Every positive probes some hashed targets; only when probes don't fill the quota, so that it is a
    good part of all pairs, are the pairs listed. ``targets`` has target_id, tags, tier.
    """
    positives = interactions.where("label = 1").select("item_id", F.col("target_id").alias("anchor"))
    total = int(round(positives.count() * config.ratio))
    pitched = interactions.select("item_id", "target_id").distinct()
    empty = F.array().cast("array<string>")
    tagged = targets.select(F.col("target_id").alias("anchor"), F.col("tags").alias("anchor_tags"))
    anchors = positives.distinct().join(tagged, "anchor", "left").join(item_tags.select("item_id", "item_tags"), "item_id", "left")
    anchors = keep(anchors.select("item_id", "anchor", F.when(F.size("anchor_tags") > 0, F.col("anchor_tags")).otherwise(F.coalesce("item_tags", empty)).alias("side")), "anchors")
    pool = targets.select("target_id", F.coalesce("tags", empty).alias("target_tags"), F.coalesce("tier", F.lit(0)).alias("tier"))
    pool = keep(pool, "pool")
    tries = max(8, 4 * int(config.ratio + 1))

    def in_buckets(bucket) -> DataFrame:
        """The pool numbered from 0 within each bucket; the buckets are few (tiers)."""
        rows = keep(numbered(pool.withColumn("bucket", bucket), [F.col("bucket"), F.col("target_id")]), "numbered")
        first = rows.groupBy("bucket").agg(F.min("place").alias("first"))
        return rows.join(F.broadcast(first), "bucket").withColumn("n", (F.col("place") - F.col("first")).cast("long")).drop("place", "first")

    def listed() -> DataFrame:
        return cross(anchors, pool)

    def chosen(rows: DataFrame, allowed, quota: int, salt: int, kind: str, taken: DataFrame) -> DataFrame:
        if quota <= 0:
            return anchors.limit(0).select("item_id", F.lit("").alias("target_id"), F.lit(kind).alias("kind"))
        good = rows.where(allowed).select("item_id", "target_id").distinct().join(pitched, ["item_id", "target_id"], "left_anti").join(taken, ["item_id", "target_id"], "left_anti")
        return keep(_quota(good, quota, salt).withColumn("kind", F.lit(kind)), kind)

    apart = (F.size("side") > 0) & (F.size("target_tags") > 0) & ~F.arrays_overlap("side", "target_tags")
    nothing = pitched.limit(0)
    quota = int(round(total * config.conflict))
    conflict = chosen(_probes(anchors, in_buckets(F.lit(0)), tries, seed), apart, quota, seed, "conflict", nothing)
    if conflict.count() < quota:
        conflict = chosen(listed(), apart, quota, seed, "conflict", nothing)
    used = conflict.select("item_id", "target_id")
    close = positives.join(near.select(F.col("target_id").alias("anchor"), F.col("neighbour").alias("target_id")), "anchor")
    close = chosen(close, F.lit(True), int(round(total * config.near_miss)), seed + 1, "near", used)
    used = used.union(close.select("item_id", "target_id"))
    left = total - conflict.count() - close.count()
    bucket = F.col("tier") if config.stratified else F.lit(0)
    other = chosen(_probes(anchors, in_buckets(bucket), tries, seed + 2), F.lit(True), left, seed + 2, "random", used)
    missing = left - other.count()
    if missing > 0:
        used = used.union(other.select("item_id", "target_id"))
        other = other.unionByName(chosen(listed(), F.lit(True), missing, seed + 3, "random", used))
    return conflict.unionByName(close).unionByName(other)
