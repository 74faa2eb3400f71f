"""Re-weighting of scores by rules, and ranking: multipliers are columns, a ranking is one window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import tags as tg
from matchloom.functions import vocab
from matchloom.operators.profiles import ATTRIBUTES


@dataclass(frozen=True)
class Penalties:
    """Multipliers, kept within [1e-6, 1], and the breadth from which a target counts as broad."""

    conflict: float = 0.05
    attribute: float = 0.7
    language: float = 0.3
    no_match: float = 0.02
    untagged: float = 0.3
    secondary: float = 0.4
    breadth: int = 4

    def __post_init__(self):
        for name in ("conflict", "attribute", "language", "no_match", "untagged", "secondary"):
            object.__setattr__(self, name, min(1.0, max(1e-6, float(getattr(self, name)))))
        object.__setattr__(self, "breadth", max(1, int(self.breadth)))


def conflict_multiplier(item: Column, target: Column, p: Penalties = Penalties(), words: vocab.Vocabulary = vocab.MUSIC) -> Column:
    return F.when(tg.conflict(item, target, words), F.lit(p.conflict)).otherwise(F.lit(1.0))


def explicit_class(asked: Column, primary: Column, every: Column, words: vocab.Vocabulary = vocab.MUSIC) -> Column:
    """untagged, primary, mixed (other primary tags conflict), secondary or none."""
    rest = F.array_except(primary, asked)
    return (
        F.when(every.isNull() | (F.size(every) == 0), "untagged")
        .when(F.arrays_overlap(asked, primary), F.when((F.size(rest) > 0) & tg.conflict(asked, rest, words), "mixed").otherwise("primary"))
        .when(F.arrays_overlap(asked, every), "secondary")
        .otherwise("none")
    )


def breadth(primary: Column, every: Column) -> Column:
    return F.when(F.size(primary) > 0, F.size(primary)).otherwise(F.size(every))


def class_multiplier(kind: Column, wide: Column, p) -> Column:
    """The multiplier of a class, with the square-root decay of broad targets. ``p`` has numbers or columns."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    base = F.when(kind == "untagged", lit(p.untagged)).when(kind == "primary", F.lit(1.0)).when(kind.isin("mixed", "secondary"), lit(p.secondary)).otherwise(lit(p.no_match))
    decay = F.when((kind != "untagged") & (wide > lit(p.breadth)), F.sqrt(lit(p.breadth) / wide)).otherwise(F.lit(1.0))
    return base * decay


def explicit_multiplier(asked: Column, primary: Column, every: Column, p: Penalties = Penalties(), words: vocab.Vocabulary = vocab.MUSIC) -> Column:
    return class_multiplier(explicit_class(asked, primary, every, words), breadth(primary, every), p)


def apart(a: str) -> Column:
    """Whether both sides know an attribute and share no value of it."""
    mine, theirs = F.col(f"item_{a}"), F.col(a)
    return (F.size(mine) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(mine, theirs)


def attribute_multiplier(p: Penalties = Penalties(), attributes=tuple(ATTRIBUTES)) -> Column:
    """Over columns item_<a> and <a>: a factor for each attribute that both sides know and don't share."""
    out = F.lit(1.0)
    for a in attributes:
        out = out * F.when(F.coalesce(apart(a), F.lit(False)), F.lit(p.language if a == "languages" else p.attribute)).otherwise(F.lit(1.0))
    return out


def item_masks(rows: DataFrame, words: vocab.Vocabulary = vocab.MUSIC) -> DataFrame:
    """Masks of item_tags and asked_tags, to be made before pairs are."""
    return rows.withColumns({"item_mask": tg.mask(F.col("item_tags"), words), "asked_mask": tg.mask(F.col("asked_tags"), words)})


def target_masks(rows: DataFrame, words: vocab.Vocabulary = vocab.MUSIC) -> DataFrame:
    """Masks of tags and primary_tags, and the breadth, to be made before pairs are."""
    return rows.withColumns({"target_mask": tg.mask(F.col("tags"), words), "primary_mask": tg.mask(F.col("primary_tags"), words), "breadth": breadth(F.col("primary_tags"), F.col("tags"))})


def masked_rules(p: Penalties, words: vocab.Vocabulary, hard_filter: bool) -> Column:
    """The explicit rule where tags are asked for, else the conflict filter, over masks."""
    asked, primary, every = F.col("asked_mask"), F.col("primary_mask"), F.col("target_mask")
    rest = primary.bitwiseAND(F.bitwise_not(asked))
    kind = (
        F.when(every == 0, "untagged")
        .when(tg.masks_meet(asked, primary), F.when(tg.masks_conflict(asked, rest, words), "mixed").otherwise("primary"))
        .when(tg.masks_meet(asked, every), "secondary")
        .otherwise("none")
    )
    hard = F.when(tg.masks_conflict(F.col("item_mask"), every, words), F.lit(p.conflict)).otherwise(F.lit(1.0)) if hard_filter else F.lit(1.0)
    return F.when(asked != 0, class_multiplier(kind, F.col("breadth"), p)).otherwise(hard)


def reweigh(scored: DataFrame, p: Penalties = Penalties(), words: vocab.Vocabulary = vocab.MUSIC, hard_filter: bool = True) -> DataFrame:
    """score times the multipliers. A row that asks for tags (asked_tags) takes the explicit rule, all
    others the conflict filter; attributes come on top. Rows with masks are judged by those."""
    if {"item_mask", "asked_mask", "target_mask", "primary_mask", "breadth"} <= set(scored.columns):
        return scored.withColumn("score", F.col("score") * masked_rules(p, words, hard_filter) * attribute_multiplier(p))
    explicit = explicit_multiplier(F.col("asked_tags"), F.col("primary_tags"), F.col("tags"), p, words)
    hard = conflict_multiplier(F.col("item_tags"), F.col("tags"), p, words) if hard_filter else F.lit(1.0)
    rule = F.when(F.size("asked_tags") > 0, explicit).otherwise(hard)
    return scored.withColumn("score", F.col("score") * rule * attribute_multiplier(p))


def top(scored: DataFrame, n: int, score: str = "score", group: str = "item_id", key: str = "target_id", digits: int | None = None) -> DataFrame:
    """The n best of each group with rank 1..n; ties by key. Only n rows a task reach the shuffle."""
    by = F.round(score, digits) if digits is not None else F.col(score)
    place = F.row_number().over(Window.partitionBy(group).orderBy(by.desc(), F.col(key)))
    return scored.withColumn("rank", place).where(F.col("rank") <= n)


def recommend(requests: DataFrame, profiles: DataFrame, score, n: int = 5, p: Penalties = Penalties(), words: vocab.Vocabulary = vocab.MUSIC, hard_filter: bool = True) -> DataFrame:
    """The n best targets for each request. ``requests`` are prepared items with asked_tags and, if
    wanted, tier; ``score`` makes the column score from the pairs. Without a candidate: no row."""
    from matchloom.operators.pairs import cross

    if len(words.tags) <= 63:
        requests, profiles = item_masks(requests, words), target_masks(profiles, words)
    pairs = cross(requests.withColumnRenamed("tier", "asked_tier") if "tier" in requests.columns else requests, profiles)
    if "tier" in requests.columns:
        pairs = pairs.where(F.col("asked_tier").isNull() | (F.col("tier") == F.col("asked_tier")))
    return top(reweigh(score(pairs), p, words, hard_filter), n).select("item_id", "rank", "target_id", "target_name", "score")
