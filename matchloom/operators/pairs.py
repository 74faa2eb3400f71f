"""Pairs of items and targets, and their features as plain column expressions.

Everything about one side (tags, norms, arrays) is computed on that side before the pairs are made. The catalogue
side is broadcast only when its counted size allows; else both sides are cut into blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions import tags as tg
from matchloom.functions import vectors as vec
from matchloom.functions import vocab
from matchloom.functions.text import normalize
from matchloom.operators.profiles import ATTRIBUTES
from matchloom.workspace import keep

#: Rows and bytes of the catalogue that may be broadcast, and of a block else.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 128 << 20
#: Bytes of a table of classes that may be broadcast.
CLASS_BYTES = 32 << 20
POP_STD_FLOOR = 5.0
MODEL_FEATURES = (
    "semantic_similarity title_text_similarity semantic_l2_distance title_semantic_diff audio_centroid_cosine audio_centroid_l2 audio_zscore_mean audio_zscore_max bpm_diff energy_diff danceability_diff audio_range_ratio "
    "item_audio_available target_audio_available genre_jaccard genre_overlap_count genre_conflict_flag genre_precision_primary genre_precision_all "
    "item_popularity_norm popularity_diff_norm popularity_zscore popularity_available genre_semantic_interaction audio_genre_interaction target_size_log target_genre_richness "
    "target_n_soft_attrs target_has_language target_has_mood mood_match_flag language_match_flag activity_match_flag soft_attr_available"
).split()
CARRIED = ["item_tag_count", "target_tag_count", "acceptance_rate", "accepted", "declined"]


def prepare_items(items: DataFrame, columns: list[str], words: vocab.Vocabulary = vocab.MUSIC) -> DataFrame:
    """item_tags (given, else from artist, name and album), numbers as an array, vector length."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("artist", "item_name", "album") if c in items.columns])
    tagged = tg.tag(text, words)
    if "item_tags" in items.columns:
        tagged = F.when(F.size("item_tags") > 0, F.col("item_tags")).otherwise(tagged)
    numbers = F.array(*[F.col(c).cast("double") for c in columns]) if columns else F.array().cast("array<double>")
    known = F.size(vec.present(numbers)) > 0
    out = items.withColumns({"item_tags": tagged, "numbers": F.when(known, numbers), "item_norm": vec.norm(F.col("embedding"))})
    return out.withColumns({f"item_{a}": tg.attributes(f"item_{a}") if f"item_{a}" in items.columns else F.array().cast("array<string>") for a in ATTRIBUTES})


def size_of(rows: DataFrame) -> tuple[int, int]:
    """Rows, and bytes that they take as text; vectors, which are most of a profile, by their numbers."""
    wide = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType))]
    numbers = [F.coalesce(F.size(f"`{c}`"), F.lit(0)) * 8 for c in wide]
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in wide]
    each = sum(numbers, F.length(F.to_json(F.struct(*rest))) if rest else F.lit(0))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()
    return int(n), int(size)


def cross(items: DataFrame, targets: DataFrame, key: str = "target_id") -> DataFrame:
    """Every item with every target: the full catalogue is the feature.

    The catalogue is broadcast when its counted rows and bytes allow. Beyond, both sides are dealt: targets by
    ``key`` into blocks of BROADCAST_ROWS or BROADCAST_BYTES, items into slices, and each block meets each slice in a
    task of its own, so tasks are many however few blocks there are, and none holds more than a block.
    """
    spark = items.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    targets = keep(targets, "catalogue")  # read twice: to be measured, and to be met
    n, size = size_of(targets)
    blocks = max(-(-n // BROADCAST_ROWS), -(-size // BROADCAST_BYTES), 1)
    if blocks == 1:
        # Dealt by item over all cores: a small table would be one task, and rankings by item then need
        # no shuffle of the pairs.
        return (items.repartition(slices, "item_id") if "item_id" in items.columns else items).crossJoin(F.broadcast(targets))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = targets.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("__slice", every(slices))
    cut = items.withColumn("__slice", F.pmod(F.xxhash64(*items.columns[:1]), F.lit(slices)).cast("int")).withColumn("__block", every(blocks))
    return cut.join(dealt.hint("shuffle_hash"), ["__block", "__slice"]).drop("__block", "__slice")


def classed(rows: DataFrame, columns: list[str], out: str = "class") -> tuple[DataFrame, DataFrame]:
    """The distinct values of some columns, numbered, with the rows that have them (n); and ``rows`` with the number
    in place of the columns. What holds for a pair by those columns alone is found once for each pair of classes."""
    found = keep(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn(out, F.monotonically_increasing_id()), "classes")
    named = found.select(out, *[F.col(c).alias(f"__of_{c}") for c in columns])
    if size_of(found)[1] <= CLASS_BYTES:
        named = F.broadcast(named)
    agree = F.lit(True)
    for c in columns:
        agree = agree & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return found, rows.join(named, agree).drop(*columns, *[f"__of_{c}" for c in columns])


def cross_similar(items: DataFrame, targets: DataFrame, dim: int, key: str = "target_id", vectors: tuple[str, str] = ("embedding", "centroid"), norms: tuple[str, str] = ("item_norm", "centroid_norm"), out: str = "semantic_similarity") -> DataFrame:
    """``cross`` with the cosine of the sides' vectors, which are left out; 0 where a side has none."""
    a, b = (rows.withColumns(vec.components(f"__{s}", F.col(v), dim)).drop(v) for rows, s, v in zip((items, targets), "ab", vectors, strict=True))
    cosine = vec.cosine_of_norms(vec.dot_of_components("__a", "__b", dim), F.col(norms[0]), F.col(norms[1]))
    rows = cross(a, b, key)
    return rows.select(*[c for c in rows.columns if not c.startswith(("__a", "__b"))], cosine.alias(out))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def semantic() -> dict[str, Column]:
    emb, centre, text = F.col("embedding"), F.col("centroid"), F.col("text_embedding")
    return {
        "semantic_similarity": vec.cosine_of_norms(vec.dot(emb, centre), F.col("item_norm"), F.col("centroid_norm")),
        "title_text_similarity": vec.cosine_of_norms(vec.dot(emb, text), F.col("item_norm"), F.col("text_norm")),
        "semantic_l2_distance": vec.distance(emb, centre),
    }


def numeric(columns: list[str]) -> dict[str, Column]:
    """Measures over the components that all sides have, 0 without any. The columns are few, so each is an expression of
    its own: loops over arrays took most of a pair's time."""
    v, c, s, lo, hi = ([F.get(vec.doubles(F.col(x)), F.lit(i)) for i in range(len(columns))] for x in ("numbers", "num_centroid", "num_std", "num_min", "num_max"))
    total = lambda values: sum((_or_zero(x) for x in values), F.lit(0.0))
    mean = lambda values: _or_zero(F.try_divide(total(values), sum((x.isNotNull().cast("int") for x in values), F.lit(0))))
    both = lambda f: [F.when(x.isNotNull() & y.isNotNull(), f(x, y)) for x, y in zip(v, c, strict=True)]
    z = [F.abs(x - y) / (d + vec.STD_OFFSET) for x, y, d in zip(v, c, s, strict=True)]
    inside = [F.when(x.between(a, b), 1.0).when(x.isNotNull() & a.isNotNull() & b.isNotNull(), 0.0) for x, a, b in zip(v, lo, hi, strict=True)]
    length = lambda f: F.sqrt(total(both(f)))
    one = lambda name: _or_zero(z[columns.index(name)]) if name in columns else F.lit(0.0)
    most = F.greatest(F.lit(0.0), F.lit(0.0), *[_or_zero(x) for x in z])  # of absolute values
    return {
        "audio_centroid_cosine": vec.cosine_of_norms(total(both(lambda x, y: x * y)), length(lambda x, y: x * x), length(lambda x, y: y * y)),
        "audio_centroid_l2": F.sqrt(mean(both(lambda x, y: (x - y) * (x - y)))),
        "audio_zscore_mean": mean(z),
        "audio_zscore_max": most,
        "bpm_diff": one("bpm"),
        "energy_diff": one("energy"),
        "danceability_diff": one("danceability"),
        "audio_range_ratio": mean(inside),
        "item_audio_available": F.col("numbers").isNotNull().cast("int"),
        "target_audio_available": F.col("num_centroid").isNotNull().cast("int"),
    }


def tagged(words: vocab.Vocabulary = vocab.MUSIC) -> dict[str, Column]:
    a, every, primary = F.col("item_tags"), F.col("tags"), F.col("primary_tags")
    share = lambda side: F.coalesce(F.try_divide(tg.overlap(a, side), F.size(side)), F.lit(0.0))
    return {
        "genre_jaccard": tg.jaccard(a, every),
        "genre_overlap_count": tg.overlap(a, every),
        "genre_conflict_flag": tg.conflict(a, every, words).cast("int"),
        "genre_precision_primary": F.when(F.size(primary) > 0, share(primary)).otherwise(share(every)),
        "genre_precision_all": share(every),
        "item_tag_count": F.size(a),
        "target_tag_count": F.size(every),
    }


def popular() -> dict[str, Column]:
    p, mean, std = F.col("popularity").cast("double"), F.col("pop_mean"), F.col("pop_std")
    both = p.isNotNull() & mean.isNotNull()
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return {
        "item_popularity_norm": F.when(p.isNotNull(), unit(p / 100)).otherwise(0.0),
        "popularity_diff_norm": F.when(both, unit(F.abs(p - mean) / 100)).otherwise(0.0),
        "popularity_zscore": F.when(both, F.abs(p - mean) / F.greatest(F.coalesce(std, F.lit(0.0)), F.lit(POP_STD_FLOOR))).otherwise(0.0),
        "popularity_available": both.cast("int"),
    }


def structural() -> dict[str, Column]:
    filled = [F.when(F.size(a) > 0, 1).otherwise(0) for a in ATTRIBUTES]
    total = filled[0]
    for f in filled[1:]:
        total = total + f
    return {
        "target_size_log": F.log1p(F.col("accepted").cast("double")),
        "target_genre_richness": F.log1p(F.size("tags").cast("double")),
        "target_n_soft_attrs": total,
        "target_has_language": (F.size("languages") > 0).cast("int"),
        "target_has_mood": (F.size("moods") > 0).cast("int"),
    }


def soft() -> dict[str, Column]:
    side = lambda a: (F.col(f"item_{a}"), F.col(a))
    both = lambda a: (F.size(side(a)[0]) > 0) & (F.size(side(a)[1]) > 0)
    any_ = lambda a: (both(a) & F.arrays_overlap(*side(a))).cast("int")
    return {
        "mood_match_flag": any_("moods"),
        "language_match_flag": any_("languages"),
        "activity_match_flag": tg.jaccard(*side("activities")),
        "soft_attr_available": (both("moods") | both("languages") | both("activities")).cast("int"),
    }


def features(pairs: DataFrame, columns: list[str], words: vocab.Vocabulary = vocab.MUSIC) -> DataFrame:
    """``pairs`` (item and profile columns side by side) with all features, in fixed order."""
    first = semantic() | numeric(columns) | tagged(words) | popular() | structural() | soft()
    out = pairs.withColumns(first)
    return out.withColumns({
        "title_semantic_diff": F.abs(F.col("semantic_similarity") - F.col("title_text_similarity")),
        "genre_semantic_interaction": F.col("genre_jaccard") * F.col("semantic_similarity"),
        "audio_genre_interaction": F.col("audio_centroid_cosine") * F.col("genre_overlap_count"),
    })


def small_enough(profiles: DataFrame) -> DataFrame:
    """A kept table of profiles, marked for broadcast if its counted bytes allow: pairs then don't travel with an
    item's vector to the target's profile."""
    return F.broadcast(profiles) if size_of(profiles)[1] <= BROADCAST_BYTES else profiles


def featurize(pairs: DataFrame, items: DataFrame, profiles: DataFrame, columns: list[str], words: vocab.Vocabulary = vocab.MUSIC) -> DataFrame:
    """(item_id, target_id, ...) with features; an unknown target or item has zeros."""
    shown = ["target_name", "description", "genres", "subgenres", "activity", "target_text"]
    full = pairs.join(items, "item_id", "left").join(profiles.drop(*shown), "target_id", "left")
    lists = ["item_tags", "tags", "primary_tags", *ATTRIBUTES, *[f"item_{a}" for a in ATTRIBUTES]]
    full = full.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists} | {c: F.coalesce(c, F.lit(0)) for c in ("accepted", "declined")} | {"acceptance_rate": F.coalesce("acceptance_rate", F.lit(0.0))})
    return features(full, columns, words).select(*pairs.columns, *MODEL_FEATURES, *CARRIED[:3], "accepted", "declined")
