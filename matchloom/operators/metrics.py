"""Offline evaluation: ranking at k, calibration, slices, lift, curve areas, tag relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import tags as tg
from matchloom.functions import vocab
from matchloom.operators.ordered import medians, running
from matchloom.workspace import keep

KS = (1, 3, 5, 10)
#: The edges of ten calibration bins as a linear space has them in doubles.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def ideal(k: Column) -> Column:
    """Discounted gain of k hits in the first k places."""
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), lambda r: 1 / F.log2(r + 1.0)), F.lit(0.0), lambda a, x: a + x)


def group_metrics(rows: DataFrame, group: list[str], key: str = "target_id", score: str = "score", label: str = "label", ks=KS) -> DataFrame:
    """Metrics of each group that has a positive; ranked by score, ties by key; precision divides by k."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(key)))
    hit = F.col(label) == 1
    ranked = rows.select(*group, key, score, label).withColumn("r", place)
    gain = F.when(hit, 1 / F.log2(F.col("r") + 1.0)).otherwise(0.0)
    sums = [F.count_if(hit).alias("positives"), F.min(F.when(hit, F.col("r"))).alias("first")]
    for k in ks:
        sums += [F.count_if(hit & (F.col("r") <= k)).alias(f"hits{k}"), F.sum(F.when(F.col("r") <= k, gain).otherwise(0.0)).alias(f"gain{k}")]
    per = ranked.groupBy(*group).agg(*sums).where("positives > 0")
    out = [*group, (1.0 / F.col("first")).alias("mrr")]
    for k in ks:
        out += [
            F.when(F.col(f"hits{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_at_{k}"),
            (F.col(f"hits{k}") / k).alias(f"precision_at_{k}"),
            (F.col(f"hits{k}") / F.col("positives")).alias(f"recall_at_{k}"),
            (F.col(f"gain{k}") / ideal(F.least(F.lit(k), F.col("positives")))).alias(f"ndcg_at_{k}"),
        ]
    return per.select(*out)


def names(ks=KS) -> list[str]:
    return ["mrr", *[f"{m}_at_{k}" for k in ks for m in ("hit", "precision", "recall", "ndcg")]]


def ranking(rows: DataFrame, group: str = "item_id", by: list[str] | None = None, ks=KS, **columns) -> DataFrame:
    """Unweighted means over the groups that have a positive, and their number; by slices if given."""
    by = by or []
    per = group_metrics(rows, [*by, group], ks=ks, **columns)
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), *[F.avg(m).alias(m) for m in names(ks)])


def slices(rows: DataFrame, dims: list[str], group: str = "item_id", ks=KS) -> DataFrame:
    """Ranking metrics for each value of several dimensions, in one pass; null is ``unknown``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dims]))
    flat = rows.withColumn("__s", pairs).select(group, "target_id", "score", "label", F.col("__s.dim").alias("slice_dim"), F.col("__s.value").alias("slice_value"))
    return ranking(flat, group, by=["slice_dim", "slice_value"], ks=ks)


def median_split(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``high`` from the exact median on, else ``low``; null stays null."""
    median = F.lit(medians(rows, [column])[column]).cast("double")
    return rows.withColumn(out, F.when(F.col(column) >= median, "high").when(F.col(column).isNotNull(), "low"))


def bins(rows: DataFrame, score: str = "score", label: str = "label", edges=EDGES) -> DataFrame:
    """bin, n, mean_score, mean_label for every bin [lo, hi), the last one closed."""
    n = len(edges) - 1
    which = F.lit(n - 1)
    for i in reversed(range(n - 1)):
        which = F.when(F.col(score) < edges[i + 1], i).otherwise(which)
    found = rows.select(which.alias("bin"), F.col(score).alias("s"), F.col(label).alias("l")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_score"), F.avg("l").alias("mean_label"))
    every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    zero = F.lit(0.0)
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_score", zero).alias("mean_score"), F.coalesce("mean_label", zero).alias("mean_label"))


def calibration_error(rows: DataFrame, **columns) -> DataFrame:
    """Expected calibration error over the bins, weighted by their rows."""
    b = bins(rows, **columns)
    return b.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_label") - F.col("mean_score"))), F.sum("n")), F.lit(0.0)).alias("ece"), F.sum("n").alias("n"))


def lift(rows: DataFrame, key: str = "target_id", score: str = "score", label: str = "label") -> DataFrame:
    """Observed and predicted means of each target, and predicted by observed (null if none)."""
    per = rows.groupBy(key).agg(F.avg(label).alias("observed"), F.avg(score).alias("predicted"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("lift", F.when(F.col("observed") > 0, F.col("predicted") / F.col("observed")))


def curve(rows: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Average precision (step-wise, ties as one threshold) and area under the ROC curve, of each group if given.

    Rows collapse to one for each distinct score first; their running sums are over ranges of scores.
    """
    by = by or []
    per = rows.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    run = keep(running(per, [*[F.col(c) for c in by], F.col("s").desc_nulls_last()], {"tp": F.col("p"), "seen": F.col("n")}), "running")
    # What was counted before a group's first row isn't its own.
    every = run.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"), F.min(F.col("tp") - F.col("p")).alias("tp0"), F.min(F.col("seen") - F.col("n")).alias("seen0"))
    found = run.join(F.broadcast(every), by) if by else run.crossJoin(F.broadcast(every))
    tp, seen, p, n = F.col("tp") - F.col("tp0"), F.col("seen") - F.col("seen0"), F.col("p"), F.col("n")
    # Negatives below a threshold's rows, and half of those that share its score. Their products with
    # counts are whole or half numbers: the sum doesn't depend on the order of the rows.
    won = p * (F.col("negatives") - (seen - tp) + (n - p) / 2)
    areas = [F.sum(F.try_divide(p, F.col("positives")) * tp / seen).alias("auc_pr"), F.try_divide(F.sum(won), F.max("positives") * F.max("negatives")).alias("auc_roc")]
    return found.groupBy(*by).agg(*areas) if by else found.agg(*areas)


def tag_relevance(ranked: DataFrame, k: int, words: vocab.Vocabulary = vocab.MUSIC) -> DataFrame:
    """Of each item's first k targets (rank, item_tags, tags, primary_tags): shares, by k, with a tag, with a
    primary tag, and in conflict; means over items that have tags."""
    a, every, primary = F.col("item_tags"), F.col("tags"), F.col("primary_tags")
    per = ranked.where((F.col("rank") <= k) & (F.size("item_tags") > 0)).groupBy("item_id").agg(
        (F.count_if(F.arrays_overlap(a, every)) / k).alias("any"),
        (F.count_if(F.arrays_overlap(a, primary)) / k).alias("primary"),
        (F.count_if(tg.conflict(a, every, words)) / k).alias("conflict"),
    )
    return per.agg(F.count(F.lit(1)).alias("n_items"), F.avg("any").alias(f"tag_precision_at_{k}"), F.avg("primary").alias(f"primary_tag_precision_at_{k}"), F.avg("conflict").alias(f"conflict_rate_at_{k}"))


def overtagging(profiles: DataFrame, thresholds=(4, 6, 8)) -> DataFrame:
    """Share of targets, in percent, whose breadth is above each threshold."""
    from matchloom.operators.rerank import breadth

    wide = breadth(F.col("primary_tags"), F.col("tags"))
    one = profiles.agg(F.count(F.lit(1)).alias("targets"), *[F.count_if(wide > t).alias(f"n{t}") for t in thresholds])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{t}").alias("n_broad")) for t in thresholds]))
    return one.select("targets", rows.alias("r")).select("r.threshold", "targets", "r.n_broad", F.coalesce(F.try_divide(F.col("r.n_broad") * 100.0, F.col("targets")), F.lit(0.0)).alias("percent"))


def standard_slices(rows: DataFrame, profiles: DataFrame, ks=KS) -> DataFrame:
    """Ranking metrics by four slices in one pass: numbers known of the item; its popularity (split at the
    median of the rows that know it); accepted items of the target (split at the median of all profiles);
    the target's first primary tag. ``rows`` carry the features of their pairs."""
    known = F.when(F.col("popularity_available") >= 1, F.col("item_popularity_norm"))
    marked = median_split(rows.withColumn("__known", known), "__known", "__half")
    side = median_split(profiles.select("target_id", "accepted", "primary_tags"), "accepted", "__half")
    first = F.coalesce(F.try_element_at(F.array_sort("primary_tags"), F.lit(1)), F.lit("untagged"))
    side = side.select("target_id", F.when(F.col("__half") == "high", "many_accepted").otherwise("few_accepted").alias("target_size"), first.alias("primary_tag"))
    marked = marked.join(side, "target_id", "left").withColumns({
        "audio": F.when(F.col("item_audio_available") >= 1, "with_audio").otherwise("without_audio"),
        "popularity": F.when(F.col("__half").isNull(), "unknown_popularity").otherwise(F.concat("__half", F.lit("_popularity"))),
        "target_size": F.coalesce("target_size", F.lit("few_accepted")),
        "primary_tag": F.coalesce("primary_tag", F.lit("untagged")),
    })
    return slices(marked, ["audio", "popularity", "target_size", "primary_tag"], ks=ks)


def at_k(names_: list[str], prefix: str) -> dict[int, str]:
    """The columns ``prefix_at_k`` by k."""
    import re

    found = {n: re.fullmatch(rf"{re.escape(prefix)}_at_(\d+)", n) for n in names_}
    return {int(m[1]): n for n, m in found.items() if m}


def metric_curve(metrics_row: DataFrame, prefix: str) -> DataFrame:
    """(k, value) of a one-row metrics table, as a plot wants it."""
    pairs = [F.struct(F.lit(k).alias("k"), F.col(n).alias("value")) for k, n in sorted(at_k(metrics_row.columns, prefix).items())]
    return metrics_row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("value is not null")
