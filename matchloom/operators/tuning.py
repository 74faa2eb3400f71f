"""Grid search over re-ranking penalties: classes of pairs first, combinations after."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import vocab
from matchloom.operators.metrics import names
from matchloom.operators.pairs import classed
from matchloom.operators.profiles import ATTRIBUTES
from matchloom.operators.rerank import apart, breadth, class_multiplier, explicit_class
from matchloom.workspace import keep

#: Cells of a matrix of pairs and combinations.
CELLS = 1_000_000

#: The penalties to combine, all and a quick choice.
GRID = {
    "no_match": [0.01, 0.02, 0.05, 0.1, 0.15],
    "untagged": [0.1, 0.2, 0.3, 0.4, 0.5],
    "secondary": [0.2, 0.3, 0.4, 0.5, 0.6, 0.7],
    "attribute": [0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
    "language": [0.1, 0.2, 0.3, 0.4, 0.5],
    "breadth": [4, 5, 6, 7, 8],
}
QUICK = {
    "no_match": [0.02, 0.05, 0.1],
    "untagged": [0.2, 0.3, 0.5],
    "secondary": [0.3, 0.5, 0.7],
    "attribute": [0.5, 0.7, 0.9, 1.0],
    "language": [0.2, 0.3, 0.5],
    "breadth": [4, 6, 8],
}


def grid(spark: SparkSession, options: dict[str, list] = GRID) -> DataFrame:
    """One row a combination, numbered in the order of the options."""
    combos = [(i, *map(float, c)) for i, c in enumerate(itertools.product(*options.values()))]
    return spark.createDataFrame(combos, "combo int, " + ", ".join(f"g_{k} double" for k in options))


def search(pairs: DataFrame, combos: DataFrame, words: vocab.Vocabulary = vocab.MUSIC, ks=(5,)) -> DataFrame:
    """Ranking metrics of each combination. ``pairs``: item_id, target_id, label, score, asked_tags, primary_tags, tags;
    where both item_<attribute> and <attribute> are there, those that both sides know and don't share cost too.

    What a pair is (class, breadth, attributes apart) doesn't depend on the combination: its factors are found once for each kind of
    pair. Items without a positive, which can't count, are left out; the pairs of an item stay together, and are ranked for all
    combinations as a matrix, so no pair is copied. A grid without a knob leaves that rule out.
    """
    kind = explicit_class(F.col("asked_tags"), F.col("primary_tags"), F.col("tags"), words)
    known = [a for a in ATTRIBUTES if {a, f"item_{a}"} <= set(pairs.columns)]
    count = lambda names: sum((F.when(F.coalesce(apart(a), F.lit(False)), 1).otherwise(0) for a in names), F.lit(0))
    other, spoken = count([a for a in known if a != "languages"]), count([a for a in known if a == "languages"])
    some = pairs.where("label = 1").select("item_id").distinct()
    traits = ["kind", "wide", "n_other", "n_spoken"]
    flat = pairs.join(some, "item_id", "left_semi").select("item_id", "target_id", "label", "score", kind.alias("kind"), breadth(F.col("primary_tags"), F.col("tags")).alias("wide"), other.alias("n_other"), spoken.alias("n_spoken"))
    kinds, flat = classed(keep(flat, "flat"), traits)
    p = SimpleNamespace(**{k: F.col(f"g_{k}") for k in ("no_match", "untagged", "secondary", "breadth")})
    factor = class_multiplier(F.col("kind"), F.col("wide"), p)
    for knob, n in (("attribute", "n_other"), ("language", "n_spoken")):
        if f"g_{knob}" in combos.columns:
            factor = factor * F.pow(F.col(f"g_{knob}"), F.col(n))
    told = kinds.crossJoin(F.broadcast(combos)).select("class", "combo", factor.alias("factor")).orderBy("class", "combo").toArrow()
    classes, numbers = np.unique(told["class"].to_numpy()), np.unique(told["combo"].to_numpy())
    table = told["factor"].to_numpy().reshape(len(classes), len(numbers))
    shared = pairs.sparkSession.sparkContext.broadcast((classes, numbers, table))
    slices = 4 * pairs.sparkSession.sparkContext.defaultParallelism
    rows = flat.select("item_id", "target_id", F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"), "class")
    rows = rows.repartition(slices, "item_id").sortWithinPartitions("item_id", "target_id")
    found = rows.mapInArrow(_measured(shared, ks), "combo int, n_groups long, " + ", ".join(f"{m} double" for m in names(ks)))
    return found.groupBy("combo").agg(F.sum("n_groups").alias("n_groups"), *[(F.sum(m) / F.sum("n_groups")).alias(m) for m in names(ks)])


def _measured(shared, ks):
    """Sums of the metrics over the items of a task, a row for each combination. Rows come in order of item and target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, numbers, table = shared.value
        sums, groups, rest = np.zeros((len(names(ks)), len(numbers))), 0, None

        def count(rows: pa.Table) -> int:
            items = rows["item_id"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
            sizes = np.diff(np.append(starts, len(items)))
            label = rows["label"].fill_null(0).to_numpy() == 1
            score = rows["score"].fill_null(-np.inf).to_numpy()
            factors = np.searchsorted(classes, rows["class"].to_numpy())
            for size in np.unique(sizes):
                mine = starts[sizes == size]
                wide = max(1, CELLS // size)  # combinations at once
                for a in range(0, len(mine), step := max(1, wide // len(numbers))):
                    at = mine[a : a + step, None] + np.arange(size)
                    for lo in range(0, len(numbers), wide):
                        sums[:, lo : lo + wide] += _metrics(score[at], label[at], table[:, lo : lo + wide][factors[at]], ks)
            return len(starts)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            items = rows["item_id"].to_numpy()
            last = len(items) - int((items == items[-1]).sum())  # the last item may go on
            if last:
                groups += count(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            groups += count(rest)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(np.full(len(numbers), groups)), *[pa.array(s) for s in sums]], ["combo", "n_groups", *names(ks)])

    return run


def _metrics(score: np.ndarray, label: np.ndarray, factor: np.ndarray, ks) -> np.ndarray:
    """Sums over items of each metric (rows) and combination (columns), from (items, pairs) scores and labels and (items, pairs,
    combinations) factors; every item has a positive. Pairs are in order of target, which breaks ties."""
    x = score[:, :, None] * factor
    x = np.where(np.isnan(x), np.inf, np.floor(np.abs(x) * 1e9 + 0.5) * np.sign(x) / 1e9)
    order = np.argsort(-x.transpose(0, 2, 1), axis=2, kind="stable")
    hit = np.take_along_axis(np.broadcast_to(label[:, None, :], order.shape), order, 2)
    positives = label.sum(axis=1)[:, None]
    gain = 1 / np.log2(np.arange(hit.shape[2]) + 2.0)
    ideal = np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(max(ks)) + 2.0))])
    out = [1.0 / (hit.argmax(axis=2) + 1)]
    for k in ks:
        hits = hit[:, :, :k].sum(axis=2)
        out += [hits > 0, hits / k, hits / positives, hit[:, :, :k] @ gain[:k] / ideal[np.minimum(k, positives)]]
    return np.array([o.sum(axis=0) for o in out])


def best(results: DataFrame, metric: str = "mrr") -> DataFrame:
    """The combination with the highest metric, the first in order among equals."""
    return results.orderBy(F.col(metric).desc(), "combo").limit(1)
