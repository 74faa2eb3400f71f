"""Training: median imputation, boosted trees with sigmoid calibration, importances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators import boosting, ordered
from matchloom.operators.metrics import curve
from matchloom.operators.sampling import order_key
from matchloom.sources.tables import Store
from matchloom.workspace import keep


#: Copies of rows that importances list as rows, and rows of a block and of a range of scores beyond.
COPIES, BLOCK_ROWS, RANGE_ROWS = 1_000_000, 30_000, 8_000_000


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; 0 for a column without values."""
    return {c: 0.0 if m is None else m for c, m in ordered.medians(df, columns).items()}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})


def balanced(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Weights that give both classes half of the total."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn(out, weight)


class Ranker:
    """Boosted trees fitted on the complement of each fold and calibrated on the fold; mean of the folds.

    They are grown by ``boosting``, as Spark's are (variance of the residuals, 32 bins, logistic loss), and ``models``
    gives them as Spark's: (trees, sigmoid) of each fold. Trees don't depend on the scale of a feature, so none is scaled.
    """

    def __init__(self, features: list[str], folds: int = 3, trees: int = 30, depth: int = 5, rate: float = 0.1, seed: int = 42):
        self.features, self.folds, self.trees, self.depth, self.rate, self.seed = features, folds, trees, depth, rate, seed
        self.values: dict[str, float] = {}
        self.forest: boosting.Forest | None = None

    def fit(self, df: DataFrame, label: str = "label") -> Ranker:
        counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
        weights = tuple(sum(counts.values()) / (len(counts) * counts[v]) if counts.get(v) else 1.0 for v in (0, 1))
        self.values, edges, n = boosting.medians_and_edges(df, self.features)
        rows = df.withColumn("fold", F.pmod(F.xxhash64("item_id", "target_id", F.lit(self.seed)), F.lit(self.folds)))
        forest = boosting.Forest(self.features, self.values, edges, [[] for _ in range(self.folds)])
        self.forest = boosting.fit(rows, forest, n, self.folds, self.trees, self.depth, self.rate, weights, label, "fold")
        return self

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        forest = self.forest
        needed = forest.used() or [0]

        @F.pandas_udf("double")
        def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)  # of one feature a series comes alone
                codes = {f: forest.codes(f, c.to_numpy("float64", na_value=np.nan)) for f, c in zip(needed, columns, strict=True)}
                yield pd.Series(forest.score(codes, len(columns[0])))

        rows = df.withColumn(out, scored(*[F.col(self.features[f]).cast("double") for f in needed]))
        return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(self.values[c])) for c in self.features if c in df.columns})

    @property
    def models(self) -> list[tuple[PipelineModel, PipelineModel]]:
        from matchloom.operators import spark_models

        return spark_models.of(self.forest) if self.forest else []

    def save(self, store: Store, name: str = "ranker") -> None:
        """The fitted folds and what they need, below the store; a model of that name is replaced."""
        for i, parts in enumerate(self.models):
            for part, fitted in zip(("trees", "sigmoid"), parts, strict=True):
                fitted.write().overwrite().save(f"{store.root}/{name}/fold{i}/{part}")
        kept = {k: getattr(self, k) for k in ("features", "folds", "trees", "depth", "rate", "seed", "values")} | {"forest": self.forest.state()}
        store.write_state(kept, f"{name}-metadata")  # last: a model without it isn't complete

    @classmethod
    def load(cls, store: Store, name: str = "ranker") -> Ranker:
        kept = store.read_state(f"{name}-metadata")
        if not kept:
            raise FileNotFoundError(f"no model {name} in {store.root}")
        if "forest" not in kept:
            raise ValueError(f"{name} is of an earlier version; train again")
        found = cls(*(kept[k] for k in ("features", "folds", "trees", "depth", "rate", "seed")))
        found.values = kept["values"]
        found.forest = boosting.Forest.of(found.features, found.values, kept["forest"])
        return found

    def importances(self) -> list[tuple[str, float]]:
        """Mean over the folds, largest first, ties by name."""
        return sorted(zip(self.features, self.forest.importances().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def permuted(df: DataFrame, seed: int, columns: list[str], out: str, keys=("item_id", "target_id")) -> DataFrame:
    """``df`` with a struct ``out`` of another row's values of the columns, by two hash orders.

    Rows are numbered inside hash buckets, so no window runs over all of them.
    """
    bucket = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(64))
    numbered = df.withColumn("__b", bucket)
    here = numbered.withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy(order_key(seed, *keys))))
    there = numbered.select("__b", F.row_number().over(Window.partitionBy("__b").orderBy(order_key(seed + 1, *keys))).alias("__n"), F.struct(*columns).alias(out))
    return here.join(there, ["__b", "__n"]).drop("__b", "__n")


def permutation_importance(ranker: Ranker, df: DataFrame, columns: list[str], repeats: int = 5, seed: int = 42, label: str = "label") -> DataFrame:
    """(feature, loss): mean loss of ROC area when a column is permuted, largest first.

    Up to COPIES copies, one plan scores all columns and repeats: a row meets one other row a repeat, and is copied once
    for each column, which takes the other row's value; column -1 is the unchanged base. Beyond, ``blocked_losses`` does the same without rows
    for copies. A column that no tree splits by moves
    no score: its loss is 0 and its copies aren't scored.
    """
    used = [c for c in columns if c in {name for name, value in ranker.importances() if value > 0}]
    columns, idle = used, [c for c in columns if c not in used]
    rows = df.select("item_id", "target_id", label, *ranker.features)
    idle = df.sparkSession.createDataFrame([(c, 0.0) for c in idle], "feature string, loss double")
    if not columns:
        return idle.orderBy("feature")
    n = rows.count()
    if n * len(columns) * repeats > COPIES:
        found = df.sparkSession.createDataFrame(blocked_losses(ranker, rows, columns, repeats, seed, label, n), "feature string, loss double")
        return found.unionByName(idle).orderBy(F.col("loss").desc(), "feature")
    copies = F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1))).alias("__column")
    tried = None
    for i in range(repeats):
        met = permuted(rows, seed + 10 * i, columns, "__other").select("*", F.lit(i).alias("__repeat"), copies)
        met = met if i == 0 else met.where("__column >= 0")
        tried = met if tried is None else tried.unionByName(met)
    moved = {c: F.when(F.col("__column") == i, F.col(f"__other.{c}")).otherwise(F.col(c)) for i, c in enumerate(columns)}
    scored = ranker.score(tried.withColumns(moved).drop("__other")).select("__column", "__repeat", label, "score")
    areas = keep(curve(scored, label=label, by=["__column", "__repeat"]), "areas")
    base = areas.where("__column = -1").select(F.coalesce("auc_roc", F.lit(0.0)).alias("base"))
    loss = areas.where("__column >= 0").groupBy("__column").agg(F.avg(F.coalesce("auc_roc", F.lit(0.0))).alias("mean"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__column") + 1)
    found = loss.crossJoin(F.broadcast(base)).select(names.alias("feature"), (F.col("base") - F.col("mean")).alias("loss"))
    return found.unionByName(idle).orderBy(F.col("loss").desc(), "feature")


def blocked_losses(ranker: Ranker, rows: DataFrame, columns: list[str], repeats: int, seed: int, label: str, n: int, range_rows: int = RANGE_ROWS) -> list[tuple[str, float]]:
    """(feature, loss) of all rows, by blocks dealt by a hash of their keys: within a block a row takes the value of
    another by two hash orders, and of each tree only what the column can change is found again.

    Areas are of scores to nine places. A block's scores leave it sorted, as differences; ranges of scores are compared in
    tasks of their own, and what lies in lower ranges is added from their counts.
    """
    forest, places = ranker.forest, 9
    asked = [ranker.features.index(c) for c in columns]
    used = [*asked, *[f for f in forest.used() if f not in asked]]  # those of the columns come first
    bins, width, n_asked = forest.bins, len(used), len(asked)
    blocks = max(1, -(-n // BLOCK_ROWS))
    ranges = max(1, -(-n // range_rows))
    cuts = np.linspace(0, 10**places, ranges + 1)[1:-1]
    trees = [[(t.masks(bins), t.weight * t.leaves()) for t in own] for own in forest.folds]

    def pack(batches):
        for batch in batches:
            codes = np.stack([forest.codes(f, boosting.doubles(batch.column(3 + i))) for i, f in enumerate(used)], axis=1)
            data = np.ascontiguousarray(codes).tobytes()
            offsets = pa.py_buffer((np.arange(batch.num_rows + 1, dtype=np.int32) * width).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(data)])], ["block", "hash", "y", "codes"])

    def mixed(h, s):
        h = h + np.uint64((s * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def run(table):
        h = table.column("hash").to_numpy().view(np.uint64)
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(h), width)
        y = table.column("y").to_numpy() > 0
        order = np.lexsort([*codes.T, y, h])
        h, y, codes = h[order], y[order], np.ascontiguousarray(codes[order].T)
        others = []
        for r in range(repeats):
            other = np.zeros(len(h), np.int64)
            other[np.argsort(mixed(h, seed + 10 * r), kind="stable")] = np.argsort(mixed(h, seed + 10 * r + 1), kind="stable")
            others.append(other)
        moved = [[codes[i][o] for o in others] for i in range(n_asked)]
        at = {f: i for i, f in enumerate(used)}
        base, total = np.zeros(len(h)), np.zeros((n_asked, repeats, len(h)))
        for own, (a, b) in zip(trees, forest.calibration, strict=True):
            margin, changed = np.zeros(len(h)), np.zeros((n_asked, repeats, len(h)))
            for tables, values in own:
                if not tables:
                    margin += values[0]
                    continue
                found = [(at[f], t, t[codes[at[f]]]) for f, t in tables.items()]
                after = [np.full(len(h), 0xFFFFFFFFFFFFFFFF, np.uint64)]
                for _, _, m in reversed(found):
                    after.append(after[-1] & m)
                now = values[boosting.places(after[-1])]
                margin += now
                before = after[0]
                for k, (i, t, m) in enumerate(found):
                    rest = before & after[len(found) - 1 - k]
                    for r in range(repeats if i < n_asked else 0):
                        changed[i, r] += values[boosting.places(rest & t[moved[i][r]])] - now
                    before = before & m
            base += boosting.sigmoid(a * margin + b)
            for i in range(n_asked):
                total[i] += boosting.sigmoid(a * (margin + changed[i]) + b)
        out = []
        for i, r, s in [(-1, 0, base), *[(i, r, total[i, r]) for i in range(n_asked) for r in range(repeats)]]:
            s = np.rint(s / len(trees) * 10**places).astype(np.uint32)
            sides = [np.sort(s[y]), np.sort(s[~y])]
            ends = [np.r_[0, np.searchsorted(x, cuts), len(x)] for x in sides]
            for k in range(ranges):
                pair = [x[e[k] : e[k + 1]] for x, e in zip(sides, ends, strict=True)]
                if len(pair[0]) or len(pair[1]):
                    out.append((i, r, k, *[np.diff(x, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for x in pair]))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["i", "r", "k", "up", "down"])

    def compare(table):
        sides = []
        for name in ("up", "down"):
            parts = [np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32) for x in table.column(name).to_pylist()]
            sides.append(np.sort(np.concatenate(parts)))
        up, down = sides
        below = int(np.searchsorted(down, up, "left").sum()) + int(np.searchsorted(down, up, "right").sum())
        one = [table.column(c)[0].as_py() for c in ("i", "r", "k")]
        return pa.table([pa.array([v], t) for v, t in zip((*one, len(up), len(down), below), (pa.int32(),) * 3 + (pa.int64(),) * 3, strict=True)], ["i", "r", "k", "up", "down", "twice"])

    keys = F.xxhash64("item_id", "target_id", F.lit(seed))
    lean = rows.select(F.pmod(keys, F.lit(blocks)).cast("int").alias("block"), F.xxhash64("target_id", "item_id", F.lit(seed)).alias("hash"), F.col(label).cast("int").alias("y"), *[F.col(ranker.features[f]).cast("double") for f in used])
    lean = lean.mapInArrow(pack, "block int, hash long, y int, codes binary")
    scores = lean.groupBy("block").applyInArrow(run, "i int, r int, k int, up binary, down binary")
    compared = scores.groupBy("i", "r", "k").applyInArrow(compare, "i int, r int, k int, up long, down long, twice long").collect()
    areas: dict[int, list[float]] = {}
    for i, r in sorted({(x["i"], x["r"]) for x in compared}):
        own = sorted((x for x in compared if (x["i"], x["r"]) == (i, r)), key=lambda x: x["k"])
        wins, ups, downs = 0, 0, 0
        for x in own:
            wins += x["twice"] + 2 * x["up"] * downs
            ups, downs = ups + x["up"], downs + x["down"]
        areas.setdefault(i, []).append(wins / (2 * ups * downs) if ups and downs else 0.0)
    return [(c, areas[-1][0] - sum(areas[i]) / len(areas[i])) for i, c in enumerate(columns)]
