"""Stored tables: scans, overwrites by swap, keyed upserts, state, incremental sync, artifacts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators.rows import labelled, latest
from matchloom.schemas import INTERACTIONS, ITEMS, TARGETS, conform


class Store:
    """Tables in a folder of any Hadoop file system, one folder a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _place(self, name: str) -> str | None:
        """Where the table is: in its folder or, when a writer died between its two renames, beside it."""
        fs, p = self._fs(f"{self.root}/{name}")
        if fs.exists(p):
            return f"{self.root}/{name}"
        _, aside = self._fs(f"{self.root}/.old-{name}")
        return f"{self.root}/.old-{name}" if fs.exists(aside) else None

    def exists(self, name: str) -> bool:
        return self._place(name) is not None

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """The table; an absent one is empty."""
        place = self._place(name)
        if place is None:
            return self.spark.createDataFrame([], schema or T.StructType([]))
        reader = self.spark.read
        return (reader.schema(schema) if schema else reader).parquet(place)

    def write(self, name: str, df: DataFrame) -> None:
        """Write beside the table, then swap by renames, so that readers and ``df`` itself may read the old one.

        The old table is set aside, not deleted, until the new one is in place: at no time is there none.
        """
        fresh = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        df.write.parquet(fresh)
        fs, table = self._fs(f"{self.root}/{name}")
        (_, new), (_, aside) = self._fs(fresh), self._fs(f"{self.root}/.old-{name}")
        if fs.exists(table):
            fs.delete(aside, True)
            if not fs.rename(table, aside):
                raise OSError(f"can't set {table} aside")
        if not fs.rename(new, table):
            raise OSError(f"can't rename {new}")
        fs.delete(aside, True)

    def write_csv(self, name: str, df: DataFrame) -> None:
        """The table as CSV files with a header, in ``csv/<name>``; lists and maps as JSON."""
        flat = [F.to_json(c).alias(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{c}`") for c, f in zip(df.columns, df.schema.fields, strict=True)]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{self.root}/csv/{name}")

    def upsert(self, name: str, df: DataFrame, keys: list[str], updated_at: str = "updated_at", nulls_win: bool = True) -> None:
        """Add rows; of rows with equal keys the latest stays, a later added one among equals."""
        parts = df.withColumn("__seq", F.lit(1))
        if self.exists(name):
            parts = self.read(name).withColumn("__seq", F.lit(0)).unionByName(parts, allowMissingColumns=True)
        self.write(name, upserted(parts, keys, updated_at, "__seq", nulls_win).drop("__seq"))

    def read_state(self, name: str = "state") -> dict:
        if not self.exists(f"{name}.json"):
            return {}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}.json", wholetext=True).collect()))

    def write_state(self, state: dict, name: str = "state") -> None:
        fs, p = self._fs(f"{self.root}/{name}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()


def load_targets(store: Store) -> DataFrame:
    """The catalogue, conformed to its schema; empty where there is none."""
    return conform(store.read("targets", None if store.exists("targets") else TARGETS), TARGETS)


def load_interactions(store: Store) -> DataFrame:
    return conform(store.read("interactions", None if store.exists("interactions") else INTERACTIONS), INTERACTIONS)


def load_labelled(store: Store) -> DataFrame:
    """The interactions whose status says yes or no, with their label."""
    return labelled(load_interactions(store))[0]


def upserted(df: DataFrame, keys: list[str], updated_at: str, sequence: str, nulls_win: bool = True) -> DataFrame:
    """The latest row of each key. A null time counts as the latest, unless ``nulls_win`` is false."""
    at = F.try_to_timestamp(F.col(updated_at).cast("string"))
    order = [at.desc_nulls_first() if nulls_win else at.desc_nulls_last(), F.col(sequence).desc()]
    return latest(df, keys, order)


def watermark(df: DataFrame, updated_at: str = "updated_at"):
    return df.agg(F.max(F.try_to_timestamp(F.col(updated_at).cast("string")))).first()[0]


def newer_than(df: DataFrame, mark, updated_at: str = "updated_at") -> DataFrame:
    """Rows after the mark; all without one. The filter reaches the scan."""
    return df if mark is None else df.where(F.col(updated_at) > F.lit(mark))


def sync(store: Store, name: str, fetch: Callable[[str | None], DataFrame], keys: list[str], full: bool = False) -> int:
    """Fetch what changed since the stored mark and upsert it, or overwrite on a full refresh.

    The mark only moves forward; rows carry ``updated_at`` through.
    """
    state = store.read_state()
    mark = None if full else state.get(name, {}).get("watermark")
    rows = fetch(mark).cache()
    try:
        n = rows.count()
        if full or not store.exists(name):
            store.write(name, rows)
        elif n:
            store.upsert(name, rows, keys)
        top = watermark(rows) if "updated_at" in rows.columns else None
        if top is not None:
            state[name] = {"watermark": max(filter(None, [str(top), mark]))}
            store.write_state(state)
        return n
    finally:
        rows.unpersist()


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    """The item export: known columns only, one row an item, the first in the file."""
    raw = spark.read.option("header", True).csv(path)
    wanted = [f.name for f in ITEMS.fields if f.name in raw.columns]
    rows = conform(raw.select(*wanted), ITEMS).withColumn("__seq", F.monotonically_increasing_id())
    return latest(rows, ["item_id"], [F.col("__seq")]).drop("__seq")


def save_bundle(model, metadata: dict, store: Store, name: str) -> None:
    """A fitted pipeline and what belongs to it."""
    model.write().overwrite().save(f"{store.root}/{name}/model")
    store.write_state(metadata, f"{name}-metadata")


def load_bundle(store: Store, name: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{store.root}/{name}/model"), store.read_state(f"{name}-metadata")


def publish(store: Store, names: list[str], to: str, dry_run: bool = False) -> list[dict]:
    """Copy tables to another place, which may be an object store; returns what was or would be copied.

    Raises before anything is copied when a table is missing.
    """
    missing = [n for n in names if not store.exists(n)]
    if missing:
        raise FileNotFoundError(f"not in the store: {', '.join(missing)}")
    manifest = []
    for name in names:
        source, target = store._place(name), f"{to.rstrip('/')}/{name}"
        fs, path = store._fs(source)
        manifest.append({"table": name, "from": source, "to": target, "bytes": fs.getContentSummary(path).getLength()})
        if not dry_run:
            store.spark.read.parquet(source).write.mode("overwrite").parquet(target)
    return manifest


def pull(store: Store, names: list[str], source: str, replace: bool = False) -> list[str]:
    """Tables of a published place that the store lacks (or all, to replace), copied into it; their names."""
    wanted = [n for n in names if replace or not store.exists(n)]
    for name in wanted:
        store.write(name, store.spark.read.parquet(f"{source.rstrip('/')}/{name}"))
    return wanted


def target_sources(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Targets that have a name, an id and a URL; at most ``limit``, all if none or not positive."""
    rows = df.where("target_name is not null and target_id is not null and target_url is not null and target_url <> ''").select("target_id", "target_name", "target_url")
    return rows.orderBy("target_id").limit(limit) if limit and limit > 0 else rows


def export_features(fetched: DataFrame, cached: DataFrame, columns: list[str], analyse=None) -> DataFrame:
    """One row an item: fresh values where it was analysed now, else cached ones.

    ``analyse`` is a function for mapInPandas over the items that have no cached row and a preview.
    """
    first = latest(fetched, ["item_id"], [F.col("target_id"), F.col("item_name")])
    # Of an item's cached rows the one with the most recent time, where there is one, then the largest values.
    newest = [F.col(c).desc_nulls_last() for c in ("updated_at", *columns) if c in cached.columns]
    have = latest(cached, ["item_id"], newest).select("item_id", *columns)
    old = first.join(have, "item_id")
    new = first.join(have.select("item_id"), "item_id", "left_anti").where("preview_url is not null")
    if analyse is not None:
        new = new.mapInPandas(analyse, old.schema)
        old = old.unionByName(new)
    return latest(old, ["item_id"], [F.col(c).desc_nulls_last() for c in columns])


def numbered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
