"""Row-level operators: labels, deduplication, hydration, tolerant projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import strip

#: Statuses that make a positive or a negative.
POSITIVE = ["accepted", "closed", "approve", "approved"]
NEGATIVE = ["declined", "reject", "rejected"]


def label(status: Column | str, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """1, 0, or null for a status that is neither."""
    key = F.lower(strip(status))
    return F.when(key.isin(*positive), 1).when(key.isin(*negative), 0)


def labelled(df: DataFrame, status: str = "status", **words) -> tuple[DataFrame, DataFrame]:
    """Rows with a label, and those rejected."""
    rows = df.withColumn("label", label(status, **words))
    return rows.where("label is not null"), rows.where("label is null").drop("label")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; ties by nothing else, so give a total one."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def pick(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def hydrate(items: DataFrame, history: DataFrame, key: str = "item_id") -> DataFrame:
    """Items, and those that only the history knows, with nulls for what it doesn't say."""
    missing = history.where(F.col(key).isNotNull()).join(items.select(key), key, "left_anti")
    missing = latest(pick(missing, items.columns), [key], [F.col(c).asc_nulls_last() for c in items.columns if c in missing.columns])
    return items.unionByName(missing, allowMissingColumns=True)


def number(c: Column) -> Column:
    """A finite number, else null."""
    value = c.try_cast("double") if hasattr(c, "try_cast") else c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
