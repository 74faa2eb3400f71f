"""Running totals and ranks over all rows without a window that gathers them in one task.

Rows are dealt into ranges, totalled within each, and the totals of the ranges before (a row a range) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.workspace import keep


def running(rows: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``rows`` with the running total of each expression, the row itself included. ``order`` is total."""
    ranged = keep(rows.withColumns({f"__of_{name}": value for name, value in totals.items()}).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")
    each = ranged.groupBy("__range").agg(*[F.sum(f"__of_{name}").alias(name) for name in totals])
    before = Window.partitionBy().orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = each.select("__range", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"__before_{name}") for name in totals])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({name: F.sum(f"__of_{name}").over(inside) for name in totals}).join(F.broadcast(offsets), "__range")
    summed = summed.withColumns({name: F.col(name) + F.col(f"__before_{name}") for name in totals})
    return summed.drop("__range", *[f"__{part}_{name}" for name in totals for part in ("of", "before")])


def numbered(rows: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``rows`` numbered from 1 in a total order."""
    return running(rows, order, {out: F.lit(1).cast("long")})


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of numeric columns, nulls and NaN left out; None for a column without values.

    All columns in one pass: one row for each distinct value of each, in order.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)]))
    values = rows.select(pairs.alias("p")).select("p.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    per = running(values.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")), [F.col("i"), F.col("v")], {"upto": F.col("n")})
    per = keep(per, "values")
    spans = per.groupBy("i").agg(F.min(F.col("upto") - F.col("n")).alias("first"), F.max("upto").alias("last"))  # a row a column
    at = per.join(F.broadcast(spans), "i")
    low = F.col("first") + F.floor((F.col("last") - F.col("first") + 1) / 2)
    high = F.col("first") + F.floor((F.col("last") - F.col("first") + 2) / 2)
    holds = lambda rank: (F.col("upto") - F.col("n") < rank) & (rank <= F.col("upto"))
    found = at.where(holds(low) | holds(high)).groupBy("i").agg(((F.min("v") + F.max("v")) / 2).alias("m")).collect()
    known = {columns[r["i"]]: float(r["m"]) for r in found}
    return {c: known.get(c) for c in columns}
