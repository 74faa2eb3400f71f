"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share all words; a
target stops at ``CAP`` times its source's size and the excess is shared anew by weight.

Rates: among all document rates between 0 and CAP whose words add up to a source's target, the ones
of least relative entropy to rate 1 are ``CAP / (1 + (CAP - 1) exp(-x))`` with ``x`` proportional
to the document's size: an exponential tilt of the odds. The factor of each source solves the
convex dual; a Newton step for all sources takes one aggregation over the (source, size) histogram,
whose sums are of whole numbers so that reruns agree. A step outside the bracket of the
root is replaced by its middle.

Copies: a rate is rounded to a neighbouring whole number. In each source the ``HEAD`` largest
documents carry their rounding error, in words, to the next smaller one; all others are rounded
along a running sum of fractions in order of size. The sum runs over range partitions whose
offsets are added afterwards, so that no source is gathered in one task.

Defined results: null text has size 0; documents of size 0 take nothing; null is a source of its
own; rows that repeat an id are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import WORD, Workspace

CAP = 3
WEIGHTS = (1, 2, 3)
HEAD = 64
ROUNDS = 80
MICRO = 1_000_000
#: Factors beyond this make every rate 0 or CAP.
WIDEST = 1e6


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source."""
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(CAP))
    # Water filling: with sources in order of cap per weight, the level is the first at which the
    # words left over, shared by the weights left over, stay below a source's cap per weight.
    by_cap = Window.partitionBy().orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weights)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    rows = rows.withColumn("level", F.first(fits, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    capped = F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("cap"))
    return rows.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"), F.coalesce(capped, F.lit(True)).alias("full"))


def rate(size: Column, scale: Column, factor: Column) -> Column:
    x = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), factor * size / scale))
    return CAP / (1 + (CAP - 1) * F.exp(-x))


def solve(bins: DataFrame, aims: DataFrame, work: Workspace) -> DataFrame:
    """``aims`` with scale and factor of each source; ``bins`` is (source, size, n), sizes above 0."""
    scale = bins.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    start = {"factor": 0.0, "low": -WIDEST, "high": WIDEST}
    state = aims.join(scale, aims.source.eqNullSafe(scale.source)).drop(scale.source).withColumns({k: F.lit(v) for k, v in start.items()})
    state = state.withColumn("factor", F.when(F.col("full"), F.lit(WIDEST)).otherwise(F.col("factor"))).withColumn("open", ~F.col("full") & (F.col("target") > 0))
    sources = aims.count()
    state = work.keep(state, "state0", sources)
    columns = state.columns
    for i in range(ROUNDS):
        if state.where("open").isEmpty():
            break
        live = state.where("open").select(F.col("source").alias("s"), "scale", "factor")
        r = rate(F.col("size"), F.col("scale"), F.col("factor"))
        words = F.col("n") * F.col("size") * r
        slope = words * (1 - r / CAP) * F.col("size") / F.col("scale")
        sums = bins.join(live, bins.source.eqNullSafe(F.col("s"))).groupBy("s").agg(F.sum(F.round(words * 1000).cast("long")).alias("words"), F.sum(F.round(slope * 1000).cast("long")).alias("slope"))
        moved = state.join(sums, state.source.eqNullSafe(F.col("s")), "left")
        short = F.col("target") - F.col("words") / 1000
        low, high = F.when(short > 0, F.col("factor")).otherwise(F.col("low")), F.when(short > 0, F.col("high")).otherwise(F.col("factor"))
        step = F.col("factor") + short / F.greatest(F.col("slope") / 1000, F.lit(1e-9))
        step = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        open_ = F.col("open") & (F.abs(short) > 1e-6 * F.col("target")) & (high - low > 1e-12)
        new = {"factor": F.when(open_, step).otherwise(F.col("factor")), "low": F.when(open_, low).otherwise(F.col("low")), "high": F.when(open_, high).otherwise(F.col("high")), "open": open_}
        state = work.keep(moved.select(*[new.get(c, F.col(c)).alias(c) for c in columns]), f"state{i + 1}", sources)
    return state


def _carry_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies of the HEAD largest documents of each source, and the words carried on."""
    one = F.lit(MICRO).cast("long")

    def fold(acc, x):
        wanted = acc["carry"] + x["rate"] * x["size"]
        near = F.floor(wanted / (x["size"] * one) + 0.5)
        low = F.floor(x["rate"] / one)
        high = F.ceil(x["rate"] / one)
        copies = F.greatest(low, F.least(high, near)).cast("long")
        return F.struct((wanted - copies * x["size"] * one).cast("long").alias("carry"), F.concat(acc["out"], F.array(F.struct(x["rid"].alias("rid"), copies.alias("copies")))).alias("out"))

    empty = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<struct<rid:bigint,copies:bigint>>").alias("out"))
    # At most HEAD structs are gathered for a source.
    folded = docs.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("place", "rid", "size", "rate"))).alias("rows")).select("source", F.aggregate("rows", empty, fold).alias("f"))
    return folded.select(F.explode("f.out").alias("o")).select("o.rid", "o.copies"), folded.select("source", F.col("f.carry").alias("carry"))


def plan_mix(df: DataFrame, source: str, text: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Documents (all columns of ``df`` but ``text``, renamed c0, c1, ...) with size, source_size,
    target, rate and copies; and the list of those columns' names is that of ``df`` without text."""
    keep = [c for c in df.columns if c != text]
    size = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")
    sized = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"))
    return _copies(work.keep(sized.withColumn("rid", F.monotonically_increasing_id()), "sized"), work), keep


def _copies(sized: DataFrame, work: Workspace) -> DataFrame:
    bins = work.keep(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "bins")
    totals = bins.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = work.keep(targets(totals), "aims")
    solved = solve(bins.where("size > 0"), aims, work).select(F.col("source").alias("s"), "scale", "factor")
    rated = bins.where("size > 0").join(solved, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", F.round(rate(F.col("size"), F.col("scale"), F.col("factor")) * MICRO).cast("long").alias("rate"))
    rated = work.keep(rated, "rates")
    work.drop(*[n for n in work.names() if n.startswith("state")])
    r = rated.select(F.col("source").alias("rs"), F.col("size").alias("rz"), "rate")
    docs = work.keep(sized.where("size > 0").select("source", "size", "rid", F.xxhash64("c0").alias("h")).join(r, F.col("source").eqNullSafe(F.col("rs")) & (F.col("size") == F.col("rz"))).drop("rs", "rz"), "rated")
    order = [F.col("size").desc(), F.col("h"), F.col("rid")]
    place = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    head = work.keep(docs.withColumn("place", place).where(F.col("place") <= HEAD), "head")
    head_copies, carry = _carry_copies(head)
    last = head.groupBy("source").agg(F.max(F.struct("place", "size", "h", "rid")).alias("last"))
    limits = work.keep(last.join(carry.withColumnRenamed("source", "cs"), F.col("source").eqNullSafe(F.col("cs"))).select(F.col("source").alias("ls"), "last", "carry"), "limits")
    after = (F.col("size") < F.col("last.size")) | ((F.col("size") == F.col("last.size")) & ((F.col("h") > F.col("last.h")) | ((F.col("h") == F.col("last.h")) & (F.col("rid") > F.col("last.rid")))))
    rest = docs.join(limits, F.col("source").eqNullSafe(F.col("ls"))).where(after).drop("ls", "last")
    ranged = work.keep(rest.withColumn("down", -F.col("size")).repartitionByRange("source", "down", "h", "rid").withColumn("pid", F.spark_partition_id()), "ranged")
    part = F.col("rate") % MICRO
    sums = ranged.groupBy("source", "pid").agg(F.sum(part).alias("part"), F.max("size").alias("largest"), F.first("carry").alias("carry"))
    by_part = Window.partitionBy("source").orderBy("pid")
    offset = F.coalesce(F.sum("part").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = F.round(F.first("carry").over(by_part) / F.first("largest").over(by_part)).cast("long") + MICRO // 2
    offsets = sums.select(F.col("source").alias("os"), F.col("pid").alias("op"), (offset + begin).alias("offset"))
    running = F.sum(part).over(Window.partitionBy("pid", "source").orderBy("down", "h", "rid").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("running", running).join(offsets, (F.col("pid") == F.col("op")) & F.col("source").eqNullSafe(F.col("os")))
    upto = F.col("offset") + F.col("running")
    extra = F.floor(upto / MICRO) - F.floor((upto - part) / MICRO)
    rest_copies = placed.select("rid", (F.floor(F.col("rate") / MICRO) + extra).cast("long").alias("copies"))
    chosen = head_copies.union(rest_copies).select(F.col("rid").alias("xr"), "copies")
    full = sized.join(chosen, F.col("rid") == F.col("xr"), "left").drop("xr").join(r, F.col("source").eqNullSafe(F.col("rs")) & (F.col("size") == F.col("rz")), "left").drop("rs", "rz")
    aim = aims.select(F.col("source").alias("as"), "source_size", "target")
    return full.join(aim, F.col("source").eqNullSafe(F.col("as"))).drop("as").withColumn("copies", F.coalesce("copies", F.lit(0)).cast("long"))


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies, taken."""
    work = Workspace(df.sparkSession, "mix")
    planned, _ = plan_mix(df.select(doc_id, source, text), source, text, work)
    return planned.select(
        F.col("c0").alias(doc_id),
        F.col("c1").alias(source),
        "size",
        "source_size",
        "target",
        F.coalesce(F.col("rate") / MICRO, F.lit(0.0)).alias("rate"),
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. All columns are those of ``docs``.

    Rows that repeat an id and a text come as often as all of them together are taken.
    """
    from matchloom.llm.near_dup import rows_for

    work = Workspace(docs.sparkSession, "mix")
    thin = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    thin = thin.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    planned, _ = plan_mix(thin, "source", "text", work)
    counts = planned.groupBy(F.xxhash64("c0").alias("__k"), F.col("c2").alias("__th")).agg(F.sum("copies").alias("__n"), F.count(F.lit(1)).alias("__rows"))
    return rows_for(docs, doc_id, text, work.keep(counts, "counts"))
