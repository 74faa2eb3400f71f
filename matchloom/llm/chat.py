"""Chat formatting with minimum-cost repair of roles.

A legal conversation is an optional system turn, then user and assistant in turn, an assistant last. Dynamic
programming over the automaton of legal turns (state: the role of the last turn) picks, for each
turn, the cheapest of keeping it, giving it another role, joining it to the turn before, or
putting an empty turn before it. The repaired sequence is rendered turn by turn.

Costs combine by minimum and sum, so a run of turns is a 4 x 4 matrix: conversations are cut into blocks of
``BLOCK`` turns, each block gives its matrix, a conversation's matrices are folded to fix the state at
every cut, and each block is then repaired and rendered between its two states. More than ``FAN`` matrices are
folded in levels, FAN at a time. Turns are numbered over range partitions of all rows, so a conversation
of any length, with whatever turn numbers, is never in one task, and neither are its matrices.
Its rendering is the concatenation of its segments in order, one row each.

Defined results: rows alike in conversation, turn, role and text count once; turns with one number stand
in order of role (null last), of the first ``PREFIX`` characters of the text and of a hash of it; null turn numbers come
last; a null text is empty; a null or unknown role may become any at a low cost; a null conversation id
is a conversation; marks of the format inside a text are broken up.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import Workspace

BLOCK = 512
#: Matrices that one task folds for a conversation; characters of a text that order it among equals.
FAN, PREFIX = 512, 64
#: Rows that one call of a worker's function handles, about.
GROUP_ROWS = 5000
#: States, spellings of roles, and costs.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
SPELLINGS = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
RELABEL, NAME_UNKNOWN, JOIN_SAME, JOIN_OTHER, INSERT = 3.0, 1.0, 1.0, 4.0, 2.0
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
NEXT = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = float("inf")
#: Stands for FAR in stored matrices.
NEVER = 1e300


def _moves() -> dict[int, list[tuple[int, tuple[int, ...]]]]:
    """From each state, the role a turn can take and the empty turns that must come before it."""
    out: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for state in range(4):
        out[state] = [(r, ()) for r in NEXT[state]]
        for between in NEXT[state]:
            out[state] += [(r, (between,)) for r in NEXT[between] if r not in NEXT[state]]
    return out


MOVES = _moves()
#: The empty turns that end a conversation from each state.
ENDING = {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_of(name) -> int:
    """The state of a role's name, 0 for an unknown one."""
    return SPELLINGS.get(name.strip().lower(), NONE) if isinstance(name, str) else NONE


def options(state: int, role: int) -> list[tuple[float, int, str, tuple[int, ...]]]:
    """(cost, next state, kind, empty turns before) for a turn of a role."""
    found = []
    for to, empty in MOVES[state]:
        name = 0.0 if to == role else NAME_UNKNOWN if role == NONE else RELABEL
        found.append((name + INSERT * len(empty), to, "turn", empty))
    if state != NONE:
        found.append((JOIN_SAME if role in (state, NONE) else JOIN_OTHER, state, "join", ()))
    return found


OPTIONS = {(s, r): options(s, r) for s in range(4) for r in range(4)}


def block_costs(roles: list[int]) -> list[float]:
    """The least costs between all states before and after a run of turns, row by row."""
    out = []
    for start in range(4):
        cost = [FAR] * 4
        cost[start] = 0.0
        for role in roles:
            after = [FAR] * 4
            for state in range(4):
                if cost[state] < FAR:
                    for c, to, _, _ in OPTIONS[state, role]:
                        after[to] = min(after[to], cost[state] + c)
            cost = after
        out += cost
    return out


def block_path(roles: list[int], start: int, end: int) -> list[tuple[float, int, str, tuple[int, ...]]]:
    """The cheapest choices from one state to the other; the first in order among equals."""
    cost, back = [FAR] * 4, []
    cost[start] = 0.0
    for role in roles:
        after, chosen = [FAR] * 4, [None] * 4
        for state in range(4):
            if cost[state] < FAR:
                for o in OPTIONS[state, role]:
                    if cost[state] + o[0] < after[o[1]]:
                        after[o[1]], chosen[o[1]] = cost[state] + o[0], (state, o)
        cost = after
        back.append(chosen)
    path, state = [], end
    for chosen in reversed(back):
        state, o = chosen[state]
        path.append(o)
    return path[::-1]


def fold(blocks: list[list[float]], start: int = NONE, end: int | None = None) -> tuple[list[int], float]:
    """The states before, between and after the blocks, on the cheapest way to ``end``, or to a legal end."""
    cost, back = [FAR] * 4, []
    cost[start] = 0.0
    for m in blocks:
        after, chosen = [FAR] * 4, [0] * 4
        for a in range(4):
            for b in range(4):
                if cost[a] + m[4 * a + b] < after[b]:
                    after[b], chosen[b] = cost[a] + m[4 * a + b], a
        cost = after
        back.append(chosen)
    ended = [cost[s] + INSERT * len(ENDING[s]) if end is None else cost[s] if s == end else FAR for s in range(4)]
    state = ended.index(min(ended))
    states = [state]
    for chosen in reversed(back):
        state = chosen[state]
        states.append(state)
    return states[::-1], min(ended)


def product(blocks: list[list[float]]) -> list[float]:
    """The matrix of consecutive blocks together."""
    out = blocks[0]
    for m in blocks[1:]:
        out = [min(out[4 * a + k] + m[4 * k + b] for k in range(4)) for a in range(4) for b in range(4)]
    return [min(x, NEVER) for x in out]


def clean(text) -> str:
    return (text if isinstance(text, str) else "").replace("<|im_", "<| im_")


def render(path, texts: list, start: int, last: bool) -> tuple[str, int]:
    """The segment of a block and the number of turns that begin in it."""
    out, state, turns = [], start, 0

    def begin(role: int, text: str) -> None:
        nonlocal state, turns
        out.append((CLOSE + "\n" if state != NONE else "") + f"{OPEN}{NAMES[role]}\n{text}")
        state, turns = role, turns + 1

    for (_, to, kind, empty), text in zip(path, texts, strict=True):
        if kind == "join":
            out.append("\n" + clean(text))
        else:
            for role in empty:
                begin(role, "")
            begin(to, clean(text))
    if last:
        for role in ENDING[state]:
            begin(role, "")
        if state != NONE:
            out.append(CLOSE + "\n")
    return "".join(out), turns


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per segment: conversation, segment, segments, n_in (turns read), n_out (turns
    rendered), cost (of the whole conversation) and text."""
    work = Workspace(df.sparkSession, "chat")
    kind = df.schema[conv].dataType.simpleString()
    raw = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("double").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    marked = [x for c in ("conv", "turn", "role") for x in (F.col(c).isNull(), F.col(c))]
    rows = raw.withColumns({f"k{i}": F.xxhash64(F.lit(i), *marked, "text") for i in (1, 2)})
    turns = _numbered(rows, work)
    groups = max(1, turns.count() // GROUP_ROWS)
    bucket = F.pmod(F.xxhash64("conv", "block"), F.lit(groups)).alias("bucket")

    def runs(pdf: pd.DataFrame):
        return pdf.sort_values(["block", "rank"], kind="stable").groupby(["conv", "block"], dropna=False, sort=False)

    def costs(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(c, b, [min(float(x), NEVER) for x in block_costs([role_of(r) for r in g["role"]])]) for (c, b), g in runs(pdf)]
        return pd.DataFrame(found, columns=["conv", "block", "costs"])

    matrices = f"conv {kind}, block long, costs array<double>"
    each = work.keep(turns.select(bucket, "conv", "block", "rank", "role").groupBy("bucket").applyInPandas(costs, matrices), "costs")
    fixed = _states(each, kind, work).withColumnsRenamed({"conv": "c", "block": "b"})
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    joined = turns.join(texts, ["k1", "k2"]).join(fixed, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b", "k1", "k2")

    def segments(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (c, b), g in runs(pdf):
            one = g.iloc[0]
            path = block_path([role_of(r) for r in g["role"]], int(one["before"]), int(one["after"]))
            shown, n_out = render(path, g["text"].tolist(), int(one["before"]), b == one["segments"] - 1)
            out.append((c, b, one["segments"], len(g), n_out, one["cost"], shown))
        return pd.DataFrame(out, columns=["conv", "segment", "segments", "n_in", "n_out", "cost", "text"])

    done = joined.select(bucket, "*").groupBy("bucket").applyInPandas(segments, f"conv {kind}, segment long, segments long, n_in long, n_out long, cost double, text string")
    return done.withColumnRenamed("conv", conv)


def _numbered(rows: DataFrame, work: Workspace) -> DataFrame:
    """(conv, role, k1, k2, rank, block) of the distinct turns: their places in the conversation, from 0.

    Places within range partitions, plus the turns of the conversation in the partitions before. Only the
    first conversation of a partition can have any, so the offsets are one row a partition at most.
    """
    thin = rows.select("conv", "turn", "role", F.substring("text", 1, PREFIX).alias("prefix"), "k1", "k2").distinct()
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("prefix").asc(), F.col("k1").asc(), F.col("k2").asc()]
    ranged = work.keep(thin.repartitionByRange(F.col("conv").asc(), *order).withColumn("pid", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("pid", "conv").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(F.col("pid").alias("p"), F.col("conv").alias("c"), F.sum("n").over(before).alias("offset")).where("offset > 0")
    place = F.row_number().over(Window.partitionBy("pid", "conv").orderBy(*order)) - 1
    placed = ranged.withColumn("place", place).join(F.broadcast(offsets), (F.col("pid") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")), "left")
    rank = (F.col("place") + F.coalesce("offset", F.lit(0))).cast("long").alias("rank")
    return work.keep(placed.select("conv", "role", "k1", "k2", rank).withColumn("block", F.floor(F.col("rank") / BLOCK)), "turns")


def _states(each: DataFrame, kind: str, work: Workspace) -> DataFrame:
    """(conv, block, before, after, segments, cost) from the matrices of all blocks, numbered from 0."""
    matrices = f"conv {kind}, block long, costs array<double>"

    def bucketed(df: DataFrame, *keys) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(max(1, df.count() // GROUP_ROWS))))

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        grouped = pdf.sort_values("block").groupby(["conv", "up"], dropna=False, sort=False)
        return pd.DataFrame([(c, u, product([list(m) for m in g["costs"]])) for (c, u), g in grouped], columns=["conv", "block", "costs"])

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c, g in pdf.sort_values("block").groupby("conv", dropna=False, sort=False):
            path, cost = fold([list(m) for m in g["costs"]])
            out += [(c, b, path[i], path[i + 1], cost) for i, b in enumerate(g["block"])]
        return pd.DataFrame(out, columns=["conv", "block", "before", "after", "cost"])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (c, _), g in pdf.sort_values("block").groupby(["conv", "up"], dropna=False, sort=False):
            path, _ = fold([list(m) for m in g["costs"]], int(g["before"].iloc[0]), int(g["after"].iloc[0]))
            out += [(c, b, path[i], path[i + 1], g["cost"].iloc[0]) for i, b in enumerate(g["block"])]
        return pd.DataFrame(out, columns=["conv", "block", "before", "after", "cost"])

    up = F.floor(F.col("block") / FAN).alias("up")
    levels = [each]
    while not levels[-1].where(F.col("block") >= FAN).isEmpty():
        grouped = bucketed(levels[-1].select("conv", "block", "costs", up), "conv", "up").groupBy("bucket")
        levels.append(work.keep(grouped.applyInPandas(combine, matrices), f"costs{len(levels)}"))
    schema = f"conv {kind}, block long, before int, after int, cost double"
    states = work.keep(bucketed(levels[-1], "conv").groupBy("bucket").applyInPandas(top, schema), "states")
    for i, lower in enumerate(reversed(levels[:-1])):
        known = states.select(F.col("conv").alias("c"), F.col("block").alias("u"), "before", "after", "cost")
        joined = lower.select("conv", "block", "costs", up).join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("u"))).drop("c", "u")
        states = work.keep(bucketed(joined, "conv", "up").groupBy("bucket").applyInPandas(inside, schema), f"states{i}")
    segments = states.groupBy(F.col("conv").alias("c")).agg((F.max("block") + 1).alias("segments"))
    return states.join(segments, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
