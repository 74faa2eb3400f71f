"""Near-duplicate detection with SetSketch registers over 5-word shingles.

1. Each text becomes its set of distinct shingle hashes (64 bit); texts with equal sets collapse
   into one node, so exact copies never meet pairwise.
2. A node's SetSketch has ``REGISTERS`` registers: the minimum of an exponential variable per
   register, truncated to powers of BASE. Registers are mergeable by maximum, and equal in two
   sets with a probability of about their Jaccard similarity J.
3. ``BANDS`` bands of ``ROWS`` registers propose candidates: a pair with J = 0.75 shares no band
   with probability (1 - 0.75**5)**56 = 2.6e-7.
4. Candidates are estimated by maximum likelihood over all registers, with both set sizes known
   exactly. Estimates under ``KEEP_FROM`` (five standard errors below the threshold) are not
   verified; all others are, on the full sets.
5. Every bucket proposes links of its members to one centre first: the best of each member, then,
   for ``STAR_ROUNDS`` rounds, the best between any two components found so far. Only pairs whose ends are
   then still in different components are looked at again: all of them in buckets of at most ``SMALL`` nodes.
   For the nodes of larger buckets an exact prefix join (shingles in order of rarity; bounds from
   positions, from the shingles that no other component has, and from a parity bitmap) finds the pairs that can reach 0.75. So
   groups of thousands of copies cost a star, not a clique, and no bucket is capped.

Defined results: null or blank texts have an empty set, n_shingles 0 and link to nothing; a null
id takes part, its component is the smallest id reachable and it is never kept; rows that repeat an
id and text are one component, and each of them is kept if its id is the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import U64, Workspace, block_words, join_skewed, mix64, text_blocks, tidy
from matchloom.llm.components import connected

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 5, 56
REGISTERS = ROWS * BANDS
BASE, RATE, LIMIT = 1.001, 20.0, 65534
KEEP_FROM = PERCENT / 100 - 5 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5
#: Nodes of a bucket up to which its open pairs are listed directly.
SMALL = 16
STAR_ROUNDS = 2
#: Words (64 bits) of the parity bitmap of a set.
PARITY = 4
#: Buckets of text hashes whose list is broadcast to narrow a scan (at most 16 MB).
SIEVE = 1 << 20

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * U64(2) + _rng.integers(0, 2, REGISTERS, dtype=np.uint64)
_W = [U64(int(x) | 1) for x in _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64)]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, whole texts."""
    with np.errstate(over="ignore"):
        for _, offsets, data in text_blocks(texts):
            words, bounds = block_words(offsets, data)
            n = max(0, len(words) - SHINGLE + 1)
            rolled = np.zeros(n, U64)
            for k, w in enumerate(_W):
                rolled += words[k : k + n] * w
            rolled = mix64(rolled)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a >= SHINGLE:
                    yield np.unique(rolled[a : b - SHINGLE + 1])
                elif b > a:
                    short = np.zeros(1, U64)
                    for k in range(b - a):
                        short += words[a + k] * _W[k]
                    yield mix64(short + U64(b - a))
                else:
                    yield np.empty(0, U64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of 64-bit hashes; all zero for the empty set."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, 2**64 - 1, U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            block = shingles[None, at : at + 1024] * _A[:, None]
            block += _B[:, None]
            np.minimum(low, block.min(axis=1), out=low)
    x = -np.log1p(-(low.astype(float) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys of an array of sketches."""
    with np.errstate(over="ignore"):
        out = np.zeros((len(sketches), BANDS), U64)
        parts = sketches.reshape(-1, BANDS, ROWS).astype(U64)
        for k in range(ROWS):
            out = mix64(out + parts[:, :, k] + U64(k + 1))
        return mix64(out + np.arange(BANDS, dtype=U64)[None, :] * U64(0xC2B2AE3D27D4EB4F))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of sketch rows a and b of sets of na and nb."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.minimum(u / v, v / u) * np.linspace(0.3, 1.0, 71)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * grid), p(v - u * grid)
    like = up * np.log(more + 1e-9) + down * np.log(less + 1e-9) + same * np.log(np.maximum(1 - more - less, 1e-9))
    return grid[np.arange(len(grid)), like.argmax(1)]


@tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, h1, h2, sketch = [], [], [], []
        with np.errstate(over="ignore"):
            for s in shingle_sets(batch.column(3)):
                n.append(len(s))
                h1.append(s.sum(dtype=U64) if len(s) else U64(0))
                h2.append(mix64(s ^ U64(0xABCDEF)).sum(dtype=U64) if len(s) else U64(0))
                sketch.append(registers(s).tobytes() if len(s) else b"")
        column = lambda x: pa.array(np.array(x, U64).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), column(h1), column(h2), pa.array(sketch, pa.binary())], ["id", "th", "tz", "n", "h1", "h2", "sketch"])


@tidy
def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sketches = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(sketches).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), BANDS)), pa.array(np.repeat(part.column(1).to_numpy(), BANDS))], ["key", "node", "n"])


@tidy
def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [np.empty(0)]
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            keep.append(estimate(a, b, part.column(2).to_numpy().astype(float), part.column(3).to_numpy().astype(float)))
        found = np.concatenate(keep)
        mask = pa.array(found >= KEEP_FROM)
        rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["a", "b", "j"])
        yield rows.filter(mask)


@tidy
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


@tidy
def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, s in enumerate(shingle_sets(batch.column(3))):
            node, n, label = (batch.column(c)[i].as_py() for c in range(3))
            parity = np.packbits(np.bincount((s % U64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1).view(np.int64)
            same = [pa.array(np.full(len(s), x)) for x in (node, n, label, *parity)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(s.view(np.int64))], ["node", "n", "label", *_PARITY, "shingle"])


_PARITY = [f"p{i}" for i in range(PARITY)]


def sizes_allow(a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def reaches(overlap, na: str, nb: str):
    """Whether an overlap of two sets of na and nb makes for enough similarity."""
    return overlap * (100 + PERCENT) >= (F.col(na) + F.col(nb)) * PERCENT


class _Finder:
    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        self.work = Workspace(docs.sparkSession, "near")
        self.texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        # Two hashes stand for a text: one is too short for 10^10 of them.
        self.texts = self.texts.withColumns({"th": F.xxhash64("text"), "tz": F.xxhash64(F.lit(7), "text")})
        self.kind = self.texts.schema["id"].dataType.simpleString()

    def run(self) -> DataFrame:
        work = self.work
        rows = work.keep(self.texts.select("id", "th", "tz", "text").mapInArrow(_sketch, f"id {self.kind}, th long, tz long, n long, h1 long, h2 long, sketch binary").withColumn("rid", F.monotonically_increasing_id()), "rows")
        groups = work.keep(rows.where("n > 0").groupBy("h1", "h2").agg(F.min("rid").alias("node"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "tz")).alias("low"), F.count(F.lit(1)).alias("__n")), "groups")
        self.nodes = work.keep(rows.join(groups.select(F.col("node").alias("rid")), "rid").select(F.col("rid").alias("node"), "n", "th", "tz", "sketch"), "nodes")
        open_ = self.buckets()
        labels = self.star_links(open_)
        rest = self.verify(self.estimate(self.open_pairs(open_, labels), "open"), "rest")
        second = connected(self.named(rest, labels).select(F.col("x").alias("a"), F.col("y").alias("b")), work, "second")
        final = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        final = final.join(second.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").withColumn("label", F.coalesce("to", "label"))
        final = work.keep(final.select("h1", "h2", "label", "low", "__n"), "final")
        lowest = work.keep(final.groupBy("label").agg(F.min("low").alias("lowest"), F.count(F.lit(1)).alias("__n")), "lowest")
        named = join_skewed(final.withColumnRenamed("__n", "copies"), lowest, ["label"], final.count()).select("h1", "h2", "lowest", F.col("copies").alias("__n"))
        named = work.keep(named, "lowest-of-groups")
        work.drop_all_but("rows", "lowest-of-groups")  # the result reads no others
        full = join_skewed(rows.select("id", "th", "tz", "n", "h1", "h2").where("n > 0"), named, ["h1", "h2"], rows.count())
        alone = F.struct(F.col("id").isNull().alias("none"), "id", "th", "tz").alias("lowest")
        out = full.select("id", "th", "tz", "n", "lowest").union(rows.where("n = 0").select("id", "th", "tz", "n", alone))
        component = F.col("lowest.id")
        stays = F.col("id").eqNullSafe(component) & (F.col("th") == F.col("lowest.th")) & (F.col("tz") == F.col("lowest.tz"))
        return out.select("id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), stays.alias("stays"))

    def buckets(self) -> DataFrame:
        """Members of the buckets of two or more nodes, with a centre picked by hash."""
        bands = self.nodes.select("node", "n", "sketch").mapInArrow(_band_rows, "key long, node long, n long")
        centres = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node", "n")).alias("c")).where("size > 1")
        centres = centres.select("key", "size", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"))
        return self.work.keep(bands.join(centres, "key"), "buckets")

    def star_links(self, members: DataFrame) -> DataFrame:
        """Components from links to centres that verify."""
        stars = members.where((F.col("node") != F.col("centre")) & sizes_allow("n", "centre_n")).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        stars = self.estimate(stars, "stars")
        both = stars.select("a", "b", "j", F.col("a").alias("x")).union(stars.select("a", "b", "j", F.col("b").alias("x")))
        pairs = both.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("j", "a", "b")).alias("p")).select("p.*").distinct()
        edges = self.verify(pairs, "star")
        labels = connected(edges, self.work, "star")
        for i in range(STAR_ROUNDS):
            stars = stars.join(self.work.again("star-pairs" if i == 0 else f"star{i - 1}-pairs"), ["a", "b"], "left_anti")
            named = self.named(stars, labels).where("x <> y")
            pairs = named.groupBy(F.least("x", "y"), F.greatest("x", "y")).agg(F.max_by(F.struct("a", "b"), F.struct("j", "a", "b")).alias("p")).select("p.*")
            more = self.verify(pairs, f"star{i}")
            edges = edges.union(more)
            labels = connected(edges, self.work, f"star{i}")
        return labels

    @staticmethod
    def named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs with the components x and y of their ends."""
        side = lambda end, name: labels.select(F.col("node").alias(end), F.col("label").alias(name))
        rows = pairs.join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left")
        return rows.withColumns({"x": F.coalesce("x", "a"), "y": F.coalesce("y", "b")})

    def estimate(self, pairs: DataFrame, name: str) -> DataFrame:
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        return self.work.keep(full.mapInArrow(_estimated, "a long, b long, j double"), name)

    def with_text(self, nodes: DataFrame) -> DataFrame:
        """(node, ..., text): the scan of the texts is narrowed by the hash buckets asked for."""
        wanted = nodes.join(self.nodes.select("node", "th", "tz"), "node")
        bucket = F.pmod("th", F.lit(SIEVE))
        sieve = wanted.select(bucket.alias("bucket")).distinct()
        some = self.texts.select("th", "tz", "text").withColumn("bucket", bucket).join(F.broadcast(sieve), "bucket", "left_semi")
        return wanted.join(some.groupBy("th", "tz").agg(F.min("text").alias("text")), ["th", "tz"]).drop("th", "tz")

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        pairs = self.work.keep(pairs.select("a", "b"), f"{name}-pairs")
        texts = self.work.keep(self.with_text(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), f"{name}-texts")
        side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
        full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
        return self.work.keep(full.mapInArrow(_verified, "a long, b long"), f"{name}-edges")

    def open_pairs(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Candidate pairs whose ends are in different components so far."""
        named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = self.work.keep(named.select("key", "size", "node", "n", "label"), "named")
        mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        open_ = self.work.keep(named.join(mixed, "key"), "mixed")
        direct = self.crossing(open_.where(F.col("size") <= SMALL), "key")
        large = open_.where(F.col("size") > SMALL).select("node", "n", "label").distinct()
        if large.isEmpty():
            return direct.distinct()
        return direct.union(self.prefix_pairs(large)).distinct()

    @staticmethod
    def sides(rows: DataFrame, key: str, *more: str) -> tuple[DataFrame, DataFrame]:
        return tuple(rows.select(key, F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("label").alias(f"l{x}"), *[F.col(c).alias(f"{c}{x}") for c in more]) for x in "ab")

    @classmethod
    def crossing(cls, rows: DataFrame, key: str) -> DataFrame:
        x, y = cls.sides(rows, key)
        return x.join(y, key).where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & sizes_allow("na", "nb")).select("a", "b")

    def prefix_pairs(self, nodes: DataFrame) -> DataFrame:
        """Pairs of different components that can reach the threshold, from an exact prefix join.

        In order of (document frequency, hash), two sets that reach it share one of the first
        n - ceil(0.75 n) + 1 shingles of either; at the first that they share, what follows bounds the
        overlap, and so does the number of a set's shingles that occur in another set at all.
        """
        kinds = "".join(f"{p} long, " for p in _PARITY)
        rows = self.with_text(nodes).select("node", "n", "label", "text").mapInArrow(_shingle_rows, f"node long, n long, label long, {kinds}shingle long")
        rows = self.work.keep(rows, "shingles")
        # A shingle of one component only can't be shared by a pair across two.
        often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").drop("x", "y")
        ranked = rows.join(often, "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1)))
        by_node = Window.partitionBy("node")
        ranked = ranked.withColumn("place", F.row_number().over(by_node.orderBy("often", "shingle"))).withColumn("common", F.count(F.when(F.col("often") > 1, 1)).over(by_node))
        longest = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
        heads = ranked.where((F.col("place") <= longest) & (F.col("often") > 1) & (F.col("common") * 100 >= F.col("n") * PERCENT))
        x, y = self.sides(self.work.keep(heads, "prefixes"), "shingle", "place", "common", *_PARITY)
        left = 1 + F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb"))
        differ = sum((F.bit_count(F.col(f"{p}a").bitwiseXOR(F.col(f"{p}b"))) for p in _PARITY), F.lit(0))
        at_most = F.floor((F.col("na") + F.col("nb") - differ) / 2)
        good = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & sizes_allow("na", "nb")
        for bound in (F.least("commona", "commonb"), left, at_most):
            good = good & reaches(bound, "na", "nb")
        return x.join(y, (x.shingle == y.shingle) & good).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. See the module's text."""
    return _Finder(docs, doc_id, text).run().drop("th", "stays").withColumnRenamed("id", doc_id)


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component one, that of the smallest id (a null id last,
    then by a text hash). All columns are those of ``docs``."""
    found = _Finder(docs, doc_id, text).run().where("stays").groupBy(F.xxhash64("id").alias("__k"), F.col("th").alias("__th")).agg(F.lit(1).alias("__n"), F.count(F.lit(1)).alias("__rows"))
    return rows_for(docs, doc_id, text, Workspace(docs.sparkSession, "stay").keep(found, "found"))


def rows_for(docs: DataFrame, doc_id: str, text: str, counts: DataFrame) -> DataFrame:
    """Each distinct (id, text) of ``docs`` as often as ``counts`` (__k, __th: hashes of both; __n; __rows:
    rows that share them) says.

    One shuffle of the texts to a hash join, so that they needn't be sorted; only where rows repeat
    an id and a text are they sorted, and one of each kept before the shuffle.
    """
    wanted = counts.where("__n > 0")
    # The columns go by number meanwhile: whatever they are called, none clashes with those added here.
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, body = (F.col(f"c{names.index(c)}") for c in (doc_id, text))
    rows = plain.withColumns({"__k": F.xxhash64(key), "__th": F.xxhash64(F.coalesce(body, F.lit("")))})
    if not wanted.where("__rows > 1").isEmpty():
        one = F.min_by(F.struct(*plain.columns), F.xxhash64(*plain.columns)).alias("one")
        rows = rows.groupBy("__k", "__th").agg(one).select("__k", "__th", "one.*")
    rows = rows.join(wanted.hint("shuffle_hash"), ["__k", "__th"])
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long"))))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
