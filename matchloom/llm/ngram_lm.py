"""Language-model scores from a log-frequency Bloom filter.

Training counts all words, and all pairs and triples of adjacent tokens, over all training texts. Every
word, pair or triple that occurs ``LEAST`` times is kept, whatever the size of the input. The filter
holds, for a key of count c, the entries (key, 1) ... (key, q) of its quantised log count q; a reader
probes q = 1, 2, ... until a probe misses. Probabilities are Jelinek-Mercer mixtures of the quantised
relative frequencies with the smoothed word probability (c + 0.5) / (N + 0.5 (V + 1)); the mixture
weights come from EM over a histogram of likelihood ratios gathered from every training token, each
with its own text's occurrence left out.

The filter is made of segments by key hash, built where the counts are and stored as a table, so no key
reaches the driver. A filter of at most ``FILTER_BYTES`` is broadcast. Beyond, the texts are dealt into blocks, the
distinct keys of a block travel to their segments, packed, and the levels found there come back to
the block, as a column of three bytes a token. Both ways give the same levels; nothing is dropped at any
size, what is broadcast is bounded, and the cost a token doesn't grow.

Exact word counts come from a broadcast of the words that make up HEAD_SHARE of the tokens or more
(at most 1 / HEAD_SHARE words) and, for all other words, from a shuffled join on the word's hash.

Null and empty texts have the end token alone. A null document id counts as a training row. Rows
with equal ids are scored one by one. An empty training set gives N = V = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import U64, HashIndex, Tally, Workspace, block_words, mix64, text_blocks, tidy

#: Words from this share of the training tokens on have their exact counts broadcast.
HEAD_SHARE = 2.0**-21
#: Occurrences from which a word, pair or triple is kept.
LEAST = 2
#: Base of the quantisation of counts, bits of the filter for each key, bits set by a key.
BASE, BITS_PER_KEY, BITS_SET = 1.5, 16, 4
#: Training tokens for each segment of the filter; bytes of a filter that is broadcast; bytes that tell the
#: keys of a segment apart.
SEGMENT_TOKENS, FILTER_BYTES, ID_BYTES = 1 << 19, 96 << 20, 5
#: Bytes of the texts of a block whose keys travel together.
BLOCK_OF_TEXTS = 8 << 20
#: Bins of log10 likelihood ratios for EM.
BINS, LOWEST, STEP = 64, -6.0, 0.25

END = U64(0x5851F42D4C957F2D)


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block with one END after each text, and the bounds of the texts."""
    words, bounds = block_words(offsets, data)
    rows = len(bounds) - 1
    out = np.empty(len(words) + rows, U64)
    ends = bounds[1:] + np.arange(rows)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = words
    out[ends] = END
    return out, np.append(0, ends + 1)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * U64(0x9E3779B97F4A7C15) + mix64(b + U64(2)))


def triple_keys(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix64(pair_keys(a, b) * U64(0xD6E8FEB86659FD93) + mix64(c + U64(3)))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> U64(33)) % U64(segments)).astype(np.int64)


def ids_of(keys: np.ndarray) -> np.ndarray:
    """What tells the keys of a segment apart: their low ID_BYTES."""
    return keys & U64((1 << 8 * ID_BYTES) - 1)


def pack(keys: np.ndarray, counts: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    """Rows (segment, ids, counts): a row holds all of the keys that belong to a segment, ID_BYTES each;
    those with a count of 1 make rows of their own, without counts."""
    for some in (counts == 1, counts > 1):
        mine, often = keys[some], counts[some]
        place = segment_of(mine, segments)
        order = np.argsort(place, kind="stable")
        found, first = np.unique(place[order], return_index=True)
        ends = np.append(first, len(order))
        ids = np.ascontiguousarray(mine[order]).view(np.uint8).reshape(-1, 8)[:, :ID_BYTES].tobytes()
        cut = lambda data, width: pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer((ends * width).astype(np.int32).tobytes()), pa.py_buffer(data)])  # noqa: E731, B023
        many = cut(often[order].astype(np.int64).tobytes(), 8) if often.max(initial=1) > 1 else pa.nulls(len(found), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), cut(ids, ID_BYTES), many], ["segment", "ids", "counts"])


def unpack_ids(packed: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, ID_BYTES)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, :ID_BYTES] = data
    return wide.view(U64).ravel()


def unpack(ids: list[bytes], counts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a segment's rows, and their counts."""
    often = [np.ones(len(i) // ID_BYTES, np.int64) if c is None else np.frombuffer(c, np.int64) for i, c in zip(ids, counts, strict=True)]
    found, where = np.unique(unpack_ids(ids), return_inverse=True)
    return found, np.bincount(where, np.concatenate(often), len(found)).astype(np.int64)


def levels_of_counts(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts / LEAST) / np.log(BASE) + 1e-9).astype(np.int64)


def least_of_level(levels: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return LEAST * BASE ** (levels - 1.0)


def _mask(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an entry belongs (before it is taken modulo a size), and its bits of a 64-bit word."""
    h = mix64(ids + U64((q * 0xA0761D6478BD642F) & (2**64 - 1)))
    mask = np.zeros(len(h), U64)
    for i in range(BITS_SET):
        mask |= U64(1) << ((h >> U64(6 * i)) & U64(63))
    return h >> U64(24), mask


def build_segment(ids: np.ndarray, counts: np.ndarray, bits: int = BITS_PER_KEY) -> tuple[np.ndarray, int]:
    """The words (64 bits) of a segment, and its highest level."""
    level = levels_of_counts(counts)
    words = np.zeros(max(1, int(level.sum()) * bits // 64), U64)
    top = int(level.max(initial=0))
    with np.errstate(over="ignore"):
        for q in range(1, top + 1):
            at, mask = _mask(ids[level >= q], q)
            np.bitwise_or.at(words, (at % U64(len(words))).astype(np.int64), mask)
    return words, top


class LogBloom:
    """Quantised counts of keys, in segments."""

    def __init__(self, parts: list[bytes], top: int):
        self.top = top
        self.sizes = np.array([len(p) // 8 for p in parts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.frombuffer(b"".join(parts), U64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 where it is absent."""
        return self.levels_of_ids(ids_of(keys), segment_of(keys, len(self.sizes)))

    def levels_of_ids(self, ids: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Probes go on while they hit."""
        out, live = np.zeros(len(ids), np.uint8), np.arange(len(ids))
        offset, size = self.offsets[segment], self.sizes[segment].astype(U64)
        for q in range(1, self.top + 1):
            if not len(live):
                break
            at, mask = _mask(ids, q)
            hit = (self.words[offset + (at % size).astype(np.int64)] & mask) == mask
            live, ids, offset, size = live[hit], ids[hit], offset[hit], size[hit]
            out[live] = q
        return out


class Model:
    """What the workers need to score: word counts of the head, filter, weights."""

    def __init__(self, head_keys, head_counts, total, types, filter_=None, weights=None):
        order = np.argsort(head_keys)
        self.head_keys, self.head_counts = head_keys[order], head_counts[order]
        self.total, self.types, self.filter, self.weights = total, types, filter_, weights

    @property
    def index(self) -> HashIndex:
        if "_index" not in self.__dict__:
            self._index = HashIndex(self.head_keys)
        return self._index

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_index"}

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Exact counts of head words, 0 for all others."""
        at = self.index.find(hashes)
        return np.where(at >= 0, self.head_counts[np.maximum(at, 0)], 0) if len(self.head_counts) else np.zeros(len(at), np.int64)

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.types + 1))


def grams(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all pairs and triples of tokens of one text, each with the place at which it ends."""
    inside = np.ones(len(h), bool)
    inside[bounds[:-1][bounds[:-1] < len(h)]] = False
    two = np.flatnonzero(inside)
    both = inside.copy()
    both[1:] &= inside[:-1]
    three = np.flatnonzero(both)
    return two, pair_keys(h[two - 1], h[two]), three, triple_keys(h[three - 2], h[three - 1], h[three])


def _tallied(df: DataFrame, keys_of, rows_of, schema: str) -> DataFrame:
    """What ``rows_of`` makes of the keys and counts of all texts, counted within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, offsets, data in text_blocks(batch.column(0)):
                with np.errstate(over="ignore"):
                    if tally.add(keys_of(offsets, data)):
                        yield from rows_of(*tally.take())
        yield from rows_of(*tally.take())

    return df.mapInArrow(tidy(run), schema)


def _counted(df: DataFrame, keys_of) -> DataFrame:
    rows = lambda keys, counts: [pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])]
    return _tallied(df, keys_of, rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _collect(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a table whose number of rows is bounded by a share of the tokens."""
    got = df.select("key", "n").toArrow()
    return got["key"].to_numpy().view(U64), got["n"].to_numpy()


def token_levels(model: Model, h: np.ndarray, bounds: np.ndarray, levels_of) -> np.ndarray:
    """(3, tokens): levels of each token (0 for a head word), of the pair and of the triple that end at it."""
    out = np.zeros((3, len(h)), np.uint8)
    if len(h):
        rare = np.flatnonzero(model.counts(h) == 0)
        two, pairs, three, triples = grams(h, bounds)
        for row, at, keys in ((0, rare, h[rare]), (1, two, pairs), (2, three, triples)):
            out[row, at] = levels_of(keys)
    return out


def _components(model: Model, h: np.ndarray, bounds: np.ndarray, levels: np.ndarray, own: int = 0):
    """For each token: exact count (0 beyond the head), its best known count, the pair and triple estimates,
    and the class of what is known of its history (0: nothing, 1: a kept word, 2: a kept pair). ``own`` is
    what the text itself adds to each count: 1 for a training text, which is left out of its own estimates."""
    exact = model.counts(h)
    n = len(h)
    p2, p3, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int8)
    value = np.where(levels > 0, least_of_level(levels.astype(float)), 0.0)
    one = np.where(exact > 0, exact, value[0])
    if not n:
        return exact, one, p2, p3, known
    kept = value - own >= LEAST
    follows = np.ones(n, bool)
    follows[bounds[:-1][bounds[:-1] < n]] = False
    before = lambda x: np.where(follows, np.concatenate([np.zeros(1, x.dtype), x[:-1]]), 0)
    word = before(one) - own
    known[follows & (word >= LEAST)] = 1
    at = kept[1] & follows
    p2[at] = np.clip((value[1, at] - own) / np.maximum(word[at], 1), 0.0, 1.0)
    # A kept pair that ends at i - 1 is the history of token i, whatever token i is.
    history = before(np.where(kept[1], value[1] * BASE, 0.0))
    known[history > 0] = 2
    at = kept[2] & kept[1] & (history > 0)
    p3[at] = np.clip((value[2, at] - own) / np.maximum(history[at] - own, 1), 0.0, 1.0)
    return exact, one, p2, p3, known


def _bin(ratio: np.ndarray) -> np.ndarray:
    """0 for an estimate of zero, else 1 + the bin of log10(estimate / word probability)."""
    with np.errstate(divide="ignore"):
        x = np.floor((np.log10(ratio) - LOWEST) / STEP)
    return np.where(ratio > 0, 1 + np.clip(x, 0, BINS - 2), 0).astype(np.int64)


def _weights(histogram: np.ndarray) -> list[tuple[float, float, float]]:
    """EM for the weights (word, pair, triple) of each class of history from ratio bins."""
    ratio = np.append(0.0, 10.0 ** (LOWEST + STEP * (np.arange(BINS - 1) + 0.5)))
    out = [(1.0, 0.0, 0.0)]
    for known in (1, 2):
        n = histogram[known]
        parts = [np.ones((BINS, BINS)), np.tile(ratio[:, None], (1, BINS)), np.tile(ratio[None, :], (BINS, 1))][: known + 1]
        w = np.full(len(parts), 1.0 / len(parts))
        for _ in range(60):
            mix = sum(a * p for a, p in zip(w, parts, strict=True))
            share = np.array([(n * a * p / mix).sum() for a, p in zip(w, parts, strict=True)])
            w = (share + 1e-3) / (share + 1e-3).sum()
        out.append(tuple([*w, *[0.0] * (3 - len(w))]))
    return out


def _pack(levels: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [levels[:, a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _unpack(found: list[bytes], bounds: np.ndarray) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.uint8).reshape(3, -1) for x in found], axis=1) if found else np.zeros((3, 0), np.uint8)


def _blocks(batch: pa.RecordBatch, text: int, levels: int | None, model: Model):
    """Blocks of a batch: (first row, token hashes, bounds, levels); levels are probed or read."""
    for row, offsets, data in text_blocks(batch.column(text)):
        with np.errstate(over="ignore"):
            h, bounds = tokens(offsets, data)
            if levels is None:
                found = token_levels(model, h, bounds, model.filter.levels)
            else:
                found = _unpack(batch.column(levels).slice(row, len(offsets) - 1).to_pylist(), bounds)
        yield h, bounds, found


def build_filter(texts: DataFrame, words: DataFrame, total: int, work: Workspace, bits: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """The stored segments (segment, words, top) of the filter, and their number.

    Keys travel packed by segment, ID_BYTES each, in one shuffle; each segment is counted and built at once.
    """
    segments = max(1, -(-total // SEGMENT_TOKENS))

    def keys(offsets, data):
        h, bounds = tokens(offsets, data)
        _, pairs, _, triples = grams(h, bounds)
        return np.concatenate([pairs, triples])

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pack(batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy(), segments)

    schema = "segment int, ids binary, counts binary"
    rows = _tallied(texts, keys, lambda k, n: pack(k, n, segments), schema)
    rows = rows.union(words.where(F.col("n") >= LEAST).select("key", "n").mapInArrow(tidy(of_words), schema))

    def build(found: pa.Table) -> pa.Table:
        ids, counts = unpack(found["ids"].to_pylist(), found["counts"].to_pylist())
        made, top = build_segment(ids[counts >= LEAST], counts[counts >= LEAST], bits)
        return pa.table({"segment": found["segment"].slice(0, 1), "words": pa.array([made.tobytes()], pa.binary()), "top": pa.array([top], pa.int32())})

    return work.keep(rows.groupBy("segment").applyInArrow(build, "segment int, words binary, top int"), "filter"), segments


def collected(stored: DataFrame, segments: int, top: int) -> LogBloom:
    """The whole filter, for one whose size allows."""
    got = {r["segment"]: bytes(r["words"]) for r in stored.select("segment", "words").toLocalIterator()}
    empty = np.zeros(1, U64).tobytes()
    return LogBloom([got.get(i, empty) for i in range(segments)], top)


def with_levels(df: DataFrame, text: str, model: Model, stored: DataFrame, segments: int, work: Workspace) -> DataFrame:
    """``df`` with a column __levels: the levels of each text's tokens, pairs and triples.

    Keys travel: a block sends each distinct key once to its segment, and gets a byte for it back, in order.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    body = names[df.columns.index(text)]
    numbered = work.keep(df.toDF(*names).withColumn("rid", F.monotonically_increasing_id()), "numbered")
    size = numbered.agg(F.coalesce(F.sum(F.octet_length(body).cast("long")), F.lit(0))).first()[0]
    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(max(1, -(-size // BLOCK_OF_TEXTS)))).cast("int"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def in_block(found: pa.Table) -> tuple[pa.Table, list, np.ndarray]:
        """The rows in order, the tokens of their texts, and all their distinct keys by segment."""
        found = found.sort_by("rid")
        parts, keys = [], [np.empty(0, U64)]
        with np.errstate(over="ignore"):
            for _, offsets, data in text_blocks(found[body]):
                h, bounds = tokens(offsets, data)
                parts.append((h, bounds))
                _, pairs, _, triples = grams(h, bounds)
                keys += [h[shared.value.counts(h) == 0], pairs, triples]
        return found, parts, np.unique(np.concatenate(keys))

    def ask(found: pa.Table) -> pa.Table:
        block = found["block"][0].as_py()
        _, _, keys = in_block(found)
        out = pa.Table.from_batches(list(pack(keys, np.ones(len(keys), np.int64), segments))[:1])
        return pa.table({"segment": out["segment"], "block": pa.array([block] * out.num_rows, pa.int32()), "ids": out["ids"]})

    def answer(segment: pa.Table, asked: pa.Table) -> pa.Table:
        known = LogBloom([segment["words"][0].as_py()], segment["top"][0].as_py()) if segment.num_rows else LogBloom([np.zeros(1, U64).tobytes()], 0)
        told = []
        with np.errstate(over="ignore"):
            for packed in asked["ids"].to_pylist():
                ids = unpack_ids([packed])
                told.append(known.levels_of_ids(ids, np.zeros(len(ids), np.int64)).tobytes())
        return pa.table({"block": asked["block"], "segment": asked["segment"], "levels": pa.array(told, pa.binary())})

    def meet(found: pa.Table, told: pa.Table) -> pa.Table:
        found, parts, keys = in_block(found)
        levels = np.zeros(len(keys), np.uint8)
        order = np.argsort(segment_of(keys, segments), kind="stable")
        levels[order] = np.frombuffer(b"".join(told.sort_by("segment")["levels"].to_pylist()), np.uint8)
        packed = []
        with np.errstate(over="ignore"):
            for h, bounds in parts:
                packed += _pack(token_levels(shared.value, h, bounds, lambda k: levels[np.searchsorted(keys, k)]), bounds)
        return pa.table([*[found[n] for n in names], pa.array(packed, pa.binary())], [*names, "__levels"])

    asked = dealt.select("block", "rid", body).groupBy("block").applyInArrow(ask, "segment int, block int, ids binary")
    told = stored.groupBy("segment").cogroup(asked.groupBy("segment")).applyInArrow(answer, "block int, segment int, levels binary")
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields, strict=True))
    met = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(meet, f"{kinds}, __levels binary")
    out = work.keep(met, "levels").toDF(*df.columns, "__levels")
    work.drop("numbered")
    return out


def train(df: DataFrame, text: str, training: Column, work: Workspace, bits: int = BITS_PER_KEY) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table (key, n) of all word counts, and ``df`` (with levels, where the filter is too large
    to be broadcast), from the texts of the rows that are ``training``."""
    sc, texts = df.sparkSession.sparkContext, df.where(training).select(text)
    words = work.keep(_counted(texts, lambda o, d: tokens(o, d)[0]), "words")
    total, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = Model(*_collect(words.where(F.col("n") >= max(1.0, total * HEAD_SHARE))), int(total), int(types))
    stored, segments = build_filter(texts, words, int(total), work, bits)
    size, top = stored.agg(F.coalesce(F.sum(F.length("words")), F.lit(0)), F.coalesce(F.max("top"), F.lit(0))).first()
    small = size <= FILTER_BYTES
    if small:
        model.filter = collected(stored, segments, top)
    else:
        df = with_levels(df, text, model, stored, segments, work)
    shared = sc.broadcast(model)
    read = None if small else 1

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(3 * BINS * BINS, np.int64)
        m = shared.value
        for batch in batches:
            for h, bounds, found in _blocks(batch, 0, read, m):
                _, one, p2, p3, known = _components(m, h, bounds, found, own=1)
                p1 = m.word_probability(one)
                seen += np.bincount((known.astype(np.int64) * BINS + _bin(p2 / p1)) * BINS + _bin(p3 / p1), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["cell", "n"])

    trained = df.where(training).select(text, *([] if small else ["__levels"]))
    cells = trained.mapInArrow(tidy(ratios), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    histogram = np.zeros(3 * BINS * BINS)
    for row in cells:  # at most 3 * BINS * BINS rows
        histogram[row["cell"]] = row["n"]
    model.weights = _weights(histogram.reshape(3, BINS, BINS))
    return model, words, df


def score(df: DataFrame, text: str, model: Model, words: DataFrame, work: Workspace) -> DataFrame:
    """``df`` (without ``text``) with n_tokens, n_known, train_tokens, base_score and score."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    mine = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "__levels"]
    given = "__levels" in df.columns
    keep = [f for f in df.schema.fields if f.name not in (text, *mine)]
    names = [f"k{i}" for i in range(len(keep))]
    fields = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, keep, strict=True)), "n_tokens long, head_known long, head_base double, head_score double, rare array<long>, times array<int>, apart array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = np.array(m.weights)
        lam = np.log10(weights[:, 0])
        for batch in batches:
            n, known_n, base, best, rare, times, apart, cuts = [], [], [], [], [], [], [], [0]
            for h, bounds, found in _blocks(batch, len(names), len(names) + 1 if given else None, m):
                exact, one, p2, p3, known = _components(m, h, bounds, found)
                head = exact > 0
                p1 = m.word_probability(one)
                mixed = weights[known, 0] * p1 + weights[known, 1] * p2 + weights[known, 2] * p3
                starts = bounds[:-1]
                n.append(np.diff(bounds))
                known_n.append(np.add.reduceat(head.astype(np.int64), starts))
                base.append(np.add.reduceat(np.where(head, np.log10(p1), 0.0), starts))
                # Where no kept n-gram speaks for a word beyond the head, its probability is the weight times
                # that of the word, whose exact count the join below brings.
                alone = ~head & (p2 == 0) & (p3 == 0)
                best.append(np.add.reduceat(np.where(alone, lam[known], np.log10(mixed)), starts))
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    beyond = ~head[a:b]
                    keys, where, often = np.unique(h[a:b][beyond], return_inverse=True, return_counts=True)
                    rare.append(keys)
                    times.append(often)
                    apart.append(np.bincount(where, alone[a:b][beyond], len(keys)))
                    cuts.append(cuts[-1] + len(keys))
            cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v)) for v in (cat(rare, U64).view(np.int64), cat(times, np.int32), cat(apart, np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(cat(n, np.int64)), pa.array(cat(known_n, np.int64)), pa.array(cat(base, float)), pa.array(cat(best, float)), *lists], [*names, "n_tokens", "head_known", "head_base", "head_score", "rare", "times", "apart"])

    renamed = df.select(*[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, keep, strict=True)], F.col(f"`{text}`"), *(["__levels"] if given else []))
    parts = work.keep(renamed.mapInArrow(tidy(run), fields).withColumn("rid", F.monotonically_increasing_id()), "parts")
    work.drop(*[n for n in work.names() if n.startswith("levels")])
    rare = parts.select("rid", F.explode(F.arrays_zip("rare", "times", "apart")).alias("w")).select("rid", F.col("w.rare").alias("key"), F.col("w.times").alias("times"), F.col("w.apart").alias("apart"))
    tail = words.where(F.col("n") < max(1.0, model.total * HEAD_SHARE))
    count = F.coalesce(F.col("n"), F.lit(0))
    each = F.log10((count + 0.5) / F.lit(model.total + 0.5 * (model.types + 1)))
    added = rare.join(tail, "key", "left").groupBy("rid").agg(F.sum(each * F.col("times")).alias("rare_base"), F.sum(each * F.col("apart")).alias("rare_score"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).cast("long").alias("rare_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.drop("rare", "times", "apart").join(added, "rid", "left").select(
        *[F.col(n).alias(f.name) for n, f in zip(names, keep, strict=True)],
        "n_tokens",
        (F.col("head_known") + zero("rare_known")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("rare_base")).alias("base_score"),
        (F.col("head_score") + zero("rare_score")).alias("score"),
    )


def fold(doc_id: str) -> Column:
    """crc32 of the id's text modulo 5; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0))


def score_documents(df: DataFrame, doc_id: str, text: str, held_out_fold: int = 1, bits: int = BITS_PER_KEY) -> DataFrame:
    """Train on the rows of all folds but one; score every row. ``bits`` of the filter for each entry."""
    work = Workspace(df.sparkSession, "lm")
    rows = df.select(F.col(doc_id), F.col(text), (fold(doc_id) == held_out_fold).alias("held_out"))
    model, words, rows = train(rows, text, ~F.col("held_out"), work, bits)
    return score(rows, text, model, words, work)
