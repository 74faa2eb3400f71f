"""Byte-level BPE over length-bucketed padded matrices.

The distinct pieces of a batch that no earlier batch of the worker has met are put into matrices of
equal padded length. In each round every row merges its leftmost pair of minimum rank; pair ranks
come from a hash table probed for the whole matrix, and rows are compacted after each round. Rows
without a mergeable pair leave the matrix. Texts are then put together from the pieces' ids.

Null texts count as empty (no tokens); texts of any length are encoded whole. Rows with equal
texts get equal results; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Length classes of pieces. A piece beyond the last takes a heap of its own: its rounds in a
#: matrix would cost the square of its length.
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256)
#: Cells of one matrix, so that a batch of long pieces stays small in memory.
CELLS = 1 << 20
#: Pieces, and bytes of pieces, that a worker remembers. Beyond, it starts over.
MEMORY = 250_000
MEMORY_BYTES = 1 << 25


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the token, then its rank, a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in f if x.strip())}


class PairTable:
    """Open addressing table from a pair of token ids to the id that merges them, for numpy probes."""

    def __init__(self, ranks: dict[bytes, int]):
        lefts, rights, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    lefts.append(a), rights.append(b), merged.append(rank)
        keys = (np.array(lefts, np.int64) << 32) | np.array(rights, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):  # each round places one key in every slot that is still free
            self.probes += 1
            spot = slots[left]
            free = self.keys[spot] == -1
            first = np.unique(spot[free], return_index=True)[1]
            put = left[free][first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], np.array(merged, np.int32)[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids for pairs; NO_RANK where they don't merge. Negative ids never merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NO_RANK, np.int32)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(keys.ravel()[live])
        for _ in range(self.probes):
            if not len(live):
                break
            found = self.keys[slot]
            hit = found == keys.ravel()[live]
            out.ravel()[live[hit]] = self.values[slot[hit]]
            more = ~hit & (found != -1)
            live, slot = live[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out


NO_RANK = np.int32(2**31 - 1)


class Encoder:
    """Encodes pieces (bytes) to id lists by the ranks; keeps what it has met within MEMORY."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.bytes = 0

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = [rank]
            elif piece:
                n = len(piece)
                if n > BUCKETS[-1]:
                    out[i] = self._merge_long(piece)
                else:
                    classes.setdefault(next(b for b in BUCKETS if n <= b), []).append(i)
        for width, members in classes.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                chunk = members[at : at + step]
                for i, ids in zip(chunk, self._merge([pieces[i] for i in chunk], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        length = np.array([len(p) for p in pieces])
        ids = self.byte_ids[raw]
        ids[np.arange(width) >= length[:, None]] = -1
        rank = self.pairs.lookup(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        done: list[list[int]] = [[]] * len(pieces)
        while len(rows):
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(rows)), best]
            ended = low == NO_RANK
            if ended.any():
                for r, line, n in zip(rows[ended], ids[ended].tolist(), length[ended], strict=True):
                    done[r] = line[:n]
                go = ~ended
                rows, ids, rank, length, best, low = rows[go], ids[go], rank[go], length[go], best[go], low[go]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            # Compaction: what stands right of the merged pair moves one cell to the left.
            cells = np.arange(ids.shape[1])[None, :]
            source = np.minimum(cells + (cells > best[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[at, best] = low
            length = length - 1
            ids[at, length] = -1
            cells = cells[:, :-1]
            source = np.minimum(cells + (cells > best[:, None]), rank.shape[1] - 1)
            rank = np.take_along_axis(rank, source, axis=1)
            rank[:, -1] = NO_RANK
            # Only the two pairs that touch the merged token have new ranks.
            right = np.minimum(best + 1, ids.shape[1] - 1)
            fits = best < rank.shape[1]
            rank[at[fits], best[fits]] = self.pairs.lookup(ids[at, best], ids[at, right])[fits]
            inner = best > 0
            rank[at[inner], best[inner] - 1] = self.pairs.lookup(ids[at[inner], best[inner] - 1], ids[at[inner], best[inner]])
            widest = int(length.max())
            if widest < ids.shape[1] and widest >= 2:
                ids, rank = ids[:, :widest], rank[:, : widest - 1]
            elif widest < 2:
                ids, rank = ids[:, :2], rank[:, :1]
        return done

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges in the same order, from a heap of (rank, place) over a linked list."""
        ids: list[int] = [self.ranks[bytes([b])] for b in piece]
        parts: list[bytes | None] = [bytes([b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (rank := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            parts[i], ids[i], parts[j] = parts[i] + parts[j], rank, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [ids[i] for i in range(n) if parts[i] is not None]

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > MEMORY or self.bytes > MEMORY_BYTES:
            self.known.clear()
            self.bytes = 0
        fresh = [p for p in pieces if p not in self.known]
        self.bytes += sum(map(len, fresh))
        coded = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh])
        for piece, ids in zip(fresh, coded, strict=True):
            self.known[piece] = (len(ids), " ".join(map(str, ids)), self.decode(ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_ENCODERS: dict[int, tuple] = {}


def _encoder(ranks) -> Encoder:
    """One encoder per worker and broadcast."""
    key = id(ranks)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = (ranks, Encoder(ranks.value if hasattr(ranks, "value") else ranks))
    return _ENCODERS[key][1]


def digests(texts: list[str | None], encoder: Encoder, splitter) -> Iterator[tuple[int, str, str]]:
    """For each text: number of tokens, SHA-256 of its ids, SHA-256 of what its ids decode to."""
    group: list[list[str]] = []
    size = 0

    def flush():
        encoder.learn({p for pieces in group for p in pieces} if len(group) > 1 else set(group[0]))
        known = encoder.known
        for pieces in group:
            rows = [known[p] for p in pieces]
            yield (
                sum([r[0] for r in rows]),
                hashlib.sha256(" ".join([r[1] for r in rows]).encode()).hexdigest(),
                hashlib.sha256(b"".join([r[2] for r in rows])).hexdigest(),
            )

    for text in texts:
        group.append(splitter(text) if text else [])
        size += len(group[-1])
        if size >= 100_000:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def encode_frame(df: DataFrame, text: str, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of the column ``text``.

    The ranks (a vocabulary file, of fixed size) are broadcast. Map-side only: no shuffle. Columns
    of ``df`` that bear one of the three names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(keep + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    at = [f.name for f in keep].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        splitter, encoder = regex.compile(pattern).findall, _encoder(shared)
        for batch in batches:
            found = list(digests(batch.column(at).to_pylist(), encoder, splitter))
            counts, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            extra = [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    return df.select(*[f"`{f.name}`" for f in keep]).mapInArrow(run, schema)


def encode_texts(df: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, out: str = "ids") -> DataFrame:
    """The general form: ``df`` with an array column ``out`` of token ids."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    at = [f.name for f in schema.fields].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        splitter, encoder = regex.compile(pattern).findall, _encoder(shared)
        for batch in batches:
            ids = []
            for value in batch.column(at).to_pylist():
                pieces = splitter(value) if value else []
                encoder.learn(set(pieces))
                ids.append([int(i) for p in pieces for i in encoder.known[p][1].split()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, out])

    return df.select(*[f"`{f.name}`" for f in schema.fields[:-1]]).mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str, ranks: dict[bytes, int], out: str = "decoded") -> DataFrame:
    """``df`` with a binary column ``out``: the bytes its id arrays stand for (null for null)."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.BinaryType())])
    at = [f.name for f in schema.fields].index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            found = [None if v is None else encoder.decode(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, out])

    return df.select(*[f"`{f.name}`" for f in schema.fields[:-1]]).mapInArrow(run, schema)
