"""Shared helpers: shared-storage tables, table reading, byte-level word hashing.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere in this subpackage. The hashing kernel works on the
raw UTF-8 buffer of a batch, so no Python string is built for any word.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


#: Rows in an Arrow batch: texts can be long, and a worker holds a batch and its arrays at once.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a file of a short table, about.
FILE_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where it is unset and the master is
    local (tests on one machine) a temporary folder is made and set as the session's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="matchloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Workspace:
    """Tables written to shared storage: they cut lineage and survive lost executors.

    ``keep`` returns the rows as read back; ``drop`` removes tables that no later plan reads. A result
    that reads them can't outlive them, so the caller who has written it calls ``release``.
    """

    made: list[Workspace] = []

    def __init__(self, spark: SparkSession, label: str):
        Workspace.made.append(self)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df`` written and read back. With a bound on its rows it makes no more files than they need: short
        tables of many rounds would otherwise be thousands of files."""
        path = f"{self.base}/{name}-{len(self._paths)}"
        (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def again(self, name: str) -> DataFrame:
        """A table kept before, read again."""
        return self.spark.read.parquet(self._paths[name])

    def names(self) -> list[str]:
        return list(self._paths)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self._paths if n not in names])

    @classmethod
    def release(cls, since: int) -> None:
        """Empty all workspaces made after the first ``since``."""
        while len(cls.made) > since:
            done = cls.made.pop()
            done.drop(*done.names())

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


#: Keys that hold more than this share of the rows are broadcast instead of shuffled: at most so many.
HEAVY = 1000


def join_skewed(rows: DataFrame, known: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``known``: a row a key, with the number ``__n`` of ``total`` rows that have the key.

    Rows of keys with more than total / HEAVY of them, of which there are fewer than HEAVY, meet a broadcast;
    only the others are shuffled by key. Without such keys it is a plain join. ``known`` is a kept table.
    """
    heavy = known.where(F.col("__n") * HEAVY > total)
    if heavy.isEmpty():
        return rows.join(known.drop("__n"), keys, how)
    heavy, light = heavy.drop("__n"), known.where(F.col("__n") * HEAVY <= total).drop("__n")
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys, how))


# ------------------------------------------------------------------ byte kernel

_MULT = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element-wise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix64(np.arange(1, 257, dtype=U64) * _MULT)
    if lower:
        codes[65:91] = codes[97:123]
    codes[_SPACE] = 0
    return codes


_CODES = {True: _byte_codes(True), False: _byte_codes(False)}
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        mult = U64(6364136223846793005)
        inverse = U64(pow(6364136223846793005, -1, 1 << 64))
        for key, value in (("up", mult), ("down", inverse)):
            p = np.full(size, value, U64)
            p[0] = U64(1)
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (64 bit) of the words in a byte array, and the byte at which each begins.

    A word's hash is a mixed polynomial over per-byte random codes, from prefix sums modulo 2**64,
    so the whole array takes a handful of vector operations whatever the words are.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        solid = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edge[0::2], edge[1::2]
        up, down = _powers(n)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum(_CODES[lower][data] * up, out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * down[starts]
        return mix64(hashes ^ ((ends - starts).astype(U64) * _MULT)), starts


#: Bytes handled at once by the kernel; a longer single text makes a block of its own.
BLOCK_BYTES = 1 << 20


def text_blocks(texts: pa.Array):
    """Blocks ``(first_row, offsets, bytes)`` of consecutive rows with about BLOCK_BYTES of text.

    ``offsets`` are relative to ``bytes``; a null text has no bytes.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]]
        row = stop


def block_words(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block of texts and ``bounds``: text i has words bounds[i]:bounds[i+1].

    Texts are separated by a blank so that no word crosses two of them.
    """
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    spaced = np.full(len(data) + rows, 32, np.uint8)
    if len(data):
        spaced[np.arange(len(data)) + np.repeat(np.arange(rows), lengths)] = data
    hashes, starts = word_hashes(spaced, lower)
    bounds = np.searchsorted(starts, np.append(offsets[:-1] + np.arange(rows), len(spaced)))
    return hashes, bounds


class HashIndex:
    """Open-addressing index over distinct 64-bit keys for vectorised look-ups."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, U64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(self.keys)) * 2.5))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        spot, left = self._slot(self.keys), np.arange(len(self.keys))
        while len(left):  # each round gives every free slot to one key
            self.probes += 1
            free = self.slots[spot] == -1
            taken, first = np.unique(spot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slots[taken] = left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, spot = left[rest], (spot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the index's keys, -1 where it is absent."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        live, slot = np.arange(len(keys)), self._slot(keys)
        for _ in range(self.probes):
            at = self.slots[slot]
            full = at >= 0
            same = full & (self.keys[np.maximum(at, 0)] == keys[live])
            out[live[same]] = at[same]
            more = full & ~same
            live, slot = live[more], (slot[more] + 1) & ((1 << self.bits) - 1)
            if not len(live):
                break
        return out


class Tally:
    """Counts of 64-bit keys, merged as they come; gives its content away when it grows large."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.size = limit, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> bool:
        """True when the content should be taken."""
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.size += len(self.parts[-1][0])
            if self.size > self.limit:
                self.parts = [self._merged()]
                self.size = len(self.parts[0][0])
        return self.size > self.limit // 2 and len(self.parts) == 1

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, U64), np.empty(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts])
        found, where = np.unique(keys, return_inverse=True)
        return found, np.bincount(where, counts, len(found)).astype(np.int64)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self._merged()
        self.parts, self.size = [], 0
        return out


def tidy(run):
    """A worker's function over batches that gives memory back to the system when it ends: workers
    live on between tasks, beside an executor that may need it then."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every system has the call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


_MADE: dict = {}


def once(key, make):
    """What ``make`` returns, built once in a worker for a broadcast (or other long-lived) object."""
    if id(key) not in _MADE:
        if len(_MADE) > 3:
            _MADE.clear()
        _MADE[id(key)] = (key, make())
    return _MADE[id(key)][1]
