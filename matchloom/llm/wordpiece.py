"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie over bytes. For each node, ``pops`` is the number of tokens that greedy matching is
certain to give off when the text leaves the node, and ``fail`` the node of what is then left to
match, so a word's count takes one step a byte and no pieces are built. A word is a run of
``[^\\x20\\x09-\\x0D]`` with one blank before it; vocabularies must hold every single byte, so every word has
a count. The distinct words of a block step through the automaton together.

Defined results: null and empty texts have 0 words and tokens; texts and words of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import U64, HashIndex, block_words, once, text_blocks, word_hashes

#: Words longer than this step on their own: rounds for all would be as many as the longest has bytes.
LONG = 64


class Automaton:
    def __init__(self, vocabulary: list[bytes]):
        missing = {bytes([b]) for b in range(256)} - set(vocabulary)
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        children: list[dict[int, int]] = [{}]
        token = [False]
        for entry in vocabulary:
            node = 0
            for byte in entry:
                to = children[node].get(byte)
                if to is None:
                    to = children[node][byte] = len(children)
                    children.append({})
                    token.append(False)
                node = to
            token[node] = True
        fail, pops = [0] * len(children), [0] * len(children)
        level = [0]
        while level:  # breadth first, so that links point to nodes that are done
            following = []
            for node in level:
                for byte, child in children[node].items():
                    following.append(child)
                    if token[child]:
                        fail[child], pops[child] = 0, 1
                        continue
                    at, count = fail[node], pops[node]
                    while byte not in children[at]:
                        count += pops[at]
                        at = fail[at]
                    fail[child], pops[child] = children[at][byte], count
            level = following
        self.children = children
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        # What is left at a word's end: tokens given off on the way back to the root.
        rest = np.zeros(len(children), np.int32)
        for node in self._by_depth():
            if node:
                rest[node] = pops[node] + rest[fail[node]]
        self.rest = rest
        keys = [(node << 8) | byte for node, c in enumerate(children) for byte in c]
        self.index = HashIndex(np.array(keys, U64))
        self.targets = np.array([to for c in children for to in c.values()], np.int32)

    def _by_depth(self) -> Iterator[int]:
        level = [0]
        while level:
            yield from level
            level = [c for node in level for c in self.children[node].values()]

    def count_one(self, word: bytes) -> int:
        node = total = 0
        children, fail, pops = self.children, self.fail, self.pops
        for byte in word:
            while byte not in children[node]:
                total += int(pops[node])
                node = int(fail[node])
            node = children[node][byte]
        return total + int(self.rest[node])

    def count_many(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of words in a byte array, each with a blank put before it."""
        total = np.zeros(len(starts), np.int64)
        for i in np.flatnonzero(lengths > LONG):
            total[i] = self.count_one(b" " + data[starts[i] : starts[i] + lengths[i]].tobytes())
        live = np.flatnonzero(lengths <= LONG)
        node = np.full(len(live), self.children[0][32], np.int32)
        place = 0
        while len(live):
            over = lengths[live] <= place
            if over.any():
                total[live[over]] += self.rest[node[over]]
                live, node = live[~over], node[~over]
                if not len(live):
                    break
            byte = data[starts[live] + place].astype(U64)
            todo = np.arange(len(live))
            while len(todo):
                at = self.index.find((node[todo].astype(U64) << U64(8)) | byte[todo])
                go = at >= 0
                node[todo[go]] = self.targets[at[go]]
                todo = todo[~go]
                total[live[todo]] += self.pops[node[todo]]
                node[todo] = self.fail[node[todo]]
                done = np.zeros(len(live), bool)
                done[todo] = True
                todo = np.flatnonzero(done)
            place += 1
        return total


def text_counts(texts: pa.Array, automaton: Automaton) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and tokens of each text, a block at a time."""
    for _, offsets, data in text_blocks(texts):
        with np.errstate(over="ignore"):
            hashes, bounds = block_words(offsets, data, lower=False)
            # The words' places in the block itself: texts are joined there without a blank.
            spaced = np.full(len(data) + len(offsets) - 1, 32, np.uint8)
            spaced[np.arange(len(data)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = data
            _, starts = word_hashes(spaced, lower=False)
        solid = (spaced != 32) & ((spaced < 9) | (spaced > 13))
        ends = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
        _, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        counts = automaton.count_many(spaced, starts[first], (ends - starts)[first])[where]
        sums = np.append(0, np.cumsum(counts))
        yield np.diff(bounds), sums[bounds[1:]] - sums[bounds[:-1]]


def count_tokens(df: DataFrame, text: str, vocabulary: list[bytes]) -> DataFrame:
    """``df`` (without ``text``) with n_words and n_tokens. The vocabulary is broadcast; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    keep = [f for f in df.schema.fields if f.name not in (text, "n_words", "n_tokens")]
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, keep, strict=True)), "n_words long, n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = once(shared, lambda: Automaton(shared.value))
        for batch in batches:
            found = list(text_counts(batch.column(batch.num_columns - 1), automaton))
            both = [pa.array(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64), pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *both], [*names, "n_words", "n_tokens"])

    columns = [F.col(f"`{f.name}`").alias(n) for n, f in zip(names, keep, strict=True)]
    done = df.select(*columns, F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
    return done.select(*[F.col(n).alias(f.name) for n, f in zip(names, keep, strict=True)], "n_words", "n_tokens")
