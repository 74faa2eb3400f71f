"""Text embeddings behind a cache keyed by text hash and model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import normalize, text_hash


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic unit vectors from hashed words, for where no text model is installed."""

    def encode(texts: list[str]) -> list[list[float]]:
        words = [t.split() for t in texts]
        # Each distinct word of a batch is hashed once; all texts are summed in one go.
        at = {w: i for i, w in enumerate(dict.fromkeys(w for t in words for w in t))}
        hashes = np.array([int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big") for w in at] or [0], np.uint64)
        place, sign = (hashes % np.uint64(dim)).astype(np.int64), np.where(hashes >> np.uint64(63), 1.0, -1.0)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in words])
        word = np.fromiter((at[w] for t in words for w in t), np.int64, len(row))
        sums = np.bincount(row * dim + place[word], sign[word], len(texts) * dim).reshape(len(texts), dim)
        return unit_rows(sums).tolist()

    return encode


def unit_rows(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=x.astype(float), where=length > 0)


def pooled_embedder(open_session: Callable, open_tokenizer: Callable, batch: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors from a transformer: the mean of its last states over the tokens that are text.

    ``open_session`` returns an ONNX session (input_ids, attention_mask and, where asked for, token_type_ids in; states
    first out), ``open_tokenizer`` a tokenizer with padding on; both are opened once in a worker, when first needed.
    """
    kept: dict = {}

    def encode(texts: list[str]) -> list[list[float]]:
        if not kept:
            kept.update(session=open_session(), tokenizer=open_tokenizer())
        asked = [i.name for i in kept["session"].get_inputs()]
        out: list[list[float]] = []
        for lo in range(0, len(texts), batch):
            read = kept["tokenizer"].encode_batch(list(texts[lo : lo + batch]))
            mask = np.array([e.attention_mask for e in read], np.int64)
            feed = {"input_ids": np.array([e.ids for e in read], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            states = np.asarray(kept["session"].run(None, {k: feed[k] for k in asked})[0], float)
            summed = (states * mask[:, :, None]).sum(1)
            out += unit_rows(summed / np.maximum(mask.sum(1, keepdims=True), 1)).tolist()
        return out

    return encode


def onnx_embedder(model: str, tokenizer: str, batch: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """``pooled_embedder`` over files of an ONNX model and its tokenizer, on a path that every worker can open."""

    def open_session():
        import onnxruntime

        return onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])

    def open_tokenizer():
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(tokenizer)
        found.enable_padding()
        return found

    return pooled_embedder(open_session, open_tokenizer, batch)


def dimension(cache: DataFrame, model: str) -> int | None:
    """The length of a model's cached vectors; None without any."""
    row = cache.where(F.col("model_name") == model).select(F.size("embedding")).first()
    return None if row is None else row[0]


def missing(texts: DataFrame, cache: DataFrame, text: str, model: str) -> DataFrame:
    """(text_hash, text): distinct normalised texts that the model's cache lacks."""
    asked = texts.select(text_hash(text).alias("text_hash"), normalize(text).alias("text")).dropDuplicates(["text_hash"])
    return asked.join(cache.where(F.col("model_name") == model).select("text_hash"), "text_hash", "left_anti")


def embed(texts: DataFrame, cache: DataFrame, text: str, model: str, encode: Callable[[list[str]], list[list[float]]]) -> tuple[DataFrame, DataFrame]:
    """``texts`` with ``embedding``, and the rows that the cache gains."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"text_hash": pdf["text_hash"], "model_name": model, "embedding": encode(pdf["text"].tolist())})

    fresh = missing(texts, cache, text, model).mapInPandas(run, "text_hash string, model_name string, embedding array<float>")
    known = cache.where(F.col("model_name") == model).select("text_hash", "embedding").unionByName(fresh.select("text_hash", "embedding"))
    return texts.withColumn("text_hash", text_hash(text)).join(known, "text_hash", "left"), fresh
