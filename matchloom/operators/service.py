"""A trained model with its profiles, kept ready to answer requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import vocab
from matchloom.functions.text import item_text
from matchloom.operators import embed, model, requests, rerank, training
from matchloom.settings import Settings
from matchloom.sources.tables import Store


class Service:
    """What ``training.train`` left in a store: the ranker, the profiles and the columns they were made with.

    Profiles are read once and kept. ``encode`` turns texts into vectors of the trained dimension.
    """

    def __init__(self, store: Store, settings: Settings = Settings(), words: vocab.Vocabulary = vocab.MUSIC, encode: Callable | None = None):
        about = store.read_state("service")
        if not about:
            raise FileNotFoundError(f"nothing was trained in {store.root}")
        self.store, self.settings, self.words = store, settings, words
        self.columns, self.dim = about["columns"], about["dim"]
        self.ranker = model.Ranker.load(store)
        self.encode = encode or embed.hashing_embedder(self.dim)
        self.profiles = store.read("profiles").cache()

    def prepare(self, rows: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """Rows of ``requests.SCHEMA`` ready to be paired; ``vectors`` (item_id, embedding), else from their texts."""
        if vectors is None:
            text = item_text(F.col("item_name"), F.col("artist"), ["artist_genres", "genres", "subgenres"], F.array_sort("languages"), F.array_sort("moods"))
            cache = self.store.spark.createDataFrame([], "text_hash string, model_name string, embedding array<float>")
            vectors, _ = embed.embed(rows.select("item_id", text.alias("text")), cache, "text", "requests", self.encode)
        return requests.prepare(rows, vectors.select("item_id", F.col("embedding").cast("array<double>").alias("embedding")), self.columns, self.words)

    def recommend(self, rows: DataFrame, n: int | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """The best targets of each request by the trained score and the rules, with their URLs."""
        n = self.settings.top_n if n is None else n
        if n <= 0:
            raise ValueError("n must be above 0")
        asked = self.prepare(rows, vectors).drop("genres", "subgenres", "artist_genres", "extra", "item_text")
        best = rerank.recommend(asked, self.profiles, training.scorer(self.ranker, self.columns, self.words), n, self.settings.penalties, self.words, self.settings.hard_tag_filter)
        return requests.with_urls(best, self.profiles) if "target_url" in self.profiles.columns else best.withColumn("target_url", F.lit(None).cast("string"))

    def answer(self, wanted: list[dict], n: int | None = None) -> list[dict]:
        """Ranked rows for a few requests (dictionaries of what they say); bad ones raise."""
        rows = requests.frame(self.store.spark, [requests.request(**w) for w in wanted])
        return [r.asDict() for r in self.recommend(rows, n).orderBy("item_id", "rank").collect()]
