"""Requests for recommendations: validated records, as rows ready to be paired with profiles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions import tags as tg
from matchloom.functions import vocab
from matchloom.functions.text import item_text
from matchloom.operators.pairs import prepare_items
from matchloom.schemas import STRING, STRINGS, fields
from matchloom.sources.feeds import strict_tier

LISTS = "artist_genres genres subgenres activities countries languages tempos moods"
#: What a request may say of an item to place; ``tier`` restricts the targets, ``extra`` holds numbers.
SCHEMA = T.StructType(
    fields("item_id item_name artist album", STRING)
    + fields("popularity", T.DoubleType())
    + fields("tier", T.IntegerType())
    + [T.StructField("extra", T.MapType(STRING, STRING))]
    + fields(LISTS, STRINGS)
)


def request(item_id: str, **given) -> dict:
    """A row of SCHEMA: what isn't given is empty, names and the tier are checked, numbers become text."""
    if unknown := set(given) - set(SCHEMA.names):
        raise TypeError(f"not in a request: {', '.join(sorted(unknown))}")
    empty = {f.name: [] if f.dataType == STRINGS else {} if f.name == "extra" else None for f in SCHEMA.fields}
    row = empty | {"item_name": "", "artist": ""} | given | {"item_id": item_id, "tier": strict_tier(given.get("tier"))}
    return row | {"extra": {k: str(v) for k, v in row["extra"].items()}}


def frame(spark: SparkSession, requests: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[n] for n in SCHEMA.names) for r in requests], SCHEMA)


def prepare(requests: DataFrame, embeddings: DataFrame, columns: list[str], words: vocab.Vocabulary = vocab.MUSIC) -> DataFrame:
    """Request rows as prepared items: numbers from ``extra``; tags from the item's text and all its
    labels; asked_tags from the labels that the request itself gives, and its artist's, when it gives any.

    ``embeddings`` has item_id and embedding.
    """
    text = item_text(F.col("item_name"), F.col("artist"), ["artist_genres", "genres", "subgenres"], F.array_sort(tg.attributes("languages")), F.array_sort(tg.attributes("moods")))
    own = tg.labels_tags("genres", "subgenres", words=words)
    asked = F.when(F.size(own) > 0, F.array_sort(F.array_union(own, tg.labels_tags("artist_genres", words=words)))).otherwise(F.array().cast("array<string>"))
    every = F.array_sort(F.array_distinct(F.concat(tg.tag(text, words), tg.labels_tags("artist_genres", "genres", "subgenres", words=words))))
    rows = requests.join(embeddings.select("item_id", "embedding"), "item_id", "left")
    rows = rows.withColumns({"item_text": text, "item_tags": every, "asked_tags": asked} | {c: F.try_element_at("extra", F.lit(c)).try_cast("double") for c in columns})
    attributes = ["activities", "countries", "languages", "tempos", "moods"]
    rows = rows.withColumnsRenamed({a: f"item_{a}" for a in attributes})
    return prepare_items(rows, columns, words)


def with_urls(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Results with the URL of each target; null where it isn't known."""
    return results.join(targets.select("target_id", "target_url"), "target_id", "left")


def candidates(targets: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Some columns of the first targets by id."""
    return targets.select(*[c for c in columns if c in targets.columns]).orderBy("target_id").limit(limit)


#: One request for each of these labels shows what a model recommends.
SAMPLES = ["Pop", "Hip-Hop", "Country", "Electronic", "Latin", "Folk"]


def samples() -> list[dict]:
    return [request(f"sample-{g.lower()}", item_name=f"{g} sample", genres=[g]) for g in SAMPLES]


def as_json(results: DataFrame) -> str:
    """Ranked results of a few requests as JSON; an empty list without any."""
    order = [c for c in ("item_id", "rank") if c in results.columns]
    return json.dumps([r.asDict() for r in results.orderBy(*order).collect()])
