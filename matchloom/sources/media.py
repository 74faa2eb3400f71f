"""Hooks for media that need libraries or a network: previews, numeric analysis, spoken language.

The functions that do the work are given by the caller; they run on executors, a failure of one item
costs that item only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.tags import language_label
from matchloom.functions.vocab import AUDIO_COLUMNS
from matchloom.sources.feeds import preview_url


#: Calls that one task has under way at once, where they wait for a network.
AT_ONCE = 8


def _per_row(work: Callable, value: str, out: list[str], at_once: int = 1):
    def attempt(key, v):
        try:
            return work(key, v) if v is not None else None
        except Exception:  # one item's failure leaves its values null
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                found = pool.map(attempt, pdf["item_id"], pdf[value]) if at_once > 1 else map(attempt, pdf["item_id"], pdf[value])
                rows = [(key, *[None if got is None else got.get(c) for c in out]) for key, got in zip(pdf["item_id"], found, strict=True)]
                yield pd.DataFrame(rows, columns=["item_id", *out])

    return run


def resolve_previews(items: DataFrame, ask: Callable[[str, str], str]) -> DataFrame:
    """``items`` with preview_url: what they have, else what a service answers for their item_url.

    ``ask`` takes an id and a URL and returns the payload as text; failures and empty answers leave null.
    """
    todo = items.where("preview_url is null and item_url is not null").select("item_id", "item_url").dropDuplicates(["item_id"])
    told = todo.mapInPandas(_per_row(lambda key, url: {"payload": ask(key, url)}, "item_url", ["payload"], AT_ONCE), "item_id string, payload string")
    told = told.select("item_id", preview_url("payload").alias("__found"))
    return items.join(told, "item_id", "left").withColumn("preview_url", F.coalesce("preview_url", "__found")).drop("__found")


def download(items: DataFrame, fetch: Callable[[str, str], dict], cached: DataFrame | None = None) -> DataFrame:
    """(item_id, content): previews fetched from preview_url, unless ``cached`` has the item."""
    todo = items.select("item_id", "preview_url").where("preview_url is not null").dropDuplicates(["item_id"])
    if cached is not None:
        todo = todo.join(cached.select("item_id"), "item_id", "left_anti")
    fresh = todo.mapInPandas(_per_row(fetch, "preview_url", ["content"], AT_ONCE), "item_id string, content binary").where("content is not null")
    return fresh if cached is None else cached.select("item_id", "content").unionByName(fresh)


def analyse(previews: DataFrame, work: Callable[[str, bytes], dict], columns=AUDIO_COLUMNS) -> DataFrame:
    """Numbers of each preview; items whose analysis fails are left out."""
    columns = list(columns)
    schema = "item_id string, " + ", ".join(f"{c} double" for c in columns)
    rows = previews.select("item_id", "content").mapInPandas(_per_row(work, "content", columns), schema)
    return rows.where(F.coalesce(*columns).isNotNull())


def spoken_language(previews: DataFrame, detect: Callable[[str, bytes], dict]) -> DataFrame:
    """(item_id, language): the label of the code that ``detect`` gives, null where it gives none."""
    rows = previews.select("item_id", "content").mapInPandas(_per_row(detect, "content", ["language"]), "item_id string, language string")
    return rows.select("item_id", language_label("language").alias("language"))
