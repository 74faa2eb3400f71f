"""Paged feeds and the shape of their records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from matchloom.functions.text import distinct_strings, id_in_url, text_or_null

ITEM_URL = r"/track/([a-zA-Z0-9]+)"
TARGET_URL = r"/playlist/([a-zA-Z0-9]+)"
#: Keys under which a page holds its records, and under which a preview stands.
RECORD_KEYS = ("items", "data", "results")
PREVIEW_KEYS = ("preview_url", "previewUrl", "url")


def pages(fetch: Callable[[int], object], page_size: int, max_pages: int | None = None) -> Iterator[dict]:
    """Records of all pages: a page is a list, or holds one under RECORD_KEYS and may name the next."""
    page, read = 1, 0
    while True:
        payload = fetch(page)
        records, following = payload if isinstance(payload, list) else [], None
        if isinstance(payload, dict):
            records = next((payload[k] for k in RECORD_KEYS if payload.get(k)), [])
            following = payload.get("nextPage")
        if not records:
            return
        yield from records
        read += 1
        if max_pages and read >= max_pages:
            return
        if isinstance(following, int):
            page = following
        elif len(records) < page_size:
            return
        else:
            page += 1


class PagedFeed(DataSource):
    """``spark.read.format("paged-feed")``: JSON records of a paged feed, one column ``record``.

    Options: a module-level ``fetcher`` ("module:function" taking a page number). With ``pages``, so many
    partitions read a numbered page each. Without, pages name the next or run out, so one partition follows
    them; ``page_size`` tells a short, last page, and ``max_pages`` ends the reading early.
    """

    @classmethod
    def name(cls) -> str:
        return "paged-feed"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(1, int(self.options["pages"]) + 1)] if "pages" in self.options else [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options["fetcher"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        if partition.value is None:
            found = pages(fetch, int(self.options.get("page_size", 1000)), int(self.options.get("max_pages", 0)) or None)
        else:
            payload = fetch(partition.value)
            found = pages(lambda _: payload, page_size=1 << 60, max_pages=1)
        for record in found:
            yield (json.dumps(record),)


def json_fetcher(base: str, headers: dict | None = None, timeout: float = 20.0, opener: Callable | None = None) -> Callable[[str], object]:
    """A function that reads JSON from a path below ``base``; ``opener`` stands in for the network in tests."""
    from urllib.request import Request, urlopen

    def fetch(path: str) -> object:
        with (opener or urlopen)(Request(base.rstrip("/") + path, headers=headers or {}), timeout=timeout) as response:
            return json.loads(response.read())

    return fetch


def feed_frame(spark: SparkSession, records: Iterator[dict], schema: str) -> DataFrame:
    """Records fetched by the driver as rows of a schema."""
    texts = [(json.dumps(r),) for r in records]
    return spark.createDataFrame(texts, "record string").select(F.from_json("record", schema).alias("r")).select("r.*")


#: The parts of a collection's page that are read.
COLLECTION_PAGE = "page int, items array<struct<track: struct<id: string, name: string, artists: array<struct<name: string>>, album: struct<name: string>, preview_url: string, duration_ms: double, popularity: string>>>"


def collection(spark: SparkSession, fetch: Callable[[int], dict], step: int = 50, limit: int | None = None) -> DataFrame:
    """The items of a collection whose pages are read by offset until one names no next.

    Pages are flattened as columns: entries without an id go, artists are joined, a popularity that is no
    number is null. ``limit`` keeps the first so many and reads no further page than they need.
    """

    def read() -> Iterator[dict]:
        have = page = 0
        following = True
        while following and not (limit and have >= limit):
            payload = fetch(page * step)
            yield {"page": page, "items": payload.get("items") or []}
            have += sum(1 for e in payload.get("items") or [] if (e.get("track") or {}).get("id"))
            following, page = payload.get("next"), page + 1

    each = feed_frame(spark, read(), COLLECTION_PAGE).select("page", F.posexplode("items").alias("at", "e")).select("page", "at", "e.track.*")
    known = each.where(F.coalesce("id", F.lit("")) != "").orderBy("page", "at")
    return (known.limit(limit) if limit else known).select(
        F.col("id").alias("item_id"),
        F.col("name").alias("item_name"),
        F.array_join("artists.name", ", ").alias("artist"),
        F.col("album.name").alias("album"),
        "duration_ms",
        "preview_url",
        F.col("popularity").try_cast("double").cast("int").alias("popularity"),
    )


def tier(c: Column | str) -> Column:
    """A whole number from 1 to 4, also from text such as ``3.0``; all else is null."""
    value = (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double")
    return F.when((value == F.floor(value)) & value.between(1, 4), value.cast("int"))


def strict_tier(value) -> int | None:
    """A request's tier: null stays null, anything but 1 to 4 is an error."""
    if value is None or value == "":
        return None
    number = float(value)
    if number != int(number) or not 1 <= number <= 4:
        raise ValueError(f"tier must be 1, 2, 3 or 4, not {value!r}")
    return int(number)


def targets(df: DataFrame) -> DataFrame:
    """Raw target records by the names and types of the target table."""
    lists = ["genres", "subgenres", "activity", "countries", "languages", "tempos", "moods"]
    have = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    return df.select(
        text_or_null(have("id")).alias("target_id"),
        text_or_null(have("playlistName")).alias("target_name"),
        text_or_null(have("description")).alias("description"),
        text_or_null(have("playlistUrl")).alias("target_url"),
        *[(distinct_strings(n) if n in df.columns else distinct_strings(F.lit(None))).alias(n) for n in lists],
        tier(have("tier")).alias("tier"),
        have("updated_at").cast("timestamp").alias("updated_at"),
    )


def interactions(df: DataFrame) -> DataFrame:
    """Raw match records, a row for each target; a match without targets keeps one row without."""
    info, each = "track_info", F.explode_outer("playlists_id").alias("p")
    url = text_or_null(F.col(f"{info}.trackUrl"))
    flat = df.select("*", each).withColumns({"__url": url, "__in_url": id_in_url(url, ITEM_URL), "__own": text_or_null(F.coalesce(F.col(f"{info}.id").cast("string"), F.col("campaigns_id").cast("string")))})
    updated = F.col("updated_at").cast("timestamp") if "updated_at" in df.columns else F.lit(None).cast("timestamp")
    return flat.select(
        text_or_null("id").alias("match_id"),
        text_or_null("campaigns_id").alias("campaign_id"),
        text_or_null("p.id").alias("target_id"),
        text_or_null("p.playlistName").alias("target_name"),
        text_or_null("p.playlistUrl").alias("target_url"),
        text_or_null("status").alias("status"),
        F.coalesce("__in_url", "__own").alias("item_id"),
        F.col("__in_url").alias("url_item_id"),
        F.col("__own").alias("source_item_id"),
        text_or_null(f"{info}.trackName").alias("item_name"),
        text_or_null(f"{info}.artistName").alias("artist"),
        F.col("__url").alias("item_url"),
        updated.alias("updated_at"),
    )


def preview_url(payload: Column | str) -> Column:
    """The first preview in a JSON payload; a payload that is no JSON object is the URL itself."""
    text = text_or_null(payload)
    found = F.coalesce(*[text_or_null(F.get_json_object(text, f"$.{k}")) for k in PREVIEW_KEYS])
    return F.when(text.startswith("{"), found).otherwise(text_or_null(F.regexp_replace(text, '^"|"$', "")))
