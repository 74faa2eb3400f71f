"""Queries: ingest, cleaning, text and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import tags as tg
from matchloom.functions import text as tx
from matchloom.operators import embed, rows
from matchloom.plans import domain as dm
from matchloom.sources import feeds, tables

LANGS = "case lang when 'en' then 'english' when 'es' then 'spanish' when 'fr' then 'french' when 'de' then 'german' else lang end"
WS = r"'\s+', ' ', 'g'"


def label_map(spark, d):
    good, _ = rows.labelled(dm.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", positive=dm.POSITIVE, negative=dm.NEGATIVE)
    return good


def label_rejects(spark, d):
    _, bad = rows.labelled(dm.read(spark, d, "lineitem"), "l_returnflag", positive=dm.POSITIVE, negative=dm.NEGATIVE)
    return bad.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def changes(spark, d):
    """Events as changes of users; every 7th has no time."""
    e = dm.read(spark, d, "events")
    return e.select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("updated_at"))


def upsert_latest(spark, d):
    e = dm.read(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("updated_at"))
    return tables.upserted(e, ["user_id"], "updated_at", "event_id").select("user_id", "event_id", "event_type")


def upsert_null_ts(spark, d):
    return tables.upserted(changes(spark, d), ["user_id"], "updated_at", "event_id").select("user_id", "event_id", F.col("updated_at").isNull().alias("no_time"))


def watermark_incremental(spark, d):
    """Changes after a stored mark, merged into what was there before it."""
    e = dm.read(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("updated_at"))
    mark = e.agg(F.expr("timestampadd(HOUR, -24, max(updated_at))")).first()[0]
    old = e.where(F.col("updated_at") <= F.lit(mark))
    merged = tables.upserted(old.unionByName(tables.newer_than(e, mark)), ["user_id"], "updated_at", "event_id")
    return merged.select("user_id", "event_id", (F.col("updated_at") > F.lit(mark)).alias("changed"))


def json_list_coerce(spark, d):
    e = dm.read(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    cell = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('", " '), k, F.lit(' ", ""]'))).when(F.col("event_id") % 5 == 1, F.concat(F.col("event_type"), F.lit(" , ,"), k)).when(F.col("event_id") % 5 == 2, F.lit(" NaN ")).when(F.col("event_id") % 5 == 3, F.lit("[]"))
    return e.select("event_id", tx.list_cell(cell).alias("labels"))


def explode_outer_flatten(spark, d):
    """Orders with their lines nested as targets; orders without a line keep a row."""
    lines = dm.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("id"), F.lit("s").alias("playlistName"), F.lit(None).cast("string").alias("playlistUrl"))).alias("playlists_id"))
    o = dm.read(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    url = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://x.example/track/T"), F.col("o_orderkey")))
    info = F.struct(F.col("o_custkey").alias("id"), F.lit(" a ").alias("trackName"), F.lit(" ").alias("artistName"), url.alias("trackUrl"))
    raw = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("campaigns_id"), F.col("o_orderstatus").alias("status"), "playlists_id", info.alias("track_info"))
    return feeds.interactions(raw).groupBy("match_id", "item_id", "target_id", "status", "item_name", "artist").agg(F.count(F.lit(1)).alias("n"))


def url_id_extract(spark, d):
    p = dm.read(spark, d, "pages")
    return p.select("page_id", tx.id_in_url("url", r"/([0-9]+)(?:[?#]|$)").alias("url_id"), tx.id_in_url("url", r"^https?://([a-z0-9.]+)/").alias("host"))


def tier_coerce(spark, d):
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat((F.col("s_suppkey") % 6).cast("string"), F.lit(".0"))).when(F.col("s_suppkey") % 3 == 1, F.lit("x")).otherwise((F.col("s_suppkey") % 6).cast("string"))
    return dm.read(spark, d, "supplier").select("s_suppkey", feeds.tier(raw).alias("tier"))


def dedupe_first(spark, d):
    e = dm.read(spark, d, "events").select("user_id", "event_type", "event_id")
    return rows.latest(e, ["user_id", "event_type"], [F.col("event_id")])


def dedupe_last(spark, d):
    e = dm.read(spark, d, "events").select("user_id", "event_type", "event_id")
    return rows.latest(e, ["user_id", "event_type"], [F.col("event_id").desc()])


def hydrate_missing_items(spark, d):
    known = dm.read(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"), F.col("p_retailprice").alias("price"))
    seen = dm.read(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.lit(None).cast("string").alias("item_name"))
    return rows.hydrate(known, seen)


def text_normalize(spark, d):
    c = dm.read(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.normalize(F.concat(F.lit("  "), F.col("text"), F.lit(" \n X"))).alias("norm"))


def item_text(spark, d):
    i = dm.items(spark, d)
    artist = F.when(F.col("item_id").cast("int") % 3 != 0, F.col("artist"))
    return i.select("item_id", tx.item_text(F.col("item_name"), artist, [F.array("album")], F.col("item_languages"), F.col("item_moods")).alias("item_text"))


def target_text(spark, d):
    t = dm.targets(spark, d)
    return t.select("target_id", tx.target_text(F.col("target_name"), F.when(F.col("tier") == 1, F.lit("nan")).otherwise(F.col("description")), ["genres", "subgenres"], F.col("moods"), F.col("activity")).alias("target_text"))


def text_hash(spark, d):
    return dm.read(spark, d, "documents").select("doc_id", tx.text_hash("text").alias("text_hash"))


def tagger(spark, d):
    return dm.read(spark, d, "part").select("p_partkey", tg.tag(F.concat_ws(" ", "p_brand", "p_name", "p_type"), dm.PARTS).alias("tags"))


def tagger_compound_demotion(spark, d):
    p = dm.read(spark, d, "part").select(tg.tag("p_name", dm.PARTS).alias("tags"), F.col("p_name").contains("rod").alias("has_rod"))
    return p.where("has_rod").groupBy("tags").agg(F.count(F.lit(1)).alias("n"))


def label_to_tags(spark, d):
    p = dm.read(spark, d, "part")
    lists = [F.array(F.lit("Any Gear"), F.upper("p_name")), F.array("p_type", F.when(F.col("p_partkey") % 2 == 0, F.lit("new")))]
    return p.select("p_partkey", tg.labels_tags(*lists, words=dm.PARTS).alias("tags"))


def attribute_normalize(spark, d):
    p = dm.read(spark, d, "part")
    raw = F.array(F.col("p_type"), F.lit(" ANY "), F.lit("n/a"), F.lit(None).cast("string"), F.concat(F.lit(" "), F.col("p_size").cast("string")), F.lower("p_type"))
    return p.select("p_partkey", tg.attributes(raw).alias("attributes"))


def lang_label(spark, d):
    return dm.read(spark, d, "documents").select("doc_id", tg.language_label(F.when(F.col("doc_id") % 10 == 0, F.lit(" ")).when(F.col("doc_id") % 10 == 1, F.lit("XX ")).otherwise(F.col("lang"))).alias("language"))


def side_tags(spark, d):
    """Distinct item tag sets with distinct target tag sets, and how often each occurs."""
    from matchloom.operators.profiles import with_tags

    i = dm.read(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n_items")).withColumn("a", tg.tag("p_name", dm.PARTS))
    t = with_tags(dm.targets(spark, d), dm.PARTS).groupBy(F.col("tags").alias("b")).agg(F.count(F.lit(1)).alias("n_targets"))
    return i.crossJoin(F.broadcast(t))


def tag_jaccard(spark, d):
    return dm.rounded(side_tags(spark, d).select("p_name", F.col("b").alias("tags"), "n_targets", tg.jaccard(F.col("a"), F.col("b")).alias("jaccard"), tg.overlap(F.col("a"), F.col("b")).alias("overlap")))


def tag_conflict(spark, d):
    return side_tags(spark, d).select("p_name", F.col("b").alias("tags"), tg.conflict(F.col("a"), F.col("b"), dm.PARTS).alias("conflict"))


def embedding_cache_miss(spark, d):
    docs = dm.read(spark, d, "documents")
    cache = docs.where("lang = 'en'").select(tx.text_hash("text").alias("text_hash"), F.lit("m").alias("model_name"))
    return embed.missing(docs, cache, "text", "m").select("text_hash")


def pushdown_scan(spark, d):
    """A filtered, pruned scan: tier-like equality on the stored column."""
    return dm.read(spark, d, "supplier").where(F.col("s_nationkey") == 7).select("s_suppkey", "s_name")


def artist_tags_lookup(spark, d):
    """Lower-cased sorted distinct labels gathered for each brand and joined to the items."""
    p = dm.read(spark, d, "part")
    brand = p.groupBy("p_brand").agg(F.array_sort(F.collect_set(F.lower("p_type"))).alias("labels"))
    return p.select("p_partkey", "p_brand").join(brand, "p_brand")


def preview_urls(spark, d):
    p = dm.read(spark, d, "pages")
    payload = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct(F.lit(" ").alias("preview_url"), F.col("url").alias("previewUrl")))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('"'), F.col("url"), F.lit('"'))).when(F.col("page_id") % 2 == 0, F.lit(""))
    return p.select("page_id", feeds.preview_url(payload).alias("preview_url"))


def feature_export(spark, d):
    """Fetched items once each, with cached numbers; items without a cached row are left to analysis."""
    fetched = dm.read(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("target_id"), F.lit("n").alias("item_name"), F.lit(None).cast("string").alias("preview_url"))
    cached = dm.read(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("bpm"))
    return tables.export_features(fetched, cached, ["bpm"]).select("item_id", "target_id", "bpm")


def target_source_list(spark, d):
    t = dm.targets(spark, d).withColumn("target_url", F.when(F.col("tier") != 2, F.concat(F.lit("u/"), F.col("target_id"))))
    return tables.target_sources(t)


QUERIES = {f.__name__: f for f in (label_map, label_rejects, upsert_latest, upsert_null_ts, watermark_incremental, json_list_coerce, explode_outer_flatten, url_id_extract, tier_coerce, dedupe_first, dedupe_last, hydrate_missing_items, text_normalize, item_text, target_text, text_hash, tagger, tagger_compound_demotion, label_to_tags, attribute_normalize, lang_label, tag_jaccard, tag_conflict, embedding_cache_miss, pushdown_scan, artist_tags_lookup, preview_urls, feature_export, target_source_list)}

_LATEST = "select {cols} from (select *, row_number() over (partition by {keys} order by {order}) rn from {rel}) where rn = 1"
_PART_TAGS = "list_sort(list_filter(list_distinct(string_split(p_name, ' ') || case when p_name = 'hot rod' then ['hot_rod'] else []::varchar[] end), lambda x: not (x = 'rod' and p_name = 'hot rod')))"
_WORDS = "['" + "','".join(dm.ADJECTIVES + dm.NOUNS) + "']"
_SIDES = f"""with {dm.TARGETS_SQL}, i as (select distinct p_name, {_PART_TAGS} a from part), t as (select tags b, count(*) n_targets from tagged group by 1)"""

ORACLE_SQL = {
    "label_map": "select l_orderkey, l_linenumber, l_returnflag, cast(case l_returnflag when 'A' then 1 else 0 end as integer) as label from lineitem where l_returnflag in ('A', 'R')",
    "label_rejects": "select l_returnflag, count(*) n from lineitem where l_returnflag not in ('A', 'R') group by 1",
    "upsert_latest": _LATEST.format(cols="user_id, event_id, event_type", keys="user_id", order="ts desc, event_id desc", rel="events"),
    "upsert_null_ts": _LATEST.format(cols="user_id, event_id, u is null no_time", keys="user_id", order="u desc nulls first, event_id desc", rel="(select *, case when event_id % 7 <> 0 then ts end u from events)"),
    "watermark_incremental": _LATEST.format(cols="user_id, event_id, ts > (select max(ts) - interval 24 hour from events) changed", keys="user_id", order="ts desc, event_id desc", rel="events"),
    "json_list_coerce": """select event_id, case event_id % 5 when 0 then [event_type, props ->> '$.k'] when 1 then [event_type, props ->> '$.k'] else []::varchar[] end labels from events""",
    "explode_outer_flatten": """select cast(o_orderkey as varchar) match_id, case when o_orderkey % 3 = 0 then 'T' || o_orderkey else cast(o_custkey as varchar) end item_id, cast(l_suppkey as varchar) target_id, o_orderstatus status, 'a' item_name, cast(null as varchar) artist, count(*) n from orders left join lineitem on l_orderkey = o_orderkey group by all""",
    "url_id_extract": r"""select page_id, nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') url_id, nullif(regexp_extract(url, '^https?://([a-z0-9.]+)/', 1), '') host from pages""",
    "tier_coerce": "select s_suppkey, cast(case when s_suppkey % 3 <> 1 and s_suppkey % 6 between 1 and 4 then s_suppkey % 6 end as integer) tier from supplier",
    "dedupe_first": "select user_id, event_type, min(event_id) event_id from events group by all",
    "dedupe_last": "select user_id, event_type, max(event_id) event_id from events group by all",
    "hydrate_missing_items": "select p_partkey item_id, p_name item_name, p_retailprice price from part where p_size > 25 union all select distinct l_partkey, cast(null as varchar), cast(null as double) from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)",
    "text_normalize": rf"""select conv_id, turn, trim(regexp_replace(lower('  ' || text || ' ' || chr(10) || ' X'), {WS})) norm from conversations""",
    "item_text": f"""with {dm.ITEMS_SQL} select item_id, case when k % 3 <> 0 then artist || ' - ' || item_name else item_name end || '. Genres: ' || lower(album) || '. Language: ' || item_languages[1] || '. Mood: ' || item_moods[1] || '.' item_text from items""",
    "target_text": f"""with {dm.TARGETS_SQL}, g as (select *, list_concat(case when k % 5 = 0 then []::varchar[] when k % 3 = 0 then [adj, noun0] else [adj] end, case when k % 4 = 0 then [noun2, 'hot rod'] else [noun2] end) l from tagged),
      u as (select *, list_filter(l, lambda x, i: list_position(l, x) = i) terms from g)
      select target_id, target_name || case when tier = 1 then '' else '. ' || adj || ' ' || noun1 end || '. Genres: ' || array_to_string(terms, ', ') || '. Mood: ' || case when k % 7 = 0 then 'any' else moods[1] end || '. Activity: ' || case when k % 3 = 0 then 'run, any' else 'walk' end || '.' target_text from u""",
    "text_hash": rf"""select doc_id, sha1('v2:' || trim(regexp_replace(lower(text), {WS}))) text_hash from documents""",
    "tagger": f"select p_partkey, list_sort(list_distinct({_PART_TAGS} || list_filter([lower(p_type)], lambda x: list_contains({_WORDS}, x)))) tags from part",
    "tagger_compound_demotion": f"select {_PART_TAGS} tags, count(*) n from part where contains(p_name, 'rod') group by 1",
    "label_to_tags": f"""select p_partkey, list_sort(list_distinct(case when p_name = 'hot rod' then ['hot_rod'] else {_PART_TAGS} end || list_filter([lower(p_type)], lambda x: list_contains({_WORDS}, x)) || case when p_partkey % 2 = 0 then ['new'] else []::varchar[] end)) tags from part""",
    "attribute_normalize": "select p_partkey, list_sort(list_distinct([lower(p_type), cast(p_size as varchar)])) attributes from part",
    "lang_label": f"select doc_id, case when doc_id % 10 = 0 then null when doc_id % 10 = 1 then 'xx' else {LANGS} end as language from documents",
    "tag_jaccard": f"{_SIDES} select p_name, b tags, n_targets, round(case when len(a) > 0 and len(b) > 0 then len(list_intersect(a, b)) / len(list_distinct(a || b)) else 0.0 end, 6) jaccard, cast(len(list_intersect(a, b)) as integer) overlap from i, t",
    "tag_conflict": f"{_SIDES} select p_name, b tags, not list_has_any(a, b) and ((list_has_any(a, ['cold','hot']) and list_has_any(b, ['cold','hot'])) or (list_has_any(a, ['new','old']) and list_has_any(b, ['new','old']))) conflict from i, t",
    "embedding_cache_miss": rf"""select distinct h text_hash from (select sha1('v2:' || trim(regexp_replace(lower(text), {WS}))) h, lang from documents) where h not in (select sha1('v2:' || trim(regexp_replace(lower(text), {WS}))) from documents where lang = 'en')""",
    "pushdown_scan": "select s_suppkey, s_name from supplier where s_nationkey = 7",
    "artist_tags_lookup": "select p_partkey, p_brand, labels from part join (select p_brand, list_sort(list_distinct(list(lower(p_type)))) labels from part group by 1) using (p_brand)",
    "preview_urls": "select page_id, case when page_id % 3 in (0, 1) then url end preview_url from pages",
    "feature_export": "select l_partkey item_id, min(l_suppkey) target_id, p_size bpm from lineitem join part on p_partkey = l_partkey where p_size <= 40 group by all",
    "target_source_list": "select cast(s_suppkey as varchar) target_id, s_name target_name, 'u/' || s_suppkey target_url from supplier where s_suppkey % 4 + 1 <> 2",
}
