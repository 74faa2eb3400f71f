"""Operators on small frames, against values computed by hand and against invariants."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from matchloom.operators import embed, metrics, model, pairs, profiles, rerank, rows, sampling, tuning
from matchloom.schemas import ITEMS, conform
from matchloom.sources import feeds, tables
from matchloom.streaming.upsert import stream_upsert


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


TARGET = "target_id string, target_name string, description string, genres array<string>, subgenres array<string>, activity array<string>, countries array<string>, languages array<string>, tempos array<string>, moods array<string>, tier int"


@pytest.fixture(scope="module")
def world(spark):
    targets = frame(
        spark,
        [
            ("hh", "Hip-Hop Hits", "rap and trap", [], [], ["relaxing", "studying"], [], ["english"], [], ["calm", "peaceful"], 1),
            ("co", "Country Roads", "country only", [], [], [], [], [], [], [], 2),
            ("edm", "EDM House", "electro house", [], [], [], [], [], [], [], 1),
        ],
        TARGET,
    )
    items = frame(
        spark,
        [("t_rap", "rap one", "A", 100.0, -8.0, 20.0, [1.0, 0.0, 0.0]), ("t_country", "country song", "B", 80.0, None, 30.0, [0.0, 1.0, 0.0]), ("t_edm", "techno", "C", 120.0, -6.0, None, [0.0, 0.0, 1.0])],
        "item_id string, item_name string, artist string, bpm double, loudness double, popularity double, embedding array<double>",
    )
    history = frame(spark, [("hh", "t_rap", 1), ("co", "t_country", 1), ("edm", "t_edm", 1), ("hh", "t_country", 0)], "target_id string, item_id string, label int")
    return targets, items, history


def test_labels_and_rejects(spark):
    df = frame(spark, [("accepted",), (" Closed",), ("DECLINED",), ("pending",), (None,)], "status string")
    good, bad = rows.labelled(df)
    assert sorted(r.label for r in good.collect()) == [0, 1, 1] and bad.count() == 2


def test_upsert(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}")
    assert store.read("m", ITEMS).count() == 0
    add = lambda data: store.upsert("m", frame(spark, data, "match_id string, updated_at string, status string"), ["match_id"])
    add([("m1", "2026-01-01", "declined")])
    add([("m1", "2026-01-02", "accepted"), ("m2", "2026-01-02", "declined")])
    assert {r.match_id: r.status for r in store.read("m").collect()} == {"m1": "accepted", "m2": "declined"}
    add([("m1", None, "late")])  # without a time it counts as the latest
    assert {r.match_id: r.status for r in store.read("m").collect()}["m1"] == "late"
    store.write_state({"a": {"watermark": "x"}})
    assert store.read_state() == {"a": {"watermark": "x"}} and store.read_state("none") == {}


def test_publish(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/a")
    store.write("t", spark.range(3))
    there = f"file://{tmp_path}/b"
    assert tables.publish(store, ["t"], there, dry_run=True)[0]["bytes"] > 0 and not tables.Store(spark, there).exists("t")
    tables.publish(store, ["t"], there)
    assert tables.Store(spark, there).read("t").count() == 3
    with pytest.raises(FileNotFoundError):
        tables.publish(store, ["t", "none"], there)


def test_sync_moves_the_mark(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}")
    asked = []

    def fetch(mark):
        asked.append(mark)
        return frame(spark, [("a", "t", f"2026-01-0{len(asked)} 00:00:00", str(len(asked)))], "match_id string, target_id string, updated_at string, v string")

    assert tables.sync(store, "m", fetch, ["match_id", "target_id"]) == 1
    assert tables.sync(store, "m", fetch, ["match_id", "target_id"]) == 1
    assert asked[0] is None and asked[1].startswith("2026-01-01")
    assert [r.v for r in store.read("m").collect()] == ["2"]


def test_stream_upsert_is_the_batch_upsert(spark, tmp_path):
    df = frame(spark, [(1, 1, "2026-01-01"), (1, 2, "2026-01-03"), (2, 3, "2026-01-01"), (1, 4, "2026-01-02")], "k int, e int, updated_at string")
    df.write.parquet(f"{tmp_path}/in")
    store = tables.Store(spark, f"file://{tmp_path}/tables")
    for _ in range(2):  # a second start finds nothing new
        stream_upsert(spark, f"{tmp_path}/in", df.schema, store, "t", ["k"], f"{tmp_path}/state").awaitTermination()
    assert {r.k: r.e for r in store.read("t").collect()} == {1: 2, 2: 3}


def test_feed(spark):
    served = {1: {"items": [{"id": 1}], "nextPage": 3}, 3: [{"id": 2}]}
    assert [r["id"] for r in feeds.pages(lambda p: served.get(p, []), page_size=2)] == [1, 2]
    assert len(list(feeds.pages(lambda p: [{"id": p}], page_size=1, max_pages=4))) == 4
    schema = "id long, campaigns_id long, status string, playlists_id array<struct<id: long, playlistName: string, playlistUrl: string>>, track_info struct<id: long, trackName: string, artistName: string, trackUrl: string>"
    records = [
        {"id": 7, "campaigns_id": 5, "status": " accepted ", "playlists_id": [{"id": 1, "playlistName": "p"}, {"id": 2}], "track_info": {"id": 9, "trackUrl": "https://x/track/t1"}},
        {"id": 8, "campaigns_id": 6, "status": "", "playlists_id": [], "track_info": None},
    ]
    got = feeds.interactions(feeds.feed_frame(spark, iter(records), schema)).orderBy("match_id", "target_id").collect()
    assert [(r.match_id, r.target_id, r.item_id, r.status) for r in got] == [("7", "1", "t1", "accepted"), ("7", "2", "t1", "accepted"), ("8", None, "6", None)]


def test_tiers(spark):
    values = ["1", "4.0", "5", "x", None, "2.5", "0"]
    got = frame(spark, [(v,) for v in values], "t string").select(feeds.tier("t").alias("x")).collect()
    assert [r.x for r in got] == [1, 4, None, None, None, None, None]
    assert feeds.strict_tier("3") == 3 and feeds.strict_tier("") is None
    with pytest.raises(ValueError):
        feeds.strict_tier(7)


def test_preview_urls(spark):
    values = ['{"preview_url": " ", "previewUrl": "u"}', '"w"', "x", "", None, '{"z": 1}']
    got = frame(spark, [(v,) for v in values], "p string").select(feeds.preview_url("p").alias("x")).collect()
    assert [r.x for r in got] == ["u", "w", "x", None, None, None]


def test_conform(spark):
    got = conform(frame(spark, [("1", "x", float("nan"))], "item_id string, bpm string, energy double"), ITEMS).first()
    assert got.item_id == "1" and got.bpm is None and got.energy is None and got.artist is None


def test_items_csv_keeps_first(spark, tmp_path):
    (tmp_path / "i.csv").write_text("item_id,item_name,bpm,zzz\na,one,90,1\na,two,91,1\nb,three,bad,1\n")
    got = {r.item_id: (r.item_name, r.bpm) for r in tables.read_items_csv(spark, f"{tmp_path}/i.csv").collect()}
    assert got == {"a": ("one", 90.0), "b": ("three", None)}


def test_feature_export(spark):
    fetched = frame(spark, [("cached", "p", "n", None), ("new", "p", "n", "u"), ("mute", "p", "n", None), ("new", "q", "n", "u")], "item_id string, target_id string, item_name string, preview_url string")
    cached = frame(spark, [("cached", 1.0)], "item_id string, bpm double")

    def analyse(batches):
        for pdf in batches:
            yield pdf.assign(bpm=2.0)

    got = {r.item_id: r.bpm for r in tables.export_features(fetched, cached, ["bpm"], analyse).collect()}
    assert got == {"cached": 1.0, "new": 2.0}


def test_hydrate(spark):
    items = frame(spark, [("a", "n")], "item_id string, item_name string")
    seen = frame(spark, [("a", "x"), ("b", "y"), ("b", "y"), (None, "z")], "item_id string, item_name string")
    assert {r.item_id: r.item_name for r in rows.hydrate(items, seen).collect()} == {"a": "n", "b": "y"}


def test_profiles(spark, world):
    targets, items, history = world
    p = {r.target_id: r for r in profiles.build(targets, history, items, ["bpm", "loudness"], 3).collect()}
    assert (p["hh"].accepted, p["hh"].declined, p["hh"].acceptance_rate) == (1, 1, 0.5)
    assert p["hh"].num_centroid == [100.0, -8.0] and p["co"].num_centroid == [80.0, None]
    assert p["hh"].centroid == [1.0, 0.0, 0.0] and p["hh"].tags == ["hip_hop"] and p["edm"].pop_count == 0
    cover = profiles.coverage(profiles.build(targets, history, items, ["bpm"], 3)).first()
    assert (cover.targets, cover.with_numbers, cover.with_tags, cover.with_popularity, cover.with_moods) == (3, 3, 3, 2, 1)


def test_population_statistics(spark):
    history = frame(spark, [("p", "a", 1), ("p", "b", 1), ("p", "a", 1), ("p", "c", 0)], "target_id string, item_id string, label int")
    items = frame(spark, [("a", 20.0, [1.0]), ("b", 30.0, [4.0]), ("c", 90.0, [9.0])], "item_id string, popularity double, embedding array<double>")
    got = profiles.popularity(history, items).first()
    assert (got.pop_count, got.pop_mean) == (3, pytest.approx(70 / 3))  # repeated rows count twice
    assert got.pop_std == pytest.approx(math.sqrt(200 / 9))
    assert profiles.centroids(history, items, 1).first().mean_vector == [2.0]


def test_blend(spark):
    mixed = profiles.blend(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    got = spark.range(1).select(mixed.alias("x")).first().x
    n = math.hypot(0.25, 0.75)
    assert got == pytest.approx([0.25 / n, 0.75 / n])


def test_pair_features(spark, world):
    targets, items, history = world
    columns = ["bpm", "loudness"]
    built = profiles.build(targets, history, items, columns, 3)
    prepared = pairs.prepare_items(items, columns)
    asked = prepared.select("item_id").crossJoin(targets.select("target_id")).union(frame(spark, [("t_rap", "nobody")], "a string, b string"))
    got = {(r.item_id, r.target_id): r for r in pairs.featurize(asked, prepared, built, columns).collect()}
    assert set(pairs.MODEL_FEATURES) <= set(got["t_rap", "hh"].asDict()) and len(pairs.MODEL_FEATURES) == 34
    assert got["t_rap", "co"].genre_conflict_flag == 1 and got["t_rap", "hh"].genre_conflict_flag == 0
    assert got["t_rap", "hh"].genre_overlap_count == 1 and got["t_rap", "hh"].semantic_similarity == pytest.approx(1)
    assert got["t_rap", "co"].semantic_l2_distance == pytest.approx(math.sqrt(2))
    assert got["t_rap", "hh"].popularity_zscore == 0 and got["t_country", "hh"].popularity_zscore == pytest.approx(10 / 5)
    assert got["t_edm", "hh"].popularity_available == 0
    nobody = got["t_rap", "nobody"]
    assert nobody.semantic_similarity == 0 and nobody.target_audio_available == 0 and nobody.genre_jaccard == 0
    assert nobody.item_audio_available == 1


def test_pairs_do_not_travel_to_profiles(spark, world, monkeypatch):
    """Small profiles come to the pairs, whatever the session would broadcast; numbers are compared without loops."""
    from matchloom.workspace import keep

    targets, items, history = world
    columns = ["bpm", "loudness"]
    prepared, built = pairs.prepare_items(items, columns), keep(profiles.build(targets, history, items, columns, 3))
    asked = prepared.select("item_id").crossJoin(targets.select("target_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = pairs.featurize(asked, prepared, pairs.small_enough(built), columns)
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan and len(near.collect()) == asked.count()
        monkeypatch.setattr(pairs, "BROADCAST_BYTES", 10)
        far = pairs.featurize(asked, prepared, pairs.small_enough(built), columns)
        assert "strategy=broadcast" not in far._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = frame(spark, [([1.0, None], [3.0, 2.0], [1.0, 0.0], [0.0, 0.0], [2.0, 2.0]), ([3.0, 4.0], [4.0, 3.0], [0.5, None], [4.0, 1.0], [5.0, 9.0]), (None, None, None, None, None)], "numbers array<double>, num_centroid array<double>, num_std array<double>, num_min array<double>, num_max array<double>")
    got = rows.select(*[c.alias(n) for n, c in pairs.numeric(columns).items()])
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    one, two, none = got.collect()
    assert one.audio_centroid_cosine == 1 and one.audio_centroid_l2 == 2 and one.bpm_diff == one.audio_zscore_max == one.audio_zscore_mean == pytest.approx(2 / 1.001) and one.audio_range_ratio == 1
    assert two.audio_centroid_cosine == pytest.approx(24 / 25) and two.audio_centroid_l2 == 1 and two.audio_zscore_mean == pytest.approx(1 / 0.501) and two.audio_range_ratio == 0.5
    assert not any(none)


def test_soft_attributes(spark):
    side = "item_activities array<string>, activities array<string>, item_languages array<string>, languages array<string>, item_moods array<string>, moods array<string>, item_countries array<string>, countries array<string>, item_tempos array<string>, tempos array<string>"
    data = [(["driving", "relaxing"], ["relaxing", "studying"], ["english"], ["german"], ["calm"], ["dark"], [], ["x"], [], [])]
    df = frame(spark, data, side)
    got = df.select(*[c.alias(n) for n, c in pairs.soft().items()], rerank.attribute_multiplier().alias("m")).first()
    assert got.activity_match_flag == pytest.approx(1 / 3) and got.mood_match_flag == 0 and got.language_match_flag == 0
    assert got.m == pytest.approx(0.3 * 0.7)
    two = rerank.Penalties(attribute=0.4, language=0.4)
    assert df.select(rerank.attribute_multiplier(two).alias("m")).first().m == pytest.approx(0.16)


@pytest.mark.parametrize(
    ("asked", "primary", "every", "expected"),
    [
        (["jazz"], ["jazz"], ["jazz"], 1.0),
        (["jazz"], ["rock"], ["jazz", "rock"], 0.4),
        (["jazz"], ["rock"], ["rock"], 0.02),
        (["jazz"], [], [], 0.3),
        (["pop"], ["hip_hop", "pop"], ["hip_hop", "pop"], 0.4),
        (["a"], ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l"], ["a"], math.sqrt(4 / 12)),
    ],
)
def test_explicit_rule(spark, asked, primary, every, expected):
    df = frame(spark, [(asked, primary, every)], "a array<string>, p array<string>, t array<string>")
    assert df.select(rerank.explicit_multiplier(F.col("a"), F.col("p"), F.col("t")).alias("m")).first().m == pytest.approx(expected)


def test_masks_are_the_sets(spark):
    from itertools import combinations

    from matchloom.functions import vocab

    tags = ["pop", "rock", "hip_hop", "country", "indie_rock", "classical"]
    sets = [list(c) for n in range(3) for c in combinations(tags, n)]
    side = spark.createDataFrame([(s,) for s in sets], "x array<string>")
    a = side.select(F.col("x").alias("asked_tags"), F.col("x").alias("item_tags"), F.lit(1.0).alias("score"))
    b = side.select(F.col("x").alias("primary_tags")).crossJoin(side.select(F.col("x").alias("more"))).select("primary_tags", F.array_union("primary_tags", "more").alias("tags"))
    empty = {f"{p}{n}": F.array().cast("array<string>") for n in profiles.ATTRIBUTES for p in ("", "item_")}
    for hard in (True, False):
        for none in (True, False):  # nothing asked for: the conflict filter
            left = a.withColumn("asked_tags", F.array().cast("array<string>")) if none else a
            plain = rerank.reweigh(left.crossJoin(b).withColumns(empty), hard_filter=hard)
            masked = rerank.reweigh(rerank.item_masks(left).crossJoin(rerank.target_masks(b)).withColumns(empty), hard_filter=hard)
            keys = ["item_tags", "asked_tags", "primary_tags", "tags", "score"]
            assert plain.select(keys).exceptAll(masked.select(keys)).isEmpty()
    with pytest.raises(ValueError):
        rerank.target_masks(b, vocab.Vocabulary({str(i): ["x"] for i in range(64)}))


def test_penalties_are_clamped():
    p = rerank.Penalties(no_match=-1, untagged=7, breadth=0)
    assert (p.no_match, p.untagged, p.breadth) == (1e-6, 1.0, 1)


def test_recommend_filters_tiers(spark, world):
    targets, items, history = world
    built = profiles.build(targets, history, items, ["bpm"], 3)
    asked = pairs.prepare_items(items, ["bpm"]).withColumn("asked_tags", F.array().cast("array<string>"))
    score = lambda p: p.withColumn("score", pairs.semantic()["semantic_similarity"])
    best = rerank.recommend(asked, built, score, 1).collect()
    assert {(r.item_id, r.target_id) for r in best} == {("t_rap", "hh"), ("t_country", "co"), ("t_edm", "edm")}
    tiered = rerank.recommend(asked.withColumn("tier", F.lit(2)), built, score, 5).collect()
    assert {r.target_id for r in tiered} == {"co"}
    assert rerank.recommend(asked.withColumn("tier", F.lit(4)), built, score, 5).count() == 0


def test_catalogue_in_blocks(spark, world, monkeypatch):
    targets, items, _ = world
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 1)
    assert pairs.cross(items, targets).select("item_id", "target_id").distinct().count() == 9


def test_ranking_metrics(spark):
    data = [("a", "x", 1, 0.9), ("a", "y", 0, 0.1), ("b", "x", 0, 0.9), ("b", "y", 1, 0.1), ("c", "x", 0, 0.5)]
    got = metrics.ranking(frame(spark, data, "item_id string, target_id string, label int, score double")).first()
    assert (got.n_groups, got.hit_at_1, got.ndcg_at_1, got.mrr) == (2, 0.5, 0.5, 0.75)
    assert got.precision_at_3 == pytest.approx(1 / 3) and got.recall_at_3 == 1


def test_calibration(spark):
    rows_ = [(0, 0.0)] * 5 + [(1, 1.0)] * 5
    assert metrics.calibration_error(frame(spark, rows_, "label int, score double")).first().ece == 0
    assert metrics.calibration_error(frame(spark, [(0, 0.9)] * 100, "label int, score double")).first().ece == pytest.approx(0.9)
    b = metrics.bins(frame(spark, [(1, 0.3), (1, 0.7)], "label int, score double"))
    assert {r.bin: r.n for r in b.collect() if r.n} == {2: 1, 6: 1}
    assert metrics.calibration_error(frame(spark, [], "label int, score double")).first().ece == 0


def test_curves(spark):
    df = frame(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)], "label int, score double")
    got = metrics.curve(df).first()
    assert got.auc_pr == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and got.auc_roc == pytest.approx(0.75)
    assert metrics.curve(frame(spark, [(1, 0.5), (0, 0.5)], "label int, score double")).first().auc_roc == 0.5


def test_slices_and_median(spark):
    df = frame(spark, [(10.0,), (20.0,), (30.0,), (40.0,), (None,)], "v double")
    assert {r.v: r.h for r in metrics.median_split(df, "v", "h").collect()} == {10.0: "low", 20.0: "low", 30.0: "high", 40.0: "high", None: None}
    data = [("a", "x", 1, 0.9, "A"), ("b", "x", 1, 0.9, None)]
    got = metrics.slices(frame(spark, data, "item_id string, target_id string, label int, score double, cat string"), ["cat"]).collect()
    assert {r.slice_value for r in got} == {"A", "unknown"}


def test_lift(spark):
    got = {r.target_id: r.lift for r in metrics.lift(frame(spark, [("a", 1, 0.5), ("a", 0, 0.5), ("b", 0, 0.5)], "target_id string, label int, score double")).collect()}
    assert got == {"a": 1.0, "b": None}


def test_group_split(spark):
    df = frame(spark, [(str(i % 10), i) for i in range(40)], "item_id string, x int")
    got = sampling.group_split(df).groupBy("item_id").agg(F.count_distinct("is_test").alias("n"), F.max("is_test").alias("t")).collect()
    assert all(r.n == 1 for r in got) and sum(r.t for r in got) == 2


@pytest.mark.parametrize("config", [sampling.Negatives(2.0), sampling.Negatives.plain(2.0), sampling.Negatives(4.0)])
def test_negatives(spark, config):
    targets = frame(spark, [(f"p{i}", [t], i % 4 + 1) for i, t in enumerate(["pop", "rock", "jazz", "metal", "edm", "soul"])], "target_id string, tags array<string>, tier int")
    history = frame(spark, [("p0", "a", 1), ("p1", "b", 1), ("p2", "c", 1)], "target_id string, item_id string, label int")
    near = frame(spark, [("p0", "p1"), ("p1", "p2"), ("p2", "p0")], "target_id string, neighbour string")
    got = sampling.draw(history, targets, frame(spark, [("a", ["pop"])], "item_id string, item_tags array<string>"), near, config).collect()
    found = {(r.item_id, r.target_id) for r in got}
    assert len(got) == len(found) == int(3 * config.ratio)
    assert not found & {("a", "p0"), ("b", "p1"), ("c", "p2")}
    tags = {f"p{i}": t for i, t in enumerate(["pop", "rock", "jazz", "metal", "edm", "soul"])}
    anchor = {"a": "pop", "b": "rock", "c": "jazz"}
    assert all(tags[r.target_id] != anchor[r.item_id] for r in got if r.kind == "conflict")
    again = {(r.item_id, r.target_id) for r in sampling.draw(history, targets, frame(spark, [("a", ["pop"])], "item_id string, item_tags array<string>"), near, config).collect()}
    assert again == found


def test_negative_shares_are_clamped():
    c = sampling.Negatives(conflict=0.8, near_miss=0.8)
    assert c.conflict == 0.8 and c.near_miss == pytest.approx(0.2)


def test_embedding_cache(spark):
    texts = frame(spark, [("One two",), ("one  TWO",), ("three",)], "t string")
    cache = frame(spark, [], "text_hash string, model_name string, embedding array<float>")
    got, fresh = embed.embed(texts, cache, "t", "m", embed.hashing_embedder(8))
    assert fresh.count() == 2 and got.where("embedding is null").count() == 0
    assert embed.missing(texts, fresh, "t", "m").count() == 0 and embed.missing(texts, fresh, "t", "other").count() == 2


def test_ranker(spark, tmp_path):
    data = [(str(i), str(i % 7), int(i % 3 == 0), float(i % 3 == 0) + 0.01 * (i % 5), None if i % 4 == 0 else 1.0) for i in range(120)]
    df = frame(spark, data, "item_id string, target_id string, label int, good double, flat double")
    ranker = model.Ranker(["good", "flat"], folds=2, trees=3, depth=2).fit(df)
    assert metrics.curve(ranker.score(df)).first().auc_roc > 0.95
    assert ranker.importances()[0][0] == "good"
    assert model.permutation_importance(ranker, df, ["good", "flat"], repeats=1).first().feature == "good"
    store = tables.Store(spark, f"file://{tmp_path}")
    tables.save_bundle(ranker.models[0][0], {"features": ["good"]}, store, "b")
    loaded, about = tables.load_bundle(store, "b")
    assert about == {"features": ["good"]} and loaded.transform(model.impute(df, ranker.values)).count() == 120


def test_exact_median_imputation(spark):
    df = frame(spark, [(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert model.medians(df, ["x"]) == {"x": 2.5}


def test_grid(spark):
    combos = tuning.grid(spark, {"no_match": [0.02, 0.1, 0.3], "untagged": [0.3, 0.6], "secondary": [0.4, 0.8], "breadth": [4, 6]})
    data = [("a", "x", 1, 0.5, ["jazz"], ["jazz"], ["jazz"]), ("a", "y", 0, 0.9, ["jazz"], ["rock"], ["rock"])]
    df = frame(spark, data, "item_id string, target_id string, label int, score double, asked_tags array<string>, primary_tags array<string>, tags array<string>")
    got = tuning.search(df, combos)
    assert got.count() == 24 and tuning.best(got).first().combo == 0


def test_running_totals_and_medians(spark, monkeypatch):
    from matchloom.operators import ordered

    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as k", "cast(id as double) as v", "if(id % 3 = 0, null, id * 1.5) as w", "cast(null as double) as nothing")
    total = {r.k: r.s for r in ordered.running(rows, [F.col("k")], {"s": F.col("k")}).collect()}
    assert total == {k: k * (k + 1) // 2 for k in range(1000)}
    assert [r.place for r in ordered.numbered(rows, [F.col("k").desc()]).orderBy(F.col("k").desc()).collect()] == list(range(1, 1001))
    import statistics

    want = statistics.median([i * 1.5 for i in range(1000) if i % 3])
    assert ordered.medians(rows, ["v", "w", "nothing"]) == {"v": 499.5, "w": want, "nothing": None}
    assert ordered.medians(rows.limit(0), ["v"]) == {"v": None}


def test_cross_beyond_a_broadcast(spark, monkeypatch):
    from matchloom.operators import pairs as pr

    items = spark.range(40).selectExpr("cast(id as string) item_id")
    targets = spark.range(30).selectExpr("cast(id as string) target_id", "array(1.0D, 2.0D) as v")
    for rows, size in ((7, 1 << 30), (1000, 100)):
        monkeypatch.setattr(pr, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(pr, "BROADCAST_BYTES", size)
        dealt = pr.cross(items, targets)
        assert dealt.select("item_id", "target_id").distinct().count() == dealt.count() == 1200
        assert "BroadcastNestedLoopJoin" not in dealt._jdf.queryExecution().executedPlan().toString()


def test_a_writer_that_dies_leaves_the_old_table(spark, tmp_path):
    from matchloom.sources import tables

    store = tables.Store(spark, f"file://{tmp_path}")
    store.write("t", spark.range(3))
    store.write("t", store.read("t").union(spark.range(1)))
    assert store.read("t").count() == 4
    (tmp_path / "t").rename(tmp_path / ".old-t")  # as between the two renames
    assert store.exists("t") and store.read("t").count() == 4
    store.write("t", spark.range(2))
    assert store.read("t").count() == 2 and store.read("t").count() == 2
    assert tables.load_targets(store).columns == tables.TARGETS.names and tables.load_labelled(store).count() == 0
    store.write("interactions", spark.createDataFrame([("m", "Accepted"), ("n", "?")], "match_id string, status string"))
    assert [r.label for r in tables.load_labelled(store).collect()] == [1]
    tables.publish(store, ["t"], f"file://{tmp_path}/out")
    other = tables.Store(spark, f"file://{tmp_path}/other")
    assert tables.pull(other, ["t"], f"file://{tmp_path}/out") == ["t"] and other.read("t").count() == 2 and tables.pull(other, ["t"], "x") == []


CURSOR = {1: {"items": [{"id": 1}, {"id": 2}], "nextPage": 7}, 7: {"items": [{"id": 3}], "nextPage": 9}, 9: {"items": []}}


def cursor_page(number):
    return CURSOR[number]


def test_feeds_follow_cursors_and_offsets(spark, tmp_path, monkeypatch):
    from matchloom.functions import text
    from matchloom.sources import feeds, media

    (tmp_path / "fake_feed.py").write_text(f"CURSOR = {CURSOR!r}\n\n\ndef page(n):\n    return CURSOR[n]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "fake_feed.py"))
    spark.dataSource.register(feeds.PagedFeed)
    got = spark.read.format("paged-feed").option("fetcher", "fake_feed:page").load()
    assert sorted(r.record for r in got.collect()) == ['{"id": 1}', '{"id": 2}', '{"id": 3}']
    assert spark.read.format("paged-feed").option("fetcher", "fake_feed:page").option("max_pages", "1").load().count() == 2
    track = lambda i: {"track": {"id": f"t{i}" if i else None, "name": f"n{i}", "artists": [{"name": "A"}, {"name": "B"}], "album": {"name": "al"}, "duration_ms": 5, "popularity": i if i != 2 else None}}
    asked = []

    def fetch(offset):
        asked.append(offset)
        return {"items": [track(offset + 1), track(0), track(offset + 2)], "next": offset < 4}

    rows = feeds.collection(spark, fetch, step=2)
    assert [(r.item_id, r.artist, r.popularity) for r in rows.collect()] == [("t1", "A, B", 1), ("t2", "A, B", None), ("t3", "A, B", 3), ("t4", "A, B", 4), ("t5", "A, B", 5), ("t6", "A, B", 6)]
    asked.clear()
    assert feeds.collection(spark, fetch, step=2, limit=2).count() == 2 and asked == [0]
    import io

    assert feeds.json_fetcher("http://x/", opener=lambda request, timeout: io.BytesIO(b'{"u": "%s"}' % request.full_url.encode()))("/a") == {"u": "http://x/a"}
    ids = spark.createDataFrame([("https://x/playlist/ab1",), ("ab2",)], "v string")
    assert [r[0] for r in ids.select(text.url_or_id("v", feeds.TARGET_URL, strict=True)).collect()] == ["ab1", "ab2"]
    for bad in (" ", None, "https://x/other/z"):
        with pytest.raises(Exception, match="empty|no id in"):
            spark.createDataFrame([(bad,)], "v string").select(text.url_or_id("v", feeds.TARGET_URL, strict=True)).collect()
    items = spark.createDataFrame([("a", None, "ok"), ("b", "have", "ok"), ("c", None, "broken"), ("d", None, None)], "item_id string, preview_url string, item_url string")

    def ask(key, url):
        if url == "broken":
            raise OSError(url)
        return '{"previewUrl": "p-%s"}' % key

    assert {r.item_id: r.preview_url for r in media.resolve_previews(items, ask).collect()} == {"a": "p-a", "b": "have", "c": None, "d": None}


def test_embedders():
    import hashlib
    from types import SimpleNamespace

    import numpy as np

    def plain(text, dim):
        v = [0.0] * dim
        for word in text.split():
            h = int.from_bytes(hashlib.sha1(word.encode()).digest()[:8], "big")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    texts = ["a b c a", "", "b", "one two three " * 5]
    for got, text in zip(embed.hashing_embedder(16)(texts), texts, strict=True):
        assert got == pytest.approx(plain(text, 16))
    assert embed.hashing_embedder(4)([]) == []

    class Session:
        def get_inputs(self):
            return [SimpleNamespace(name="input_ids"), SimpleNamespace(name="attention_mask")]

        def run(self, _, feed):
            assert set(feed) == {"input_ids", "attention_mask"}
            return [np.stack([feed["input_ids"], feed["input_ids"] ** 2], 2).astype(np.float32)]

    class Padded:
        def encode_batch(self, texts):
            longest = max(len(t) for t in texts)
            return [SimpleNamespace(ids=[ord(c) - 96 for c in t] + [9] * (longest - len(t)), attention_mask=[1] * len(t) + [0] * (longest - len(t))) for t in texts]

    got = embed.pooled_embedder(Session, Padded, batch=2)(["ab", "c", "aaaa"])
    want = [np.array([1.5, 2.5]), np.array([3.0, 9.0]), np.array([1.0, 1.0])]
    assert np.allclose(got, [w / np.linalg.norm(w) for w in want])
