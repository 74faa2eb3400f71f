"""Settings, requests, media hooks, and training end to end on a small world."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from matchloom.operators import metrics, pairs, profiles, requests, rerank, training
from matchloom.settings import Settings
from matchloom.sources import media
from matchloom.sources.tables import Store

TARGET = "target_id string, target_name string, target_url string, description string, genres array<string>, subgenres array<string>, activity array<string>, countries array<string>, languages array<string>, tempos array<string>, moods array<string>, tier int"
GENRES = ["Rap", "Country", "Electronic", "Jazz"]


@pytest.fixture(scope="module")
def world(spark):
    targets = [(f"p{i}", f"{GENRES[i % 4]} mix {i}", f"u{i}", "", [GENRES[i % 4]], [], [], [], ["english"] if i % 2 else [], [], [], i % 4 + 1) for i in range(8)]
    items = [(f"t{i}", f"{GENRES[i % 4]} song", "A", float(80 + 10 * (i % 4)), float(i % 10 * 10) if i % 5 else None, [1.0 if k == i % 4 else 0.1 for k in range(4)]) for i in range(40)]
    history = [(f"t{i}", f"p{(i + j) % 8}", int((i + j) % 4 == i % 4)) for i in range(40) for j in (0, 1, 4)]
    return (
        spark.createDataFrame(targets, TARGET),
        spark.createDataFrame(items, "item_id string, item_name string, artist string, bpm double, popularity double, embedding array<double>"),
        spark.createDataFrame(history, "item_id string, target_id string, label int"),
    )


def test_settings():
    s = Settings.from_env({"MATCHLOOM_SEED": "7", "MATCHLOOM_HARD_TAG_FILTER": "false", "MATCHLOOM_UNTAGGED_PENALTY": "0.5"})
    assert (s.seed, s.hard_tag_filter, s.penalties.untagged, s.negatives.ratio) == (7, False, 0.5, 5.0)


def test_train(spark, world, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    settings = Settings(trees=3, folds=2, neighbours=2, negative_ratio=1.0)
    features = ["semantic_similarity", "genre_jaccard", "popularity_zscore"]
    ranker, report = training.train(*world, ["bpm"], 4, settings, store=store, features=features)
    assert report["binary_metrics"]["auc_roc"] > 0.8 and report["ranking_metrics"]["hit_at_5"] > 0.5
    assert {s["slice_dim"] for s in report["slices"]} == {"audio", "popularity", "target_size", "primary_tag"}
    assert report["dataset"]["n_features"] == 3 and len(report["calibration"]["bins"]) == 10
    assert store.read("ranking_metrics").count() == 1 and store.read("target_lift").count() > 0
    assert json.dumps(store.read_state("evaluation_report"))
    assert store.read("full_catalog_eval").count() == 8 * 8


def test_requests(spark, world):
    targets, items, history = world
    built = profiles.build(targets, history, items, ["bpm"], 4)
    wanted = [requests.request("a", item_name="x", genres=["Jazz"], languages=["English"], extra={"bpm": "90", "z": "bad"}), requests.request("b", item_name="rap song", tier="3"), *requests.samples()]
    vectors = items.limit(1).select(F.lit("a").alias("item_id"), F.lit([0.1, 0.1, 0.1, 1.0]).cast("array<double>").alias("embedding"))
    rows = requests.prepare(requests.frame(spark, wanted), vectors, ["bpm"])
    got = {r.item_id: r for r in rows.collect()}
    assert got["a"].numbers == [90.0] and got["a"].asked_tags == ["jazz"] and got["b"].numbers is None
    assert got["b"].asked_tags == [] and got["b"].item_tags == ["hip_hop"] and got["sample-folk"].item_tags == ["folk_acoustic"]
    score = lambda p: p.withColumn("score", (pairs.semantic()["semantic_similarity"] + 1) / 2)
    best = rerank.recommend(rows, built, score, 2)
    top = {(r.item_id, r.rank): r.target_id for r in best.collect()}
    assert top["a", 1] == "p3" and top["b", 1] in ("p2", "p6")
    linked = requests.with_urls(best, targets)
    assert linked.where("item_id = 'a' and rank = 1").first().target_url == "u3"
    assert json.loads(requests.as_json(best.limit(0))) == [] and len(json.loads(requests.as_json(best.where("item_id = 'a'")))) == 2
    assert requests.candidates(targets, ["target_id", "absent"], 3).count() == 3
    with pytest.raises(ValueError):
        requests.request("c", tier=9)
    with pytest.raises(TypeError):
        requests.request("c", colour="blue")


def test_media(spark):
    items = spark.createDataFrame([("a", "u"), ("b", "broken"), ("c", None), ("d", "old")], "item_id string, preview_url string")
    cached = spark.createDataFrame([("d", b"xyz")], "item_id string, content binary")

    def fetch(_, url):
        if url == "broken":
            raise OSError(url)
        return {"content": url.encode()}

    previews = media.download(items, fetch, cached)
    assert {r.item_id: bytes(r.content) for r in previews.collect()} == {"a": b"u", "d": b"xyz"}
    numbers = media.analyse(previews, lambda _, content: {"bpm": float(len(content))}, ["bpm", "energy"])
    assert {r.item_id: (r.bpm, r.energy) for r in numbers.collect()} == {"a": (1.0, None), "d": (3.0, None)}
    spoken = media.spoken_language(previews, lambda key, _: {"language": "EN" if key == "a" else None})
    assert {r.item_id: r.language for r in spoken.collect()} == {"a": "english", "d": None}


def test_metric_curves(spark):
    row = spark.createDataFrame([(0.1, 0.5, None, 0.3)], "mrr double, hit_at_1 double, hit_at_10 double, hit_at_3 double")
    assert [(r.k, r.value) for r in metrics.metric_curve(row, "hit").orderBy("k").collect()] == [(1, 0.5), (3, 0.3)]
    assert metrics.at_k(["hit_at_1", "xhit_at_2", "hit_at_x"], "hit") == {1: "hit_at_1"}


def test_command_line(capsys):
    from matchloom.__main__ import main

    main(["list"])
    assert "recommend_topk_semantic" in capsys.readouterr().out


def test_service_answers_from_what_was_trained(spark, world, tmp_path):
    from matchloom import server
    from matchloom.operators.model import Ranker
    from matchloom.operators.service import Service

    store = Store(spark, f"file://{tmp_path}")
    with pytest.raises(FileNotFoundError):
        Service(store)
    settings = Settings(trees=3, folds=2, neighbours=2, negative_ratio=1.0)
    ranker, _ = training.train(*world, ["bpm"], 4, settings, store=store)
    loaded = Ranker.load(store)
    rows = training.pairs.featurize(world[2].select("item_id", "target_id"), training.pairs.prepare_items(world[1], ["bpm"]), store.read("profiles"), ["bpm"])
    scores = lambda r: {(x.item_id, x.target_id): x.score for x in r.score(rows).collect()}
    assert scores(loaded) == pytest.approx(scores(ranker)) and len(scores(loaded)) == 120
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv/ranking_metrics").count() == 1

    service = Service(store, settings)
    vectors = spark.createDataFrame([("a", [0.1, 0.1, 0.1, 1.0])], "item_id string, embedding array<double>")
    asked = requests.frame(spark, [requests.request("a", item_name="x", genres=["Jazz"], extra={"bpm": 110})])
    best = service.recommend(asked, 3, vectors).orderBy("rank").collect()
    # Jazz targets are p3 and p7; the score is the trained model's, and rules came on top.
    assert [r.rank for r in best] == [1, 2, 3] and best[0].target_id in ("p3", "p7") and best[0].target_url == "u" + best[0].target_id[1]
    assert 0 <= best[2].score <= best[1].score <= best[0].score <= 1
    status, found = server.reply(service, "POST", "/recommend", json.dumps({"requests": [{"item_id": "b", "item_name": "rap song", "tier": 3}], "n": 2}).encode())
    assert status == 200 and {r["target_id"] for r in found["recommendations"]} == {"p2", "p6"}
    for bad in (b"{", b"{}", b'{"item_id": "c", "tier": 9}', b'{"item_id": "c", "n": 0}', b'{"item_id": "c", "colour": 1}'):
        assert server.reply(service, "POST", "/recommend", bad)[0] == 400
    assert server.reply(service, "GET", "/health", b"") == (200, {"status": "ok", "targets": 8}) and server.reply(service, "GET", "/x", b"")[0] == 404

    import threading
    import urllib.request

    with server.serve(service, port=0) as running:
        threading.Thread(target=running.serve_forever, daemon=True).start()
        with urllib.request.urlopen(f"http://127.0.0.1:{running.server_port}/health") as response:
            assert json.loads(response.read())["status"] == "ok"
        running.shutdown()


def test_importance_in_one_plan(spark):
    from matchloom.operators import model

    rows = [(f"i{i}", f"t{i}", (i * 37 % 100) / 100, (i * 53 % 100) / 100, int((i * 37 % 100) > 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id string, target_id string, good double, noise double, label int")
    ranker = model.Ranker(["good", "noise"], folds=2, trees=3, depth=2).fit(df)
    found = model.permutation_importance(ranker, df, ["noise", "good"], repeats=3).collect()
    assert [r.feature for r in found] == ["good", "noise"] and found[0].loss > 0.3 and abs(found[1].loss) < 0.1


def test_idle_features_are_not_scored(spark, monkeypatch):
    from matchloom.operators import model

    rows = [(f"i{i}", f"t{i}", (i * 37 % 100) / 100, 1.0, int((i * 37 % 100) > 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "item_id string, target_id string, good double, flat double, label int")
    ranker = model.Ranker(["good", "flat"], folds=2, trees=2, depth=2).fit(df)
    scored, score = [], ranker.score
    monkeypatch.setattr(ranker, "score", lambda df: scored.append(df.count()) or score(df))
    found = model.permutation_importance(ranker, df, ["flat", "good"], repeats=3).collect()
    assert scored == [200 * (1 + 3)]  # the base and three repeats of one column
    assert [r.feature for r in found] == ["good", "flat"] and found[0].loss > 0.3 and found[1].loss == 0
    assert [tuple(r) for r in model.permutation_importance(ranker, df, ["flat"], repeats=2).collect()] == [("flat", 0.0)]


def test_grid_of_six_knobs(spark):
    from matchloom.operators import tuning

    import math

    assert math.prod(map(len, tuning.GRID.values())) == 26_250 and math.prod(map(len, tuning.QUICK.values())) == 972
    rows = [("a", "x", 1, 0.5, ["pop"], ["pop"], ["pop"], ["en"], ["fr"], ["calm"], ["calm"]), ("a", "y", 0, 0.9, ["pop"], ["jazz"], ["jazz"], ["en"], ["en"], ["calm"], ["dark"]), ("b", "x", 0, 0.9, ["pop"], [], [], [], [], [], [])]
    names = "item_id string, target_id string, label int, score double, asked_tags array<string>, primary_tags array<string>, tags array<string>, item_languages array<string>, languages array<string>, item_moods array<string>, moods array<string>"
    options = {"no_match": [0.9], "untagged": [0.3], "secondary": [0.4], "attribute": [0.1, 1.0], "language": [0.1, 1.0], "breadth": [4]}
    got = {r.combo: r.mrr for r in tuning.search(spark.createDataFrame(rows, names), tuning.grid(spark, options)).collect()}
    # x scores 0.5 times the language factor; y 0.81 times the attribute factor.
    assert got == {0: 0.5, 1: 1.0, 2: 0.5, 3: 0.5}


def test_trees_are_the_same_by_any_partitions_and_as_sparks_models(spark):
    from matchloom.operators import model

    rows = [(f"i{i}", f"t{i}", (i * 37 % 101) / 100, None if i % 9 == 0 else (i * 53 % 97) / 100, int((i * 37 % 101) + (i * 53 % 97) > 95)) for i in range(600)]
    df = spark.createDataFrame(rows, "item_id string, target_id string, a double, b double, label int")
    one = model.Ranker(["a", "b"], folds=2, trees=2, depth=2).fit(df.coalesce(1))
    other = model.Ranker(["a", "b"], folds=2, trees=2, depth=2).fit(df.repartition(3))
    assert one.forest.state()["folds"] == other.forest.state()["folds"] and one.values == other.values
    assert one.values == model.medians(df, ["a", "b"])
    scored = {r.item_id: r.score for r in one.score(df).collect()}
    mean = dict.fromkeys(scored, 0.0)
    for trees, sigmoid in one.models:
        from pyspark.ml.functions import vector_to_array

        margins = trees.transform(model.impute(df, one.values)).withColumn("margin_of_1", vector_to_array("margin")[1])
        for r in sigmoid.transform(margins).select("item_id", vector_to_array("calibrated")[1].alias("s")).collect():
            mean[r.item_id] += r.s / len(one.models)
    assert scored == pytest.approx(mean, abs=1e-9)


def test_medians_beyond_a_summary(spark):
    from matchloom.operators import boosting, model

    # More distinct values than a summary holds exactly: the median is in brackets that are read again.
    df = spark.range(0, 30000, 1, 2).selectExpr("cast(pow(id * 7919 % 30000, 2) as double) as x", "if(id % 3 = 0, null, cast(id % 50 as double)) as y", "cast(null as double) as z")
    values, edges, n = boosting.medians_and_edges(df, ["x", "y", "z"])
    assert values == model.medians(df, ["x", "y", "z"]) and n == 30000
    assert len(edges[2]) == 0 and 20 <= len(edges[0]) <= 31


def test_importances_of_many_copies_are_not_listed(spark, monkeypatch):
    from matchloom.operators import model

    rows = [(f"i{i}", f"t{i}", (i * 37 % 100) / 100, (i * 53 % 100) / 100, int((i * 37 % 100) > 50) if i % 10 else 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "item_id string, target_id string, good double, noise double, label int")
    ranker = model.Ranker(["good", "noise"], folds=2, trees=3, depth=2).fit(df)
    plain = {r.feature: r.loss for r in model.permutation_importance(ranker, df, ["good", "noise"], repeats=3).collect()}
    monkeypatch.setattr(model, "COPIES", 0)
    monkeypatch.setattr(ranker, "score", lambda df: pytest.fail("copies were listed"))
    found = model.permutation_importance(ranker, df, ["good", "noise"], repeats=3).collect()
    assert [r.feature for r in found][0] == "good" and all(r.loss == pytest.approx(plain[r.feature], abs=0.05) for r in found)
    # Ranges of scores in tasks of their own give the same areas.
    whole = model.blocked_losses(ranker, df, ["good"], 2, 42, "label", 2000)
    assert model.blocked_losses(ranker, df, ["good"], 2, 42, "label", 2000, range_rows=100) == whole
