"""Training end to end: split, profiles, negatives, model, evaluation, report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import vocab
from matchloom.operators import metrics, model, pairs, profiles, sampling
from matchloom.settings import Settings
from matchloom.sources.tables import Store
from matchloom.workspace import keep


def bundle(targets: DataFrame, items: DataFrame, known: DataFrame, columns: list[str], dim: int, settings: Settings, words: vocab.Vocabulary):
    """Profiles from the known interactions, and items ready for pairing."""
    built = keep(profiles.build(targets, known, items, columns, dim, words, settings.semantic_blend), "profiles")
    return built, keep(pairs.prepare_items(items, columns, words), "items")


def scorer(ranker: model.Ranker, columns: list[str], words: vocab.Vocabulary = vocab.MUSIC):
    """For ``rerank.recommend``: pairs with the ranker's score, through the features that it was fitted on."""
    return lambda rows: ranker.score(pairs.features(rows, columns, words))


def train(targets: DataFrame, items: DataFrame, interactions: DataFrame, columns: list[str], dim: int, settings: Settings = Settings(), words: vocab.Vocabulary = vocab.MUSIC, store: Store | None = None, features: list[str] | None = None) -> tuple[model.Ranker, dict]:
    """The fitted ranker and its report. Items are split before anything is learned from them; a training
    pair's own label is part of the profile it meets, a test pair's never is. With a store, the report's tables
    (also as CSV), the profiles and the ranker are kept there, as ``service.Service`` reads them."""
    features = features or pairs.MODEL_FEATURES
    rows = interactions.na.drop(subset=["item_id", "target_id", "label"]).select("item_id", "target_id", "label")
    split = keep(sampling.group_split(rows, share=settings.test_share, seed=settings.seed), "split")
    known, held = split.where("not is_test").drop("is_test"), split.where("is_test").drop("is_test")
    built, prepared = bundle(targets, items, known, columns, dim, settings, words)
    near = sampling.neighbours(built.select("target_id", "centroid"), settings.neighbours, dim=dim)
    drawn = sampling.draw(known, built.select("target_id", "tags", "tier"), prepared.select("item_id", "item_tags"), near, settings.negatives, settings.seed)
    train_pairs = known.unionByName(drawn.select("item_id", "target_id", F.lit(0).alias("label")))
    featured = lambda p: pairs.featurize(p, prepared, built, columns, words)
    fitting = keep(featured(train_pairs).select("item_id", "target_id", "label", *features), "fitting")
    ranker = model.Ranker(features, settings.folds, settings.trees, seed=settings.seed).fit(fitting)
    test = keep(ranker.score(featured(held)), "test")

    positive = held.where("label = 1").select("item_id", "target_id").distinct().withColumn("y", F.lit(1))
    catalogue = pairs.cross(held.select("item_id").distinct(), built.select("target_id"))
    catalogue = catalogue.join(positive, ["item_id", "target_id"], "left").select("item_id", "target_id", F.coalesce("y", F.lit(0)).alias("label"))
    catalogue = keep(ranker.score(featured(catalogue)), "catalogue")
    tagged = catalogue.join(prepared.select("item_id", "item_tags"), "item_id").join(built.select("target_id", "tags", "primary_tags"), "target_id")
    from matchloom.operators.rerank import top

    tables = {
        "ranker_eval": test.select("item_id", "target_id", "label", "score"),
        "full_catalog_eval": catalogue.select("item_id", "target_id", "label", "score"),
        "calibration_curve": metrics.bins(test),
        "ranking_metrics": metrics.ranking(catalogue),
        "slice_analysis": metrics.standard_slices(catalogue, built),
        "target_lift": metrics.lift(test),
        "feature_importance": targets.sparkSession.createDataFrame(ranker.importances(), "feature string, importance double"),
    }
    listed = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  small metric tables
    report = {
        "binary_metrics": listed(metrics.curve(test))[0],
        "ranking_metrics": listed(tables["ranking_metrics"])[0],
        "tag_metrics": listed(metrics.tag_relevance(top(tagged, 5), 5, words))[0],
        "calibration": {**listed(metrics.calibration_error(test))[0], "bins": listed(tables["calibration_curve"].orderBy("bin"))},
        "slices": listed(tables["slice_analysis"].orderBy("slice_dim", "slice_value")),
        "feature_importances": [{"feature": f, "importance": v} for f, v in ranker.importances()[:20]],
        "dataset": {"n_train_rows": fitting.count(), "n_test_rows": test.count(), "n_features": len(features), "feature_columns": list(features), "n_targets": built.select("target_id").distinct().count()},
    }
    if store is not None:
        for name, table in tables.items():
            store.write(name, table)
            store.write_csv(name, table)
        store.write("profiles", built)
        ranker.save(store)
        store.write_state({"columns": columns, "dim": dim}, "service")
        store.write_state(json.loads(json.dumps(report, default=str)), "evaluation_report")
    return ranker, report
