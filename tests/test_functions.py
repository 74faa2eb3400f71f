"""Text, tag and vector functions on values computed by hand."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from matchloom.functions import tags as tg
from matchloom.functions import text as tx
from matchloom.functions import vectors as vec
from matchloom.functions import vocab


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


@pytest.mark.parametrize(
    ("value", "expected"),
    [(None, []), ("", []), (" NaN ", []), ("none", []), ("[]", []), ('["a", " b ", ""]', ["a", "b"]), ("a, ,b", ["a", "b"]), ("[broken", ["[broken"]), ("x", ["x"])],
)
def test_list_cell(spark, value, expected):
    assert one(spark, tx.list_cell(F.lit(value).cast("string"))) == expected


def test_distinct_strings_keep_order(spark):
    assert one(spark, tx.distinct_strings(strings("Trap", " Drill", "Trap", "", None))) == ["Trap", "Drill"]
    assert one(spark, tx.distinct_strings(F.lit(None))) == []


def test_ids_in_urls(spark):
    assert one(spark, tx.id_in_url(F.lit("https://x.example/track/t1?z=1"), r"/track/([a-zA-Z0-9]+)")) == "t1"
    assert one(spark, tx.id_in_url(F.lit("https://x.example/album/t1"), r"/track/([a-zA-Z0-9]+)")) is None
    assert one(spark, tx.url_or_id(F.lit(" abc "), r"/playlist/(\w+)")) == "abc"
    assert one(spark, tx.url_or_id(F.lit("https://x/playlist/q9"), r"/playlist/(\w+)")) == "q9"
    assert one(spark, tx.url_or_id(F.lit("https://x/other/q9"), r"/playlist/(\w+)")) is None


def test_item_and_target_text(spark):
    assert one(spark, tx.item_text(F.lit("Drill Anthem"), F.lit("MC Foo"))) == "MC Foo - Drill Anthem"
    assert one(spark, tx.item_text(F.lit(None), F.lit("MC Foo"))) == "MC Foo"
    assert one(spark, tx.item_text(F.lit("a"), F.lit(""), [strings("Rap", "rap")], strings("EN"), strings("Dark"))) == "a. Genres: rap. Language: en. Mood: dark."
    target = tx.target_text(F.lit("Workout Mix"), F.lit("high energy"), [strings("Pop", "Hip-Hop")], strings("Energetic"), strings("Workout"))
    assert one(spark, target) == "Workout Mix. high energy. Genres: pop, hip-hop. Mood: energetic. Activity: workout."
    assert one(spark, tx.target_text(F.lit("n"), F.lit("nan"))) == "n"


def test_normalize_and_hash(spark):
    assert one(spark, tx.normalize(F.lit(" A  b\n"))) == "a b"
    assert one(spark, tx.text_hash(F.lit(" A  b"))) == hashlib.sha1(b"v2:a b").hexdigest()
    assert one(spark, tx.text_hash(F.lit(None).cast("string"))) == hashlib.sha1(b"v2:").hexdigest()


def test_vocabulary_sizes():
    assert len(vocab.MUSIC.patterns) == 30 and sum(map(len, vocab.MUSIC.patterns.values())) == 157
    assert len(vocab.MUSIC.conflicts) == 30 and len(vocab.AUDIO_COLUMNS) == 41


@pytest.mark.parametrize(
    ("text", "tags"),
    [("hip-hop rap urban daily", ["hip_hop"]), ("Best Pop Rock Hits 2026", ["pop", "pop_rock"]), ("garage ROCK", ["rock"]), ("", []), (None, []), ("épop", [])],
)
def test_tagger(spark, text, tags):
    assert one(spark, tg.tag(F.lit(text).cast("string"))) == tags


def test_jaccard_and_conflict(spark):
    a = lambda *x: strings(*x) if x else tx.empty_strings()
    assert one(spark, tg.jaccard(a("a", "b"), a("a", "c"))) == pytest.approx(1 / 3)
    assert one(spark, tg.jaccard(a(), a("a"))) == 0
    assert one(spark, tg.conflict(a("hip_hop"), a("country")))
    assert one(spark, tg.conflict(a("pop"), a("hip_hop")))
    assert not one(spark, tg.conflict(a("pop", "rock"), a("pop", "metal")))
    assert not one(spark, tg.conflict(a(), a("pop")))
    # Members of one family are in one group and so conflict.
    assert one(spark, tg.conflict(a("rock"), a("indie_rock")))
    assert one(spark, tg.conflict(a("pop"), a("pop_rock")))
    assert not one(spark, tg.conflict(a("jazz"), a("soul")))


def test_labels(spark):
    assert one(spark, tg.labels_tags(strings("Rock", "Acoustic"))) == ["folk_acoustic", "rock"]
    assert one(spark, tg.labels_tags(strings("Blues Rock", "Hard Rock", "Folk Rock"))) == ["blues_rock", "folk_rock", "rock"]
    # A label mapped to nothing stops; an unknown one goes through the patterns.
    assert one(spark, tg.labels_tags(strings("Other", "experimental", None))) == []
    assert one(spark, tg.labels_tags(strings("west coast hip hop"))) == ["hip_hop"]


def test_attributes_and_languages(spark):
    assert one(spark, tg.attributes(strings("Any", "any", "OTHER", "  ", "None", "n/a", "Unknown", "ALL", None))) == []
    assert one(spark, tg.attributes(strings("42", "Pop", "pop "))) == ["42", "pop"]
    assert [one(spark, tg.language_label(F.lit(x).cast("string"))) for x in ("en", "ZH ", "", None, "Xx")] == ["english", "chinese", None, None, "xx"]
    assert [one(spark, tg.key_number(F.lit(x).cast("string"))) for x in ("C#", "B", "H", None)] == [1, 11, -1, -1]


def doubles(*values):
    return F.array(*[F.lit(v).cast("double") for v in values])


def test_vectors(spark):
    assert one(spark, vec.cosine(doubles(1, 0), doubles(1, 1))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, vec.cosine(doubles(0, 0), doubles(1, 1))) == 0
    assert one(spark, vec.cosine(F.lit(None).cast("array<double>"), doubles(1))) == 0
    assert one(spark, vec.distance(doubles(0, 3), doubles(4, 0))) == 5
    assert one(spark, vec.rms_distance(doubles(0, 3, None), doubles(4, 0, 7))) == pytest.approx(math.sqrt(12.5))
    assert one(spark, vec.joint_cosine(doubles(1, None), doubles(2, 5))) == pytest.approx(1)
    assert one(spark, vec.range_ratio(doubles(90, -9, 0.6, 0.4), doubles(80, -10, 0.5, 0.3), doubles(120, -6, 0.9, 0.7))) == 1
    assert one(spark, vec.range_ratio(doubles(200, None), doubles(80, 1), doubles(120, 2))) == 0
    z = one(spark, vec.zscores(doubles(90), doubles(100), doubles(math.sqrt(800 / 3))))
    assert z[0] == pytest.approx(0.61233, abs=1e-4)
    assert one(spark, vec.unit(doubles(0, 0))) == [0, 0]
