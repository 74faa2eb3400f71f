"""Toxicity: all scripts, long and short words, quotation marks, a plain version of features and score."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import queries, toxicity
from matchloom.llm.common import table


def values(texts, lexicon):
    return dict(zip(toxicity.FEATURES, toxicity.features(texts, lexicon).T, strict=True))


def test_all_scripts():
    lexicon = toxicity.Lexicon({"дурак": 1.0, "βλάκας": 1.0, "أحمق": 1.0, "मूर्ख": 1.0}, {"笨蛋": 1.0, "ばか": 1.0})
    x = values(["ты дурак", "ты дурок", "είσαι βλάκας", "أنت أحمق", "तुम मूर्ख हो", "你是笨蛋吗", "お前はばかだ", "добрый день", "今天天气很好", "ИДИОТ"], lexicon)
    assert (x["plain"] > 0).tolist() == [True, False, True, True, True, True, True, False, False, False]
    assert x["fuzzy"][1] > 0 and x["fuzzy"][7] == 0


def test_terms_are_learned_in_all_scripts_and_lengths(spark):
    long = "ß" + "z" * 60
    bad, good = ["ты дурак совсем", "你是笨蛋吗我说", f"so {long} here", "yo ox no"], ["добрый день", "今天天气很好啊", "so fine here", "yo no"]
    rows = [(1, f"{t} {i}") for i in range(12) for t in bad] + [(0, f"{t} {i}") for i in range(12) for t in good]
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic int, text string"))
    assert {"дурак", long, "ox"} <= set(found.words) and any("笨蛋".startswith(s) or s in "你是笨蛋吗我说" for s in found.stems)
    x = values(["он дурак", "我是笨蛋", f"a {long}", "ox", "добрый день", "天气很好"], found)
    assert (x["plain"] > 0).tolist() == [True, True, True, True, False, False]


def test_more_terms_than_any_table():
    terms = {f"{a}{b}{c}word": 1.0 for a in "abcdefghijklm" for b in "nopqrstuvw" for c in "xyzäöü"}
    assert len(terms) == 780
    big = toxicity.Lexicon(terms | {f"q{i}".translate(str.maketrans("0123456789", "abcdefghij")): 0.5 for i in range(1000)}, {})
    assert (values([" ".join(terms), "anxword", "none at all"], big)["plain"] > 0).tolist() == [True, True, False]


def test_a_small_table_changes_nothing(monkeypatch):
    texts = ["an idiot, an idoit; 'clown' clwn", "x " * 2000 + "moron"] * 3
    want = toxicity.features(texts, toxicity.Lexicon({"idiot": 1.0, "clown": 0.5, "moron": 0.7}, {"lowe": 0.9}))
    monkeypatch.setattr(toxicity, "TABLE", 1)
    lexicon = toxicity.Lexicon({"idiot": 1.0, "clown": 0.5, "moron": 0.7}, {"lowe": 0.9})
    assert all((toxicity.features([t], lexicon)[0] == w).all() for t, w in zip(texts, want, strict=True))


def test_marks_quote_only_in_pairs():
    lexicon = toxicity.Lexicon({"idiot": 1.0}, {})
    far = "x " * toxicity.QUOTE_SPAN
    x = values(['a 5" board, idiot', 'it read "an idiot" there', 'an open " mark. idiot', f'far " {far} idiot "', '5" long, "an idiot" here', '"yes" idiot "no"'], lexicon)
    assert (x["quoted"] > 0).tolist() == [False, True, False, False, True, False]
    assert (x["plain"] > 0).tolist() == [True, False, True, True, False, True]


def test_query_against_a_plain_version(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    lexicon, weights = toxicity.train(docs, labels, "doc_id", "text")
    chosen = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = toxicity.features([texts[i] for i in chosen if i in texts], lexicon)
    y = np.array([chosen[i] for i in chosen if i in texts], float)
    assert toxicity.fit(x, y) == pytest.approx(weights, abs=1e-6)
    # One text at a time: neither its neighbours in a block nor its place in the table matter.
    score = {i: 1 / (1 + np.exp(-np.clip(toxicity.features([t], lexicon)[0] @ weights, -30, 30))) for i, t in texts.items()}
    rows = queries.op5_toxicity(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(score[r.doc_id], abs=1e-9) and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_labels_of_the_held_out_fold_teach_nothing(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x, "doc_id", "text") for x in (labels, flipped))
    assert a[0].words == b[0].words and a[1] == pytest.approx(b[1])
