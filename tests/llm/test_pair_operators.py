"""Near-duplicates, fingerprints, nearest neighbours and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from matchloom.llm import common, components, imatch, mixing, near_dup, queries, vamana
from matchloom.llm.common import Workspace, table

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain_components(docs):
    """{(id, text): (n, component)} by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def cluster_texts(seed, copies=60):
    """A base with many edited copies, a shared passage, chains of copies, exact copies, short texts."""
    rng = np.random.default_rng(seed)
    pick = lambda n: [str(x) for x in rng.choice(WORDS, n)]
    base, passage = pick(80), pick(40)
    texts = [" ".join(base)] * 5
    for _ in range(copies):
        edited = list(base)
        for at in rng.choice(80, rng.integers(1, 6), replace=False):
            edited[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(edited))
    texts += [" ".join(pick(rng.integers(2, 60)) + passage) for _ in range(40)]
    chain = pick(60)
    for i in range(10):
        chain = chain[1:] + pick(1)
        texts.append(" ".join(chain))
    texts += ["a b", "A  b", "a b c", "", " ", None, "one", "ONE", "a b c d e"]
    return [(i * 3, t) for i, t in enumerate(texts)]


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "small"), [(1, 16), (2, 2), (3, 0)])
def test_near_duplicates(spark, monkeypatch, seed, small):
    monkeypatch.setattr(near_dup, "SMALL", small)  # 0: all open buckets take the prefix join
    docs = cluster_texts(seed)
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found(got) == sorted(plain_components(docs), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_near_duplicates_of_odd_rows(spark):
    docs = [(1, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (None, "lonely words"), (2, None), (2, "z z z z z z z"), (7, "q " * 40_000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_shingles string")
    got = near_dup.near_duplicates(df)
    assert found(got) == sorted(plain_components(docs), key=str)
    stay = near_dup.survivors(df)
    assert stay.columns == df.columns and sorted(((r.doc_id, r.text) for r in stay.collect()), key=str) == sorted({d for d in docs if d != (None, "a b c d e f")}, key=str)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_rows_with_clashing_names_and_many_repeats(spark):
    names = ["doc_id", "text", "__k", "__th", "__n", "__row", "__rows", "__copy", "c0"]
    rows = [(i, f"text number {i} of some that differ in words {i * 7}", *["x"] * 7) for i in range(20)] + [(3, "again and again the very same row", *["y"] * 7)] * 40
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"`{n}` string" for n in names[1:]))
    got = near_dup.survivors(df)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(set(rows))
    assert mixing.mixed(df.withColumn("source", F.lit("s"))).columns == [*names, "source"]


def test_heavy_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 3)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(k, 0) for k in range(2, 30)], "k long, v long")
    known = rows.where("k <> 5").groupBy("k").agg(F.count(F.lit(1)).alias("__n")).withColumn("w", F.col("k") * 10)
    inner = common.join_skewed(rows, known, ["k"], 78)
    assert sorted((r.k, r.v, r.w) for r in inner.collect()) == sorted((r.k, r.v, r.k * 10) for r in rows.collect() if r.k != 5)
    outer = {(r.k, r.w) for r in common.join_skewed(rows, known, ["k"], 78, "left").collect()}
    assert (5, None) in outer and len(outer) == 29


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1000) for i in range(1, 200, 3)] + [(5000, 5001)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "hub")).collect()}
    assert set(got.values()) == {0, 5000} and sum(v == 0 for v in got.values()) == 200 + 67


def test_a_cluster_needs_a_shared_folder(spark):
    class Away:
        def __getattr__(self, name):
            return getattr(spark, name)

        class conf:
            @staticmethod
            def get(*_):
                return None

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

            class getConf:
                get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        common.shared_dir(Away())


def test_sketches_estimate():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.6, 0.8, 1.0):
        a = rng.integers(0, 2**63, 600).astype(np.uint64)
        b = np.concatenate([a[: int(600 * share)], rng.integers(0, 2**63, 600 - int(600 * share)).astype(np.uint64)])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = near_dup.registers(np.unique(a)), near_dup.registers(np.unique(b))
        n = np.array([600.0])
        got = near_dup.estimate(ra[None], rb[None], n, n)[0]
        assert abs(got - j) < 0.13 or (j < 0.3 and got < 0.45)
        assert (np.maximum(ra, rb) == near_dup.registers(np.union1d(a, b))).all()  # mergeable


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (100, 95), (200, 200)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {i: 0 for i in range(51)} | {90: 90, 95: 90, 100: 90}


def test_small_graphs_take_few_jobs(spark, monkeypatch):
    edges = [(i * 7 % 97, i * 13 % 89) for i in range(60)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (3000, 3000)]
    rows = spark.createDataFrame(edges, "a long, b long")
    truth = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in truth:
        for a, b in edges:
            if a != b:
                truth[a] = truth[b] = min(truth[a], truth[b])
    for gather in (0, 30, common.FILE_ROWS):  # rounds only, rounds and then the driver, the driver only
        monkeypatch.setattr(components, "GATHER", gather, raising=False)
        spark.sparkContext.setJobGroup(f"gather{gather}", "")
        got = components.connected(rows, Workspace(spark, "few"))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"gather{gather}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {r.node: r.label for r in got.collect()} == truth and got.count() == len(truth)
    assert jobs <= 5
    empty = components.connected(rows.where("a = b"), Workspace(spark, "none"))
    assert empty.columns == ["node", "label"] and empty.count() == 0


# ---------------------------------------------------------------- 7 fingerprints


def test_imatch(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in imatch.compare_with_edits(docs).collect()}
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = {}
    for k, (i, text) in enumerate(texts):
        half, following = len(text) // 2, texts[(k + 1) % len(texts)][1]
        edited = text[: len(text) - half] + following[:half]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, rows[i].fingerprint) == rows[i].fingerprint
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        if text == following:
            assert rows[i].near_next == 1
    assert len(set(prints.values())) >= 0.9 * len(prints)
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.6 * len(rows)


def test_imatch_of_odd_rows(spark):
    data = [(1, "a b"), (1, "a b"), (1, "c"), (None, None), (2, ""), (3, "é" * 5), (4, "long text " * 20_000)]
    df = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, n_chars int")
    rows = imatch.compare_with_edits(df).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in rows), key=str) == sorted(((d, len(t or "")) for d, t in data), key=str)
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    one = imatch.compare_with_edits(df.limit(1)).collect()
    assert one[0].near_next == 1 and imatch.compare_with_edits(df.limit(0)).count() == 0


def xx64(values, seed=42):
    """Spark's 64-bit hash of longs, ints and strings, one after the other, as a signed number."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return struct.unpack("<q", struct.pack("<Q", seed))[0]


def plain_fingerprint(text, frequency, n):
    """Parts of a text by the definition, one text at a time."""
    terms = {xx64([w]) for w in re.split("[ \t\n\x0b\x0c\r]+", text.lower()) if w}
    rare, common = max(2.0, n / 2000), max(4.0, n / 200)
    band = {t for t in terms if rare <= frequency[t] <= common}
    above = sorted(frequency[t] << 32 | t & 0xFFFFFFFF for t in terms if frequency[t] > common)
    wanted = math.ceil((len(band) + len(above)) / 4)
    chosen = sorted(band | {xx64([r]) for r in above[: max(0, wanted - len(band))]})
    out = []
    for chain in range(16):
        level = [t for t in chosen if not t & 7 << 3 * chain]
        for depth in range(5):
            if depth:
                level = [t for t in level if not xx64([t, (chain,)]) & 1 << depth - 1]
            out.append(xx64([*level, (chain * 5 + depth,)]) % 32767 + 1 if level else 0)
    if not any(out):
        out = [xx64([xx64([text]), (i,)]) % 32767 + 1 for i in range(80)]
    return out


def test_imatch_against_a_plain_version(spark, small):
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    frequency = Counter(t for _, x in texts for t in {xx64([w]) for w in re.split("[ \t\n\x0b\x0c\r]+", x.lower()) if w})
    shown = lambda parts: ".".join("-" if p == 0 else f"{p:x}" for p in parts)
    rows = {r.doc_id: r for r in imatch.compare_with_edits(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    own = {i: plain_fingerprint(x, frequency, len(texts)) for i, x in texts}
    for k, (i, x) in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        half = len(x) // 2
        edited = plain_fingerprint(x[: len(x) - half] + after[1][:half], frequency, len(texts))
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (shown(own[i]), shown(edited))
        for got, other in ((rows[i].near_edited, edited), (rows[i].near_next, own[after[0]])):
            some = [(a, b) for a, b in zip(own[i], other, strict=True) if a or b]
            assert got == pytest.approx(sum(a == b for a, b in some) / len(some) if some else 1.0)


@pytest.mark.parametrize("broadcast", [imatch.BROADCAST, 0])
def test_imatch_of_a_large_group_of_near_copies(spark, monkeypatch, broadcast):
    monkeypatch.setattr(imatch, "BROADCAST", broadcast)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(4000)]
    text = rng.choice(words, 240).tolist()
    docs = [(i, " ".join(rng.choice(words, 240))) for i in range(200)]
    for i in range(100):  # a third of the rows: one word is changed in each
        near = list(text)
        near[rng.integers(240)] = f"x{i}"
        docs.append((1000 + i, " ".join(near)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in imatch.compare_with_edits(df).collect()}
    inside = [rows[1000 + i] for i in range(99)]
    assert np.median([r.near_next for r in inside]) > 0.7 and min(r.near_next for r in inside) > 0.3
    assert np.mean([r.near_edited > 0 for r in inside]) > 0.9
    assert np.median([rows[i].near_next for i in range(199)]) < 0.05


# ---------------------------------------------------------------- 8 nearest neighbours


def plain_nearest(ids, x, k=5):
    x = x / np.abs(x).max(axis=1)[:, None]
    length = np.linalg.norm(x, axis=1)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i] / (length * length[i])
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def test_recall(spark, small):
    rows = queries.op8_vamana(spark, small).collect()
    data = table(spark, small, "embeddings").toPandas()
    truth = plain_nearest(data["vec_id"].to_numpy(), np.stack(data["embedding"]).astype(float))
    hits = sum(r.vec_id in {v for v, _ in truth[r.query_id]} for r in rows)
    assert len(rows) == 5 * len(truth) and hits >= 0.9 * len(rows)
    for r in rows:
        want = dict(truth[r.query_id]).get(r.vec_id)
        assert want is None or r.score == pytest.approx(want, abs=1e-12)


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(vamana, "SHARD", 300)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).round(3)
    x[1000:2000] = x[1000]  # a vector that a third of the rows hold
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vamana.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    truth = plain_nearest(np.arange(3000), x)
    assert sum(r.vec_id in {v for v, _ in truth[r.query_id]} for r in got) >= 0.9 * len(got) and len(got) == 300
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1000] == [1001, 1002, 1003, 1004, 1005]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1950] == [1000, 1001, 1002, 1003, 1004]


@pytest.mark.parametrize("query_rows", [vamana.QUERY_ROWS, 7])
def test_extreme_magnitudes_and_many_queries(spark, monkeypatch, query_rows):
    monkeypatch.setattr(vamana, "QUERY_ROWS", query_rows)  # 7: the queries of a shard in several tasks
    monkeypatch.setattr(vamana, "SHARD", 400)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 8)) * (10.0 ** rng.choice([-300, -200, 0, 200, 300], 1200))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vamana.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    truth = plain_nearest(np.arange(1200), x)
    assert len(got) == 5 * len(truth)
    hits = [r for r in got if r.vec_id in dict(truth[r.query_id])]
    assert len(hits) >= 0.9 * len(got)
    assert all(r.score == pytest.approx(dict(truth[r.query_id])[r.vec_id], abs=1e-12) for r in hits)


def test_groups_of_jittered_copies(spark, monkeypatch):
    monkeypatch.setattr(vamana, "SHARD", 300)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16))
    x[::3] = x[0] * rng.uniform(0.5, 2, (500, 1)) + rng.normal(size=(500, 16)) * 1e-4  # a third: one direction, scaled and moved a little
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vamana.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    truth = plain_nearest(np.arange(1500), x)
    assert sum(r.vec_id in dict(truth[r.query_id]) for r in got) >= 0.9 * len(got)


def test_vectors_that_take_no_part(spark):
    data = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (6, [1.0, 1.0]), (7, [float("inf"), 0.0]), (None, [1.0, 0.0]), (100, [0.0, 0.0]), (8, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in vamana.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 6), (0, 2, 50), (50, 1, 6), (50, 2, 0)]
    assert vamana.nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    work = Workspace(spark, "stages")
    docs = before = table(spark, small, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = work.keep(stage(spark, docs, small), name)
        kept[name] = docs
        assert name == "byte_bpe" or docs.columns == before.columns
    ids = lambda n: sorted(r.doc_id for r in kept[n].select("doc_id").collect())
    scores = {r.doc_id: r.predicted for r in queries.op5_toxicity(spark, small).collect()}
    assert ids("toxicity") == sorted(i for i, p in scores.items() if p == 0)
    truth = plain_components([(r.doc_id, r.text) for r in kept["toxicity"].collect()])
    assert ids("near_dedup") == sorted(d for d, _, c in truth if d == c)
    assert ids("pii") == ids("near_dedup") and set(ids("mixing")) <= set(ids("pii"))
    assert ids("byte_bpe") == ids("mixing")
    text = {r.doc_id: r.text for r in kept["pii"].collect()}
    for r in kept["byte_bpe"].collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, small).collect()) == sorted(r.ids_sha256 for r in kept["byte_bpe"].collect())


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted", "__n", "__k", "size", "toxic", "k0", "__done"]
    bad = "you are an idiot and a moron, a pathetic clown"
    texts = [(1, "a fine day of words that go on and on"), (2, None), (3, ""), (4, bad), (None, "no id but words to read here"), (5, "a fine day of words that go on and on"), (6, " \t\n"), (1, "a fine day of words that go on and on"), (7, "long " * 60_000), (8, "mail ab@cd.example now"), (None, None)]
    rows = [(i, t, "en", "s" if (i or 0) % 2 else None, 1, 0.5, "p", 7, 8, 9, 1, "k", "d") for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, __n long, __k long, size long, toxic int, k0 string, __done string"
    for name, data in (("odd", rows), ("none", [])):
        base = f"file://{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([(1, 0), (None, 1), (5, None)][: len(data)], "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
        docs = spark.read.parquet(f"{base}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs
            docs = Workspace(spark, "odd").keep(stage(spark, docs, base), stage_name)
            assert docs.columns == names, stage_name
            if stage_name == "toxicity" and data:
                assert sorted(map(str, docs.collect())) == sorted(str(r) for r in before.collect() if r.text != bad)
            if stage_name == "near_dedup" and data:
                # Of the three alike the smallest id once; empty texts link with nothing.
                assert sorted((str(r.doc_id), (r.text or "")[:12]) for r in docs.collect()) == sorted([("1", "a fine day o"), ("2", ""), ("3", ""), ("None", "no id but wo"), ("6", " \t\n"), ("7", "long long lo"), ("8", "mail ab@cd.e"), ("None", "")])
            if stage_name == "pii" and data:
                assert all(r.score == 0.5 and r.predicted == "p" and r["__n"] == 7 for r in docs.collect())
        out = corpus_pipeline.run(spark, base)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (out.count() > 0) == bool(data)


def test_registration():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
