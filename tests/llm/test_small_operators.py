"""Operators on texts against plain versions: encoding, counts, language model, pseudonyms, chat, mixing."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import bpe, chat, mixing, ngram_lm, pseudonyms, toxicity, wordpiece
from matchloom.llm.common import HashIndex, Workspace, block_words, text_blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, repeated rows, clashing extra columns come with these.
ODD = [
    (1, "One two three.", "en", "a", 3),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "no id here", "en", "a", 1),
    (4, " \t\n ", "de", None, 3),
    (1, "One two three.", "en", "a", 3),
    (5, "ümläut 😀 x" * 50, "de", "b", 1),
    (6, "long " * 30_000, "en", "a", 1),
    (7, "y" * 20_000, "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def both_encoders(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder(ranks)


# ---------------------------------------------------------------- words and hashes


def test_words_are_byte_words():
    import pyarrow as pa

    texts = ["The cat\x0b sat", None, "", "  x", "THE  cat"]
    for _, offsets, data in text_blocks(pa.array(texts)):
        with np.errstate(over="ignore"):
            hashes, bounds = block_words(offsets, data)
        assert np.diff(bounds).tolist() == [len((t or "").encode().split()) for t in texts]
        assert hashes[0] == hashes[bounds[4]] and hashes[1] == hashes[bounds[4] + 1]


def test_hash_index():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    index = HashIndex(keys)
    with np.errstate(over="ignore"):
        assert (index.find(keys) == np.arange(5000)).all() and (index.find(keys + np.uint64(1)) == -1).sum() > 4990
    assert HashIndex(np.empty(0, np.uint64)).find(keys[:3]).tolist() == [-1] * 3


# ---------------------------------------------------------------- 9 byte-level BPE


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_bpe_is_the_librarys(both_encoders, texts):
    library, encoder = both_encoders
    split = regex.compile(public_tokenizers.PATTERN).findall
    for text, (n, ids, decoded) in zip(texts, bpe.digests(texts, encoder, split), strict=True):
        expected = library.encode_ordinary(text)
        assert n == len(expected) and ids == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert decoded == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_long_pieces(ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks)
    for piece in (b"a" * 5000, b"thethe" * 300, bytes(range(97, 123)) * 40):
        assert encoder.encode_pieces([piece])[0] == library._encode_single_piece(piece)


def test_bpe_frames(spark, odd, none, ranks):
    got = bpe.encode_frame(odd.withColumn("n_tokens", F.lit("clash")), "text", ranks, public_tokenizers.PATTERN)
    rows = got.collect()
    assert len(rows) == len(ODD) and got.columns[-3:] == ["n_tokens", "ids_sha256", "decoded_sha256"]
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert (r.n_tokens == 0) == (not r.text)
    assert bpe.encode_frame(none, "text", ranks, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(odd, "text", ranks, public_tokenizers.PATTERN), "ids", ranks)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())


# ---------------------------------------------------------------- 3 longest-match counts


def greedy(word: bytes, vocabulary: set[bytes], longest: int) -> int:
    at = n = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        n += 1
    return n


def test_longest_match(spark, odd, none):
    extra = [b" a", b"ab", b"abc", b"bcd", b"cde", b" abcx", b"dd", b"ddd", b" one", b"long", b" lo"]
    vocabulary = [bytes([b]) for b in range(256)] + extra
    known, longest = set(vocabulary), max(map(len, vocabulary))
    automaton = wordpiece.Automaton(vocabulary)
    for word in itertools.islice(itertools.product(b"abcdx", repeat=5), 0, None, 7):
        assert automaton.count_one(b" " + bytes(word)) == greedy(b" " + bytes(word), known, longest)
    for r in wordpiece.count_tokens(odd.select("doc_id", "n_chars", "text"), "text", vocabulary).join(odd.distinct(), ["doc_id", "n_chars"]).collect():
        words = (r.text or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w, known, longest) for w in words))
    assert wordpiece.count_tokens(none, "text", vocabulary).count() == 0
    with pytest.raises(ValueError):
        wordpiece.Automaton([b"a"])


# ---------------------------------------------------------------- 10 language model


def test_bloom_levels_never_fall_short():
    rng = np.random.default_rng(2)
    keys, counts = rng.integers(0, 2**63, 20_000).astype(np.uint64), rng.integers(2, 5000, 20_000)
    with np.errstate(over="ignore"):
        places = ngram_lm.segment_of(keys, 5)
        # What two tasks counted, packed by segment, adds up.
        half = counts // 2
        rows = [r for n in (counts - half, half) for b in ngram_lm.pack(keys[n > 0], n[n > 0], 5) for r in b.to_pylist()]
        whole = [ngram_lm.unpack(*zip(*[(r["ids"], r["counts"]) for r in rows if r["segment"] == i], strict=True)) for i in range(5)]
        assert {(int(x), int(c)) for ids, n in whole for x, c in zip(ids, n, strict=True)} == set(zip(ngram_lm.ids_of(keys).tolist(), counts.tolist(), strict=True))
        built = [ngram_lm.build_segment(ngram_lm.ids_of(keys[places == i]), counts[places == i]) for i in range(5)]
        top = max(t for _, t in built)
        f = ngram_lm.LogBloom([w.tobytes() for w, _ in built], top)
        levels = f.levels(keys)
        assert (levels >= ngram_lm.levels_of_counts(counts)).all()
        assert (levels == ngram_lm.levels_of_counts(counts)).mean() > 0.98
        assert (f.levels(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.02


def check_scores(rows, docs):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 5
    counts = Counter(w for i, t in docs if fold(i) != 1 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        expected[i, fold(i) == 1, len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == expected


def plain_scores(docs):
    """{(id, text): score}, one token at a time, with dictionaries in place of the filter."""
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    training = [w for i, w in words.items() if fold(i) != 1]
    count = Counter(tuple(w[k : k + n]) for w in training for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total, types = sum(map(len, training)), sum(len(g) == 1 for g in count)
    level = lambda c: 1 + math.floor(math.log(c / 2) / math.log(1.5) + 1e-9)
    known = {g: 2 * 1.5 ** (level(c) - 1) for g, c in count.items() if c >= 2}
    head = max(1.0, total * ngram_lm.HEAD_SHARE)
    best = lambda x: count[x,] if count[x,] >= head else known.get((x,), 0.0)
    p1 = lambda c: (c + 0.5) / (total + 0.5 * (types + 1))

    def estimates(w, k, own):
        two = known.get(tuple(w[k - 1 : k + 1]), 0.0) if k else 0.0
        three = known.get(tuple(w[k - 2 : k + 1]), 0.0) if k > 1 else 0.0
        before = best(w[k - 1]) - own if k else 0.0
        earlier = known.get(tuple(w[k - 2 : k]), 0.0) if k > 1 else 0.0
        history = earlier * 1.5 if earlier - own >= 2 else 0.0
        kind = 2 if history else 1 if k and before >= 2 else 0
        p2 = min(1.0, (two - own) / max(before, 1)) if two - own >= 2 else 0.0
        p3 = min(1.0, (three - own) / max(history - own, 1)) if three - own >= 2 and two - own >= 2 and history else 0.0
        return kind, p2, p3

    cells = np.zeros((3, ngram_lm.BINS, ngram_lm.BINS))
    for w in training:
        for k in range(len(w)):
            kind, p2, p3 = estimates(w, k, 1)
            a, b = (int(ngram_lm._bin(np.array([p / p1(best(w[k]))]))[0]) for p in (p2, p3))
            cells[kind, a, b] += 1
    weights, out = ngram_lm._weights(cells), {}
    for i, w in words.items():
        out[i] = 0.0
        for k, x in enumerate(w):
            kind, p2, p3 = estimates(w, k, 0)
            c = best(x) if p2 or p3 else count[x,]
            out[i] += math.log10(weights[kind][0] * p1(c) + weights[kind][1] * p2 + weights[kind][2] * p3)
    return out


@pytest.mark.parametrize("head_share", [ngram_lm.HEAD_SHARE, 1e-3])
def test_scores_against_a_plain_version(spark, small, monkeypatch, head_share):
    monkeypatch.setattr(ngram_lm, "HEAD_SHARE", head_share)  # 1e-3 leaves most words beyond the head
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()])
    # So many bits that hardly a probe hits by chance; one that does moves a text by less than 1.
    got = {r.doc_id: r.score for r in ngram_lm.score_documents(docs, "doc_id", "text", bits=1024).collect()}
    assert got.keys() == want.keys()
    off = sorted(abs(got[i] - want[i]) for i in want)
    assert off[int(len(off) * 0.98)] < 0.01 and off[-1] < 1


def test_a_filter_too_large_to_broadcast_gives_the_same_scores(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None), (-1, ""), (-2, "never seen words here")], docs.schema))
    monkeypatch.setattr(ngram_lm, "SEGMENT_TOKENS", 25_000)
    shown = lambda: sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in ngram_lm.score_documents(docs, "doc_id", "text").collect()), key=str)
    one = shown()
    monkeypatch.setattr(ngram_lm, "FILTER_BYTES", 1)
    monkeypatch.setattr(ngram_lm, "BLOCK_OF_TEXTS", 50_000)
    assert shown() == one


def test_texts_that_occur_twice_score_higher(spark):
    rng = np.random.default_rng(6)
    text = lambda: " ".join(rng.choice([f"w{i}" for i in range(3000)], 60))
    # Ids of which none is held out; a text that another row repeats is better known to the model.
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1]
    twice = [text() for _ in range(50)]
    docs = list(zip(ids, [*twice, *twice, *[text() for _ in range(300)]], strict=False))
    rows = {r.doc_id: r.score - r.base_score for r in ngram_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    assert min(rows[i] for i in ids[:100]) > max(rows[i] for i in ids[100:400])


def test_scores_of_odd_rows(odd, none):
    rows = ngram_lm.score_documents(odd, "doc_id", "text").collect()
    check_scores(rows, [(r[0], r[1]) for r in ODD])
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert ngram_lm.score_documents(none, "doc_id", "text").count() == 0


def test_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = ngram_lm.score_documents(docs, "doc_id", "text").collect()
    check_scores(rows, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# ---------------------------------------------------------------- 1 pseudonyms


def rewritten(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [(r.text, r.n) for r in pseudonyms.pseudonymise(df, **{"key": "a key", "found": "n"} | more).orderBy("i").collect()]


def test_feistel_permutes_and_inverts(spark):
    cells = [([a, b, c],) for a in range(3) for b in range(4) for c in range(5)]
    radices = F.array(*[F.lit(x).cast("long") for x in (3, 4, 5)])
    df = spark.createDataFrame(cells, "d array<bigint>").withColumn("e", pseudonyms.feistel(F.col("d"), radices, F.lit("k")))
    back = df.withColumn("b", pseudonyms.feistel(F.col("e"), radices, F.lit("k"), inverse=True))
    assert back.select("e").distinct().count() == 60 and back.where("b = d").count() == 60


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    texts = [
        "card 4111 1111 1111 1111, 4111111111111111 not 4111111111111112.",
        "call +1 (172) 555-7713 or +44 20 7946 0958 190.137.223.204.",
        "mail étion.34@mail7.example.com or ÉTION.34@mail7.example.com",
        "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, not DE00370400440532013000",
        "born 1984-02-29, 29/02/1984; not 2021-02-30",
        "ssn 078-05-1120 not 666-12-1234",
        'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"',
        "v1.2.3 License 4.0. 999.1.1.1 costs 12345 in 2024",
        None,
        "",
        "plain words",
    ]
    got = rewritten(spark, texts)
    spaced, run = regex.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[0][0])[:2]
    assert spaced.replace(" ", "") == run and run != "4111111111111111" and luhn(run) and "4111111111111112" in got[0][0] and got[0][1] == 2
    assert regex.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \+44 \d\d \d{4} \d{4} [\d.]+\.", got[1][0]) and "555-7713" not in got[1][0] and "190.137" not in got[1][0] and got[1][1] == 3
    a, b = regex.findall(r"(\S+)@mail7.example.com", got[2][0])
    assert a.lower() == b.lower() and a != "étion.34"
    number = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    accounts = [s.replace(" ", "") for s in regex.findall(r"GB[\dA-Z ]+\d|DE\d+", got[3][0])]
    assert [number(s) for s in accounts[:2]] == [1, 1] and accounts[2] == "DE00370400440532013000" and got[3][1] == 2
    iso, dmy = regex.findall(r"(\d{4})-(\d\d)-(\d\d), (\d\d)/(\d\d)/(\d{4})", got[4][0])[0][:3], regex.findall(r"(\d\d)/(\d\d)/(\d{4})", got[4][0])[0]
    assert iso == dmy[::-1] and iso[0].startswith("19") and "2021-02-30" in got[4][0]
    assert "078-05-1120" not in got[5][0] and "666-12-1234" in got[5][0]
    assert regex.search(r'"[0-9a-f]{40}"', got[6][0]) and "9c8b4543" not in got[6][0]
    assert [g[0] for g in got[7:]] == texts[7:] and all(g[1] == 0 for g in got[7:])
    assert rewritten(spark, texts) == got and rewritten(spark, texts, key="other")[0] != got[0]


def test_phones_in_national_spacings(spark):
    # French, German, Spanish, British, American; the country code and the format stay.
    numbers = ["+33 6 12 34 56 78", "+336 12345678", "+33 (0)6 12 34 56 78", "+33.6.12.34.56.78", "+49 170 1234567", "+49 30 123456", "+49 30/123456", "+34 91 1234567", "+34 612 34 56 78", "+44 20 7946 0958", "+44 7911 123456", "+1 212-555-0187", "+33612345678"]
    got = rewritten(spark, [f"call {x}, or {x} 190.137.223.204." for x in numbers])
    digits = lambda x: regex.sub(r"\D", "", x)
    for number, (text, n) in zip(numbers, got, strict=True):
        shape = regex.sub("d", "[0-9]", regex.escape(regex.sub(r"\d", "d", number)))
        first, second = regex.fullmatch(rf"call ({shape}), or ({shape}) [0-9.]+", text).groups()
        assert n == 3 and first == second != number and first[:2] == number[:2], number
        assert "190.137" not in text
    assert digits(got[0][0][5:22]) == digits(got[1][0][5:18]) == digits(got[12][0][5:17])  # one number, three spacings
    # What follows is left alone when the whole has more than 15 digits; the number isn't.
    long, short = rewritten(spark, ["+49 170 1234567 12345", "+49 30 1234"])
    assert long[0].endswith(" 12345") and "1234567 " not in long[0] and long[1] == 1
    assert rewritten(spark, ["+49 30 12", "3+12345678"]) == [("+49 30 12", 0), ("3+12345678", 0)] and short[1] == 1


def test_spaced_accounts_end_at_their_countrys_length(spark):
    cases = {
        "AT61 1904 3002 3457 3201": ["TO PAY", "2024", "BIC x", "BE68 5390 0754 7034", "A", "NOW PAY 2024 ABCD"],
        "BE68 5390 0754 7034": ["2024 was", "BIC x", "AT61 1904 3002 3457 3201"],
        "PL61 1090 1014 0000 0712 1981 2874": ["OK", "2024"],
        "ES91 2100 0418 4502 0005 1332": ["Y", "2024"],
        "DE89 3704 0044 0532 0130 00": ["AB", "2024"],
        "FR14 2004 1010 0505 0001 3M02 606": ["2024"],
    }
    pairs = [(account, after) for account, more in cases.items() for after in more]
    for (account, after), (text, n) in zip(pairs, rewritten(spark, [f"{a} {b}" for a, b in pairs]), strict=True):
        new, rest = text[: len(account)], text[len(account) :]
        assert new != account and [len(g) for g in new.split(" ")] == [len(g) for g in account.split(" ")], account
        both = after.replace(" ", "").isalnum() and len(after) > 18 and after[2].isdigit()
        assert (n == 2 and rest != f" {after}") if both else (n == 1 and rest == f" {after}"), (account, after)
        flat = new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def test_pseudonyms_of_odd_rows(odd, none):
    out = pseudonyms.pseudonymise(odd, "k")
    assert out.columns == odd.columns and Counter(out.collect()) == Counter(odd.collect())
    assert pseudonyms.pseudonymise(none, "k").count() == 0


# ---------------------------------------------------------------- 4 chat


def brute_cost(roles):
    best = math.inf
    for kinds in itertools.product(range(4), repeat=len(roles)):
        state, cost = chat.NONE, 0.0
        for role, to in zip(roles, kinds, strict=True):
            if to == 0:  # join
                if state == chat.NONE:
                    cost = math.inf
                    break
                cost += chat.JOIN_SAME if role in (state, chat.NONE) else chat.JOIN_OTHER
                continue
            ways = [e for r, e in chat.MOVES[state] if r == to]
            if not ways:
                cost = math.inf
                break
            cost += chat.INSERT * min(map(len, ways)) + (0 if to == role else chat.NAME_UNKNOWN if role == 0 else chat.RELABEL)
            state = to
        best = min(best, cost + chat.INSERT * len(chat.ENDING[state]))
    return best


def test_repair_is_cheapest():
    for roles in itertools.chain.from_iterable(itertools.product(range(4), repeat=n) for n in range(5)):
        cut = len(roles) // 2
        whole, cost = chat.fold([chat.block_costs(list(roles))])
        assert cost == brute_cost(roles)
        assert chat.fold([chat.block_costs(list(roles[:cut])), chat.block_costs(list(roles[cut:]))])[1] == cost
        path = chat.block_path(list(roles), whole[0], whole[-1])
        assert sum(p[0] for p in path) + chat.INSERT * len(chat.ENDING[whole[-1]]) == cost


def test_chat_frames(spark, monkeypatch):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
        (2, 0, "assistant", "a"), (2, 1, "user", "b"), (2, 2, "user", "c"),
        (None, 0, "user", "x"), (3, None, None, None), (1, 0, "user", "hi"),
        (4, 0, "system", "s <|im_end|>"), (4, 1, "GPT", "y"),
    ]
    turns += [(9, t, "human" if t % 2 == 0 else "bot", f"t{t}") for t in range(1300)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    rows = chat.format_conversations(df).orderBy("conv_id", "segment").collect()
    text = {}
    for r in rows:
        text[r.conv_id] = text.get(r.conv_id, "") + r.text
    assert text[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert text[2] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nb\nc<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert "s <| im_end|>" in text[4] and len([r for r in rows if r.conv_id == 9]) == 3 and text[9].count("<|im_start|>") == 1300
    assert set(text) == {1, 2, 3, 4, 9, None}
    legal = regex.compile(r"(<\|im_start\|>system\n.*?<\|im_end\|>\n)?(<\|im_start\|>user\n.*?<\|im_end\|>\n<\|im_start\|>assistant\n.*?<\|im_end\|>\n)+", regex.S)
    assert all(legal.fullmatch(t) for t in text.values())
    assert chat.format_conversations(df.limit(0)).count() == 0


def plain_chats(turns):
    """{conversation: (turns, cost, rendering)}, one conversation at a time, without blocks."""
    by = {}
    for c, n, role, text in set(turns):
        by.setdefault(c, []).append((n is None, n or 0, role is None, role or "", text or ""))
    out = {}
    for c, rows in by.items():
        rows.sort()
        roles = [chat.role_of(None if none else r) for _, _, none, r, _ in rows]
        states, cost = chat.fold([chat.block_costs(roles)])
        out[c] = (len(rows), cost, chat.render(chat.block_path(roles, states[0], states[-1]), [r[-1] for r in rows], states[0], True)[0])
    return out


@pytest.mark.parametrize(("block", "fan"), [(512, 512), (4, 3)])
def test_chat_against_a_plain_version(spark, small, monkeypatch, block, fan):
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "FAN", fan)  # 3: matrices of long conversations are folded in levels
    monkeypatch.setattr(chat, "GROUP_ROWS", 40)
    roles = ["user", "assistant", "system", "human", None, "narrator", "gpt"]
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    turns += [(-1, t, roles[t * t % 7], f"t{t:03d}") for t in range(150)] + [(-2, None, roles[t % 7], f"t{t:03d}") for t in range(100)]
    turns += [(-3, 0, "user", f"t{t:03d}") for t in range(70)] + [(None, t % 5, roles[t % 3], f"t{t:03d}") for t in range(90)] + turns[:50]
    # One host, all turns null or equal: no task may hold the conversation whole.
    rows = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.segment):
        n, _, shown = got.get(r.conv_id, (0, 0, ""))
        assert r.n_in <= block and r.segment < r.segments
        got[r.conv_id] = (n + r.n_in, r.cost, shown + r.text)
    want = plain_chats(turns)
    if block == 512:
        assert got == want
    # Shorter blocks may choose another of the cheapest repairs: as many turns, the cost, the texts in order, legal.
    bare = lambda shown: regex.sub(r"<\|im_(start\|>\w+|end\|>)\n|\n", "", shown)
    assert {c: (n, cost, bare(shown)) for c, (n, cost, shown) in got.items()} == {c: (n, cost, bare(shown)) for c, (n, cost, shown) in want.items()}
    legal = regex.compile(r"(<\|im_start\|>system\n.*?<\|im_end\|>\n)?(<\|im_start\|>user\n.*?<\|im_end\|>\n<\|im_start\|>assistant\n.*?<\|im_end\|>\n)+", regex.S)
    assert all(legal.fullmatch(shown) for _, _, shown in got.values())


# ---------------------------------------------------------------- 2 mixing


def filled(sizes, weights, cap=3):
    """Targets by resharing the excess until none is above."""
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        open_ = [s for s in sizes if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        target = {s: cap * sizes[s] if s in full else left * weights[s] / sum(weights[x] for x in open_) for s in sizes}
        over = {s for s in open_ if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1, "d": 50, None: 7}, {"a": 5}, {"a": 0, "b": 9}, {"Z": 1, "a": 1, "é": 1, "b": 1000}])
def test_targets(spark, sizes):
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(ordered)}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    for r in got:
        assert r.target == pytest.approx(filled(sizes, weights)[r.source])


def test_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        entry = by.setdefault(r.source, [r.target, 0])
        entry[1] += r.taken
    assert all(abs(taken - target) <= 0.05 * target + 3 for target, taken in by.values())
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect()) == sorted((r.doc_id, r.taken) for r in rows)
    again = mixing.mixed(docs)
    assert again.columns == docs.columns
    assert Counter(r.doc_id for r in again.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_rates_and_copies_against_a_plain_version(spark, small):
    """Rates by halving an interval for each source; copies are a neighbour of the rate and add up to the target."""
    rows = mixing.mix(spark.read.parquet(f"{small}/documents.parquet")).collect()
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    for mine in sources.values():
        sizes = np.array([r["size"] for r in mine if r["size"]], float)
        target, low, high = mine[0].target, -60.0, 60.0
        rate = lambda x: 3 / (1 + 2 * np.exp(-np.clip(x * sizes / sizes.mean(), -700, 700)))  # noqa: E731, B023
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if (sizes * rate(middle)).sum() < target else (low, middle)
        want = np.full(len(sizes), 3.0) if target >= 3 * sizes.sum() else rate(low)
        got = [r for r in mine if r["size"]]
        assert np.abs([r.rate for r in got] - want).max() < 2e-4
        assert all(math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in got)
        assert abs(sum(r.taken for r in got) - target) <= 0.05 * target + 3


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.source, r.source_size) for r in rows} == {("a", 30_009), ("b", 101), ("c", 1), (None, 0)}
    assert mixing.mix(none).count() == 0


# ---------------------------------------------------------------- 5 toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_all_within_one_edit():
    lexicon = toxicity.Lexicon({"idiot": 1.0, "clown": 0.5, "bad": 0.7}, {"lowe": 0.9})
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("idotclwnbae"), rng.integers(1, 8))) for _ in range(4000)]
    words += ["idiot", "idot", "idiiot", "xdiot", "clwn", "bad", "bxd", "lowering", "lxwe", "ciown", "idiots", "dioti"]
    classes = np.append(lexicon.classes[np.frombuffer(" ".join(words).encode(), np.uint8)], 0)
    _, hit, near = lexicon.match(classes)
    for word, h, n in zip(words, hit, near, strict=True):
        assert h == pytest.approx(max([w for t, w in lexicon.words.items() if t == word] + [0.9 * word.startswith("lowe")]))
        if h == 0:
            assert n == pytest.approx(max([w for t, w in lexicon.words.items() if len(t) >= 5 and distance(t, word) == 1], default=0.0)), word


def test_context():
    lexicon = toxicity.Lexicon({"idiot": 1.0}, {})
    x = dict(zip(toxicity.FEATURES, toxicity.features(['He said "what an idiot" today', "you idiot", "an idiot here", "an 1diot", None, ""], lexicon).T, strict=True))
    assert (x["quoted"] > 0).tolist() == [True] + [False] * 5
    assert (x["plain"] > 0).tolist() == [False, True, True, False, False, False]
    assert (x["address"] > 0).tolist() == [False, True] + [False] * 4
    assert x["fuzzy"][3] > 0 and x["plain"][4] == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    for docs in (odd, none):
        model = toxicity.train(docs, labels, "doc_id", "text")
        rows = toxicity.score(docs.select("doc_id", "text").withColumn("score", F.lit("clash")), "text", *model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    nothing = toxicity.train(odd, labels.limit(0), "doc_id", "text")
    found = toxicity.score(spark.createDataFrame([("you are an idiot and a moron, a pathetic clown",), ("a fine day",)], "text string"), "text", *nothing).collect()
    assert [r.predicted for r in found] == [1, 0]


def test_workspace(spark):
    work = Workspace(spark, "test")
    kept = work.keep(spark.range(3), "a")
    assert kept.count() == 3 and work.again("a").count() == 3
    work.drop("a")
