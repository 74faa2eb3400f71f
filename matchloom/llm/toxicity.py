"""Toxicity scores from a learned lexicon, matched by Levenshtein automata.

1. Lexicon. From labelled training texts (at most ``MAX_LABELLED``, taken by hash), words of any length and
   script and word stems of 4 to 6 letters are kept whose likelihood ratio speaks for label 1; a given
   base list is added. In scripts without blanks between words, all runs of 2 to 4 letters stand for
   words. Every term that passes the tests is kept: each is in ``LEAST_TEXTS`` of the sampled
   texts at least, which bounds their number by the sample.
2. Matching. The terms form a trie. The automaton that runs over a word is the trie intersected with
   Levenshtein automata: its states are sets of (trie node, edits so far), made when first met and kept in a
   transition table, so that all words of a block step through it together; the table is emptied between
   blocks when it has grown large. Words of FUZZY letters or more match within one edit, shorter
   words and stems exactly. Letters of all scripts have classes of their own where the lexicon uses them.
3. Context. A match between a pair of quotation marks at most ``QUOTE_SPAN`` apart, or with a word of reporting
   in the window before it, counts as quotation; one with a second-person word in its window counts as
   address; all others as plain use. A mark without a partner quotes nothing.
4. Score. A logistic model over sums of term weights by kind of match and context, fitted on
   the same labelled texts with a ridge towards prior weights, so that few labels change little.

Labels, language, source and id are never inputs. Defined results: null and empty texts score the
model's base rate; texts are read whole; rows that repeat an id are scored one by one; labels
that are null, or of ids without a text, are ignored; without any labels the prior weights hold.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import tidy

MAX_LABELLED = 10_000
FUZZY = 5
WINDOW, QUOTE_SPAN = 40, 400
STEMS = (4, 5, 6)
#: Lengths of the runs that stand for words where a script has no blanks.
RUNS = (2, 3, 4)
#: A term's least likelihood-ratio statistic, log odds and number of toxic texts.
LEAST_G, LEAST_ODDS, LEAST_TEXTS = 15.0, 3.0, 4
#: Cells of the transition table from which it is emptied before the next block.
TABLE = 1 << 22
#: The base list of terms, words that report speech, words that address someone.
BASE_TERMS = ["idiot", "moron", "stupid", "loser", "clown", "trash", "scum", "worthless", "pathetic", "disgusting"]
REPORTING = ["said", "says", "wrote", "called", "quote", "quoted", "quoting", "reported", "claimed", "dit", "écrit", "disait", "sagte", "schrieb", "nannte", "dijo", "dice", "escribió"]
ADDRESS = ["you", "your", "youre", "you're", "tu", "toi", "vous", "votre", "du", "dich", "dein", "ihr", "tú", "usted", "vosotros"]
QUOTES = '"“”„«»'
#: Scripts that are written without blanks between words.
DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
DENSE_RANGES = [(0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
FEATURES = ("bias", "plain", "quoted", "fuzzy", "fuzzy_quoted", "address", "density")
PRIOR = np.array([-3.0, 2.0, 0.3, 1.0, 0.1, 0.5, 0.5])
RIDGE = np.array([0.01, 0.5, 2.0, 2.0, 2.0, 2.0, 0.5])

DEAD = 0


@functools.cache
def letters_of_words() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is part of a word, and whether its script has no blanks."""
    solid = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), bool, 0x110000)
    dense = np.zeros(0x110000, bool)
    for low, high in DENSE_RANGES:
        dense[low : high + 1] = True
    return solid, dense & solid


class Lexicon:
    """Terms (word or stem, with a weight) as an automaton that is determinised as words need it."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        solid, self.dense = letters_of_words()
        letters = {c: i + 1 for i, c in enumerate(sorted(set("".join([*words, *stems]))))}
        self.other = len(letters) + 1
        #: Character classes: 0 separates words, then the lexicon's letters, then all other letters.
        self.classes = np.where(solid, self.other, 0).astype(np.int32)
        for c, k in letters.items():
            self.classes[ord(c)] = k
        self.children: list[dict[int, int]] = [{}]
        self.word_at: list[float] = [0.0]
        self.stem_at: list[float] = [0.0]
        self.slack: list[int] = [0]
        self.long_word: list[bool] = [False]
        for terms, at in ((words, self.word_at), (stems, self.stem_at)):
            for term, weight in terms.items():
                node = 0
                path = [0]
                for c in term:
                    k = letters[c]
                    if k not in self.children[node]:
                        self.children[node][k] = len(self.children)
                        self.children.append({})
                        self.word_at.append(0.0), self.stem_at.append(0.0), self.slack.append(0), self.long_word.append(False)
                    node = self.children[node][k]
                    path.append(node)
                at[node] = max(at[node], weight)
                if terms is words and len(term) >= FUZZY:
                    self.long_word[node] = True
                    for n in path:  # an edit is worth following only towards a word long enough
                        self.slack[n] = 1
        self.empty()

    def __getstate__(self):
        return self.words, self.stems  # the automaton is made anew where it is used

    def __setstate__(self, terms):
        self.__init__(*terms)

    def empty(self) -> None:
        """Forget all states but the first two; they are made again when met."""
        self.ids: dict[frozenset, int] = {frozenset(): DEAD}
        self.sets: list[frozenset] = [frozenset()]
        self.next = np.full((1024, self.other + 1), -1, np.int32)
        self.next[DEAD] = DEAD
        self.exact, self.near, self.stem = (np.zeros(1024) for _ in range(3))
        self.start = self._state(self._closure({(0, 0)}))

    def _closure(self, items: set) -> frozenset:
        """With what skipping a letter of a term (an edit) reaches; no worse duplicates."""
        best: dict[int, int] = {}
        for node, edits in items:
            best[node] = min(edits, best.get(node, 9))
            if edits == 0 and self.slack[node]:
                for child in self.children[node].values():
                    if self.slack[child]:
                        best[child] = min(1, best.get(child, 9))
        return frozenset(best.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.ids:
            k = len(self.sets)
            self.ids[items] = k
            self.sets.append(items)
            if k == len(self.next):
                self.next = np.vstack([self.next, np.full_like(self.next, -1)])
                self.exact, self.near, self.stem = (np.concatenate([x, np.zeros(k)]) for x in (self.exact, self.near, self.stem))
            self.exact[k] = max([self.word_at[n] for n, e in items if e == 0], default=0.0)
            self.near[k] = max([self.word_at[n] for n, e in items if e == 1 and self.long_word[n]], default=0.0)
            self.stem[k] = max([self.stem_at[n] for n, e in items if e == 0], default=0.0)
        return self.ids[items]

    def _step(self, state: int, letter: int) -> int:
        out: set = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(letter)
            if child is not None and (edits == 0 or self.slack[child]):
                out.add((child, edits))
            if edits == 0 and self.slack[node]:
                out.add((node, 1))  # a letter too many
                out.update((c, 1) for k, c in self.children[node].items() if k != letter and self.slack[c])
        return self._state(self._closure(out))

    def match(self, classes: np.ndarray, dense: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all words, and for each its weight as an exact word or stem, and as a near one;
        ``classes`` ends with a 0. Every letter marked ``dense`` may begin a word."""
        if len(self.sets) * (self.other + 1) > TABLE:
            self.empty()
        solid = classes > 0
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        if dense is not None:
            first |= dense
            first[1:] |= solid[1:] & dense[:-1]
        starts = np.flatnonzero(first)
        hit, near = np.zeros(len(starts)), np.zeros(len(starts))
        live, at = np.arange(len(starts)), starts.copy()
        state = np.full(len(starts), self.start, np.int32)
        while len(live):
            letter = classes[at]
            ended = letter == 0
            if ended.any():
                over, s = live[ended], state[ended]
                hit[over] = np.maximum(hit[over], self.exact[s])
                near[over] = self.near[s]
                go = ~ended
                live, at, state, letter = live[go], at[go], state[go], letter[go]
            to = self.next[state, letter]
            fresh = np.flatnonzero(to == -1)
            if len(fresh):
                wide = self.other + 1
                for key in np.unique(state[fresh].astype(np.int64) * wide + letter[fresh]):
                    s, c = divmod(int(key), wide)
                    k = self._step(s, c)  # may enlarge the table
                    self.next[s, c] = k
                to = self.next[state, letter]
            stem = self.stem[to]
            some = stem > 0
            hit[live[some]] = np.maximum(hit[live[some]], stem[some])
            go = to != DEAD
            live, at, state = live[go], at[go] + 1, to[go]
        return starts, hit, near


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """(texts, FEATURES) of whole texts; texts are joined into blocks of about a million characters."""
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, 0] = 1.0
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") < 1_000_000):
            size += len(texts[last] or "")
            last += 1
        lowered = [(t or "").lower() for t in texts[first:last]]
        out[first:last, 1:] = _block(lowered, lexicon)
        first = last
    return out


def _block(lowered: list[str], lexicon: Lexicon) -> np.ndarray:
    joined = "\n".join([*lowered, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros((len(lowered), len(FEATURES) - 1))
    points = np.minimum(points, 0x10FFFF)
    dense = lexicon.dense[points]
    starts, hit, near = lexicon.match(lexicon.classes[points], dense if dense.any() else None)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    found = np.flatnonzero((hit > 0) | (near > 0))
    at = starts[found]
    row = np.searchsorted(begin, at, "right") - 1
    inside = _quoted(joined, points, begin, at, row)
    reported, addressed = np.zeros(len(found), bool), np.zeros(len(found), bool)
    for i, (p, r) in enumerate(zip(at.tolist(), row.tolist(), strict=True)):
        ahead = joined[max(int(begin[r]), p - WINDOW) : p].split()
        after = joined[p : min(int(begin[r + 1]), p + WINDOW)].split()
        reported[i] = any(w.strip(".,:;!?") in _REPORTING for w in ahead)
        addressed[i] = any(w.strip(".,:;!?") in _ADDRESS for w in ahead) or any(w.strip(".,:;!?") in _ADDRESS for w in after)
    quoted = inside | reported
    total = lambda w, mask: np.bincount(row[mask], w[found][mask], len(lowered))
    exact = hit[found] > 0
    words = np.bincount(np.searchsorted(begin, starts, "right") - 1, minlength=len(lowered))[: len(lowered)]
    plain = total(hit, exact & ~quoted)
    density = plain / np.maximum(words, 1) * 100
    columns = [plain, total(hit, exact & quoted), total(near, ~exact & ~quoted), total(near, ~exact & quoted), np.bincount(row[addressed & ~quoted], minlength=len(lowered)).astype(float), density]
    return np.log1p(np.stack(columns, 1))


_REPORTING, _ADDRESS = frozenset(REPORTING), frozenset(ADDRESS)


def _quoted(joined: str, points: np.ndarray, begin: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` (of texts ``row``) stand between two marks that belong together: the first
    doesn't follow a letter or digit, the second follows no blank, and they are at most QUOTE_SPAN apart."""
    out = np.zeros(len(at), bool)
    marks = np.flatnonzero(np.isin(points, _QUOTES))
    if not len(marks):
        return out
    for r in np.unique(row):
        mine = marks[np.searchsorted(marks, begin[r]) : np.searchsorted(marks, begin[r + 1])].tolist()
        opens, closes, i = [], [], 0
        while i + 1 < len(mine):
            a, b = mine[i], mine[i + 1]
            if b - a <= QUOTE_SPAN and not (a > begin[r] and joined[a - 1].isalnum()) and not joined[b - 1].isspace():
                opens.append(a), closes.append(b)
                i += 1
            i += 1
        if opens:
            here = np.flatnonzero(row == r)
            k = np.searchsorted(opens, at[here]) - 1
            out[here] = (k >= 0) & (at[here] < np.array(closes)[np.maximum(k, 0)])
    return out


_QUOTES = np.array([ord(c) for c in QUOTES], np.uint32)


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """From rows (text, toxic): the terms whose presence speaks for label 1."""
    lowered = F.lower(F.coalesce("text", F.lit("")))
    # Only texts with such letters are searched for them: the classes of whole scripts are slow to test.
    dense = (F.octet_length(lowered) > F.char_length(lowered)) & lowered.rlike(f"[{DENSE}]")
    found = lambda pattern, group=0: F.regexp_extract_all(lowered, F.lit(pattern), F.lit(group))
    words = F.array_distinct(F.when(dense, found(rf"[\p{{L}}\p{{M}}&&[^{DENSE}]]+")).otherwise(found(r"[\p{L}\p{M}]+")))
    stems = F.array_distinct(F.concat(*[F.transform(words, _stem(n)) for n in STEMS]))
    runs = F.array_distinct(F.concat(*[F.transform(found(rf"(?=([{DENSE}]{{{n}}}))", 1), lambda r: F.concat(r, F.lit("*"))) for n in RUNS]))
    each = F.concat(words, F.filter(stems, lambda s: s.isNotNull()), F.when(dense, runs).otherwise(F.array().cast("array<string>")))
    size = rows.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    pos, neg = float(size["p"] or 0), float(size["n"] or 0)
    if not pos or not neg:
        return Lexicon(dict.fromkeys(BASE_TERMS, 1.0), {})
    counts = rows.select("toxic", F.explode(each).alias("term")).groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b")).where(F.col("a") >= LEAST_TEXTS)
    a, b, t = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    part = lambda x, share: F.when(x > 0, x * F.log(x / (t * share))).otherwise(0.0)
    g = 2 * (part(a, pos / (pos + neg)) + part(b, neg / (pos + neg)))
    odds = F.log(((a + 0.5) / (pos + 1)) / ((b + 0.5) / (neg + 1)))
    best = counts.select("term", odds.alias("odds"), g.alias("g")).where((F.col("g") >= LEAST_G) & (F.col("odds") >= LEAST_ODDS)).collect()
    words_, stems_ = dict.fromkeys(BASE_TERMS, 1.0), {}
    for r in sorted(best, key=lambda r: (len(r["term"]), r["term"])):
        weight = min(1.0, r["odds"] / 5.0)
        if r["term"].endswith("*"):
            stem = r["term"][:-1]
            if not any(stem[:k] in stems_ for k in range(1, len(stem))):
                stems_[stem] = weight
        else:
            words_[r["term"]] = max(weight, words_.get(r["term"], 0.0))
    return Lexicon(words_, stems_)


def _stem(n: int):
    return lambda w: F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*")))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with the ridge towards PRIOR."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - RIDGE * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(RIDGE), gradient)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _apply(df: DataFrame, text: str, shared, schema: str, finish) -> DataFrame:
    """Features of the last column of each batch, given to ``finish`` with the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = shared.value
        for batch in batches:
            yield finish(batch, features(batch.column(batch.num_columns - 1).to_pylist(), lexicon), weights)

    return df.mapInArrow(tidy(run), schema)


def train(df: DataFrame, labels: DataFrame, doc_id: str, text: str, fold: int = 0):
    """The lexicon and the weights, from labels whose crc32(id as text) mod 5 is not ``fold``."""
    ids = labels.select(F.col(doc_id).alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and __id is not null")
    ids = ids.where(F.crc32(F.col("__id").cast("string")) % 5 != fold).orderBy(F.xxhash64("__id"), "__id", "toxic").limit(MAX_LABELLED)
    # At most MAX_LABELLED ids: a broadcast of them filters the scan of the texts.
    chosen = df.sparkSession.createDataFrame(ids.collect(), ids.schema)
    rows = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id").select("toxic", "text")
    lexicon = learn_lexicon(rows)
    shared = df.sparkSession.sparkContext.broadcast((lexicon, None))
    names = ["toxic", *FEATURES]

    def finish(batch, x, _):
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in x.T]], names)

    got = _apply(rows, "text", shared, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES), finish).toArrow()
    if not got.num_rows:
        return lexicon, PRIOR.copy()
    return lexicon, fit(np.stack([got[f].to_numpy() for f in FEATURES], 1), got["toxic"].to_numpy().astype(float))


def accepted(df: DataFrame, text: str, lexicon: Lexicon, weights: np.ndarray) -> DataFrame:
    """The rows of ``df`` that the model doesn't reject, with all their columns, whatever these are called."""
    shared = df.sparkSession.sparkContext.broadcast((lexicon, weights))
    place, names = df.columns.index(text), [f"k{i}" for i in range(len(df.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = shared.value
        for batch in batches:
            yield batch.filter(pa.array(features(batch.column(place).to_pylist(), lexicon) @ w < 0))

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields, strict=True))
    return df.toDF(*names).mapInArrow(tidy(run), kinds).toDF(*df.columns)


def score(df: DataFrame, text: str, lexicon: Lexicon, weights: np.ndarray) -> DataFrame:
    """``df`` with score and predicted; map-side only. Columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast((lexicon, weights))
    keep = [f for f in df.schema.fields if f.name not in ("score", "predicted")]
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, keep, strict=True)), "score double, predicted int"])

    def finish(batch, x, w):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    columns = [F.col(f"`{f.name}`").alias(n) for n, f in zip(names, keep, strict=True)]
    done = _apply(df.select(*columns, F.col(f"`{text}`").alias("__text")), text, shared, schema, finish)
    return done.select(*[F.col(n).alias(f.name) for n, f in zip(names, keep, strict=True)], "score", "predicted")
