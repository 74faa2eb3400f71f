"""I-Match fingerprints from randomised lexicons. DataFrame operations only.

A term is a lower-cased word. The lexicon holds the terms whose inverse document frequency lies in a
band: those that occur in between N * ``RARE`` and N * ``COMMON`` of the N texts (at least 2, and the
upper end never below 4). A text's distinct terms of the lexicon are sorted by their 64-bit hash;
each of ``CHAINS`` * ``LEVELS`` randomised lexicons keeps a share of the terms (an eighth, a 16th, ...,
each level of a chain a part of the level above), and the hash of what it keeps, in order, is one part of
the fingerprint. Coarse levels speak for short texts, fine levels for long ones. The likeness
of two fingerprints is the share of equal parts among those that are not empty in both.

Where a large group of copies or near copies shares its words, these are above the band. A text with
fewer than ``LEAST`` of its known terms (band or above) in the band is therefore given its own rarest
terms above it, up to that share, so that its parts speak for the whole text at any size of the group.

The band's lower end bounds the lexicon: at most (mean distinct terms of a text) / RARE terms, and those
above it are at most (mean distinct terms) / COMMON. All are broadcast when their counted size is at
most ``BROADCAST`` terms; else those above the band are broadcast and the band is joined by a shuffle.

Defined results: null counts as empty text. A text of whose terms no lexicon keeps any has parts from the
hash of its whole text, so only equal texts are alike. Rows that repeat an id and a text
share a fingerprint; each gives a row. Rows with equal ids follow each other in order of a text hash. A
null id comes first. A table of one text has itself as the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import Workspace

RARE, COMMON = 1 / 2000, 1 / 200
#: The share of a text's known terms that its fingerprint is made of at least.
LEAST = 1 / 4
CHAINS, LEVELS = 16, 5
#: The first level of a chain keeps one term in 2**FIRST_BITS, each later one half of the level above.
FIRST_BITS = 3
BROADCAST = 1 << 20
#: A word that stands for the text itself, so that texts without a term of the lexicon keep a row.
SELF = "\x01"
#: Groups that one task's aggregation may hold before it sorts (a group is a text's terms).
GROUPS = 100_000


def split_words(text: Column) -> Column:
    """Lower-cased words; an empty one where blanks meet. The one-character split takes no regex."""
    return F.split(F.regexp_replace(F.lower(text), r"[\x09-\x0D]", " "), " ")


def _kept(chain: int, depth: int):
    """Whether a level keeps a term. The first takes bits of the term's hash itself, other ones for each
    chain; the rare terms left for deeper levels are hashed anew."""
    if depth == 0:
        return lambda t: t.bitwiseAND(F.lit(((1 << FIRST_BITS) - 1) << (FIRST_BITS * chain)).cast("long")) == 0
    return lambda t: F.xxhash64(t, F.lit(chain)).bitwiseAND(F.lit(1 << (depth - 1)).cast("long")) == 0


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a transform of one element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(terms: Column, fallback: Column) -> Column:
    """Fingerprint parts (array of smallint, 0 for an empty part) of a sorted array of term hashes."""
    short = lambda h: (F.pmod(h, F.lit(32767)) + 1).cast("smallint")

    def chain_parts(chain: int):
        def body(first: Column) -> Column:
            out, level = [], first
            for depth in range(LEVELS):
                level = level if depth == 0 else F.filter(level, _kept(chain, depth))
                out.append(let(level, numbered(chain * LEVELS + depth)))
            return F.array(*out)

        return body

    def numbered(i: int):
        return lambda x: F.when(F.size(x) > 0, short(F.xxhash64(x, F.lit(i)))).otherwise(F.lit(0).cast("smallint"))

    # The first level of a chain looks at all terms, once; all others at an eighth of them or less.
    made = F.flatten(F.array(*[let(F.filter(terms, _kept(chain, 0)), chain_parts(chain)) for chain in range(CHAINS)]))
    whole = F.array(*[short(F.xxhash64(fallback, F.lit(i))) for i in range(CHAINS * LEVELS)])
    return let(made, lambda a: F.when(F.exists(a, lambda x: x != 0), a).otherwise(whole))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those not empty in both; 1 when all are empty in both."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    some = F.size(F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0)))
    same = F.size(F.filter(pairs, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
    return F.when(some == 0, F.lit(1.0)).otherwise(same / some)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.when(x == 0, F.lit("-")).otherwise(F.lower(F.hex(x.cast("long"))))), ".")


def successors(texts: DataFrame, work: Workspace) -> DataFrame:
    """(id, k, th, n, copies, next_k, next_th) for the distinct rows: the next in order of (id, th),
    after the last the first.

    Order within range partitions, then across their first rows; no global window over rows.
    """
    keys = texts.groupBy("id", "k", "th").agg(F.count(F.lit(1)).alias("copies"), F.max(F.char_length("text")).alias("n"))
    parted = work.keep(keys.repartitionByRange("id", "th").withColumn("pid", F.spark_partition_id()), "ranged")
    firsts = parted.groupBy("pid").agg(F.min(F.struct("id", "th", "k")).alias("first"))
    every = Window.partitionBy().orderBy("pid")  # one row a partition
    later = F.coalesce(F.lead("first").over(every), F.first("first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    later = firsts.select(F.col("pid").alias("lp"), later.alias("later"))
    inside = F.lead(F.struct("id", "th", "k")).over(Window.partitionBy("pid").orderBy("id", "th"))
    rows = parted.withColumn("inside", inside).join(later, F.col("pid") == F.col("lp"))
    follow = F.coalesce("inside", "later")
    return work.keep(rows.select("id", "k", "th", "n", "copies", follow["k"].alias("next_k"), follow["th"].alias("next_th")), "successors")


def lexicon(texts: DataFrame, text: str, work: Workspace) -> DataFrame:
    """(term, df, common) of the band and, as ``common``, above it, from the document frequencies in all texts."""
    n = texts.count()
    words = texts.select(F.explode(F.array_distinct(split_words(F.col(text)))).alias("word")).where("word <> ''")
    often = words.select(F.xxhash64("word").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return work.keep(often.where(F.col("df") >= max(2.0, n * RARE)).withColumn("common", F.col("df") > max(4.0, n * COMMON)), "lexicon")


def chosen(band: Column, common: Column) -> Column:
    """Sorted terms of a text: those of the band and, where they are too few, its rarest above it."""

    def body(v):
        wanted = F.ceil((F.size(v["band"]) + F.size(v["common"])) * F.lit(LEAST)).cast("int")
        more = F.slice(v["common"], F.lit(1), F.greatest(F.lit(0), wanted - F.size(v["band"])))
        return F.when(F.size(v["band"]) >= wanted, v["band"]).otherwise(F.array_sort(F.concat(v["band"], F.transform(more, lambda c: F.xxhash64(c)))))

    return let(F.struct(band.alias("band"), common.alias("common")), body)


def fingerprints(rows: DataFrame, lex: DataFrame, small: bool) -> DataFrame:
    """(k, th, sha, own, edited): parts for ``text`` and ``edit`` of each (k, th)."""
    both = F.array(F.struct(F.lit(0).alias("kind"), F.concat("text", F.lit(" " + SELF)).alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edit").alias("t")))
    texts = rows.select("k", "th", F.sha2("edit", 256).alias("sha"), F.xxhash64("edit").alias("eh"), F.explode(both).alias("b")).select("k", "th", "sha", "eh", "b.kind", "b.t")
    words = texts.select("k", "th", "kind", "sha", "eh", F.explode(split_words(F.col("t"))).alias("word")).where("word <> ''")
    about = (F.col("word") == SELF) & (F.col("kind") == 0)
    flat = words.select("k", "th", "kind", F.xxhash64("word").alias("term"), F.when(about, F.col("sha")).alias("sha"), F.when(about, F.col("eh")).alias("eh"))
    # A term above the band as one number: its document frequency, then half of its hash. 0 in the band.
    rank = F.when(F.col("common"), F.shiftleft(F.least(F.col("df"), F.lit((1 << 31) - 1)), 32).bitwiseOR(F.col("term").bitwiseAND(F.lit((1 << 32) - 1)))).otherwise(F.lit(0).cast("long"))
    known = lex.select("term", rank.alias("rank"))
    self = lex.sparkSession.range(1).select(F.xxhash64(F.lit(SELF)).alias("term"), F.lit(-1).cast("long").alias("rank"))
    if small:
        joined = flat.join(F.broadcast(known.union(self)), "term")
    else:
        above = F.broadcast(known.where("rank > 0").union(self))
        joined = flat.join(above, "term").unionByName(flat.join(above, "term", "left_anti").join(known.where("rank = 0"), "term"))
    some = lambda k, of, value: F.array_sort(F.array_distinct(F.collect_list(F.when((F.col("kind") == k) & of, F.col(value)))))
    band, above = F.col("rank") == 0, F.col("rank") > 0
    terms = [some(k, of, value).alias(f"{name}{k}") for k in (0, 1) for name, of, value in (("band", band, "term"), ("common", above, "rank"))]
    grouped = joined.groupBy("k", "th").agg(*terms, F.max("sha").alias("sha"), F.max("eh").alias("eh"))
    grouped = grouped.select("k", "th", "sha", "eh", chosen(F.col("band0"), F.col("common0")).alias("own"), chosen(F.col("band1"), F.col("common1")).alias("edited"))
    return grouped.select("k", "th", "sha", parts(F.col("own"), F.col("th")).alias("own"), parts(F.col("edited"), F.col("eh")).alias("edited"))


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next row's.
    """
    work = Workspace(docs.sparkSession, "imatch")
    docs.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPS))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    texts = texts.withColumn("k", F.xxhash64("id")).withColumn("th", F.xxhash64("text"))
    follow = successors(texts, work)
    lex = lexicon(texts, "text", work)
    small = lex.count() <= BROADCAST
    # Both uses of the texts read one shuffle; what a row needs of the next is a second, half as large.
    unique = texts.groupBy("k", "th").agg(F.first("text").alias("text"))
    asked = follow.select(F.col("k").alias("for_k"), F.col("th").alias("for_th"), F.floor(F.col("n") / 2).cast("int").alias("half"), F.col("next_k").alias("k"), F.col("next_th").alias("th"))
    given = unique.join(asked, ["k", "th"]).select(F.col("for_k").alias("k"), F.col("for_th").alias("th"), "half", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("prefix"))
    edit = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - F.col("half")), F.col("prefix"))
    rows = unique.join(given, ["k", "th"]).select("k", "th", "text", edit.alias("edit"))
    prints = work.keep(fingerprints(rows, lex, small), "prints")
    after = prints.select(F.col("k").alias("next_k"), F.col("th").alias("next_th"), F.col("own").alias("next_own"))
    full = prints.join(follow, ["k", "th"]).join(after, ["next_k", "next_th"])
    full = full.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return full.select(
        F.col("id").alias(doc_id),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
