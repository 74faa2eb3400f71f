"""Tag sets as sorted arrays without nulls: tagging, overlap, conflict, labels, attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions import vocab
from matchloom.functions.text import as_column, empty_strings, normalize, strip


def literals(values) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else empty_strings()


def tag(text: Column | str, words: vocab.Vocabulary = vocab.MUSIC) -> Column:
    """The tags whose patterns occur in a text, sorted; one alternation per tag."""
    norm = normalize(text)
    found = F.array(*[F.when(norm.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(t)) for t, patterns in words.patterns.items()])
    return F.array_sort(demote(F.array_compact(found), words))


def demote(tags: Column, words: vocab.Vocabulary = vocab.MUSIC) -> Column:
    """Without the plain tag where a compound of it is present."""
    if not words.compounds or words.plain is None:
        return tags
    return F.when(F.arrays_overlap(tags, literals(words.compounds)), F.array_remove(tags, words.plain)).otherwise(tags)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tags by all tags; 0 where either side has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), overlap(a, b) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def conflict(a: Column, b: Column, words: vocab.Vocabulary = vocab.MUSIC) -> Column:
    """Whether disjoint tag sets meet one conflicting group on both sides.

    Members of a family (a plain tag and its compounds) are in one group, so they conflict too.
    """
    groups = [F.arrays_overlap(a, literals(sorted(g))) & F.arrays_overlap(b, literals(sorted(g))) for g in words.conflicts]
    some = F.lit(False)
    for g in groups:
        some = some | g
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b) & some


def mask(tags: Column, words: vocab.Vocabulary = vocab.MUSIC) -> Column:
    """A tag set as the bits of a long, by the vocabulary's order; at most 63 tags.

    For pairs by the million: overlaps and conflicts of masks are a few machine operations.
    """
    if len(words.tags) > 63:
        raise ValueError("a mask holds 63 tags")
    out = F.lit(0).cast("long")
    for i, t in enumerate(words.tags):
        out = out + F.when(F.array_contains(tags, t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return out


def group_masks(words: vocab.Vocabulary) -> list[int]:
    at = {t: i for i, t in enumerate(words.tags)}
    return [sum(1 << at[t] for t in g if t in at) for g in words.conflicts]


def masks_meet(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) != 0


def masks_conflict(a: Column, b: Column, words: vocab.Vocabulary = vocab.MUSIC) -> Column:
    """``conflict`` over masks. Empty masks meet no group, so they need no test of their own."""
    some = F.lit(False)
    for g in group_masks(words):
        some = some | (masks_meet(a, F.lit(g).cast("long")) & masks_meet(b, F.lit(g).cast("long")))
    return ~masks_meet(a, b) & some


def label_tags(label: Column, words: vocab.Vocabulary = vocab.MUSIC) -> Column:
    """Tags of one label: from the label maps, else from the patterns. A label that is mapped to no
    tags has none."""
    if not words.labels:
        return tag(label, words)
    flat = [x for name, tags in words.labels for x in (F.lit(name), literals(tags))]
    return F.coalesce(F.element_at(F.create_map(*flat), F.lower(strip(label))), tag(label, words))


def labels_tags(*lists: Column | str, words: vocab.Vocabulary = vocab.MUSIC) -> Column:
    """The union of the tags of all labels of some lists, sorted."""
    labels = F.filter(F.concat(*[F.coalesce(as_column(x), empty_strings()) for x in lists]), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(labels, lambda x: label_tags(x, words)))))


def attributes(values: Column | str) -> Column:
    """Lower-cased, stripped, distinct values that say something, sorted; null to empty."""
    clean = F.transform(as_column(values).cast("array<string>"), lambda x: F.lower(strip(x)))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & ~x.isin(*vocab.NO_SIGNAL)))), empty_strings())


def lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_label(code: Column | str) -> Column:
    """The label of a language's code or name; unknown ones pass in lower case, blanks are null."""
    key = F.nullif(F.lower(strip(code)), F.lit(""))
    return F.coalesce(lookup(key, vocab.LANGUAGES), key)


def key_number(key: Column | str) -> Column:
    """A musical key as 0 to 11, -1 if unknown."""
    return F.coalesce(lookup(strip(key), vocab.KEYS), F.lit(-1))
