"""Text columns: trimming, list cells, ids in URLs, item and target texts, hashes.

Blanks are Unicode blanks, as in ``str.strip``; ``trim`` would strip spaces alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)^\s+|\s+$"
HASH_VERSION = "v2"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(as_column(c).cast("string"), BLANKS, "")


def text_or_null(c: Column | str) -> Column:
    """Stripped text; null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def normalize(c: Column | str) -> Column:
    """Lower case, runs of blanks to one space, stripped; null to empty."""
    return F.coalesce(strip(F.regexp_replace(F.lower(as_column(c)), r"(?U)\s+", " ")), F.lit(""))


def _stripped(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def distinct_strings(items: Column | str) -> Column:
    """Stripped, non-blank, first occurrences in order; null to empty."""
    return F.coalesce(F.array_distinct(_stripped(as_column(items).cast("array<string>"))), empty_strings())


def list_cell(c: Column | str) -> Column:
    """A text cell as a list: blank, nan, none and [] are empty; a JSON array is read; else commas split."""
    text = strip(c)
    parsed = F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>"))
    nothing = text.isNull() | F.lower(text).isin("", "nan", "none", "[]")
    return F.when(nothing, empty_strings()).otherwise(_stripped(F.coalesce(parsed, F.split(text, ","))))


def merge_terms(*lists: Column | str) -> Column:
    """Lists joined, lower-cased, first occurrences in order."""
    parts = [F.coalesce(as_column(x), empty_strings()) for x in lists]
    return F.array_distinct(F.filter(F.transform(F.concat(*parts), lambda x: F.lower(strip(x))), lambda x: x.isNotNull() & (x != "")))


def id_in_url(url: Column | str, pattern: str) -> Column:
    """The pattern's first group; null where it doesn't occur."""
    return F.nullif(F.regexp_extract(as_column(url), pattern, 1), F.lit(""))


def url_or_id(value: Column | str, pattern: str, strict: bool = False) -> Column:
    """An id as it is, or the one in a URL. Blank or unreadable values are null, or, if ``strict``, an error."""
    text = text_or_null(value)
    found = F.when(text.contains("/"), id_in_url(text, pattern)).otherwise(text)
    if not strict:
        return found
    shown = F.coalesce(text, F.lit(""))
    return F.coalesce(found, F.when(text.isNull(), F.raise_error(F.lit("an id or a URL is empty"))).otherwise(F.raise_error(F.concat(F.lit("no id in "), shown))).cast("string"))


def with_suffixes(base: Column, suffixes: dict[str, Column]) -> Column:
    """``base`` and, for each list that isn't empty, ``Name: a, b.``"""
    parts = [F.when(F.size(terms) > 0, F.concat(F.lit(f"{name}: "), F.array_join(terms, ", "), F.lit("."))) for name, terms in suffixes.items()]
    joined = F.concat_ws(" ", *parts)
    return F.when(joined == "", base).otherwise(F.concat(base, F.lit(". "), joined))


def item_text(name, artist, genres=(), languages=None, moods=None) -> Column:
    """``artist - name`` with what is known of genre, language and mood."""
    a, n = (F.coalesce(strip(x), F.lit("")) for x in (artist, name))
    base = F.when((a != "") & (n != ""), F.concat(a, F.lit(" - "), n)).when(n != "", n).otherwise(a)
    none = empty_strings()
    return with_suffixes(base, {"Genres": merge_terms(*genres) if genres else none, "Language": merge_terms(languages) if languages is not None else none, "Mood": merge_terms(moods) if moods is not None else none})


def target_text(name, description, genres=(), moods=None, activities=None) -> Column:
    """``name. description`` with genre, mood and activity; the description may be missing or ``nan``."""
    n, d = (F.coalesce(strip(x), F.lit("")) for x in (name, description))
    base = F.when((d != "") & (F.lower(d) != "nan"), F.concat(n, F.lit(". "), d)).otherwise(n)
    none = empty_strings()
    return with_suffixes(base, {"Genres": merge_terms(*genres) if genres else none, "Mood": merge_terms(moods) if moods is not None else none, "Activity": merge_terms(activities) if activities is not None else none})


def text_hash(c: Column | str) -> Column:
    """Versioned SHA-1 of a normalised text."""
    return F.sha1(F.concat(F.lit(HASH_VERSION + ":"), normalize(c)))
