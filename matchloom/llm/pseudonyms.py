"""Format-preserving pseudonyms from keyed Feistel networks. DataFrame operations only.

Numbers, dates and addresses are found by pattern, validated, and replaced by a keyed permutation
of their own format: the same length, separators, letter case, ranges and check digits. Equal values have equal
pseudonyms in every document; different values of one format have different ones.

The permutation is an unbalanced Feistel network over mixed-radix digits: ROUNDS times, each digit of
one half is shifted, modulo its own radix, by a keyed hash of the other half, the format, the round and
its place. Any list of radices is permuted within itself, so no cycle walking is needed.

kind     validated by                                   permuted
card     13-19 digits in one run or fours, Luhn         all digits but the last, which is computed
iban     country, length, remainder modulo 97           digits and letters of the account; check digits computed
ssn      area, group and serial in use                  the three numbers in their ranges
date     a day of 1900-2099 (ISO, or day and month      the day, within its century
         with a four-digit year; . / - )
phone    + and 8-15 digits in groups of any size with   all digits after the country code
         one blank, - or / (or only dots) between them,
         or (ddd) ddd-dddd; ends with the last group
         that fits into 15 digits
ip       four numbers up to 255                         the four numbers
email    local part, @, domain with a dot               letters and digits of the local part
secret   32 hexadecimal digits or more                  the hexadecimal digits

What doesn't validate stays as it is. Defined results: null and empty texts stay as they are; a text
without a digit or @ isn't searched further; very long texts, and very long numbers, addresses and
domains in them, are handled whole, in time linear in their length.

The key is the caller's and is never part of this library: who knows it can turn pseudonyms back.
``key_of`` takes it from the session's settings; a session without one gets a random key, so that its
pseudonyms link to each other but to those of no other session.
"""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: Where the key is looked for: a setting of the session, then a variable of the environment.
KEY_SETTING, KEY_VARIABLE = "spark.matchloom.pseudonym.key", "MATCHLOOM_PSEUDONYM_KEY"
_SESSION_KEYS: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The configured key, or one random key for each application."""
    configured = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    return configured or _SESSION_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


#: The patterns of the kinds, in order of precedence.
EDGE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: The length of an account number by country; a spaced one ends there, so that a short
#: word or a number after it isn't taken for its last group.
ACCOUNTS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _spaced(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: [A-Z0-9]{{4}}){{{fours}}}" + (rf" [A-Z0-9]{{{rest}}}" if rest else "")


PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)++",
    "secret": EDGE + r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})" + END,
    "iban": EDGE + r"(?:(?=[A-Z]{2}\d{2} )(?:" + "|".join(_spaced(n, c) for n, c in ACCOUNTS.items()) + ")" + END + r"|[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?))" + END,
    "phone": r"(?<![\p{L}\p{N}+])(?:(?:\+?\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|\+\d{1,3} ?\(0\) ?\d(?:[ /.-]?\d){4,11}|\+\d(?:[ /-]?\d){7,14}|\+\d(?:\.?\d){7,14})(?![\p{L}\p{N}]|[.-]\d)",
    "date": EDGE + r"(?:(?:19|20)\d{2}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2(?:19|20)\d{2})(?![\p{L}\p{N}]|[-/.]\d)",
    "ssn": EDGE + r"(?<![-.])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "ip": EDGE + r"(?<![-.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)",
    "card": EDGE + r"(?:\d{4}([ -])\d{4}\3\d{4}\3\d{1,7}|\d{13,19})" + END,
}
ANY = "|".join(PATTERNS.values())
#: The country codes of the telephone network, of one, two or three digits.
COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: The letters that are permuted among each other.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
HEX = ["0123456789abcdef", "0123456789ABCDEF"]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def feistel(digits: Column, radices: Column, key: Column, inverse: bool = False) -> Column:
    """The digits (array of long), each below its radix, permuted; or back again."""
    sign = -1 if inverse else 1
    order = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])

    def shifted(half, radix, other, form, i):
        seed = F.sha2(F.concat_ws("|", key, form, i.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 256)
        # The hash of the other half is made once, not for each digit.
        moved = let(seed, lambda s: F.zip_with(half, F.transform(radix, lambda r, p: F.pmod(F.xxhash64(s, p), r)), lambda x, m: x + sign * m))
        return F.zip_with(moved, radix, lambda x, r: F.pmod(x, r))

    def network(v):
        def one(s, i):
            even = i % 2 == 0
            a = F.when(even, shifted(s["a"], v["ra"], s["b"], v["form"], i)).otherwise(s["a"])
            b = F.when(even, s["b"]).otherwise(shifted(s["b"], v["rb"], s["a"], v["form"], i))
            return F.struct(a.alias("a"), b.alias("b"))

        return F.aggregate(order, F.struct(v["a"].alias("a"), v["b"].alias("b")), one, lambda s: F.concat(s["a"], s["b"]))

    def halves(v):
        h = F.floor(F.size(v["d"]) / 2).cast("int")
        rest = F.size(v["d"]) - h
        form = F.array_join(F.transform(v["r"], lambda r: r.cast("string")), ",")
        return network_of(F.struct(F.slice(v["d"], F.lit(1), h).alias("a"), F.slice(v["d"], h + 1, rest).alias("b"), F.slice(v["r"], F.lit(1), h).alias("ra"), F.slice(v["r"], h + 1, rest).alias("rb"), form.alias("form")))

    def network_of(v):
        return let(v, network)

    return let(F.struct(digits.alias("d"), radices.alias("r")), halves)


def chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _place(c: Column, alphabets: list[str]) -> Column:
    """Where a character stands in its alphabet, and that alphabet's size and letters."""
    out = F.struct(long(0).alias("d"), long(1).alias("r"), F.lit("").alias("of"))
    for a in alphabets:
        at = F.instr(F.lit(a), c)
        out = F.when(at > 0, F.struct((at - 1).cast("long").alias("d"), long(len(a)).alias("r"), F.lit(a).alias("of"))).otherwise(out)
    return out


def spread(value: Column, alphabets: list[str], key: Column) -> Column:
    """A string with the characters of each alphabet permuted, all others in place.

    The two cases of a letter have one number, so that texts in capitals stay linked to others.
    """

    def body(v):
        found = F.transform(v["c"], lambda c: _place(c, alphabets))
        return let(F.struct(v["c"].alias("c"), found.alias("p")), finish)

    def finish(v):
        new = feistel(F.transform(v["p"], lambda p: p["d"]), F.transform(v["p"], lambda p: p["r"]), key)
        return F.array_join(F.zip_with(F.zip_with(v["c"], v["p"], lambda c, p: F.struct(c.alias("c"), p["of"].alias("of"))), new, lambda x, d: F.when(x["of"] == "", x["c"]).otherwise(F.substring(x["of"], (d + 1).cast("int"), F.lit(1)))), "")

    return let(F.struct(chars(value).alias("c")), body)


def refill(value: Column, pattern: str, new: Column) -> Column:
    """``value`` with its characters of a class replaced, in order, by the strings of ``new``."""
    return F.array_join(F.flatten(F.zip_with(F.split(value, pattern, -1), new, lambda gap, c: F.array(gap, F.coalesce(c, F.lit(""))))), "")


def digits_of(value: Column) -> Column:
    return F.transform(chars(F.regexp_replace(value, r"\D", "")), lambda c: c.cast("long"))


def tens(digits: Column) -> Column:
    return F.transform(digits, lambda _: long(10))


def luhn_digit(payload: Column) -> Column:
    """The check digit that follows the payload digits."""
    twice = F.transform(F.reverse(payload), lambda x, i: F.when(i % 2 == 0, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.pmod(-F.aggregate(twice, long(0), lambda a, x: a + x), long(10))


def text_of(digits: Column) -> Column:
    return F.transform(digits, lambda x: x.cast("string"))


def card(m: Column, key: Column) -> Column:
    def body(v):
        payload = F.slice(v["d"], F.lit(1), F.size(v["d"]) - 1)
        new = feistel(payload, tens(payload), key)
        full = let(new, lambda n: F.concat(n, F.array(luhn_digit(n))))
        return F.when(luhn_digit(payload) == F.element_at(v["d"], -1), refill(m, r"\d", text_of(full))).otherwise(m)

    return let(F.struct(digits_of(m).alias("d")), body)


def phone(m: Column, key: Column) -> Column:
    country = F.regexp_extract(m, r"^(?:\+\d{1,3} ?\(0\) ?|\+?\d{1,3}[ .-]?(?=\()|" + COUNTRY + ")?", 0)

    def body(v):
        digits = digits_of(v["rest"])
        good = F.length(F.regexp_replace(m, r"\D", "")).between(8, 15)
        return F.when(good, F.concat(v["country"], refill(v["rest"], r"\d", text_of(feistel(digits, tens(digits), key))))).otherwise(m)

    return let(F.struct(country.alias("country"), F.substring(m, F.length(country) + 1, F.length(m)).alias("rest")), body)


def ip(m: Column, key: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    good = ~m.rlike(r"(^|\.)0\d") & ~F.exists(parts, lambda x: x > 255)
    new = feistel(parts, F.transform(parts, lambda _: long(256)), key)
    return F.when(good, F.array_join(text_of(new), ".")).otherwise(m)


def ssn(m: Column, key: Column) -> Column:
    def body(v):
        area, group, serial = (v["p"][i] for i in range(3))
        good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        new = feistel(F.array(area - 1 - F.when(area > 666, 1).otherwise(0), group - 1, serial - 1), F.array(long(898), long(99), long(9999)), key)
        return F.when(good, let(new, lambda n: F.concat_ws("-", F.lpad((n[0] + 1 + F.when(n[0] >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((n[1] + 1).cast("string"), 2, "0"), F.lpad((n[2] + 1).cast("string"), 4, "0")))).otherwise(m)

    return let(F.struct(F.transform(F.split(m, "-"), lambda x: x.cast("long")).alias("p")), body)


def date(m: Column, key: Column) -> Column:
    plain = F.regexp_replace(m, "[/.]", "-")
    day = lambda form: F.try_to_timestamp(plain, F.lit(form)).cast("date")
    forms = ["yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy"]

    def body(v):
        # 1900-1999 has 92 * 397 days, 2000-2099 has 75 * 487.
        def century(first, x, y):
            since = F.datediff(v["day"], F.lit(first).cast("date")).cast("long")
            new = feistel(F.array(F.floor(since / y).cast("long"), F.pmod(since, long(y))), F.array(long(x), long(y)), key)
            return let(new, lambda n: F.date_add(F.lit(first).cast("date"), (n[0] * y + n[1]).cast("int")))

        new = F.when(F.year(v["day"]) < 2000, century("1900-01-01", 92, 397)).otherwise(century("2000-01-01", 75, 487))
        shown = let(new, lambda d: F.when(v["form"] == 0, F.date_format(d, forms[0])).when(v["form"] == 1, F.date_format(d, forms[1])).otherwise(F.date_format(d, forms[2])))
        return F.when(v["day"].isNull(), m).otherwise(F.regexp_replace(shown, "-", F.regexp_extract(m, "[-/.]", 0)))

    first = F.when(m.rlike(r"^\d{4}"), F.struct(F.lit(0).alias("form"), day(forms[0]).alias("day"))).when(day(forms[1]).isNotNull(), F.struct(F.lit(1).alias("form"), day(forms[1]).alias("day")))
    return let(first.otherwise(F.struct(F.lit(2).alias("form"), day(forms[2]).alias("day"))), body)


def email(m: Column, key: Column) -> Column:
    return F.concat(spread(F.substring_index(m, "@", 1), ALPHABETS, key), F.lit("@"), F.substring_index(m, "@", -1))


def secret(m: Column, key: Column) -> Column:
    return F.when(m.rlike("[a-f]"), spread(m, HEX[:1], key)).when(m.rlike("[A-F]"), spread(m, HEX[1:], key)).otherwise(spread(m, ALPHABETS[:1], key))


def remainder97(value: Column) -> Column:
    at = lambda c: (F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1).cast("long")
    return F.aggregate(chars(value), long(0), lambda a, c: F.pmod(a * F.when(at(c) < 10, 10).otherwise(100) + at(c), long(97)))


def iban(m: Column, key: Column) -> Column:
    def body(v):
        country, account = F.substring(v["s"], 1, 2), F.substring(v["s"], F.lit(5), F.length(v["s"]))
        good = F.length(v["s"]).between(15, 34) & (remainder97(F.concat(account, F.substring(v["s"], 1, 4))) == 1)
        new = spread(account, [ALPHABETS[0], ALPHABETS[2]], key)
        full = let(new, lambda a: F.concat(country, F.lpad((98 - remainder97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        return F.when(good, refill(m, "[^ ]", chars(full))).otherwise(m)

    return let(F.struct(F.regexp_replace(m, " ", "").alias("s")), body)


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one match of ANY, or the match itself where it doesn't validate."""
    return (
        F.when(m.contains("@"), email(m, key))
        .when(m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), secret(m, key))
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), iban(m, key))
        .when(m.startswith("+") | m.contains("("), phone(m, key))
        .when(m.rlike(r"^(?:\d{4}[-/.]\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4})$"), date(m, key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), ssn(m, key))
        .when(m.contains("."), ip(m, key))
        .otherwise(card(m, key))
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``df`` with the column ``text`` rewritten; ``found`` names a column for the number of values
    replaced. Map-side only: no shuffle, no Python."""
    if not key:
        raise ValueError("a key is needed")
    column, secret_key = F.col(f"`{text}`"), F.lit(key)
    matches = F.regexp_extract_all(column, F.lit(ANY), F.lit(0))
    pairs = F.transform(matches, lambda m: F.struct(m.alias("old"), pseudonym(m, secret_key).alias("new")))
    worth = column.rlike("[0-9@]")

    def rebuilt(v):
        gaps = F.split(column, ANY, -1)
        return F.array_join(F.flatten(F.zip_with(gaps, v, lambda g, p: F.array(g, F.coalesce(p["new"], F.lit(""))))), "")

    # The pseudonyms of a text are computed once, for both the new text and the count.
    done = F.transform(F.array(pairs), lambda v: F.struct(F.when(F.size(v) == 0, column).otherwise(rebuilt(v)).alias("text"), F.size(F.filter(v, lambda p: p["old"] != p["new"])).alias("n")))
    name = "__done" + "_" * max(map(len, df.columns))  # longer than any column's name
    out = df.withColumn(name, F.when(worth, F.element_at(done, 1)))
    out = out.withColumn(text, F.coalesce(F.col(f"{name}.text"), column))
    if found:
        out = out.withColumn(found, F.coalesce(F.col(f"{name}.n"), F.lit(0)))
    return out.drop(name)
