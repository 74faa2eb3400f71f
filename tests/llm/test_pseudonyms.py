"""Pseudonyms against a plain version that works one value at a time, and hostile texts."""

from __future__ import annotations

import datetime
import hashlib
import struct

import pytest
import regex
import xxhash

from matchloom.llm import pseudonyms, queries

KEY = "a key of the tests"
FOUND = regex.compile(pseudonyms.ANY.replace(r"\d", "[0-9]").replace(r"\D", "[^0-9]"))


def shift(seed: str, place: int) -> int:
    first = xxhash.xxh64_intdigest(seed.encode(), 42)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<i", place), first)))[0]


def permuted(digits, radices):
    half = len(digits) // 2
    sides = [list(digits[:half]), list(digits[half:])]
    bases = [radices[:half], radices[half:]]
    for i in range(10):
        mine, other = i % 2, 1 - i % 2
        seed = hashlib.sha256("|".join([KEY, ",".join(map(str, radices)), str(i), ",".join(map(str, sides[other]))]).encode()).hexdigest()
        sides[mine] = [(d + shift(seed, p)) % r for p, (d, r) in enumerate(zip(sides[mine], bases[mine], strict=True))]
    return sides[0] + sides[1]


def put(value, allowed, new):
    fresh = iter(new)
    return "".join(str(next(fresh)) if allowed(c) else c for c in value)


def spread(value, alphabets):
    places = [next(((a.index(c), len(a), a) for a in alphabets if c in a), (0, 1, c)) for c in value]
    new = permuted([p for p, _, _ in places], [n for _, n, _ in places])
    return "".join(a[d] for d, (_, _, a) in zip(new, places, strict=True))


def check_digit(payload):
    total = 0
    for i, d in enumerate(reversed(payload)):
        total += sum(divmod(2 * d, 10)) if i % 2 == 0 else d
    return -total % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def on_date(m):
    plain = regex.sub("[/.]", "-", m)
    for form in ("%Y-%m-%d", "%d-%m-%Y", "%m-%d-%Y"):
        if (form[1] == "Y") == bool(regex.match("[0-9]{4}", m)):
            try:
                day = datetime.datetime.strptime(plain, form).date()
            except ValueError:
                continue
            first, x, y = (datetime.date(1900, 1, 1), 92, 397) if day.year < 2000 else (datetime.date(2000, 1, 1), 75, 487)
            a, b = permuted(list(divmod((day - first).days, y)), [x, y])
            return (first + datetime.timedelta(a * y + b)).strftime(form).replace("-", regex.search("[-/.]", m)[0])
    return m


def pseudonym(m):
    digits = [int(c) for c in m if c in "0123456789"]
    is_digit = lambda c: c in "0123456789"
    lower, upper, number = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    if "@" in m:
        local, _, domain = m.partition("@")
        return spread(local, pseudonyms.ALPHABETS) + "@" + domain
    if regex.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", m):
        return spread(m, [number + "abcdef"] if regex.search("[a-f]", m) else [number + "ABCDEF"] if regex.search("[A-F]", m) else [number])
    if regex.match("[A-Z]{2}[0-9]{2}", m):
        s = m.replace(" ", "")
        if not 15 <= len(s) <= 34 or mod97(s[4:] + s[:4]) != 1:
            return m
        account = spread(s[4:], [number, upper])
        return put(m, lambda c: c != " ", s[:2] + f"{98 - mod97(account + s[:2] + '00'):02d}" + account)
    if m.startswith("+") or "(" in m:
        if not 8 <= len(digits) <= 15:
            return m
        country = regex.match(r"\+[0-9]{1,3} ?\(0\) ?|\+?[0-9]{1,3}[ .-]?(?=\()|" + pseudonyms.COUNTRY.replace(r"\d", "[0-9]"), m)
        country = country[0] if country else ""
        rest = [int(c) for c in m[len(country) :] if is_digit(c)]
        return country + put(m[len(country) :], is_digit, permuted(rest, [10] * len(rest)))
    if regex.fullmatch(r"[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}", m):
        return on_date(m)
    if regex.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        area, group, serial = map(int, m.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return m
        a, g, s = permuted([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999])
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"
    if "." in m:
        parts = m.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return m
        return ".".join(map(str, permuted([int(p) for p in parts], [256] * 4)))
    if check_digit(digits[:-1]) != digits[-1]:
        return m
    new = permuted(digits[:-1], [10] * (len(digits) - 1))
    return put(m, is_digit, [*new, check_digit(new)])


def rewritten(text):
    return text if text is None else FOUND.sub(lambda m: pseudonym(m[0]), text)


CASES = [
    "card 4111 1111 1111 1111, 4111111111111111 not 4111111111111112; 4012-8888-8888-1881 378282246310005",
    "call +1 (172) 555-7713 or +44 20 7946 0958 190.137.223.204. (212) 555-0187",
    "mail étion.34@mail7.example.com or ÉTION.34@mail7.example.com. x@y.z-, a@b, @c.d",
    "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, not DE00370400440532013000",
    "born 1984-02-29, 29/02/1984, 12.31.2011; not 2021-02-30",
    "ssn 078-05-1120 not 666-12-1234, 899-99-9999 000-01-0001",
    'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" 9C8B45435718DCC700C184A7E303CDC6 ' + "12345678" * 5,
    "v1.2.3 License 4.0. 999.1.1.1 10.0.0.255 01.2.3.4 costs 12345 in 2024",
    "+33 (0)6 12 34 56 78, +49 170 1234567 12345, +336 12345678, +39.06.1234567",
    "AT61 1904 3002 3457 3201 TO PAY", "", None, "plain words",
]


def test_against_a_plain_version(spark, small):
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES + docs)], "i int, text string")
    got = [r.text for r in pseudonyms.pseudonymise(df, KEY).orderBy("i").collect()]
    assert got == [rewritten(t) for t in CASES + docs]
    assert sum(a != b for a, b in zip(got, CASES + docs, strict=True)) > 10


def test_long_values_are_linear(spark):
    labels, digits = "x@" + "a." * 20_000 + "com", "1" * 300_000
    texts = [labels, digits, "a" * 100_000 + "@b.com", "x@a" + "-" * 200_000, "1." * 100_000, "+" + "1 " * 100_000, "x@" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.text for r in pseudonyms.pseudonymise(df, KEY).orderBy("i").collect()]
    assert [len(t) for t in got] == [len(t) for t in texts]
    assert got[0][1:] == labels[1:] and got[1] == spread(digits, ["0123456789"]) and got[2].endswith("@b.com")
    assert got[3:5] == texts[3:5] and got[6] == texts[6]


def test_the_key_is_the_callers(spark, small, monkeypatch):
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(spark.createDataFrame([("x",)], "text string"), "")
    mine = pseudonyms.key_of(spark)
    assert mine == pseudonyms.key_of(spark) and len(mine) >= 64
    monkeypatch.setenv(pseudonyms.KEY_VARIABLE, KEY)
    got = {r.doc_id: r.text for r in queries.op1_feistel_pii(spark, small).collect()}
    assert got == {r.doc_id: rewritten(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
