"""Format-preserving pseudonyms for personal data.

One pattern finds e-mail addresses, telephone numbers, dates, social security numbers, IPv4 addresses, card numbers and
access tokens. A number or date that passes its test (Luhn digit, octets, calendar, number ranges) is permuted within
its format by a keyed Feistel network: the value is a pair of numbers below a and b, each round adds a keyed digest of
one to the other modulo its size, so the map is one to one on a * b values, with nothing left over. A card keeps its
length, separators and a right Luhn digit, a date its notation and a real day, an address four octets, a social
security number its validity, a telephone number its country code, its punctuation and, of ten digits in North America,
whether area and exchange are ones that are given out. Equal values of a kind get equal pseudonyms in every document,
however they are punctuated. The local part of an e-mail address and an access token, which have no number format, become keyed
digests of the same form. What fails its test stays as it is, as do null and empty texts.

Texts of any length are treated whole, within their row, without a shuffle; only functions of the JVM are used. An
empty table gives no rows; repeated rows get the same result. The key is a secret; there is no key by default.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name

ROUNDS = 10
#: Dates from FIRST_DAY on, DAYS of them (1900-01-01 to 2099-11-12), as pairs below these.
FIRST_DAY, DAY_PAIR = "1900-01-01", (250, 292)

# The kinds' forms.
SECRET = r"""(?i:(?<![\p{L}\p{N}_])(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)["']?\s{0,3}[=:]\s{0,3}["']?)[A-Za-z0-9_\-/+]{16,}+|(?<![A-Za-z0-9])(?:AKIA|ASIA|gh[pousr]_|sk-)[A-Za-z0-9]{16,}+"""
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++"
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
PHONE = r"(?<![\p{L}\p{N}+])\+\d{2,3}[ .\-]\d(?:[ .\-]\d{2}){4}(?!\d)|(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?![\d])|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}([.\-])\d{3}\1\d{4}(?![\d\-])"
DATE = r"(?<![\d.\-/])\d{4}([\-/.])\d{2}\2\d{2}(?![\d\-/])|(?<![\d.\-/])\d{2}([\-/.])\d{2}\3\d{4}(?![\d\-/])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
CARD = r"(?<!\d)(?<!\d[ \-])\d{4}([ \-])\d{4}\4\d{4}\4\d{1,7}(?![ \-]?\d)|(?<!\d)(?<!\d[ \-])(?:\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})(?![ \-]?\d)|(?<!\d)\d{13,19}(?!\d)"
ANY = "|".join((SECRET, EMAIL, PHONE, DATE, SSN, IPV4, CARD))
#: Every form has one of these; texts without them, most of prose, are not searched further.
SIGNS = r"[0-9@=:_]|AKIA|ASIA|sk-"
KINDS = ("secret", "email", "phone", "date", "ssn", "ip", "card")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def digest(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256)


def permuted(x: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """The value below a * b that the Feistel network gives for x."""

    def step(s: Column, i: Column) -> Column:
        noise = F.conv(F.substring(digest(key, kind, i, s["y"], s["m"], s["n"]), 1, 15), 16, 10).cast("long")
        return F.struct(s["y"].alias("x"), ((s["x"] + noise % s["m"]) % s["m"]).alias("y"), s["n"].alias("m"), s["m"].alias("n"))

    # Division of longs as doubles would lose digits, so the quotient is taken by div.
    start = F.struct(F.call_function("div", x, b).alias("x"), (x % b).alias("y"), a.alias("m"), b.alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["x"] * s["n"] + s["y"])


def power(n: Column) -> Column:
    """10 to the power n, up to 18, exactly."""
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of up to 18 digits, as one of the same length."""
    n = F.length(digits)
    low = F.call_function("div", n, F.lit(2)).cast("int")
    return F.lpad(permuted(digits.cast("long"), power(n - low), power(low), key, kind).cast("string"), n, "0")


def filled(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    put = lambda s, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(s["out"], F.substring(digits, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i")))
    return F.aggregate(F.split(form, ""), start, put, lambda s: s["out"])


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum; doubled_last: whether the last digit counts double."""
    d = F.split(F.reverse(digits), "")
    d = F.filter(d, lambda c: c != "")
    worth = F.transform(d, lambda c, i: F.when(i % 2 == (0 if doubled_last else 1), c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x)


def as_card(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        fresh = lambda f: F.concat(f, ((10 - luhn_sum(f, True) % 10) % 10).cast("string"))
        new = let(permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), lambda f: filled(m, fresh(f)))
        return F.when(F.length(d).between(13, 19) & (luhn_sum(d, False) % 10 == 0) & ~d.rlike("^0+$"), new)

    return let(digits_of(m), body)


def as_ip(m: Column, key: str) -> Column:
    def body(octets: Column) -> Column:
        value = ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
        join = lambda v: F.concat_ws(".", *[(F.call_function("div", v, F.lit(256**k).cast("long")) % 256).cast("string") for k in (3, 2, 1, 0)])
        side = F.lit(1 << 16).cast("long")
        return F.when(F.array_max(octets) <= 255, let(permuted(value, side, side, key, "ip"), join))

    return let(F.split(m, r"\.").cast("array<bigint>"), body)


def as_date(m: Column, key: str) -> Column:
    """Years first or last; with the year last the day comes first, unless only the month fits there."""
    a, b = (F.lit(n).cast("long") for n in DAY_PAIR)
    sign = F.regexp_extract(m, r"\d([\-/.])\d", 1)

    def body(p: Column) -> Column:
        first = F.length(p[0]) == 4
        day = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")
        ways = [(F.when(first, day(p[0], p[1], p[2])), "yyyy", "MM", "dd"), (F.when(~first, day(p[2], p[1], p[0])), "dd", "MM", "yyyy"), (F.when(~first, day(p[2], p[0], p[1])), "MM", "dd", "yyyy")]

        def moved(found: Column, form: list[str]) -> Column:
            n = F.datediff(found, F.lit(FIRST_DAY).cast("date")).cast("long")
            new = let(permuted(n, a, b, key, "date"), lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int")))
            text = let(new, lambda v: F.concat(F.date_format(v, form[0]), sign, F.date_format(v, form[1]), sign, F.date_format(v, form[2])))
            return F.when(found.isNotNull() & (n >= 0) & (n < a * b), text)

        return F.coalesce(*[let(found, partial(moved, form=form)) for found, *form in ways])

    return let(F.split(m, r"[\-/.]"), body)


def div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def number(digits: Column, begin: int, length: int) -> Column:
    return F.substring(digits, begin, length).cast("long")


def longs(*values: int) -> list[Column]:
    return [F.lit(v).cast("long") for v in values]


def north_american(d: Column, key: str) -> Column:
    """Ten digits: area, exchange, line. Numbers whose area and exchange begin with 2 to 9 stay such, others do, too."""
    area, exchange, line = number(d, 1, 3), number(d, 4, 3), number(d, 7, 4)
    inside = ((area - 200) * 800 + exchange - 200) * 10_000 + line
    back = lambda v: (div(v, 8_000_000) + 200) * 10_000_000 + (div(v, 10_000) % 800 + 200) * 10_000 + v % 10_000
    low = 200 * 10_000_000
    outside = F.when(area < 200, d.cast("long")).otherwise(low + ((area - 200) * 200 + exchange) * 10_000 + line)
    high = lambda w: (div(w, 2_000_000) + 200) * 10_000_000 + div(w, 10_000) % 200 * 10_000 + w % 10_000
    given = let(permuted(inside, *longs(640_000, 10_000), key, "phone given"), back)
    other = let(permuted(outside, *longs(60_000, 60_000), key, "phone other"), lambda v: F.when(v < low, v).otherwise(high(v - low)))
    return F.lpad(F.when((area >= 200) & (exchange >= 200), given).otherwise(other).cast("string"), 10, "0")


def as_phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, COUNTRY, 0)

    def body(rest: Column) -> Column:
        ten = country.isin("", "+1")
        new = let(digits_of(rest), lambda d: F.when(ten & (F.length(d) == 10), filled(rest, north_american(d, key))).when(F.length(d).between(7, 14), filled(rest, permuted_digits(d, key, "phone"))))
        return F.concat(country, new)

    return let(F.substring(m, F.length(country) + 1, F.length(m)), body)


def as_ssn(m: Column, key: str) -> Column:
    """Valid numbers are 898 areas (001 to 899 without 666), 99 groups and 9999 serials, and stay valid."""
    valid = ~m.rlike(r"^(?:000|666|9)") & ~m.rlike(r"-00-") & ~m.rlike(r"-0000$")

    def body(d: Column) -> Column:
        area = number(d, 1, 3)
        value = ((F.when(area < 666, area - 1).otherwise(area - 2)) * 99 + number(d, 4, 2) - 1) * 9_999 + number(d, 6, 4) - 1
        a = lambda v: div(v, 99 * 9_999)
        text = lambda v: F.concat(F.lpad((a(v) + F.when(a(v) < 665, 1).otherwise(2)).cast("string"), 3, "0"), F.lpad((div(v, 9_999) % 99 + 1).cast("string"), 2, "0"), F.lpad((v % 9_999 + 1).cast("string"), 4, "0"))
        return filled(m, let(permuted(value, *longs(898 * 99, 9_999), key, "ssn"), text))

    return F.when(valid, let(digits_of(m), body))


def as_email(m: Column, key: str) -> Column:
    name = F.substring(digest(key, "email", F.lower(m)), 1, 12)
    return F.concat(F.lit("u"), name, F.lit("@"), F.substring_index(m, "@", -1))


def as_secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"""(?:AKIA|ASIA|gh[pousr]_|sk-|[=:]\s{0,3}["']?)([A-Za-z0-9_\-/+]{16,})$""", 1)

    def body(v: Column) -> Column:
        long = F.repeat(digest(key, "secret", F.lower(v)), F.call_function("div", F.length(v), F.lit(64)).cast("int") + 1)
        new = F.substring(long, F.lit(1), F.length(v))
        return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(v)), F.when(v == F.upper(v), F.upper(new)).otherwise(new))

    return let(value, body)


def named(kind: str, text: Column) -> Column:
    return F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("text")))


def replaced(m: Column, key: str) -> Column:
    """kind and pseudonym of a match; nulls if it fails its test."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    kinds = {"secret": (SECRET, as_secret), "email": (EMAIL, as_email), "phone": (PHONE, as_phone), "date": (DATE.replace(r"\2", r"\1").replace(r"\3", r"\2"), as_date), "ssn": (SSN, as_ssn), "ip": (IPV4, as_ip), "card": (CARD.replace(r"\4", r"\1"), as_card)}
    out = F.lit(None).cast("struct<kind:string,text:string>")
    for kind, (pattern, change) in reversed(kinds.items()):
        out = F.when(whole(pattern), let(change(m, key), partial(named, kind))).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, text: str = "text", key: str | None = None, counts: str | None = "n_private") -> DataFrame:
    """docs with the text's personal data replaced, and a column of the number of replaced values, if it is named.

    The key comes from TESSERA_KEY where none is given; without one the operator refuses. Columns of other names stay;
    one of the name of counts is replaced.
    """
    key = key or os.environ.get("TESSERA_KEY")
    if not key:
        raise ValueError("pseudonyms need a secret key: give one, or set TESSERA_KEY")
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    made = F.transform(found, lambda m: F.coalesce(replaced(m, key), F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))))
    parts = F.when(t.rlike(SIGNS) & t.rlike(ANY), F.struct(F.split(t, ANY, -1).alias("gaps"), made.alias("made")))

    def whole(p: Column) -> Column:
        joined = F.array_join(F.zip_with(p["gaps"], p["made"], lambda g, m: F.concat(g, F.coalesce(m["text"], F.lit("")))), "")
        return F.struct(joined.alias("text"), F.size(F.filter(p["made"], lambda m: m["kind"].isNotNull())).cast("long").alias("n"))

    name = free_name(docs, "made")
    out = docs.withColumn(name, let(parts, lambda p: F.when(p.isNotNull(), whole(p))))
    out = out.withColumn(text, F.coalesce(F.col(name)["text"], t))
    if counts:
        out = out.drop(*[c for c in docs.columns if c.lower() == counts.lower()])
        out = out.withColumn(counts, F.coalesce(F.col(name)["n"], F.lit(0)).cast("long"))
    return out.drop(name)
