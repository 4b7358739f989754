"""Text functions: tokens, phrases, wildcards, folding and a light stemmer, all as Spark columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import QueryError

#: Whatever is neither letter nor digit separates tokens.
SEPARATOR = r"[^\p{L}\p{N}]+"
WORD_CHARACTER = r"[\p{L}\p{N}]"
# Typographic quotes, blanks and invisible characters, and their plain forms.
FANCY = "".join(map(chr, (0x201C, 0x201D, 0x201E, 0xAB, 0xBB, 0x2018, 0x2019, 0x201A, 0xB4, 0xA0, 0x2009, 0x202F)))
PLAIN = '"' * 5 + "'" * 4 + " " * 3
INVISIBLE = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
#: Latin letters with marks, and the letters without; from the characters' decompositions.
MARKED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1)
UNMARKED = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)
#: Endings that the light stemmer takes off in English, longest first; at least three letters stay.
ENDINGS = ("ations", "ation", "ingly", "edly", "ness", "ing", "ies", "ied", "ed", "ly", "es", "s")


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; null for null."""
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    """The same on the driver, for a query's words."""
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def joined(text: Column) -> Column:
    """Tokens in order between blanks, with a blank at both ends: a phrase is a substring of it."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def has_all(token_array: Column, wanted: list[str]) -> Column:
    """Whether all wanted tokens occur; false for null."""
    out = F.lit(True)
    for t in dict.fromkeys(wanted):
        out = out & F.coalesce(F.array_contains(token_array, t), F.lit(False))
    return out


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the phrase's tokens are adjacent and in order."""
    return F.coalesce(F.contains(joined(text), F.lit(f" {' '.join(query_tokens(phrase))} ")), F.lit(False))


def has_phrase_prefix(text: Column, phrase: str) -> Column:
    """As a phrase whose last token need only begin so."""
    return F.coalesce(F.contains(joined(text), F.lit(f" {' '.join(query_tokens(phrase))}")), F.lit(False))


def wildcard_pattern(word: str, least: int = 3) -> str:
    """A regular expression for a token with * and ?; at least so many letters come first."""
    head = re.split(r"[*?]", word.lower())[0]
    if len(head) < least:
        raise QueryError(f"{word!r} needs {least} letters before its first wildcard")
    return "".join({"*": r"[\p{L}\p{N}]*", "?": r"[\p{L}\p{N}]"}.get(c, re.escape(c)) for c in word.lower())


def has_wildcard(text: Column, word: str, least: int = 3) -> Column:
    """Whether some token fits the word with wildcards."""
    return F.coalesce(F.rlike(joined(text), F.lit(f" {wildcard_pattern(word, least)} ")), F.lit(False))


def has_wildcard_phrase(text: Column, phrase: str, least: int = 3) -> Column:
    """Adjacent tokens in order, of which some have wildcards."""
    parts = [wildcard_pattern(w, least) if re.search(r"[*?]", w) else re.escape(w) for w in phrase.lower().split()]
    return F.coalesce(F.rlike(joined(text), F.lit(f" {' '.join(parts)} ")), F.lit(False))


def has_similar(text: Column, word: str, distance: int) -> Column:
    """Whether some token is within this edit distance of word."""
    return F.coalesce(F.exists(F.array_distinct(tokens(text)), lambda t: F.levenshtein(t, F.lit(word.lower())) <= distance), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def fits(token: Column, word: str) -> Column:
    """Whether a token is the word, which may have wildcards."""
    return F.rlike(token, F.lit(f"^(?:{wildcard_pattern(word)})$")) if re.search(r"[*?]", word) else token == word


def starts(token_array: Column, phrase: list[str]) -> Column:
    """The places where these words stand one after another."""

    def place(token: Column, i: Column) -> Column:
        found = fits(token, phrase[0])
        for k, w in enumerate(phrase[1:], 1):
            found = found & F.coalesce(fits(F.get(token_array, i + k), w), F.lit(False))
        return F.when(found, i)

    return F.filter(F.transform(token_array, place), lambda i: i.isNotNull())


def has_near(text: Column, operands: list[str], gaps: int, ordered: bool = False) -> Column:
    """Whether all operands (words or phrases) stand with at most so many other words between them, none within another.

    Only the places of these words are compared, and of each further operand only those near the first.
    """
    if len(operands) < 2:
        raise QueryError("proximity needs two operands")
    phrases = [wildcard_tokens(o) for o in operands]
    if not all(phrases):
        raise QueryError("an operand has no words")
    sizes = [len(p) for p in phrases]
    span = sum(sizes) + gaps

    def rest(places: Column, chosen: list[Column]) -> Column:
        k = len(chosen)
        if k == len(phrases):
            first, end = F.least(*chosen), F.greatest(*[c + n for c, n in zip(chosen, sizes, strict=True)])
            return end - first <= span
        here = F.filter(places[f"p{k}"], lambda i: F.abs(i - chosen[0]) <= span) if k else places["p0"]

        def fitting(i: Column) -> Column:
            found = F.lit(True)
            for c, n in zip(chosen, sizes, strict=False):
                after = c + n <= i
                found = found & (after if ordered else after | (i + sizes[k] <= c))
            return found & rest(places, [*chosen, i])

        return F.exists(here, fitting)

    with_tokens = lambda t: let(F.struct(*[starts(t, p).alias(f"p{k}") for k, p in enumerate(phrases)]), lambda places: rest(places, []))
    return F.coalesce(let(tokens(text), with_tokens), F.lit(False))


def has_within(text: Column, phrase: str, slop: int) -> Column:
    """Whether the phrase's words stand so that moving them by ``slop`` places in all makes the phrase: a sloppy phrase."""
    parts = wildcard_tokens(phrase)
    if not parts:
        raise QueryError("the phrase has no words")
    if len(parts) == 1:
        return has_wildcard(text, parts[0]) if re.search(r"[*?]", parts[0]) else has_all(tokens(text), parts)

    def found(moved: Column) -> Column:
        all_of = lambda s: [F.exists(moved[f"p{k}"], lambda i: (i >= s) & (i <= s + slop)) for k in range(len(parts))]

        def from_here(s: Column) -> Column:
            out = F.lit(True)
            for x in all_of(s):
                out = out & x
            return out

        return F.exists(F.flatten(F.array(*[moved[f"p{k}"] for k in range(len(parts))])), from_here)

    moved = lambda t: F.struct(*[F.transform(starts(t, [w]), moved_by(k)).alias(f"p{k}") for k, w in enumerate(parts)])
    return F.coalesce(let(tokens(text), lambda t: let(moved(t), found)), F.lit(False))


def moved_by(k: int) -> Callable[[Column], Column]:
    return lambda i: i - k


def wildcard_tokens(text: str) -> list[str]:
    """A query's words, wildcards kept."""
    return [w for w in re.split(r"[^\w*?]+|_", text.lower()) if w.strip("*?")]


def plain(text: Column) -> Column:
    """Typographic quotes and blanks made plain, invisible characters removed."""
    return F.translate(F.translate(text, FANCY, PLAIN), INVISIBLE, "")


def folded(text: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(text, MARKED, UNMARKED)


def cleaned(text: Column) -> Column:
    """A search text without reserved signs and without a dangling and, or, not."""
    return F.trim(F.regexp_replace(F.translate(plain(text), "/:[]<>", "      "), r"(?i)\s+(?:and|or|not)\s*$", ""))


def without_punctuation(text: Column) -> Column:
    return F.translate(text, ".,!?", "")


def stemmed(token: Column) -> Column:
    """A token without its ending: a light rule stemmer, one pass, for English."""
    return F.regexp_replace(token, rf"(?<=\p{{L}}{{3}})(?:{'|'.join(ENDINGS)})$", "")


def stems(text: Column) -> Column:
    return F.transform(tokens(text), stemmed)


def highlighted(text: Column, wanted: list[str], before: str = ">>", after: str = "<<") -> Column:
    """text with each of the wanted words between marks."""
    if not wanted:
        return text
    either = "|".join(re.escape(w) for w in wanted)
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}")


def fragments(text: Column, wanted: list[str], size: int = 300, most: int = 5) -> Column:
    """Up to ``most`` pieces of text of at most ``size`` characters around the wanted words, marked."""
    either = "|".join(re.escape(w) for w in wanted)
    half = size // 2
    found = F.regexp_extract_all(text, F.lit(rf"(?is).{{0,{half}}}(?<![\p{{L}}\p{{N}}])(?:{either})(?![\p{{L}}\p{{N}}]).{{0,{half}}}"), F.lit(0))
    return F.transform(F.slice(found, 1, most), lambda x: highlighted(F.trim(x), wanted))


def years_in(text: str) -> tuple[int, int] | None:
    """The range of years that a search text ends in, as in ``rivers 1999-2004``; None where there is none."""
    found = re.search(r"(?:^|\s)(1[0-9]{3}|20[0-9]{2})\s*[-\u2013]\s*(1[0-9]{3}|20[0-9]{2})\s*$", text)
    return (int(found[1]), int(found[2])) if found and int(found[1]) <= int(found[2]) else None


def spoken(name: str, prefix: str = "") -> str:
    """A column's name for people: ``o_order_date`` with the prefix ``o_`` is Order date."""
    plain_name = name.removeprefix(prefix).replace(".", " ").replace("_", " ").strip()
    return plain_name[:1].upper() + plain_name[1:]
