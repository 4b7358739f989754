"""Text search: words, phrases, patterns, similar words and proximity as conditions of a row, and a stated ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.functions import text as words

# By the number of fields searched, what a field counts that has all words, and that has them as a phrase.
WEIGHTS = {
    1: {"primary": (1.0, 2.0)},
    2: {"primary": (1.0, 2.0), "secondary": (0.10, 0.15)},
    3: {"primary": (1.5, 3.0), "secondary": (0.3, 0.5), "tertiary": (0.05, 0.1)},
}
#: A quoted phrase, perhaps sloppy or near other phrases; or what stands between blanks.
TERM = re.compile(r'"([^"]*)"((?:~\d+~"[^"]*")+|~\d+)?|(\S+)')


@dataclass(frozen=True)
class Word:
    """Terms that all have to occur, in one column.

    ``"a b"`` is a phrase, ``"a b"~3`` one whose words may be moved by three places in all, ``"a"~3~"b c"`` phrases with
    at most three words between them; ``wor*`` and ``w?rd`` are patterns, also within phrases; ``word~1`` is a word that
    differs by one letter.
    """

    text: str

    def column(self, c: Column) -> Column:
        plain, found = [], F.lit(True)
        for m in TERM.finditer(self.text):
            if m[3] is None:
                found = found & quoted(c, m[1], m[2] or "")
            elif "~" in m[3]:
                word, _, n = m[3].partition("~")
                if not word or (n and not n.isdigit()):
                    raise QueryError(f"{m[3]!r} is not a word, ~ and a number")
                found = found & words.has_similar(c, word, int(n or 2))
            elif set(m[3]) & set("*?"):
                found = found & words.has_wildcard(c, m[3])
            else:
                plain += words.query_tokens(m[3])
        return found & words.has_all(words.tokens(c), plain) if plain else found

    def over(self, columns: list[Column]) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | self.column(c)
        return out


def quoted(c: Column, phrase: str, rest: str) -> Column:
    """A phrase with what follows its closing quote."""
    if '"' in rest:
        gaps = {int(n) for n in re.findall(r"~(\d+)~", rest)}
        if len(gaps) > 1:
            raise QueryError("one number of words for all phrases")
        return words.has_near(c, [phrase, *re.findall(r'"([^"]*)"', rest)], gaps.pop())
    if rest:
        return words.has_within(c, phrase, int(rest[1:]))
    if set(phrase) & set("*?"):
        return words.has_wildcard_phrase(c, phrase) if " " in phrase else words.has_wildcard(c, phrase)
    return words.has_phrase(c, phrase)


@dataclass(frozen=True)
class Either:
    """A tree of words: and, or, not."""

    join: str
    parts: tuple

    def over(self, columns: list[Column]) -> Column:
        found = [p.over(columns) for p in self.parts]
        if self.join == "not":
            return ~found[0]
        out = found[0]
        for x in found[1:]:
            out = out & x if self.join == "and" else out | x
        return out


def joined(text: str) -> Word | Either:
    """A search text: terms, perhaps joined by AND, OR and NOT in capitals; AND binds closer than OR. Brackets need a tree."""
    if text.lstrip().startswith("!"):
        raise QueryError("a search is not negated by !; use NOT")
    terms = [m[0] for m in TERM.finditer(text)]
    if not {"AND", "OR", "NOT"} & {*terms}:
        return Word(text)
    if any(t[0] == "(" or t[-1] == ")" for t in terms):
        raise QueryError("brackets in a search need a tree of words")
    either = [Either("and", tuple(both(part))) for part in split(terms, "OR")]
    return either[0] if len(either) == 1 else Either("or", tuple(either))


def both(terms: list[str]) -> list[Word | Either]:
    out: list[Word | Either] = []
    for part in split(terms, "AND"):
        first, *negated = split(part, "NOT", part[0] == "NOT")
        if first:
            out.append(Word(" ".join(first)))
        out += [Either("not", (Word(" ".join(x)),)) for x in negated]
    return out


def split(terms: list[str], sign: str, may_begin: bool = False) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in terms:
        if t == sign:
            out.append([])
        else:
            out[-1].append(t)
    if not all(out[may_begin:]):
        raise QueryError(f"{sign} needs words on both sides" if sign != "NOT" else "NOT needs words after it")
    return out


def search(df: DataFrame, columns: list[str], query: str | Word | Either) -> DataFrame:
    """Rows that the query matches; each of its terms has to match in one of the columns."""
    q = joined(query) if isinstance(query, str) else query
    return df.filter(q.over([F.col(c) for c in columns]))


def across(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows in which each term occurs in some column."""
    all_tokens = F.concat(*[F.coalesce(words.tokens(F.col(c)), F.array().cast("array<string>")) for c in columns])
    return df.filter(words.has_all(all_tokens, words.query_tokens(query)))


def ranked(df: DataFrame, fields: dict[str, str], query: str, popularity: str | None = None, out: str = "score", scaling: str = "sqrt") -> DataFrame:
    """Rows that match across the fields, with a score.

    The score adds what each field (primary, secondary, tertiary) counts if it has all words, and if it has them as a
    phrase; at least a tenth of the least such figure if the words only occur across fields. It is multiplied by the
    boost of the popularity. Each field's tokens are made once.
    """
    terms = words.query_tokens(query)
    if not terms:
        raise QueryError("the search has no words")
    weights = WEIGHTS[max(1, min(3, len(fields)))]
    roles = dict(zip(fields, weights, strict=False)) if not {*fields.values()} <= {*weights} else fields
    phrase = f" {' '.join(terms)} "

    def scored(t: Column) -> Column:
        score, all_tokens = F.lit(0.0), F.flatten(F.array(*[t[f"t{k}"] for k in range(len(fields))]))
        for k, column in enumerate(fields):
            own, (one, whole) = t[f"t{k}"], weights[roles[column]]
            score = score + F.when(words.has_all(own, terms), one).otherwise(0.0)
            if len(terms) > 1:
                there = F.contains(F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")), F.lit(phrase))
                score = score + F.when(words.has_all(own, terms) & there, whole).otherwise(0.0)
        least = 0.1 * min(weights[roles[c]][0] for c in fields)
        return F.when(words.has_all(all_tokens, terms), F.greatest(score, F.lit(least)))

    none = F.array().cast("array<string>")
    made = F.struct(*[F.coalesce(words.tokens(F.col(c)), none).alias(f"t{k}") for k, c in enumerate(fields)])
    found = df.withColumn(out, words.let(made, scored)).filter(F.col(out).isNotNull())
    return found.withColumn(out, F.col(out) * boost(F.col(popularity), scaling)) if popularity else found


def boost(count: Column, scaling: str = "sqrt") -> Column:
    """1 + the root of a count, 1/2 where it is 0 or missing; or 1 + its logarithm, 1/2 up to 1."""
    if scaling == "log":
        return F.when(count.isNull() | (count <= 1), 0.5).otherwise(1 + F.log(count))
    return F.when(count.isNull() | (count <= 0), 0.5).otherwise(1 + F.sqrt(count))


def near(df: DataFrame, column: str, operands: list[str], gaps: int, ordered: bool = False) -> DataFrame:
    """Rows in which all operands (words or phrases) stand with at most so many other words between them: a filter, no shuffle."""
    return df.filter(words.has_near(F.col(column), operands, gaps, ordered))


def in_one_element(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows of which some one element of an array of texts matches the whole query, as an affiliation has all its words."""
    q = joined(query)
    return df.filter(F.coalesce(F.exists(column, lambda x: q.over([x])), F.lit(False)))
