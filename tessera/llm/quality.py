"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document; expectation-maximisation estimates how often each vote is right,
and a document is kept if its probability of being good, given all votes, is at least 1/2. So one bad vote need not
reject a document, and how much it takes follows from the corpus. Rules that look at the same thing depend on each
other: they form a family, whose votes have one joint table, and families are taken as independent given the class.

A document is good or bad, and the bad ones are of several kinds, one for each family: at first, a kind is taken to fail
its own family's rules (``FAULT``) and to look like a good document to all others; which votes go together in it is
then learned. Good documents are taken to be most (``GOOD``) and to get few bad votes (``RIGHT``). These figures stay in
as prior counts of ``PRIOR`` of the corpus and 10 documents, so that a rule without evidence stays mostly right and
the classes do not change places. Only the counts of vote patterns reach the driver, as many as rules can combine their
votes and however large the corpus, so all documents that pass the base rule count in the fit.

Base counts of a text: words, their characters, symbols, repeated lines, and words in 5-word windows that occur twice.
A document with fewer than 10 words or with more than 20 % repeated words fails outright. A null text has no words.
An empty table gives no rows. Repeated rows are judged alike. A text is counted as a whole within one row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WORD, batch_bytes, free_name, spool

SPLIT = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Further counts for the rules: upper-case and all cased letters, exclamation marks, lines with a word, digits, words
#: without letter or digit, and ends of sentences.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_cased", "n_marks", "n_lines", "n_digits", "n_bare", "n_ends"]
BARE = re.compile(r"(?<![^\x20\x09-\x0D])[^\w\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")
END = re.compile(r"[.!?](?![^\x20\x09-\x0D\"'”’»)\]])")


def repeated_words(words: list[str]) -> int:
    """Words within a window of WINDOW words that occurs twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    windows = ids[:n]
    for k in range(1, WINDOW):  # each step numbers the windows anew, so equal numbers are equal windows
        windows = windows * len(number) + ids[k : n + k]
        if k < WINDOW - 1:
            windows = np.unique(windows, return_inverse=True)[1]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    words = SPLIT.findall(text)
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    cased = sum(map(len, re.findall(r"[A-Za-zÀ-ÖØ-öø-ÿ]+", text)))
    digits = sum(map(len, re.findall(r"\d+", text)))
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), upper, cased, text.count("!"), len(lines), digits, len(BARE.findall(text)), len(END.findall(text)))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its id and COUNTS."""
    batch_bytes(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts_of(x.as_py()) for x in b.column(1)]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", *COUNTS])

    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


#: Rules by family.
FAMILIES = (("length",), ("symbols", "many symbols"), ("case",), ("marks",), ("repeats", "lines"), ("words",), ("digits",), ("bare",), ("sentences",))
RULES = tuple(r for f in FAMILIES for r in f)
#: Probabilities of the votes bad, abstain, good before any evidence: of a rule on a good document, and of a rule of its
#: own family on one of a kind of bad documents; share of good documents.
RIGHT, FAULT, GOOD = (0.01, 0.29, 0.7), (0.5, 0.25, 0.25), 0.9
#: Weight of these figures, as a share of the documents.
PRIOR = 0.01


def votes(of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Per rule 1 (good), -1 (bad) or 0 (abstains)."""
    n, c = F.greatest(of("n_words"), F.lit(1)), F.greatest(of("n_cased"), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    length, chars = of("word_chars") / n, F.greatest(of("word_chars"), F.lit(1))
    return {
        "length": vote(of("n_words") < 20, of("n_words") >= 50),
        "symbols": vote(of("n_symbols") > 0.1 * n, of("n_symbols") < 0.05 * n),
        "many symbols": vote(of("n_symbols") > 0.3 * n, F.lit(False)),
        "case": vote(of("n_upper") > 0.5 * c, of("n_upper") < 0.2 * c),
        "marks": vote(of("n_marks") > 0.2 * n, of("n_marks") < 0.05 * n),
        "repeats": vote(of("n_repeat_words") > 0.1 * n, of("n_repeat_words") < 0.05 * n),
        "lines": vote(of("n_dup_lines") > 0.2 * F.greatest(of("n_lines"), F.lit(1)), F.lit(False)),
        "words": vote((length < 3) | (length > 10), (length > 4) & (length < 8)),
        "digits": vote(of("n_digits") > 0.2 * chars, of("n_digits") < 0.05 * chars),
        "bare": vote(of("n_bare") > 0.1 * n, of("n_bare") < 0.03 * n),
        "sentences": vote(of("n_ends") < 0.01 * n, of("n_ends") > 0.03 * n),
    }


class Model:
    """Share of each class (good, then the kinds of bad documents), and per family the probabilities [class][joint vote]."""

    def __init__(self, shares: np.ndarray, tables: list[np.ndarray]):
        self.shares, self.tables = shares, tables

    def classes(self, cells: np.ndarray) -> np.ndarray:
        """Posterior [class][row] of rows of joint votes, a column for each family."""
        logs = np.log(self.shares)[:, None] + sum(np.log(t[:, cells[:, k]]) for k, t in enumerate(self.tables))
        p = np.exp(logs - logs.max(axis=0))
        return p / p.sum(axis=0)


def before_evidence() -> Model:
    kinds = len(FAMILIES)
    tables = []
    for k, family in enumerate(FAMILIES):
        one = np.array([RIGHT] + [FAULT if x == k else RIGHT for x in range(kinds)])
        joint = one
        for _ in family[1:]:
            joint = (joint[:, :, None] * one[:, None, :]).reshape(1 + kinds, -1)
        tables.append(joint)
    return Model(np.array([GOOD] + [(1 - GOOD) / kinds] * kinds), tables)


def cells_of(patterns: np.ndarray) -> np.ndarray:
    """Joint votes of the families, from rows of votes in the order of RULES."""
    out, at = [], 0
    for family in FAMILIES:
        cell = np.zeros(len(patterns), np.int64)
        for _ in family:
            cell = 3 * cell + patterns[:, at] + 1
            at += 1
        out.append(cell)
    return np.stack(out, 1)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> Model:
    """Expectation-maximisation over vote patterns and their numbers."""
    start = before_evidence()
    if not patterns:
        return start
    cells = cells_of(np.array([p for p, _ in patterns]))
    n = np.array([c for _, c in patterns], float)
    strength = PRIOR * n.sum() + 10
    model = start
    for _ in range(rounds):
        weights = n * model.classes(cells)
        tables = []
        for k, prior in enumerate(start.tables):
            new = strength * prior
            for c, w in enumerate(weights):
                new[c] += np.bincount(cells[:, k], w, new.shape[1])
            tables.append(new / new.sum(axis=1, keepdims=True))
        after = Model((weights.sum(axis=1) + strength * start.shares) / (n.sum() + strength), tables)
        done = max(np.abs(a - b).max() for a, b in zip(after.tables, model.tables, strict=True)) < 1e-9
        model = after
        if done:
            break
    return model


def patterns_of(counts: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """Vote patterns and their numbers, over all rows that pass the base rule."""
    rows = counts.filter(~failed()).select(*[v.alias(k) for k, v in votes().items()]).groupBy(*RULES).agg(F.count("*").alias("n")).orderBy(*RULES)
    return [(tuple(r[:-1]), r[-1]) for r in rows.collect()]


def good_probability(model: Model, of: Callable[[str], Column] = F.col) -> Column:
    """The posterior as an expression over the counts."""
    vote = votes(of)
    row = lambda values: F.array(*[F.lit(float(x)) for x in values])
    logs = row(np.log(model.shares))
    for family, table in zip(FAMILIES, model.tables, strict=True):
        cell = F.lit(0)
        for rule in family:
            cell = 3 * cell + vote[rule] + 1
        logs = F.zip_with(logs, F.get(F.array(*[row(c) for c in np.log(table).T]), cell), lambda a, b: a + b)
    # One class after another against the good one, the first.
    return F.get(F.transform(F.array(logs), lambda x: 1 / F.aggregate(x, F.lit(0.0), lambda s, y: s + F.exp(y - x[0]))), F.lit(0))


def failed(of: Callable[[str], Column] = F.col) -> Column:
    return (of("n_words") < 10) | (100 * of("n_repeat_words") > 20 * of("n_words"))


def verdict(model: Model, of: Callable[[str], Column] = F.col) -> Column:
    return ~failed(of) & (good_probability(model, of) >= 0.5)


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its id, COUNTS, base_failed, p_good and kept."""
    counts = spool(measured(docs, doc_id, text))
    model = fit(patterns_of(counts))
    return counts.withColumns({"base_failed": failed(), "p_good": good_probability(model), "kept": verdict(model)}).withColumnRenamed("id", doc_id)


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept.

    The patterns of all rows are counted first; then each row is measured again where it lies, so no text is moved.
    """
    model = fit(patterns_of(measured(docs, doc_id, text)))
    rows = free_name(docs, "counts")
    batch_bytes(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(rows, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [dict(zip(COUNTS, counts_of(x.as_py()), strict=True)) for x in b.column(at)]
            column = pa.array(found, pa.struct([(c, pa.int64()) for c in COUNTS]))
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, rows])

    counted = docs.mapInArrow(run, schema)
    return counted.filter(verdict(model, lambda c: F.col(rows)[c])).select(*docs.columns)
