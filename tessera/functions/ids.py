"""Identifiers in any spelling, as Spark columns: the canonical form, or null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of public identifier schemes, and the addresses that canonical forms begin with.
PATTERNS = {
    "doi": (r"(10\.\d+/\S+)", "https://doi.org/"),
    "orcid": (r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", "https://orcid.org/"),
    "ror": (r"(?:^|/)(0[a-z0-9]{6}\d{2})$", "https://ror.org/"),
    "issn": (r"(?:^|[^\dX-])(\d{4}-\d{3}[\dX])(?:$|[^\dX-])", ""),
    "wikidata": (r"(Q\d+)$", "https://www.wikidata.org/wiki/"),
    "pmid": (r"(?i)^(?:pmid:|https?://pubmed\.ncbi\.nlm\.nih\.gov/)?\s*(\d{1,9})/?$", "https://pubmed.ncbi.nlm.nih.gov/"),
    "pmcid": (r"(?i)(?:^|pmcid:|PMC|articles/PMC)\s*(\d+)/?$", "https://www.ncbi.nlm.nih.gov/pmc/articles/"),
    "slug": (r"([^/\s]+)/?$", ""),
    "scopus": (r"(?:authorID=|scopus:|^)(\d{8,})", ""),
}
UPPER = ("orcid", "issn", "wikidata")
LOWER = ("doi", "ror", "slug")


def identifier(kind: str, text: Column) -> Column:
    """The bare identifier found in text; null if there is none."""
    pattern, _ = PATTERNS[kind]
    text = F.trim(text)
    text = F.upper(text) if kind in UPPER else F.lower(text) if kind in LOWER else text
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def canonical(scheme: str, value: str) -> str | None:
    """The same of one value, on the driver. scheme: a public one, or the letters of own ids, which are bare and upper case."""
    text = value.strip()
    if scheme not in PATTERNS:
        found = re.search(rf"(?:^|/)([{scheme}]\d{{2,}})$", text.upper())
        return found[1] if found else None
    text = text.upper() if scheme in UPPER else text.lower() if scheme in LOWER else text
    found = re.search(PATTERNS[scheme][0], text)
    return found[1] if found else None


def address(kind: str, text: Column) -> Column:
    """The identifier as a full address."""
    return F.concat(F.lit(PATTERNS[kind][1]), identifier(kind, text))


def entity_id(text: Column, letters: str) -> Column:
    """An entity's own id: one of these letters and at least two digits, upper case, from any spelling."""
    found = F.regexp_extract(F.upper(F.trim(text)), rf"(?:^|/)([{letters}]\d{{2,}})$", 1)
    return F.when(found != "", found)


def entity_of(text: Column, letters: dict[str, str]) -> Column:
    """The entity that an id's first letter stands for."""
    first = F.substring(entity_id(text, "".join(letters)), 1, 1)
    out = F.lit(None).cast("string")
    for letter, name in letters.items():
        out = F.when(first == letter, name).otherwise(out)
    return out
