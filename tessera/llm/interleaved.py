"""Interleaved document sequences: ordered text and media references of HTML pages, with the payloads resolved.

A page is read into a sequence of parts, text blocks and media references in page order; a block is split where a media
element stands within it. A reference has its source and caption, so positions and captions stay aligned, and names a
stored payload by digest (``media:<sha256>``); other sources have no digest. A caption that no reference takes is text. A
join on the digest resolves payloads; references to the same payload share one stored row.

A payload is stored losslessly as 8-bit samples, a grey image of ``WIDTH`` samples a row (portable graymap): its bytes,
padded with 0 to full rows. ``media_store`` writes a table with the stored form of each, ``figures`` reads that table
and computes features from what it finds there. A null or empty text is a payload of one row of zeros. Equal texts have
equal values. Repeated rows each get their parts; a page without parts gives none; a reference without a stored payload
keeps null payload columns. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch_bytes, spool
from tessera.llm.html_blocks import read

WIDTH = 64
SCHEME = "media:"
STORE = "digest string, n_bytes bigint, media binary"
FIGURES = "digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
PARTS = "page {page}, position int, kind string, text string, digest string, src string, caption string"


def batch(rows: list[tuple], schema: str, first: pa.DataType | None = None) -> pa.RecordBatch:
    """Rows as a batch of this schema; first: the type of its first column, if it is another's."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*[c.split() for c in schema.split(", ")], strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, first if first is not None and not k else kinds[types[k]]) for k, c in enumerate(columns)], list(names))


def padded(raw: bytes) -> bytes:
    """With zeros up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH or WIDTH * (not raw))


def stored(payload: bytes) -> bytes:
    """The payload as a portable graymap."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples(media: bytes) -> np.ndarray:
    """Rows of 8-bit samples, read back from a portable graymap."""
    kind, shape, most, rest = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or most != b"255" or len(rest) != width * height:
        raise ValueError("not a graymap of 8-bit samples")
    return np.frombuffer(rest, np.uint8).reshape(height, width)


def feature(rows: np.ndarray) -> str:
    """Shape, mean, standard deviation and mean step between the samples of a row."""
    n = rows.size
    steps = np.abs(np.diff(rows.astype(np.int16), axis=1)).sum(dtype=np.int64)
    counts = np.bincount(rows.ravel(), minlength=256)
    value = np.arange(256)
    total, squares = int((counts * value).sum()), int((counts * value * value).sum())
    mean = total / n
    return f"{rows.shape[1]}x{rows.shape[0]} mean={mean:.4f} sd={max(0.0, squares / n - mean * mean) ** 0.5:.4f} step={steps / n:.4f}"


def digest(text: Column) -> Column:
    """The digest that names a text's payload: of its bytes before padding. By functions of the JVM."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def media_store(docs: DataFrame, text: str = "text", unique: bool = True) -> DataFrame:
    """A written table of payloads: digest, n_bytes before padding, media (the stored form); a row for each payload.

    With unique off no text is shuffled: a payload has a row from each task that met it, all of them alike.
    """
    batch_bytes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[str] = set()
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d not in met:
                    met.add(d)
                    raw = t.encode()
                    rows.append((d, len(raw), stored(padded(raw))))
            yield batch(rows, STORE)

    texts = docs.select(digest(F.col(text)).alias("digest"), F.coalesce(text, F.lit("")).alias("text"))
    return spool((texts.dropDuplicates(["digest"]) if unique else texts).mapInArrow(run, STORE))


def figures(store: DataFrame) -> DataFrame:
    """Sizes, digests and feature of each payload, from its stored form as read back."""
    batch_bytes(store.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, n, media in zip(*[c.to_pylist() for c in b.columns], strict=True):
                back = samples(media)
                payload = back.tobytes()
                rows.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
            yield batch(rows, FIGURES)

    # A table of its own, so that a later join on digests may be split where one is frequent.
    return spool(store.select("digest", "n_bytes", "media").mapInArrow(run, FIGURES).dropDuplicates(["digest"]))


def parts(source: str | None) -> list[tuple[int, str, str | None, str | None, str | None, str | None]]:
    """The page's parts: position, kind (text or media), text, digest, src, caption (else the alternative text)."""
    page = read(source or "")
    out: list[tuple] = []
    media = [m for m in page.media if m.attributes.get("src")]
    taken = {m.figure for m in media if m.figure}
    at = 0

    def reference() -> None:
        nonlocal at
        m = media[at]
        src = m.attributes["src"]
        out.append(("media", None, src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, src, page.captions.get(m.figure) or m.attributes.get("alt")))
        at += 1

    # Elements without a source split a block, too, but are no parts.
    sourced = {}
    for m in page.media:
        sourced.setdefault((m.order, m.inside), []).append(bool(m.attributes.get("src")))
    for i in range(len(page.blocks) + 1):
        for here in sourced.get((i, False), ()):
            if here:
                reference()
        if i == len(page.blocks):
            break
        b = page.blocks[i]
        text = b.caption_of not in taken
        inner = sourced.get((i, True), ())
        for k, piece in enumerate(b.pieces or (b.text,)):
            if piece and text:
                out.append(("text", piece, None, None, None))
            if k < len(inner) and inner[k]:
                reference()
    return [(k, *x) for k, x in enumerate(out)]


def sequences(pages: DataFrame, payloads: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Parts of all pages, a row each, with the columns of payloads (by its digest) where a reference is resolved."""
    batch_bytes(pages.sparkSession)
    schema = PARTS.format(page=pages.schema[page_id].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch([(i, *x) for i, source in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in parts(source.as_py())], schema, b.column(0).type)

    found = pages.select(F.col(page_id).alias("page"), F.col(html).alias("html")).mapInArrow(run, schema)
    return found.join(payloads.withColumnRenamed("digest", "store_digest"), F.col("digest") == F.col("store_digest"), "left").drop("store_digest").withColumnRenamed("page", page_id)


def as_page(doc_id: Column, text: Column) -> Column:
    """A page that names a document and refers to its text's payload, for a table of texts without pages."""
    name = F.concat(F.lit("document "), F.coalesce(doc_id.cast("string"), F.lit("?")))
    return F.concat(F.lit("<p>"), name, F.lit('</p><figure><img src="media:'), digest(text), F.lit('"><figcaption>'), name, F.lit("</figcaption></figure>"))
