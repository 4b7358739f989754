"""Packing along a space-filling curve.

A document's set of tokens is a hashed vector: each token has a fixed random direction in ``DIMENSIONS`` dimensions,
and the document lies at their sum, over the root of their number. Each coordinate is close to normal, so its normal
distribution function spreads documents evenly over the cells of a grid; a cell's number along the Hilbert curve,
then a hash of the id, is the sort key. Documents are range-sorted by it and laid end to end, and the row of all tokens
is cut every ``LENGTH``: neighbours on the curve share sequences, and only the very last sequence needs padding.

A batch of texts is tokenized as a whole: its different words once each, and those merged side by side, so that new
words cost little more than known ones. The hash in the key spreads copies, which share a cell, over the ranges.
Tokenized documents are written once, two bytes a token, so that neither the range boundaries nor a lost executor
tokenizes them anew. The boundaries are approximate quantiles of the key; of each range only a boundary and its token
sum reach the driver. Then one shuffle brings the documents into their order, and the tasks that read it cut them. A
null or empty text has the end token only. Rows with the same id are packed each; their order among themselves is open.
An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch_bytes, spool

LENGTH = 2048
END = 1
DIMENSIONS, BITS = 3, 10
#: Bytes of chunks and ids that a worker keeps of those that only the library splits, with so many for each entry itself;
#: longer chunks are not kept, and longer pieces not merged in tables.
CACHE_BYTES, ENTRY, LONGEST = 192 << 20, 250, 64
#: Symbols in a table of pieces of one length.
TABLE = 1 << 18
#: Ranges for each shuffle partition, so that partitions even out.
RANGES = 4
# How the word vocabulary splits text, the same for lower-case text of the letters below, and other text
# than of composed letters that have one lower-case form each.
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\v\f\r a-z0-9ß-öø-ÿ]+"
STEPS = ["NFC", "Replace", "Lowercase"]
OPTIONS = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
OTHER = r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]"
#: Byte-level vocabularies write a byte as its Latin-1 character where that is visible, others as characters from 256 on.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SIGNS = {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in VISIBLE)}
PIECE = "id {id}, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def views(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the strings of an array, and the bytes that they bound."""
    _, ends, data = strings.buffers()
    return np.frombuffer(ends, np.int32)[strings.offset :][: len(strings) + 1], np.frombuffer(data or b"", np.uint8)


def binaries(ends: np.ndarray, data: pa.Buffer | np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def laid(values: pa.Array, at: pa.Array, bounds: pa.Array) -> pa.Array:
    """Values at these places, those between two bounds end to end."""
    ends, data = views(values.take(at))
    return binaries(ends[bounds.to_numpy()], data)


class Merges:
    """The merges of a byte-level vocabulary, for many pieces at once.

    Pieces of one length are the columns of a table of symbols. Each step merges in every column its pair of the least
    rank, of equals the first, as the library does piece by piece.
    """

    NONE = 1 << 30

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        signs = [SIGNS.get(b, chr(b)) for b in range(256)]
        self.inner, self.last = (np.array([vocab[c + x] for c in signs], np.int32) for x in ("", suffix))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rank = {vocab[a] << 16 | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pairs = np.array(sorted(rank), np.uint32)
        self.rank = np.array([rank[k] for k in sorted(rank)], np.int32)

    def order(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """When the pair of a and b at this place of its piece is merged: by rank, then place."""
        pair = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        i = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[i] == pair, self.rank[i] * LONGEST + at, self.NONE)

    def table(self, data: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
        """Ids of the pieces of this length (up to LONGEST) that begin there: a column each, -1 where a symbol was merged away."""
        n = len(begin)
        ids = self.inner[data[begin + np.arange(length)[:, None]]]
        ids[-1] = self.last[data[begin + length - 1]]
        due = np.full((length, n), self.NONE, np.int32)
        due[:-1] = self.order(ids[:-1], ids[1:], np.arange(length - 1, dtype=np.int32)[:, None])
        after = np.repeat(np.arange(1, length + 1, dtype=np.int32)[:, None], n, 1)
        before = after - 2
        flat_ids, flat_due, flat_after, flat_before = (x.ravel() for x in (ids, due, after, before))  # views
        column, first = np.arange(n), due.min(axis=0)
        while len(column := column[on := first < self.NONE]):
            row, k = first[on] % LONGEST, first[on] // LONGEST
            one = row * n + column
            two = flat_after[one] * n + column
            end = flat_after[two]
            flat_ids[one], flat_ids[two], flat_after[one] = self.made[k], -1, end
            flat_due[one] = flat_due[two] = self.NONE
            some = end < length
            mine, other = one[some], (end * n + column)[some]
            flat_before[other] = row[some]
            flat_due[mine] = self.order(flat_ids[mine], flat_ids[other], row[some])
            begins = flat_before[one]
            some = begins >= 0
            mine, other = one[some], (begins * n + column)[some]
            flat_due[other] = self.order(flat_ids[other], flat_ids[mine], begins[some])
            first = due[:, column].min(axis=0) if 2 * len(column) < n else due.min(axis=0)[column]
        return ids


class Words:
    """Ids of texts by a tokenizers file. No token crosses white space, so of a batch each chunk between blanks is encoded once.

    Chunks are split here by the file's rule, and pieces merged by its merges; the library itself encodes chunks with
    other than plain letters or with a special string, and all if the rule or the kind of model is another. A worker
    keeps the ids of those.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.size = self.tokenizer.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("two bytes do not hold the ids of this vocabulary")
        with open(file, encoding="utf-8") as f:
            stated = json.load(f)
        model, rules = stated["model"], json.dumps(stated["pre_tokenizer"])
        steps = [x["type"] for x in (stated["normalizer"] or {}).get("normalizers", [])]
        known = steps == STEPS and json.dumps(SPLIT_RULE) in rules and model["type"] == "BPE" and not any(model.get(k) for k in OPTIONS)
        self.merges = Merges(model) if known else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}
        self.held = 0

    def library(self, chunks: list[str]) -> list[bytes]:
        """Ids of any chunks."""
        new: dict[str, bytes] = {}
        left = [c for c in chunks if c not in self.seen]
        for i in range(0, len(left), 10_000):
            part = left[i : i + 10_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                new[c] = struct.pack(f"<{len(e)}H", *e.ids)
        out = [new[c] if c in new else self.seen[c] for c in chunks]
        kept = {c: x for c, x in new.items() if len(c) <= LONGEST}
        size = sum(4 * len(c) + len(x) + ENTRY for c, x in kept.items())
        if self.held + size > CACHE_BYTES:
            self.seen, self.held = {}, 0
        if size <= CACHE_BYTES:
            self.seen |= kept
            self.held += size
        return out

    def merged(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces that the rule leaves whole."""
        ends, data = views(pieces)
        size = np.diff(ends)
        order = np.argsort(size, kind="stable")
        lengths, starts = np.unique(size[order], return_index=True)
        values, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for length, rows in zip(lengths.tolist(), np.split(order, starts[1:])[: len(lengths)], strict=True):
            if 0 < length <= LONGEST:
                for i in range(0, len(rows), TABLE // length):
                    ids = self.merges.table(data, ends[rows[i : i + TABLE // length]].astype(np.int64), length).T
                    values.append(ids[ids >= 0])
                    counts.append((ids >= 0).sum(axis=1))
            else:
                for i in rows.tolist():
                    signs = "".join(SIGNS.get(b, chr(b)) for b in data[ends[i] : ends[i + 1]].tolist())
                    values.append(np.array([t.id for t in self.tokenizer.model.tokenize(signs)] if signs else [], np.int32))
                    counts.append(np.array([len(values[-1])]))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return binaries(2 * np.cumsum(np.concatenate(counts)), np.concatenate(values).astype("<u2")).take(pa.array(place))

    def chunks(self, chunks: pa.Array) -> pa.Array:
        """Ids of each chunk."""
        other = pc.match_substring_regex(chunks, OTHER) if self.merges else pa.array(np.ones(len(chunks), bool))
        for s in self.special:
            other = pc.or_(other, pc.match_substring(chunks, s))
        split = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(chunks.filter(pc.invert(other))), PIECES, r"\0 "), " ")
        found = split.flatten().dictionary_encode()
        own = laid(self.merged(found.dictionary), found.indices, split.offsets)
        if not pc.any(other).as_py():
            return own
        rest = pa.array(self.library(chunks.filter(other).to_pylist()), pa.binary())
        other = other.to_numpy(zero_copy_only=False)
        return pa.concat_arrays([own, rest]).take(pa.array(np.where(other, len(own) + np.cumsum(other), np.cumsum(~other)) - 1))

    def encoded(self, texts: pa.Array) -> pa.Array:
        """Per text its ids, two bytes each."""
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        return laid(self.chunks(found.dictionary), found.indices, split.offsets)

    def ids(self, texts: list[str]) -> list[bytes]:
        return self.encoded(pa.array(texts, pa.string())).to_pylist()


@cache
def words(file: str) -> Words:
    return Words(file)


@cache
def directions(size: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((size, DIMENSIONS)).astype(np.float32)


def cells(ids: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The grid cells of the hashed vectors of documents, whose ids lie between these bounds."""
    n = len(bounds) - 1
    row = np.arange(n, dtype=np.uint32 if n <= 1 << 16 else np.uint64) << 16
    kinds = np.sort(np.repeat(row, np.diff(bounds)) | ids)
    kinds = kinds[np.diff(kinds, prepend=~kinds[:1]) != 0]
    starts = np.searchsorted(kinds, row)
    at = np.add.reduceat(table[kinds & 0xFFFF], starts) / np.sqrt(np.diff(starts, append=len(kinds)), dtype=np.float32)[:, None]
    share = np.array([(1 + math.erf(x / math.sqrt(2))) / 2 for x in at.ravel().tolist()])
    return np.minimum((1 << BITS) - 1, (share * (1 << BITS)).astype(np.int64)).reshape(at.shape)


def hilbert(cells: np.ndarray) -> np.ndarray:
    """Numbers of grid cells along the Hilbert curve (Skilling's transformation), for rows of coordinates."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def tokenized(docs: DataFrame, file: str, doc_id: str, text: str) -> DataFrame:
    """id, key (place on the curve, then hash of the id), ids (with the end token, two bytes each)."""
    batch_bytes(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([END], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(file)
        table = directions(w.size)
        for b in batches:
            if not b.num_rows:
                continue
            rows = pc.binary_join_element_wise(w.encoded(b.column(1).cast(pa.string()).fill_null("")), end, b"")
            bounds, data = views(rows)
            place = hilbert(cells(data.view("<u2"), bounds // 2, table))
            key = (place << 32) | b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.int64()), rows], ["id", "key", "ids"])

    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(doc_id).bitwiseAND(F.lit((1 << 32) - 1)).alias("hash"))
    return slim.mapInArrow(run, f"id {kind}, key bigint, ids binary")


def bounds_below(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above key, by bisection."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda low, step: F.when((low + step <= len(bounds)) & (F.get(table, low + step - 1) <= key), low + step).otherwise(low))


def pieces(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """A row per piece: id, start in its document, length, ids (two bytes each), ids_crc32 (of four bytes each), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = spool(tokenized(docs, file, doc_id, text))
    kind = rows.schema["id"].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = RANGES * tasks
    bounds = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    dealt = rows.withColumn("part", bounds_below(F.col("key"), sorted(set(bounds)))).withColumn("n", F.call_function("div", F.length("ids"), F.lit(2)))
    base, before = {}, 0
    for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each range
        base[r.part], before = before, before + r.n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begin = None, 0
        for b in batches:
            out: list[tuple] = []
            for i, ids, p in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if p != part:
                    part, begin = p, base[p]
                start, n = 0, len(ids) // 2
                while start < n:
                    sequence, offset = divmod(begin + start, length)
                    k = min(n - start, length - offset)
                    own = ids[2 * start : 2 * (start + k)]
                    out.append((i, start, k, own, zlib.crc32(np.frombuffer(own, "<u2").astype("<u4").tobytes()), n, sequence, offset))
                    start += k
                begin += n
            columns = zip(*out, strict=True) if out else [[]] * 8
            kinds = [b.column(0).type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ordered = dealt.repartition(tasks, "part").sortWithinPartitions("part", "key", "id")
    return ordered.select("id", "ids", "part").mapInArrow(cut, PIECE.format(id=kind)).withColumnRenamed("id", doc_id)
