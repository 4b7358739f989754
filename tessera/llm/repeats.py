"""Repeated passages by a run-length index: bytes in strings of 100 that also start earlier are marked.

*Anchors.* In each string of ``LENGTH`` bytes the ``SEED``-byte substring with the least hash, and all that tie, are
anchors, so equal strings have an equal anchor at the same place. An anchor's segment is all that its strings cover.
Hashes only deal anchors out: a seed that occurs once has no repeats, all others go on with the bytes of their segments.

*Index.* Segments are dealt by seed and indexed in chunks of bounded size: a suffix array yields the Burrows-Wheeler
transform, of which only the runs are kept, with the text position, its predecessor in suffix order and their common
prefix sampled at each run's end. Segments of the same bytes, whose rows would lie in the same runs, are one text of the
index with all their places; all places but the first (least id, then position) are repeats. From the samples the
matching statistics of every position are streamed in text order: between two samples the predecessor moves along and
the common prefix falls by one. Positions whose match is at least LENGTH long, linked to their predecessors, are the
occurrences of one string; all but the first are marked. So whatever is marked was compared by its bytes.

*Crowded seeds.* A seed with more than ``MOST`` different segments, such as that of a line that very many documents share,
is more than a chunk holds; of one with more than ``BUSY`` anchors, more than a task should read, equal segments are
joined first, dealt by their bytes. Where more than MOST different ones are left, the anchor grows: each string reaches
over the seed by half of what it has to spare on the left or on the right, so it is dealt anew by the seed with that
half, and again, until no anchor is crowded; an anchor as long as a string has equal segments only. All then go through
the same index.

Texts are UTF-8 bytes; null is empty. Matches do not cross documents. Rows with equal id and text are one document, each
reported; rows with equal id and other texts are documents of their own, told apart and ordered by a 64-bit digest of
the text, and so are those with a null id, which comes after all others. Documents are read in blocks, so a long one
needs memory for itself and a block's hashes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch_bytes, scratch, small, spool

LENGTH = 100
SEED = 44
AROUND = LENGTH - SEED
BLOCK = 1 << 19
#: Anchors that a task joins at once; bytes of segments that it does.
JOINED, HELD = 1 << 19, 1 << 25
#: Anchors of a seed that one task may read; different segments of an anchor that a chunk may hold; bytes of a chunk.
BUSY, MOST, CHUNK = 100_000, 25_000, 1 << 19
#: Stands for a null id, after all others.
LAST = (1 << 63) - 1
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Polynomial:
    """Hashes of substrings, modulo 2 ** 64, with an odd base that can be divided out."""

    def __init__(self) -> None:
        base = 0x9E3779B97F4A7C15
        n = BLOCK + 4 * LENGTH
        self.letters = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
        self.up = np.cumprod(np.full(n, base, U))
        self.down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), U))

    def prefix(self, text: np.ndarray) -> np.ndarray:
        out = np.zeros(len(text) + 1, U)
        np.cumsum(self.letters[text] * self.up[: len(text)], out=out[1:])
        return out

    def part(self, prefix: np.ndarray, lo: np.ndarray | slice, hi: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
        return mixed((prefix[hi] - prefix[lo]) * self.down[at])


POLYNOMIAL: list[Polynomial] = []


def polynomial() -> Polynomial:
    if not POLYNOMIAL:
        POLYNOMIAL.append(Polynomial())
    return POLYNOMIAL[0]


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each window of so many values."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    if done < width:
        x = best(x[: done - width], x[width - done :])
    return x


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seed hash and position of each anchor."""
    p, n = polynomial(), len(text)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    width = AROUND + 1
    for begin in range(0, max(0, n - SEED + 1) if n >= LENGTH else 0, BLOCK):
        # The block's anchors depend on LENGTH bytes to either side.
        lo, hi = max(0, begin - LENGTH), min(n, begin + BLOCK + 2 * LENGTH)
        if hi - lo < LENGTH:
            continue
        prefix = p.prefix(text[lo:hi])
        h = p.part(prefix, slice(None, -SEED), slice(SEED, None), slice(0, hi - lo - SEED + 1))
        least = sliding(h, width, np.minimum)
        edge = np.zeros(width - 1, U)
        at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)
        at = at[(at + lo >= begin) & (at + lo < begin + BLOCK)]
        found.append((h[at], at + lo))
    if not found:
        return np.empty(0, U), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def joined(seed: np.ndarray, doc: np.ndarray, sub: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """A task's anchors: kind, seed, doc, sub, at, n.

    Kind 0 is the one anchor of its seed here, kind 1 one of several, known to be repeated; kind 2 says of a seed that
    it has n of them.
    """
    order = np.argsort(seed, kind="stable")
    seed, doc, sub, at = (x[order] for x in (seed, doc, sub, at))
    first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
    n = np.diff(np.concatenate([first, [len(seed)]]))
    several = np.repeat(n > 1, n)
    told = first[n > 1]
    kind = np.concatenate([several.astype(np.int8), np.full(len(told), 2, np.int8)])
    take = np.concatenate([np.arange(len(seed)), told])
    return kind, seed[take], doc[take], sub[take], at[take], np.concatenate([np.ones(len(seed), np.int64), n[n > 1]])


def anchor_rows(texts: DataFrame) -> DataFrame:
    """Anchors of texts (doc, sub, text), as joined in each task."""
    names = ["kind", "seed", "doc", "sub", "at", "n"]

    def out(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        kind, seed, doc, sub, at, n = joined(*[np.concatenate(x) for x in held])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (kind, seed.view(np.int64), doc, sub, at.astype(np.int32), n.astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        count = 0
        for b in batches:
            for d, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                buffer = t.as_buffer()
                if buffer is None or buffer.size < LENGTH:
                    continue
                seed, at = anchors(np.frombuffer(buffer, np.uint8))
                for x, y in zip(held, (seed, np.full(len(at), d, np.int64), np.full(len(at), s, np.int64), at), strict=True):
                    x.append(y)
                count += len(at)
                if count >= JOINED:
                    yield out(held)
                    held, count = [[], [], [], []], 0
        if count:
            yield out(held)

    return texts.select("doc", "sub", "text").mapInArrow(run, "kind tinyint, seed bigint, doc bigint, sub bigint, at int, n int")


def repeated(rows: DataFrame, most: int) -> DataFrame:
    """Anchors of repeated seeds (kind 1), and seeds with more than ``most`` of them (kind 3): kind, seed, doc, sub, at."""
    # Anchors known to be repeated need not meet others: they are spread by their places.
    home = F.when(F.col("kind") == 1, F.xxhash64("doc", "at")).otherwise(F.col("seed"))
    dealt = rows.repartition(home).sortWithinPartitions("seed")

    def made(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int8, np.int64, np.int64, np.int64, np.int32), strict=True)], ["kind", "seed", "doc", "sub", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last seed, its anchors so far, and its row while there is but one.
        last, total, waiting = None, 0, np.empty((5, 0), np.int64)
        for b in batches:
            kind, seed, doc, sub, at, n = (c.to_numpy().astype(np.int64) for c in b.columns)
            known = kind == 1
            rows = np.stack([np.ones(len(kind), np.int64), seed, doc, sub, at])
            yield made(list(rows[:, known]))
            rows, n, lone = rows[:, ~known], n[~known], (kind == 0)[~known]
            if not len(n):
                continue
            first = np.flatnonzero(np.concatenate([[True], rows[1, 1:] != rows[1, :-1]]))
            sums = np.add.reduceat(n, first)
            if rows[1, 0] == last:
                sums[0] += total
                if sums[0] > 1:
                    yield made(list(waiting))
                    waiting = waiting[:, :0]
            else:
                if total > most:
                    yield made([np.array([x]) for x in (3, last, 0, 0, 0)])
                waiting = waiting[:, :0]
            sizes = np.diff(np.concatenate([first, [len(n)]]))
            yield made(list(rows[:, lone & np.repeat(sums > 1, sizes)]))
            crowded = rows[:, first[:-1]][:, sums[:-1] > most]
            crowded[0] = 3
            yield made(list(crowded))
            last, total = rows[1, -1], int(sums[-1])
            if total == 1:
                waiting = rows[:, -1:]
        if total > most:
            yield made([np.array([x]) for x in (3, last, 0, 0, 0)])

    return dealt.mapInArrow(run, "kind tinyint, seed bigint, doc bigint, sub bigint, at int")


#: A segment with its first place (doc, sub, begin) and others; off: where its anchor begins in it.
SEGMENT = "key bigint, off int, bytes binary, doc bigint, sub bigint, begin int, more array<struct<doc:bigint,sub:bigint,begin:int>>"
#: A repeated span (lo to hi), or a segment that begins at lo (hi null).
FOUND = "doc bigint, sub bigint, lo int, hi int, key bigint, off int, bytes binary"


def segment_batch(found: dict[tuple[int, int, bytes], int], group: list[int], doc: list[int], sub: list[int], begin: list[int]) -> pa.RecordBatch:
    """Each different (key, off, bytes) once, with its places in order; found numbers them, group has the number of each place."""
    group, doc, sub, begin = np.array(group, np.int64), np.array(doc, np.int64), np.array(sub, np.int64), np.array(begin, np.int32)
    order = np.lexsort((begin, sub, doc, group))
    group, doc, sub, begin = group[order], doc[order], sub[order], begin[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    again = np.concatenate([[False], (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (begin[1:] == begin[:-1])]) | first
    more = pa.StructArray.from_arrays([pa.array(x[~again]) for x in (doc, sub, begin)], ["doc", "sub", "begin"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(group[~again], minlength=len(found)))]).astype(np.int32)
    keys, offs, parts = zip(*found, strict=True)
    columns = [pa.array(keys, pa.int64()), pa.array(offs, pa.int32()), pa.array(parts, pa.binary()), *[pa.array(x[first]) for x in (doc, sub, begin)], pa.ListArray.from_arrays(pa.array(ends), more)]
    return pa.RecordBatch.from_arrays(columns, ["key", "off", "bytes", "doc", "sub", "begin", "more"])


def segments(texts: DataFrame) -> DataFrame:
    """Segments of the anchors at places (seed, at) of texts (doc, sub, bytes), those of equal bytes in a task as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, places, size = {}, ([], [], [], []), 0
        for b in batches:
            seeds, ats = (x.tolist() for x in (b.column(3).flatten().field(0).to_numpy(), b.column(3).flatten().field(1).to_numpy()))
            ends = b.column(3).offsets.to_numpy() - b.column(3).offsets[0].as_py()
            group, docs, subs, begins = places
            for k, (doc, sub, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for i in range(ends[k], ends[k + 1]):
                    at = ats[i]
                    begin = at - AROUND if at > AROUND else 0
                    part = text[begin : at + LENGTH]
                    group.append(found.setdefault((seeds[i], at - begin, part), len(found)))
                    begins.append(begin)
                n = ends[k + 1] - ends[k]
                docs += [doc] * n
                subs += [sub] * n
                size += n * LENGTH
                if size >= HELD:
                    yield segment_batch(found, *places)
                    found, places, size = {}, ([], [], [], []), 0
                    group, docs, subs, begins = places
        if found:
            yield segment_batch(found, *places)

    return texts.select("doc", "sub", "bytes", "places").mapInArrow(run, SEGMENT)


def grown(rows: DataFrame, length: int) -> DataFrame:
    """Segments of anchors of this length, dealt anew by longer ones: a segment for the strings that reach far to the right, one for the rest."""
    spare = LENGTH - length
    half = -(-spare // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, places = {}, ([], [], [], [])
            for _, off, text, doc, sub, begin in zip(*[c.to_pylist() for c in b.columns[:6]], strict=True):
                # First and last start of the strings, and where the longer anchor begins.
                for lo, hi, anchor in ((off - (spare - half), off, off), (off - spare, off - (spare - half) - 1, off - half)):
                    lo, end = max(lo, 0), min(hi + LENGTH, len(text))
                    if anchor >= 0 and anchor + length + half <= len(text) and end - lo >= LENGTH:
                        key = xxhash.xxh3_64_intdigest(text[anchor : anchor + length + half]) - (1 << 63)
                        for x, y in zip(places, (found.setdefault((key, anchor - lo, text[lo:end]), len(found)), doc, sub, begin + lo), strict=True):
                            x.append(y)
            if found:
                yield segment_batch(found, *places)

    return rows.mapInArrow(run, SEGMENT)


def again_spans(b: pa.RecordBatch, repeat: np.ndarray) -> list[np.ndarray]:
    """doc, sub, lo, hi of the first places of these rows and of all other places of all rows."""
    size = pa.compute.binary_length(b.column(2)).to_numpy().astype(np.int64)
    doc, sub, begin = (b.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5))
    more = b.column(6)
    inner = [x.to_numpy().astype(np.int64) for x in more.flatten().flatten()]
    long = np.repeat(size, np.diff(more.offsets.to_numpy()))
    return [np.concatenate(x) for x in ((doc[repeat], inner[0]), (sub[repeat], inner[1]), (begin[repeat], inner[2]), (begin[repeat] + size[repeat], inner[2] + long))]


def found_batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), [c.split()[0] for c in FOUND.split(", ")])


def spans_batch(doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(doc))
    return found_batch(pa.array(doc.astype(np.int64)), pa.array(sub.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()))


def crowded_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Segments (key, off, bytes, doc, sub, begin)."""
    key, off, text, doc, sub, begin = zip(*rows, strict=True)
    kinds = (doc, pa.int64()), (sub, pa.int64()), (begin, pa.int32()), ([None] * len(rows), pa.int32()), (key, pa.int64()), (off, pa.int32()), (text, pa.binary())
    return found_batch(*[pa.array(x, t) for x, t in kinds])


class Collapse:
    """Of sorted segments the first of each (key, off, bytes); others are repeats, but for rows of the very same place."""

    def __init__(self) -> None:
        self.last: tuple = (None, None, None)
        self.place: tuple = (0, 0, 0)

    def split(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are first, and those that are repeats."""
        n = b.num_rows
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key, off = b.column(0).to_numpy(), b.column(1).to_numpy()
        places = [b.column(k).to_numpy() for k in (3, 4, 5)]
        text = b.column(2)
        same = pa.compute.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False) & (key[1:] == key[:-1]) & (off[1:] == off[:-1])
        carried = self.last == (key[0], off[0], text[0].as_py())
        first = np.concatenate([[not carried], ~same])
        lead = np.maximum.accumulate(np.where(first, np.arange(n), -1))
        moved = np.zeros(n, bool)
        for p, before in zip(places, self.place, strict=True):
            moved |= p != np.where(lead < 0, before, p[lead])
        self.place = tuple(p[lead[-1]] if lead[-1] >= 0 else before for p, before in zip(places, self.place, strict=True))
        self.last = key[-1], off[-1], text[n - 1].as_py()
        return np.flatnonzero(first), np.flatnonzero(~first & moved)


def ordered(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions("key", "off", "bytes", "doc", "sub", "begin")


def collapsed(rows: DataFrame) -> DataFrame:
    """Segments, each different one once, and spans of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Collapse()
        for b in batches:
            first, repeat = state.split(b)
            yield spans_batch(*again_spans(b, repeat))
            key, off, text, doc, sub, begin = b.take(pa.array(first)).columns[:6]
            yield found_batch(doc, sub, begin, pa.nulls(len(first), pa.int32()), key, off, text)

    return ordered(rows, "key", "off", "bytes").mapInArrow(run, FOUND)


def spans_in(found: DataFrame) -> DataFrame:
    return found.filter("hi is not null").select("doc", "sub", "lo", "hi")


def segments_in(found: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<doc:bigint,sub:bigint,begin:int>>")
    return found.filter("hi is null").select("key", "off", "bytes", "doc", "sub", F.col("lo").alias("begin"), none.alias("more"))


def dealt_out(rows: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Segments of crowded anchors, as segments of anchors that are not, and spans found on the way."""
    calm, spans, length = None, [], SEED
    while True:
        both = spool(collapsed(rows))
        spans.append(spans_in(both))
        rows = segments_in(both)
        crowded = spool(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"))
        if length == LENGTH or crowded.isEmpty():
            return rows if calm is None else calm.unionByName(rows), spans
        crowded = small(crowded)
        part = rows.join(crowded, "key", "left_anti")
        calm = part if calm is None else calm.unionByName(part)
        rows = grown(rows.join(crowded, "key", "left_semi"), length)
        length += -(-(LENGTH - length) // 2)


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of a chunk of segments, with samples at run ends.

    Each segment is followed by a separator of its own. Kept are, for each run, the text position of its end, the
    position before it in suffix order, and the length of their common prefix.
    """

    def __init__(self, segments: list[bytes]):
        lengths = np.array([len(s) for s in segments], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        self.n = n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        separator = np.zeros(n, bool)
        separator[ends] = True
        text[~separator] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
        self.left = np.repeat(ends, lengths + 1) - np.arange(n)  # bytes up to the separator
        suffixes, levels = self.sort(text, int(lengths.max()) + 1)
        before = np.where(suffixes > 0, text[suffixes - 1], 0)
        start = np.ones(n, bool)
        start[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        runs = np.flatnonzero(start)
        position, previous = suffixes[runs], np.where(runs > 0, suffixes[runs - 1], -1)
        common = self.common(text, levels, position, previous)
        order = np.argsort(position)
        self.position, self.previous, self.prefix = position[order], previous[order], common[order]

    def sort(self, text: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix array by prefix doubling, and ranks by so many first bytes, each time twice as many."""
        n = self.n
        bits = n.bit_length()
        symbols = np.flatnonzero(np.bincount(text))
        size = len(symbols) + 1
        width = max(1, (62 - bits) // size.bit_length())
        number = np.zeros(int(text.max()) + 1, np.int64)
        number[symbols] = np.arange(len(symbols))
        padded = np.concatenate([number[text], np.zeros(width, np.int64)])
        key = padded[:n].copy()
        for k in range(1, width):
            key *= size
            key += padded[k : k + n]
        # What lies behind the separator does not count.
        short = np.flatnonzero(self.left < width)
        key[short] -= key[short] % size ** (width - self.left[short])
        # Suffixes that end within the width are told apart by position: the sorted words end in it.
        order = np.sort((key << bits) | np.arange(n)) & ((1 << bits) - 1)
        key = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = (key[1:] != key[:-1]) | (self.left[order[1:]] < width)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        levels = [(width, rank)]
        while width < longest:
            group = np.bincount(rank, minlength=n)
            active = np.flatnonzero(group[rank] > 1)
            if not len(active):
                break
            base, second = rank[active], rank[np.minimum(active + width, n - 1)]
            if 3 * bits <= 63:
                packed = np.sort((base << 2 * bits) | (second << bits) | active)
                where, key = packed & ((1 << bits) - 1), packed >> bits
            else:
                key = (base << bits) | second
                o = np.argsort(key, kind="stable")
                where, key = active[o], key[o]
            base = key >> bits
            at = np.arange(len(where))
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            new_base = np.concatenate([[True], base[1:] != base[:-1]])
            rank = rank.copy()
            rank[where] = base + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(new_base, at, 0))
            width *= 2
            levels.append((width, rank))
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        return suffixes, levels

    def common(self, text: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes; separators differ. What is left at a level is shorter than twice its width."""
        length = np.zeros(len(a), np.int64)
        known = np.flatnonzero(b >= 0)
        x, y, last = a[known], b[known], self.n - 1
        found = np.zeros(len(known), np.int64)
        for width, rank in reversed(levels):
            same = (rank[x] == rank[y]) & (x != y)
            step = np.where(same, width, 0)
            found += step
            x, y = np.minimum(x + step, last), np.minimum(y + step, last)
        live = np.ones(len(known), bool)
        for _ in range(levels[0][0]):
            live &= (text[x] == text[y]) & (text[x] > 0)
            found += live
            x, y = np.minimum(x + live, last), np.minimum(y + live, last)
        length[known] = found
        return length

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position its predecessor in suffix order, and the length of their match."""
        counts = np.diff(np.concatenate([self.position, [self.n]]))
        step = np.arange(self.n) - np.repeat(self.position, counts)
        return np.repeat(self.previous, counts) + step, np.repeat(self.prefix, counts) - step


def marked(segments: list[bytes], doc: np.ndarray, sub: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (doc, sub, from, to) of repeated bytes in a chunk of segments that begin at these places of documents."""
    index = RunLengthIndex(segments)
    previous, match = index.statistics()
    n = index.n
    linked = np.flatnonzero(match >= LENGTH)
    lengths = np.array([len(s) + 1 for s in segments])
    own = np.repeat(np.arange(len(segments)), lengths)
    place = begin[own] + np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    _, number = np.unique(np.stack([doc, sub], 1), axis=0, return_inverse=True)
    when = (number.ravel()[own] << 32) | place
    root = np.arange(n)
    root[linked] = previous[linked]
    while True:
        hop = root[root[linked]]
        if (hop == root[linked]).all():
            break
        root[linked] = hop
    first = when.copy()
    np.minimum.at(first, root[linked], when[linked])
    involved = np.zeros(n, bool)
    involved[linked] = True
    involved[root[linked]] = True
    at = np.flatnonzero(involved & (when > first[root]))
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    new = np.concatenate([[True], (np.diff(at) != 1) | (own[at][1:] != own[at][:-1])])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
    return doc[own[at[new]]], sub[own[at[new]]], place[at[new]], place[at[last]] + LENGTH


def indexed(rows: DataFrame, most: int) -> DataFrame:
    """Repeated spans (doc, sub, lo, hi) among the segments of each anchor, by run-length indexes over chunks of whole anchors.

    Anchors with more than ``most`` different segments are crowded: their segments come back as they are (lo, and no hi).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Collapse()
        parts: list[bytes] = []
        places: list[tuple[int, int, int]] = []
        # Segments in the chunk with their bytes, and from where those of the last anchor begin; whether it is crowded.
        size, last, begin, crowded = 0, None, 0, False

        def chunk() -> pa.RecordBatch:
            return spans_batch(*marked(parts, *np.array(places, np.int64).T[:3]))

        for b in batches:
            first, repeat = state.split(b)
            yield spans_batch(*again_spans(b, repeat))
            # Equal strings lie alike around their anchor. Where it has but one different segment they are in places of it,
            # told above, so that the index would find no others. A batch's last anchor may go on in the next.
            key = b.column(0).to_numpy()[first]
            new = np.concatenate([key[:1] != last, key[1:] != key[:-1]])
            first = first[~(new & np.concatenate([new[1:], [False] * len(new[:1])]))]
            keys, offs, texts, *at = (c.to_pylist() for c in b.take(pa.array(first)).columns[:6])
            back: list[tuple] = []
            for key, off, part, *place in zip(keys, offs, texts, *at, strict=True):
                if key != last:
                    if size >= CHUNK:
                        yield chunk()
                        parts, places, size = [], [], 0
                    last, begin, crowded = key, len(parts), False
                if not crowded and len(parts) - begin == most:
                    crowded = True
                    back += [(key, o, x, *y) for x, (*y, o) in zip(parts[begin:], places[begin:], strict=True)]
                    size -= sum(map(len, parts[begin:])) + len(parts) - begin
                    del parts[begin:], places[begin:]
                if crowded:
                    back.append((key, off, part, *place))
                    continue
                parts.append(part)
                places.append((*place, off))
                size += len(part) + 1
            if back:
                yield crowded_batch(back)
        if parts:
            yield chunk()

    return ordered(rows, "key").mapInArrow(run, FOUND)


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, doc and sub (which name a document and order documents) and text of each row of docs."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    slim = docs.select(F.col(doc_id).alias("id"), key.alias("doc"), F.col(text).alias("text"))
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    several = spool(slim.groupBy("doc").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).filter("low != high").select(F.col("doc").alias("__doc")))
    if several.isEmpty():
        return slim.withColumn("sub", F.lit(0).cast("long"))
    both = slim.join(small(several), F.col("doc") == F.col("__doc"), "left")
    return both.withColumn("sub", F.when(F.col("__doc").isNull(), F.lit(0)).otherwise(digest).cast("long")).drop("__doc")


def same_document(left: str, right: str) -> Column:
    return (F.col("doc") == F.col(left)) & (F.col("sub") == F.col(right))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", busy: int = BUSY, most: int = MOST) -> DataFrame:
    """Per row of docs: its id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that are left) and the removed spans."""
    batch_bytes(docs.sparkSession)
    with scratch() as held:
        both, marks = spans_of(named(docs, doc_id, text), busy, most)
        return held.keep(reported(both, marks).withColumnRenamed("id", doc_id))


def spans_of(texts: DataFrame, busy_from: int, most: int) -> tuple[DataFrame, DataFrame]:
    """texts with their bytes if they have anchors of repeated seeds, else with the digest of all; and spans per document."""
    with scratch() as held:
        found = spool(repeated(anchor_rows(texts), busy_from))
        busy = spool(found.filter("kind = 3").select("seed").distinct())
        anchors_ = found.filter("kind = 1").drop("kind")
        any_busy = not busy.isEmpty()
        anchors_ = anchors_.join(small(busy).withColumn("busy", F.lit(True)), "seed", "left") if any_busy else anchors_.withColumn("busy", F.lit(None).cast("boolean"))
        # Per document, at most as many as it has anchors.
        lists = anchors_.groupBy(F.col("doc").alias("d"), F.col("sub").alias("s")).agg(F.collect_list(F.struct("seed", "at", "busy")).alias("places"))
        rows = texts.withColumn("bytes", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).join(lists, same_document("d", "s"), "left")
        free = F.col("places").isNull()
        both = spool(rows.select("id", "doc", "sub", F.length("bytes").cast("long").alias("n_bytes"), F.when(free, F.sha2("bytes", 256)).alias("sha"), F.when(~free, F.col("bytes")).alias("bytes"), "places"))
        held.keep(both)
    with scratch() as held:
        part = lambda busy: segments(both.filter("bytes is not null").withColumn("places", F.filter("places", lambda p: p["busy"].isNotNull() == F.lit(busy))).filter("size(places) > 0"))
        found = spool(indexed(part(False), most))
        spans, left = [spans_in(found)], segments_in(found)
        if any_busy or not left.isEmpty():
            calm, on_the_way = dealt_out(left.unionByName(part(True)) if any_busy else left, most)
            spans += [*on_the_way, spans_in(indexed(calm, 1 << 62))]
        marks = spans[0]
        for x in spans[1:]:
            marks = marks.unionByName(x)
        marks = spool(marks.groupBy(F.col("doc").alias("d"), F.col("sub").alias("s")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
        held.keep(marks)
    return both, marks


def runs_of(spans: pa.ListArray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the maximal runs of each row's spans (lo, hi; in any order) within its n bytes, in order."""
    row = np.repeat(np.arange(len(n)), pa.compute.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False))
    lo, hi = (x.to_numpy().astype(np.int64) for x in spans.flatten().flatten())
    inside = lo < n[row]
    row, lo, hi = row[inside], lo[inside], np.minimum(hi, n[row])[inside]
    # The rows are laid out one behind the other, with a gap; a run begins where no span so far reaches.
    base = np.cumsum(n + 1) - (n + 1)
    order = np.argsort(lo + base[row])
    row, lo = row[order], lo[order]
    reach = np.maximum.accumulate(hi[order] + base[row])
    begins = np.flatnonzero(np.concatenate([[True] * len(lo[:1]), lo[1:] + base[row[1:]] > reach[:-1]]))
    ends = np.concatenate([begins[1:], [len(lo)]])[: len(begins)] - 1
    return row[begins], lo[begins], reach[ends] - base[row[begins]]


def reported(both: DataFrame, marks: DataFrame) -> DataFrame:
    final = both.filter("bytes is not null").join(marks, same_document("d", "s"), "left").select("id", "n_bytes", "bytes", "spans")
    id_type = both.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy()
            row, lo, hi = runs_of(b.column(3), n)
            count = np.bincount(row, minlength=len(n))
            ends = np.concatenate([[0], np.cumsum(count)])
            removed = np.diff(np.concatenate([[0], np.cumsum(hi - lo)])[ends])
            digests, los, his = [], lo.tolist(), hi.tolist()
            for raw, first, end in zip(b.column(2).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                digest, at = hashlib.sha256(), 0
                for k in range(first, end):
                    digest.update(raw[at : los[k]])
                    at = his[k]
                digest.update(raw[at:])
                digests.append(digest.hexdigest())
            spans = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (lo, hi)], ["lo", "hi"]))
            columns = [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digests, pa.string()), spans]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    done = final.mapInArrow(run, f"id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<lo:int,hi:int>>")
    zero = F.lit(0).cast("long")
    rest = both.filter("bytes is null").select("id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.array().cast("array<struct<lo:int,hi:int>>").alias("spans"))
    return done.unionByName(rest)
