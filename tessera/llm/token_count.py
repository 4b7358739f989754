"""Token counts by byte-pair merging with a heap and a linked list.

A text's symbols are its characters, white space written as the vocabulary does; a character that is no piece counts
as its UTF-8 bytes. The adjacent pair whose joined piece has the lowest rank, the leftmost on a tie, is merged again
and again: a heap holds the pairs, a linked list the neighbours. The count is the initial symbols less the merges; no
identifiers are made.

No piece of the vocabulary has a space mark after another character (this is tested when it is loaded, and a
vocabulary with such pieces is merged over whole texts), so a text falls into chunks, each marks and what follows, that
no merge joins. A worker keeps the counts of the chunks it has met, up to ``CACHE_BYTES`` and none longer than
``LONGEST``. A model that normalizes its text is refused.

Null and empty texts count 0. Special strings in a text are ordinary text, as the library's default has it. Texts of
any length are counted whole; a batch of rows is all that a task holds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch_bytes

MARK = "▁"
#: Bytes of chunks that a worker keeps, with so many for each entry itself; characters of the longest.
CACHE_BYTES, ENTRY, LONGEST = 192 << 20, 180, 64
#: Text that normalizers change.
ODD = " a  \u00c5\u212b ｆｉ ﬁe\u0301 B  "


class Merger:
    """Counts with the pieces of a sentencepiece BPE model whose normalizer is the identity."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if sp.normalize(ODD) != MARK + ODD.replace(" ", MARK):
            raise ValueError("the model normalizes its text, which is not counted here")
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in normal}
        self.bytes = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        self.chunked = not any(a != MARK and b == MARK for p in self.rank for a, b in zip(p, p[1:], strict=False))
        self.seen: dict[str, int] = {}
        self.room = CACHE_BYTES

    def symbols(self, chunk: str) -> int:
        """Tokens of the characters by themselves; what is no piece counts as its bytes."""
        return sum(1 if c in self.rank or not self.bytes else len(c.encode()) for c in chunk)

    def merges(self, chunk: str) -> int:
        rank, n = self.rank, len(chunk)
        piece = list(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[chunk[i : i + 2]], i, chunk[i : i + 2]) for i in range(n - 1) if chunk[i : i + 2] in rank]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not piece[i] or j >= n or piece[i] + piece[j] != joined:
                continue  # one of the two was merged meanwhile
            done += 1
            piece[i], piece[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := joined + piece[k]) in rank:
                    heapq.heappush(heap, (rank[pair], i, pair))
            if (h := before[i]) >= 0 and (pair := piece[h] + joined) in rank:
                heapq.heappush(heap, (rank[pair], h, pair))
        return done

    def of_chunk(self, chunk: str) -> int:
        n = self.symbols(chunk) - self.merges(chunk)
        if len(chunk) <= LONGEST:
            self.room -= 2 * len(chunk) + ENTRY
            if self.room < 0:
                self.seen.clear()
                self.room = CACHE_BYTES
            self.seen[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.chunked:
            return self.of_chunk(marked)
        # Marks in a row are one chunk with what follows them.
        parts = marked.split(MARK)[1:]
        seen, total, run = self.seen, 0, 1
        for p in parts[:-1]:
            if p:
                chunk = MARK * run + p
                total += seen.get(chunk) or self.of_chunk(chunk)
                run = 1
            else:
                run += 1
        chunk = MARK * run + parts[-1]
        return total + (seen.get(chunk) or self.of_chunk(chunk))


@cache
def merger(model_file: str) -> Merger:
    return Merger(model_file)


def token_counts(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Per row of docs: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    batch_bytes(docs.sparkSession)
    kind = docs.schema[doc_id].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model_file)
        for b in batches:
            n = pa.array([m.count(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    out = slim.mapInArrow(count, f"id {kind.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
