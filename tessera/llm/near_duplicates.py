"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

A document is the weighted set of its shingles of five words; a shingle that occurs n times weighs 1 + ln n. In a
signature of ``ROWS * BANDS`` components each shingle is a Poisson process of arrivals at a rate of its weight, each
arrival at a random component; a component keeps the shingle that arrives first, and a shingle ends when its next
arrival is later than all components' first ones. Two components agree with the probability Jaccard similarity of
their documents (for equal weights, the Jaccard similarity). Documents that agree in all rows of a band are
candidates; at a similarity of 0.8 a pair escapes all bands with probability 7e-6.

Equal texts are joined first, by digest, and only one of them goes on, so copies make no pairs. Within a band's bucket
no pairs are enumerated: all members are compared with its hub, the member that shares most with others, which makes at
most as many pairs as there are members.

*Closing.* What is left to find in a bucket are pairs x, y of different classes. Either they share a shingle that the
hub lacks, or their common shingles are the hub's: at most k of them, k being the lesser number that one of the two has
in common with the hub, of a weight of at most k + e, e the surplus of the group's weights over 1. Similarity then asks
for w(x) + w(y) <= 2.25 (k + e), which members that are not similar to the hub can hardly meet with others of usual
length. So members meet by shared shingles outside the hub, and by hub where their weights allow for a pair; such groups
are dealt in blocks, every two blocks meet in one place, and a bound on the similarity, computed for one text against a
block at once, leaves the pairs to verify. The links are those of all candidates, whatever the size of a bucket.

Each pair's similarity is computed exactly from the texts, and pairs of at least 0.8 link; classes are the connected
components.

A text of one to four words is one shingle. Texts without words, and null, have no shingles: each stays alone. Texts
go by their digest, so ids may be null or repeated; rows with the same id count as rows. A null id is the class_id of
classes only in which all ids are null. An empty table gives no rows. Texts are read whole; a row's memory is that of
its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, batch_bytes, free_name, scratch, small, spool

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 30
#: Two similar texts have shares u, v of their weights in common with 1 / u + 1 / v at most this.
SHARES = 1 + 1 / SIMILARITY
#: A block of an open bucket: members, and bytes of their hashes and weights.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: Ids, eight bytes each, may be broadcast up to this count.
BROADCAST_IDS = 1_000_000
SPLIT = re.compile(WORD)
M = ROWS * BANDS


class WordHashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h


HASHES = WordHashes()


def mixed(x: np.ndarray, step: int = 0) -> np.ndarray:
    """The finalizer of splitmix64, over 64-bit words."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the text's shingles, and their weights."""
    words = SPLIT.findall(text or "")
    if not words:
        return np.empty(0, np.uint64), np.empty(0)
    ids = np.fromiter(map(HASHES.__getitem__, words), np.int64, len(words)).view(np.uint64)
    n = max(1, len(ids) - SHINGLE + 1)
    h = np.full(n, min(len(ids), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(ids))):
        h = mixed(h ^ ids[k : n + k])
    h, counts = np.unique(h, return_counts=True)
    return h, 1 + np.log(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per weighted set (none empty) the shingle of each of M components."""
    h = np.concatenate([a for a, _ in sets])
    w = np.concatenate([b for _, b in sets])
    doc = np.repeat(np.arange(len(sets)), [len(a) for a, _ in sets])
    first = np.full(len(sets) * M, np.inf)
    who = np.zeros(len(sets) * M, np.uint64)
    time = np.zeros(len(h))
    step = 0
    while len(h):
        r = mixed(h, step)
        step += 1
        # The high 40 bits give the time to the next arrival, the low ones the component.
        time = time - np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) / (1 << 40)) / w
        at = doc * M + ((r & np.uint64(0xFFFFFF)) % np.uint64(M)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = h[won]
        if step < 10 or step % 10 == 0:
            still = np.unique(doc)
            last = np.full(len(sets), np.inf)
            last[still] = first.reshape(len(sets), M)[still].max(axis=1)
            go = time < last[doc]
            h, w, doc, time = h[go], w[go], doc[go], time[go]
    return who.reshape(len(sets), M)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    (ha, wa), (hb, wb) = a, b
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # Where y_j / x_j is below i's ratio, x_j / x_i is the larger of the two.
    below = only_x + np.concatenate([[0.0], np.cumsum(x)[:-1]])
    above = only_y + np.cumsum(y[::-1])[::-1]
    return float((1 / (below / x + above / y)).sum())


def banded(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row with words: id, digest of the text, and a hash per band."""
    batch_bytes(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py()) for x in b.column(1)]
            full = [i for i, s in enumerate(sets) if len(s[0])]
            if not full:
                continue
            who = np.concatenate([signatures([sets[i] for i in full[k : k + 500]]) for k in range(0, len(full), 500)]).reshape(len(full), BANDS, ROWS)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS))
            for k in range(ROWS):
                h = mixed(h ^ who[:, :, k], k)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(full) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(h.ravel().view(np.int64)))
            rows = pa.array(full)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), bands], ["id", "digest", "bands"])

    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.unhex(F.md5(F.col(text))).alias("digest"))
    return slim.mapInArrow(run, f"id {kind}, digest binary, bands array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough; sets has id, hashes and weights."""
    other = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"))
    full = pairs.join(other, "b").join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa")), "a")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (ha, wa, hb, wb) in enumerate(zip(*[b.column(k) for k in range(2, 6)], strict=True)):
                one = np.frombuffer(ha.as_buffer(), np.uint64), np.frombuffer(wa.as_buffer(), np.float32).astype(float)
                two = np.frombuffer(hb.as_buffer(), np.uint64), np.frombuffer(wb.as_buffer(), np.float32).astype(float)
                if probability_jaccard(one, two) >= SIMILARITY - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in b.columns[:2]], ["a", "b"])

    return full.select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(run, f"a {kind}, b {kind}")


def digest_of(text: str) -> Column:
    return F.unhex(F.md5(F.col(text)))


def weighted_sets(docs: DataFrame, digests: DataFrame, text: str) -> DataFrame:
    """id (the digest), hashes and weights of the texts named in digests (id, distinct), once for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h, _ in sets], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in sets], pa.binary())], ["id", "hashes", "weights"])

    rows = docs.select(digest_of(text).alias("id"), F.col(text).alias("text")).join(small(digests, BROADCAST_IDS), "id", "left_semi")
    return rows.mapInArrow(run, "id binary, hashes binary, weights binary").dropDuplicates(["id"])


def components(edges: DataFrame) -> DataFrame:
    """id and label, the least id it is connected with. edges (a, b) is a spooled table."""
    both = spool(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = spool(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "b", "label": "near"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("hop"))
        new = labels.join(near, "id").join(hop, "label", "left")
        new = spool(new.select("id", F.least("label", "near", "hop").alias("new"), "label"))
        labels, changed = new.select("id", F.col("new").alias("label")), not new.filter("new != label").isEmpty()
        if not changed:
            return labels


def linking(label: list, side: list[int], sets: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Pairs of different labels that are similar enough, without those that the pairs before have joined.

    side is 0 or 1; where both occur, only pairs of two sides are compared.
    """
    _, label = np.unique(np.array(label, object), return_inverse=True)
    usual = np.bincount(label).argmax()
    order = np.lexsort((label == usual, side))
    label, sets = label[order], [sets[k] for k in order]
    n, cut = len(sets), side.count(0)
    starts = np.concatenate([[0], np.cumsum([len(h) for h, _ in sets])])
    words, at = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    weights = np.concatenate([w for _, w in sets])
    mass = np.add.reduceat(weights, starts[:-1])
    mark = np.zeros(len(words))
    for x in range(cut if 0 < cut < n else n - 1):
        low = cut if 0 < cut < n else x + 1
        if (label[low:] == label[x]).all():
            continue
        own = at[starts[x] : starts[x + 1]]
        mark[own] = weights[starts[x] : starts[x + 1]]
        met = mark[at[starts[low] :]]
        mark[own] = 0
        ends = starts[low:-1] - starts[low]
        with np.errstate(divide="ignore"):
            # With the shares u and v of two texts' weights on common shingles, the similarity is at most 1 / (1/u + 1/v - 1).
            inverse = mass[x] / np.add.reduceat(met, ends) + mass[low:] / np.add.reduceat(weights[starts[low] :] * (met > 0), ends)
        for y in low + np.flatnonzero((label[low:] != label[x]) & (inverse <= 1 + 1 / SIMILARITY + 1e-6)):
            if label[x] != label[y] and probability_jaccard(sets[x], sets[y]) >= SIMILARITY - 1e-9:
                label[label == label[y]] = label[x]
                yield int(order[x]), int(order[y])


def profiles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (hub, id, label) with weight w, k shingles in common with the hub, rest (those it lacks), and heavy: common ones of a weight over 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, w, other in zip(*b.columns[3:], strict=True):
                h, w = np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.float32).astype(float)
                other = np.frombuffer(other.as_buffer(), np.uint64)
                common = other[np.minimum(np.searchsorted(other, h), len(other) - 1)] == h
                heavy = common & (w > 1)
                rows.append((float(w.sum()), int(common.sum()), h[~common].view(np.int64).tolist(), [{"h": x, "w": y} for x, y in zip(h[heavy].view(np.int64).tolist(), w[heavy].tolist(), strict=True)]))
            kinds = [pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("h", pa.int64()), ("w", pa.float64())]))]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], ["hub", "id", "label", "w", "k", "rest", "heavy"])

    full = members.join(sets, "id").join(sets.select(F.col("id").alias("hub"), F.col("hashes").alias("other")), "hub")
    return full.select("hub", "id", "label", "hashes", "weights", "other").mapInArrow(run, "hub binary, id binary, label binary, w double, k bigint, rest array<bigint>, heavy array<struct<h:bigint,w:double>>")


def meetings(profile: DataFrame) -> DataFrame:
    """bucket, id, label: groups in which all pairs of different labels meet that can be similar."""
    rest = profile.select("hub", "id", "label", F.explode("rest").alias("h"))
    shared = rest.groupBy("hub", "h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")).filter("low != high")
    # Shingles that the same members share are one group.
    shared = shared.groupBy("hub", "n", "x", "y").agg(F.min("h").alias("h")).select("hub", "h")
    outside = rest.join(shared, ["hub", "h"]).select(F.xxhash64("hub", "h").alias("bucket"), "id", "label")
    surplus = profile.select("hub", F.explode("heavy").alias("x")).groupBy("hub", "x.h").agg(F.max("x.w").alias("most")).groupBy(F.col("hub").alias("__hub")).agg(F.sum(F.col("most") - 1).alias("e"))
    own = profile.filter("id = hub").select(F.col("hub").alias("__own"), F.col("label").alias("of")).distinct()
    near = profile.drop("rest", "heavy").join(surplus, F.col("hub") == F.col("__hub"), "left").join(own, F.col("hub") == F.col("__own"))
    near = near.withColumn("reach", SHARES * (F.col("k") + F.coalesce("e", F.lit(0.0))) - F.col("w") + 1e-3).withColumn("apart", F.col("label") != F.col("of")).select("hub", "id", "label", "w", "reach", "apart")
    ends = near.groupBy(F.col("hub").alias("__hub")).agg(F.min("w").alias("least"), F.max(F.when(F.col("apart"), F.col("reach"))).alias("most"))
    near = near.join(ends, F.col("hub") == F.col("__hub")).drop("__hub")
    pair = F.when(F.col("apart"), F.col("reach") >= F.col("least")).otherwise(F.col("w") <= F.col("most"))
    return outside.unionByName(near.filter(pair).select(F.xxhash64("hub").alias("bucket"), "id", "label"))


def finished(now: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that make one class of all that belongs together in the buckets of more than one label.

    now has id, bucket and label.
    """
    kind = now.schema["id"].dataType.simpleString()
    open_ = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    rows = spool(now.join(open_.select("bucket"), "bucket").join(sets.select("id", (F.length("hashes") + F.length("weights")).alias("bytes")), "id"))
    shape = rows.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = rows.join(shape, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side")
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side, "id", "label")
    key = ["bucket", "i", "j"]
    rows = rows.join(sets, "id").select(*key, "side", "id", "label", "hashes", "weights").repartition(*key).sortWithinPartitions(*key)

    def links(held: list[tuple]) -> Iterator[tuple]:
        if len(held) > 1:
            texts = [(np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32).astype(float)) for _, _, _, h, w in held]
            for x, y in linking([r[2] for r in held], [r[0] for r in held], texts):
                yield held[x][1], held[y][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for b in batches:
            out = []
            for *at, side, i, label, h, w in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at != place:
                    out += links(held)
                    place, held = at, []
                held.append((side, i, label, h, w))
            yield made(out, b.column(4).type)
        if held:
            yield made(list(links(held)), b.column(4).type)

    def made(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with the label of each id's class: its own id where it has none."""
    if labels is None:
        return members.withColumn("label", F.col("id"))
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def text_classes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Per row of docs with words its id and digest; and per digest the label of its class."""
    with scratch() as held:
        rows = spool(banded(docs, doc_id, text))
        out = rows.select("id", "digest"), classed(docs, rows, text)
        held.keep(*out)
    return out


def classed(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Per digest the label of its class."""
    texts = spool(rows.groupBy(F.col("digest").alias("id")).agg(F.min("bands").alias("bands")))
    members = texts.select("id", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = spool(members.join(shared, "bucket"))
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    members = spool(members.drop("n").join(weight, "id"))
    sets = spool(weighted_sets(docs, spool(members.select("id").distinct()), text))
    best = F.max_by("id", F.struct("weight", "id")).alias("hub")
    hubs = spool(members.groupBy("bucket").agg(best))
    pairs = members.join(hubs, "bucket").filter("id != hub")
    edges = spool(similar(spool(pairs.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()), sets))
    labels = None if edges.isEmpty() else components(edges)
    now = labelled(members, labels).select("id", "bucket", "label")
    # Buckets of two members were settled by their hub.
    left = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low != high and n > 2")
    groups = spool(now.join(left.select("bucket"), "bucket").join(hubs, "bucket").select("hub", "id", "label").distinct())
    if not groups.isEmpty():
        found = spool(finished(spool(meetings(spool(profiles(groups, sets)))), sets))
        if not found.isEmpty():
            labels = components(edges.union(found))
    return spool(labelled(texts.select("id"), labels).withColumnRenamed("id", "digest"))


def wordless(docs: DataFrame, text: str) -> DataFrame:
    return docs.filter(~F.coalesce(F.col(text).rlike(WORD), F.lit(False)))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its id and class_id, the least id of its class."""
    rows, labels = text_classes(docs, doc_id, text)
    least = rows.groupBy("digest").agg(F.min("id").alias("id")).join(labels, "digest")
    least = least.join(least.groupBy("label").agg(F.min("id").alias("class_id")), "label").select("digest", "class_id")
    known = rows.join(least, "digest").select(F.col("id").alias(doc_id), "class_id")
    return known.unionByName(wordless(docs, text).select(doc_id, F.col(doc_id).alias("class_id")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, one row of each class: that of the least id, nulls last (of equal ids, one row of the least digest).

    Of rows without words those of equal ids and texts are one; where the id is null each stays.
    """
    with scratch() as held:
        first = held.keep(first_of_each(docs, doc_id, text))
    # One column names text and id, so that copies are spread and one shuffle serves both steps.
    own = free_name(docs, "digest")
    kept = docs.withColumn(own, row_name(digest_of(text), F.col(doc_id))).join(first, F.col(own) == F.col("__name"), "left_semi")
    alone = wordless(docs, text)
    return kept.dropDuplicates([own]).drop(own).unionByName(alone.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, text])).unionByName(alone.filter(F.col(doc_id).isNull()))


def first_of_each(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of each class a row of the least id, nulls last, and the least digest with it: its __name."""
    rows, labels = text_classes(docs, doc_id, text)
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    first = rows.groupBy("digest").agg(F.min(order).alias("o")).join(labels, "digest").groupBy("label").agg(F.min(F.struct("o", "digest")).alias("first"))
    return spool(first.select(row_name(F.col("first.digest"), F.col("first.o.id")).alias("__name")))


def row_name(digest: Column, doc_id: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.hex(digest), F.coalesce(F.concat(F.lit("|"), doc_id.cast("string")), F.lit("")))))
