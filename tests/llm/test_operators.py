"""Each operator against a plain version of itself, and over awkward rows."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cases import LONG, documents, empty, prose
from tessera.llm import common, interleaved, main_text, mixing, near_duplicates, packing, pseudonyms, quality, queries, repeats, token_count, url_filter

WORDS = queries.vocabulary("word_bpe_49k.json")
PIECES = queries.vocabulary("piece_bpe_32k.model")


# Repeated passages.


def repeats_by_hand(docs):
    first, out = {}, {}
    for d, t in sorted(docs):
        for i in range(len(t) - 99):
            first.setdefault(t[i : i + 100], (d, i))
    for d, t in docs:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            if first[t[i : i + 100]] < (d, i):
                gone[i : i + 100] = True
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out[d] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


def patchwork(r, n):
    base = [bytes(r.choices(b"abcdefgh ", k=r.randint(50, 400))) for _ in range(6)]
    out = []
    for d in range(n):
        t = b""
        for _ in range(r.randint(0, 5)):
            x, b = r.random(), r.choice(base)
            i = r.randint(0, len(b) - 1)
            t += b[i : i + r.randint(60, 300)] if x < 0.5 else bytes(r.choices(b"abcdefgh ", k=r.randint(1, 200))) if x < 0.8 else b"a" * r.randint(50, 250) if x < 0.9 else b
        out.append((d, t))
    return out


@pytest.mark.parametrize(("busy", "most", "rows"), [(10_000, 5_000, 2000), (10_000, 3, 2000), (3, 3, 2000), (1, 1, 3), (20, 2, 3)])
def test_repeats(spark, monkeypatch, busy, most, rows):
    monkeypatch.setattr(repeats, "batch_bytes", lambda s: common.batch_bytes(s, rows))
    docs = patchwork(random.Random(busy + most), 100)
    df = spark.createDataFrame([(d, t.decode()) for d, t in docs], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeats(df, busy=busy, most=most).collect()}
    assert got == repeats_by_hand(docs)


def test_repeats_of_a_crowded_line(spark):
    """A line that all documents share between words of their own, and some of them more around it."""
    r = random.Random(3)
    line = bytes(r.choices(b"abcdefgh ", k=70))
    sides = [bytes(r.choices(b"xyz ", k=40)) for _ in range(4)]
    docs = [(d, bytes(r.choices(b"klmnop ", k=r.randint(0, 60))) + r.choice([b"", *sides]) + line + r.choice([b"", *sides]) + bytes(r.choices(b"klmnop ", k=r.randint(0, 60)))) for d in range(150)]
    df = spark.createDataFrame([(d, t.decode()) for d, t in docs], "doc_id long, text string").repartition(3)
    for busy, most in ((1_000, 10), (10, 2)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeats(df, busy=busy, most=most).collect()}
        assert got == repeats_by_hand(docs)


def test_repeats_of_odd_rows(spark):
    """Nulls in ids and texts, equal ids with other texts, repeated rows, clashing columns."""
    r = random.Random(4)
    one, two = (bytes(r.choices(b"abcdef ", k=300)).decode() for _ in range(2))
    rows = [(None, one), (None, two), (4, one[50:] + two[:120]), (4, two), (4, two), (7, None), (8, ""), (9, "short"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "doc", "sub", "bytes", "n", "d", "key"):
        df = df.withColumn(c, F.lit("mine"))
    # The documents in their order: by id, then by digest of the text, null ids last.
    digest = {x.t: x.h for x in spark.createDataFrame([(t,) for _, t in rows if t], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    names = sorted({(i is None, i or 0, digest.get(t, 0), t) for i, t in rows if t})
    want = repeats_by_hand([(k, t.encode()) for k, (*_, t) in enumerate(names)])
    by_row = collections.Counter((None if none else i, *want[k]) for k, (none, i, _, t) in enumerate(names) for _ in range(rows.count((None if none else i, t))))
    by_row.update([(7, 0, 0, 0, hashlib.sha256(b"").hexdigest()), (8, 0, 0, 0, hashlib.sha256(b"").hexdigest()), (None, 0, 0, 0, hashlib.sha256(b"").hexdigest())])
    got = collections.Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.repeats(df).collect())
    assert got == by_row
    assert repeats.repeats(df.limit(0)).count() == 0


def test_marks_come_from_the_index(spark, monkeypatch):
    """Without the index stage nothing is removed."""
    monkeypatch.setattr(repeats, "indexed", lambda rows, most: rows.sparkSession.createDataFrame([], repeats.FOUND))
    df = spark.createDataFrame([(d, t.decode()) for d, t in patchwork(random.Random(5), 60)], "doc_id long, text string")
    assert repeats.repeats(df).agg(F.sum("n_removed")).first()[0] == 0


def test_repeats_in_a_long_text_of_several_blocks(spark, monkeypatch):
    r = random.Random(2)
    part = bytes(r.choices(b"abcdefghijkl ", k=3000))
    long = bytes(r.choices(b"abcdefghijkl ", k=repeats.BLOCK - 1500)) + part + bytes(r.choices(b"abc ", k=900)) + part[500:]
    df = spark.createDataFrame([(5, long.decode()), (3, part[:700].decode())], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.repeats(df).collect()}
    at = repeats.BLOCK - 1500
    assert [tuple(s) for s in got[5].spans] == [(at, at + 700), (at + 3900, at + 3900 + 2500)]
    assert got[3].n_removed == 0


def test_index_is_the_suffix_order():
    r = random.Random(1)
    segments = [bytes(r.choices(b"ab", k=r.randint(1, 60))) for _ in range(20)] + [b"abab" * 10] * 2
    previous, match = repeats.RunLengthIndex(segments).statistics()
    text = [x for j, s in enumerate(segments) for x in [*((1, c) for c in s), (0, j)]]
    order = sorted(range(len(text)), key=lambda i: text[i:])
    for a, i in zip(order, order[1:], strict=False):
        n = 0
        while max(a, i) + n < len(text) and text[a + n] == text[i + n]:
            n += 1
        assert (previous[i], match[i]) == (a, n)


def test_index_holds_no_anchor_with_one_segment(spark, monkeypatch, tmp_path):
    """Exact copies are settled by their bytes; only anchors with several different segments are sorted."""
    r = random.Random(6)
    one, two = (bytes(r.choices(b"abcdefgh ", k=2000)) for _ in range(2))
    docs = [(0, one), (1, one), (2, one), (3, two), (4, two[:1000] + b"x" + two[1000:])]
    rows = [(key, 56, part, 0, 0, 200 * k, []) for k, (key, part) in enumerate([(1, one[:156]), (2, one[200:356]), (2, b"y" + one[201:356]), (3, one[400:556])] + [(9, two[k : k + 156]) for k in (0, 1)])]
    (tmp_path / "sizes").mkdir()

    def counted(segments, *places, whole=repeats.marked):
        (tmp_path / "sizes" / str(len(segments))).write_text("")
        return whole(segments, *places)

    monkeypatch.setattr(repeats, "marked", counted)
    # In batches of any size; the last anchor of a batch may be kept.
    for size in (1, 2, 3, 100):
        found = spark.createDataFrame(rows, repeats.SEGMENT).coalesce(1)
        monkeypatch.setattr(repeats, "ordered", lambda df, *by: df.coalesce(1).sortWithinPartitions("key", "off", "bytes"))
        common.batch_bytes(spark, size)
        spans = {(x.lo, x.hi) for x in repeats.indexed(found, 1000).collect()}
        assert {(401, 556), (1000, 1155)} == spans
    assert "4" in {p.name for p in (tmp_path / "sizes").iterdir()}
    monkeypatch.undo()
    common.batch_bytes(spark)
    df = spark.createDataFrame([(d, t.decode()) for d, t in docs], "doc_id long, text string")
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.repeats(df).collect()} == repeats_by_hand(docs)


# URL filter.


def test_url_filter(spark):
    urls = ["http://a.com/en/x", "HTTP://EXAMPLE.COM/en/7", "https://www.example.com/en/77?q=/de/", "https://notexample.com/en/7", "x://net/de/1#f", "//com/en/", None, "", "http://com", "http://org/es/", "http://b.org/ES/", "ftp://m.example.net/de/8"]
    want = ["block", "allow", "allow", "block", "block", "allow", "allow", "allow", "allow", "block", "allow", "allow"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("verdict", F.lit("mine")).withColumn("best", F.lit(1))
    got = url_filter.url_filter(df).orderBy("page_id").collect()
    assert [r.verdict for r in got] == want
    assert got[6].host == got[6].path == got[5].host == ""
    assert got[2].rule == "example.com/en/7"
    assert got[3].rule == "com/en/"
    assert url_filter.url_filter(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(df, rules=()).collect()} == {"allow"}


def test_url_filter_by_the_rules_of_its_contract(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: v for v, h, p in url_filter.RULES} == rules
    df = spark.createDataFrame([(f"http://www.{rule}x",) for rule in rules] + [("http://example.net/de/7",), ("http://net/fr/",)], "url string")
    got = {(r.rule, r.verdict) for r in url_filter.url_filter(df, otherwise="none").collect()}
    assert got == {*rules.items(), (None, "none")}


def test_url_filter_with_many_rules(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "CHUNK", 3)
    r = random.Random(21)
    hosts = [f"{a}.{b}" for a in ("news", "shop", "my", "a1", "b2") for b in ("com", "org", "net", "example.com")] + ["com", "org", "net"]
    rules = {(r.choice(hosts), "/" + "".join(r.choices("abc/", k=r.randint(0, 4)))): r.choice(["allow", "block"]) for _ in range(1500)}
    rules = [(v, h, p) for (h, p), v in rules.items()]
    urls = [f"http://{r.choice(['', 'www.', 'x.y.'])}{r.choice(hosts)}/{''.join(r.choices('abc/', k=r.randint(0, 7)))}" for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.url_filter(df, rules=rules).collect()}
    for i, u in enumerate(urls):
        host, _, path = u.removeprefix("http://").partition("/")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and f"/{path}".startswith(p)]
        assert got[i] == (max(fits)[1:] if fits else (None, "allow"))


def test_cascade_is_exact_when_filters_are_small(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key")).cache()
    listed = universe.filter(F.xxhash64("key") % 10 == 0)
    levels = url_filter.cascade(universe, listed, "key")
    assert len(levels) >= 3
    assert sum(x.bits for x in levels) < 300 * 10
    got = {r.key for r in universe.filter(url_filter.member(levels, F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()}


# Mixing.


def targets_by_hand(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (mixing.WEIGHTS[i % 3] for i in range(len(order))), strict=True))
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        per = (total - cap * sum(sizes[s] for s in full)) / max(1, sum(weight[s] for s in free))
        above = {s for s in free if weight[s] * per >= cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in full else weight[s] * per for s in order}
        full |= above


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(1.2) * 10)), r.choice(["a"] * 9 + ["b", "c", "d", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = targets_by_hand(sizes), collections.Counter()
    source = {i: s for i, _, s in rows}
    for x in got:
        assert x.size == len(rows[x.doc_id][1].split())
        assert x.target == pytest.approx(want[source[x.doc_id]])
        assert x.taken in (0, x.size, 2 * x.size, 3 * x.size)
        taken[source[x.doc_id]] += x.taken
    for s, t in want.items():
        longest = max(len(t.split()) for _, t, x in rows if x == s)
        assert abs(taken[s] - t) <= longest / 2
    assert sorted(got) == sorted(mixing.mix(df.repartition(7)).collect())
    assert mixing.mix(empty(spark)).count() == 0


def copies_by_hand(rows, cap=3, lean=0.25):
    """rows (id, text, source): copies of each, by the whole method over sorted lists."""

    def number(i, t):
        digest = xxhash.xxh64_intdigest((t or "").encode(), 42) if t is not None else 42
        text = f"mix|{'null' if i is None else i}|{digest - (1 << 64) if digest >> 63 else digest}"
        return (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)

    docs = [(k, len(re.findall(r"[^ \t-\r]+", t or "")), number(i, t), s) for k, (i, t, s) in enumerate(rows)]
    sizes = {s: sum(d[1] for d in docs if d[3] == s) for s in {d[3] for d in docs}}
    out = [0] * len(rows)
    for s, target in targets_by_hand(sizes, cap).items():
        own = [d for d in docs if d[3] == s]
        whole = min(cap, int(target / sizes[s] + 1e-12)) if sizes[s] else 0
        left, mean = max(0.0, target - whole * sizes[s]), sizes[s] / len(own)
        w = lambda n: (mean / 2 ** ((math.floor(math.log2(n) * mixing.CLASSES) + 0.5) / mixing.CLASSES)) ** lean
        p = lambda c, n: c * w(n) / (1 + c * w(n))
        low, high = -60.0, 60.0
        for _ in range(mixing.STEPS):
            half = (low + high) / 2
            low, high = (low, half) if sum(d[1] * p(2**half, d[1]) for d in own if d[1]) > left else (half, high)
        sampled = round(sum(p(2**low, d[1]) for d in own if d[1])) if left > 0 else 0
        rank = {d[0]: d[2] / (1 - d[2]) / w(max(1, d[1])) if sizes[s] else 0 for d in own}
        n = dict.fromkeys(rank, 0)
        for k in range(1 + mixing.FILLS + mixing.REFILLS):
            may = [d for d in own if 0 < d[1] <= left and (n[d[0]] == 0 if k <= mixing.FILLS else whole + n[d[0]] < cap)]
            words = count = 0
            for _, peers in itertools.groupby(sorted(may, key=lambda d: rank[d[0]]), key=lambda d: rank[d[0]]):
                peers = list(peers)
                if words + sum(d[1] for d in peers) > left or (not k and count + len(peers) > sampled):
                    break
                words, count = words + sum(d[1] for d in peers), count + len(peers)
                for d in peers:
                    n[d[0]] += 1
            left -= words
        for d in own:
            out[d[0]] = whole + n[d[0]]
    return out


@pytest.mark.parametrize("per_slice", [1, 10_000])
def test_mixing_by_hand(spark, monkeypatch, per_slice):
    """The whole selection, with null ids and texts, repeated rows and clashing columns, in any order of rows."""
    monkeypatch.setattr(mixing, "PER_SLICE", per_slice)
    r = random.Random(31)
    rows = [(None if k % 37 == 0 else k % 350, None if k % 29 == 0 else "w " * int(r.paretovariate(1.1) * 4) + str(k % 300), r.choice(["a"] * 6 + ["b", "c", None, "d"])) for k in range(400)]
    rows += rows[:5] + [(900, "", "e"), (901, None, "e")]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "row_ int, doc_id long, text string, source string")
    for c in ("row", "size", "u", "rank", "whole", "passes", "Copies"):
        df = df.withColumn(c, F.lit("mine"))
    want = copies_by_hand(rows)
    taken = mixing.mixed(df.repartition(5))
    got = collections.Counter(x.row_ for x in taken.collect())
    assert [got[k] for k in range(len(rows))] == want
    assert taken.columns == df.columns
    by_id = sorted(((x.doc_id, x.size, x.copies) for x in mixing.mix(df.orderBy(F.rand(1))).collect()), key=str)
    assert by_id == sorted(((i, len((t or "").split()), n) for (i, t, _), n in zip(rows, want, strict=True)), key=str)


def test_mixing_prefers_high_inclusion_odds(spark):
    df = spark.createDataFrame([(i, "w " * (5 if i % 2 else 500), s) for i in range(2000) for s in ["a"]] + [(9999, "w " * 300_000, "b")], "doc_id long, text string, source string")
    got = mixing.mix(df, share=0.5, cap=1, weights=(1, 9)).filter("doc_id < 9999").collect()
    share = lambda odd: np.mean([x.copies for x in got if x.doc_id % 2 == odd])
    assert share(1) > share(0)


# Packing.


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    df = documents(spark)
    got = packing.pieces(df, WORDS).collect()
    tk = Tokenizer.from_file(WORDS)
    rows = df.select("doc_id", "text").distinct().collect()
    for row in rows:
        ids = [*tk.encode(row.text or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in got if p.doc_id == row.doc_id), key=lambda p: (p.start, p.sequence_id))
        n = 2 if row.doc_id == 11 else 1  # a repeated row
        assert sum(p.length for p in own) == n * len(ids)
        for p in own:
            part = ids[p.start : p.start + p.length]
            assert list(np.frombuffer(p.ids, "<u2")) == part
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert p.doc_tokens == len(ids)
    filled = collections.defaultdict(list)
    for p in got:
        filled[p.sequence_id].append((p.offset, p.length))
    for s, spans in filled.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == 2048 or s == max(filled)
    assert packing.pieces(empty(spark), WORDS).count() == 0


def test_curve_is_one_walk_through_the_grid(monkeypatch):
    monkeypatch.setattr(packing, "BITS", 3)
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    walk = cells[np.argsort(packing.hilbert(cells))]
    assert sorted(packing.hilbert(cells)) == list(range(512))
    assert set(np.abs(np.diff(walk, axis=0)).sum(axis=1)) == {1}


def test_words_are_the_library_s_ids():
    from tokenizers import Tokenizer

    tk, w, r = Tokenizer.from_file(WORDS), packing.Words(WORDS), random.Random(2)
    signs = [*"ab  \n\t'séÉΣσΑ１9\x1c\x85İß!?", "<|endoftext|>", "<|startoftext|>", "'ll", " ́"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 14))) for _ in range(3000)]
    assert [list(np.frombuffer(x, "<u2")) for x in w.ids(texts)] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_need_no_call_each(monkeypatch):
    """Words that no worker has met are merged together, and each once for a batch, not by a call of the library each."""
    import tokenizers

    calls = collections.Counter()

    def counted(f):
        def call(*a, **b):
            calls[f.__name__] += 1
            return f(*a, **b)

        return call

    class Counted:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            got = getattr(self.real, name)
            return Counted(got) if name == "model" else counted(got) if name in ("tokenize", "encode_batch_fast") else got

    class Opened:
        from_file = staticmethod(lambda file, real=tokenizers.Tokenizer: Counted(real.from_file(file)))

    real, r = tokenizers.Tokenizer.from_file(WORDS), random.Random(5)
    monkeypatch.setattr(tokenizers, "Tokenizer", Opened)
    texts = [" ".join("".join(r.choices("abdefgilmnorstéü", k=r.randint(1, 12))).capitalize() + r.choice(["", ",", "!?"]) for _ in range(200)) for _ in range(20)]
    got = packing.Words(WORDS).ids(texts)
    assert [list(np.frombuffer(x, "<u2")) for x in got] == [real.encode(t, add_special_tokens=False).ids for t in texts]
    assert calls.total() < 10


def test_merges_of_all_lengths():
    from tokenizers import Tokenizer

    tk, w, r = Tokenizer.from_file(WORDS), packing.Words(WORDS), random.Random(6)
    texts = [" ".join("".join(r.choices(signs, k=k)) for signs in ("ab", "etaoinshr", "éèß", "'sretvmld", "!#'", "a1é'!\x00\x1c")) for k in range(90)] * 2
    assert [list(np.frombuffer(x, "<u2")) for x in w.ids(texts)] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("normalizer", [None, {"type": "Sequence", "normalizers": [{"type": "NFC"}]}])
def test_other_rules_go_to_the_library(tmp_path, normalizer):
    """A vocabulary that does not lower letters."""
    from tokenizers import Tokenizer

    file = tmp_path / "other.json"
    with open(WORDS, encoding="utf-8") as f:
        file.write_text(json.dumps(json.load(f) | {"normalizer": normalizer}), encoding="utf-8")
    tk, w = Tokenizer.from_file(str(file)), packing.Words(str(file))
    texts = ["River", "RIVERS,don't  and", "river\n12 É"]
    assert [list(np.frombuffer(x, "<u2")) for x in w.ids(texts)] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_cells_are_those_of_each_document():
    r = np.random.default_rng(7)
    table = packing.directions(500)
    docs = [r.integers(0, 500, n).astype("<u2") for n in (1, 3, 2000, 1, 700)]
    at = [table[np.unique(d)].sum(axis=0) / math.sqrt(len(np.unique(d))) for d in docs]
    want = [[min(1023, int((1 + math.erf(x / math.sqrt(2))) / 2 * 1024)) for x in v] for v in at]
    assert packing.cells(np.concatenate(docs), np.cumsum([0, *map(len, docs)]), table).tolist() == want


# Main text.

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site name</h1></header>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, as all do, for long reasons.</p></div><article><h1>A&eacute; title</h1>
<p>First   paragraph with <b>bold</b> words,<br>and more.<p>Short.<script>var t="</p>";</script><div class=ad>Buy this thing now, it is good.</div><p>Last &lt;one&gt; &amp; done; this has enough words to be text.</article>
<aside><p>Side words that go on and on for a while.</p></aside><div id=comments><p>First! A reader's comment of some length, really.</p></div><form>Mail <input></form><footer>&copy; x"""


def test_main_text():
    got = main_text.main_text(PAGE, main_text.weights())
    assert got == "Aé title\n\nFirst paragraph with bold words, and more.\n\nShort.\n\nLast <one> & done; this has enough words to be text."


def test_held_out_accuracy():
    r, right, n = random.Random(77), 0, 0
    for _ in range(150):
        source, content = main_text.example(r)
        blocks, keep = main_text.labelled(source, main_text.weights())
        right += sum((b.text in content) == k for b, k in zip(blocks, keep, strict=True))
        n += len(blocks)
    assert right / n > 0.97


LONG_LINE = "The river had risen in the night, and by the morning the lower fields lay under a sheet of grey water."
LAYOUTS = [
    f"<div><h1>The flood of the year</h1><p>{LONG_LINE}</p><p>Of.</p><p>{LONG_LINE}</p></div><div><p>Of.</p></div>",
    f"<table><tr><td><h2>A river in the night</h2><p>{LONG_LINE}</p><p>Of.</p><p>{LONG_LINE}</p></td></tr></table><div><div><p>Of.</p></div></div>",
    f"<section><div><p>{LONG_LINE}</p><p>{LONG_LINE}</p><p>Of.</p><p>{LONG_LINE}</p></div></section><p>Of.</p>",
]


@pytest.mark.parametrize("source", LAYOUTS)
def test_the_cut_overrules_the_classifier(source):
    """A short line that the classifier takes for boilerplate stays within an article, and goes by itself."""
    w = main_text.weights()
    blocks, keep = main_text.labelled(source, w)
    short = [i for i, b in enumerate(blocks) if b.text == "Of."]
    assert [main_text.cost(blocks[i], False, w) < 0 for i in short] == [True, True]
    assert [keep[i] for i in short] == [True, False]
    assert all(k for i, k in enumerate(keep) if i not in short)


def test_the_cut_is_better_than_the_classifier_alone():
    r, wrong = random.Random(78), [0, 0]
    w = main_text.weights()
    for _ in range(300):
        source, content = main_text.example(r)
        blocks, keep = main_text.labelled(source, w)
        has = any(b.flags & main_text.ARTICLE for b in blocks)
        for b, k in zip(blocks, keep, strict=True):
            wrong[0] += (main_text.cost(b, has, w) > 0) != (b.text in content)
            wrong[1] += k != (b.text in content)
    assert wrong[1] < 0.95 * wrong[0]


def test_open_ended_elements_lose_no_text():
    w = main_text.weights()
    text = f"<article><h1>The flood of the year</h1><p>{LONG_LINE}</p>"
    assert LONG_LINE in main_text.main_text(f"<html><head><title>x</title><meta charset=utf-8>{text}", w)
    assert LONG_LINE in main_text.main_text(f"<head><title>x</title>{LONG_LINE} And more.", w)
    assert main_text.main_text(f"<article><p>{LONG_LINE}</p><button>More<p>{LONG_LINE}</p>", w).count(LONG_LINE) == 2
    assert main_text.main_text(f"<article><p>{LONG_LINE}</p><select><option>a<p>{LONG_LINE}</p></article>", w).count(LONG_LINE) == 2
    assert "Buy" not in main_text.main_text(f"<article><p>{LONG_LINE}</p><button><div>Buy</div></button></article>", w)


def test_minimum_cut_by_hand():
    r = random.Random(6)
    for _ in range(200):
        n = r.randint(1, 7)
        costs = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 1.5)) for a in range(n) for b in range(a) if r.random() < 0.6]

        def total(labels, costs=costs, edges=edges):
            return sum(-c if k else 0 for c, k in zip(costs, labels, strict=True)) + sum(c for a, b, c in edges if labels[a] != labels[b])

        best = min(total([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert total(main_text.minimum_cut(costs, edges)) == pytest.approx(best)


def test_extract_odd_pages(spark):
    pages = [PAGE, None, "", "<p", "plain text without tags is a text of its own.", "<div " * 2000, "<p>" + LONG, "<b><i></b></i></p></div>&am"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").withColumn("url", F.lit("u")).withColumn("text", F.lit("mine"))
    got = {r.page_id: r for r in main_text.extract(df).collect()}
    assert [got[i].text for i in (1, 2, 3)] == ["", "", ""]
    assert got[6].text == LONG
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert main_text.extract(df.limit(0)).count() == 0


# Quality rules.


def counts_by_hand(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = collections.Counter(windows)
    hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    df = documents(spark)
    got = quality.judged(df).collect()
    text = {r.doc_id: r.text for r in df.collect()}
    assert len(got) == df.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_by_hand(text[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    r = random.Random(8)
    for _ in range(300):
        t = "".join(r.choices(["a ", "b ", "c\n", "\n", "\x0b", "| ", "a b c d e "], k=r.randint(0, 40)))
        assert quality.counts_of(t)[:5] == counts_by_hand(t)


def test_quality_keeps_the_good(spark):
    r = random.Random(9)
    good = [prose(r, r.randint(20, 200)) for _ in range(300)]
    bad = [" ".join(w + r.choice(["***", "$$$", "###"]) for w in prose(r, 60).split()) for _ in range(20)] + [" ".join(w.upper() + "!!" for w in prose(r, 60).split()) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    kept = {x.doc_id for x in quality.judged(df).filter("kept").collect()}
    assert kept == set(range(300))
    assert {x.doc_id for x in quality.kept(df).collect()} == kept
    assert quality.judged(empty(spark)).count() == quality.kept(empty(spark)).count() == 0
    assert quality.kept(documents(spark)).columns == documents(spark).columns


def kept_by_hand(rows):
    """rows (id, votes, failed): expectation-maximisation document by document."""
    groups, at = [], 0
    for f in quality.FAMILIES:
        groups.append(slice(at, at + len(f)))
        at += len(f)
    fitted = [v for _, v, failed in rows if not failed]
    weight, kinds = quality.PRIOR * len(fitted) + 10, range(len(groups) + 1)

    def prior(c, k, g):
        return np.prod([(quality.FAULT if c == k + 1 else quality.RIGHT)[x + 1] for x in g])

    first = [quality.GOOD] + [(1 - quality.GOOD) / len(groups)] * len(groups)
    share, table = first, [[lambda v, c=c, k=k: prior(c, k, v) for k in range(len(groups))] for c in kinds]

    def classes(v):
        p = [share[c] * math.prod(table[c][k](v[s]) for k, s in enumerate(groups)) for c in kinds]
        return [x / sum(p) for x in p]

    memo = lambda: {v: classes(v) for v in {*fitted}}
    now = memo()
    for _ in range(500):
        new = []
        for c in kinds:
            total = sum(now[v][c] for v in fitted)
            row = []
            for k, s in enumerate(groups):
                n = collections.Counter()
                for v in fitted:
                    n[v[s]] += now[v][c]
                row.append(lambda v, n=n, total=total, c=c, k=k: (n[v] + weight * prior(c, k, v)) / (total + weight))
            new.append(row)
        share, table = [(sum(now[v][c] for v in fitted) + first[c] * weight) / (len(fitted) + weight) for c in kinds], new
        before, now = now, memo()
        if max(abs(now[v][0] - before[v][0]) for v in now) < 1e-12:
            break
    return {i for i, v, failed in rows if not failed and classes(v)[0] >= 0.5}


def test_quality_verdicts_by_hand(spark):
    """Documents with one bad vote and with several, judged by a plain version; a single vote can be overruled."""
    r = random.Random(19)
    texts = []
    for k in range(160):
        words = prose(r, r.randint(12, 120)).split()
        if k % 9 == 0:
            words = [w + r.choice(["***", "$$$"]) + " |" if r.random() < 0.6 else w for w in words]
        if k % 7 == 0:
            words = [w.upper() + "!" for w in words]
        if k % 23 == 0:
            words = [w + "!" for w in words]
        if k % 40 == 1:
            words += words[:6] * 2
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    judged = quality.judged(df)
    rows = [(x.doc_id, tuple(x[len(judged.columns) :]), x.base_failed) for x in judged.select("*", *[v.alias(f"v_{k}") for k, v in quality.votes().items()]).collect()]
    kept = {x.doc_id for x in judged.filter("kept").collect()}
    assert kept == kept_by_hand(rows)
    assert any(min(v) < 0 for i, v, _ in rows if i in kept)
    assert any(min(v) < 0 for i, v, failed in rows if i not in kept and not failed)


# Near-duplicates.


def classes_by_hand(rows):
    sets = {i: near_duplicates.shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a][0]) and near_duplicates.probability_jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: top(i) for i in sets}


def edited(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"x{r.random()}"
    return " ".join(out)


def test_near_duplicates(spark):
    r = random.Random(11)
    rows = []
    for _ in range(12):
        words = prose(r, 200).split()
        rows += [edited(r, words, r.randint(0, 9)) for _ in range(r.randint(1, 25))]
    rows = [(i, t) for i, t in enumerate(r.sample(rows, len(rows)))] + [(900, None), (901, ""), (902, " "), (903, "one two"), (904, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.class_id for x in near_duplicates.classes(df).collect()}
    assert got == classes_by_hand(rows)
    assert got[901] == 901
    assert got[904] == 903
    assert {x.doc_id for x in near_duplicates.deduplicated(df).collect()} == set(got.values())


def test_near_duplicates_of_odd_rows(spark):
    df = documents(spark)
    got = near_duplicates.classes(df)
    assert got.count() == df.count()
    kept = near_duplicates.deduplicated(df)
    assert kept.columns == df.columns
    ids = [x.doc_id for x in kept.collect()]
    assert sorted(ids) == sorted({x.class_id for x in got.collect()})
    assert near_duplicates.classes(empty(spark)).count() == 0


def below_the_limit(r):
    """Texts on one template, pairs of them similar just below 0.8, and now and then two just above it."""
    template, rows = [f"t{k}" for k in range(304)], []
    for k in range(160):
        tail = [f"u{k}x{i}" for i in range(42)]
        rows.append((len(rows), " ".join(template + tail)))
        if k % 8 == 0:
            rows.append((len(rows), " ".join(template + tail[:6] + [f"v{k}x{i}" for i in range(36)])))
    return r.sample(rows, len(rows))


def test_near_duplicates_in_a_group_just_below_the_limit(spark):
    rows = below_the_limit(random.Random(14))
    want = classes_by_hand(rows)
    assert len(set(want.values())) == 160
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.class_id for x in near_duplicates.classes(df).collect()} == want


def test_near_duplicates_of_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 16)
    rows = below_the_limit(random.Random(15))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.class_id for x in near_duplicates.classes(df).collect()} == classes_by_hand(rows)


def test_near_duplicates_with_null_ids(spark):
    r = random.Random(16)
    one, two, three = (prose(r, 200) for _ in range(3))
    near = one.replace(one.split()[100], "changed", 1)
    rows = [(None, one), (5, one), (3, near), (None, two), (None, two), (7, three), (7, two + " " + three), (None, None), (None, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x.doc_id, x.class_id) for x in near_duplicates.classes(df).collect()), key=str)
    assert got == sorted([(None, 3), (5, 3), (3, 3), (None, None), (None, None), (7, 7), (7, 7), (None, None), (None, None), (8, 8)], key=str)
    kept = [(x.doc_id, x.text) for x in near_duplicates.deduplicated(df).collect()]
    assert sorted(kept, key=str) == sorted([(3, near), (None, two), (7, three), (7, two + " " + three), (None, None), (None, ""), (8, None)], key=str)


def test_probability_jaccard_by_hand():
    r = random.Random(12)
    for _ in range(50):
        a, b = (near_duplicates.shingles(" ".join(r.choices("abc", k=60))) for _ in range(2))
        x, y = dict(zip(*a, strict=True)), dict(zip(*b, strict=True))
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x if i in y)
        assert near_duplicates.probability_jaccard(a, b) == pytest.approx(want)


def test_signatures_estimate_the_similarity():
    r, off = random.Random(13), []
    for _ in range(60):
        words = [str(i) for i in range(400)]
        a, b = near_duplicates.shingles(" ".join(words)), near_duplicates.shingles(edited(r, words, 15))
        one, two = near_duplicates.signatures([a, b])
        off.append((one == two).mean() - near_duplicates.probability_jaccard(a, b))
    assert abs(np.mean(off)) < 0.02


# Token counts.


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = documents(spark)
    got = {r.doc_id: r for r in token_count.token_counts(df, PIECES).collect()}
    for r in df.collect():
        n = len(sp.encode(r.text or ""))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 4096)
    m, r = token_count.Merger(PIECES), random.Random(1)
    for _ in range(3000):
        t = "".join(r.choices([*"ab  \n\t▁é😀\x00\x85　z", "<s>", "</s>"], k=r.randint(0, 12)))
        assert m.count(t) == len(sp.encode(t))
    assert token_count.token_counts(empty(spark), PIECES).count() == 0


# Pseudonyms.


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms(spark):
    rows = ["card 4111111111111111 and 4111-1111-1111-1111, not 4111 1111 1111 1112", "4111111111111111", "+1 (017) 555-7713 or +10175557713", "ip 233.254.104.120, not 1.2.3.4.5 or 999.1.1.1", "on 2024-02-29 and 29/02/2024, not 2023-02-29", "Ly.39@mail1.example.com### x", 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"', None, "", "nothing 12345 here", LONG]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").withColumn("made", F.lit("mine"))
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(df, key="k").collect()}
    cards = re.findall(r"[\d-]{16,}", got[0].text)
    assert luhn(cards[0]) and cards[0] == cards[1].replace("-", "") == got[1].text != "4111111111111111"
    assert got[0].text.endswith("not 4111 1111 1111 1112")
    a, b = re.findall(r"\+1[\d ()\-]+\d", got[2].text)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "10175557713"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a)
    octets = re.match(r"ip ([\d.]+), not 1\.2\.3\.4\.5 or 999\.1\.1\.1", got[3].text)[1].split(".")
    assert len(octets) == 4 and all(int(x) < 256 for x in octets)
    one, two = re.match(r"on (\d{4}-\d\d-\d\d) and (\d\d/\d\d/\d{4}), not 2023-02-29", got[4].text).groups()
    assert one == "-".join(two.split("/")[::-1]) != "2024-02-29"
    assert re.fullmatch(r"u[0-9a-f]{12}@mail1\.example\.com### x", got[5].text)
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[6].text) and "2abc3f" not in got[6].text
    assert [got[i].text for i in (7, 8, 9, 10)] == [rows[i] for i in (7, 8, 9, 10)]
    assert [got[i].n_private for i in range(11)] == [2, 1, 2, 1, 2, 1, 1, 0, 0, 0, 0]
    other = pseudonyms.pseudonymised(df, key="another").filter("doc_id = 1").first().text
    assert luhn(other) and other != got[1].text


def test_numbers_stay_linked_and_valid(spark):
    """Against a Feistel network in plain Python; punctuation does not matter, valid numbers stay valid."""

    def permuted(x, a, b, key, kind):
        x, y, m, n = x // b, x % b, a, b
        for i in range(1, pseudonyms.ROUNDS + 1):
            noise = int(hashlib.sha256(f"{key}|{kind}|{i}|{y}|{m}|{n}".encode()).hexdigest()[:15], 16)
            x, y, m, n = y, (x + noise % m) % m, n, m
        return x * n + y

    r = random.Random(23)
    phones = [("+4915112345678", "+49 151 12345678"), ("+44 20 7946 0958", "+442079460958"), ("+33 1 23 45 67 89", "+33123456789"), ("+1 617 555 0123", "(617) 555-0123"), ("+1 017 555 0123", "017-555-0123")]
    ssns = [f"{r.choice([r.randint(1, 665), r.randint(667, 899)]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" for _ in range(300)]
    cards = ["3782 822463 10005", "3782-822463-10005", "378282246310005"]
    rows = [f"call {a} or {b} now" for a, b in phones] + [f"ssn {x} x" for x in ssns] + [f"card {c} x" for c in cards]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").withColumn("Made", F.lit("mine")).withColumn("_made", F.lit("mine"))
    out = pseudonyms.pseudonymised(df, key="k")
    assert out.columns == ["doc_id", "text", "Made", "_made", "n_private"]
    got = [x.text for x in out.orderBy("doc_id").collect()]
    for (a, b), text in zip(phones, got, strict=False):
        one, two = re.fullmatch(r"call (.+) or (.+) now", text).groups()
        digits = lambda t: re.sub(r"\D", "", t)[-9:]
        assert digits(one) == digits(two) and (one, two) != (a, b)
        assert one[:3] == a[:3] and re.sub(r"\d", "0", one) == re.sub(r"\d", "0", a)
    assert re.match(r"call \+1 [2-9]\d\d [2-9]", got[3])
    for x, text in zip(ssns, got[5:], strict=False):
        area, group, serial = map(int, x.split("-"))
        v = permuted(((area - 1 if area < 666 else area - 2) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "k", "ssn")
        a = v // (99 * 9999)
        assert text == f"ssn {a + 1 if a < 665 else a + 2:03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d} x"
    three = [re.sub(r"\D", "", t) for t in got[-3:]]
    assert len({*three}) == 1 and luhn(three[0]) and three[0] != "378282246310005"
    with pytest.raises(ValueError, match="key"):
        pseudonyms.pseudonymised(df)


def test_permutation_is_one_to_one(spark):
    a, b = (F.lit(n).cast("long") for n in pseudonyms.DAY_PAIR)
    x = spark.range(250 * 292).select(pseudonyms.permuted(F.col("id"), a, b, "k", "date").alias("v")).agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()
    assert tuple(x) == (73_000, 0, 72_999)


# Interleaved sequences.


def test_payload_round_trip():
    for raw in (b"", b"a", b"x" * 64, bytes(range(256)) * 3 + b"\n255\n", b"\x00" * 64):
        payload = interleaved.padded(raw)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw)
        assert interleaved.samples(interleaved.stored(payload)).tobytes() == payload


def test_interleaved_query(spark, tmp_path):
    df = documents(spark, False).unionByName(spark.createDataFrame([(50, "a", "", "", 1), (51, "a\x00", "", "", 1)], documents(spark, False).schema))
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_interleaved(spark, str(tmp_path)).collect()
    text = {r.doc_id: r.text for r in df.collect()}
    assert len(got) == df.count()
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        payload = interleaved.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(interleaved.stored(payload)).hexdigest()
        assert r.caption == f"document {r.doc_id}"


def test_store_is_read_back_from_its_table(spark):
    """The written media are the texts' bytes, and figures follow what lies in the table."""
    df = documents(spark)
    store = interleaved.media_store(df)
    texts = {r.text or "" for r in df.collect()}
    rows = store.collect()
    assert {interleaved.samples(r.media).tobytes()[: r.n_bytes].decode() for r in rows} == texts and len(rows) == len(texts)
    other = store.withColumn("media", F.lit(bytearray(interleaved.stored(b"z" * 64))))
    assert {r.payload_sha256 for r in interleaved.figures(other).collect()} == {hashlib.sha256(b"z" * 64).hexdigest()}
    assert interleaved.figures(interleaved.media_store(empty(spark))).count() == 0


def test_sequences_keep_order_and_captions(spark):
    html = '<p>one<figure><img src="media:d1" alt="x"><figcaption><p>cap <b>one</b></p><p>and more</figcaption></figure><p>two <img src="media:d2" alt="alt two"> three<img><p>four'
    ordinary = '<p>a<p><img src="http://x/a.png"><video src="/v.mp4"><source src="v.webm"></video><figure><img src="b.png"><figcaption>cap b</figcaption></figure><figure><figcaption>alone</figcaption></figure>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>x<img src=media:none>"), (4, ordinary), (None, "<p>y")], "page_id long, html string").withColumn("digest", F.lit("mine"))
    store = spark.createDataFrame([("d1", 7), ("d2", 8)], "digest string, n_bytes long")
    got = [(r.page_id, r.position, r.kind, r.text or r.src, r.caption, r.n_bytes) for r in interleaved.sequences(pages, store).orderBy("page_id", "position").collect()]
    assert got[0] == (None, 0, "text", "y", None, None)
    assert got[1:7] == [
        (1, 0, "text", "one", None, None),
        (1, 1, "media", "media:d1", "cap one and more", 7),
        (1, 2, "text", "two", None, None),
        (1, 3, "media", "media:d2", "alt two", 8),
        (1, 4, "text", "three", None, None),
        (1, 5, "text", "four", None, None),
    ]
    assert got[7:9] == [(3, 0, "text", "x", None, None), (3, 1, "media", "media:none", None, None)]
    assert [x[2:5] for x in got[9:]] == [("text", "a", None), ("media", "http://x/a.png", None), ("media", "/v.mp4", None), ("media", "v.webm", None), ("media", "b.png", "cap b"), ("text", "alone", None)]
    assert interleaved.sequences(pages.limit(0), store).count() == 0


# Pipeline.


def test_pipeline(spark):
    import corpus_pipeline

    docs, sizes = documents(spark), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = common.spool(stage(spark, docs, ""))
        sizes.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert sizes[0] > sizes[1] > 0
    nothing = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        nothing = common.spool(stage(spark, nothing, ""))
    assert nothing.count() == 0
