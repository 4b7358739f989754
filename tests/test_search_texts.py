"""Search texts against plain Python, and what they refuse."""

import itertools
import random
import re

import pytest

from tessera import queries
from tessera.functions import ids, text
from tessera.operators import search
from tessera.operators.filters import Leaf, QueryError, compiled
from tessera.plans import query
from tessera.sources import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    return [(i, " ".join(r.choices("abcdx", k=r.randint(0, 14)))) for i in range(400)] + [(400, None), (401, "")]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id int, t string").cache()


def near_by_hand(words, operands, gaps, ordered):
    places = [[i for i in range(len(words)) if words[i : i + len(o)] == o] for o in operands]
    for chosen in itertools.product(*places):
        spans = sorted((i, i + len(o)) for i, o in zip(chosen, operands, strict=True))
        apart = all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        in_order = not ordered or list(chosen) == sorted(chosen)
        if apart and in_order and spans[-1][1] - spans[0][0] - sum(map(len, operands)) <= gaps:
            return True
    return False


@pytest.mark.parametrize("ordered", [False, True])
@pytest.mark.parametrize(("operands", "gaps"), [(["a", "b"], 0), (["a", "b"], 2), (["a b", "c"], 1), (["a", "a"], 1), (["a", "b", "c"], 2), (["a", "b c", "d", "a"], 4)])
def test_proximity(df, rows, operands, gaps, ordered):
    got = {r.id for r in search.near(df, "t", operands, gaps, ordered).collect()}
    assert got == {i for i, t in rows if near_by_hand((t or "").split(), [o.split() for o in operands], gaps, ordered)}


@pytest.mark.parametrize(("phrase", "slop"), [("a b", 0), ("a b", 1), ("a b", 2), ("a b c", 2), ("d a", 3)])
def test_sloppy_phrase(df, rows, phrase, slop):
    def holds(words):
        moved = [[i - k for i in range(len(words)) if words[i] == w] for k, w in enumerate(phrase.split())]
        return any(max(c) - min(c) <= slop for c in itertools.product(*moved))

    got = {r.id for r in search.search(df, ["t"], f'"{phrase}"~{slop}').collect()}
    assert got == {i for i, t in rows if holds((t or "").split())}


@pytest.mark.parametrize(
    ("q", "holds"),
    [
        ("a b", lambda w: {"a", "b"} <= w),
        ("a OR b", lambda w: bool({"a", "b"} & w)),
        ("a AND b NOT c", lambda w: {"a", "b"} <= w and "c" not in w),
        ("NOT a", lambda w: "a" not in w),
        ("a AND NOT b OR c d", lambda w: ("a" in w and "b" not in w) or {"c", "d"} <= w),
    ],
)
def test_words_joined_in_a_text(df, rows, q, holds):
    assert {r.id for r in search.search(df, ["t"], q).collect()} == {i for i, t in rows if holds({*(t or "").split()})}


@pytest.mark.parametrize("q", ["x~y", "~2", "a AND", "OR b", "a NOT", "(a OR b) AND c", "!a", "ab*c", '"a"~1~"b"~2~"c"', '"a b*"~2'])
def test_refused_texts(df, q):
    with pytest.raises(QueryError):
        search.search(df, ["t"], q)


def test_slop_with_patterns(spark):
    df = spark.createDataFrame([(1, "smartly made phones"), (2, "phone smart"), (3, "smart"), (4, "smarter old grey phone")], "id int, t string")
    found = lambda q: [r.id for r in search.search(df, ["t"], q).orderBy("id").collect()]
    assert found('"smart* phone*"~1') == [1]
    assert found('"smart* phone"~2') == [2, 4]
    assert found('phones~1 "smart"~3~"phone"') == [2]


def test_not_holds_for_all_columns(spark):
    df = spark.createDataFrame([(1, "smart", "phone"), (2, "old", "phone"), (3, "phone", "smart")], "id int, a string, b string")
    assert [r.id for r in search.search(df, ["a", "b"], "phone NOT smart").collect()] == [2]


def test_days_and_terms(spark):
    df = spark.sql("select * from values (1, timestamp '2024-01-03 10:00:00', 'ABC'), (2, timestamp '2024-01-04 00:00:00', 'abc'), (3, null, null) t(id, ts, name)")
    found = lambda f: [r.id for r in df.filter(compiled(f, df.schema)).orderBy("id").collect()]
    assert found(Leaf("ts", "2024-01-03")) == [1]
    assert found(Leaf("ts", "2024-01-03", negated=True)) == [2, 3]
    assert found(Leaf("name", "Abc", "term")) == [1, 2]
    assert found(Leaf("name", ("Abc", None), "term", True)) == []
    with pytest.raises(QueryError):
        compiled(Leaf("ts", "soon"), df.schema)


@pytest.mark.parametrize(
    ("scheme", "raw", "want"),
    [("pmid", "PMID:123", "123"), ("pmcid", "PMC123", "123"), ("pmcid", "1234567", "1234567"), ("doi", "https://doi.org/10.123/ABC", "10.123/abc"), ("issn", "print 1234-567x, online", "1234-567X"), ("WA", "https://example.org/w0123", "W0123"), ("WA", "x", None)],
)
def test_ids_in_any_spelling(spark, scheme, raw, want):
    assert ids.canonical(scheme, raw) == want
    if scheme in ids.PATTERNS:
        from pyspark.sql import functions as F

        assert spark.range(1).select(ids.identifier(scheme, F.lit(raw)).alias("x")).first().x == want


def test_exact_quantiles_by_narrowing(spark, monkeypatch):
    import numpy as np

    from tessera.operators import groups

    monkeypatch.setattr(groups, "FEW", 20)
    monkeypatch.setattr(groups, "ACCURACY", 50)
    r = np.random.default_rng(3)
    for values in (r.normal(size=5000), np.repeat([1.0, 2.0], [3000, 10]), np.arange(7.0), r.integers(0, 40, 3000).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        got = groups.stats(df, "v").first()
        assert got["count"] == len(values)
        assert [got.p25, got.p50, got.p75] == pytest.approx(np.percentile(values, [25, 50, 75]).tolist())
    assert tuple(groups.stats(spark.createDataFrame([], "v double"), "v").first()) == (0, None, None, None, None)


def test_fragments_by_hand(spark):
    long = "x " * 400 + "Worthless here" + " y" * 400 + " worthless."
    df = spark.createDataFrame([(1, long), (2, "worthlessly"), (3, None)], "id int, t string")
    from pyspark.sql import functions as F

    got = {r.id: r.f for r in df.select("id", text.fragments(F.col("t"), ["worthless"], 40).alias("f")).collect()}
    assert got[2] == [] and got[3] is None
    assert [re.sub(r"[xy ]", "", x) for x in got[1]] == [">>Worthless<<here", ">>worthless<<."]
    assert all(len(x) <= 40 + len("worthless") + 4 for x in got[1])


def test_catalog_names_all_columns(spark):
    got = {r.name: (r.type, r.abilities) for r in queries.column_catalog(spark, FOLDER).collect()}
    assert got["lines.l_returnflag"] == ("array<string>", ["filter", "group", "search", "select"])
    assert got["o_totalprice"][1] == ["filter", "group", "range", "select", "sort"]
    assert {"o_orderkey", "lines", "lines.l_quantity"} <= {*got}


def test_scored_only_where_it_shows(spark):
    rows = query.run(spark, FOLDER, {"get_rows": "documents", "search": "the", "group_by": [{"column_id": "lang"}]})
    assert "sqrt" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    first = query.run(spark, FOLDER, {"get_rows": "documents", "search": "the", "per_page": 5}).collect()
    assert [r.score for r in first] == sorted((r.score for r in first), reverse=True)


def test_rows_of_entities_are_told_apart(spark):
    for name in ("lineitem", "conversations", "orders"):
        e, df = catalog.entity(name), catalog.scan(spark, FOLDER, name)
        columns = (e.unique,) if isinstance(e.unique, str) else e.unique
        assert df.select(*columns).distinct().count() == df.count()


def test_small_helpers(spark, tmp_path):
    from tessera.sources import tables

    assert text.years_in("rivers 1999-2004") == (1999, 2004)
    assert text.years_in("2004-1999") is None and text.years_in("room 12-14") is None
    assert text.spoken("o_order_date", "o_") == "Order date"
    assert ids.canonical("slug", "https://example.org/licenses/CC-BY") == "cc-by"
    with pytest.raises(QueryError):
        tables.write(spark.range(1), str(tmp_path), "xlsx")
    tables.write(spark.sql("select 1 as id, array(1, 2) as a"), f"{tmp_path}/t", "csv", header=True)
    assert spark.read.csv(f"{tmp_path}/t", header=True).first().a == "[1,2]"
    e, schema = catalog.entity("orders"), catalog.scan(spark, FOLDER, "orders").schema
    with pytest.raises(QueryError, match="one key"):
        query.filters_of_text("status:F|price:5", e, schema)
    with pytest.raises(QueryError, match="nested"):
        query.run(spark, FOLDER, {"get_rows": "orders", "group_by": [{"column_id": "status"}, {"column_id": "o_orderpriority"}], "sort_by": [{"column_id": "price", "aggregate": "mean"}]})
