"""Query objects, paging by cursor, and catalog checks."""

import pytest

from tessera.operators import paging, search
from tessera.operators.filters import QueryError
from tessera.plans import query
from tessera.sources import catalog

FOLDER = "/root/testdata/sf0.001"


def test_pages_by_cursor_are_the_whole_order(spark):
    df = spark.read.parquet(f"{FOLDER}/customer.parquet").limit(60).cache()
    keys, cursor, seen = [("c_mktsegment", True), ("c_acctbal", False)], "*", []
    while cursor:
        rows = paging.keyset_page(df, keys, "c_custkey", cursor, 25).collect()
        seen += [r.c_custkey for r in rows]
        cursor = paging.encoded([rows[-1][k] for k in ("c_mktsegment", "c_acctbal", "c_custkey")]) if len(rows) == 25 else None
    assert seen == [r.c_custkey for r in df.orderBy(*paging.order([*keys, ("c_custkey", False)])).collect()]


@pytest.mark.parametrize(
    "wrong",
    [
        {"get_rows": "order"},
        {"get_rows": "orders", "filter_rows": [{"column_id": "o_status", "value": 1}]},
        {"get_rows": "orders", "filter_rows": [{"column_id": "o_totalprice", "value": "many"}]},
        {"get_rows": "orders", "group_by": [{"column_id": "o_orderdate"}]},
        {"get_rows": "orders", "group_by": [{"column_id": "o_orderstatus"}], "select": ["o_orderkey"]},
        {"get_rows": "orders", "sample": 20_000},
        {"get_rows": "orders", "page": 500, "per_page": 200},
        {"get_rows": "orders", "search": "x"},
        {"get_rows": "orders", "order": 1},
    ],
)
def test_wrong_queries(spark, wrong):
    with pytest.raises(QueryError):
        query.run(spark, FOLDER, wrong)


def test_guess_of_a_name():
    with pytest.raises(QueryError, match="did you mean 'orders'"):
        catalog.entity("order")


def test_canonical_form_is_one(spark):
    e, schema = catalog.entity("orders"), spark.read.parquet(f"{FOLDER}/orders.parquet").schema
    leaf = lambda c, v, n=False: {"column_id": c, "value": v, "is_negated": n}
    one = {"filter_rows": [leaf("status", "F"), {"join": "or", "is_negated": True, "filters": [leaf("price", 1), leaf("o-custkey", 2)]}]}
    two = {"filter_rows": [leaf("o_custkey", 2, True), leaf("o_orderstatus", "F"), leaf("o_totalprice", 1, True)]}
    assert query.canonical(one, e, schema) == query.canonical(two, e, schema)
    again = query.canonical(two, e, schema)
    assert query.canonical(again, e, schema) == again


def test_search_in_words(spark):
    df = spark.createDataFrame([(1, "Smart phones are here"), (2, "a smart, old phone"), (3, None), (4, "")], "id int, text string")
    ids = lambda q: [r.id for r in search.search(df, ["text"], q).orderBy("id").collect()]
    assert ids("smart") == [1, 2]
    assert ids('"smart phones"') == [1]
    assert ids("phon*") == [1, 2]
    assert ids('"smart phon*"') == [1]
    assert ids("phnes~1") == [1]
    assert [r.id for r in search.near(df, "text", ["smart", "phone"], 1).collect()] == [2]
    assert search.near(df, "text", ["smart", "phone"], 0).count() == 0


def test_stream_of_events(spark, tmp_path):
    from tessera.streaming import windows

    stream = windows.windowed(windows.events(spark, FOLDER), "ts", ["event_type"], "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    total = spark.sql("select sum(count) from windows").first()[0]
    assert total == spark.read.parquet(f"{FOLDER}/events.parquet").count()
