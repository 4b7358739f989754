"""Queries over whole texts, however long."""

from oracle import connect, duck_rows, spark_rows
from tessera import queries


def test_marks_past_the_200th_character(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 250 + "éüñ" * 500), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.QUERIES["fold_marks"](spark, str(tmp_path)).collect()}
    assert got == {1: "a" * 250 + "eun" * 500, 2: None, 3: ""}


def test_positions_past_the_30th_word(spark, tmp_path):
    long = " ".join(f"w{k % 701}" for k in range(20_000))
    spark.createDataFrame([(1, long), (2, None), (3, " . "), (4, "a b a a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.QUERIES["decode_positions"](spark, str(tmp_path)).collect()}
    assert got == {1: long, 4: "a b a a"}


def test_positions_are_made_once(spark, tmp_path):
    """A text is split once and its JSON is read once, whatever else the query asks of them."""
    rows = [(1, "B a, b! Ⅻ a ǅ É"), (2, None), (3, " . "), (4, ""), (5, "x"), (6, "İ İ"), (7, "- 7 -")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["decode_positions"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("from_json("), plan.count("split(")) == (1, 1)
    assert {r.doc_id: r.text for r in df.collect()} == {1: "b a b ⅻ a ǆ é", 5: "x", 6: "i i", 7: "7"}
