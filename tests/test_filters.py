"""Null-safe filters: random trees against Python's logic, and what reaches the scan."""

import random

import pytest

from tessera.operators.filters import Branch, Leaf, QueryError, compiled, from_text, kind_of, negate, normal

ROWS = [(i, a, n, t) for i, (a, n, t) in enumerate((a, n, t) for a in ("a", "b", None) for n in (1, 5, None) for t in (["x", "y"], ["x", None], [], None))]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, a string, n int, t array<string>").cache()


def leaf(r):
    return r.choice(
        [
            Leaf("a", r.choice(["a", "b", "c", None])),
            Leaf("a", tuple(r.sample(["a", "b", None], r.randint(1, 2))), "in"),
            Leaf("n", r.randint(0, 6), r.choice([">", ">=", "<", "<=", "is"])),
            Leaf("n", (1, 4), "between"),
            Leaf("t", r.choice(["x", "y", "z", None])),
            Leaf("t", ("x", "y"), "contains_all"),
            Leaf("a", "a", "prefix"),
        ]
    )


def tree(r, depth):
    f = leaf(r) if depth == 0 or r.random() < 0.3 else Branch(r.choice(["and", "or"]), tuple(tree(r, depth - 1) for _ in range(r.randint(1, 3))))
    return negate(f) if r.random() < 0.3 else f


def holds(f, row):
    if isinstance(f, Branch):
        out = (all if f.join == "and" else any)(holds(x, row) for x in f.filters)
    else:
        v = row[{"a": 1, "n": 2, "t": 3}[f.column]]
        if f.column == "t":
            known = [x for x in v or [] if x is not None]
            out = not known if f.value is None else all(x in known for x in f.value) if f.operator == "contains_all" else f.value in known
        elif f.operator == "in":
            out = v in f.value
        elif f.operator == "is":
            out = v == f.value
        else:
            out = v is not None and {">": lambda: v > f.value, ">=": lambda: v >= f.value, "<": lambda: v < f.value, "<=": lambda: v <= f.value, "between": lambda: f.value[0] <= v <= f.value[1], "prefix": lambda: v.startswith(f.value)}[f.operator]()
    return out != f.negated


def test_random_trees(df):
    r = random.Random(3)
    trees = [tree(r, 3) for _ in range(60)]
    found = df.select("id", *[compiled(t, df.schema).alias(f"c{k}") for k, t in enumerate(trees)]).collect()
    for row in found:
        for k, t in enumerate(trees):
            assert row[f"c{k}"] is holds(t, ROWS[row.id]), (t, ROWS[row.id])


def test_normal_form_has_no_negated_branches():
    r = random.Random(4)

    def check(f):
        if isinstance(f, Branch):
            assert not f.negated
            for x in f.filters:
                assert not (isinstance(x, Branch) and x.join == f.join)
                check(x)

    for _ in range(100):
        check(normal(tree(r, 4)))


@pytest.mark.parametrize(
    ("text", "ids"),
    [("5", lambda n: n == 5), ("!5", lambda n: n != 5), ("1-4", lambda n: n is not None and 1 <= n <= 4), ("!1-4", lambda n: not (n is not None and 1 <= n <= 4)), ("2-", lambda n: n is not None and n >= 2), ("-2", lambda n: n is not None and n <= 2), ("<5", lambda n: n is not None and n < 5), ("null", lambda n: n is None), ("!null", lambda n: n is not None), ("1|null", lambda n: n in (1, None)), ("!1|5", lambda n: n is None)],
)
def test_text_forms(df, text, ids):
    got = {r.id for r in df.filter(compiled(from_text("n", text, kind_of(df.schema, "n")), df.schema)).collect()}
    assert got == {r[0] for r in ROWS if ids(r[2])}


@pytest.mark.parametrize("text", ["1|!5", "", "none", "x"])
def test_wrong_text(df, text):
    with pytest.raises(QueryError):
        compiled(from_text("n", text, kind_of(df.schema, "n")), df.schema)


def test_unknown_column(df):
    with pytest.raises(QueryError, match="not a valid column"):
        compiled(Leaf("zz", 1), df.schema)


def test_not_equal_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = df.filter(compiled(Leaf("o_orderstatus", "F", negated=True), df.schema)).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualNullSafe(o_orderstatus,F))" in plan
    assert "o_totalprice" not in plan


def test_sorted_page_is_a_top_k(spark):
    from tessera.operators import paging

    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = paging.page(df, [("o_totalprice", True)], "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
