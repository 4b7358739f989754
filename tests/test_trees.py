"""Descendants in deep trees and in cycles."""

from tessera.operators import joins


def counted(spark, edges):
    return {r.ancestor: r.n for r in joins.descendants(spark.createDataFrame(edges, "p long, c long"), "p", "c").collect()}


def test_descendants_below_20_levels(spark):
    assert counted(spark, [(k, k + 1) for k in range(26)]) == {k: 26 - k for k in range(26)}


def test_descendants_of_cycles_and_null_parents(spark):
    assert counted(spark, [(1, 2), (2, 3), (3, 1), (None, 1)]) == {1: 3, 2: 3, 3: 3, None: 3}
