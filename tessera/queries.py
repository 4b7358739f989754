"""Each operator on the driver's tables, with the same in SQL.

Raw tables have no nulls and no arrays, so several queries run over derived ones (``nullable_orders``, ``nested_orders``),
which the SQL derives alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.functions import text as words
from tessera.operators import groups, joins, lookup, paging, search, vectors
from tessera.operators.filters import Leaf, all_of, any_of, compiled, from_text, in_any_case, kind_of, negate
from tessera.plans import query as plans
from tessera.sources import catalog, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NULLABLE = """nullable as (select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as o_orderstatus,
    case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders)"""
NESTED = """nested as (select o_orderkey, o_orderpriority, list_distinct(list(l_returnflag) filter (where l_returnflag is not null)) as flags,
    list_distinct(list(l_linestatus) filter (where l_linestatus is not null)) as statuses
    from orders left join lineitem on l_orderkey = o_orderkey group by all)"""


def query(sql: str | None = None):
    """Register a query, and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return catalog.scan(spark, folder, name)


def nullable_orders(spark: SparkSession, folder: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return scan(spark, folder, "orders").withColumns({"o_orderstatus": F.nullif("o_orderstatus", F.lit("P")), "o_totalprice": price})


def nested_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their lines as an array of structs; null where there are none."""
    lines = scan(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_linestatus", "l_quantity", "l_partkey", "l_suppkey")).alias("lines"))
    return scan(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def ids_where(df: DataFrame, f, *columns: str) -> DataFrame:
    return df.filter(compiled(f, df.schema)).select(*columns)


# Filters.


@query(f"with {NULLABLE} select o_orderkey, o_orderstatus from nullable where o_orderstatus = 'F'")
def filter_eq(spark, folder):
    return ids_where(nullable_orders(spark, folder), Leaf("o_orderstatus", "F"), "o_orderkey", "o_orderstatus")


@query(f"with {NULLABLE} select o_orderkey, o_orderstatus from nullable where o_orderstatus is distinct from 'F'")
def filter_not_nullsafe(spark, folder):
    return ids_where(nullable_orders(spark, folder), Leaf("o_orderstatus", "F", negated=True), "o_orderkey", "o_orderstatus")


@query(f"with {NULLABLE} select o_orderkey, o_orderstatus from nullable where o_orderstatus = 'F' or o_orderstatus is null")
def filter_in_null(spark, folder):
    df = nullable_orders(spark, folder)
    return ids_where(df, from_text("o_orderstatus", "F|null", kind_of(df.schema, "o_orderstatus")), "o_orderkey", "o_orderstatus")


@query(f"with {NULLABLE} select o_orderkey, o_orderstatus from nullable where o_orderstatus is null or o_orderstatus not in ('F', 'X')")
def filter_not_in(spark, folder):
    df = nullable_orders(spark, folder)
    return ids_where(df, from_text("o_orderstatus", "!F|X", kind_of(df.schema, "o_orderstatus")), "o_orderkey", "o_orderstatus")


@query(f"with {NULLABLE} select o_orderkey from nullable where o_totalprice is null")
def filter_missing(spark, folder):
    return ids_where(nullable_orders(spark, folder), Leaf("o_totalprice"), "o_orderkey")


@query(f"with {NULLABLE} select o_orderkey from nullable where o_totalprice is not null")
def filter_present(spark, folder):
    return ids_where(nullable_orders(spark, folder), Leaf("o_totalprice", negated=True), "o_orderkey")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 12")
def filter_range_between(spark, folder):
    df = scan(spark, folder, "lineitem")
    return ids_where(df, from_text("l_quantity", "10-12", kind_of(df.schema, "l_quantity")), "l_orderkey", "l_linenumber", "l_quantity")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 49 or l_quantity <= 2")
def filter_range_open(spark, folder):
    df = scan(spark, folder, "lineitem")
    return ids_where(df, from_text("l_quantity", "49-|-2", kind_of(df.schema, "l_quantity")), "l_orderkey", "l_linenumber", "l_quantity")


@query(f"with {NULLABLE} select o_orderkey from nullable where o_totalprice is null or o_totalprice < 1000 or o_totalprice > 200000")
def filter_range_not(spark, folder):
    df = nullable_orders(spark, folder)
    return ids_where(df, from_text("o_totalprice", "!1000-200000", kind_of(df.schema, "o_totalprice")), "o_orderkey")


@query("select o_orderkey from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1996-06-30'")
def filter_date_from_to(spark, folder):
    return ids_where(scan(spark, folder, "orders"), all_of(Leaf("o_orderdate", "1995-01-01", ">="), Leaf("o_orderdate", "1996-06-30", "<=")), "o_orderkey")


@query(f"""with {NULLABLE} select o_orderkey from nullable
    where not (coalesce(o_orderstatus = 'F', false) and (coalesce(o_totalprice > 100000, false) or not coalesce(o_orderpriority = '1-URGENT', false)))""")
def filter_tree_nnf(spark, folder):
    tree = all_of(Leaf("o_orderstatus", "F"), any_of(Leaf("o_totalprice", 100000, ">"), Leaf("o_orderpriority", "1-URGENT", negated=True)))
    return ids_where(nullable_orders(spark, folder), negate(tree), "o_orderkey")


@query(f"with {NESTED} select o_orderkey from nested where list_contains(flags, 'R') and list_contains(flags, 'A')")
def filter_value_and(spark, folder):
    return ids_where(nested_orders(spark, folder), Leaf("lines.l_returnflag", ("R", "A"), "contains_all"), "o_orderkey")


@query(f"with {NESTED} select o_orderkey from nested where list_contains(flags, 'R') and list_contains(statuses, 'O')")
def filter_flattened_objects(spark, folder):
    return ids_where(nested_orders(spark, folder), all_of(Leaf("lines.l_returnflag", "R"), Leaf("lines.l_linestatus", "O")), "o_orderkey")


@query("""select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_linestatus = 'O')""")
def filter_same_element(spark, folder):
    match = F.exists("lines", lambda x: (x["l_returnflag"] == "R") & (x["l_linestatus"] == "O"))
    return nested_orders(spark, folder).filter(F.coalesce(match, F.lit(False))).select("o_orderkey")


@query(f"with {NESTED} select o_orderkey from nested where not coalesce(list_contains(flags, 'R'), false)")
def filter_array_not(spark, folder):
    return ids_where(nested_orders(spark, folder), Leaf("lines.l_returnflag", "R", negated=True), "o_orderkey")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def filter_has_children(spark, folder):
    orders, lines = scan(spark, folder, "orders"), scan(spark, folder, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("select p_partkey, p_name from part where starts_with(p_name, 'small r') or starts_with(p_name, 'red')")
def filter_prefix(spark, folder):
    return ids_where(scan(spark, folder, "part"), any_of(Leaf("p_name", "small r", "prefix"), Leaf("p_name", "red", "prefix")), "p_partkey", "p_name")


@query("select c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')")
def filter_region_expand(spark, folder):
    keys = scan(spark, folder, "nation").join(scan(spark, folder, "region").filter(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    return scan(spark, folder, "customer").join(keys.select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


# Whole queries.


@query("""select o_orderpriority as key, count(*) as count, round(avg(o_totalprice), 4) as mean_o_totalprice from orders
    where o_orderstatus is distinct from 'F' and o_orderdate >= timestamp '1995-01-01' group by 1""")
def query_object(spark, folder):
    q = {
        "get_rows": "orders",
        "filter_rows": [{"column_id": "o_orderstatus", "value": "F", "is_negated": True}, {"column_id": "o_orderdate", "value": "1995-01-01", "operator": ">="}],
        "group_by": [{"column_id": "o_orderpriority"}],
        "sort_by": [{"column_id": "o_totalprice", "aggregate": "mean", "direction": "desc"}],
    }
    return plans.run(spark, folder, q).withColumn("mean_o_totalprice", F.round("mean_o_totalprice", 4))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus in ('F', 'O') and o_totalprice >= 50000 order by o_totalprice desc, o_orderkey limit 40 offset 40")
def query_filter_text(spark, folder):
    df = scan(spark, folder, "orders")
    filters = plans.filters_of_text("status:F|O,o_totalprice:50000-", catalog.entity("orders"), df.schema)
    return plans.run(spark, folder, {"get_rows": "orders", "filter_rows": filters, "select": ["o_orderkey", "price"], "page": 2, "per_page": 40})


# Grouping.


@query("select l_returnflag as key, count(*) as count from lineitem group by 1")
def group_terms(spark, folder):
    return groups.terms(scan(spark, folder, "lineitem"), "l_returnflag")


@query(f"with {NESTED} select unnest(flags) as key, count(*) as count from nested group by 1")
def group_terms_multivalued(spark, folder):
    return groups.terms(nested_orders(spark, folder), "lines.l_returnflag")


@query(f"with {NULLABLE} select coalesce(o_orderstatus, 'unknown') as key, count(*) as count from nullable group by 1")
def group_unknown(spark, folder):
    return groups.terms(nullable_orders(spark, folder), "o_orderstatus", unknown=True)


@query(f"with {NESTED} select coalesce(f, 'unknown') as key, count(*) as count from nested left join (select o_orderkey as k, unnest(flags) as f from nested) on k = o_orderkey group by 1")
def group_unknown_multivalued(spark, folder):
    return groups.terms(nested_orders(spark, folder), "lines.l_returnflag", unknown=True)


@query("select n_nationkey as key, coalesce(c, 0) as count from nation left join (select s_nationkey, count(*) as c from supplier where s_acctbal > 5000 group by 1) on s_nationkey = n_nationkey")
def group_zero_fill(spark, folder):
    observed = groups.terms(scan(spark, folder, "supplier").filter("s_acctbal > 5000"), "s_nationkey")
    return groups.zero_filled(observed, scan(spark, folder, "nation"), "n_nationkey")


@query("select o_orderpriority as key, count(*) as count, round(sum(o_totalprice), 2) as sum_o_totalprice from orders group by 1 order by 3 desc, 1 limit 3")
def group_sort_metric(spark, folder):
    out = groups.terms(scan(spark, folder, "orders"), "o_orderpriority", order="-sum_o_totalprice", limit=3, metric=("sum", "o_totalprice"))
    return out.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("select p_brand as key, count(*) as count from part group by 1 order by 1 limit 10")
def group_sort_key(spark, folder):
    return groups.terms(scan(spark, folder, "part"), "p_brand", order="key", limit=10)


def customers_placed(spark, folder):
    df = scan(spark, folder, "customer").join(scan(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.join(scan(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


PLACED = "placed as (select * from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
TOP_1 = "a as (select r_name as key_1, count(*) as count_1 from placed group by 1 order by 2 desc, 1 limit 2)"
TOP_2 = """b as (select key_1, key_2, count_2 from (select r_name as key_1, n_name as key_2, count(*) as count_2,
    row_number() over (partition by r_name order by count(*) desc, n_name) as p from placed where r_name in (select key_1 from a) group by 1, 2) where p <= 2)"""


@query(f"with {PLACED}, {TOP_1}, {TOP_2} select key_1, count_1, key_2, count_2 from a join b using (key_1)")
def group_nested_top2(spark, folder):
    return groups.nested(customers_placed(spark, folder), ["r_name", "n_name"], 2)


@query(f"""with {PLACED}, {TOP_1}, {TOP_2}, c as (select key_1, key_2, key_3, count_3 from (select r_name as key_1, n_name as key_2, c_mktsegment as key_3,
    count(*) as count_3, row_number() over (partition by r_name, n_name order by count(*) desc, c_mktsegment) as p
    from placed join b on r_name = key_1 and n_name = key_2 group by 1, 2, 3) where p <= 2)
    select key_1, count_1, key_2, count_2, key_3, count_3 from a join b using (key_1) join c using (key_1, key_2)""")
def group_nested_3d(spark, folder):
    return groups.nested(customers_placed(spark, folder), ["r_name", "n_name", "c_mktsegment"], 2)


@query("""select 'o_orderstatus' as facet, o_orderstatus as key, count(*) as count from orders group by 2
    union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2""")
def facets_two(spark, folder):
    return groups.facets(scan(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(f"with {NULLABLE} select 'true' as key, count(o_totalprice) as count from nullable union all select 'false', count(*) - count(o_totalprice) from nullable")
def group_boolean_pair(spark, folder):
    return groups.presence(nullable_orders(spark, folder), "o_totalprice")


@query("""select unnest(['any', 'large', 'huge']) as key, unnest([count(*), count(*) filter (o_totalprice > 100000), count(*) filter (o_totalprice > 300000)]) as count from orders""")
def group_overlap_buckets(spark, folder):
    price = F.col("o_totalprice")
    return groups.overlapping(scan(spark, folder, "orders"), {"any": price.isNotNull(), "large": price > 100000, "huge": price > 300000})


@query("select p_brand as key, count(*) as count from part where p_brand > 'Brand#2' group by 1 order by 1 limit 5")
def group_cursor_page(spark, folder):
    return groups.after(groups.terms(scan(spark, folder, "part"), "p_brand"), "Brand#2", 5)


@query("select n_nationkey as key, count(*) as count, n_name as key_display_name from customer join nation on c_nationkey = n_nationkey where contains(lower(n_name), 'an') or contains(lower(n_name), '1') group by 1, 3")
def group_q_filter(spark, folder):
    buckets = groups.terms(scan(spark, folder, "customer"), "c_nationkey")
    nation = scan(spark, folder, "nation")
    like = [groups.named_like(buckets, nation, "n_nationkey", "n_name", q) for q in ("an", "1")]
    return like[0].union(like[1]).distinct()


@query("select year(o_orderdate) as key, count(*) as count from orders where year(o_orderdate) between 1990 and 1999 group by 1")
def group_partial_year(spark, folder):
    lo, hi = groups.years_like("199")
    return groups.terms(scan(spark, folder, "orders").filter(F.year("o_orderdate").between(lo, hi)), F.year("o_orderdate"))


@query("select r_name as key, count(distinct c_custkey) as count from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def group_through(spark, folder):
    dim = scan(spark, folder, "nation").join(scan(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return groups.through(scan(spark, folder, "customer"), "c_nationkey", dim, "n_nationkey", "r_name", "c_custkey")


@query("select round(sum(l_extendedprice), 2) as total, round(sum(l_extendedprice) filter (l_returnflag in ('R', 'A')), 2) as returned from lineitem")
def meta_sums(spark, folder):
    back = F.when(F.col("l_returnflag").isin("R", "A"), F.col("l_extendedprice"))
    return scan(spark, folder, "lineitem").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.sum(back), 2).alias("returned"))


@query("""select count(l_extendedprice) as count, round(sum(l_extendedprice), 2) as sum, round(quantile_cont(l_extendedprice, 0.25), 4) as p25,
    round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.75), 4) as p75 from lineitem""")
def stats_percentiles(spark, folder):
    out = groups.stats(scan(spark, folder, "lineitem"), "l_extendedprice")
    return out.select("count", F.round("sum", 2).alias("sum"), *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")])


@query("select cast(floor(o_totalprice / 5000) * 5000 as bigint) as key, count(*) as count from orders group by 1 having count(*) >= 15")
def histogram(spark, folder):
    return groups.histogram(scan(spark, folder, "orders"), "o_totalprice", 5000, 15).withColumn("key", F.col("key").cast("long"))


@query("select unnest(['total', 'F', 'O']) as key, unnest([count(*), count(*) filter (o_orderstatus = 'F'), count(*) filter (o_orderstatus = 'O')]) as count from orders where o_totalprice > 100000")
def filters_view_counts(spark, folder):
    status = F.col("o_orderstatus")
    return groups.value_counts(scan(spark, folder, "orders").filter("o_totalprice > 100000"), {"F": status == "F", "O": status == "O"})


# Order, pages, samples.


@query(f"with {NULLABLE} select o_orderkey, o_totalprice, o_orderstatus from nullable order by o_orderstatus desc nulls last, o_totalprice nulls last, o_orderkey limit 100")
def sort_multi(spark, folder):
    return paging.page(nullable_orders(spark, folder), paging.sort_keys("o_orderstatus:desc,o_totalprice"), "o_orderkey", 1, 100).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def page_offset(spark, folder):
    return paging.page(scan(spark, folder, "orders"), [("o_totalprice", True)], "o_orderkey", 3).select("o_orderkey", "o_totalprice")


@query(f"with {NULLABLE} select o_orderkey, o_totalprice from nullable where o_totalprice < 150000 or o_totalprice is null or (o_totalprice = 150000 and o_orderkey > 100) order by o_totalprice desc nulls last, o_orderkey limit 25")
def page_keyset(spark, folder):
    return paging.keyset_page(nullable_orders(spark, folder), [("o_totalprice", True)], "o_orderkey", paging.encoded([150000.0, 100])).select("o_orderkey", "o_totalprice")


@query("select o_orderkey from orders order by md5('42|' || o_orderkey), o_orderkey limit 50")
def sample_seeded(spark, folder):
    return paging.sample(scan(spark, folder, "orders"), 50, "o_orderkey", "42").select("o_orderkey")


@query()
def random_one(spark, folder):
    return paging.any_row(scan(spark, folder, "customer"))


@query("select o_orderkey, o_totalprice from orders")
def select_columns(spark, folder):
    return paging.selected(scan(spark, folder, "orders"), ["o_orderkey", "o_totalprice"])


TABLES = tuple(catalog.ENTITIES)


@query(" union all ".join(f"select '{t}' as entity, count(*) as count from {t}" for t in TABLES))
def entity_counts(spark, folder):
    return catalog.counts(spark, folder)


@query()
def column_catalog(spark, folder):
    return spark.createDataFrame(catalog.properties(nested_orders(spark, folder)), "name string, type string, abilities array<string>")


# Joins.


@query("select s_nationkey as key, count(*) as count, n_name as key_display_name from supplier join nation on s_nationkey = n_nationkey group by 1, 3")
def join_names(spark, folder):
    return joins.with_names(groups.terms(scan(spark, folder, "supplier"), "s_nationkey"), "key", scan(spark, folder, "nation"), "n_nationkey", "n_name")


@query("select 'nation' as entity, cast(n_nationkey as varchar) as id, n_name as display_name from nation union all select 'region', cast(r_regionkey as varchar), r_name from region")
def join_name_union(spark, folder):
    return joins.union_of({"nation": (scan(spark, folder, "nation"), "n_nationkey", "n_name"), "region": (scan(spark, folder, "region"), "r_regionkey", "r_name")})


def collections(spark: SparkSession) -> DataFrame:
    rows = [("col_a", "customer", str(k)) for k in (1, 5, 7, 11, 99, 10**9)] + [("col_b", "part", "3")]
    return spark.createDataFrame(rows, "collection_id string, entity_type string, entity_id string")


@query("select o_orderkey from orders where o_custkey in (1, 5, 7, 11, 99, 1000000000)")
def semi_collection(spark, folder):
    return joins.in_collection(scan(spark, folder, "orders"), "o_custkey", collections(spark), "col_a", "customer").select("o_orderkey")


@query("select o_orderkey from orders where o_custkey not in (1, 5, 7, 11, 99, 1000000000)")
def anti_collection(spark, folder):
    return joins.in_collection(scan(spark, folder, "orders"), "o_custkey", collections(spark), "col_a", "customer", negated=True).select("o_orderkey")


EDGES = "edges as (select distinct a.l_partkey as source, b.l_partkey as target from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey where a.l_partkey = 7)"


@query(f"with {EDGES} select p_partkey from part where p_partkey in (select target from edges)")
def cited_by_analogue(spark, folder):
    lines = scan(spark, folder, "lineitem")
    pairs = lines.select("l_orderkey", F.col("l_partkey").alias("source")).filter("source = 7").join(lines.select("l_orderkey", F.col("l_partkey").alias("target")), "l_orderkey").filter("source <> target")
    return joins.named_by(scan(spark, folder, "part"), "p_partkey", pairs, "source", "target", 7).select("p_partkey")


@query("select c_custkey, case c_nationkey when 3 then 4 when 5 then 4 else c_nationkey end as c_nationkey from customer")
def merge_redirect(spark, folder):
    aliases = spark.createDataFrame([(3, 4), (5, 4)], "old int, new int")
    return joins.redirected(scan(spark, folder, "customer"), "c_nationkey", aliases, "old", "new").select("c_custkey", "c_nationkey")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as p from events) where p = 1")
def dedupe_latest(spark, folder):
    return joins.newest(scan(spark, folder, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("select 'customer' as entity, c_custkey as id, c_name as name from customer union all select 'supplier', s_suppkey, s_name from supplier")
def multi_index_union(spark, folder):
    rename = lambda t, k, n: t.select(F.col(k).alias("id"), F.col(n).alias("name"))
    return joins.union_all({"customer": rename(scan(spark, folder, "customer"), "c_custkey", "c_name"), "supplier": rename(scan(spark, folder, "supplier"), "s_suppkey", "s_name")}).select("entity", "id", "name")


@query("select n_regionkey as ancestor, count(*) as n from nation group by 1")
def tree_descendants(spark, folder):
    edges = scan(spark, folder, "nation").select((F.col("n_regionkey") - 1000).alias("p"), F.col("n_nationkey").alias("c"))
    return joins.descendants(edges, "p", "c").select((F.col("ancestor") + 1000).alias("ancestor"), "n")


@query("select n_nationkey as ancestor, (select count(*) from nation m where m.n_nationkey > n.n_nationkey) as n from nation n where n_nationkey < 24")
def tree_descendants_deep(spark, folder):
    """A chain of the 25 nations."""
    edges = scan(spark, folder, "nation").filter("n_nationkey > 0").select((F.col("n_nationkey") - 1).alias("p"), F.col("n_nationkey").alias("c"))
    return joins.descendants(edges, "p", "c")


@query("select c_custkey, c_acctbal from customer where c_custkey % 3 <> 0 union all select c_custkey, c_acctbal + 1 from customer where c_custkey % 3 = 0")
def upsert_rows(spark, folder):
    df = scan(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return tables.upserted(df, df.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


# Text.

TOKENS = r"toks as (select doc_id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as t, n_chars from documents)"
JOINED = TOKENS + ", j as (select *, ' ' || array_to_string(t, ' ') || ' ' as s from toks)"


@query(f"with {TOKENS} select doc_id from toks where list_contains(t, 'the') and list_contains(t, 'of')")
def search_and(spark, folder):
    return search.search(scan(spark, folder, "documents"), ["text"], "the of").select("doc_id")


@query(f"with {JOINED} select doc_id from j where contains(s, ' of the ')")
def search_phrase(spark, folder):
    return search.search(scan(spark, folder, "documents"), ["text"], '"of the"').select("doc_id")


@query(f"with {JOINED} select doc_id from j where contains(s, ' of th')")
def search_prefix(spark, folder):
    return scan(spark, folder, "documents").filter(words.has_phrase_prefix(F.col("text"), "of th")).select("doc_id")


@query(rf"with {JOINED} select doc_id from j where regexp_matches(s, ' ing[\p{{L}}\p{{N}}]*ed ')")
def search_wildcard(spark, folder):
    return search.search(scan(spark, folder, "documents"), ["text"], "ing*ed").select("doc_id")


@query(f"with {TOKENS} select doc_id from toks where (list_contains(t, 'the') or list_contains(t, 'der')) and not list_contains(t, 'und')")
def search_boolean(spark, folder):
    tree = search.Either("and", (search.Either("or", (search.Word("the"), search.Word("der"))), search.Either("not", (search.Word("und"),))))
    return search.search(scan(spark, folder, "documents"), ["text"], tree).select("doc_id")


@query(f"with {TOKENS} select doc_id from toks where len(list_filter(t, lambda x: regexp_full_match(x, '.?tion|t.?ion|ti.?on|tio.?n|tion.|.ion|t.on|ti.n|tio.|ion|ton|tin|tio'))) > 0")
def search_fuzzy(spark, folder):
    return search.search(scan(spark, folder, "documents"), ["text"], "tion~1").select("doc_id")


FIELDS = r"""f as (select doc_id, n_chars, string_split(text, chr(10))[1] as title, coalesce(text[length(string_split(text, chr(10))[1]) + 2:], '') as body from documents),
    ft as (select *, list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> '') as tt, list_filter(string_split_regex(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '') as bt from f)"""


def two_fields(spark, folder):
    first = F.split("text", "\n")[0]
    return scan(spark, folder, "documents").select("doc_id", "n_chars", first.alias("title"), F.substring(F.col("text"), F.length(first) + 2, F.length("text")).alias("body"))


@query(f"with {FIELDS} select doc_id from ft where list_contains(list_concat(tt, bt), 'the') and list_contains(list_concat(tt, bt), 'with')")
def search_cross_field(spark, folder):
    return search.across(two_fields(spark, folder), ["title", "body"], "the with").select("doc_id")


@query(f"""with {FIELDS}, s as (select doc_id, n_chars,
        (case when list_contains(tt, 'of') and list_contains(tt, 'the') then 1.0 else 0 end) + (case when contains(' ' || array_to_string(tt, ' ') || ' ', ' of the ') then 2.0 else 0 end)
        + (case when list_contains(bt, 'of') and list_contains(bt, 'the') then 0.1 else 0 end) + (case when contains(' ' || array_to_string(bt, ' ') || ' ', ' of the ') then 0.15 else 0 end) as raw
        from ft where list_contains(list_concat(tt, bt), 'of') and list_contains(list_concat(tt, bt), 'the'))
    select doc_id, round(cast(greatest(raw, 0.01) * (case when n_chars > 0 then 1 + sqrt(n_chars) else 0.5 end) as double), 4) as score from s""")
def search_ranked(spark, folder):
    return search.ranked(two_fields(spark, folder), {"title": "primary", "body": "secondary"}, "of the", "n_chars").select("doc_id", F.round("score", 4).alias("score"))


POSITIONS = TOKENS + ", p as (select doc_id, unnest(t) as w, generate_subscripts(t, 1) as at from toks)"


@query(f"with {POSITIONS} select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id where a.w = 'the' and b.w = 'of' and a.at <> b.at and abs(a.at - b.at) - 1 <= 3")
def search_proximity(spark, folder):
    return search.near(scan(spark, folder, "documents"), "text", ["the", "of"], 3).select("doc_id")


@query(f"""with {POSITIONS}, ph as (select a.doc_id, a.at from p a join p b on a.doc_id = b.doc_id and b.at = a.at + 1 where a.w = 'of' and b.w = 'the')
    select distinct ph.doc_id from ph join p on ph.doc_id = p.doc_id where p.w = 'and' and p.at > ph.at + 1 and p.at - ph.at - 2 <= 8""")
def search_proximity_ordered(spark, folder):
    return search.near(scan(spark, folder, "documents"), "text", ["of the", "and"], 8, ordered=True).select("doc_id")


@query(f"""with {POSITIONS} select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id join p c on a.doc_id = c.doc_id where a.w = 'the' and b.w = 'of' and c.w = 'and'
    and greatest(a.at, b.at, c.at) - least(a.at, b.at, c.at) - 2 <= 6""")
def search_proximity_three(spark, folder):
    return search.near(scan(spark, folder, "documents"), "text", ["the", "of", "and"], 6).select("doc_id")


@query(r"select doc_id, regexp_replace(text, '(?i)\b(worthless)\b', '>>\1<<', 'g') as text from documents where contains(lower(text), 'worthless')")
def search_highlight(spark, folder):
    df = scan(spark, folder, "documents").filter(F.contains(F.lower("text"), F.lit("worthless")))
    return df.select("doc_id", words.highlighted(F.col("text"), ["worthless"]).alias("text"))


@query(r"select doc_id, len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as n_tokens from documents")
def token_count(spark, folder):
    return scan(spark, folder, "documents").select("doc_id", F.size(words.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("select doc_id, strip_accents(text) as text from documents")
def fold_marks(spark, folder):
    return scan(spark, folder, "documents").select("doc_id", words.folded(F.col("text")).alias("text"))


# Vectors.

Q0 = "q as (select embedding as v from embeddings where vec_id = 0)"
COSINE = "list_sum(list_transform(list_zip(embedding, v), lambda x: cast(x[1] as double) * x[2])) / sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) / sqrt(list_sum(list_transform(v, lambda x: cast(x as double) * x)))"


def first_vector(spark, folder) -> list[float]:
    return lookup.by_id(scan(spark, folder, "embeddings"), "vec_id", 0).first().embedding


@query(f"with {Q0} select vec_id, round({COSINE}, 6) as score from embeddings, q order by {COSINE} desc, vec_id limit 10")
def knn_topk(spark, folder):
    return vectors.nearest(scan(spark, folder, "embeddings"), "vec_id", "embedding", first_vector(spark, folder)).select("vec_id", F.round("score", 6).alias("score"))


@query(f"with {Q0} select vec_id, round({COSINE}, 6) as score from embeddings, q where label in (1, 2, 3) order by {COSINE} desc, vec_id limit 10")
def knn_prefilter(spark, folder):
    return vectors.nearest(scan(spark, folder, "embeddings"), "vec_id", "embedding", first_vector(spark, folder), where=F.col("label").isin(1, 2, 3)).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""with {Q0}, h as (select vec_id, label, {COSINE} as s from embeddings, q order by s desc, vec_id limit 50)
    select vec_id, round(s * (1 + 0.5 * greatest(0, least(1, (s - 0.5) / 0.5)) * (label * 20) / (label * 20 + 100.0)), 6) as score from h""")
def knn_rescore(spark, folder):
    hits = vectors.nearest(scan(spark, folder, "embeddings"), "vec_id", "embedding", first_vector(spark, folder), 50).withColumn("count", F.col("label") * 20)
    return vectors.rescored(hits, "vec_id", "count").select("vec_id", F.round("score", 6).alias("score"))


@query(f"""with {Q0}, h as (select vec_id, {COSINE} as s from embeddings, q order by s desc, vec_id limit 10)
    select vec_id, round(s, 6) as score from h union all select vec_id, (select round(quantile_cont(s, 0.5), 6) from h) from embeddings where vec_id < 5 and vec_id not in (select vec_id from h)""")
def knn_injected(spark, folder):
    df = scan(spark, folder, "embeddings")
    hits = vectors.nearest(df, "vec_id", "embedding", first_vector(spark, folder)).select("vec_id", "score")
    return vectors.with_injected(hits, df.filter("vec_id < 5").select("vec_id"), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


# Lookup.


@query(r"""with o as (select o_custkey, count(*) as n from orders group by 1)
    select c_custkey, round(cast((case when lower(c_name) = 'customer#0000' then 2000000 else 0 end) + 1000000 + ln(1 + coalesce(n, 0)) as double), 6) as score
    from customer left join o on o_custkey = c_custkey where contains(' ' || array_to_string(list_filter(string_split_regex(lower(c_name), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ', ' customer 0000')
    order by 2 desc, 1 limit 10""")
def autocomplete_tiers(spark, folder):
    popular = scan(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    df = scan(spark, folder, "customer").join(popular, F.col("o_custkey") == F.col("c_custkey"), "left")
    return lookup.completions(df, "c_custkey", "c_name", "Customer#0000", F.col("n")).select("c_custkey", F.round("score", 6).alias("score"))


@query("select p_type, count(*) as n from part where starts_with(lower(p_type), 'eco') or starts_with(lower(p_type), 'sta') group by 1")
def suggest_prefix(spark, folder):
    df = scan(spark, folder, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return lookup.suggestions(df, "p_type", "n", "eco", 1000).union(lookup.suggestions(df, "p_type", "n", "sta", 1000))


@query("select o_orderkey, o_totalprice from orders where o_orderkey = 77")
def lookup_id(spark, folder):
    return lookup.by_id(scan(spark, folder, "orders"), "o_orderkey", 77).select("o_orderkey", "o_totalprice")


@query("select distinct o_orderkey from orders join lineitem on l_orderkey = o_orderkey where l_partkey = 12")
def lookup_external_id(spark, folder):
    return lookup.by_external_id(scan(spark, folder, "orders"), "o_orderkey", scan(spark, folder, "lineitem"), "l_partkey", "l_orderkey", 12).select("o_orderkey")


@query("select event_id, try_cast(props->>'$.k' as bigint) as k from events")
def json_decode_map(spark, folder):
    return scan(spark, folder, "events").select("event_id", F.from_json("props", "map<string,bigint>")["k"].alias("k"))


@query("""select * from (values ('https://doi.org/10.1234/ABC', '10.1234/abc', null), ('0000-0002-1825-0097', null, '0000-0002-1825-0097'), ('none', null, null)) t(raw, doi, orcid)""")
def identifiers(spark, folder):
    df = spark.createDataFrame([("https://doi.org/10.1234/ABC",), ("0000-0002-1825-0097",), ("none",)], "raw string")
    return df.select("raw", ids.identifier("doi", F.col("raw")).alias("doi"), ids.identifier("orcid", F.col("raw")).alias("orcid"))


@query("""select '{"n_nationkey":' || n_nationkey || ',"n_name":' || to_json(n_name) || ',"n_regionkey":' || n_regionkey || '}' as json from nation""")
def json_rows(spark, folder):
    return tables.as_json(scan(spark, folder, "nation"))


@query("select n_nationkey, rank() over (order by n_name) as place from nation")
def rank_page(spark, folder):
    """Places on a page; only ever over a page's few rows."""
    page = paging.page(scan(spark, folder, "nation"), [("n_name", False)], "n_nationkey", 1, 200)
    return page.select("n_nationkey", F.rank().over(Window.orderBy("n_name")).alias("place"))


# Shapes of results.


@query(f"with {TOKENS} select doc_id, array_to_string(t, ' ') as text from toks where len(t) > 0")
def decode_positions(spark, folder):
    """Word positions as JSON, decoded into text again."""
    # A filter on the positions would be moved below them and have them made twice: texts without a word go before.
    df = scan(spark, folder, "documents").filter(F.lower("text").rlike(words.WORD_CHARACTER))
    df = tables.positions_of_words(df.select("doc_id", tables.index_of_words(words.tokens(F.col("text"))).alias("index")), "index", "positions")
    return df.select("doc_id", tables.text_of_positions("positions").alias("text"))


@query("select o_orderkey, cast(count(l_orderkey) filter (l_returnflag <> 'R') as integer) as n_lines from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def scrub_elements(spark, folder):
    return tables.with_elements(nested_orders(spark, folder), "lines", lambda x: x["l_returnflag"] != "R", "n_lines").select("o_orderkey", "n_lines")


@query("select r_regionkey, case r_name when 'ASIA' then 'Asia and Pacific' else r_name end as r_name from region")
def override_names(spark, folder):
    return tables.overridden(scan(spark, folder, "region").withColumn("k", F.col("r_name")), "k", "r_name", {"ASIA": "Asia and Pacific"}).select("r_regionkey", "r_name")


@query("select s_suppkey, s_name || ' (' || n_name || ', ' || r_name || ')' as hint from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def completion_hint(spark, folder):
    df = joins.with_names(scan(spark, folder, "supplier"), "s_nationkey", scan(spark, folder, "nation").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("n")), "n_nationkey", "n", "n")
    df = joins.with_names(df.withColumn("r", F.col("n.n_regionkey")), "r", scan(spark, folder, "region"), "r_regionkey", "r_name", "region")
    return df.select("s_suppkey", F.concat("s_name", F.lit(" ("), "n.n_name", F.lit(", "), "region", F.lit(")")).alias("hint"))


@query("select l_orderkey, l_returnflag as key, count(*) as count from lineitem group by 1, 2")
def map_to_rows(spark, folder):
    """Per order a map of return flags, as rows again."""
    counts = scan(spark, folder, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("key")).agg(F.count("*").alias("count"))
    maps = counts.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("key", "count"))).alias("m"))
    return maps.select("l_orderkey", tables.map_rows("m").alias("x")).select("l_orderkey", "x.key", "x.count")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_partkey in (3, 14, 15))")
def semi_collection_array(spark, folder):
    rows = spark.createDataFrame([("col_p", "part", str(k)) for k in (3, 14, 15)], "collection_id string, entity_type string, entity_id string")
    return joins.in_collection(nested_orders(spark, folder), "lines.l_partkey", rows, "col_p", "part").select("o_orderkey")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_partkey in (3, 14, 15))")
def anti_collection_array(spark, folder):
    rows = spark.createDataFrame([("col_p", "part", str(k)) for k in (3, 14, 15)], "collection_id string, entity_type string, entity_id string")
    return joins.in_collection(nested_orders(spark, folder), "lines.l_partkey", rows, "col_p", "part", negated=True).select("o_orderkey")


@query(rf"with {TOKENS} select doc_id from toks where list_contains(list_transform(t, lambda x: regexp_replace(x, '^(.*?\p{{L}}{{3}})(ations|ation|ingly|edly|ness|ing|ies|ied|ed|ly|es|s)$', '\1')), 'ther')")
def search_stemmed(spark, folder):
    return scan(spark, folder, "documents").filter(words.has_all(words.stems(F.col("text")), ["ther"])).select("doc_id")


@query(rf"with {JOINED} select doc_id from j where contains(strip_accents(s), ' leeau ')")
def search_folded(spark, folder):
    return scan(spark, folder, "documents").filter(words.has_phrase(words.folded(F.col("text")), "leeau")).select("doc_id")


@query()
def search_fragments(spark, folder):
    df = scan(spark, folder, "documents").filter(F.contains(F.lower("text"), F.lit("worthless")))
    return df.select("doc_id", F.explode(words.fragments(F.col("text"), ["worthless"])).alias("fragment"))


@query("select 'nation' as entity, cast(n_nationkey as bigint) as id, n_name as name from nation where n_name ilike 'nation\\_1%' escape '\\' union all select 'region', r_regionkey, r_name from region where r_name ilike 'nation 1%'")
def autocomplete_all(spark, folder):
    rename = lambda t, k, n: t.select(F.col(k).cast("long").alias("id"), F.col(n).alias("name"))
    df = joins.union_all({"nation": rename(scan(spark, folder, "nation"), "n_nationkey", "n_name"), "region": rename(scan(spark, folder, "region"), "r_regionkey", "r_name")})
    return lookup.completions(df, "id", "name", "nation_1", limit=100).select("entity", "id", "name")


@query("select s_suppkey from supplier where lower(s_name) = 'supplier#000000007'")
def lookup_name(spark, folder):
    return lookup.by_name(scan(spark, folder, "supplier"), "s_name", "Supplier#000000007").select("s_suppkey")


@query("select * from (values ('https://example.org/w123', 'W123', 'works'), ('a45', 'A45', 'authors'), ('x', null, null)) t(raw, id, entity)")
def entity_of_id(spark, folder):
    df = spark.createDataFrame([("https://example.org/w123",), ("a45",), ("x",)], "raw string")
    return df.select("raw", ids.entity_id(F.col("raw"), "WA").alias("id"), ids.entity_of(F.col("raw"), {"W": "works", "A": "authors"}).alias("entity"))


@query(f"with {Q0}, h as (select vec_id, {COSINE} as s from embeddings, q order by s desc, vec_id limit 10) select vec_id, text from h join documents on doc_id = vec_id")
def knn_documents(spark, folder):
    """The texts of the nearest vectors: a join of ten rows."""
    hits = vectors.nearest(scan(spark, folder, "embeddings"), "vec_id", "embedding", first_vector(spark, folder)).select("vec_id")
    return hits.join(scan(spark, folder, "documents"), F.col("doc_id") == F.col("vec_id")).select("vec_id", "text")


# Terms, days, ids and collections in query objects.

WORKS = "works as (select 'W' || lpad(cast(o_orderkey as varchar), 6, '0') as id, case when o_orderkey % 2 = 0 then o_orderpriority else lower(o_orderpriority) end as priority, o_orderdate, o_orderkey from orders)"
WORK = catalog.Entity("works", "id", (("o_orderkey", False),), schemes={"id": "W"})


def works(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with ids and with priorities in mixed case."""
    priority = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    return scan(spark, folder, "orders").select(F.concat(F.lit("W"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")).alias("id"), priority.alias("priority"), "o_orderdate", "o_orderkey")


def works_where(spark: SparkSession, folder: str, raw: dict, collections: DataFrame | None = None) -> DataFrame:
    df = works(spark, folder)
    return df.filter(compiled(in_any_case(plans.tree(raw, WORK, df.schema, collections), df.schema, WORK.codes), df.schema)).select("id")


@query(f"with {WORKS} select id from works where lower(priority) in ('1-urgent', '2-high')")
def filter_term_fold(spark, folder):
    return works_where(spark, folder, {"column_id": "priority", "operator": "in", "value": ["1-Urgent", "2-HIGH"]})


@query("select o_orderkey from orders where cast(o_orderdate as date) = (select cast(min(o_orderdate) as date) from orders) or cast(o_orderdate as date) = date '1995-06-17'")
def filter_day(spark, folder):
    df = scan(spark, folder, "orders")
    first = str(df.agg(F.min("o_orderdate")).first()[0])[:10]
    return ids_where(df, Leaf("o_orderdate", (first, "1995-06-17"), "in"), "o_orderkey")


@query(f"with {WORKS} select id from works where id in ('W000003', 'W000007', 'W000009')")
def filter_id_forms(spark, folder):
    return works_where(spark, folder, {"column_id": "id", "operator": "in", "value": ["https://example.org/w000003", " W000007", "works/w000009"]})


@query(f"with {WORKS} select id from works where id in ('W000001', 'W000002', 'W000004') or not (lower(priority) = '1-urgent' or id in ('W000001', 'W000002', 'W000004', 'W000005'))")
def query_collection(spark, folder):
    """A collection among other conditions, and its complement."""
    rows = [("mine", "works", f"W00000{k}") for k in (1, 2, 4)] + [("other", "works", f"W00000{k}") for k in (1, 2, 4, 5)]
    collections = spark.createDataFrame(rows, "collection_id string, entity_type string, entity_id string")
    member = lambda name, negated: {"column_id": "id", "operator": "in collection", "value": name, "is_negated": negated}
    rest = {"join": "and", "filters": [{"column_id": "priority", "value": "1-urgent", "is_negated": True}, member("other", True)]}
    return works_where(spark, folder, {"join": "or", "filters": [member("mine", False), rest]}, collections)


@query("select count(*) as count from documents where list_contains(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), 'the') and lower(lang) = 'en'")
def query_total(spark, folder):
    return plans.total(spark, folder, {"get_rows": "documents", "search": "the", "filter_rows": [{"column_id": "lang", "value": "EN"}]})


# Search texts.


@query(f"""with {POSITIONS} select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id where a.w = 'of' and b.w = 'the'
    and greatest(a.at, b.at - 1) - least(a.at, b.at - 1) <= 3""")
def search_slop(spark, folder):
    return search.search(scan(spark, folder, "documents"), ["text"], '"of the"~3').select("doc_id")


@query(f"""with {POSITIONS} select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id where a.w = 'and' and b.w = 'that' and a.at <> b.at and abs(a.at - b.at) - 1 <= 4""")
def search_near_text(spark, folder):
    return search.search(scan(spark, folder, "documents"), ["text"], '"and"~4~"that"').select("doc_id")


@query(f"with {TOKENS} select doc_id from toks where (list_contains(t, 'the') and list_contains(t, 'with') and not list_contains(t, 'for')) or list_contains(t, 'und')")
def search_boolean_text(spark, folder):
    return search.search(scan(spark, folder, "documents"), ["text"], "the AND with NOT for OR und").select("doc_id")


@query(f"with {TOKENS} select doc_id from toks where list_contains(t, 'the') and len(list_filter(t, lambda x: levenshtein(x, 'whith') <= 1)) > 0 and regexp_matches(' ' || array_to_string(t, ' ') || ' ', ' tha[\\p{{L}}\\p{{N}}]* ')")
def search_mixed_terms(spark, folder):
    return search.search(scan(spark, folder, "documents"), ["text"], "the whith~1 tha*").select("doc_id")


@query(f"with {FIELDS} select doc_id from ft where (list_contains(tt, 'the') or list_contains(bt, 'the')) and not (list_contains(tt, 'with') or list_contains(bt, 'with'))")
def search_not_columns(spark, folder):
    return search.search(two_fields(spark, folder), ["title", "body"], "the NOT with").select("doc_id")


@query(f"""with {FIELDS}, three as (select doc_id, tt, list_filter(bt, lambda x: len(x) <= 4) as bt, list_filter(bt, lambda x: len(x) > 2) as ct from ft)
    select doc_id, round(cast(greatest((case when list_contains(tt, 'of') and list_contains(tt, 'the') then 1.5 else 0 end) + (case when contains(' ' || array_to_string(tt, ' ') || ' ', ' of the ') then 3.0 else 0 end)
        + (case when list_contains(bt, 'of') and list_contains(bt, 'the') then 0.3 else 0 end) + (case when contains(' ' || array_to_string(bt, ' ') || ' ', ' of the ') then 0.5 else 0 end)
        + (case when list_contains(ct, 'of') and list_contains(ct, 'the') then 0.05 else 0 end) + (case when contains(' ' || array_to_string(ct, ' ') || ' ', ' of the ') then 0.1 else 0 end), 0.005) as double), 4) as score
    from three where list_contains(list_concat(tt, bt, ct), 'of') and list_contains(list_concat(tt, bt, ct), 'the')""")
def search_three_fields(spark, folder):
    df = two_fields(spark, folder)
    short, long = (F.array_join(F.filter(words.tokens(F.col("body")), f), " ") for f in (lambda x: F.length(x) <= 4, lambda x: F.length(x) > 2))
    df = df.select("doc_id", "title", short.alias("body"), long.alias("full"))
    return search.ranked(df, {"title": "primary", "body": "secondary", "full": "tertiary"}, "of the").select("doc_id", F.round("score", 4).alias("score"))


# Pages, buckets, suggestions.


@query("select conv_id, turn, role from conversations")
def page_keyset_ties(spark, folder):
    """All pages of a table whose order has many ties, united: every row once."""
    df = scan(spark, folder, "conversations").select("conv_id", "turn", "role")
    e, out, cursor, keys = catalog.entity("conversations"), None, "*", [("role", False)]
    per_page = 1 + df.count() // 4
    while cursor:
        page = paging.keyset_page(df, keys, e.unique, cursor, per_page)
        last = page.orderBy(*[F.desc(c) for c in ("role", "conv_id", "turn")]).select("role", "conv_id", "turn").first()
        out = page if out is None else out.union(page)
        cursor = paging.encoded(list(last)) if last is not None else None
    return out


@query("select 'https://example.org/' || key as key, cast(sum(count) as bigint) as count from (select lower(o_orderpriority) as key, count(*) as count from orders where o_orderkey % 2 = 0 group by 1 union all select lower(o_orderpriority), count(*) from orders where o_orderkey % 2 = 1 group by 1) where key like '1%' or key like '2%' group by 1")
def group_keys_formatted(spark, folder):
    """Keys in one spelling, as addresses, those of equal keys added, only some beginnings kept."""
    buckets = groups.terms(works(spark, folder), "priority").withColumn("key", F.lower("key"))
    return groups.addressed(groups.merged(groups.beginning(buckets, "1", "2")), "https://example.org/")


@query("select count(distinct o_custkey) as groups_count from orders")
def groups_count(spark, folder):
    return groups.groups_count(scan(spark, folder, "orders"), "o_custkey")


@query("select o_orderpriority as key, count(*) as count from orders where lower(o_orderpriority) like '%high%' group by 1 order by 2 desc, 1 limit 10")
def suggest_filter_values(spark, folder):
    return lookup.value_suggestions(scan(spark, folder, "orders"), "o_orderpriority", "hi")


@query("select n_name as key, cast(count(*) as bigint) as count from customer join nation on n_nationkey = c_nationkey where contains(lower(n_name), 'nation_1') group by 1 order by 2 desc, 1 limit 10")
def suggest_nations(spark, folder):
    """Nations by name, those with most customers first."""
    df = joins.with_names(scan(spark, folder, "customer"), "c_nationkey", scan(spark, folder, "nation"), "n_nationkey", "n_name", "nation")
    return lookup.value_suggestions(df, "nation", "nation 1")


@query("select n_name, round(sum(c_acctbal), 2) as total from customer join nation on n_nationkey = c_nationkey group by 1")
def sum_per_nation(spark, folder):
    """Sums by key, with names: a grouping that is kept as a table of its own."""
    sums = groups.terms(scan(spark, folder, "customer"), "c_nationkey", metric=("sum", "c_acctbal"))
    named = joins.with_names(sums, "key", scan(spark, folder, "nation"), "n_nationkey", "n_name", "n_name")
    return named.select("n_name", F.round("sum_c_acctbal", 2).alias("total"))


@query(f"with {Q0}, h as (select vec_id, {COSINE} as s from embeddings, q order by s desc, vec_id limit 10) select vec_id, round(s * case when vec_id % 5 <= 1 then 0.5 else 1 + ln(vec_id % 5) end, 5) as score from h")
def knn_log_rescore(spark, folder):
    hits = vectors.nearest(scan(spark, folder, "embeddings"), "vec_id", "embedding", first_vector(spark, folder)).withColumn("cited", F.col("vec_id") % 5)
    return vectors.log_rescored(hits, "vec_id", "cited").select("vec_id", F.round("score", 5).alias("score"))


@query(r"select doc_id from documents where len(list_filter(string_split(text, chr(10)), lambda line: list_contains(string_split_regex(lower(line), '[^\p{L}\p{N}]+'), 'the') and list_contains(string_split_regex(lower(line), '[^\p{L}\p{N}]+'), 'with'))) > 0")
def search_one_element(spark, folder):
    df = scan(spark, folder, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return search.in_one_element(df, "lines", "the with").select("doc_id")


@query(f"with {NESTED} select o_orderkey, flags[:2] as flags, len(flags) > 2 as more from (select o_orderkey, list_sort(flags) as flags from nested) t where flags is not null")
def truncate_arrays(spark, folder):
    df = nested_orders(spark, folder).filter("lines is not null").select("o_orderkey", F.array_sort(F.array_distinct("lines.l_returnflag")).alias("flags"))
    return tables.truncated(df, "flags", 2, "more")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'https://example.org/orders/' || o_orderkey || '.pdf' end as url from orders")
def content_links(spark, folder):
    return tables.linked(scan(spark, folder, "orders"), "url", F.col("o_orderstatus") == "F", "https://example.org/orders/", "o_orderkey", ".pdf").select("o_orderkey", "url")


@query("select c_nationkey as key, count(*) as count, n_name as key_display_name from customer join nation on n_nationkey = c_nationkey group by 1, 3 order by 2 desc, 1 limit 10")
def group_with_names(spark, folder):
    return plans.run(spark, folder, {"get_rows": "customer", "group_by": [{"column_id": "c_nationkey"}], "per_page": 10})


@query("select o_orderkey from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 25")
def sort_year_by_date(spark, folder):
    return plans.run(spark, folder, {"get_rows": "orders", "filter_rows": [{"column_id": "status", "value": "f"}], "sort_by": [{"column_id": "year", "direction": "desc"}], "select": ["o_orderkey"]})
