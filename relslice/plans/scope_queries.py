"""Scans, samples, guards and scopes (groups A and C of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import STAR, Dataset, ForeignKey, TableSpec
from ..operators import graph, scope
from ..sources.tables import dataset, staged, table, table_or_none
from .derived import EDGES, HIERARCHY, ROOT, TIGHT, derive, plain
from .registry import ORACLES, query

COUNTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "no_such_table"]
SAMPLE, CAP = 100, 10_000


@query(f"SELECT o_orderkey FROM orders WHERE {ROOT}")
def scope_root(spark, sf):
    return scope.scan_ids(table(spark, sf, "orders"), "o_orderkey", ROOT)


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 1000")
def scan_projected(spark, sf):
    return scope.scan(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"], "o_totalprice > 1000")


@query(f"SELECT count(*) AS n FROM orders WHERE {ROOT}")
def count_where(spark, sf):
    return scope.count_where(table(spark, sf, "orders"), ROOT)


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in COUNTED[:-1]) + " UNION ALL SELECT 'no_such_table', NULL")
def row_counts(spark, sf):
    """A table that cannot be read has a null count."""
    parts = []
    for name in COUNTED:
        df = table_or_none(spark, sf, name)
        parts.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit(None).cast("bigint").alias("n")) if df is None else df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n"))
    return reduce(DataFrame.union, parts)


@query(f"SELECT o_orderkey FROM orders WHERE {ROOT} ORDER BY o_orderkey LIMIT {SAMPLE}")
def scope_root_sample(spark, sf):
    return scope.sample_ids(table(spark, sf, "orders"), "o_orderkey", ROOT, SAMPLE)


@query(
    f"SELECT least(n, {CAP + 1}) AS matched, CAST({CAP} AS BIGINT) AS cap, CASE WHEN n = 0 THEN 'empty' WHEN n > {CAP} THEN 'over-cap' ELSE 'ok' END AS status FROM (SELECT count(*) AS n FROM orders WHERE {ROOT}) c"
)
def scope_guard(spark, sf):
    return scope.guard(table(spark, sf, "orders"), "o_orderkey", ROOT, CAP)


_SAMPLED = f"SELECT o_orderkey FROM orders WHERE {ROOT} ORDER BY o_orderkey LIMIT {SAMPLE}"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN ({_SAMPLED})")
def scope_sample_children(spark, sf):
    """Children of exactly the sampled roots; the predicate is not asked again."""
    ids = staged(scope.sample_ids(table(spark, sf, "orders"), "o_orderkey", ROOT, SAMPLE), "sample")
    return scope.with_ids(table(spark, sf, "lineitem"), "l_orderkey", ids).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_ROOTS = f"SELECT o_orderkey FROM orders WHERE {ROOT}"


@query(f"SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {ROOT})")
def scope_direct_parent(spark, sf):
    return scope.parent_of(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders").where(ROOT), "o_custkey").select("c_custkey", "c_name", "c_nationkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN ({_ROOTS})")
def scope_direct_child(spark, sf):
    ids = scope.scan_ids(table(spark, sf, "orders"), "o_orderkey", ROOT)
    return scope.with_ids(table(spark, sf, "lineitem"), "l_orderkey", ids).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN ({_ROOTS}))")
def scope_child_lookup(spark, sf):
    ids = scope.scan_ids(table(spark, sf, "orders"), "o_orderkey", ROOT)
    lines = scope.with_ids(table(spark, sf, "lineitem"), "l_orderkey", ids)
    return scope.parent_of(table(spark, sf, "part"), "p_partkey", lines, "l_partkey").select("p_partkey", "p_name")


_TIGHT_NATIONS = f"SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {TIGHT})"


@query(f"SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey IN ({_TIGHT_NATIONS})")
def scope_transitive(spark, sf):
    """Nations two hops and regions three hops up from the root."""
    data = dataset(spark, sf)
    root = data.tables["orders"].where(TIGHT)
    nations = scope.up(data, root, [("o_custkey", "customer"), ("c_nationkey", "nation")])
    regions = scope.up(data, root, [("o_custkey", "customer"), ("c_nationkey", "nation"), ("n_regionkey", "region")])
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query(
    f"SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN ({_TIGHT_NATIONS} UNION SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {TIGHT})))"
)
def scope_union_paths(spark, sf):
    data = dataset(spark, sf)
    roots = data.tables["orders"].where(TIGHT)
    lines = scope.with_ids(data.tables["lineitem"], "l_orderkey", roots.select("o_orderkey"))
    customers, suppliers = scope.up(data, roots, [("o_custkey", "customer")]), scope.up(data, lines, [("l_suppkey", "supplier")])
    return scope.union_by_key(data.tables["nation"], "n_nationkey", [customers.select("c_nationkey"), suppliers.select("s_nationkey")]).select("n_nationkey", "n_name")


@query(
    f"SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {TIGHT}) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7)"
)
def scope_any_path(spark, sf):
    """A table without a key: a row counts once, however many paths reach it, and equal rows stay apart."""
    orders, suppliers = table(spark, sf, "orders").where(TIGHT).select("o_orderkey"), table(spark, sf, "supplier").where("s_nationkey = 7").select("s_suppkey")
    return scope.where_any(table(spark, sf, "lineitem"), [("l_orderkey", orders), ("l_suppkey", suppliers)]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


_LINES = f"lineitem WHERE l_orderkey IN ({_ROOTS})"
_CUSTOMERS = f"customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {ROOT})"
_SUPPLIERS = f"supplier WHERE s_suppkey IN (SELECT l_suppkey FROM {_LINES})"
_NATIONS = f"nation WHERE n_nationkey IN (SELECT c_nationkey FROM {_CUSTOMERS} UNION SELECT s_nationkey FROM {_SUPPLIERS})"
COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{kind}' AS kinds, count(*) AS n FROM {rows}"
    for name, kind, rows in (
        ("orders", "root", f"orders WHERE {ROOT}"),
        ("customer", "direct-parent", _CUSTOMERS),
        ("lineitem", "direct-child", _LINES),
        ("part", "child-lookup", f"part WHERE p_partkey IN (SELECT l_partkey FROM {_LINES})"),
        ("supplier", "child-lookup", _SUPPLIERS),
        ("nation", "transitive", _NATIONS),
        ("region", "transitive", f"region WHERE r_regionkey IN (SELECT n_regionkey FROM {_NATIONS})"),
    )
)


@query(COUNTS_SQL)
def scope_counts(spark, sf):
    """Rows in scope per table for one root; the root's ids are staged once and every path starts from them."""
    data = dataset(spark, sf)
    ids = staged(scope.scan_ids(data.tables["orders"], "o_orderkey", ROOT), "roots")
    return scope.scope_counts(scope.star_scopes(data, ids))


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {ROOT} AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def scope_root_subquery(spark, sf):
    """A root predicate may hold a sub-query."""
    return derive(spark, sf, f"SELECT o_orderkey, o_totalprice FROM {{orders}} WHERE {ROOT} AND o_custkey IN (SELECT c_custkey FROM {{customer}} WHERE c_mktsegment = 'BUILDING')")


_E = f"e AS ({plain(EDGES)})"


@query(
    f"""WITH RECURSIVE {_E}, up(node, depth) AS (SELECT 't12', 0 UNION SELECT e.dst, depth + 1 FROM up JOIN e ON e.src = up.node WHERE depth < 3),
    near AS (SELECT dst AS node, 'direct-parent' AS kind FROM e WHERE src = 't12' AND dst <> 't12' UNION SELECT src, 'direct-child' FROM e WHERE dst = 't12' AND src <> 't12'
      UNION SELECT b.dst, 'child-lookup' FROM e a JOIN e b ON b.src = a.src AND b.field = 'f4' WHERE a.dst = 't12' AND a.src <> 't12' AND b.dst <> 't12' AND b.dst <> b.src)
    SELECT 't12' AS node, 'root' AS kind UNION ALL SELECT node, kind FROM near
    UNION ALL SELECT DISTINCT node, 'transitive' FROM up WHERE node <> 't12' AND node NOT IN (SELECT node FROM near)"""
)
def scope_paths(spark, sf):
    """How tables of the derived catalog belong to one of them; all lookups named f4 are followed from its children."""
    edges = staged(derive(spark, sf, EDGES), "edges")
    lookups = edges.where("field = 'f4'").select(F.col("src").alias("child"), "field").distinct()
    return graph.scope_paths(edges, "t12", lookups, 3)


_ASKED = "SELECT DISTINCT 't' || CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING) AS node FROM {part} WHERE p_size % 2 = 0"


@query(f"SELECT w.node, coalesce(p.kind, 'unknown') AS kind FROM ({plain(_ASKED)}) w LEFT JOIN ({ORACLES['scope_paths']}) p ON p.node = w.node")
def scope_paths_asked(spark, sf):
    """Tables that a run asks for, with their ways to the root; some have none."""
    return graph.paths_of(derive(spark, sf, _ASKED), scope_paths(spark, sf))


# ---- scopes closed over rows

#: Every row that a foreign key of the star schema ties to another, by table; lineitem has no key and is followed from the root.
_STAR_LINKS = """k(a, x, b, y) AS (SELECT 'nation', n_nationkey, 'region', n_regionkey FROM nation UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, 'nation', s_nationkey FROM supplier UNION ALL SELECT 'orders', o_orderkey, 'customer', o_custkey FROM orders)"""
_SOME_SUPPLIERS = "s_nationkey % 5 = 2"
_OF_THEM = f"lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE {_SOME_SUPPLIERS})"
_STAR_CLOSURE = f"""{_STAR_LINKS}, r(t, i) AS (SELECT 'supplier', s_suppkey FROM supplier WHERE {_SOME_SUPPLIERS} UNION SELECT 'orders', l_orderkey FROM {_OF_THEM} UNION SELECT 'part', l_partkey FROM {_OF_THEM}
  UNION SELECT 'supplier', l_suppkey FROM {_OF_THEM} UNION SELECT k.b, k.y FROM r JOIN k ON k.a = r.t AND k.x = r.i)"""


def _of_suppliers(spark, sf):
    data = dataset(spark, sf)
    ids = staged(scope.scan_ids(data.tables["supplier"], "s_suppkey", _SOME_SUPPLIERS), "roots")
    return data, scope.closed(data, scope.scopes(data, "supplier", ids), required=False)


@query(f"WITH RECURSIVE {_STAR_CLOSURE} SELECT t AS table_name, count(*) AS n FROM r GROUP BY t UNION ALL SELECT 'lineitem', count(*) FROM {_OF_THEM}")
def scope_closure_star(spark, sf):
    """Nations are reached from suppliers at once and from customers of their orders three hops later; both count."""
    _, reached = _of_suppliers(spark, sf)
    return scope.scope_counts(reached).select("table_name", "n")


_NESTED = {
    "region": STAR["region"],
    "nation": STAR["nation"],
    "customer": TableSpec("customer", "c_custkey", (ForeignKey("customer", "c_nationkey", ("nation",), required=True), ForeignKey("customer", "first_order", ("orders",), required=True))),
    "orders": TableSpec("orders", "o_orderkey", (ForeignKey("orders", "o_custkey", ("customer",), required=True), ForeignKey("orders", "parent_order", ("orders",), required=True))),
}
_NESTED_ROOT = "o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2001-01-01 00:00:00'"
_NESTED_CLOSURE = f"""c AS ({plain(HIERARCHY["customer"])}), o AS ({plain(HIERARCHY["orders"])}),
  k(a, x, b, y) AS (SELECT 'nation', n_nationkey, 'region', n_regionkey FROM nation UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey FROM c UNION ALL SELECT 'customer', c_custkey, 'orders', first_order FROM c WHERE first_order IS NOT NULL
    UNION ALL SELECT 'orders', o_orderkey, 'customer', o_custkey FROM o UNION ALL SELECT 'orders', o_orderkey, 'orders', parent_order FROM o WHERE parent_order IN (SELECT o_orderkey FROM o)),
  r(t, i) AS (SELECT 'orders', o_orderkey FROM o WHERE {_NESTED_ROOT} UNION SELECT k.b, k.y FROM r JOIN k ON k.a = r.t AND k.x = r.i)"""


def _nested(spark, sf):
    data = Dataset({name: derive(spark, sf, HIERARCHY[name]) if name in HIERARCHY else table(spark, sf, name) for name in _NESTED}, _NESTED)
    ids = scope.scan_ids(data.tables["orders"], "o_orderkey", _NESTED_ROOT)
    return data, scope.closed(data, {"orders": ("root", scope.with_ids(data.tables["orders"], "o_orderkey", ids))})


@query(f"WITH RECURSIVE {_NESTED_CLOSURE} SELECT t AS table_name, CAST(i AS VARCHAR) AS id FROM r")
def scope_closure(spark, sf):
    """Chains within orders, and a cycle between orders and customers, followed to their ends."""
    data, reached = _nested(spark, sf)
    return scope.scope_ids(data, reached)


@query(
    f"""WITH RECURSIVE {_NESTED_CLOSURE} SELECT 'orders' AS table_name, 'parent_order' AS column_name, 'orders' AS target, 'not-in-source' AS reason, count(*) AS n
    FROM o WHERE o_orderkey IN (SELECT i FROM r WHERE t = 'orders') AND parent_order NOT IN (SELECT o_orderkey FROM o) HAVING count(*) > 0"""
)
def scope_dangling(spark, sf):
    """Nothing points to a row out of scope; what the source itself lacks is named."""
    return scope.dangling(*_nested(spark, sf))


@query(
    f"""WITH k AS (SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM {_OF_THEM})), c AS (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM k)))
    SELECT 'customer' AS table_name, 'c_nationkey' AS column_name, 'nation' AS target, 'not-in-scope' AS reason, count(*) AS n FROM c WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE {_SOME_SUPPLIERS}) HAVING count(*) > 0"""
)
def scope_dangling_open(spark, sf):
    """What scopes by names alone leave open: the nations of customers that are reached last."""
    data = dataset(spark, sf)
    ids = staged(scope.scan_ids(data.tables["supplier"], "s_suppkey", _SOME_SUPPLIERS), "roots")
    return scope.dangling(data, scope.scopes(data, "supplier", ids))


@query(f"WITH RECURSIVE {_STAR_CLOSURE} SELECT r.t AS table_name, count(*) AS n FROM r JOIN k ON k.a = r.t AND k.x = r.i LEFT JOIN r s ON s.t = k.b AND s.i = k.y WHERE s.i IS NULL GROUP BY r.t")
def scope_dangling_closed(spark, sf):
    """Closed scopes leave nothing open."""
    data, reached = _of_suppliers(spark, sf)
    return scope.dangling(data, reached, required=False).select("table_name", "n")
