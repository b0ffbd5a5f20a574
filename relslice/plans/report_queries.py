"""Scopes from declarations, noise and child filters, guarded writes, verification through the id map, previews and plan drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mask
from ..model import ForeignKey
from ..operators import catalog, graph, idmap, load, scope, verify
from ..operators.idmap import Rule
from ..sources.tables import dataset, new_folder, staged, table
from .derived import COLUMNS, EDGES, PARTIAL_MAP, ROOT, SALT, TARGET_CUSTOMERS, derive, plain
from .graph_queries import _O, _S, _WALK, CANDIDATE, HOPS, _SCC, C, E, T, columns, edges, root, stops, target_columns, upsert_decisions
from .graph_queries import ROOT as TABLE
from .load_queries import TC, TO_CUSTOMER, _fingerprint_sql, _minted, digest_sql, mint, preset_sql
from .registry import ORACLES, query
from .scope_queries import COUNTS_SQL

# ---- scopes from declarations

_SUPPLIERS = "supplier WHERE s_nationkey % 5 = 2"
_OF_SUPPLIERS = f"lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM {_SUPPLIERS})"
_THEIR_ORDERS = f"orders WHERE o_orderkey IN (SELECT l_orderkey FROM {_OF_SUPPLIERS})"
_THEIR_NATIONS = f"nation WHERE n_nationkey IN (SELECT s_nationkey FROM {_SUPPLIERS})"


@query(
    f"""SELECT 'supplier' AS table_name, 'root' AS kinds, count(*) AS n FROM {_SUPPLIERS} UNION ALL SELECT 'nation', 'direct-parent', count(*) FROM {_THEIR_NATIONS}
    UNION ALL SELECT 'lineitem', 'direct-child', count(*) FROM {_OF_SUPPLIERS} UNION ALL SELECT 'orders', 'child-lookup', count(*) FROM {_THEIR_ORDERS}
    UNION ALL SELECT 'part', 'child-lookup', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM {_OF_SUPPLIERS})
    UNION ALL SELECT 'region', 'transitive', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM {_THEIR_NATIONS})
    UNION ALL SELECT 'customer', 'transitive', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {_THEIR_ORDERS})"""
)
def scope_declared(spark, sf):
    """Another root over the same declarations; nothing but the root's name and predicate is given."""
    data = dataset(spark, sf)
    ids = staged(scope.scan_ids(data.tables["supplier"], "s_suppkey", "s_nationkey % 5 = 2"), "roots")
    return scope.scope_counts(scope.scopes(data, "supplier", ids))


@query(
    f"""SELECT 'supplier' AS table_name, 'root' AS kinds, count(*) AS n FROM {_SUPPLIERS} UNION ALL SELECT 'nation', 'direct-parent', count(*) FROM {_THEIR_NATIONS}
    UNION ALL SELECT 'lineitem', 'direct-child', count(*) FROM {_OF_SUPPLIERS} UNION ALL SELECT 'orders', 'child-lookup', count(*) FROM {_THEIR_ORDERS}"""
)
def scope_declared_one_hop(spark, sf):
    """One hop up, and one named look-up of the children."""
    data = dataset(spark, sf)
    ids = staged(scope.scan_ids(data.tables["supplier"], "s_suppkey", "s_nationkey % 5 = 2"), "roots")
    return scope.scope_counts(scope.scopes(data, "supplier", ids, max_hops=1, lookups={("lineitem", "l_orderkey")}))


@query("SELECT id FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 <> 1 THEN p_name END AS id FROM part) p WHERE id <> ''")
def scan_ids_blank(spark, sf):
    """Null and empty ids do not count."""
    rows = derive(spark, sf, "SELECT CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 <> 1 THEN p_name END AS id FROM {part}")
    return scope.scan_ids(rows, "id")


@query(f"WITH m AS ({plain(PARTIAL_MAP)}) SELECT o_orderkey, m.target_id FROM orders LEFT JOIN m ON m.source_id = CAST(CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS STRING)")
def idmap_lookup(spark, sf):
    rows = derive(spark, sf, "SELECT o_orderkey, 'customer' AS object, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS o_custkey FROM {orders}")
    return idmap.lookup(rows, "object", "o_custkey", derive(spark, sf, PARTIAL_MAP)).select("o_orderkey", "target_id")


@query(
    f"""WITH m AS ({plain(PARTIAL_MAP)}), s AS (SELECT CAST(s_suppkey AS STRING) AS source_id, 'S' || CAST(s_suppkey AS STRING) AS target_id FROM supplier)
    SELECT event_id, coalesce(s.target_id, m.target_id) AS user_id FROM events LEFT JOIN s ON s.source_id = CAST(user_id AS STRING) LEFT JOIN m ON m.source_id = CAST(user_id AS STRING)"""
)
def fk_remap_first_target(spark, sf):
    """A key into several tables without a type: the first declared target that has the id counts."""
    both = derive(spark, sf, PARTIAL_MAP).union(derive(spark, sf, "SELECT 'supplier', CAST(s_suppkey AS STRING), 'S' || CAST(s_suppkey AS STRING) FROM {supplier}"))
    key = ForeignKey("events", "user_id", ("supplier", "customer"), first_declared=True)
    return idmap.remap(table(spark, sf, "events"), "events", "event_id", [Rule(key)], both).select("event_id", "user_id")


_SHARED = "SELECT 'N' || CAST(p_partkey AS STRING) AS id, p_name AS name FROM {part}"


@query(f"SELECT name, count(*) AS n FROM ({plain(_SHARED)}) s GROUP BY name HAVING count(*) > 1")
def natural_key_ambiguous(spark, sf):
    """Names that several target rows hold map nothing, and are reported."""
    return idmap.ambiguous_names(derive(spark, sf, _SHARED), "name")


# ---- catalog

_CHILDREN = """SELECT 't' || CAST(p_partkey % 40 AS STRING) AS parent, 't' || CAST(p_partkey AS STRING) ||
  CASE p_size % 6 WHEN 0 THEN 'History' WHEN 1 THEN 'Feed' WHEN 2 THEN 'Share' WHEN 3 THEN 'ChangeEvent' WHEN 4 THEN '__c' ELSE '' END AS child, p_size % 11 = 0 AS restricted_delete FROM {part}"""
_READ_ONLY = "(" + " OR ".join(f"ends_with(child, '{end}')" for end in graph.READ_ONLY) + " OR restricted_delete)"


@query(f"SELECT parent, count(*) FILTER (NOT {_READ_ONLY}) AS kept, count(*) FILTER ({_READ_ONLY}) AS dropped_read_only FROM ({plain(_CHILDREN)}) c GROUP BY parent")
def child_filter(spark, sf):
    return graph.child_filter(derive(spark, sf, _CHILDREN))


@query(f"WITH {E} SELECT DISTINCT src AS child, field, NOT master_detail AS nillable, master_detail FROM e WHERE dst = 't3' AND src <> 't3' AND src IN (SELECT 't' || CAST(p_partkey AS STRING) FROM part WHERE p_size % 4 <> 1)")
def edges_children_allowed(spark, sf):
    allowed = derive(spark, sf, "SELECT 't' || CAST(p_partkey AS STRING) AS child FROM {part} WHERE p_size % 4 <> 1")
    return graph.child_relationships(derive(spark, sf, EDGES), "t3", allowed)


_LISTED = """SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'ns__' ELSE '' END || CASE p_size % 9 WHEN 0 THEN 'FeedItem' WHEN 1 THEN 'ProcessInstanceStep' WHEN 2 THEN 'User' WHEN 3 THEN 'Group'
  WHEN 4 THEN 'AccountTag' WHEN 5 THEN 'CaseHistory2' ELSE p_name END || CASE p_size % 7 WHEN 0 THEN '__c' WHEN 1 THEN '__mdt' WHEN 2 THEN 'Share' ELSE '' END AS name FROM {part}"""
_FLAGS = f"""f AS (SELECT name, len(string_split(name, '__')) >= 3 OR (len(string_split(name, '__')) = 2 AND string_split(name, '__')[2] <> 'c') AS managed,
  regexp_matches(name, '{"|".join(catalog.SYSTEM_CHILDREN)}') AS system_child, name IN ({", ".join(f"'{n}'" for n in catalog.STANDARD_ROOTS)}) AS standard_root,
  regexp_matches(name, '(?:{"|".join(catalog.SYSTEM_ENDS)})$') AS system FROM ({plain(_LISTED)}) n)"""


@query(f"WITH {_FLAGS} SELECT * FROM f")
def noise_flags(spark, sf):
    return catalog.noise(derive(spark, sf, _LISTED))


@query(
    f"""WITH {_FLAGS}, w AS (SELECT CASE WHEN standard_root THEN 'stop' WHEN managed THEN 'managed' WHEN system_child THEN 'system' ELSE 'shown' END AS w FROM f)
    SELECT count(*) FILTER (w = 'shown') AS shown, count(*) FILTER (w = 'managed') AS managed_hidden, count(*) FILTER (w = 'system') AS system_hidden, count(*) FILTER (w = 'stop') AS stops FROM w"""
)
def noise_hidden_counts(spark, sf):
    return catalog.hidden_counts(derive(spark, sf, _LISTED))


@query(f"WITH {C}, d AS (SELECT table_name, CASE WHEN NOT createable THEN 'non-createable' END AS why FROM c) SELECT table_name, count(*) FILTER (why IS NULL) AS kept, CAST(0 AS BIGINT) AS formula, CAST(0 AS BIGINT) AS audit, count(*) FILTER (why = 'non-createable') AS non_createable FROM d GROUP BY table_name")
def catalog_field_filter_included(spark, sf):
    """Formula and audit columns are kept on request."""
    return catalog.filter_report(columns(spark, sf), include_formula=True, include_audit=True)


_AUDITS = ", ".join(f"'{a}'" for a in catalog.AUDIT)
_HIT = f"(regexp_matches(column_name, '{catalog.SENSITIVE}') OR coalesce(regexp_matches(label, '{catalog.SENSITIVE}'), FALSE))"


@query(
    f"""WITH RECURSIVE {C}, {E}, {_WALK}, d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node), y AS (SELECT *, CASE WHEN calculated THEN 'formula' WHEN column_name IN ({_AUDITS}) THEN 'audit' WHEN NOT createable THEN 'non-createable' END AS why FROM c),
    o AS (SELECT table_name, count(*) AS fields, count(*) FILTER (why = 'formula') AS formula, count(*) FILTER (why = 'audit') AS audit, count(*) FILTER (why = 'non-createable') AS non_createable, count(*) FILTER (why IS NULL AND {_HIT}) AS sensitive FROM y GROUP BY table_name),
    n AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT table_name FROM o), k AS (SELECT DISTINCT src FROM e WHERE dst = '{TABLE}' AND src <> '{TABLE}')
    SELECT n.node, o.table_name IS NOT NULL AS described, CASE WHEN n.node = '{TABLE}' THEN 'root' WHEN n.node IN ('t1', 't3') THEN 'standard-root' WHEN d.depth IS NULL AND k.src IS NOT NULL THEN 'child' ELSE 'parent' END AS role,
      d.depth, coalesce(fields, 0) AS fields, coalesce(formula, 0) AS formula, coalesce(audit, 0) AS audit, coalesce(non_createable, 0) AS non_createable, coalesce(sensitive, 0) AS sensitive
    FROM n LEFT JOIN o ON o.table_name = n.node LEFT JOIN d ON d.node = n.node LEFT JOIN k ON k.src = n.node"""
)
def node_roles(spark, sf):
    every = edges(spark, sf)
    return graph.node_roles(every, columns(spark, sf), graph.walk(every, root(spark), HOPS, stops(spark, sf)), TABLE, ["t1", "t3"])


@query(
    f"""WITH RECURSIVE {E}, {_SCC}, i AS (SELECT s.component, e.nillable FROM e JOIN scc s ON s.node = e.src JOIN scc d ON d.node = e.dst AND d.component = s.component)
    SELECT component, CASE WHEN bool_or(nillable) THEN 'two-phase' ELSE 'skipped' END AS step, CASE WHEN NOT bool_or(nillable) THEN 'no-nillable-edge' END AS reason FROM i GROUP BY component"""
)
def cycle_steps(spark, sf):
    """A cycle without a nillable edge cannot be loaded in two phases; its step is skipped, with a row that says so."""
    every = edges(spark, sf)
    return graph.cycle_steps(graph.break_edges(every, staged(graph.components(every), "components")))


# ---- upsert keys and writes


@query(f"WITH {C} SELECT table_name, count(DISTINCT column_name) AS candidates FROM c WHERE {CANDIDATE} GROUP BY table_name HAVING count(DISTINCT column_name) > 1")
def upsert_key_conflicts(spark, sf):
    return catalog.key_conflicts(columns(spark, sf))


@query(ORACLES["upsert_decisions"].replace("k > 1 AND most = 0 THEN 'all-candidates-empty'", "k > 1 THEN 'multiple-candidates'"))
def upsert_decisions_unprobed(spark, sf):
    """Without counts of filled values, several candidates stay undecided."""
    overrides, sticky = (derive(spark, sf, s.format(columns=COLUMNS)) for s in (_O, _S))
    return catalog.upsert_decisions(columns(spark, sf), target_columns(spark, sf), overrides, sticky, None)


@query(
    f"""WITH {C}, {T}, ok AS (SELECT DISTINCT table_name, column_name FROM t WHERE {CANDIDATE}) SELECT x.table_name, x.column_name, CASE WHEN x.table_name NOT IN (SELECT table_name FROM t) THEN 'target-describe-failed'
    WHEN NOT EXISTS (SELECT 1 FROM ok WHERE ok.table_name = x.table_name AND ok.column_name = x.column_name) THEN 'target-missing-field' ELSE 'picked' END AS verdict FROM (SELECT DISTINCT table_name, column_name FROM c WHERE {CANDIDATE}) x"""
)
def upsert_target_check(spark, sf):
    choices = catalog.upsert_candidates(columns(spark, sf)).select("table_name", "column_name").distinct()
    return catalog.verify_target(choices, target_columns(spark, sf))


#: Updates of which some have no name, and some share one.
_UPDATES = """SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '' WHEN c_custkey % 10 = 2 THEN 'shared' ELSE c_name END AS name,
  'N' || CAST(c_custkey AS STRING) AS id, c_acctbal AS acctbal, c_mktsegment AS segment, CAST(c_custkey AS BIGINT) AS k FROM {customer} WHERE c_custkey % 3 = 0"""
_DOUBLED = TARGET_CUSTOMERS + " UNION ALL SELECT c_name, 'D' || CAST(c_custkey AS STRING), c_acctbal, c_mktsegment FROM {customer} WHERE c_custkey % 60 = 48"
_JUDGED = f"""t AS ({plain(_DOUBLED)}), u AS ({plain(_UPDATES)}), j AS (SELECT u.*, CASE WHEN name IS NULL OR name = '' THEN 'no-key' WHEN name IN (SELECT name FROM u GROUP BY name HAVING count(*) > 1) THEN 'repeated-key'
  WHEN name IN (SELECT name FROM t GROUP BY name HAVING count(*) > 1) THEN 'repeated-on-target' END AS reject_reason FROM u)"""


def _guarded(spark, sf):
    target, updates = derive(spark, sf, _DOUBLED), derive(spark, sf, _UPDATES)
    return load.guarded_upsert(target, updates, "name", ["acctbal", "segment"])


@query(f"WITH {_JUDGED}, g AS (SELECT * FROM j WHERE reject_reason IS NULL) SELECT coalesce(t.name, g.name) AS name, CASE WHEN g.name IS NOT NULL THEN g.acctbal ELSE t.acctbal END AS acctbal, CASE WHEN g.name IS NOT NULL THEN g.segment ELSE t.segment END AS segment, t.name IS NULL AS created FROM t FULL JOIN g ON g.name = t.name")
def upsert_guarded(spark, sf):
    """Keys that are missing or not unique on a side neither multiply target rows nor add any."""
    return _guarded(spark, sf)[0]


@query(f"WITH {_JUDGED} SELECT k, reject_reason FROM j WHERE reject_reason IS NOT NULL")
def upsert_rejects(spark, sf):
    return _guarded(spark, sf)[1].select("k", "reject_reason")


_PATCHES = "SELECT 'T' || CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 24 = 0 THEN NULL ELSE 'PATCHED' END AS segment FROM {customer} WHERE c_custkey % 6 = 0"


@query(f"WITH {TC}, p AS ({plain(_PATCHES)}) SELECT tc.name, tc.id, tc.acctbal, CASE WHEN p.id IS NOT NULL THEN p.segment ELSE tc.segment END AS segment FROM tc LEFT JOIN p ON p.id = tc.id")
def point_update(spark, sf):
    return load.patch(derive(spark, sf, TARGET_CUSTOMERS), "id", derive(spark, sf, _PATCHES), ["segment"])


_BATCH = """SELECT 'customer' AS table_name, CASE WHEN c_custkey % 3 <> 0 THEN 'already-loaded' ELSE 'inserted' END AS outcome, count(*) AS n FROM customer WHERE c_custkey % 4 <> 2 GROUP BY 2
  UNION ALL SELECT 'orders', CASE WHEN o_custkey % 3 = 0 AND o_custkey % 4 = 2 THEN 'rejected' ELSE 'inserted' END, count(*) FROM orders GROUP BY 2"""


@query(f"{_BATCH} UNION ALL SELECT 'part', 'not-run', count(*) FROM part UNION ALL SELECT 'supplier', 'already-run', count(*) FROM supplier")
def multi_step_control(spark, sf):
    """A finished step is passed over; rejected orders stop the batch before parts."""
    t = {name: table(spark, sf, name) for name in ("supplier", "customer", "orders", "part")}
    steps = [("supplier", t["supplier"], "s_suppkey", []), ("customer", t["customer"].where("c_custkey % 4 <> 2"), "c_custkey", []), ("orders", t["orders"], "o_orderkey", [Rule(TO_CUSTOMER, "reject")]), ("part", t["part"], "p_partkey", [])]
    return load.stitch(steps, derive(spark, sf, PARTIAL_MAP), mint, finished=("supplier",), stop_on_reject=True)[0]


@query(ORACLES["multi_step_stitch"])
def multi_step_resumed(spark, sf):
    """A batch that broke off after its first step goes on from the journal and ends as if it had not."""
    t = {name: table(spark, sf, name) for name in ("customer", "orders")}
    steps = [("customer", t["customer"].where("c_custkey % 4 <> 2"), "c_custkey", []), ("orders", t["orders"], "o_orderkey", [Rule(TO_CUSTOMER, "reject")])]
    journal = new_folder(spark, "journal")
    load.stitch(steps[:1], derive(spark, sf, PARTIAL_MAP), mint, journal=journal)
    return load.stitch(steps, derive(spark, sf, PARTIAL_MAP), mint, journal=journal)[0]


# ---- rejects that spread

#: Nations without an entry in the map: their customers are rejected, then those customers' orders, orders after these, and lines.
_KNOWN_NATIONS = "SELECT 'nation' AS object, CAST(n_nationkey AS STRING) AS source_id, 'N' || CAST(n_nationkey AS STRING) AS target_id FROM {nation} WHERE n_nationkey % 7 <> 3"
_ALL_NATIONS = "SELECT 'nation' AS object, CAST(n_nationkey AS STRING) AS source_id, 'N' || CAST(n_nationkey AS STRING) AS target_id FROM {nation}"
_FOLLOWING = """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_custkey, CASE WHEN parent_order IN (SELECT CAST(o_orderkey AS BIGINT) FROM {orders}) THEN parent_order END AS parent_order
  FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_orderkey / 2) AS BIGINT) END AS parent_order FROM {orders}) p"""
_LINES = "SELECT CAST(l_orderkey AS BIGINT) * 100 + l_linenumber AS line, l_orderkey FROM {lineitem}"
_FIRST_BAD = f"""o AS ({plain(_FOLLOWING)}), l AS ({plain(_LINES)}), c AS (SELECT c_custkey, c_nationkey % 7 = 3 AS bad FROM customer), b(k) AS (SELECT o_orderkey FROM o JOIN c ON c_custkey = o_custkey WHERE bad UNION SELECT o.o_orderkey FROM b JOIN o ON o.parent_order = b.k),
  j AS (SELECT 'customer' AS table_name, bad, c_custkey AS id FROM c UNION ALL SELECT 'orders', k IS NOT NULL, o_orderkey FROM o LEFT JOIN b ON k = o_orderkey UNION ALL SELECT 'lines', k IS NOT NULL, line FROM l LEFT JOIN b ON k = l_orderkey)"""


def _cascade(spark, sf, start):
    customers, orders, lines = table(spark, sf, "customer"), derive(spark, sf, _FOLLOWING), derive(spark, sf, _LINES)
    required = lambda name, column, target: Rule(ForeignKey(name, column, (target,), required=True), "reject")
    steps = [
        ("customer", customers, "c_custkey", [required("customer", "c_nationkey", "nation")]),
        ("orders", orders, "o_orderkey", [required("orders", "o_custkey", "customer"), required("orders", "parent_order", "orders")]),
        ("lines", lines, "line", [required("lines", "l_orderkey", "orders")]),
    ]
    return load.stitch(steps, start, mint)


@query(f"WITH RECURSIVE {_FIRST_BAD} SELECT table_name, CASE WHEN bad THEN 'rejected' ELSE 'inserted' END AS outcome, count(*) AS n FROM j GROUP BY 1, 2")
def reject_cascade(spark, sf):
    """Rejects go from step to step and along orders that follow a rejected order."""
    return _cascade(spark, sf, derive(spark, sf, _KNOWN_NATIONS))[0]


@query(f"WITH RECURSIVE {_FIRST_BAD} SELECT DISTINCT table_name AS object, CAST(id AS VARCHAR) AS source_id FROM j WHERE NOT bad UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 7 <> 3")
def reject_cascade_map(spark, sf):
    """Only rows that were kept are in the map."""
    return _cascade(spark, sf, derive(spark, sf, _KNOWN_NATIONS))[1].select("object", "source_id")


@query(f"WITH RECURSIVE {_FIRST_BAD} SELECT table_name, CASE WHEN bad THEN 'inserted' ELSE 'already-loaded' END AS outcome, count(*) AS n FROM j GROUP BY 1, 2")
def reject_retry(spark, sf):
    """A second run, once the nations are there, loads what the first one rejected and nothing else."""
    first = _cascade(spark, sf, derive(spark, sf, _KNOWN_NATIONS))[1]
    return _cascade(spark, sf, idmap.layered(derive(spark, sf, _ALL_NATIONS), first))[0]


# ---- masks, checked through the id map

#: What went to the target: masked names, some clear, some lost; segments as they were.
_SENT = "SELECT 'C' || CAST(c_custkey AS STRING) AS id, c_name, c_mktsegment AS segment, c_custkey FROM {customer} WHERE c_custkey % 5 <> 1"


@query(
    f"""WITH m AS ({plain(PARTIAL_MAP)}), s AS (SELECT c_custkey, c_name, c_mktsegment, {preset_sql('person-name', 'd')} AS own FROM (SELECT *, {digest_sql('c_name')} AS d FROM customer) x),
    p AS (SELECT s.*, CASE WHEN c_custkey % 7 = 0 THEN c_name WHEN c_custkey % 7 = 1 THEN 'x' ELSE own END AS target FROM s JOIN m ON m.source_id = CAST(c_custkey AS STRING) WHERE c_custkey % 5 <> 1)
    SELECT 'c_name' AS column_name, CASE WHEN target = own THEN 'match' WHEN target = c_name THEN 'leak' ELSE 'mismatch' END AS bucket, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'c_mktsegment', 'copied', count(*) FROM p"""
)
def mask_verify_mapped(spark, sf):
    """Source and target rows meet through the id map; columns that are not masked are counted as copied."""
    own = mask.mask(F.col("c_name"), "person-name", SALT)
    sent = derive(spark, sf, _SENT).withColumn("name", F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).when(F.col("c_custkey") % 7 == 1, "x").otherwise(own)).select("id", "name", "segment")
    pairs = verify.mapped_pairs(table(spark, sf, "customer"), "customer", "c_custkey", derive(spark, sf, PARTIAL_MAP), sent, "id", {"c_name": "name", "c_mktsegment": "segment"})
    masked = verify.mask_report(pairs, [("c_name", F.col("s_c_name"), F.col("t_name"), mask.mask(F.col("s_c_name"), "person-name", SALT))])
    return masked.union(pairs.groupBy(F.lit("c_mktsegment"), verify.copied(F.col("s_c_mktsegment"), F.col("t_segment"))).agg(F.count(F.lit(1))))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN substr(own, 1, CAST(c_custkey % 4 * 4 AS BIGINT)) ELSE own END AS masked FROM (SELECT c_custkey, {preset_sql('person-name', 'd')} AS own FROM (SELECT *, {digest_sql('c_name')} AS d FROM customer) x) y")
def mask_length_cap(spark, sf):
    """Masks are cut to a positive length; zero stands for none."""
    return table(spark, sf, "customer").select("c_custkey", mask.mask(F.col("c_name"), "person-name", SALT, F.col("c_custkey") % 4 * 4).alias("masked"))


# ---- previews and drift

_LEFT_OUT = "column_name IN ('o_orderpriority', 'c_mktsegment', 'l_discount', 's_acctbal')"


@query(
    f"""WITH s AS ({COUNTS_SQL}), m AS (SELECT 'customer' AS table_name, count(*) AS mapped FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE {ROOT})),
    d AS (SELECT 'customer' AS table_name, 'picked' AS kind, 'c_name' AS field UNION ALL SELECT 'supplier', 'picked', 's_name'), x AS (SELECT table_name, count(*) AS source_only FROM information_schema.columns WHERE {_LEFT_OUT} AND table_name IN ('orders', 'customer', 'lineitem', 'supplier') GROUP BY 1),
    f AS (SELECT 'orders' AS table_name, count(*) AS defaulted FROM orders WHERE {ROOT} AND o_custkey % 7 = 0),
    p AS (SELECT s.table_name, s.kinds, s.n, coalesce(mapped, 0) AS mapped, s.n - coalesce(mapped, 0) AS to_load, coalesce(d.kind, 'insert-only') AS kind, d.field, coalesce(source_only, 0) AS source_only, coalesce(defaulted, 0) AS defaulted
      FROM s LEFT JOIN m ON m.table_name = s.table_name LEFT JOIN d ON d.table_name = s.table_name LEFT JOIN x ON x.table_name = s.table_name LEFT JOIN f ON f.table_name = s.table_name)
    SELECT * FROM p UNION ALL SELECT NULL, NULL, CAST(sum(n) AS BIGINT), CAST(sum(mapped) AS BIGINT), CAST(sum(to_load) AS BIGINT), NULL, NULL, CAST(sum(source_only) AS BIGINT), CAST(sum(defaulted) AS BIGINT) FROM p"""
)
def preview_full(spark, sf):
    """Counts, keys to match by, schema differences, rows that point outside, and totals, for one root."""
    data = dataset(spark, sf)
    ids = staged(scope.scan_ids(data.tables["orders"], "o_orderkey", ROOT), "roots")
    reached = scope.scopes(data, "orders", ids)
    mapped = idmap.already_loaded_counts({"customer": (reached["customer"][1], "c_custkey")}, derive(spark, sf, PARTIAL_MAP)).select("table_name", "mapped")
    keys = None
    for name, candidates in (("customer", ["c_name"]), ("supplier", ["s_name"])):
        one = load.pick_key(load.key_population(reached[name][1], candidates)).select(F.lit(name).alias("table_name"), F.when(F.col("column_name").isNotNull(), "picked").otherwise("ambiguous").alias("kind"), F.col("column_name").alias("field"))
        keys = one if keys is None else keys.union(one)
    source = catalog.described(data)
    differences = source.join(source.where(f"not ({_LEFT_OUT})"), ["table_name", "column_name"], "left_anti").groupBy("table_name").agg(F.count(F.lit(1)).alias("source_only"))
    outside = reached["orders"][1].withColumn("owner", F.when(F.col("o_custkey") % 7 == 0, F.col("o_custkey")))
    defaulted = idmap.first_references(outside, ["owner"]).select(F.lit("orders").alias("table_name"), F.col("n").alias("defaulted"))
    return verify.preview(scope.scope_counts(reached), mapped, keys, differences, defaulted)


_GONE = f"{ROOT} AND o_orderkey % 50 <> 0"


def _plan(spark, sf, predicate, changed):
    """The plan of a preview: tables of the derived catalog with their keys; changed tables have another decision."""
    decisions = upsert_decisions(spark, sf)
    kind = F.when(F.lit(changed) & F.col("field").isNotNull() & F.col("table_name").endswith("7"), F.lit("insert-only")).otherwise(F.col("kind"))
    objects = decisions.select("table_name", F.lit(0).alias("wave"), F.lit("single").alias("step"), F.lit(None).cast("string").alias("break_edge"), kind.alias("kind"), "field", "reason")
    sample = verify.id_set_fingerprint(scope.scan_ids(table(spark, sf, "orders"), "o_orderkey", predicate), "orders", "o_orderkey")
    return verify.plan_parts("orders", predicate, objects, sample)


def _quoted(text: str) -> str:
    return text.replace("'", "''")


@query(
    f"""WITH u AS ({ORACLES["upsert_decisions"]}), a AS ({_fingerprint_sql("orders", "o_orderkey", ROOT)}), b AS ({_fingerprint_sql("orders", "o_orderkey", _GONE)})
    SELECT 'predicate' AS part, '{_quoted(ROOT)}' AS before, '{_quoted(_GONE)}' AS now UNION ALL SELECT 'sample', CAST(a.n AS STRING) || ':' || a.digest, CAST(b.n AS STRING) || ':' || b.digest FROM a, b WHERE a.digest <> b.digest
    UNION ALL SELECT 'table:' || table_name, '0|single||picked|' || field, '0|single||insert-only|' || field FROM u WHERE field IS NOT NULL AND ends_with(table_name, '7')"""
)
def plan_drift_parts(spark, sf):
    """What has changed since a preview: the predicate, the ids it finds, and decisions of some tables."""
    return verify.plan_drift(staged(_plan(spark, sf, ROOT, False), "plan"), staged(_plan(spark, sf, _GONE, True), "plan"))



#: Orders as a later run finds them: some are gone, some have another status, some are new.
_LATER = """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 1009 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey % 1013 <> 5
  UNION ALL SELECT CAST(-o_orderkey AS BIGINT), o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey % 2003 = 7"""


@query(
    f"""WITH b AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderstatus AS s FROM orders), t AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM ({plain(_LATER)}) x),
    j AS (SELECT coalesce(b.k, t.k) AS k, b.k IS NOT NULL AS there, t.k IS NOT NULL AS here, b.s IS DISTINCT FROM t.s AS unlike FROM b FULL JOIN t ON b.k = t.k)
    SELECT CAST(floor(k / 64.0) * 64 AS BIGINT) AS range_start, CAST(floor(k / 64.0) * 64 + 63 AS BIGINT) AS range_end, count(*) FILTER (WHERE there) AS n_before, count(*) FILTER (WHERE here) AS n_now FROM j GROUP BY 1, 2 HAVING bool_or(unlike)"""
)
def drift_ranges(spark, sf):
    """Ranges of keys whose rows have changed since a preview, found from stored sums without the rows."""
    columns = ["o_orderstatus", "o_totalprice"]
    before = table(spark, sf, "orders").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))
    trees = [staged(verify.range_tree(rows, "o_orderkey", columns, 64), "tree") for rows in (before, derive(spark, sf, _LATER))]
    return verify.changed_ranges(*trees, 64)


_FEW = "o_orderkey % 50 = 11 AND o_totalprice > 1000"


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_FEW})")
def scope_sifted_children(spark, sf):
    """Children of few roots: lines are sifted by a Bloom filter of the orders where they are read, then matched exactly."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return scope.with_few_ids(lines, "l_orderkey", scope.scan_ids(table(spark, sf, "orders"), "o_orderkey", _FEW))


def _order_sql(edges_sql):
    """Wave, step and break edge of every table, by recursive SQL over the edges."""
    return f"""WITH RECURSIVE e AS ({edges_sql}), {_SCC}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), s AS (SELECT n.node, coalesce(component, n.node) AS step, component FROM n LEFT JOIN scc ON scc.node = n.node),
    d AS (SELECT DISTINCT a.step AS a, b.step AS b FROM e JOIN s a ON a.node = e.src JOIN s b ON b.node = e.dst WHERE a.step <> b.step),
    l(step, wave) AS (SELECT DISTINCT step, 0 FROM s UNION SELECT d.a, wave + 1 FROM l JOIN d ON d.b = l.step), m AS (SELECT step, max(wave) AS wave FROM l GROUP BY step),
    o AS (SELECT s.component, src || '.' || field AS said, row_number() OVER (PARTITION BY s.component ORDER BY src = dst, pos, src, field, dst) AS rn FROM e JOIN s ON s.node = e.src JOIN s q ON q.node = e.dst AND q.component = s.component WHERE nillable)
    SELECT s.node AS table_name, m.wave, CASE WHEN s.component IS NULL THEN 'single' WHEN o.said IS NULL THEN 'skipped' ELSE 'two-phase' END AS step, o.said AS break_edge FROM s JOIN m ON m.step = s.step LEFT JOIN o ON o.component = s.component AND rn = 1"""


@query(_order_sql(plain(EDGES)))
def load_steps(spark, sf):
    return graph.load_steps(edges(spark, sf))


#: The catalog after a release: some references are gone.
_EDGES_LATER = f"SELECT * FROM ({EDGES}) q WHERE pos % 7 <> 3"


@query(
    f"""WITH a AS ({_order_sql(plain(EDGES))}), b AS ({_order_sql(plain(_EDGES_LATER))}), p AS (SELECT 'table:' || table_name AS part, concat_ws('|', wave, step, coalesce(break_edge, ''), 'picked', '') AS said FROM a),
    q AS (SELECT 'table:' || table_name AS part, concat_ws('|', wave, step, coalesce(break_edge, ''), 'picked', '') AS said FROM b)
    SELECT coalesce(p.part, q.part) AS part, p.said AS before, q.said AS now FROM p FULL JOIN q ON q.part = p.part WHERE p.said IS DISTINCT FROM q.said"""
)
def plan_order_drift(spark, sf):
    """Tables whose place in the load order, or whose way of breaking a cycle, has changed since a preview."""
    plans = []
    for sql in (EDGES, _EDGES_LATER):
        steps = graph.load_steps(staged(derive(spark, sf, sql), "edges"))
        objects = steps.withColumns({"kind": F.lit("picked"), "field": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
        plans.append(staged(verify.plan_parts("orders", ROOT, objects), "plan"))
    return verify.plan_drift(*plans)


_KEYED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_extendedprice"],
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n, count({c}) AS filled, count({c}) > 0 AND count(DISTINCT {c}) = count({c}) AS is_unique FROM {t}" for t, cs in _KEYED.items() for c in cs))
def unique_keys(spark, sf):
    """Columns that the data allow as a key to match by."""
    return catalog.unique_keys({name: (table(spark, sf, name), names) for name, names in _KEYED.items()})
