"""The catalog and its graph (groups B and E of the survey), over column and edge tables derived from part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.mask import STRATEGIES, TEXT_TYPES
from ..operators import catalog, graph
from ..sources.tables import staged, table
from .derived import COLUMNS, EDGES, REFERENCES, TARGET_COLUMNS, derive, plain
from .registry import query

C, T, E = f"c AS ({plain(COLUMNS)})", f"t AS ({plain(TARGET_COLUMNS)})", f"e AS ({plain(EDGES)})"
AUDITS = ", ".join(f"'{a}'" for a in catalog.AUDIT)
HIT = f"(regexp_matches(column_name, '{catalog.SENSITIVE}') OR coalesce(regexp_matches(label, '{catalog.SENSITIVE}'), FALSE))"
TEXT = ", ".join(f"'{t}'" for t in TEXT_TYPES)
WRITABLE = "type <> 'id' AND createable AND NOT calculated"
CANDIDATE = "external_id AND id_lookup AND is_unique AND createable AND NOT auto_number AND NOT calculated"
ROOT, HOPS = "t20", 4
STOPS = "src IN ('t3', 't1')"


def columns(spark, sf):
    return derive(spark, sf, COLUMNS)


def target_columns(spark, sf):
    return derive(spark, sf, TARGET_COLUMNS)


def edges(spark, sf):
    return staged(derive(spark, sf, EDGES), "edges")


def stops(spark, sf):
    """Tables that are listed but not walked through."""
    return derive(spark, sf, EDGES).where(STOPS).select(F.col("src").alias("node")).distinct()


def root(spark):
    return spark.createDataFrame([(ROOT,)], "node string")


@query(
    f"""WITH {C}, d AS (SELECT table_name, CASE WHEN calculated THEN 'formula' WHEN column_name IN ({AUDITS}) THEN 'audit' WHEN NOT createable THEN 'non-createable' END AS why FROM c)
    SELECT table_name, count(*) FILTER (why IS NULL) AS kept, count(*) FILTER (why = 'formula') AS formula, count(*) FILTER (why = 'audit') AS audit, count(*) FILTER (why = 'non-createable') AS non_createable FROM d GROUP BY table_name"""
)
def catalog_field_filter(spark, sf):
    return catalog.filter_report(columns(spark, sf))


@query(f"WITH {C} SELECT table_name, column_name, pos, CASE WHEN master_detail THEN 'master-detail' ELSE 'not-nillable' END AS reason FROM c WHERE master_detail OR (createable AND NOT nillable AND NOT defaulted AND NOT calculated)")
def required_columns(spark, sf):
    return catalog.required_columns(columns(spark, sf))


@query(
    "SELECT 'orders' AS table_name, 'o_custkey' AS column_name, count(*) FILTER (o_custkey % 7 = 0) AS nulls FROM orders UNION ALL SELECT 'orders', 'o_orderpriority', count(*) FILTER (o_orderpriority = '1-URGENT') FROM orders UNION ALL SELECT 'orders', 'o_orderkey', 0 FROM orders GROUP BY 1"
)
def required_null_report(spark, sf):
    rows = derive(spark, sf, "SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority FROM {orders}")
    return catalog.null_report(rows, "orders", ["o_custkey", "o_orderpriority", "o_orderkey"])


@query(f"WITH {C} SELECT table_name, column_name, pos FROM c WHERE {HIT}")
def sensitive_columns(spark, sf):
    return catalog.sensitive_columns(columns(spark, sf))


@query(f"WITH {E} SELECT src, dst, field, nillable, master_detail, polymorphic, kind, pos FROM e")
def edges_all(spark, sf):
    refs = derive(spark, sf, REFERENCES)
    return graph.explode_references(refs.withColumn("targets", F.array_compact(F.array("target1", "target2"))))


@query(f"WITH {E} SELECT DISTINCT src AS child, field, nillable FROM e WHERE dst = 't3' AND src <> 't3'")
def edges_children(spark, sf):
    return graph.child_edges(derive(spark, sf, EDGES), "t3")


_WALK = f"w(node, depth) AS (SELECT '{ROOT}', 0 UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < {HOPS} AND w.node NOT IN ('t3', 't1'))"


@query(f"WITH RECURSIVE {E}, {_WALK} SELECT node, min(depth) AS depth FROM w GROUP BY node")
def walk_parents(spark, sf):
    return graph.walk(edges(spark, sf), root(spark), HOPS, stops(spark, sf))


@query(f"WITH {E} SELECT DISTINCT src AS node FROM e WHERE dst = '{ROOT}' AND src <> '{ROOT}'")
def walk_children(spark, sf):
    return graph.child_edges(derive(spark, sf, EDGES), ROOT).select(F.col("child").alias("node")).distinct()


@query(f"WITH {E} SELECT DISTINCT b.dst AS node FROM e a JOIN e b ON b.src = a.src AND b.field = 'f4' WHERE a.dst = '{ROOT}' AND a.src <> '{ROOT}' AND b.dst <> b.src")
def walk_child_lookup(spark, sf):
    return graph.child_lookups(edges(spark, sf), ROOT, "f4")


@query(
    f"""WITH {E}, r AS (SELECT 't' || CAST(p_partkey AS STRING) AS child, 'f' || CAST(p_partkey % 6 AS STRING) AS field FROM part),
    k AS (SELECT DISTINCT src FROM e WHERE dst = '{ROOT}' AND src <> '{ROOT}'), f AS (SELECT DISTINCT src, field FROM e)
    SELECT child, field, CASE WHEN child NOT IN (SELECT src FROM k) THEN 'not-a-child' ELSE 'not-a-reference' END AS error FROM r
    WHERE child NOT IN (SELECT src FROM k) OR NOT EXISTS (SELECT 1 FROM f WHERE f.src = r.child AND f.field = r.field)"""
)
def child_lookup_errors(spark, sf):
    requests = derive(spark, sf, "SELECT 't' || CAST(p_partkey AS STRING) AS child, 'f' || CAST(p_partkey % 6 AS STRING) AS field FROM {part}")
    return graph.lookup_errors(requests, edges(spark, sf), ROOT)


_MUST = f"m(node) AS (SELECT '{ROOT}' UNION SELECT e.dst FROM m JOIN e ON e.src = m.node WHERE NOT e.nillable AND m.node NOT IN ('t3', 't1'))"


@query(f"WITH RECURSIVE {E}, {_MUST} SELECT node FROM m")
def must_include(spark, sf):
    return graph.closure(edges(spark, sf).where("not nillable"), root(spark), stops(spark, sf))


_BUCKETS = f"""{_MUST}, {_WALK}, mi AS (SELECT node FROM m WHERE node NOT IN ('t3', 't1', '{ROOT}')),
    op AS (SELECT DISTINCT node FROM w WHERE node NOT IN ('t3', 't1', '{ROOT}') AND node NOT IN (SELECT node FROM mi)),
    oc AS (SELECT DISTINCT src AS node FROM e WHERE dst = '{ROOT}' AND src NOT IN ('t3', 't1', '{ROOT}') AND src NOT IN (SELECT node FROM mi) AND src NOT IN (SELECT node FROM op)),
    b AS (SELECT node, 'must-include' AS bucket FROM mi UNION ALL SELECT node, 'optional-parent' FROM op UNION ALL SELECT node, 'optional-child' FROM oc)"""


@query(f"WITH RECURSIVE {E}, {_BUCKETS} SELECT node, bucket FROM b")
def classify_tables(spark, sf):
    return graph.classify(edges(spark, sf), ROOT, HOPS, stops(spark, sf))


@query(
    f"""WITH RECURSIVE {E}, {_BUCKETS}, x AS (SELECT e.src, e.field, e.dst, coalesce(s.bucket = 'must-include', FALSE) OR e.dst = '{ROOT}' AS met, s.bucket IS NULL AS missing
      FROM e JOIN b ON b.node = e.src AND b.bucket <> 'must-include' LEFT JOIN b s ON s.node = e.dst WHERE NOT e.nillable),
    g AS (SELECT src, field, count(DISTINCT dst) AS targets, bool_and(missing) AS missing FROM x GROUP BY src, field HAVING NOT bool_or(met))
    SELECT g.src AS node, g.field, (SELECT min(dst) FROM x WHERE x.src = g.src AND x.field = g.field AND x.missing = g.missing) AS target, CASE WHEN missing THEN 'missing' ELSE 'optional' END AS status, targets FROM g"""
)
def required_fk_warnings(spark, sf):
    every = edges(spark, sf)
    return graph.required_warnings(every, staged(graph.classify(every, ROOT, HOPS, stops(spark, sf)), "buckets"), ROOT)


_SCC = """r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
    scc AS (SELECT x.a AS node, min(y.b) AS component FROM r x JOIN r y ON x.a = y.a JOIN r z ON z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.a)"""


@query(f"WITH RECURSIVE {E}, {_SCC} SELECT node, component FROM scc")
def scc_components(spark, sf):
    return graph.components(edges(spark, sf))


@query(
    f"""WITH RECURSIVE {E}, {_SCC}, i AS (SELECT s.component, e.* FROM e JOIN scc s ON s.node = e.src JOIN scc d ON d.node = e.dst AND d.component = s.component),
    k AS (SELECT component, count(*) AS inner_edges FROM i GROUP BY component),
    o AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY src = dst, pos, src, field, dst) AS rn FROM i WHERE nillable)
    SELECT k.component, inner_edges, o.src AS break_src, o.field AS break_field, o.dst AS break_dst FROM k LEFT JOIN o ON o.component = k.component AND rn = 1"""
)
def scc_break_edge(spark, sf):
    every = edges(spark, sf)
    return graph.break_edges(every, staged(graph.components(every), "components"))


@query(
    f"""WITH RECURSIVE {E}, {_SCC}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), s AS (SELECT n.node, coalesce(component, n.node) AS step FROM n LEFT JOIN scc ON scc.node = n.node),
    d AS (SELECT DISTINCT a.step AS a, b.step AS b FROM e JOIN s a ON a.node = e.src JOIN s b ON b.node = e.dst WHERE a.step <> b.step),
    l(step, wave) AS (SELECT DISTINCT step, 0 FROM s UNION SELECT d.a, wave + 1 FROM l JOIN d ON d.b = l.step) SELECT s.node, max(wave) AS wave FROM s JOIN l ON l.step = s.step GROUP BY s.node"""
)
def load_waves(spark, sf):
    every = edges(spark, sf)
    return graph.load_waves(every, staged(graph.components(every), "components"))


@query(
    f"""WITH RECURSIVE h AS (SELECT src, dst FROM ({plain(EDGES)}) q WHERE NOT nillable), r(a, b) AS (SELECT src, dst FROM h UNION SELECT r.a, h.dst FROM r JOIN h ON h.src = r.b)
    SELECT x.a AS node, min(y.b) AS component FROM r x JOIN r y ON x.a = y.a JOIN r z ON z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.a"""
)
def cycle_feedback_rest(spark, sf):
    """What stays cyclic once a set of nillable edges is left out: the cycles of required edges alone."""
    return graph.feedback_edges(edges(spark, sf))[1]


_ORDERS_AFTER = "SELECT CAST(o_orderkey AS STRING) AS src, CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS STRING) AS dst FROM {orders}"


@query("SELECT CAST(o_orderkey AS VARCHAR) AS node, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS wave FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def load_waves_rows(spark, sf):
    """Rows of a hierarchy in an order that puts parents first: each order after its customer's order before it."""
    after = staged(derive(spark, sf, _ORDERS_AFTER).where("dst is not null"), "hierarchy")
    return graph.row_waves(after)


@query(
    f"""WITH RECURSIVE {E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(node, depth) AS (SELECT '{ROOT}', 0 UNION SELECT b.dst, depth + 1 FROM w JOIN b ON b.src = w.node WHERE depth < 2) SELECT node, min(depth) AS depth FROM w GROUP BY node"""
)
def focus_khop(spark, sf):
    return graph.neighbourhood(edges(spark, sf), root(spark), 2)


@query(
    f"""WITH RECURSIVE {C}, {E}, {_WALK}, d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node), k AS (SELECT 't' || CAST(l_partkey % 50 AS STRING) AS node, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT c.table_name AS node, count(*) AS fields, count(*) FILTER (calculated) AS calculated, any_value(d.depth) AS depth, coalesce(any_value(k.n), 0) AS n FROM c LEFT JOIN d ON d.node = c.table_name LEFT JOIN k ON k.node = c.table_name GROUP BY c.table_name"""
)
def node_summary(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("t"), (F.col("l_partkey") % 50).cast("string")).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return graph.node_summary(columns(spark, sf), graph.walk(edges(spark, sf), root(spark), HOPS, stops(spark, sf)), counts)


@query(f"WITH {C} SELECT table_name, column_name, pos FROM c WHERE {WRITABLE}")
def project_writable(spark, sf):
    return catalog.writable(columns(spark, sf)).select("table_name", "column_name", "pos")


@query(f"WITH {C}, {T} SELECT table_name, column_name, pos, (EXISTS (SELECT 1 FROM t WHERE t.table_name = c.table_name AND t.column_name = c.column_name) OR c.table_name NOT IN (SELECT table_name FROM t)) AS kept FROM c WHERE {WRITABLE}")
def schema_intersect(spark, sf):
    return catalog.intersect(columns(spark, sf), target_columns(spark, sf))


@query(f"WITH {C}, {T} SELECT c.table_name, c.column_name, least(c.length, t.length) AS length FROM c JOIN t ON t.table_name = c.table_name AND t.column_name = c.column_name")
def schema_length_clamp(spark, sf):
    return catalog.length_clamp(columns(spark, sf), target_columns(spark, sf))


@query(
    f"""WITH {C}, {T}, o AS (SELECT c.table_name, c.table_name NOT IN (SELECT table_name FROM t) AS missing, CASE WHEN NOT EXISTS (SELECT 1 FROM t WHERE t.table_name = c.table_name AND t.column_name = c.column_name) THEN c.column_name END AS name FROM c WHERE {WRITABLE})
    SELECT table_name, bool_or(missing) AS missing, count(name) AS source_only, coalesce(string_agg(name, ',' ORDER BY name), '') AS first_columns FROM o GROUP BY table_name"""
)
def schema_diff(spark, sf):
    return catalog.schema_diff(columns(spark, sf), target_columns(spark, sf))


@query(
    f"WITH {C}, {T}, m AS (SELECT * FROM c WHERE {HIT} AND type IN ({TEXT})) SELECT m.table_name, m.column_name, m.length, t.length AS target_length FROM m JOIN t ON t.table_name = m.table_name AND t.column_name = m.column_name WHERE t.length < m.length"
)
def masked_length_warnings(spark, sf):
    return catalog.masked_length_warnings(columns(spark, sf), target_columns(spark, sf))


_STRATEGY = "CASE " + " ".join(f"WHEN {f'type = {chr(39)}{k}{chr(39)} OR ' if k else ''}regexp_matches(lower(column_name || ' ' || label), '{p}') THEN '{s}'" for s, k, p in STRATEGIES) + " ELSE 'generic-text' END"


@query(f"WITH {C} SELECT table_name, column_name, pos, {_STRATEGY} AS strategy FROM c")
def mask_strategy(spark, sf):
    return catalog.mask_strategies(columns(spark, sf))


_OVERRIDES = "SELECT table_name, column_name, CASE WHEN pos % 3 = 0 THEN 'copy' WHEN pos % 3 = 1 THEN 'email' ELSE 'generic-text' END AS strategy FROM ({columns}) c WHERE pos % 6 IN (1, 3) AND createable"


@query(
    f"""WITH {C}, o AS ({_OVERRIDES.format(columns=plain(COLUMNS))}), a AS (SELECT table_name, column_name, 'auto' AS strategy FROM c WHERE {HIT} AND type IN ({TEXT}))
    SELECT table_name, column_name, strategy FROM o WHERE strategy <> 'copy' UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.table_name = a.table_name AND o.column_name = a.column_name)"""
)
def mask_selection(spark, sf):
    return catalog.mask_selection(columns(spark, sf), derive(spark, sf, _OVERRIDES.format(columns=COLUMNS)))


@query(f"WITH {C} SELECT table_name, count(*) FILTER ({HIT}) AS flagged, count(*) FILTER ({HIT} AND type IN ({TEXT})) AS will_mask, count(*) FILTER ({HIT} AND type NOT IN ({TEXT})) AS flagged_non_text FROM c GROUP BY table_name")
def mask_recall_report(spark, sf):
    return catalog.recall_report(columns(spark, sf))


@query(f"WITH {C} SELECT table_name, column_name, pos FROM c WHERE {CANDIDATE}")
def upsert_candidates(spark, sf):
    return catalog.upsert_candidates(columns(spark, sf)).select("table_name", "column_name", "pos")


_O = "SELECT table_name, CASE WHEN pos % 16 < 8 THEN 'ExternalId__c' ELSE 'Nope__c' END AS column_name FROM ({columns}) c WHERE column_name = 'Email__c' AND length % 5 = 0"
_S = "SELECT table_name, 'LegacyKey__c' AS column_name FROM ({columns}) c WHERE column_name = 'MobilePhone' AND length % 3 = 0"
_P = "SELECT table_name, column_name, CASE WHEN length % 4 = 0 THEN 0 ELSE length END AS filled FROM ({columns}) c WHERE external_id"


@query(
    f"""WITH {C}, {T}, ov AS ({_O.format(columns=plain(COLUMNS))}), st AS ({_S.format(columns=plain(COLUMNS))}), po AS ({_P.format(columns=plain(COLUMNS))}),
    cd AS (SELECT DISTINCT table_name, column_name FROM c WHERE {CANDIDATE}), ok AS (SELECT DISTINCT table_name, column_name FROM t WHERE {CANDIDATE}),
    cp AS (SELECT cd.*, coalesce(po.filled, 0) AS filled FROM cd LEFT JOIN po ON po.table_name = cd.table_name AND po.column_name = cd.column_name),
    n AS (SELECT table_name, count(*) AS k, max(filled) AS most FROM cp GROUP BY table_name),
    best AS (SELECT table_name, column_name FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY filled DESC, column_name) AS rn FROM cp) q WHERE rn = 1),
    x AS (SELECT a.table_name, n.k, n.most, ov.column_name AS ov, CASE WHEN EXISTS (SELECT 1 FROM cd JOIN ok ON ok.table_name = cd.table_name AND ok.column_name = cd.column_name WHERE cd.table_name = a.table_name AND cd.column_name = st.column_name) THEN st.column_name END AS st, best.column_name AS best
      FROM (SELECT DISTINCT table_name FROM c) a LEFT JOIN n ON n.table_name = a.table_name LEFT JOIN ov ON ov.table_name = a.table_name LEFT JOIN st ON st.table_name = a.table_name LEFT JOIN best ON best.table_name = a.table_name),
    y AS (SELECT *, coalesce(ov, st, best) AS field FROM x),
    z AS (SELECT table_name, field, CASE WHEN k IS NULL THEN 'no-candidates' WHEN ov IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cd WHERE cd.table_name = y.table_name AND cd.column_name = ov) THEN 'override-invalid'
      WHEN ov IS NULL AND st IS NULL AND k > 1 AND most = 0 THEN 'all-candidates-empty' WHEN table_name NOT IN (SELECT table_name FROM t) THEN 'target-describe-failed'
      WHEN NOT EXISTS (SELECT 1 FROM ok WHERE ok.table_name = y.table_name AND ok.column_name = field) THEN 'target-missing-field' END AS reason FROM y)
    SELECT table_name, CASE WHEN reason IS NULL THEN 'picked' ELSE 'ambiguous' END AS kind, CASE WHEN reason IS NULL THEN field END AS field, reason FROM z"""
)
def upsert_decisions(spark, sf):
    made = [derive(spark, sf, s.format(columns=COLUMNS)) for s in (_O, _S, _P)]
    return catalog.upsert_decisions(columns(spark, sf), target_columns(spark, sf), *made)
