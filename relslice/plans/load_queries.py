"""Id maps, rewriting, upserts, cycles, masks, checks and reports (groups D, F, G, H and I of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mask
from ..model import STAR, ForeignKey
from ..operators import idmap, load, scope, verify
from ..operators.idmap import Rule
from ..sources.tables import dataset, spread, staged, table
from .derived import LOG, PARTIAL_MAP, ROOT, SALT, TARGET_CUSTOMERS, derive, plain
from .registry import query
from .scope_queries import COUNTS_SQL

TO_CUSTOMER = STAR["orders"].foreign_keys[0]
TO_ORDERS = STAR["lineitem"].foreign_keys[0]


def _minted(table_name: str, column: str) -> str:
    return f"substr(sha256('target:{table_name}:' || CAST({column} AS STRING)), 1, 24)"


def mint(df, name, key):
    return idmap.assign(df, name, key, "target")


LOG_SQL, P, TC = f"log AS ({plain(LOG)})", f"m AS ({plain(PARTIAL_MAP)})", f"tc AS ({plain(TARGET_CUSTOMERS)})"

# ---- id map


@query(f"SELECT 'orders' AS object, CAST(o_orderkey AS STRING) AS source_id, {_minted('orders', 'o_orderkey')} AS target_id FROM orders")
def idmap_assign(spark, sf):
    return mint(table(spark, sf, "orders"), "orders", "o_orderkey")


@query(f"WITH {P} SELECT 'customer' AS object, CAST(c_custkey AS STRING) AS source_id, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'S' || CAST(c_custkey AS STRING) END, m.target_id) AS target_id FROM customer LEFT JOIN m ON m.source_id = CAST(c_custkey AS STRING) WHERE c_custkey % 5 = 0 OR m.target_id IS NOT NULL")
def idmap_layered(spark, sf):
    """The session's map over the kept one; blank targets of the session do not count."""
    session = derive(spark, sf, "SELECT 'customer' AS object, CAST(c_custkey AS STRING) AS source_id, CASE WHEN c_custkey % 5 = 0 THEN 'S' || CAST(c_custkey AS STRING) ELSE '' END AS target_id FROM {customer}")
    return idmap.layered(derive(spark, sf, PARTIAL_MAP), session)


_OLD = "SELECT 'user' AS object, CAST(user_id AS STRING) AS source_id, 'e' || CAST(event_id AS STRING) AS target_id, event_id AS updated_at FROM {events} WHERE event_id % 3 <> 0"
_NEW = "SELECT 'user' AS object, CAST(user_id AS STRING) AS source_id, 'n' || CAST(event_id AS STRING) AS target_id, event_id AS updated_at FROM {events} WHERE event_id % 3 = 0"


@query(f"SELECT object, source_id, target_id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY object, source_id ORDER BY updated_at DESC) AS rn FROM ({plain(_OLD)} UNION ALL {plain(_NEW)}) u) q WHERE rn = 1")
def idmap_merge(spark, sf):
    return idmap.merge(derive(spark, sf, _OLD), derive(spark, sf, _NEW))


_LAST = lambda rows: f"SELECT object, source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY object, source_id ORDER BY updated_at DESC) AS rn FROM ({rows}) u) q WHERE rn = 1"


@query(
    f"""WITH a AS ({_LAST(plain(_OLD))}), b AS ({_LAST(f"{plain(_OLD)} UNION ALL {plain(_NEW)}")}) SELECT count(a.source_id) AS before, count(*) AS after, count(*) FILTER (a.source_id IS NULL) AS added,
    count(*) FILTER (a.target_id <> b.target_id) AS changed, count(*) FILTER (a.target_id = b.target_id) AS kept FROM b LEFT JOIN a ON a.source_id = b.source_id"""
)
def idmap_merge_sizes(spark, sf):
    return idmap.merge_sizes(derive(spark, sf, _OLD), derive(spark, sf, _NEW))


_MAPS = "SELECT c_nationkey % 5 AS map_id, 'customer' AS object, CAST(c_custkey AS STRING) AS source_id, 'C' || CAST(c_custkey AS STRING) AS target_id FROM {customer}"
_META = "SELECT n_nationkey AS map_id, CASE WHEN n_nationkey = 1 THEN 'other' ELSE 'here' END AS target, CASE WHEN n_nationkey = 2 THEN NULL WHEN n_nationkey = 3 THEN 'old' ELSE 'now' END AS stamp FROM {nation} WHERE n_nationkey BETWEEN 1 AND 4"


@query(f"WITH a AS ({plain(_MAPS)}), b AS ({plain(_META)}) SELECT a.map_id, object, source_id, target_id, CASE WHEN target IS NULL THEN 'meta-missing' WHEN target <> 'here' THEN 'target-changed' WHEN stamp IS NOT NULL AND stamp <> 'now' THEN 'target-refreshed' END AS reason FROM a LEFT JOIN b ON a.map_id = b.map_id")
def idmap_validity(spark, sf):
    return idmap.valid(derive(spark, sf, _MAPS), derive(spark, sf, _META), "here", "now")


_NAMES = "SELECT 'N' || CAST(c_custkey + 7 AS STRING) AS id, c_name AS name FROM {customer} WHERE c_custkey % 9 <> 1"


@query(f"SELECT 'customer' AS object, CAST(c_custkey AS STRING) AS source_id, id AS target_id FROM customer JOIN ({plain(_NAMES)}) t ON name = c_name")
def natural_key_map(spark, sf):
    return idmap.by_natural_key(table(spark, sf, "customer"), derive(spark, sf, _NAMES), "customer", "c_custkey", "c_name", "id", "name")


@query("SELECT c_name FROM customer WHERE c_custkey % 9 = 1")
def natural_key_unmapped(spark, sf):
    return idmap.unmatched_names(table(spark, sf, "customer"), derive(spark, sf, _NAMES), "c_name", "name")


# ---- rewriting


def _orders(spark, sf):
    return derive(spark, sf, "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS o_custkey, o_totalprice FROM {orders}")


_O = "o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS o_custkey, o_totalprice FROM orders)"


@query(f"WITH {_O} SELECT o_orderkey, CASE WHEN o_custkey IS NOT NULL THEN {_minted('customer', 'o_custkey')} END AS o_custkey, {_minted('orders', 'o_orderkey')} AS target_id, o_totalprice FROM o")
def fk_remap(spark, sf):
    """Orders and their customers under new ids; every id is in the map."""
    ids = mint(table(spark, sf, "customer"), "customer", "c_custkey").union(mint(table(spark, sf, "orders"), "orders", "o_orderkey"))
    return idmap.remap(_orders(spark, sf), "orders", "o_orderkey", [Rule(TO_CUSTOMER)], ids).select("o_orderkey", "o_custkey", "target_id", "o_totalprice")


_LOST = "o_custkey IS NOT NULL AND m.target_id IS NULL"
_JOINED = "FROM o LEFT JOIN m ON m.source_id = CAST(o_custkey AS STRING)"


@query(f"WITH {_O}, {P} SELECT o_orderkey, m.target_id AS o_custkey, CASE WHEN {_LOST} THEN 'unresolved:o_custkey' END AS reject_reason {_JOINED}")
def fk_remap_partial(spark, sf):
    """The map lacks customers and the key is required: those rows are rejected, as data."""
    return idmap.remap(_orders(spark, sf), "orders", "o_orderkey", [Rule(TO_CUSTOMER, "reject")], derive(spark, sf, PARTIAL_MAP)).select("o_orderkey", "o_custkey", "reject_reason")


@query(f"WITH {_O}, {P} SELECT o_orderkey, m.target_id AS o_custkey, CASE WHEN {_LOST} THEN 'o_custkey' ELSE '' END AS omitted {_JOINED}")
def fk_remap_omit(spark, sf):
    """Keys to tables that are not copied are left out, which is not the same as null."""
    return idmap.remap(_orders(spark, sf), "orders", "o_orderkey", [Rule(TO_CUSTOMER, "omit")], derive(spark, sf, PARTIAL_MAP)).select("o_orderkey", "o_custkey", F.array_join("_omit", ",").alias("omitted"))


@query(f"WITH m AS ({plain(PARTIAL_MAP)} UNION ALL SELECT 'supplier', CAST(s_suppkey AS STRING), 'S' || CAST(s_suppkey AS STRING) FROM supplier) SELECT event_id, m.target_id AS user_id FROM events LEFT JOIN m ON m.object = CASE WHEN event_id % 2 = 0 THEN 'customer' ELSE 'supplier' END AND m.source_id = CAST(user_id AS STRING)")
def fk_remap_polymorphic(spark, sf):
    """A key that points to customers or suppliers, as a type column says."""
    events = derive(spark, sf, "SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'customer' ELSE 'supplier' END AS user_type FROM {events}")
    ids = derive(spark, sf, f"{PARTIAL_MAP} UNION ALL SELECT 'supplier', CAST(s_suppkey AS STRING), 'S' || CAST(s_suppkey AS STRING) FROM {{supplier}}")
    key = ForeignKey("events", "user_id", ("customer", "supplier"), type_column="user_type")
    return idmap.remap(events, "events", "event_id", [Rule(key)], ids).select("event_id", "user_id")


@query(f"WITH {_O}, {P} SELECT coalesce(CASE WHEN {_LOST} THEN 'unresolved:o_custkey' END, 'accepted') AS reason, count(*) AS n {_JOINED} GROUP BY 1")
def reject_counts(spark, sf):
    rows = idmap.remap(_orders(spark, sf), "orders", "o_orderkey", [Rule(TO_CUSTOMER, "reject")], derive(spark, sf, PARTIAL_MAP))
    return rows.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0")
def dedup_already_seeded(spark, sf):
    return idmap.not_yet_loaded(table(spark, sf, "customer"), "customer", "c_custkey", derive(spark, sf, PARTIAL_MAP)).select("c_custkey", "c_name")


@query(f"SELECT 'customer' AS table_name, count(*) AS in_scope, count(*) FILTER (c_custkey % 3 <> 0) AS mapped FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {ROOT}) UNION ALL SELECT 'orders', count(*), 0 FROM orders WHERE {ROOT}")
def already_seeded_counts(spark, sf):
    roots = table(spark, sf, "orders").where(ROOT)
    customers = scope.parent_of(table(spark, sf, "customer"), "c_custkey", roots, "o_custkey")
    return idmap.already_loaded_counts({"customer": (customers, "c_custkey"), "orders": (roots, "o_orderkey")}, derive(spark, sf, PARTIAL_MAP))


_OWNED = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS owner, CASE WHEN event_id % 4 = 0 THEN user_id END AS created_by FROM {events}"


@query(f"SELECT count(coalesce(owner, created_by)) AS n FROM ({plain(_OWNED)}) e")
def defaulted_ref_counts(spark, sf):
    return idmap.first_references(derive(spark, sf, _OWNED), ["owner", "created_by"])


_FAILED = "SELECT lpad(CAST(o_orderkey AS STRING), 12, '0') AS row_key, o_custkey FROM {orders} WHERE o_orderkey % 10 = 0"


@query(
    f"""WITH {P}, f AS ({plain(_FAILED)}), s AS (SELECT m.source_id, m.target_id, row_key FROM f JOIN m ON m.source_id = CAST(o_custkey AS STRING) WHERE CAST(m.source_id AS BIGINT) % 4 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY row_key) AS rn, count(*) OVER (PARTITION BY source_id) AS n FROM s)
    SELECT source_id, target_id, string_agg(row_key, ',' ORDER BY row_key) AS row_keys, any_value(n) AS n FROM r WHERE rn <= 5 GROUP BY source_id, target_id"""
)
def stale_idmap_entries(spark, sf):
    live = derive(spark, sf, "SELECT 'C' || CAST(c_custkey AS STRING) AS id FROM {customer} WHERE c_custkey % 4 = 0")
    return idmap.stale_entries(derive(spark, sf, _FAILED), "o_custkey", "customer", derive(spark, sf, PARTIAL_MAP), live, "id")


@query(f"WITH {TC} SELECT 'customer' AS object, CAST(c_custkey AS STRING) AS source_id, tc.id AS target_id FROM customer JOIN tc ON tc.name = c_name")
def duplicate_recovery(spark, sf):
    return idmap.adopt_duplicates(table(spark, sf, "customer"), "c_custkey", "c_name", derive(spark, sf, TARGET_CUSTOMERS), "name", "id", "customer")


@query(f"WITH {LOG_SQL} SELECT source_id, regexp_extract(message, '{verify.DUPLICATE_ID}', 1) AS target_id FROM log WHERE status_code = 'DUPLICATE_VALUE' AND regexp_extract(message, '{verify.DUPLICATE_ID}', 1) <> ''")
def log_duplicate_ids(spark, sf):
    return verify.duplicate_ids(derive(spark, sf, LOG))


# ---- upserts

_KEYED = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_name END AS ext, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS legacy, CAST(NULL AS STRING) AS never FROM {customer}"
_FILLED = f"SELECT 'ext' AS column_name, count(ext) AS filled FROM ({plain(_KEYED)}) a UNION ALL SELECT 'legacy', count(legacy) FROM ({plain(_KEYED)}) b UNION ALL SELECT 'never', count(never) FROM ({plain(_KEYED)}) c"


@query(_FILLED)
def key_population(spark, sf):
    return load.key_population(derive(spark, sf, _KEYED), ["ext", "legacy", "never"])


@query(f"SELECT CASE WHEN filled > 0 THEN column_name END AS column_name, filled FROM ({_FILLED}) f ORDER BY filled DESC, column_name LIMIT 1")
def pick_upsert_key(spark, sf):
    return load.pick_key(load.key_population(derive(spark, sf, _KEYED), ["ext", "legacy", "never"]))


_KEPT = "SELECT p_brand AS table_name, CASE WHEN p_size % 2 = 0 THEN 'ExternalId__c' ELSE 'LegacyKey__c' END AS column_name, p_partkey AS updated_at FROM {part}"


@query(f"SELECT table_name, column_name FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY updated_at DESC) AS rn FROM ({plain(_KEPT)}) k) q WHERE rn = 1")
def sticky_keys_merge(spark, sf):
    """The last choice per table wins."""
    return load.merge_sticky(derive(spark, sf, _KEPT)).select("table_name", "column_name")


@query(f"SELECT CASE WHEN ext IS NOT NULL AND ext <> '' THEN 'UPSERT' ELSE 'INSERT' END AS route, count(*) AS n FROM ({plain(_KEYED)}) k GROUP BY 1")
def upsert_route_counts(spark, sf):
    return load.route(derive(spark, sf, _KEYED), "ext").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


_UPDATES = "SELECT c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS acctbal, 'moved' AS segment, c_custkey % 5 = 0 AS keep_segment FROM {customer} WHERE c_custkey % 6 < 4"


def _upserted(spark, sf):
    updates = derive(spark, sf, _UPDATES)
    updates = updates.withColumn("_omit", F.when(F.col("keep_segment"), F.array(F.lit("segment"))).otherwise(F.array().cast("array<string>")))
    return load.upsert(derive(spark, sf, TARGET_CUSTOMERS), updates, "name", ["acctbal", "segment"])


_UPSERT = f"WITH {TC}, u AS ({plain(_UPDATES)}) SELECT coalesce(tc.name, u.name) AS name, CASE WHEN u.name IS NOT NULL THEN u.acctbal ELSE tc.acctbal END AS acctbal, CASE WHEN u.name IS NOT NULL AND NOT keep_segment THEN u.segment ELSE tc.segment END AS segment, tc.name IS NULL AS created FROM tc FULL OUTER JOIN u ON tc.name = u.name"


@query(_UPSERT)
def upsert_merge(spark, sf):
    return _upserted(spark, sf)


@query(f"SELECT created, count(*) AS n FROM ({_UPSERT}) q GROUP BY created")
def upsert_created_flags(spark, sf):
    return _upserted(spark, sf).groupBy("created").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TC} SELECT name, id, acctbal, segment FROM tc UNION ALL SELECT c_name, NULL, c_acctbal, NULL FROM customer WHERE c_custkey % 4 = 1")
def insert_append(spark, sf):
    return load.insert(derive(spark, sf, TARGET_CUSTOMERS), derive(spark, sf, "SELECT c_name AS name, c_acctbal AS acctbal FROM {customer} WHERE c_custkey % 4 = 1")).select("name", "id", "acctbal", "segment")


@query("SELECT p_name AS key, count(*) AS n FROM part WHERE p_name <> '' GROUP BY p_name HAVING count(*) > 1")
def upsert_key_dupes(spark, sf):
    return load.duplicate_keys(table(spark, sf, "part"), "p_name")


# ---- cycles: customers name their first order, orders their customer

_FIRST = "SELECT c_custkey, c_name, first_order FROM {customer} LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM {orders} GROUP BY o_custkey) f ON o_custkey = c_custkey"


def _cycle(spark, sf):
    return derive(spark, sf, _FIRST), ForeignKey("customer", "first_order", ("orders",))


@query(f"SELECT c_custkey, CAST(NULL AS STRING) AS first_order, CASE WHEN c_custkey % 2 = 0 THEN 'first_order' ELSE '' END AS omitted, {_minted('customer', 'c_custkey')} AS target_id FROM customer")
def cycle_phase1(spark, sf):
    """Members are written with the broken key null (inserts) or left out (upserts)."""
    rows, key = _cycle(spark, sf)
    rows = rows.withColumn("ext", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))
    done = load.first_phase(rows, "customer", "c_custkey", "first_order", [Rule(key)], mint(rows, "customer", "c_custkey"), "ext")
    return done.select("c_custkey", "first_order", F.array_join("_omit", ",").alias("omitted"), "target_id")


_BACK = f"""WITH c AS ({plain(_FIRST)}) SELECT CAST(c_custkey AS STRING) AS source_id, CASE WHEN c_custkey % 13 <> 0 THEN {_minted('customer', 'c_custkey')} END AS target_id,
  CASE WHEN first_order % 5 <> 0 THEN {_minted('orders', 'first_order')} END AS fk_target_id,
  CASE WHEN first_order % 5 = 0 THEN 'unresolved-target' WHEN c_custkey % 13 = 0 THEN 'unresolved-self' END AS reason FROM c WHERE first_order IS NOT NULL"""


def _backfill(spark, sf):
    rows, _ = _cycle(spark, sf)
    ids = mint(table(spark, sf, "customer").where("c_custkey % 13 <> 0"), "customer", "c_custkey").union(mint(table(spark, sf, "orders").where("o_orderkey % 5 <> 0"), "orders", "o_orderkey"))
    return load.backfill(rows, "customer", "c_custkey", "first_order", "orders", ids)


@query(f"SELECT target_id, fk_target_id FROM ({_BACK}) b WHERE reason IS NULL")
def cycle_backfill(spark, sf):
    return _backfill(spark, sf).where("reason is null").select("target_id", "fk_target_id")


@query(f"SELECT reason, count(*) AS n FROM ({_BACK}) b WHERE reason IS NOT NULL GROUP BY reason")
def cycle_unresolved(spark, sf):
    return _backfill(spark, sf).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- masks


def _hex(b: bytes) -> str:
    return f"from_hex('{b.hex()}')"


def digest_sql(value: str) -> str:
    inner, outer = mask.pads(SALT)
    return f"sha256({_hex(outer)} || from_hex(sha256({_hex(inner)} || encode({value}))))"


def draw_sql(digest: str, k: int) -> str:
    return f"CAST('0x' || substr({digest}, {1 + 8 * k}, 8) AS BIGINT)"


def _list(words: list[str], n: str) -> str:
    return f"[{', '.join(repr(w) for w in words)}][1 + {n} % {len(words)}]"


def preset_sql(name: str, d: str) -> str:
    a, b, c, e = (draw_sql(d, k) for k in range(4))
    return {
        "email": f"lower({_list(mask.FIRST_NAMES, a)} || '.' || {_list(mask.LAST_NAMES, b)} || substr({d}, 17, 6) || '@example.com')",
        "phone": f"substr(lpad(CAST({a} * 4 + {b} % 4 AS STRING), 11, '0'), 2, 3) || '-' || substr(lpad(CAST({a} * 4 + {b} % 4 AS STRING), 11, '0'), 5, 3) || '-' || substr(lpad(CAST({a} * 4 + {b} % 4 AS STRING), 11, '0'), 8, 4)",
        "person-name": f"{_list(mask.FIRST_NAMES, a)} || ' ' || {_list(mask.FIRST_NAMES, e)} || ' ' || {_list(mask.LAST_NAMES, b)} || '-' || {_list(mask.LAST_NAMES, c)}",
        "street-address": f"CAST({a} % 9899 + 1 AS STRING) || ' ' || {_list(mask.STREETS, b)}",
        "postal-code": f"CAST(10000 + {a} % 90000 AS STRING)",
        "generic-text": f"{_list(mask.WORDS, a)} || {_list(mask.WORDS, b)} || ' ' || {_list(mask.WORDS, c)} || {_list(mask.WORDS, e)}",
    }[name]


_VALUES = "SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '' ELSE c_name || ' é' END AS v FROM {customer}"


def _masked(strategy: str, length: int | None = None):
    def run(spark, sf):
        return derive(spark, sf, _VALUES).select("k", mask.mask(F.col("v"), strategy, SALT, length).alias("masked"))

    return run


def _masked_sql(strategy: str, length: int | None = None) -> str:
    made = preset_sql(strategy, "d")
    made = f"substr({made}, 1, {length})" if length else made
    return f"SELECT k, CASE WHEN v IS NULL OR v = '' THEN v ELSE {made} END AS masked FROM (SELECT *, {digest_sql('v')} AS d FROM ({plain(_VALUES)}) x) y"


for _name, _strategy, _length in (("mask_email", "email", 20), ("mask_phone", "phone", None), ("mask_person_name", "person-name", None), ("mask_street", "street-address", 12), ("mask_postal", "postal-code", None), ("mask_text", "generic-text", None)):
    _run = _masked(_strategy, _length)
    _run.__name__ = _name
    query(_masked_sql(_strategy, _length))(_run)


@query(f"SELECT k, {draw_sql('d', 0)} AS seed FROM (SELECT *, {digest_sql('v')} AS d FROM ({plain(_VALUES)}) x) y")
def mask_seed(spark, sf):
    return derive(spark, sf, _VALUES).select("k", mask.seed(F.col("v"), SALT).alias("seed"))


_TYPED = "SELECT c_custkey AS k, c_name AS v, CASE c_custkey % 8 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'person-name' WHEN 3 THEN 'street-address' WHEN 4 THEN 'postal-code' WHEN 5 THEN 'generic-text' WHEN 6 THEN 'copy' ELSE 'no-such' END AS strategy, CAST(5 + c_custkey % 20 AS INT) AS length FROM {customer}"
_PICKED = "CASE strategy " + " ".join(f"WHEN '{p}' THEN substr({preset_sql(p, 'd')}, 1, length)" for p in mask.PRESETS) + " END"


@query(f"SELECT k, CASE WHEN strategy = 'copy' THEN v ELSE {_PICKED} END AS masked, CASE WHEN strategy = 'no-such' THEN 'unmaskable' END AS reject_reason FROM (SELECT *, {digest_sql('v')} AS d FROM ({plain(_TYPED)}) x) y")
def mask_table(spark, sf):
    """A strategy per row; copied values stay, and a strategy that does not exist rejects the row."""
    rows = derive(spark, sf, _TYPED)
    masked = F.when(F.col("strategy") == "copy", F.col("v")).otherwise(mask.mask_by_strategy(F.col("v"), F.col("strategy"), SALT, F.col("length")))
    return rows.withColumn("masked", masked).select("k", "masked", F.when(F.col("v").isNotNull() & F.col("masked").isNull(), "unmaskable").alias("reject_reason"))


#: What a target might hold: right masks, clear values, another column's mask, cut ones.
_KINDS = "k % 10"


def _loaded(spark, sf):
    """(k, v, target, own, other): source values, what the target holds, and the masks of two presets."""
    rows = derive(spark, sf, _VALUES).withColumn("own", mask.mask(F.col("v"), "email", SALT)).withColumn("other", mask.mask(F.col("v"), "phone", SALT))
    kind = F.col("k") % 10
    target = F.when(kind == 3, F.col("v")).when(kind == 4, F.col("other")).when(kind == 5, F.substring("own", 1, 9)).when(kind == 6, F.lit("")).when(kind == 7, F.lit("x")).otherwise(F.col("own"))
    return rows.withColumn("target", target)


_LOADED = f"""l AS (SELECT *, CASE k % 10 WHEN 3 THEN v WHEN 4 THEN other WHEN 5 THEN substr(own, 1, 9) WHEN 6 THEN '' WHEN 7 THEN 'x' ELSE own END AS target FROM
  (SELECT k, v, CASE WHEN v IS NULL OR v = '' THEN v ELSE {preset_sql('email', 'd')} END AS own, CASE WHEN v IS NULL OR v = '' THEN v ELSE {preset_sql('phone', 'd')} END AS other FROM (SELECT *, {digest_sql('v')} AS d FROM ({plain(_VALUES)}) x) y) z)"""


@query(f"WITH {_LOADED} SELECT 'v' AS column_name, CASE WHEN v IS NULL OR v = '' THEN CASE WHEN target IS NOT DISTINCT FROM v THEN 'empty-kept' ELSE 'mismatch' END WHEN target = own THEN 'match' WHEN target = v THEN 'leak' ELSE 'mismatch' END AS bucket, count(*) AS n FROM l GROUP BY 2")
def mask_verify(spark, sf):
    return verify.mask_report(_loaded(spark, sf), [("v", F.col("v"), F.col("target"), F.col("own"))])


def _by_preset(spark, sf):
    rows = _loaded(spark, sf).where("v <> ''")
    return rows.select(F.lit("email").alias("preset"), F.col("v").alias("source"), F.col("own").alias("masked")).union(rows.select(F.lit("email"), "v", "target").where("k % 20 = 3"))


@query(f"WITH {_LOADED}, p AS (SELECT 'email' AS preset, v AS source, own AS masked FROM l WHERE v <> '' UNION ALL SELECT 'email', v, target FROM l WHERE v <> '' AND k % 20 = 3) SELECT preset, source, count(DISTINCT masked) AS outputs FROM p GROUP BY 1, 2 HAVING count(DISTINCT masked) > 1")
def mask_consistency(spark, sf):
    return verify.inconsistent(_by_preset(spark, sf))


_POSTAL = f"SELECT 'postal-code' AS preset, c_name AS source, {preset_sql('postal-code', 'd')} AS masked FROM (SELECT c_name, {digest_sql('c_name')} AS d FROM customer) x"


@query(f"SELECT preset, masked, count(DISTINCT source) AS sources FROM ({_POSTAL}) p GROUP BY 1, 2 HAVING count(DISTINCT source) > 1")
def mask_collisions(spark, sf):
    """Masks are many-to-one; a unique key may only be masked if this is empty."""
    values = table(spark, sf, "customer").select(F.lit("postal-code").alias("preset"), F.col("c_name").alias("source"), mask.mask(F.col("c_name"), "postal-code", SALT).alias("masked"))
    return verify.collisions(values)


#: Postal codes, each of another customer.
_CODES = "SELECT c_custkey AS k, lpad(CAST((c_custkey * 7919) % 100003 AS STRING), 6, '0') AS v FROM {customer}"


def _permuted_sql() -> str:
    out = f"SELECT k, v, CAST(substr(v, 1, 3) AS BIGINT) AS l, CAST(substr(v, 4) AS BIGINT) AS r FROM ({plain(_CODES)}) x"
    for i in range(mask.ROUNDS):
        half, other = ("l", "r") if i % 2 == 0 else ("r", "l")
        said = digest_sql(f"'{i}:6:' || CAST({other} AS STRING)")
        new = f"({half} + CAST('0x' || substr({said}, 1, 15) AS BIGINT) % 1000) % 1000 AS {half}"
        out = f"SELECT k, v, {new if half == 'l' else 'l'}, {new if half == 'r' else 'r'} FROM ({out}) q{i}"
    return f"SELECT k, v, lpad(CAST(l AS STRING), 3, '0') || lpad(CAST(r AS STRING), 3, '0') AS masked FROM ({out}) q"


@query(f"SELECT k, masked FROM ({_permuted_sql()}) p")
def mask_permuted(spark, sf):
    """A mask that is one-to-one: digits under a keyed permutation."""
    return spread(derive(spark, sf, _CODES), "k").select("k", mask.permute_digits(F.col("v"), SALT).alias("masked"))


@query(f"SELECT 'permuted' AS preset, masked, count(DISTINCT v) AS sources FROM ({_permuted_sql()}) p GROUP BY 1, 2 HAVING count(DISTINCT v) > 1")
def mask_permuted_collisions(spark, sf):
    """A unique key stays unique: no two codes share a mask."""
    return verify.collisions(spread(derive(spark, sf, _CODES), "k").select(F.lit("permuted").alias("preset"), F.col("v").alias("source"), mask.permute_digits(F.col("v"), SALT).alias("masked")))


@query(f"WITH {_LOADED} SELECT target AS value, count(*) AS n FROM l WHERE target IN (SELECT v FROM l WHERE v <> '') GROUP BY target")
def mask_leak_scan(spark, sf):
    rows = _loaded(spark, sf)
    return verify.leaks(rows, "v", rows.select("target"), "target")


@query(f"WITH {_LOADED} SELECT k, CASE WHEN target = own THEN NULL WHEN target = other THEN 'other-column' WHEN target = '' THEN 'empty' WHEN starts_with(own, target) THEN 'truncated' ELSE 'unknown' END AS reason FROM l WHERE v <> ''")
def mask_mismatch_reason(spark, sf):
    return _loaded(spark, sf).where("v <> ''").select("k", verify.mismatch_reason(F.col("target"), F.col("own"), F.col("other")).alias("reason"))


# ---- reports, fingerprints, batches, clean-up


@query(
    f"WITH s AS ({COUNTS_SQL}), m AS (SELECT 'customer' AS table_name, count(*) AS mapped FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE {ROOT})) SELECT s.table_name, s.kinds, s.n, coalesce(m.mapped, 0) AS mapped, s.n - coalesce(m.mapped, 0) AS to_load FROM s LEFT JOIN m ON m.table_name = s.table_name"
)
def preview_summary(spark, sf):
    """What a run would do, per table; nothing is written to the target."""
    data = dataset(spark, sf)
    ids = staged(scope.scan_ids(data.tables["orders"], "o_orderkey", ROOT), "roots")
    scopes = scope.star_scopes(data, ids)
    mapped = idmap.already_loaded_counts({"customer": (scopes["customer"][1], "c_custkey")}, derive(spark, sf, PARTIAL_MAP)).select("table_name", "mapped")
    n = F.coalesce("mapped", F.lit(0))
    return scope.scope_counts(scopes).join(mapped, "table_name", "left").select("table_name", "kinds", "n", n.alias("mapped"), (F.col("n") - n).alias("to_load"))


@query(f"WITH {LOG_SQL} SELECT table_name, outcome, count(*) AS n FROM log GROUP BY 1, 2")
def load_summary(spark, sf):
    return verify.load_summary(derive(spark, sf, LOG))


def _fingerprint_sql(name: str, key: str, where: str = "TRUE") -> str:
    words = " || '-' || ".join(f"CAST(coalesce(sum({draw_sql('h', k)}), 0) AS STRING)" for k in range(3))
    return f"SELECT '{name}' AS table_name, count(*) AS n, {words} AS digest FROM (SELECT sha256(CAST({key} AS STRING)) AS h FROM {name} WHERE {where}) x"


@query(_fingerprint_sql("orders", "o_orderkey", ROOT))
def id_set_fingerprint(spark, sf):
    return verify.id_set_fingerprint(scope.scan_ids(table(spark, sf, "orders"), "o_orderkey", ROOT), "orders", "o_orderkey")


@query(f"WITH a AS (SELECT count(*) AS n FROM orders WHERE {ROOT}), b AS (SELECT count(*) AS n FROM orders WHERE {ROOT} AND o_orderkey % 50 <> 0) SELECT 'orders' AS table_name, a.n AS n_before, b.n AS n_now FROM a, b WHERE a.n <> b.n")
def plan_drift_check(spark, sf):
    """Scopes of a preview against scopes of now; customers have not changed, some orders have gone."""
    orders, customers = table(spark, sf, "orders").where(ROOT), table(spark, sf, "customer")
    same = verify.id_set_fingerprint(customers, "customer", "c_custkey")
    before = same.union(verify.id_set_fingerprint(orders, "orders", "o_orderkey"))
    now = same.union(verify.id_set_fingerprint(orders.where("o_orderkey % 50 <> 0"), "orders", "o_orderkey"))
    return verify.drift(before, now)


def _steps(spark, sf):
    customers = table(spark, sf, "customer").where("c_custkey % 4 <> 2")
    orders = table(spark, sf, "orders")
    steps = [("customer", customers, "c_custkey", []), ("orders", orders, "o_orderkey", [Rule(TO_CUSTOMER, "reject")])]
    return load.stitch(steps, derive(spark, sf, PARTIAL_MAP), mint)


_STITCH = """SELECT 'customer' AS table_name, CASE WHEN c_custkey % 3 <> 0 THEN 'already-loaded' ELSE 'inserted' END AS outcome, count(*) AS n FROM customer WHERE c_custkey % 4 <> 2 GROUP BY 2
  UNION ALL SELECT 'orders', CASE WHEN o_custkey % 3 = 0 AND o_custkey % 4 = 2 THEN 'rejected' ELSE 'inserted' END, count(*) FROM orders GROUP BY 2"""


@query(_STITCH)
def multi_step_stitch(spark, sf):
    """Two steps over one id map: orders find customers of the first step and of earlier runs."""
    return _steps(spark, sf)[0]


@query(f"SELECT table_name, outcome, CAST(sum(n) AS BIGINT) AS n FROM ({_STITCH}) s GROUP BY ROLLUP (table_name, outcome)")
def multi_step_rollup(spark, sf):
    return load.rollup_steps(_steps(spark, sf)[0])


@query(f"WITH {LOG_SQL}, x AS (SELECT source_id, unnest(list_distinct(regexp_extract_all(message, '{verify.ERROR_CODE}', 1))) AS code FROM log) SELECT source_id, code FROM x")
def log_error_codes(spark, sf):
    return derive(spark, sf, LOG).select("source_id", F.explode(verify.error_codes(F.col("message"))).alias("code"))


@query(
    f"""WITH {LOG_SQL}, x AS (SELECT status, list_sort(list_distinct(regexp_extract_all(message, '{verify.ERROR_CODE}', 1))) AS codes FROM log)
    SELECT 'HTTP ' || CAST(status AS STRING) || CASE WHEN len(codes) > 0 THEN ' (' || array_to_string(codes, ', ') || ')' ELSE '' END AS summary, count(*) AS n FROM x GROUP BY 1"""
)
def log_error_summary(spark, sf):
    return verify.error_summary(derive(spark, sf, LOG))


_BASE = "SELECT 'customer' AS object, 'T' || CAST(c_custkey AS STRING) AS target_id FROM {customer} WHERE c_custkey % 8 = 0"
_RUN = "SELECT 'customer' AS object, 'T' || CAST(c_custkey AS STRING) AS target_id FROM {customer} WHERE c_custkey % 16 < 8 UNION ALL SELECT 'nation', CAST(n_nationkey AS STRING) FROM {nation}"


@query(f"WITH {TC} SELECT name, id FROM tc WHERE id NOT IN (SELECT target_id FROM ({plain(_RUN)}) r WHERE object = 'customer' AND target_id NOT IN (SELECT target_id FROM ({plain(_BASE)}) b))")
def cleanup_run(spark, sf):
    return load.clean_up(derive(spark, sf, TARGET_CUSTOMERS), "customer", "id", derive(spark, sf, _RUN), derive(spark, sf, _BASE), ["nation"]).select("name", "id")


@query(f"SELECT CAST(c_custkey AS STRING) AS source_id, {_minted('customer', 'c_custkey')} AS target_id FROM customer")
def resume_idempotent(spark, sf):
    """A load that broke off half-way and is run again: the map ends up as after one run."""
    customers = table(spark, sf, "customer")
    first = staged(mint(customers.where("c_custkey % 2 = 0"), "customer", "c_custkey"), "half-a-map")
    rest = mint(idmap.not_yet_loaded(customers, "customer", "c_custkey", first), "customer", "c_custkey")
    return idmap.layered(first, rest).select("source_id", "target_id")
