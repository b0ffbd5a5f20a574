"""Meaning of the operators on tiny tables: null against left out, rejects, stale maps, order validity, plans."""

from __future__ import annotations

import hashlib
import hmac
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relslice.functions import mask
from relslice.model import Dataset, ForeignKey, TableSpec
from relslice.operators import catalog, graph, idmap, load, scope, verify
from relslice.operators.idmap import Rule
from relslice.sources import tables

EDGES = "src string, dst string, field string, nillable boolean, master_detail boolean, polymorphic boolean, kind string, pos int"


def edges(spark, pairs, nillable=True):
    return spark.createDataFrame([(a, b, f"f{i}", nillable, False, False, "self" if a == b else "parent", i) for i, (a, b) in enumerate(pairs)], EDGES)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def id_map(spark, pairs, name="p"):
    return spark.createDataFrame([(name, s, t) for s, t in pairs], "object string, source_id string, target_id string")


@pytest.mark.parametrize(
    "pairs, expected",
    [
        ([("a", "b"), ("b", "c")], []),
        ([("a", "a")], [("a", "a")]),
        ([("a", "b"), ("b", "a"), ("c", "a")], [("a", "a"), ("b", "a")]),
        ([("a", "b"), ("b", "a"), ("a", "a")], [("a", "a"), ("b", "a")]),
        ([(f"n{i:02}", f"n{(i + 1) % 9:02}") for i in range(9)] + [("x", "n00"), ("n03", "y"), ("y", "z"), ("z", "y")], [(f"n{i:02}", "n00") for i in range(9)] + [("y", "y"), ("z", "y")]),
    ],
)
def test_components(spark, pairs, expected):
    assert rows(graph.components(edges(spark, pairs))) == sorted(expected)


def test_load_waves_puts_parents_first(spark):
    e = edges(spark, [("c", "b"), ("b", "a"), ("a", "b"), ("d", "c"), ("d", "a"), ("e", "d")])
    waves = dict(rows(graph.load_waves(e, graph.components(e))))
    assert waves["a"] == waves["b"] < waves["c"] < waves["d"] < waves["e"]


def test_break_edge_prefers_nillable_edges_to_others(spark):
    e = edges(spark, [("a", "a"), ("a", "b"), ("b", "a")])
    assert rows(graph.break_edges(e, graph.components(e))) == [("a", 3, "a", "f1", "b")]
    hard = edges(spark, [("a", "b"), ("b", "a")], nillable=False)
    assert rows(graph.break_edges(hard, graph.components(hard))) == [("a", 2, None, None, None)]


def test_walk_counts_hops_exactly_and_does_not_expand_stops(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "s"), ("s", "t"), ("d", "a")])
    start, stop = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("s",)], "node string")
    assert rows(graph.walk(e, start, 2, stop)) == [("a", 0), ("b", 1), ("c", 2), ("s", 1)]


def test_required_chain_closes_transitively_and_optional_does_not(spark):
    must = edges(spark, [("r", "a"), ("a", "b")], nillable=False).union(edges(spark, [("b", "c")]))
    none = spark.createDataFrame([], "node string")
    assert rows(graph.classify(must, "r", 3, none)) == [("a", "must-include"), ("b", "must-include"), ("c", "optional-parent")]


def test_remap_null_reject_omit(spark):
    df = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, p long")
    key, ids = ForeignKey("c", "p", ("p",)), id_map(spark, [("10", "T10")])
    kept = lambda how: rows(idmap.remap(df, "c", "id", [Rule(key, how)], ids).select("id", "p", F.array_join("_omit", ","), "reject_reason"))
    assert kept("null") == [(1, "T10", "", None), (2, None, "", None), (3, None, "", None)]
    assert kept("omit") == [(1, "T10", "", None), (2, None, "p", None), (3, None, "", None)]
    assert kept("reject") == [(1, "T10", "", None), (2, None, "", "unresolved:p"), (3, None, "", None)]


def test_polymorphic_key_needs_a_type_column():
    with pytest.raises(ValueError):
        ForeignKey("task", "what", ("account", "case"))


def test_upsert_keeps_what_is_left_out_and_writes_nulls(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("z", 9, "z")], "k string, n int, s string")
    new = spark.createDataFrame([("a", None, None, ["s"]), ("b", None, None, []), ("c", 3, "w", [])], "k string, n int, s string, _omit array<string>")
    assert rows(load.upsert(target, new, "k", ["n", "s"])) == [("a", None, "x", False), ("b", None, None, False), ("c", 3, "w", True), ("z", 9, "z", False)]


def test_upsert_twice_is_upsert_once(spark):
    target = spark.createDataFrame([("a", 1)], "k string, n int")
    new = spark.createDataFrame([("a", 5), ("b", 6)], "k string, n int")
    once = load.upsert(target, new, "k", ["n"]).drop("created")
    assert rows(load.upsert(once, new, "k", ["n"]).drop("created")) == rows(once)


def test_no_candidate_is_filled(spark):
    df = spark.createDataFrame([(None, None)], "b string, a string")
    assert rows(load.pick_key(load.key_population(df, ["b", "a"]))) == [(None, 0)]


@pytest.mark.parametrize("target, stamp, reason", [("here", "now", None), ("there", "now", "target-changed"), ("here", "later", "target-refreshed"), ("here", None, None)])
def test_map_validity(spark, target, stamp, reason):
    m = id_map(spark, [("1", "T")]).withColumn("map_id", F.lit(1))
    meta = spark.createDataFrame([(1, "here", "now")], "map_id int, target string, stamp string")
    assert idmap.valid(m, meta, target, stamp).first().reason == reason
    assert idmap.valid(m, meta.where("map_id = 2"), target, stamp).first().reason == "meta-missing"


def test_cycle_backfill_reasons(spark):
    df = spark.createDataFrame([("1", "7"), ("2", "8"), ("3", "7"), ("4", ""), ("5", None)], "id string, fk string")
    ids = id_map(spark, [("1", "A1"), ("2", "A2")], "a").union(id_map(spark, [("7", "B7")], "b"))
    assert rows(load.backfill(df, "a", "id", "fk", "b", ids).select("source_id", F.coalesce("reason", F.lit("ok")))) == [("1", "ok"), ("2", "unresolved-target"), ("3", "unresolved-self")]


def test_where_any_keeps_equal_rows_apart(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (3, 7)], "a int, b int")
    assert rows(scope.where_any(df, [("a", df.where("a = 1").select("a")), ("b", df.where("b in (5, 6)").select("b"))])) == [(1, 5), (1, 5), (2, 6)]


def test_guard_states(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [scope.guard(df, "k", p, 5, s).first().status for p, s in (("k < 0", None), ("k < 5", None), ("k < 6", None), ("k < 9", 3), ("k < 9", 8))] == ["empty", "ok", "over-cap", "ok", "sample-over-cap"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=20), min_size=1, max_size=8))
def test_digest_is_hmac_and_masks_are_stable(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", mask.keyed_digest(F.col("v"), "salt").alias("d"), mask.mask(F.col("v"), "email", "salt", 15).alias("m")).collect()
    seen: dict[str, str] = {}
    for r in got:
        assert r.d == hmac.new(b"salt", r.v.encode(), hashlib.sha256).hexdigest()
        assert len(r.m) <= 15 and r.m == r.m.lower() and seen.setdefault(r.v, r.m) == r.m


def test_mask_shapes(spark):
    df = spark.createDataFrame([(str(i),) for i in range(50)] + [("",), (None,)], "v string")
    for name, shape in (("phone", r"^\d{3}-\d{3}-\d{4}$"), ("postal-code", r"^[1-9]\d{4}$"), ("email", r"^[a-z]+\.[a-z]+[0-9a-f]{6}@example\.com$"), ("person-name", r"^\w+ \w+ \w+-\w+$")):
        bad = df.select("v", mask.mask(F.col("v"), name, "s").alias("m")).where(F.when(F.coalesce("v", F.lit("")) == "", ~F.col("m").eqNullSafe(F.col("v"))).otherwise(~F.col("m").rlike(shape)))
        assert bad.count() == 0


def test_strategy_order(spark):
    df = spark.createDataFrame([("string", "MailingPostalCode", None), ("string", "Email_Phone", None), ("phone", "Name", None), ("string", "BillingStreet", None), ("string", "Nickname", None), ("string", "Note", "x")], "t string, n string, l string")
    assert [r[0] for r in df.select(mask.pick_strategy(F.col("t"), F.col("n"), F.col("l"))).collect()] == ["postal-code", "email", "phone", "street-address", "person-name", "generic-text"]


def test_duplicate_ids_from_messages(spark):
    log = spark.createDataFrame([("1", "DUPLICATE_VALUE", "duplicates with id: 003xx000004TmiQAAS"), ("2", "DUPLICATE_VALUE", "id: 003xx000004TmiQ ."), ("3", "DUPLICATE_VALUE", "no id"), ("4", "OTHER", "id: 003xx000004TmiQ")], "source_id string, status_code string, message string")
    assert rows(verify.duplicate_ids(log)) == [("1", "003xx000004TmiQAAS"), ("2", "003xx000004TmiQ")]


def test_fingerprint_ignores_order(spark):
    a, b = spark.range(100).repartition(3), spark.range(99, -1, -1).toDF("id")
    assert rows(verify.id_set_fingerprint(a, "t", "id")) == rows(verify.id_set_fingerprint(b, "t", "id")) != rows(verify.id_set_fingerprint(a.where("id > 0"), "t", "id"))


def test_sensitive_names(spark):
    df = spark.createDataFrame([("SSN__c", None), ("Name", "Date of birth"), ("Amount", "Total"), ("HomePhone", None)], "column_name string, label string")
    assert [r[0] for r in df.select(catalog.is_sensitive()).collect()] == [True, True, False, True]


def test_semi_join_reads_only_the_keys(spark, tmp_path):
    for name, df in (("root", spark.range(50).select(F.col("id").alias("rid"), F.lit("x").alias("wide"))), ("child", spark.range(500).select((F.col("id") % 50).alias("fk"), F.col("id").alias("v"), F.lit("y").alias("unused")))):
        df.write.parquet(str(tmp_path / name))
    root, child = spark.read.parquet(str(tmp_path / "root")), spark.read.parquet(str(tmp_path / "child"))
    out = scope.with_ids(child, "fk", scope.scan_ids(root, "rid", "rid < 3")).select("v")
    plan = out._jdf.queryExecution().toString()
    assert out.count() == 30 and "ReadSchema: struct<rid:bigint>" in plan and "unused" not in plan.split("== Physical Plan ==")[1] and "Cartesian" not in plan


def small_dataset(spark):
    """An account, contacts that point to it, notes on either, and owners above."""
    owner = spark.createDataFrame([(1,), (2,), (3,)], "owner_id long")
    account = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "account_id long, owner long")
    contact = spark.createDataFrame([(20, 10, 3), (21, 11, 1), (22, None, 2)], "contact_id long, account long, owner long")
    note = spark.createDataFrame([("account", 10), ("contact", 10), ("contact", 20), ("account", 11), (None, 10), ("account", 10)], "kind string, about long")
    specs = {
        s.name: s
        for s in (
            TableSpec("owner", "owner_id"),
            TableSpec("account", "account_id", (ForeignKey("account", "owner", ("owner",)),)),
            TableSpec("contact", "contact_id", (ForeignKey("contact", "account", ("account",)), ForeignKey("contact", "owner", ("owner",)))),
            TableSpec("note", None, (ForeignKey("note", "about", ("account", "contact"), type_column="kind"),)),
        )
    }
    return Dataset({"owner": owner, "account": account, "contact": contact, "note": note}, specs)


def test_scopes_follow_declarations(spark):
    data = small_dataset(spark)
    found = scope.scopes(data, "account", spark.createDataFrame([(10,)], "id long"))
    assert {k: v[0] for k, v in found.items()} == {"account": "root", "owner": "direct-parent", "contact": "direct-child", "note": "direct-child"}
    assert rows(found["account"][1]) == [(10, 1)] and rows(found["owner"][1]) == [(1,)] and rows(found["contact"][1]) == [(20, 10, 3)]
    up = scope.scopes(data, "contact", spark.createDataFrame([(20,), (22,)], "id long"))
    assert up["owner"][0] == "direct-parent" and rows(up["owner"][1]) == [(2,), (3,)] and rows(up["account"][1]) == [(10, 1)]


def test_guarded_upsert_neither_multiplies_nor_adds_rows(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v long")
    updates = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30), ("c", 31), ("d", 40), (None, 50), ("", 60)], "k string, v long")
    done, rejected = load.guarded_upsert(target, updates, "k", ["v"])
    assert sorted(((r.k, r.v, r.created) for r in done.collect()), key=str) == sorted([("a", 10, False), ("b", 2, False), ("b", 3, False), (None, 4, False), ("d", 40, True)], key=str)
    assert sorted((r.v, r.reject_reason) for r in rejected.collect()) == [(20, "repeated-on-target"), (30, "repeated-key"), (31, "repeated-key"), (50, "no-key"), (60, "no-key")]


def test_names_held_twice_map_nothing(spark):
    source = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, name string")
    target = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "y"), ("D", None)], "tid string, tname string")
    assert rows(idmap.by_natural_key(source, target, "t", "id", "name", "tid", "tname")) == [("t", "1", "A")]
    assert rows(idmap.adopt_duplicates(source, "id", "name", target, "tname", "tid", "t")) == [("t", "1", "A")]
    assert rows(idmap.ambiguous_names(target, "tname")) == [("y", 2)]


def test_layers_and_merges_settle_ties(spark):
    m = "object string, source_id string, target_id string"
    one = spark.createDataFrame([("t", "1", "a"), ("t", "1", "b"), ("t", "2", "")], m)
    assert rows(idmap.layered(one)) == [("t", "1", "b")]
    stamped = spark.createDataFrame([("t", "1", "a", 5), ("t", "1", "b", 5)], m + ", updated_at long")
    assert rows(idmap.merge(stamped, stamped.where("target_id = 'a'"))) == [("t", "1", "a", 5)]


def test_a_batch_stops_after_rejects_and_passes_over_finished_steps(spark):
    people = spark.createDataFrame([(1, 9)], "id long, boss long")
    rule = Rule(ForeignKey("people", "boss", ("people",)), "reject")
    mint = lambda df, table, key: idmap.assign(df, table, key, "t")
    steps = [("done", people, "id", []), ("people", people, "id", [rule]), ("later", people, "id", [])]
    outcome, ids = load.stitch(steps, id_map(spark, []), mint, finished=("done",), stop_on_reject=True)
    assert rows(outcome) == [("done", "already-run", 1), ("later", "not-run", 1), ("people", "rejected", 1)] and ids.isEmpty()  # a rejected row does not enter the map
    assert ("later", "inserted", 1) in rows(load.stitch(steps, id_map(spark, []), mint)[0])


def test_a_patch_with_a_null_overwrites(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, v long, w string")
    patches = spark.createDataFrame([("a", None), ("z", 5)], "id string, v long")
    assert sorted(map(str, load.patch(target, "id", patches, ["v"]).collect())) == sorted(map(str, spark.createDataFrame([("a", None, "x"), ("b", 2, "y")], "id string, v long, w string").collect()))


def test_a_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session())


# ---- scopes closed over rows


def made(spark, specs, **values):
    """A dataset of tables given as lists of tuples; columns are the key and the foreign keys, all long."""
    tables_of = {}
    for name, spec in specs.items():
        columns = list(dict.fromkeys(([spec.key] if spec.key else []) + [c for fk in spec.foreign_keys for c in (fk.column, fk.type_column) if c]))
        typed = ", ".join(f"{c} {'string' if c.endswith('_type') else 'long'}" for c in columns)
        tables_of[name] = spark.createDataFrame(values[name], typed)
    return Dataset(tables_of, specs)


def spec(name, *keys):
    return TableSpec(name, f"{name}_id", tuple(ForeignKey(name, f"{name}_{t}", (t,), required=True) for t in keys))


def ids_of(reached, name):
    return sorted(r[0] for r in reached[name][1].select(f"{name}_id").collect())


def test_a_table_that_a_deeper_level_needs_again_takes_those_rows_as_well(spark):
    specs = {s.name: s for s in (spec("r", "a", "c"), spec("a", "d"), spec("c", "b"), spec("b", "d"), spec("d"))}
    data = made(spark, specs, r=[(1, 1, 1), (2, 1, 1)], a=[(1, 1)], c=[(1, 1)], b=[(1, 2)], d=[(1,), (2,), (3,)])
    root = spark.createDataFrame([(1,)], "id long")
    by_name = scope.scopes(data, "r", root)
    assert ids_of(by_name, "d") == [1] and rows(scope.dangling(data, by_name)) == [("b", "b_d", "d", "not-in-scope", 1)]
    reached = scope.closed(data, by_name)
    assert ids_of(reached, "d") == [1, 2] and reached["d"][0] == "closure,transitive" and ids_of(reached, "r") == [1]
    assert rows(scope.dangling(data, reached)) == []


def test_rows_that_point_within_their_table_and_in_circles_are_followed(spark):
    node = TableSpec("n", "n_id", (ForeignKey("n", "n_up", ("n",), required=True), ForeignKey("n", "n_m", ("m",), required=True)))
    back = TableSpec("m", "m_id", (ForeignKey("m", "m_n", ("n",), required=True), ForeignKey("m", "m_x", ("x",))))
    data = made(spark, {"n": node, "m": back, "x": TableSpec("x", "x_id")}, n=[(i, i + 1, None) for i in range(1, 20)] + [(20, 99, 7), (40, 41, None), (41, 40, None)], m=[(7, 40, 5), (8, 1, None)], x=[(5,)])
    start = {"n": ("root", data.tables["n"].where("n_id = 1"))}
    reached = scope.closed(data, start, compact=3)
    assert ids_of(reached, "n") == [*range(1, 21), 40, 41] and ids_of(reached, "m") == [7] and "x" not in reached
    assert rows(scope.dangling(data, reached)) == [("n", "n_up", "n", "not-in-source", 1)]
    assert ids_of(scope.closed(data, start, required=False), "x") == [5]


def test_typed_and_first_declared_targets_are_told_apart(spark):
    typed = TableSpec("t", None, (ForeignKey("t", "ref", ("a", "b"), type_column="ref_type", required=True), ForeignKey("t", "any", ("b", "a"), first_declared=True, required=True)))
    data = made(spark, {"t": typed, "a": TableSpec("a", "a_id"), "b": TableSpec("b", "b_id")}, t=[(1, "a", 10), (2, "b", 11), (None, "b", None)], a=[(1,), (2,), (10,), (11,)], b=[(1,), (2,), (10,)])
    reached = scope.closed(data, {"t": ("root", data.tables["t"])})
    assert ids_of(reached, "a") == [1, 11] and ids_of(reached, "b") == [2, 10] and rows(scope.dangling(data, reached)) == []


def test_closing_an_empty_scope_adds_nothing(spark):
    specs = {s.name: s for s in (spec("r", "a"), spec("a"))}
    data = made(spark, specs, r=[(1, 1)], a=[(1,)])
    reached = scope.closed(data, {"r": ("root", data.tables["r"].where("r_id > 5"))})
    assert list(reached) == ["r"] and reached["r"][1].count() == 0


# ---- rejects that spread


def test_rejected_rows_stay_out_of_the_map_and_take_what_needs_them_along(spark):
    mint = lambda df, name, key: idmap.assign(df, name, key, "t")
    need = lambda name, column, target: Rule(ForeignKey(name, column, (target,), required=True), "reject")
    a = spark.createDataFrame([(1,)], "id long")
    b = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, a long")
    c = spark.createDataFrame([(100, 10), (101, 11)], "id long, b long")
    run = lambda a, start: load.stitch([("a", a, "id", []), ("b", b, "id", [need("b", "a", "a")]), ("c", c, "id", [need("c", "b", "b")])], start, mint)
    outcome, made_map = run(a, id_map(spark, []))
    assert rows(outcome) == [("a", "inserted", 1), ("b", "inserted", 2), ("b", "rejected", 1), ("c", "inserted", 1), ("c", "rejected", 1)]
    assert sorted((r.object, r.source_id) for r in made_map.collect()) == [("a", "1"), ("b", "10"), ("b", "12"), ("c", "100")]
    again, _ = run(a, made_map)
    assert ("b", "rejected", 1) in rows(again) and ("c", "rejected", 1) in rows(again)
    mended, whole = run(spark.createDataFrame([(1,), (2,)], "id long"), made_map)
    assert rows(mended) == [("a", "already-loaded", 1), ("a", "inserted", 1), ("b", "already-loaded", 2), ("b", "inserted", 1), ("c", "already-loaded", 1), ("c", "inserted", 1)]
    assert whole.count() == 7


def test_rejects_spread_within_a_table_but_not_past_loaded_rows(spark):
    mint = lambda df, name, key: idmap.assign(df, name, key, "t")
    up = Rule(ForeignKey("n", "up", ("n",), required=True), "reject")
    chain = [(i, i - 1 if i > 1 else 99) for i in range(1, 9)]  # 1 points nowhere
    other = [(20, 21), (21, 20), (22, None), (23, 22), (24, 24), (30, 3)]  # 20 and 21 need each other; 30 is on the chain
    df = spark.createDataFrame(chain + other, "id long, up long")
    outcome, made_map = load.stitch([("n", df, "id", [up])], id_map(spark, []), mint)
    assert rows(outcome) == [("n", "inserted", 5), ("n", "rejected", 9)]
    outcome, made_map = load.stitch([("n", df, "id", [up])], id_map(spark, [("3", "T3")], "n"), mint)
    assert rows(outcome) == [("n", "already-loaded", 1), ("n", "inserted", 11), ("n", "rejected", 2)]
    loose = Rule(ForeignKey("n", "up", ("n",)), "null")
    assert rows(load.stitch([("n", df, "id", [loose])], id_map(spark, []), mint)[0]) == [("n", "inserted", 14)]


def test_repeated_entries_of_a_map_do_not_multiply_rows(spark):
    df = spark.createDataFrame([(1, 10, "p")], "id long, p long, kind string")
    ids = id_map(spark, [("10", "A"), ("10", "B")]).union(id_map(spark, [("1", "X"), ("1", "Y")], "c"))
    for key in (ForeignKey("c", "p", ("p", "q"), type_column="kind"), ForeignKey("c", "p", ("p",)), ForeignKey("c", "p", ("q", "p"), first_declared=True)):
        assert rows(idmap.remap(df, "c", "id", [Rule(key)], ids).select("p", "target_id")) == [("B", "Y")]


# ---- long and tangled graphs


def test_long_chains_and_circles_take_few_rounds(spark, monkeypatch):
    jobs = []
    for name in ("staged", "staged_with", "staged_count"):
        monkeypatch.setattr(graph, name, lambda *a, f=getattr(tables, name): (jobs.append(1), f(*a))[1])
    n = 100
    chain = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(n)], "src string, dst string").repartition(3)
    waves = graph.load_waves(chain, spark.createDataFrame([], "node string, component string"))
    assert rows(waves) == [(f"n{i:04}", n - i) for i in range(n + 1)] and len(jobs) <= 20
    with pytest.raises(RuntimeError):
        graph.load_waves(chain.union(spark.createDataFrame([(f"n{n:04}", "n0000")], "src string, dst string")), spark.createDataFrame([], "node string, component string"))
    jobs.clear()
    circle = spark.createDataFrame([(f"n{i:04}", f"n{(i + 1) % n:04}") for i in range(n)] + [("x", "n0003"), ("n0007", "y")], "src string, dst string")
    assert rows(graph.components(circle)) == [(f"n{i:04}", "n0000") for i in range(n)] and len(jobs) <= 60


def test_rounds_on_a_graph_send_no_tables_through_the_driver(spark):
    e = edges(spark, [("c", "b"), ("b", "a"), ("a", "b"), ("d", "c")])
    labels = graph.components(e)
    kept = tables.staged(labels, "c")
    for df in (labels, graph.load_waves(e, kept), graph.break_edges(e, kept)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_permuted_masks_of_one_file_are_made_by_many_tasks(spark, tmp_path):
    from relslice.plans import QUERIES

    spark.range(1, 40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    made = QUERIES["mask_permuted"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() > 4 and len({r.masked for r in made.collect()}) == 39
    # digits alone go the short way, and it gives the digits that the long one gives
    df = spark.createDataFrame([("004217", "a004217"), ("7", "a7"), ("1" * 40, "a" + "1" * 40)], "v string, w string")
    assert all(v == w[1:] for v, w in rows(df.select(mask.permute_digits(F.col("v"), "s"), mask.permute_digits(F.col("w"), "s"))))


def test_waves_of_a_hierarchy_of_rows(spark, monkeypatch):
    jobs = []
    for name in ("staged", "staged_with", "staged_count"):
        monkeypatch.setattr(graph, name, lambda *a, f=getattr(tables, name): (jobs.append(1), f(*a))[1])
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)]
    tree = chain + [("x", "n050"), ("x", "n050"), ("y", "x"), ("s", "s")]
    expected = sorted([(f"n{i:03}", 100 - i) for i in range(101)] + [("x", 51), ("y", 52), ("s", 0)])
    assert rows(graph.row_waves(spark.createDataFrame(tree, "src string, dst string").repartition(3))) == expected and len(jobs) <= 9
    for other in ([("a", "b"), ("b", "a"), ("c", "b")], [("a", "b"), ("a", "c"), ("c", "b")]):
        e = edges(spark, other)
        assert rows(graph.row_waves(e)) == rows(graph.load_waves(e, graph.components(e)))


def test_rejects_spread_along_a_chain_in_few_rounds(spark, monkeypatch):
    jobs = []
    for module in (graph, load):
        for name in ("staged", "staged_with", "staged_count"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, lambda *a, f=getattr(tables, name): (jobs.append(1), f(*a))[1])
    none, own = id_map(spark, []), [Rule(ForeignKey("p", "up", ("p",)), "reject"), Rule(ForeignKey("p", "q", ("q",)), "reject")]
    mint = lambda df, table, key: idmap.assign(df, table, key, "t")
    table = [(i, i - 1 if i else None, 7 if i == 20 else None) for i in range(100)] + [(200, 201, None), (201, 200, None), (300, 5, None)]
    df = spark.createDataFrame(table, "id long, up long, q long")
    assert sorted(int(r.id) for r in load.judge(df, "p", "id", own, none, mint).where("rejected").collect()) == list(range(20, 100)) and len(jobs) <= 14
    # rows that share an id have two ways up: either may lead to a reject
    shared = spark.createDataFrame([(1, None, 7), (2, None, None), (3, 1, None), (3, 2, None), (4, 3, None)], "id long, up long, q long")
    assert rows(load.judge(shared, "p", "id", own, none, mint).where("rejected").select("id").distinct()) == [("1",), ("3",), ("4",)]


def test_tables_that_point_at_each_other_are_merged_and_the_rest_is_peeled_off(spark, monkeypatch):
    jobs = []
    for name in ("staged", "staged_with", "staged_count"):
        monkeypatch.setattr(graph, name, lambda *a, f=getattr(tables, name): (jobs.append(1), f(*a))[1])
    n = 256  # as in the catalog: tables n / 2 and n / 3, a neighbour and back
    links = {(i, j) for i in range(n) for j in (i // 2, i // 3, i ^ 1) if i != j}
    e = spark.createDataFrame([(f"n{i:03}", f"n{j:03}") for i, j in links], "src string, dst string")
    assert rows(graph.components(e)) == [(f"n{i:03}", f"n{i & ~1:03}") for i in range(n)] and len(jobs) <= 12


def test_components_of_many_graphs_at_once(spark):
    chance, links, expected = random.Random(3), [], []
    for g in range(60):
        k = chance.randint(2, 9)
        own = {(chance.randrange(k), chance.randrange(k)) for _ in range(chance.randint(1, 2 * k))}
        own |= {(b, a) for a, b in own if chance.random() < g % 3 / 3}
        reach = set(own)
        for via in range(k):
            reach |= {(a, d) for a, b in reach if b == via for c, d in reach if c == via}
        links += [(f"g{g}n{a}", f"g{g}n{b}") for a, b in own]
        expected += [(f"g{g}n{a}", f"g{g}n{min(b for b in range(k) if (a, b) in reach and (b, a) in reach)}") for a in range(k) if (a, a) in reach]
    assert rows(graph.components(spark.createDataFrame(links, "src string, dst string"))) == sorted(expected)


def test_later_rounds_of_feedback_edges_see_what_is_cyclic_alone(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "components", lambda df, f=graph.components: (seen.append(df.count()), f(df))[1])
    e = edges(spark, [("a", "b"), ("b", "a"), *[(f"n{i}", "a") for i in range(20)]])
    out, rest = graph.feedback_edges(e)
    assert rest.isEmpty() and rows(out.select("src", "dst")) == [("a", "b")] and seen == [22, 1]


@settings(max_examples=2, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.booleans()), min_size=1, max_size=25, unique_by=lambda e: e[:2]))
def test_components_waves_and_feedback_edges_of_any_graph(spark, links):
    def reach(pairs):
        seen = set(pairs)
        while True:
            more = {(a, d) for a, b in seen for c, d in pairs if b == c} - seen
            if not more:
                return seen
            seen |= more

    def cyclic(pairs):
        r = reach(pairs)
        return {(f"n{a}", f"n{min(b for b in range(10) if (a, b) in r and (b, a) in r)}") for a in range(10) if (a, a) in r}

    e = spark.createDataFrame([(f"n{a}", f"n{b}", "f", nillable, i) for i, (a, b, nillable) in enumerate(links)], "src string, dst string, field string, nillable boolean, pos int")
    labels = tables.staged(graph.components(e), "c")
    assert set(rows(labels)) == cyclic([x[:2] for x in links])
    step, wave = {f"n{i}": f"n{i}" for i in range(10)} | dict(rows(labels)), dict(rows(graph.load_waves(e, labels)))
    for a, b, _ in links:
        a, b = f"n{a}", f"n{b}"
        assert wave[a] > wave[b] or step[a] == step[b] and wave[a] == wave[b]
    assert all(w == 0 or any(wave[f"n{b}"] == w - 1 for a, b, _ in links if step[f"n{a}"] == step[n]) for n, w in wave.items())
    out, rest = graph.feedback_edges(e)
    out = out.collect()
    assert all(r.nillable for r in out) and set(rows(rest)) == cyclic([x[:2] for x in links if not x[2]])
    gone = {(r.src, r.dst) for r in out}
    assert cyclic([x[:2] for x in links if (f"n{x[0]}", f"n{x[1]}") not in gone]) == set(rows(rest))


def test_a_component_with_several_cycles_is_broken_and_filled_in_again(spark):
    # a -> b -> a, a -> c -> a, b -> b: one edge does not do
    e = edges(spark, [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("b", "b")])
    out, rest = graph.feedback_edges(e)
    assert rest.isEmpty() and rows(out.select("src", "dst")) == [("a", "b"), ("a", "c"), ("b", "b")]
    a = spark.createDataFrame([(1, 10, 20), (2, None, 21)], "id long, b long, c long")
    ids = id_map(spark, [("1", "A1"), ("2", "A2")], "a").union(id_map(spark, [("10", "B10")], "b")).union(id_map(spark, [("20", "C20")], "c"))
    broken = [Rule(ForeignKey("a", "b", ("b",))), Rule(ForeignKey("a", "c", ("c",)))]
    assert rows(load.first_phase(a, "a", "id", ["b", "c"], broken, ids).select("id", "b", "c", "target_id")) == [(1, None, None, "A1"), (2, None, None, "A2")]
    filled = load.backfill_all(a, "a", "id", [("b", "b"), ("c", "c")], ids)
    assert rows(filled.select("column_name", "source_id", "target_id", "fk_target_id").na.fill("-")) == [("b", "1", "A1", "B10"), ("c", "1", "A1", "C20"), ("c", "2", "A2", "-")]


def test_a_store_of_keys_that_is_missing_or_broken_counts_as_empty(spark, tmp_path):
    assert load.sticky_keys(spark, str(tmp_path / "none")).isEmpty()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not a table")
    assert load.sticky_keys(spark, str(tmp_path / "bad")).isEmpty()
    spark.range(1).write.parquet(str(tmp_path / "other"))
    assert load.sticky_keys(spark, str(tmp_path / "other")).isEmpty()
    new = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("u", "x", 3), ("u", "y", 3), (None, "z", 1)], load.STICKY)
    load.merge_sticky(load.sticky_keys(spark, str(tmp_path / "none")), new).write.parquet(str(tmp_path / "good"))
    assert rows(load.sticky_keys(spark, str(tmp_path / "good"))) == [("t", "b", 2), ("u", "y", 3)]


def test_sizes_of_a_merge(spark):
    kind = "object string, source_id string, target_id string, updated_at long"
    old = spark.createDataFrame([("a", "1", "x", 1), ("a", "1", "w", 0), ("a", "2", "y", 5), ("a", "3", "z", 1)], kind)
    new = spark.createDataFrame([("a", "1", "n", 2), ("a", "2", "n", 4), ("a", "4", "n", 1)], kind)
    assert rows(idmap.merge_sizes(old, new)) == [(3, 4, 1, 1, 2)]


def test_permuted_digits_are_one_to_one_and_keep_the_shape(spark):
    whole = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert sorted(r.m for r in whole.select(mask.permute_digits(F.col("v"), "s").alias("m")).collect()) == [f"{i:03}" for i in range(1000)]
    shapes = ["7", "42", "(555) 123-4567", "007-x", "", None, "no digit", "9" * 36, "1" * 40 + "-2", "12é34"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(shapes)], "i int, v string")
    got = [r.m for r in df.orderBy("i").select(mask.permute_digits(F.col("v"), "s").alias("m")).collect()]
    import re

    assert got[4:7] == ["", None, "no digit"] and got[8].endswith("1111-2")
    assert all(v is None or re.sub("[0-9]", "0", m) == re.sub("[0-9]", "0", v) for v, m in zip(shapes, got))
    assert got[2] != shapes[2] and got != [r.m for r in df.orderBy("i").select(mask.permute_digits(F.col("v"), "t").alias("m")).collect()]


def test_bloom_filter_sifts_before_the_exchange_and_loses_nothing(spark):
    ids = spark.range(0, 60_000, 3).withColumnRenamed("id", "k")
    df = spark.range(400_000).select((F.col("id") * 7 % 1_000_003).cast("int").alias("fk"), "id").union(spark.sql("SELECT CAST(NULL AS INT), 1L"))
    n = ids.count()
    exact, passed = scope.with_ids(df, "fk", ids), scope.sifted(df, "fk", ids, n)
    outside = df.count() - exact.count()
    assert passed.join(exact, "id", "left_semi").count() >= exact.count() and passed.count() - exact.count() < 0.04 * outside
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = scope.with_few_ids(df, "fk", ids)
        assert rows(got) == rows(exact)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")  # the filter lies below the exact join, on its left side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("kind, sifts", [("string", True), ("date", True), ("double", False), ("decimal(12,2)", False)])
def test_bloom_filter_of_other_types_of_ids(spark, kind, sifts):
    value = F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")) if kind == "date" else F.col("id").cast(kind)
    df = spark.range(500).select(value.alias("k"), F.col("id").alias("word"))
    ids = df.where("word % 50 = 3").select("k")
    assert (scope.sifted(df, "k", ids, 10).count() < 500) == sifts
    assert rows(scope.with_few_ids(df, "k", ids)) == rows(df.where("word % 50 = 3"))
    assert scope.with_few_ids(df, "k", ids.limit(0)).count() == 0 and scope.with_few_ids(df.limit(0), "k", ids).count() == 0


def test_filter_is_left_out_where_ids_are_too_many(spark):
    df = spark.range(100).toDF("k")
    assert scope.sifted(df, "k", df, 100, most_words=4).count() == 100
    assert scope.sifted(df, "k", df.where("k < 5"), 5, most_words=4).count() < 100


def test_changed_ranges_are_those_of_changed_rows_alone(spark):
    schema = "k long, v string, w double"
    before = [(k, f"v{k}", 1.0) for k in range(-300, 3_000) if k % 3] + [(None, "a", None), (7, "v7", 1.0), (2**60 + 1, "far", None)]
    build = lambda data: tables.staged(verify.range_tree(spark.createDataFrame(data, schema), "k", ["v", "w"], 10, fan=4, levels=4))
    tree = build(before)
    assert verify.changed_ranges(tree, build(before[::-1]), 10, 4, 4).count() == 0
    now = [r for r in before if r[0] not in (1_000, -299)] + [(-1_000, "new", None), (None, "b", None)]
    now = [(k, None if k == 2_000 else v, w) for k, v, w in now]
    now.remove((7, "v7", 1.0))
    assert rows(verify.changed_ranges(tree, build([r for r in now if r[0] is not None]), 10, 4, 4).where("range_start is null")) == [(None, None, 1, 0)]
    got = rows(verify.changed_ranges(tree, build(now), 10, 4, 4).where("range_start is not null"))
    assert got == [(-1_000, -991, 0, 1), (-300, -291, 6, 5), (0, 9, 7, 6), (1_000, 1_009, 7, 6), (2_000, 2_009, 7, 7)]
    assert rows(verify.changed_ranges(build([]), build([(5, "a", 1.0)]), 10, 4, 4)) == [(0, 9, 0, 1)] and verify.changed_ranges(build([]), build([]), 10, 4, 4).count() == 0


def test_a_killed_batch_goes_on_from_its_journal(spark, tmp_path):
    need = lambda t, to: Rule(ForeignKey(t, "up", (to,), required=True), "reject")
    frame = lambda pairs: spark.createDataFrame(pairs, "id string, up string")
    steps = [("a", frame([("1", None), ("2", None)]), "id", []), ("b", frame([("1", "1"), ("2", "9")]), "id", [need("b", "a")]), ("c", frame([("1", "1"), ("2", "2")]), "id", [need("c", "b")])]
    minted, broken = [], {"c"}

    def mint(df, name, key):
        minted.append(name)
        if name in broken:
            raise RuntimeError("killed")
        return df.select(F.lit(name).alias("object"), F.col(key).alias("source_id"), F.concat(F.lit(f"{name}-"), key).alias("target_id"))

    journal, start = str(tmp_path / "journal"), id_map(spark, [("0", "old")], "a")
    with pytest.raises(RuntimeError):
        load.stitch(steps, start, mint, journal=journal)
    broken.clear()
    minted.clear()
    got = load.stitch(steps, start, mint, journal=journal)
    assert set(minted) == {"c"}
    want = load.stitch(steps, start, mint)
    assert rows(got[0]) == rows(want[0]) and rows(got[1]) == rows(want[1])
    minted.clear()
    again = load.stitch(steps, start, mint, journal=journal)
    assert not minted and rows(again[0]) == rows(want[0]) and rows(again[1]) == rows(want[1])
    stopped = load.stitch(steps, start, mint, stop_on_reject=True, journal=journal)
    assert ("b", "rejected", 1) in rows(stopped[0])
    with pytest.raises(ValueError, match="step 0"):
        load.stitch([steps[1]], start, mint, journal=journal)
    id_map(spark, [("1", "else")], "a").write.mode("overwrite").parquet(f"{journal}/0001-map")
    with pytest.raises(ValueError, match="not the one"):
        load.stitch(steps, start, mint, journal=journal)


def test_unique_keys_by_data(spark):
    df = spark.range(3_000).select("id", (F.col("id") % 2_999).alias("almost"), F.when(F.col("id") < 5, F.col("id")).alias("some"), F.lit(None).cast("int").alias("none"), F.lit("x").alias("same"), F.col("id").cast("string").alias("value"))
    got = {r.column_name: (r.n, r.filled, r.is_unique) for r in catalog.unique_keys({"t": (df, df.columns)}).collect()}
    assert got == {"id": (3_000, 3_000, True), "almost": (3_000, 3_000, False), "some": (3_000, 5, True), "none": (3_000, 0, False), "same": (3_000, 3_000, False), "value": (3_000, 3_000, True)}
    assert [r.is_unique for r in catalog.unique_keys({"t": (df.limit(0), ["id"])}).collect()] == [False]


def test_load_steps_name_the_wave_and_the_edge_to_break(spark):
    free = edges(spark, [("a", "b"), ("b", "a"), ("c", "a")])
    tied = edges(spark, [("x", "y"), ("y", "x")], nillable=False)
    assert rows(graph.load_steps(free.union(tied)).select("table_name", "wave", "step", F.coalesce("break_edge", F.lit("-")))) == [
        ("a", 0, "two-phase", "a.f0"), ("b", 0, "two-phase", "a.f0"), ("c", 1, "single", "-"), ("x", 0, "skipped", "-"), ("y", 0, "skipped", "-"),
    ]
