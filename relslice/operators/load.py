"""Writing to a target: match by a key or insert, cycles in two phases, batches of steps, clean-up."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import staged, staged_with
from . import graph
from .idmap import MAP, Rule, layered, remap


def key_population(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values present per candidate key, in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns])).alias("x")).select("x.column_name", "x.filled")


def pick_key(population: DataFrame) -> DataFrame:
    """The best filled candidate, the first by name on a tie; null if all are empty."""
    best = F.min_by("column_name", F.struct(-F.col("filled"), F.col("column_name")))
    return population.agg(F.when(F.max("filled") > 0, best).alias("column_name"), F.max("filled").alias("filled"))


STICKY = "table_name string, column_name string, updated_at long"


def sticky_keys(spark: SparkSession, path: str) -> DataFrame:
    """The stored choices of keys (STICKY). A store that is missing, whose files are no Parquet or that is another table counts as
    empty, so the keys are chosen anew; other errors are errors."""
    try:
        return spark.read.parquet(path).select("table_name", "column_name", F.col("updated_at").cast("long"))
    except AnalysisException:
        return spark.createDataFrame([], STICKY)
    except Py4JJavaError as e:
        if "CANNOT_READ_FILE_FOOTER" not in str(e) and "is not a Parquet file" not in str(e):
            raise
        return spark.createDataFrame([], STICKY)


def merge_sticky(*stores: DataFrame) -> DataFrame:
    """(table_name, column_name, updated_at): the last choice per table; of two at once the larger name."""
    last = F.max(F.struct("updated_at", "column_name")).alias("r")
    return reduce(DataFrame.unionByName, stores).where("table_name is not null").groupBy("table_name").agg(last).select("table_name", "r.column_name", "r.updated_at")


def has_key(column: str) -> Column:
    c = F.col(column).cast("string")
    return c.isNotNull() & (c != "")


def route(df: DataFrame, key: str) -> DataFrame:
    """df with route: UPSERT where the key has a value, else INSERT."""
    return df.withColumn("route", F.when(has_key(key), "UPSERT").otherwise("INSERT"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values of more than one row; an upsert by them is refused."""
    return df.where(has_key(key)).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """target after updates: rows that match by key take the columns sent, others are added; adds `created`.

    A column named in an update's _omit keeps the target's value; a null that is sent overwrites it. Keys have to be unique on
    both sides, and updates without one are added: guarded_upsert() sees to that."""
    omit = F.coalesce(F.col("u._omit"), F.array().cast("array<string>")) if "_omit" in updates.columns else F.array().cast("array<string>")
    there, sent_rows = target.withColumn("__there", F.lit(True)), updates.withColumn("__sent", F.lit(True))
    joined = there.alias("t").join(sent_rows.alias("u"), F.col(f"t.{key}") == F.col(f"u.{key}"), "full_outer")
    sent = F.col("u.__sent").isNotNull()
    values = [F.when(sent & ~F.array_contains(omit, c), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns]
    return joined.select(F.coalesce(f"t.{key}", f"u.{key}").alias(key), *values, F.col("t.__there").isNull().alias("created"))


def refused(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """updates with reject_reason: null where the row may be matched, else no-key, repeated-key or repeated-on-target."""
    own = duplicate_keys(updates, key).select(F.col("key").alias("__own"))
    there = duplicate_keys(target, key).select(F.col("key").alias("__there"))
    rows = updates.join(own, F.col(key) == F.col("__own"), "left").join(there, F.col(key) == F.col("__there"), "left")
    reason = F.when(~has_key(key), "no-key").when(F.col("__own").isNotNull(), "repeated-key").when(F.col("__there").isNotNull(), "repeated-on-target")
    return rows.withColumn("reject_reason", reason).drop("__own", "__there")


def guarded_upsert(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(target after the updates that one key value names alone on both sides, rejected updates with reject_reason).

    Target rows without a key, or that share one, stay as they are."""
    judged = staged(refused(target, updates, key), "judged")
    good = judged.where("reject_reason is null").drop("reject_reason")
    return upsert(target, good, key, columns), judged.where("reject_reason is not null")


def patch(target: DataFrame, id_column: str, patches: DataFrame, columns: list[str]) -> DataFrame:
    """target with the named columns of the rows whose id patches hold (once each); a null in a patch overwrites."""
    p = patches.select(F.col(id_column).alias("__id"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = target.join(p, F.col(id_column) == F.col("__id"), "left")
    return joined.select(*[(F.when(F.col("__id").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)) for c in target.columns])


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """target and the rows; columns that one side lacks are null."""
    return target.unionByName(rows, allowMissingColumns=True)


def backfill(rows: DataFrame, table: str, key: str, column: str, other: str, id_map: DataFrame) -> DataFrame:
    """Second phase of a cycle: per row with a value in the broken column, the ids on the target of both ends and a reason.

    The reason is unresolved-target (tested first), unresolved-self or null."""
    pending = rows.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).select(F.col(key).cast("string").alias("source_id"), F.col(column).cast("string").alias("__fk"))
    own = id_map.where(F.col("object") == table).select("source_id", "target_id")
    far = id_map.where(F.col("object") == other).select(F.col("source_id").alias("__fk"), F.col("target_id").alias("fk_target_id"))
    reason = F.when(F.col("fk_target_id").isNull(), "unresolved-target").when(F.col("target_id").isNull(), "unresolved-self")
    return pending.join(far, "__fk", "left").join(own, "source_id", "left").select("source_id", "target_id", "fk_target_id", reason.alias("reason"))


def backfill_all(rows: DataFrame, table: str, key: str, broken: list[tuple[str, str]], id_map: DataFrame) -> DataFrame:
    """backfill() for several broken (column, table it points to), with column_name."""
    each = [backfill(rows, table, key, column, other, id_map).withColumn("column_name", F.lit(column)) for column, other in broken]
    return reduce(DataFrame.union, each)


def first_phase(df: DataFrame, table: str, key: str, broken: str | list[str], rules: list[Rule], id_map: DataFrame, key_column: str | None = None) -> DataFrame:
    """First phase of a cycle: rows are rewritten, with the broken columns null for inserts and left out for upserts."""
    broken = [broken] if isinstance(broken, str) else broken
    rows = remap(df, table, key, [r for r in rules if r.key.column not in broken], id_map)
    upserted = has_key(key_column) if key_column else F.lit(False)
    left_out = F.when(upserted, F.concat("_omit", F.array(*map(F.lit, broken)))).otherwise(F.col("_omit"))
    return rows.withColumn("_omit", left_out).withColumns({c: F.lit(None).cast("string") for c in broken})


def spread_rejects(rejected: DataFrame, links: DataFrame) -> DataFrame:
    """(id, depth): rejected rows (id, depth 0) and all rows that lead to one along links (child, parent), by the fewest links.

    Null ends lead nowhere. Ids may be structs, (object, source_id) say, for links between tables. A chain takes a round per link;
    only rows that were rejected in the last round are followed, so a row is never judged twice, in a circle either."""
    down = links.where("child is not null and parent is not null").select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return graph.walk(down, rejected.select(F.col("id").alias("node")).where("node is not null"), 1_000_000).withColumnRenamed("node", "id")


def _led_to_rejects(tried: DataFrame, links: DataFrame) -> DataFrame:
    """(id) of spread_rejects() for tried (id, bad). Where a row has at most one parent, paths are followed at twice the length in
    every round; rows of several parents, or of one id, go by spread_rejects()."""
    bad = tried.where("bad and id is not null").select(F.col("id").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("w"))
    on = links.where("child is not null and parent is not null").select(F.col("child").alias("node"), "parent", F.lit(0).alias("w"))
    way = bad.union(on).groupBy("node").agg(F.max("w").alias("w"), F.min("parent").alias("next"), F.max("parent").alias("last"))
    open_ = F.col("w") == 0
    ways, several = staged_with(way.select("node", F.when(open_, F.col("next")).alias("next"), F.when(open_, F.col("last")).alias("last"), "w"), F.count_if(F.col("next") != F.col("last")), "ways")
    if several:
        return spread_rejects(tried.where("bad").select("id"), links).select("id")
    return graph.follow(ways).where("next is null and w > 0").select(F.col("node").alias("id"))


def judge(df: DataFrame, table: str, key: str, rules: list[Rule], id_map: DataFrame, mint) -> DataFrame:
    """(id, rejected) per row of df that is to be loaded, staged. id is the key as text.

    A row is rejected if a key with the rule `reject` has no entry in the map, or leads within the table to a rejected row. Rows of
    df count as entries of each other until one of them is rejected; the rejection then spreads along the keys within the table."""
    hoped = layered(mint(df, table, key), id_map)
    own = [r for r in rules if r.unmapped == "reject" and table in r.key.targets]
    columns = [F.col(f"__own{i}") for i in range(len(own))]
    kept = df
    for i, r in enumerate(own):
        inside = F.lit(True) if r.key.type_column is None else F.col(r.key.type_column) == table
        kept = kept.withColumn(f"__own{i}", F.when(inside, F.col(r.key.column).cast("string")))
    tried = staged(remap(kept, table, key, rules, hoped).select(F.col(key).cast("string").alias("id"), F.col("reject_reason").isNotNull().alias("bad"), *columns), "tried")
    if not own:
        return tried.select("id", F.col("bad").alias("rejected"))
    links = tried.select(F.col("id").alias("child"), F.explode(F.array(*columns)).alias("parent"))
    loaded = id_map.where(F.col("object") == table).select(F.col("source_id").alias("parent"))  # by an earlier run
    spread = _led_to_rejects(tried.select("id", "bad"), staged(links.join(loaded, "parent", "left_anti"), "rejects-links")).select(F.col("id").alias("__id"))
    return tried.join(spread, F.col("id") == F.col("__id"), "left").select("id", (F.col("bad") | F.col("__id").isNotNull()).alias("rejected"))


JOURNAL = "step int, table_name string, n_map long, map_digest string"


def _map_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_map"), F.coalesce(F.sum(F.xxhash64(*MAP).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("map_digest")]


def record(id_map: DataFrame, outcome: DataFrame, journal: str, at: int, table: str) -> tuple[DataFrame, DataFrame]:
    """Write a step's map and outcome into the journal, and last of all its record; returns both as read back."""
    spark, seen, folder = id_map.sparkSession, Observation(), f"{journal}/{at:04d}"
    id_map.observe(seen, *_map_sums()).write.mode("overwrite").parquet(f"{folder}-map")
    outcome.write.mode("overwrite").parquet(f"{folder}-outcome")
    row = (at, table, seen.get["n_map"], seen.get["map_digest"])
    spark.createDataFrame([row], JOURNAL).coalesce(1).write.mode("overwrite").parquet(f"{folder}-done")
    return spark.read.schema(id_map.schema).parquet(f"{folder}-map"), spark.read.schema(outcome.schema).parquet(f"{folder}-outcome")


def recorded(spark: SparkSession, journal: str) -> dict[int, Row]:
    """The records of a journal by step; a folder that does not exist has none."""
    try:
        return {r.step: r for r in spark.read.schema(JOURNAL).parquet(f"{journal}/*-done").collect()}
    except AnalysisException:
        return {}


def resume(spark: SparkSession, journal: str, done: Row, table: str) -> tuple[DataFrame, DataFrame]:
    """The map and the outcome that a recorded step has left; an error if the step is another one or the map is not as recorded."""
    if done.table_name != table:
        raise ValueError(f"the journal has {done.table_name} as step {done.step}, not {table}")
    id_map, outcome = (spark.read.parquet(f"{journal}/{done.step:04d}-{part}") for part in ("map", "outcome"))
    found = id_map.agg(*_map_sums()).first()
    if (found.n_map, found.map_digest) != (done.n_map, done.map_digest):
        raise ValueError(f"the map of step {done.step} ({table}) is not the one that was recorded")
    return id_map.select(*MAP), outcome


def stitch(steps: list[tuple[str, DataFrame, str, list[Rule]]], start: DataFrame, mint, finished: tuple[str, ...] = (), stop_on_reject: bool = False, journal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run steps (table, rows, key, rules) in order over one shared id map; later steps resolve keys to earlier ones.

    Returns (outcome per table, id map). mint(df, table, key) makes the map rows of a step; rows that the map has are skipped. Only
    rows that are not rejected enter the map, so rejects spread to later steps and, along keys within a table, within a step; a
    later run tries them again. A key that several rows share enters if none of them is rejected.
    The map and the outcomes are staged after each step, so a run that breaks off goes on from there. Steps in finished are not
    run again (outcome already-run); after a step with rejected rows, stop_on_reject leaves out the rest (not-run).

    journal is a shared folder that outlives the run: each step's map and outcome go there, then one record that it is done. A
    batch that is started again with the journal takes recorded steps from there, after a check of the map, and goes on with the
    first one that is not recorded; what a killed step has left is overwritten. A journal of other steps is an error."""
    id_map, outcomes, stopped = start.select(*MAP), [], False
    done = recorded(start.sparkSession, journal) if journal else {}
    for at, (table, df, key, rules) in enumerate(steps):
        if at in done:
            id_map, outcome = resume(start.sparkSession, journal, done[at], table)
            outcomes.append(outcome)
            stopped = stop_on_reject and not outcome.where("outcome = 'rejected'").isEmpty()
            continue
        if table in finished or stopped:
            state = "already-run" if table in finished else "not-run"
            outcomes.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table_name"), F.lit(state).alias("outcome"), "n"))
            continue
        known = id_map.where(F.col("object") == table).select(F.col("source_id").alias("__k")).distinct()
        flagged = df.join(known, F.col(key).cast("string") == F.col("__k"), "left")
        todo = flagged.where("__k is null").drop("__k")
        judged = staged(judge(todo, table, key, rules, id_map, mint), "judged")
        bad = judged.where("rejected").select(F.col("id").alias("__bad"))
        grown = layered(mint(todo.join(bad, F.col(key).cast("string") == F.col("__bad"), "left_anti"), table, key), id_map)
        new = judged.select(F.when(F.col("rejected"), "rejected").otherwise("inserted").alias("outcome"))
        outcome = new.union(flagged.where("__k is not null").select(F.lit("already-loaded"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
        outcome = outcome.select(F.lit(table).alias("table_name"), "outcome", "n")
        if journal:
            id_map, outcome = record(grown, outcome, journal, at, table)
        else:
            id_map, outcome = staged(grown, "id-map"), staged(outcome, "outcome")
        outcomes.append(outcome)
        stopped = stop_on_reject and not outcomes[-1].where("outcome = 'rejected'").isEmpty()
    return reduce(DataFrame.union, outcomes), id_map


def rollup_steps(outcomes: DataFrame) -> DataFrame:
    """Counts per step and outcome, per step, and overall (null stands for all)."""
    return outcomes.rollup("table_name", "outcome").agg(F.sum("n").alias("n"))


def made_by_run(run: DataFrame, baseline: DataFrame, keep: list[str]) -> DataFrame:
    """(object, target_id) that a run has added and that may be deleted."""
    return run.join(baseline.select("object", "target_id"), ["object", "target_id"], "left_anti").where(~F.col("object").isin(keep)).select("object", "target_id").distinct()


def clean_up(target: DataFrame, table: str, id_column: str, run: DataFrame, baseline: DataFrame, keep: list[str]) -> DataFrame:
    """target without the rows that a run has added."""
    gone = made_by_run(run, baseline, keep).where(F.col("object") == table).select(F.col("target_id").alias("__gone"))
    return target.join(gone, F.col(id_column) == F.col("__gone"), "left_anti")
