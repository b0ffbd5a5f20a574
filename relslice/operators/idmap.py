"""The id map (object, source_id, target_id, updated_at) and rewriting of foreign keys through it.

Target ids are made from the source id before any row is written, so every foreign key, cycles included, is rewritten in one
pass and a run that is repeated makes the same ids. Source ids are text in the map.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ForeignKey

ID_DIGITS = 24
MAP = ["object", "source_id", "target_id"]


def minted(target: str, table: str, source_id: Column) -> Column:
    """96 bits of a digest of target, table and source id."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(target), F.lit(table), source_id.cast("string")), 256), 1, ID_DIGITS)


def assign(df: DataFrame, table: str, key: str, target: str) -> DataFrame:
    """Id map rows for the rows of a table."""
    rows = df.select(F.col(key).cast("string").alias("source_id")).where("source_id is not null").distinct()
    return rows.select(F.lit(table).alias("object"), "source_id", minted(target, table, F.col("source_id")).alias("target_id"))


def layered(*maps: DataFrame) -> DataFrame:
    """One map out of several; later ones win, blank targets do not count. Of two rows in one map, the larger target counts."""
    rows = None
    for rank, m in enumerate(maps):
        part = m.select(*MAP, F.lit(rank).alias("rank")).where("target_id is not null and target_id <> ''")
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("object", "source_id").agg(F.max_by("target_id", F.struct("rank", "target_id")).alias("target_id"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newer row of each id, by updated_at; on a tie the row of new, then the larger target."""
    rows = old.select(*MAP, "updated_at", F.lit(0).alias("rank")).union(new.select(*MAP, "updated_at", F.lit(1).alias("rank")))
    last = F.max_by(F.struct("target_id", "updated_at"), F.struct("updated_at", "rank", "target_id"))
    return rows.groupBy("object", "source_id").agg(last.alias("r")).select("object", "source_id", "r.target_id", "r.updated_at")


def merge_sizes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: ids in old and in the merged map, and how many of those are new, point elsewhere now, or are as they were."""
    before = old.groupBy("object", "source_id").agg(F.max_by("target_id", F.struct("updated_at", "target_id")).alias("was"), F.lit(True).alias("had"))
    both = merge(old, new).join(before, ["object", "source_id"], "left")
    had, same = F.coalesce("had", F.lit(False)), F.col("was").eqNullSafe(F.col("target_id"))
    counts = {"before": had, "after": F.lit(True), "added": ~had, "changed": had & ~same, "kept": had & same}
    return both.agg(*[F.count_if(c).alias(name) for name, c in counts.items()])


def valid(id_map: DataFrame, meta: DataFrame, target_id: str, stamp: str | None) -> DataFrame:
    """(object, source_id, target_id, reason): the map where its meta row (map_id, target, stamp) fits; else reason says why not.

    A stamp counts only if both sides have one. Meta is joined by the map's map_id."""
    why = (
        F.when(F.col("meta_target").isNull(), "meta-missing")
        .when(F.col("meta_target") != target_id, "target-changed")
        .when(F.col("meta_stamp").isNotNull() & F.lit(stamp).isNotNull() & (F.col("meta_stamp") != F.lit(stamp)), "target-refreshed")
    )
    m = meta.select("map_id", F.col("target").alias("meta_target"), F.col("stamp").alias("meta_stamp"))
    return id_map.join(m, "map_id", "left").select("map_id", *MAP, why.alias("reason"))


def single(target: DataFrame, name: str, key: str) -> DataFrame:
    """(__name, target_id) of names that one target row alone holds."""
    each = target.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__name")).agg(F.min(F.col(key).cast("string")).alias("target_id"), F.count(F.lit(1)).alias("n"))
    return each.where("n = 1").select("__name", "target_id")


def ambiguous_names(target: DataFrame, name: str) -> DataFrame:
    """(name, n): names that several target rows hold, which single() leaves out."""
    return target.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lookup(rows: DataFrame, object_column: str, id_column: str, id_map: DataFrame) -> DataFrame:
    """rows with target_id, null where the map lacks (object, source id) or the id is null."""
    m = id_map.select(F.col("object").alias("__o"), F.col("source_id").alias("__s"), "target_id")
    return rows.join(m, (F.col(object_column) == F.col("__o")) & (F.col(id_column).cast("string") == F.col("__s")), "left").drop("__o", "__s")


def by_natural_key(source: DataFrame, target: DataFrame, table: str, key: str, name: str, target_key: str, target_name: str) -> DataFrame:
    """Id map rows of dimension rows that have the same name on both sides. A name that several target rows hold maps nothing."""
    t = single(target, target_name, target_key)
    return source.join(t, F.col(name) == F.col("__name")).select(F.lit(table).alias("object"), F.col(key).cast("string").alias("source_id"), "target_id")


def unmatched_names(source: DataFrame, target: DataFrame, name: str, target_name: str) -> DataFrame:
    names = target.select(F.col(target_name).alias("__name"))
    return source.join(names, F.col(name) == F.col("__name"), "left_anti").select(name)


@dataclass(frozen=True)
class Rule:
    """What an id without an entry in the map becomes: null, reject (drop the row) or omit (leave the column out)."""

    key: ForeignKey
    unmapped: str = "null"


def remap(df: DataFrame, table: str, key: str, rules: list[Rule], id_map: DataFrame) -> DataFrame:
    """df with rewritten foreign keys (text), target_id, _omit (columns to leave out) and reject_reason.

    Null stays null. Rows whose foreign key is null do not take part in the look-up by a common key: they are dealt out by
    their own key, so that they do not meet in one task. A polymorphic key looks only among rows of its type's table. Of repeated
    entries of the map, the larger target counts, as in layered(); they never multiply rows.
    """
    out = df.withColumn("__omit", F.array().cast("array<string>")).withColumn("__reject", F.array().cast("array<string>"))
    for i, rule in enumerate(rules):
        column, targets = rule.key.column, list(rule.key.targets)
        place = F.array_position(F.array(*map(F.lit, targets)), F.col("object"))
        found = id_map.where(F.col("object").isin(targets))
        source = F.coalesce(F.col(column).cast("string"), F.concat(F.lit("\0"), F.col(key).cast("string")))
        if rule.key.type_column:
            m = found.groupBy(F.col("object").alias(f"__o{i}"), F.col("source_id").alias(f"__s{i}")).agg(F.max("target_id").alias(f"__t{i}"))
            out = out.join(m, (source == m[f"__s{i}"]) & (F.col(rule.key.type_column) == m[f"__o{i}"]), "left").drop(f"__o{i}")
        else:  # of several targets, the first declared one that has the id
            m = found.groupBy(F.col("source_id").alias(f"__s{i}")).agg(F.max_by("target_id", F.struct(-place, F.col("target_id"))).alias(f"__t{i}"))
            out = out.join(m, source == m[f"__s{i}"], "left")
        lost = F.col(column).isNotNull() & F.col(f"__t{i}").isNull()
        if rule.unmapped == "omit":
            out = out.withColumn("__omit", F.when(lost, F.concat("__omit", F.array(F.lit(column)))).otherwise(F.col("__omit")))
        if rule.unmapped == "reject":
            out = out.withColumn("__reject", F.when(lost, F.concat("__reject", F.array(F.lit(column)))).otherwise(F.col("__reject")))
        out = out.withColumn(column, F.col(f"__t{i}")).drop(f"__s{i}", f"__t{i}")
    own = id_map.where(F.col("object") == table).groupBy(F.col("source_id").alias("__own")).agg(F.max("target_id").alias("target_id"))
    out = out.join(own, F.col(key).cast("string") == F.col("__own"), "left").drop("__own")
    reason = F.when(F.size("__reject") > 0, F.concat(F.lit("unresolved:"), F.array_join("__reject", ",")))
    return out.withColumn("_omit", F.col("__omit")).withColumn("reject_reason", reason).drop("__omit", "__reject")


def not_yet_loaded(df: DataFrame, table: str, key: str, id_map: DataFrame) -> DataFrame:
    """Rows of an insert that the map does not have."""
    done = id_map.where(F.col("object") == table).select(F.col("source_id").alias("__done"))
    return df.join(done, F.col(key).cast("string") == F.col("__done"), "left_anti")


def already_loaded_counts(scopes: dict[str, tuple[DataFrame, str]], id_map: DataFrame) -> DataFrame:
    """Per table: rows in scope and how many of them the map has."""
    ids = None
    for table, (df, key) in scopes.items():
        part = df.select(F.lit(table).alias("object"), F.col(key).cast("string").alias("source_id"))
        ids = part if ids is None else ids.union(part)
    known = id_map.select("object", "source_id").distinct().withColumn("__known", F.lit(True))
    return ids.join(known, ["object", "source_id"], "left").groupBy(F.col("object").alias("table_name")).agg(F.count(F.lit(1)).alias("in_scope"), F.count_if(F.col("__known")).alias("mapped"))


def stale_entries(failed: DataFrame, column: str, table: str, id_map: DataFrame, live: DataFrame, live_id: str, shown: int = 5) -> DataFrame:
    """Map entries that failed rows refer to and whose target row is gone; per entry up to `shown` of those rows' keys."""
    suspects = failed.join(id_map.where(F.col("object") == table), F.col(column).cast("string") == F.col("source_id"))
    gone = suspects.join(live.select(F.col(live_id).alias("__live")), F.col("target_id") == F.col("__live"), "left_anti")
    entry = ["source_id", "target_id"]
    counts = gone.groupBy(*entry).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*entry).orderBy("row_key"))
    first = gone.select(*entry, "row_key").distinct().withColumn("rank", rank).where(F.col("rank") <= shown)  # limited before it is exchanged
    keys = first.groupBy(*entry).agg(F.array_join(F.array_sort(F.collect_list("row_key")), ",").alias("row_keys"))
    return counts.join(keys, entry).select(*entry, "row_keys", "n")


def adopt_duplicates(inserts: DataFrame, key: str, unique: str, target: DataFrame, target_unique: str, target_id: str, table: str) -> DataFrame:
    """Id map rows for inserts whose unique value one target row has already."""
    t = single(target, target_unique, target_id)
    return inserts.join(t, F.col(unique) == F.col("__name")).select(F.lit(table).alias("object"), F.col(key).cast("string").alias("source_id"), "target_id")


def first_references(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows point at all to tables that are not copied (users, groups, queues)."""
    return df.agg(F.count_if(F.coalesce(*[F.col(c) for c in columns]).isNotNull()).alias("n"))
