"""Checks after a load: masks derived again, leaks, collisions; fingerprints of id sets; load logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged

# fixed values: how load logs name error codes and the row that a duplicate meets
ERROR_CODE = r'"(?:errorCode|error)"\s*:\s*"([A-Za-z][A-Za-z0-9_]*)"'
DUPLICATE_ID = r"\bid:\s*([a-zA-Z0-9]{18}|[a-zA-Z0-9]{15})\b"


def bucket(source: Column, target: Column, derived: Column) -> Column:
    """match, mismatch, leak (the clear value), or empty-kept."""
    empty = source.isNull() | (source == "")
    return F.when(empty, F.when(target.eqNullSafe(source), "empty-kept").otherwise("mismatch")).when(target.eqNullSafe(derived), "match").when(target.eqNullSafe(source), "leak").otherwise("mismatch")


def mask_report(pairs: DataFrame, columns: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """(column_name, bucket, n) for (name, source, target, derived) columns of rows joined through the id map, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), bucket(s, t, d).alias("bucket")) for n, s, t, d in columns])).alias("x")
    return pairs.select(each).groupBy("x.column_name", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def mapped_pairs(source: DataFrame, table: str, key: str, id_map: DataFrame, target: DataFrame, target_id: str, columns: dict[str, str]) -> DataFrame:
    """Source columns (s_name) beside the target columns they went to (t_name), row by row through the id map.

    columns names source and target columns. Rows that the map or the target lacks are left out."""
    m = id_map.where(F.col("object") == table).select(F.col("source_id").alias("__s"), F.col("target_id").alias("__t"))
    s = source.select(F.col(key).cast("string").alias("__key"), *[F.col(c).alias(f"s_{c}") for c in columns])
    t = target.select(F.col(target_id).cast("string").alias("__id"), *[F.col(c).alias(f"t_{c}") for c in columns.values()])
    return s.join(m, F.col("__key") == F.col("__s")).join(t, F.col("__t") == F.col("__id")).drop("__s", "__t", "__id").withColumnRenamed("__key", "source_id")


def copied(source: Column, target: Column) -> Column:
    """Buckets of a column that is not masked: copied, empty-kept or mismatch."""
    return F.when(source.isNull() | (source == ""), F.when(target.eqNullSafe(source), "empty-kept").otherwise("mismatch")).when(target.eqNullSafe(source), "copied").otherwise("mismatch")


def inconsistent(values: DataFrame) -> DataFrame:
    """(preset, source) with more than one mask."""
    return values.groupBy("preset", "source").agg(F.count_distinct("masked").alias("outputs")).where("outputs > 1")


def collisions(values: DataFrame) -> DataFrame:
    """(preset, masked) that several sources share."""
    return values.groupBy("preset", "masked").agg(F.count_distinct("source").alias("sources")).where("sources > 1")


def leaks(source: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Values of the whole masked column that occur in clear in the source column."""
    clear = source.select(F.col(column).alias("__v")).where("__v is not null and __v <> ''").distinct()
    return target.join(clear, F.col(target_column) == F.col("__v"), "left_semi").groupBy(F.col(target_column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def mismatch_reason(target: Column, own: Column, other: Column) -> Column:
    """Why a masked value is not what it should be: another column's mask, empty, cut off, or unknown; null if it is right."""
    return (
        F.when(target.eqNullSafe(own), F.lit(None).cast("string")).when(target.eqNullSafe(other), "other-column")
        .when(target.isNull() | (target == ""), "empty").when(own.startswith(target), "truncated").otherwise("unknown")
    )


def id_set_fingerprint(ids: DataFrame, table: str, key: str) -> DataFrame:
    """(table_name, n, digest): does not depend on order, and is summed in parts before any exchange.

    Each id counts by three 32-bit words of its SHA-256; their sums make the digest."""
    h = F.sha2(F.col(key).cast("string"), 256)
    words = [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)") for k in range(3)]
    sums = ids.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(w), F.lit(0)).cast("string").alias(f"w{k}") for k, w in enumerate(words)])
    return sums.select(F.lit(table).alias("table_name"), "n", F.concat_ws("-", "w0", "w1", "w2").alias("digest"))


def drift(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Tables whose fingerprint is not the stored one; any row blocks the load."""
    s, t = stored.select("table_name", F.col("n").alias("n_before"), F.col("digest").alias("before")), now.select("table_name", F.col("n").alias("n_now"), F.col("digest").alias("now"))
    return s.join(t, "table_name", "full_outer").where(~F.col("before").eqNullSafe(F.col("now"))).select("table_name", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_now", F.lit(0)).alias("n_now"))


def _down(number: Column, by: int) -> Column:
    """number / by, rounded down, in whole numbers."""
    n = number.cast("long")
    return F.call_function("div", n - F.pmod(n, F.lit(by)), F.lit(by).cast("long"))


def range_tree(rows: DataFrame, key: str, columns: list[str], width: int, fan: int = 16, levels: int = 3) -> DataFrame:
    """(level, node, n, digest): sums of row hashes per range of a whole-number key, folded upwards.

    A leaf (level 0) is a range of width keys, node k of a level covers nodes fan * k to fan * k + fan - 1 below. Rows without a key
    have a null node. A row counts by three 32-bit words of the SHA-256 of its key and columns; their sums make a digest, so order
    and partitions do not matter and repeated rows do. Rows meet once, in parts, at their leaf; levels are made from leaves."""
    said = F.concat(*[F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in [key, *columns]])
    h = F.sha2(said, 256)
    words = [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)").alias(f"w{k}") for k in range(3)]
    leaves = rows.select(_down(F.col(key), width).alias("leaf"), *words).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(3)])
    up = [F.struct(F.lit(level).alias("level"), _down(F.col("leaf"), fan**level).alias("node")) for level in range(levels + 1)]
    nodes = leaves.select(F.explode(F.array(*up)).alias("at"), "n", *[F.col(f"w{k}").cast("decimal(38,0)").alias(f"w{k}") for k in range(3)])
    sums = nodes.groupBy("at.level", "at.node").agg(F.sum("n").alias("n"), *[F.sum(f"w{k}").cast("string").alias(f"w{k}") for k in range(3)])
    return sums.select("level", "node", "n", F.concat_ws("-", "w0", "w1", "w2").alias("digest"))


def changed_ranges(before: DataFrame, now: DataFrame, width: int, fan: int = 16, levels: int = 3) -> DataFrame:
    """(range_start, range_end, n_before, n_now): leaves of two range trees (stored, best by level) that differ.

    Compared from the top; below it, only children of nodes that differ are looked at, and no rows at all. Rows without a key are
    the range with null ends."""
    suspects = None
    for level in range(levels, -1, -1):
        sides = [t.where(F.col("level") == level).select("node", "n", "digest") for t in (before, now)]
        if suspects is not None:
            sides = [t.join(suspects, _down(F.col("node"), fan).eqNullSafe(F.col("suspect")), "left_semi") for t in sides]
        b, t = sides[0].toDF("b_node", "b_n", "b_digest"), sides[1].toDF("t_node", "t_n", "t_digest")
        unlike = b.join(t, F.col("b_node").eqNullSafe(F.col("t_node")), "full_outer").where(~F.col("b_digest").eqNullSafe(F.col("t_digest")))
        found = staged(unlike.select(F.coalesce("b_node", "t_node").alias("node"), F.coalesce("b_n", F.lit(0)).alias("n_before"), F.coalesce("t_n", F.lit(0)).alias("n_now")), "ranges")
        suspects = found.select(F.col("node").alias("suspect"))
    return found.select((F.col("node") * width).alias("range_start"), (F.col("node") * width + width - 1).alias("range_end"), "n_before", "n_now")


def plan_parts(root: str, predicate: str, objects: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """(part, value) of all that a preview has settled: root, predicate, per table its step and key, and the sample's fingerprint.

    objects has table_name, wave, step, break_edge, kind, field and reason; sample is a row of id_set_fingerprint."""
    spark = objects.sparkSession
    said = F.concat_ws("|", F.col("wave").cast("string"), "step", F.coalesce("break_edge", F.lit("")), "kind", F.coalesce("field", "reason", F.lit("")))
    parts = spark.createDataFrame([("root", root), ("predicate", predicate)], "part string, value string").union(objects.select(F.concat(F.lit("table:"), "table_name"), said))
    if sample is not None:
        parts = parts.union(sample.select(F.lit("sample"), F.concat_ws(":", F.col("n").cast("string"), "digest")))
    return parts


def plan_drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """(part, before, now) of what differs between two plans; any row blocks the load."""
    b, n = before.select("part", F.col("value").alias("before")), now.select("part", F.col("value").alias("now"))
    return b.join(n, "part", "full_outer").where(~F.col("before").eqNullSafe(F.col("now")))


def preview(counts: DataFrame, mapped: DataFrame, decisions: DataFrame, differences: DataFrame, defaulted: DataFrame) -> DataFrame:
    """What a run would do, per table and in all (table_name null): rows in scope and mapped, the upsert key or why there is none,
    columns that only the source has, rows that point to tables that are not copied."""
    zero = F.lit(0).cast("long")
    rows = counts.join(mapped, "table_name", "left").join(decisions, "table_name", "left").join(differences, "table_name", "left").join(defaulted, "table_name", "left")
    per = rows.select(
        "table_name", "kinds", "n", F.coalesce("mapped", zero).alias("mapped"), (F.col("n") - F.coalesce("mapped", zero)).alias("to_load"),
        F.coalesce("kind", F.lit("insert-only")).alias("kind"), "field", F.coalesce("source_only", zero).alias("source_only"), F.coalesce("defaulted", zero).alias("defaulted"),
    )
    sums = [F.sum(c).alias(c) if c in ("n", "mapped", "to_load", "source_only", "defaulted") else F.lit(None).cast("string").alias(c) for c in per.columns]
    return per.union(per.agg(*sums).select(*per.columns))


def error_codes(message: Column) -> Column:
    """Distinct codes in a raw message, never free text."""
    return F.array_distinct(F.regexp_extract_all(message, F.lit(ERROR_CODE), F.lit(1)))


def error_summary(log: DataFrame) -> DataFrame:
    """(summary, n): status and codes, as HTTP 400 (CODE)."""
    codes = F.array_join(F.array_sort(error_codes(F.col("message"))), ", ")
    text = F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.when(codes != "", F.concat(F.lit(" ("), codes, F.lit(")"))).otherwise(""))
    return log.groupBy(text.alias("summary")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_ids(log: DataFrame) -> DataFrame:
    """(source_id, target_id) from messages of duplicates that name the row they met."""
    found = F.regexp_extract("message", DUPLICATE_ID, 1)
    return log.where(F.col("status_code") == "DUPLICATE_VALUE").select("source_id", found.alias("target_id")).where("target_id <> ''")


def load_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("table_name", "outcome").agg(F.count(F.lit(1)).alias("n"))
