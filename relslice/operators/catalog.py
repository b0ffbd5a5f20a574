"""Questions to a table of column descriptions (table_name, column_name, label, type and flags), of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mask import TEXT_TYPES, pick_strategy
from ..model import Dataset

# fixed values: columns that a store fills in by itself
AUDIT = ["CreatedById", "CreatedDate", "LastModifiedById", "LastModifiedDate", "SystemModstamp", "LastActivityDate", "LastViewedDate", "LastReferencedDate"]
# fixed values: what names and labels of sensitive columns hold
SENSITIVE = r"(?i)(?:ssn|social[_ ]?sec|tax[_ ]?id|\bdob\b|birth[_ ]?date|date[_ ]?of[_ ]?birth|passport|license|credit[_ ]?card|\bcard[_ ]?num|account[_ ]?num|routing[_ ]?num|iban\b|\bcvv\b|email|phone|mobile|address|postal|zip|patient|diagnosis|medical)"

# fixed values: children that automation fills in
SYSTEM_CHILDREN = [
    "Feed$", "^FeedComment$", "^FeedItem$", "^FeedAttachment$", "^FeedRevision$", "^FeedPollChoice$", "^FeedPollVote$", "History$", "History2$", "ChangeEvent$", "Share$", "Tag$",
    "OwnerSharingRule$", "AccessRule$", "^AgentWork", "^FlowRecord", "^FlowOrchestration", "^FlowExecution", "^FlowInterview", "^ProcessInstance", "^ProcessException", "^RecordAction",
    "^PendingServiceRouting", "^NetworkActivity", "^NetworkFeed", "^NetworkUser", "^EntitySubscription$", "^CombinedAttachment$", "^AIInsightValue$", "^AIRecordInsight$", "^OpenActivity$",
    "^ActivityHistory$", "^CollaborationGroupRecord$", "^UserDefinedLabelAssignment$", "^AttachedContentDocument$", "^AttachedContentNote$", "^LookedUpFromActivity$",
]
# fixed values: tables that every store has and that are not copied
STANDARD_ROOTS = ["User", "UserRole", "Profile", "PermissionSet", "PermissionSetGroup", "Group", "Organization", "RecordType", "RecordTypeLocalization", "CurrencyType", "BusinessHours", "Calendar", "Holiday", "Queue", "QueueSobject"]
# fixed values: how system tables end
SYSTEM_ENDS = ["ChangeEvent", "Feed", "History", "Share", "Tag", "OwnerSharingRule", "AccessRule", "__mdt"]


def is_managed(name: Column) -> Column:
    """The name has a namespace: three parts or more, or two of which the last is not c."""
    parts = F.split(name, "__")
    return (F.size(parts) >= 3) | ((F.size(parts) == 2) & (F.get(parts, F.lit(1)) != "c"))


def noise(names: DataFrame) -> DataFrame:
    """(name, managed, system_child, standard_root, system) for names that users seldom want to see."""
    n = F.col("name")
    return names.select("name", is_managed(n).alias("managed"), n.rlike("|".join(SYSTEM_CHILDREN)).alias("system_child"), n.isin(STANDARD_ROOTS).alias("standard_root"), n.rlike("(?:" + "|".join(SYSTEM_ENDS) + ")$").alias("system"))


def hidden_counts(names: DataFrame, include_managed: bool = False, include_system: bool = False) -> DataFrame:
    """(shown, managed_hidden, system_hidden, stops): how many names each rule hides; the first that fits counts."""
    flags = noise(names)
    why = F.when(F.col("standard_root"), "stop").when(F.col("managed") & F.lit(not include_managed), "managed").when(F.col("system_child") & F.lit(not include_system), "system")
    w = F.coalesce(why, F.lit("shown"))
    return flags.agg(*[F.count_if(w == k).alias(c) for k, c in (("shown", "shown"), ("managed", "managed_hidden"), ("system", "system_hidden"), ("stop", "stops"))])


def drop_reason(include_formula: bool = False, include_audit: bool = False, include_non_createable: bool = False) -> Column:
    """Why a column is left out of a copy; null if it stays. The first reason that fits counts."""
    never = F.when(F.lit(False), F.lit(""))
    why = never if include_formula else never.when(F.col("calculated"), "formula")
    why = why if include_audit else why.when(F.col("column_name").isin(AUDIT), "audit")
    return why if include_non_createable else why.when(~F.col("createable"), "non-createable")


def filter_report(columns: DataFrame, **include: bool) -> DataFrame:
    """Per table: columns kept and dropped, by reason. include_formula and so on keep what is dropped otherwise."""
    c = columns.withColumn("why", drop_reason(**include))
    return c.groupBy("table_name").agg(
        F.count_if(F.col("why").isNull()).alias("kept"), F.count_if(F.col("why") == "formula").alias("formula"), F.count_if(F.col("why") == "audit").alias("audit"), F.count_if(F.col("why") == "non-createable").alias("non_createable")
    )


def required_reason() -> Column:
    """Why a column must have a value; null if it need not."""
    must = F.col("createable") & ~F.col("nillable") & ~F.col("defaulted") & ~F.col("calculated")
    return F.when(F.col("master_detail"), "master-detail").when(must, "not-nillable")


def required_columns(columns: DataFrame) -> DataFrame:
    return columns.withColumn("reason", required_reason()).where("reason is not null").select("table_name", "column_name", "pos", "reason")


def null_report(df: DataFrame, name: str, required: list[str]) -> DataFrame:
    """Rows without a value, per required column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.select(F.lit(name).alias("table_name"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in required])).alias("x")).select("table_name", "x.column_name", "x.nulls")


def is_sensitive() -> Column:
    return F.col("column_name").rlike(SENSITIVE) | F.coalesce(F.col("label").rlike(SENSITIVE), F.lit(False))


def sensitive_columns(columns: DataFrame) -> DataFrame:
    return columns.where(is_sensitive()).select("table_name", "column_name", "pos")


def writable(columns: DataFrame) -> DataFrame:
    """Columns that a load may send: not the id, not calculated, createable; defaulted ones stay."""
    return columns.where("type <> 'id' and createable and not calculated")


def intersect(source: DataFrame, target: DataFrame) -> DataFrame:
    """Writable source columns and whether the target has them; a table that the target lacks altogether keeps all."""
    t = target.select("table_name", "column_name").distinct().withColumn("there", F.lit(True))
    known = target.select("table_name").distinct().withColumn("known", F.lit(True))
    return writable(source).join(t, ["table_name", "column_name"], "left").join(known, "table_name", "left").select("table_name", "column_name", "pos", (F.col("there").isNotNull() | F.col("known").isNull()).alias("kept"))


def length_clamp(source: DataFrame, target: DataFrame) -> DataFrame:
    """The smaller of both lengths."""
    t = target.select("table_name", "column_name", F.col("length").alias("target_length"))
    return source.join(t, ["table_name", "column_name"]).select("table_name", "column_name", F.least("length", "target_length").alias("length"))


def schema_diff(source: DataFrame, target: DataFrame, shown: int = 10) -> DataFrame:
    """Per table: whether the target lacks it, how many columns only the source has, and the first of them by name."""
    have = target.select("table_name").distinct().withColumn("there", F.lit(True))
    t = target.select("table_name", "column_name").distinct().withColumn("same", F.lit(True))
    rows = writable(source).select("table_name", "column_name").distinct().join(t, ["table_name", "column_name"], "left").join(have, "table_name", "left")
    only = F.when(F.col("same").isNull(), F.col("column_name"))
    rank = F.row_number().over(Window.partitionBy("table_name").orderBy("column_name"))
    first = rows.where("same is null").select("table_name", "column_name").withColumn("rank", rank).where(F.col("rank") <= shown)  # limited before it is exchanged
    names = first.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list("column_name")), ",").alias("first_columns"))
    counts = rows.groupBy("table_name").agg(F.max(F.col("there").isNull()).alias("missing"), F.count(only).alias("source_only"))
    return counts.join(names, "table_name", "left").select("table_name", "missing", "source_only", F.coalesce("first_columns", F.lit("")).alias("first_columns"))


def masked_length_warnings(source: DataFrame, target: DataFrame) -> DataFrame:
    """Masked columns that are shorter on the target."""
    t = target.select("table_name", "column_name", F.col("length").alias("target_length"))
    masked = source.where(is_sensitive() & F.col("type").isin(TEXT_TYPES))
    return masked.join(t, ["table_name", "column_name"]).where("target_length < length").select("table_name", "column_name", "length", "target_length")


def mask_strategies(columns: DataFrame) -> DataFrame:
    return columns.select("table_name", "column_name", "pos", pick_strategy(F.col("type"), F.col("column_name"), F.col("label")).alias("strategy"))


def mask_selection(columns: DataFrame, overrides: DataFrame) -> DataFrame:
    """Sensitive text columns with strategy auto, then overrides (table_name, column_name, strategy); copy opts out. Of two overrides of a
    column the larger strategy counts."""
    found = columns.where(is_sensitive() & F.col("type").isin(TEXT_TYPES)).select("table_name", "column_name", F.lit("auto").alias("strategy"), F.lit(0).alias("rank"))
    both = found.unionByName(overrides.select("table_name", "column_name", "strategy", F.lit(1).alias("rank")))
    return both.groupBy("table_name", "column_name").agg(F.max_by("strategy", F.struct("rank", "strategy")).alias("strategy")).where("strategy <> 'copy'")


def recall_report(columns: DataFrame) -> DataFrame:
    """Per table: columns flagged, those that will be masked, and flagged ones that are not text."""
    s, text = is_sensitive(), F.col("type").isin(TEXT_TYPES)
    return columns.groupBy("table_name").agg(F.count_if(s).alias("flagged"), F.count_if(s & text).alias("will_mask"), F.count_if(s & ~text).alias("flagged_non_text"))


def upsert_candidates(columns: DataFrame) -> DataFrame:
    """Columns that could identify a row on the target."""
    return columns.where("external_id and id_lookup and is_unique and createable and not auto_number and not calculated")


def unique_keys(tables: dict[str, tuple[DataFrame, list[str]]], error: float = 0.03) -> DataFrame:
    """(table_name, column_name, n, filled, is_unique) of the named columns, from the data: no value comes twice, and one is there.

    One pass a table counts rows and filled values and estimates distinct ones by HyperLogLog sketches of all columns at once. A
    column whose estimate is further below its filled values than eight standard errors is not unique; only the others are grouped
    by value, in parts before the exchange. The driver sees one row of counts a table. Empty columns and tables have no key."""
    out = []
    for name, (df, columns) in tables.items():
        counts = [F.struct(F.count(c).alias("filled"), F.approx_count_distinct(c, error).alias("distinct")).alias(f"c{i}") for i, c in enumerate(columns)]
        seen = df.agg(F.count(F.lit(1)).alias("n"), *counts).first()
        for i, c in enumerate(columns):
            filled, distinct = seen[f"c{i}"]
            said = [F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(seen["n"]).cast("long").alias("n"), F.lit(filled).cast("long").alias("filled")]
            if filled and distinct >= (1 - 8 * error) * filled:
                again = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("times")).agg(F.coalesce(F.max("times"), F.lit(0)).alias("most"))
                out.append(again.select(*said, (F.col("most") == 1).alias("is_unique")))
            else:
                out.append(df.sparkSession.range(1).select(*said, F.lit(False).alias("is_unique")))
    return reduce(DataFrame.union, out)


def upsert_decisions(columns: DataFrame, target: DataFrame, overrides: DataFrame, sticky: DataFrame, population: DataFrame | None) -> DataFrame:
    """Per table: the key to match on, or why there is none. Override before sticky before single before best filled.

    Without a population (None) several candidates stay undecided."""
    probed = population is not None
    if not probed:
        population = columns.select("table_name", "column_name", F.lit(0).cast("long").alias("filled")).where("false")
    own = upsert_candidates(columns).select("table_name", "column_name").distinct()
    there = upsert_candidates(target).select("table_name", "column_name").distinct().withColumn("there", F.lit(True))
    seen = target.select("table_name").distinct().withColumn("described", F.lit(True))
    full = own.join(population, ["table_name", "column_name"], "left").join(there, ["table_name", "column_name"], "left")
    best = F.min_by("column_name", F.struct(-F.coalesce("filled", F.lit(0)), F.col("column_name")))
    per = full.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("candidates"), best.alias("best"), F.coalesce(F.max("filled"), F.lit(0)).alias("most"), F.collect_set("column_name").alias("names"), F.collect_set(F.when(F.col("there"), F.col("column_name"))).alias("ok")
    )
    t = columns.select("table_name").distinct().join(per, "table_name", "left").join(seen, "table_name", "left")
    t = t.join(overrides.select("table_name", F.col("column_name").alias("override")), "table_name", "left").join(sticky.select("table_name", F.col("column_name").alias("sticky")), "table_name", "left")
    none = F.col("candidates").isNull()
    bad_override = F.col("override").isNotNull() & ~F.array_contains("names", F.col("override"))
    use_sticky = F.col("sticky").isNotNull() & F.array_contains("ok", F.col("sticky"))
    undecided = F.col("override").isNull() & ~F.coalesce(use_sticky, F.lit(False)) & (F.col("candidates") > 1)
    empty = undecided & (F.col("most") == 0) if probed else undecided
    field = F.when(F.col("override").isNotNull(), F.col("override")).when(use_sticky, F.col("sticky")).otherwise(F.col("best"))
    t = t.withColumn("field", field)
    reason = (
        F.when(none, "no-candidates").when(bad_override, "override-invalid").when(empty, "all-candidates-empty" if probed else "multiple-candidates")
        .when(F.col("described").isNull(), "target-describe-failed").when(~F.array_contains("ok", F.col("field")), "target-missing-field")
    )
    t = t.withColumn("reason", reason)
    return t.select("table_name", F.when(F.col("reason").isNull(), "picked").otherwise("ambiguous").alias("kind"), F.when(F.col("reason").isNull(), F.col("field")).alias("field"), "reason")


def key_conflicts(columns: DataFrame) -> DataFrame:
    """(table_name, candidates) of tables with several candidate keys."""
    return upsert_candidates(columns).select("table_name", "column_name").distinct().groupBy("table_name").agg(F.count(F.lit(1)).alias("candidates")).where("candidates > 1")


def verify_target(choices: DataFrame, target: DataFrame) -> DataFrame:
    """choices (table_name, column_name) with verdict: picked, target-describe-failed or target-missing-field."""
    ok = upsert_candidates(target).select("table_name", "column_name").distinct().withColumn("__ok", F.lit(True))
    seen = target.select("table_name").distinct().withColumn("__seen", F.lit(True))
    verdict = F.when(F.col("__seen").isNull(), "target-describe-failed").when(F.col("__ok").isNull(), "target-missing-field").otherwise("picked")
    return choices.join(ok, ["table_name", "column_name"], "left").join(seen, "table_name", "left").select("table_name", "column_name", verdict.alias("verdict"))


def described(data: Dataset) -> DataFrame:
    """(table_name, column_name, pos) of a dataset, from the schemas of its tables; no rows are read."""
    spark = next(iter(data.tables.values())).sparkSession
    return spark.createDataFrame([(t, c, i) for t, df in data.tables.items() for i, c in enumerate(df.columns, 1)], "table_name string, column_name string, pos long")
