"""Which rows of related tables belong to a root: scans, samples, guards and semi-joins along foreign keys.

Ids stay DataFrames; they are never turned into literal lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Dataset, ForeignKey
from ..sources.tables import staged, staged_count

Scopes = dict[str, tuple[str, DataFrame]]


def present(column: str, df: DataFrame) -> Column:
    """The id is there: not null and, for text, not empty."""
    c = F.col(column)
    return c.isNotNull() & (c != "") if dict(df.dtypes)[column] == "string" else c.isNotNull()


def scan_ids(df: DataFrame, key: str, predicate: str | Column | None = None) -> DataFrame:
    """Ids of the rows that match."""
    hits = df if predicate is None else df.where(predicate)
    return hits.select(key).where(present(key, df))


def scan(df: DataFrame, columns: list[str], predicate: str | Column | None = None) -> DataFrame:
    return (df if predicate is None else df.where(predicate)).select(*columns)


def count_where(df: DataFrame, predicate: str | Column | None = None) -> DataFrame:
    return (df if predicate is None else df.where(predicate)).agg(F.count(F.lit(1)).alias("n"))


def sample_ids(df: DataFrame, key: str, predicate: str, n: int) -> DataFrame:
    """The n smallest ids that match: the same rows on every run."""
    return scan_ids(df, key, predicate).orderBy(key).limit(n)


def guard(df: DataFrame, key: str, predicate: str, cap: int, sample: int | None = None) -> DataFrame:
    """(matched, cap, status). No more than cap + 1 ids are counted."""
    status = F.when(F.col("matched") == 0, "empty")
    if sample is not None:
        status = status.when(F.lit(sample > cap), "sample-over-cap").otherwise("ok")
    else:
        status = status.when(F.col("matched") > cap, "over-cap").otherwise("ok")
    counted = scan_ids(df, key, predicate).limit(cap + 1).agg(F.count(F.lit(1)).alias("matched"))
    return counted.select("matched", F.lit(cap).cast("bigint").alias("cap"), status.alias("status"))


def with_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose column is among the ids."""
    values = ids.select(F.col(ids.columns[0]).alias("__id")).where("__id is not null").distinct()
    return df.join(values, df[column] == values["__id"], "left_semi")


def _comparable(df: DataFrame, column: str, ids: DataFrame) -> str | None:
    """The type in which equal values of both sides hash alike; None if there is no such type."""
    a, b = df.schema[column].dataType.simpleString(), ids.schema[0].dataType.simpleString()
    whole = {"tinyint", "smallint", "int", "bigint"}
    return "bigint" if {a, b} <= whole else a if a == b and a in ("string", "date", "binary") else None


def id_filter(ids: DataFrame, words: int, as_type: str) -> DataFrame:
    """(word, bits): a Bloom filter of the ids with two bits an id, both in one of `words` (a power of two) 64-bit words.

    It is made by an aggregation with partial sums; a row per word that is not empty."""
    word, mask = _places(F.col(ids.columns[0]).cast(as_type), words)
    return ids.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def _places(value: Column, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(value)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, n).bitwiseAND(F.lit(63)).cast("int")) for n in (40, 50)]
    return h.bitwiseAND(F.lit(words - 1)), bits[0].bitwiseOR(bits[1])


def sifted(df: DataFrame, column: str, ids: DataFrame, n: int, bits_per_id: int = 16, most_words: int = 2**21) -> DataFrame:
    """Rows of df whose column may be among n distinct ids: all that are, and about two in a hundred of the others.

    The filter is broadcast, so rows are left out in the stage that reads them. It has at most most_words rows of 16 bytes (some
    80 MB with its hash table); for more ids than that serves (8 million), and for types that do not hash alike, df comes back as
    it is."""
    words = 1 << max(0, (n * bits_per_id - 1) // 64).bit_length()
    as_type = _comparable(df, column, ids)
    if as_type is None or words > most_words:
        return df
    there = df.where(F.col(column).isNotNull())
    word, mask = _places(there[column].cast(as_type), words)
    bits = F.broadcast(id_filter(ids, words, as_type))
    return there.join(bits, (word == bits["word"]) & (bits["bits"].bitwiseAND(mask) == mask), "left_semi")


def with_few_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """with_ids() for a df far larger than what the ids select: a Bloom filter of the ids sifts df where it is read, so that only
    rows in scope (and a few others) are shuffled to the exact semi-join. Worth it where the ids are too many to be broadcast."""
    values, n = staged_count(ids.select(F.col(ids.columns[0]).alias("__id")).where("__id is not null").distinct(), "ids")
    return with_ids(sifted(df, column, values, n), column, values)


def parent_of(parent: DataFrame, key: str, scope: DataFrame, column: str) -> DataFrame:
    """Rows of parent that rows in scope point to."""
    return with_ids(parent, key, scope.select(column))


def up(data: Dataset, scope: DataFrame, hops: list[tuple[str, str]]) -> DataFrame:
    """Follow (foreign key column, parent table) pairs upwards from rows in scope, one semi-join a hop."""
    for column, table in hops:
        scope = parent_of(data.tables[table], data.specs[table].key, scope, column)
    return scope


def union_by_key(df: DataFrame, key: str, ids: list[DataFrame]) -> DataFrame:
    """Rows of a keyed table that any of the paths reaches, each once."""
    every = reduce(DataFrame.union, [i.select(F.col(i.columns[0]).alias(key)) for i in ids])
    return with_ids(df, key, every)


def where_any(df: DataFrame, paths: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of a table without a key that any path reaches; equal rows stay as many as they are."""
    flagged = df
    for i, (column, ids) in enumerate(paths):
        values = ids.select(F.col(ids.columns[0]).alias(f"__id{i}")).where(f"__id{i} is not null").distinct()
        flagged = flagged.join(values, flagged[column] == values[f"__id{i}"], "left")
    hit = reduce(Column.__or__, [F.col(f"__id{i}").isNotNull() for i in range(len(paths))])
    return flagged.where(hit).select(*df.columns)


def _pointing(rows: DataFrame, fk: ForeignKey, target: str) -> DataFrame:
    """Values of a foreign key that point to one target; with several targets, its type column tells which."""
    return (rows.where(F.col(fk.type_column) == target) if fk.type_column else rows).select(fk.column)


def scopes(data: Dataset, root: str, root_ids: DataFrame, max_hops: int = 4, lookups: set[tuple[str, str]] | None = None) -> dict[str, tuple[str, DataFrame]]:
    """(path kinds, rows in scope) per table that the declarations of a dataset tie to a root.

    Direct parents and children of the root, tables that its children look up (by the (child, column) pairs in lookups; None
    takes all), and then further parents, at most max_hops above the root. A table that several paths reach takes the union of
    them; transitive paths count only where there is no other. Only names are looked at here, no rows: a table is visited once, so
    rows that are needed again from a deeper level are not in yet. closed() adds them."""
    out = {root: ("root", with_ids(data.tables[root], data.specs[root].key, root_ids))}
    near: dict[str, list[tuple[str, str, DataFrame]]] = {}

    def reach(into: dict, name: str, kind: str, column: str, values: DataFrame) -> None:
        if name in data.tables and name not in out and (kind == "direct-child" or data.specs[name].key):
            into.setdefault(name, []).append((kind, column, values))

    def settle(found: dict[str, list[tuple[str, str, DataFrame]]]) -> list[str]:
        for name, paths in found.items():
            df, key = data.tables[name], data.specs[name].key
            keyed = key and all(column == key for _, column, _ in paths)
            rows = union_by_key(df, key, [v for *_, v in paths]) if keyed else where_any(df, [(c, v) for _, c, v in paths])
            out[name] = (",".join(sorted({kind for kind, *_ in paths})), rows)
        return list(found)

    for fk in data.parents(root):
        for target in fk.targets:
            if target != root and target in data.specs:
                reach(near, target, "direct-parent", data.specs[target].key, _pointing(out[root][1], fk, target))
    for fk in data.children(root):
        if fk.table != root:
            reach(near, fk.table, "direct-child", fk.column, root_ids)
    children = [name for name, paths in near.items() if any(kind == "direct-child" for kind, *_ in paths)]
    parents = settle(near)
    looked: dict[str, list[tuple[str, str, DataFrame]]] = {}
    for child in children:
        for fk in data.parents(child):
            if lookups is None or (child, fk.column) in lookups:
                for target in fk.targets:
                    if target not in (root, child) and target in data.specs:
                        reach(looked, target, "child-lookup", data.specs[target].key, _pointing(out[child][1], fk, target))
    wave = [name for name in parents if name not in children] + settle(looked)
    for _ in range(max_hops - 1):
        above: dict[str, list[tuple[str, str, DataFrame]]] = {}
        for name in wave:
            for fk in data.parents(name):
                for target in fk.targets:
                    if target != name and target in data.specs:
                        reach(above, target, "transitive", data.specs[target].key, _pointing(out[name][1], fk, target))
        wave = settle(above)
    return out


def targets_of(data: Dataset, rows: DataFrame, fk: ForeignKey, target: str) -> DataFrame:
    """(id): the rows of one target that a foreign key of rows points to, each once.

    With several targets, the type column tells which one; without it, the first declared target that has the id."""
    ids = _pointing(rows, fk, target).select(F.col(fk.column).alias("id")).where("id is not null").distinct()
    if not fk.type_column:
        for earlier in fk.targets[: fk.targets.index(target)]:
            if earlier in data.tables:
                ids = ids.join(data.tables[earlier].select(F.col(data.specs[earlier].key).alias("id")), "id", "left_anti")
    return ids


def _followed(data: Dataset, table: str, required: bool) -> list[tuple[ForeignKey, str]]:
    """Foreign keys of a table with each of their targets that has a key; required: those alone that may not be null."""
    keys = [fk for fk in data.parents(table) if fk.required or not required]
    return [(fk, target) for fk in keys for target in fk.targets if target in data.tables and data.specs[target].key]


def closed(data: Dataset, scopes: Scopes, required: bool = True, compact: int = 8) -> Scopes:
    """Scopes with every row that rows in scope point to, and what those point to, until nothing is missing.

    Follows required foreign keys, or all of them. Per table, only the rows that came new in a round are followed in the next one;
    they are staged with their foreign keys, so a table is read once a round, and only where something points to it. Rows of one
    table that point to each other (self references), several paths to a table and cycles between tables need nothing of their
    own: the rounds end when no table has new rows, at the latest after as many as the longest chain of rows. Ids that the target
    does not have stay open; dangling() reports them. A table that gains rows has `closure` among its kinds."""

    def needed(table: str) -> list[str]:
        own = [data.specs[table].key] if data.specs[table].key else []
        return list(dict.fromkeys(own + [c for fk, _ in _followed(data, table, required) for c in (fk.column, fk.type_column) if c]))

    held: dict[str, list[DataFrame]] = {}
    new: dict[str, DataFrame] = {}
    for table, (_, rows) in scopes.items():
        if needed(table):
            new[table] = staged(rows.select(*needed(table)), "scope")
            if data.specs[table].key:
                held[table] = [new[table].select(F.col(data.specs[table].key).alias("id"))]
    gained: set[str] = set()
    while new:
        wanted: dict[str, list[DataFrame]] = {}
        for table, rows in new.items():
            for fk, target in _followed(data, table, required):
                wanted.setdefault(target, []).append(targets_of(data, rows, fk, target))
        new = {}
        for target, ids in wanted.items():
            open_ids = reduce(DataFrame.union, ids).distinct()
            if target in held:
                open_ids = open_ids.join(reduce(DataFrame.union, held[target]), "id", "left_anti")
            key = data.specs[target].key
            found, n = staged_count(with_ids(data.tables[target].select(*needed(target)), key, open_ids), "closure")
            if n:
                new[target] = found
                gained.add(target)
        for target, found in new.items():  # after all were compared with what was held before the round
            parts = [*held.get(target, []), found.select(F.col(data.specs[target].key).alias("id"))]
            held[target] = [staged(reduce(DataFrame.union, parts), "held")] if len(parts) > compact else parts
    out = dict(scopes)
    for table in gained:
        kinds, before = scopes.get(table, ("", None))
        rows = with_ids(data.tables[table], data.specs[table].key, reduce(DataFrame.union, held[table]))
        out[table] = (",".join(sorted({*filter(None, kinds.split(",")), "closure"})), rows)
    return out


def dangling(data: Dataset, scopes: Scopes, required: bool = True) -> DataFrame:
    """(table_name, column_name, target, reason, n): rows in scope whose foreign key leads to no row in scope.

    The reason is not-in-scope, or not-in-source if the target table lacks the row itself."""
    found = []
    for table, (_, rows) in scopes.items():
        for fk in data.parents(table):
            if required and not fk.required:
                continue
            for target in fk.targets:
                if target not in data.tables or not data.specs[target].key:
                    continue
                key = data.specs[target].key
                lost = _pointing(rows, fk, target).select(F.col(fk.column).alias("id")).where("id is not null")
                if len(fk.targets) > 1 and not fk.type_column:
                    lost = lost.join(targets_of(data, rows, fk, target), "id", "left_semi")
                    if target != fk.targets[-1]:  # what no target has is reported with the last one
                        lost = with_ids(lost, "id", data.tables[target].select(key))
                if target in scopes:
                    lost = lost.join(scopes[target][1].select(F.col(key).alias("id")), "id", "left_anti")
                there = data.tables[target].select(F.col(key).alias("id")).distinct().withColumn("there", F.lit(True))
                judged = lost.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(there, "id", "left")
                reason = F.when(F.col("there"), "not-in-scope").otherwise("not-in-source")
                found.append(judged.groupBy(reason.alias("reason")).agg(F.sum("n").alias("n")).select(F.lit(table).alias("table_name"), F.lit(fk.column).alias("column_name"), F.lit(target).alias("target"), "reason", "n"))
    if not found:
        raise ValueError("no foreign key is declared for these tables")
    return reduce(DataFrame.union, found)


def scope_ids(data: Dataset, scopes: Scopes) -> DataFrame:
    """(table_name, id): the ids in scope of every table with a key, as text."""
    each = [rows.select(F.lit(name).alias("table_name"), F.col(data.specs[name].key).cast("string").alias("id")) for name, (_, rows) in scopes.items() if data.specs[name].key]
    return reduce(DataFrame.union, each)


def star_scopes(data: Dataset, root_ids: DataFrame) -> dict[str, tuple[str, DataFrame]]:
    """scopes() for a root of orders."""
    return scopes(data, "orders", root_ids)


def scope_counts(scopes: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(table_name, kinds, n)."""
    each = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.lit(kind).alias("kinds"), "n") for name, (kind, df) in scopes.items()]
    return reduce(DataFrame.union, each)
