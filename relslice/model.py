"""What a set of related tables declares about itself: keys, foreign keys and column flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ForeignKey:
    """column of table points to the key of one of targets; with several targets type_column tells which.

    first_declared: the keys of all targets lie in one space, and the first declared target that has the id counts."""

    table: str
    column: str
    targets: tuple[str, ...]
    type_column: str | None = None
    required: bool = False
    master_detail: bool = False
    first_declared: bool = False

    def __post_init__(self) -> None:
        if len(self.targets) > 1 and not (self.type_column or self.first_declared):
            raise ValueError(f"{self.table}.{self.column} has several targets and needs a type_column")


@dataclass(frozen=True)
class TableSpec:
    """key is None for a table whose rows have no unique key."""

    name: str
    key: str | None
    foreign_keys: tuple[ForeignKey, ...] = ()


@dataclass
class Dataset:
    """Tables by name with their declarations; nothing is read before it is used."""

    tables: dict[str, DataFrame]
    specs: dict[str, TableSpec] = field(default_factory=dict)

    def parents(self, table: str) -> list[ForeignKey]:
        return list(self.specs[table].foreign_keys)

    def children(self, table: str) -> list[ForeignKey]:
        return [fk for spec in self.specs.values() for fk in spec.foreign_keys if table in fk.targets]


#: Declarations of the star schema that the queries and tests run on.
STAR = {
    s.name: s
    for s in (
        TableSpec("region", "r_regionkey"),
        TableSpec("nation", "n_nationkey", (ForeignKey("nation", "n_regionkey", ("region",), required=True),)),
        TableSpec("customer", "c_custkey", (ForeignKey("customer", "c_nationkey", ("nation",), required=True),)),
        TableSpec("supplier", "s_suppkey", (ForeignKey("supplier", "s_nationkey", ("nation",), required=True),)),
        TableSpec("part", "p_partkey"),
        TableSpec("orders", "o_orderkey", (ForeignKey("orders", "o_custkey", ("customer",)),)),
        TableSpec(
            "lineitem",
            None,
            (
                ForeignKey("lineitem", "l_orderkey", ("orders",), required=True, master_detail=True),
                ForeignKey("lineitem", "l_partkey", ("part",)),
                ForeignKey("lineitem", "l_suppkey", ("supplier",)),
            ),
        ),
    )
}
