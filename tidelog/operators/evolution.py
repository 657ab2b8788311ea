"""Schema versions and migrations, compiled to expressions over an event's map of values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.values import to_json
from tidelog.sources.log import CREATED, EVOLVED, INSERTED, UPDATED

COMPATIBLE, NEEDED, INCOMPATIBLE = "COMPATIBLE", "MIGRATION_NEEDED", "INCOMPATIBLE"


@dataclass(frozen=True)
class AddColumn:
    """Set a default where the column is absent."""

    name: str
    default: Any = None

    def apply(self, m: Column) -> Column:
        return F.when(F.map_contains_key(m, F.lit(self.name)), m).otherwise(F.map_concat(m, F.create_map(F.lit(self.name), F.lit(to_json(self.default)))))


@dataclass(frozen=True)
class RemoveColumn:
    name: str

    def apply(self, m: Column) -> Column:
        return F.map_filter(m, lambda k, _: k != self.name)


@dataclass(frozen=True)
class RenameColumn:
    """Move a value if it is present; an existing target is replaced."""

    old: str
    new: str

    def apply(self, m: Column) -> Column:
        moved = F.map_concat(F.map_filter(m, lambda k, _: ~k.isin(self.old, self.new)), F.create_map(F.lit(self.new), m[self.old]))
        return F.when(F.map_contains_key(m, F.lit(self.old)), moved).otherwise(m)


@dataclass(frozen=True)
class ModifyColumn:
    """Declare another type; stored values stay, unless ``cast_to`` names a Spark type to try."""

    name: str
    cast_to: str | None = None

    def apply(self, m: Column) -> Column:
        if not self.cast_to:
            return m
        return F.transform_values(m, lambda k, v: F.when(k == self.name, F.coalesce(v.try_cast(self.cast_to).cast("string"), F.lit("null"))).otherwise(v))


#: The fields of a column in an event's definition.
COLUMN_FIELDS = ("name", "type", "primary_key", "unique")


def columns_of(definition: str) -> list[dict]:
    """The columns that a schema event declares; of an evolution, the new ones."""
    found = json.loads(definition)
    columns = found["new_schema"] if isinstance(found, dict) else found
    return [{k: c[k] for k in COLUMN_FIELDS if k in c} for c in columns]


def payload(table: str, old: list[dict], new: list[dict], operations: list) -> dict:
    """What an evolution records: both schemas, and the columns added, removed, renamed and modified."""
    before, after = ({c["name"]: c for c in columns} for columns in (old, new))
    renamed = {op.old: op.new for op in operations if isinstance(op, RenameColumn) and op.old in before and op.new in after}
    added = [c for n, c in after.items() if n not in before and n not in renamed.values()]
    removed = [n for n in before if n not in after and n not in renamed]
    modified = [{"name": n, "old_definition": before[n], "new_definition": c} for n, c in after.items() if n in before and before[n] != c]
    return {"table_name": table, "old_schema": old, "new_schema": new, "evolution": {"added_columns": added, "removed_columns": removed, "modified_columns": modified, "renamed_columns": renamed}}


@dataclass
class Registry:
    """Versions of tables' schemas, and the migrations between them."""

    schemas: dict[tuple[str, int], list[dict]] = field(default_factory=dict)
    migrations: dict[tuple[str, int, int], list] = field(default_factory=dict)

    def register(self, table: str, version: int, columns: list[dict]) -> None:
        self.schemas[table, version] = columns

    def register_migration(self, table: str, old: int, new: int, operations: list) -> None:
        self.migrations[table, old, new] = operations

    def schema(self, table: str, version: int) -> list[dict]:
        if (table, version) not in self.schemas:
            raise KeyError(f"no schema of table '{table}' at version {version}")
        return self.schemas[table, version]

    def latest(self, table: str) -> int:
        return max((v for t, v in self.schemas if t == table), default=0)

    def path(self, table: str, old: int, new: int) -> list:
        """The operations from one version to another, step by step; backward and missing steps raise."""
        if old > new:
            raise ValueError(f"can't migrate '{table}' backward from {old} to {new}")
        out = []
        for v in range(old, new):
            if (table, v, v + 1) not in self.migrations:
                raise ValueError(f"no migration path for '{table}' from {v} to {v + 1}")
            out += self.migrations[table, v, v + 1]
        return out

    def check(self, table: str, old: int, new: int) -> str:
        """By the direct edge only; ``check_path`` also takes several steps."""
        if (table, old) not in self.schemas or (table, new) not in self.schemas:
            return INCOMPATIBLE
        if old >= new:
            return COMPATIBLE
        return NEEDED if (table, old, new) in self.migrations else INCOMPATIBLE

    def check_path(self, table: str, old: int, new: int) -> str:
        try:
            return self.check(table, old, new) if old >= new else NEEDED if self.path(table, old, new) is not None else INCOMPATIBLE
        except ValueError:
            return INCOMPATIBLE


def apply_operations(m: Column, operations: list) -> Column:
    return reduce(lambda acc, op: op.apply(acc), operations, m)


def migrated(log: DataFrame, registry: Registry, targets: dict[str, int], versions: dict[str, list[int]], on_error: str = "drop", migrate_updates: bool = False) -> DataFrame:
    """The log with inserted rows brought to each table's target version.

    ``versions``: the versions that each table's events may have. Without a path, ``drop`` leaves the
    insertion out and ``keep`` leaves it as it is; a later version than the target counts as without a path
    under ``keep`` and as migrated under ``drop``. Updates stay as they were written unless ``migrate_updates``.
    """
    kinds = [INSERTED, UPDATED] if migrate_updates else [INSERTED]
    data, lost = F.col("data"), F.lit(False)
    for table, target in targets.items():
        for version in versions.get(table, []):
            if version == target or (version > target and on_error == "drop"):
                continue
            here = F.col("type").isin(*kinds) & (F.col("table_name") == table) & (F.col("version") == version)
            try:
                operations = registry.path(table, version, target)
            except ValueError:
                lost = lost | (here & (F.col("type") == INSERTED)) if on_error == "drop" else lost
                continue
            data = F.when(here, apply_operations(F.col("data"), operations)).otherwise(data)
    return log.where(~lost).withColumn("data", data)


def history(log: DataFrame) -> DataFrame:
    """The distinct schema versions of each table, in order."""
    return log.where(F.col("type").isin(CREATED, EVOLVED)).groupBy("table_name").agg(F.array_sort(F.collect_set("version")).alias("versions"))
