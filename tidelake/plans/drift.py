"""Schema drift: what changed between a declared or stored schema and a batch, and what is done about it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.conform import MALFORMED, conform_types

EVOLVE, FILL_NULL, CAST, DROP_COLUMN, REJECT = "evolve", "fill_null", "cast", "drop_column", "reject_batch"


@dataclass(frozen=True)
class Change:
    column: str
    action: str
    detail: str = ""


def castable(source: T.DataType, target: T.DataType) -> bool:
    """From nothing, to text, among numbers, among dates and times."""
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return (
        source == target or isinstance(source, T.NullType) or isinstance(target, T.StringType)
        or (isinstance(source, T.NumericType) and isinstance(target, T.NumericType)) or (isinstance(source, temporal) and isinstance(target, temporal))
    )


def source_changes(columns: Sequence[str], declared: Sequence[str], required: Sequence[str], undeclared: str = DROP_COLUMN) -> list[Change]:
    """Required columns that are missing reject the batch; undeclared ones follow the policy."""
    gone = [Change(c, REJECT, "required column is missing") for c in required if c not in columns]
    return gone + [Change(c, undeclared, "undeclared column") for c in columns if c not in declared and c != MALFORMED]


def target_changes(batch: T.StructType, target: T.StructType) -> list[Change]:
    """New columns evolve the target, missing ones are NULL, other types are cast if they can be, else reject."""
    old, out = {f.name: f.dataType for f in target}, []
    for f in batch:
        if f.name.startswith("_"):
            continue
        if f.name not in old:
            out.append(Change(f.name, EVOLVE, f.dataType.simpleString()))
        elif f.dataType != old[f.name]:
            detail = f"{f.dataType.simpleString()} to {old[f.name].simpleString()}"
            out.append(Change(f.name, CAST if castable(f.dataType, old[f.name]) else REJECT, detail))
    names = {f.name for f in batch}
    return out + [Change(f.name, FILL_NULL) for f in target if f.name not in names]


def aligned(df: DataFrame, changes: Sequence[Change], target: T.StructType) -> DataFrame:
    """Casts (lossy values show up as malformed) and typed NULL columns."""
    types = {f.name: f.dataType for f in target}
    casts = {c.column: types[c.column] for c in changes if c.action == CAST}
    out = conform_types(df, casts) if casts else df
    return out.withColumns({c.column: F.lit(None).cast(types[c.column]) for c in changes if c.action == FILL_NULL})


def rejected(changes: Sequence[Change]) -> list[Change]:
    return [c for c in changes if c.action == REJECT]


def described(changes: Sequence[Change]) -> str | None:
    """All changes as one text; None if there are none."""
    return "; ".join(f"{c.action}({c.column})" + (f": {c.detail}" if c.detail else "") for c in changes) or None


def checks(changes: Sequence[Change]) -> list[dict]:
    """A result for each change, like those of rules."""
    status = {REJECT: "failed", DROP_COLUMN: "warning"}
    return [{"name": f"schema:{c.action}({c.column})", "category": "schema", "action": c.action, "status": status.get(c.action, "info"), "failed": None, "note": c.detail or None} for c in changes]


def report(spark, changes: Sequence[Change]) -> DataFrame:
    return spark.createDataFrame([(c.column, c.action, c.detail) for c in changes], "column string, action string, detail string")
