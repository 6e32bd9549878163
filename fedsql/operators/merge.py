"""The five ways a result goes into a table, as joins on its primary key.

``I`` appends; ``U`` updates rows whose key exists; ``UI`` updates or
inserts; ``UDI`` also deletes the target's rows in range that the source
lacks; ``DI`` deletes the rows in range, then inserts.  Columns that the
source lacks keep their value on update and are null on insert.  Null keys
match null keys.  If a key comes several times in the source, the last in
order of all its columns wins an update; inserts keep each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("I", "U", "UI", "UDI", "DI")
NAMES = {"INSERT": "I", "UPDATE": "U", "UPDATE_INSERT": "UI", "UPDATE_DELETE_INSERT": "UDI", "DELETE_INSERT": "DI"}


def aligned(source: DataFrame, target: DataFrame) -> DataFrame:
    return target.unionByName(source, allowMissingColumns=True) if source.columns else target


def merge(target: DataFrame | None, source: DataFrame, keys: Sequence[str], mode: str = "I", scope: str | None = None) -> DataFrame:
    """The table after the write.  ``scope``: SQL over key columns bounding what UDI and DI delete (all rows if not given)."""
    mode = NAMES.get(mode.upper(), mode.upper())
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if target is None:
        return source if mode != "U" else source.limit(0)
    if mode == "I":
        return aligned(source, target)
    inside = F.coalesce(F.expr(scope).cast("boolean"), F.lit(False)) if scope else F.lit(True)
    if mode == "DI":
        return aligned(source, target.filter(~inside))
    keys = [k for k in keys if k in target.columns and k in source.columns]
    if not keys:
        raise ValueError(f"{mode} needs a primary key that both sides have")
    others = [c for c in source.columns if c not in keys]
    own = source.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), F.struct(*(F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(others)), F.lit(1).alias("__one")).alias("__v"))
    last = own.groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(F.max("__v").alias("__v"))
    on: Column = F.lit(True)
    for i, k in enumerate(keys):
        on = on & target[f"`{k}`"].eqNullSafe(F.col(f"__k{i}"))
    joined = target.join(last, on, "left")
    if mode == "UDI":
        joined = joined.filter(F.col("__v").isNotNull() | ~inside)
    place = {c: i for i, c in enumerate(others)}
    updated = joined.select(*(F.when(F.col("__v").isNotNull(), F.col("__v")[f"v{place[c]}"].cast(target.schema[c].dataType)).otherwise(target[f"`{c}`"]).alias(c) if c in place else target[f"`{c}`"] for c in target.columns))
    if mode == "U":
        return updated
    new_on: Column = F.lit(True)
    for k in keys:
        new_on = new_on & source[f"`{k}`"].eqNullSafe(target[f"`{k}`"])
    return aligned(source.join(target, new_on, "left_anti"), updated)


def delete(target: DataFrame, condition: str) -> DataFrame:
    """Without the rows for which the condition holds; rows where it is null stay."""
    return target.filter(~F.coalesce(F.expr(condition).cast("boolean"), F.lit(False)))
