"""Reshaping tables: key/value rows to columns and back.

Pivoted columns are named by values, so their number is bounded by
:data:`MOST_COLUMNS`; beyond it the call fails instead of dropping any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from fedsql.session import written

MOST_COLUMNS = 10_000


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _values(df: DataFrame, head: str) -> list[str]:
    """The column names to come, in order; the names of a result are known to its reader, so they are bounded."""
    rows = df.select(_c(head).cast("string").alias("h")).filter("h is not null").distinct().limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"{head} has more than {MOST_COLUMNS} values to make columns of")
    return sorted(r.h for r in rows)


def v4h(df: DataFrame, key: str, value: str, *keep: str) -> DataFrame:
    """Each column but those kept becomes a (key, value) row; values of unlike types are texts."""
    rest = [c for c in df.columns if c not in keep]
    kinds = {df.schema[c].dataType.simpleString() for c in rest}
    cell = (lambda c: _c(c)) if len(kinds) == 1 else (lambda c: _c(c).cast("string"))
    return df.select(*(_c(k) for k in keep), F.explode(F.array(*(F.struct(F.lit(c).alias(key), cell(c).alias(value)) for c in rest))).alias("__kv")).select(*(_c(k) for k in keep), f"__kv.`{key}`", f"__kv.`{value}`")


def h4v(df: DataFrame, key: str, value: str, ident: str | None = None) -> DataFrame:
    """(key, value) rows become columns; without an id, a key that comes again begins a new row."""
    names = _values(df, key)
    if ident:
        return df.groupBy(_c(ident)).pivot(key, names).agg(F.first(_c(value), ignorenulls=True))
    numbered = written(df.withColumn("__o", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__o", 33)), "numbered")
    # the k-th time a key comes it is the k-th row's: counted by partition first, so that no key is one task's work
    before = W.partitionBy(_c(key)).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    bases = numbered.groupBy(_c(key), "__p").agg(F.count(F.lit(1)).alias("__n")).select(_c(key).alias("__k"), F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy(_c(key), "__p").orderBy("__o")
    rows = numbered.join(bases, _c(key).eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__q"))).withColumn("__row", F.col("__base") + F.row_number().over(inside)).drop("__k", "__q", "__base", "__p")
    return rows.groupBy("__row").pivot(key, names).agg(F.first(_c(value), ignorenulls=True)).orderBy("__row").drop("__row")


def v2h(df: DataFrame, head: str, row: str, value: str | None = None) -> DataFrame:
    """One row for each ``row``, one column for each ``head``: numbers summed, others the last, without a value the count; 0 if missing."""
    names = _values(df, head)
    if value is None:
        agg = F.count(F.lit(1))
    elif isinstance(df.schema[value].dataType, T.NumericType):
        agg = F.sum(_c(value))
    else:
        agg = F.max_by(_c(value), F.col("__o"))
    out = df.withColumn("__o", F.monotonically_increasing_id()).groupBy(_c(row)).pivot(head, names).agg(agg)
    numeric = value is None or isinstance(df.schema[value].dataType, T.NumericType)
    return out.na.fill(0, names) if numeric else out.na.fill("0", names)


def h2v(df: DataFrame, head: str, row: str, value: str = "value") -> DataFrame:
    """One row for each cell beside the ``row`` column."""
    return v4h(df, head, value, row)


def uniqkv(df: DataFrame, key: str, head: str, value: str | None = None) -> DataFrame:
    """The first row of each key, and a column for each head with its value (the count without one)."""
    numbered = df.withColumn("__o", F.monotonically_increasing_id())
    others = [c for c in df.columns if c not in (key, head, value)]
    firsts = numbered.groupBy(_c(key)).agg(*(F.min_by(_c(c), "__o").alias(c) for c in others), F.min("__o").alias("__first"))
    agg = F.count(F.lit(1)) if value is None else F.max_by(_c(value), F.col("__o"))
    wide = numbered.groupBy(_c(key)).pivot(head, _values(df, head)).agg(agg)
    return firsts.join(wide, key).orderBy("__first").drop("__first")


TRANSFORMS: dict[str, Callable[..., DataFrame]] = {"v4h": v4h, "h4v": h4v, "v2h": v2h, "h2v": h2v, "uniqkv": uniqkv}
