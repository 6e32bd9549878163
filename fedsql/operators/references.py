"""References to records that do not exist, from signed counts.

Changes are deltas of sign +1 and -1: a reference appears or goes, a target
comes to life or dies.  :class:`Ledger` adds deltas up to counts per table,
key and day; keys with positive references and zero existence are the current
orphans.  For references at their own time (:func:`orphans_at`) the ledger's
existence is carried forward over a key's days, and only days with positive
references on which existence is too little at some time go on; of these the
deltas of the reference's own day are looked at one by one.  A key with a
third of all references is spread over its days, all tables go through one
ledger at once, and no row's work grows with the key's number of lives.

Defined results: null keys and times make no reference; a life without a
beginning, or that ends no later than it begins, never covers a time, but its
target is known; copies of a life count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MOVES = "array<struct<ts: timestamp, sign: int>>"


class Ledger:
    """Counts per (table_name, key, day) that deltas are added to.

    ``refs`` and ``exist`` are signed sums of that day's deltas, ``targets`` the target rows that first show that day,
    ``moves`` the day's single changes of existence; changes without a time are under a null day, before all others.
    """

    def __init__(self, state: DataFrame | None = None) -> None:
        self.state = state

    def apply(self, references: DataFrame | None = None, existence: DataFrame | None = None) -> Ledger:
        """references: (table_name, key, ts, sign); existence: (table_name, key, ts, sign, targets)."""
        zero, group = F.lit(0).cast("bigint"), ("table_name", "key", "day")
        count = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
        none = F.array().cast(MOVES)
        parts = []
        if references is not None:  # added up by day before they meet the rest
            by_day = references.withColumn("day", F.to_date("ts")) if "day" not in references.columns else references
            parts.append(by_day.groupBy(*group).agg(F.sum(F.col("sign").cast("bigint")).alias("refs")).select(*group, "refs", zero.alias("exist"), zero.alias("targets"), none.alias("moves")))
        if existence is not None:
            moved = F.when(F.col("sign") != 0, F.array(F.struct("ts", F.col("sign").cast("int").alias("sign"))).cast(MOVES)).otherwise(none)
            parts.append(existence.select("table_name", "key", F.to_date("ts").alias("day"), zero.alias("refs"), F.col("sign").cast("bigint").alias("exist"), F.col("targets").cast("bigint").alias("targets"), moved.alias("moves")))
        if self.state is not None:
            parts.append(self.state)
        if not parts or (references is None and existence is None):
            return self
        # by key, which carrying over its days needs as well; a key has no more rows here than days and changes
        rows = reduce(DataFrame.unionByName, parts).repartition("table_name", "key")
        return Ledger(rows.groupBy(*group).agg(count("refs"), count("exist"), count("targets"), F.flatten(F.collect_list("moves")).alias("moves")))

    def orphans(self) -> DataFrame:
        """(table_name, period, key, refs): the references, by UTC month, of keys that have some and no existence now."""
        now = W.partitionBy("table_name", "key")
        return (
            self.state.withColumn("exists", F.sum("exist").over(now)).filter("exists <= 0").groupBy("table_name", F.date_format("day", "yyyy-MM").alias("period"), "key")
            .agg(F.sum("refs").alias("refs")).filter("refs > 0")
        )

    def orphan_days(self) -> DataFrame:
        """(table_name, key, day, carry, begun, known, moves) of days with positive references and existence too little at some time.

        ``carry`` is the existence the day begins with, ``begun`` whether a life began before, ``known`` whether any
        row of the target is there.
        """
        key = W.partitionBy("table_name", "key").orderBy(F.asc_nulls_first("day"))
        before = key.rowsBetween(W.unboundedPreceding, -1)
        births = F.exists("moves", lambda x: x["sign"] > 0)
        return (
            self.state.withColumn("carry", F.coalesce(F.sum("exist").over(before), F.lit(0)))
            .withColumn("begun", F.coalesce(F.max(births).over(before), F.lit(False)))
            .withColumn("known", F.sum("targets").over(key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) > 0)
            .filter("refs > 0").filter(least_existence(F.col("carry"), F.col("moves")) <= 0)
            .select("table_name", "key", "day", "carry", "begun", "known", "moves")
        )


def deltas_of_lives(lives: DataFrame, table_name: str, key: Column, begin: Column, end: Column) -> DataFrame:
    """(table_name, key, ts, sign, targets): +1 at a life's begin, -1 at its end; a life that covers no time changes nothing but is a target's row."""
    own = lives.select(key.alias("key"), begin.alias("begin"), end.alias("end")).filter("key is not null").distinct()
    lasts = F.col("begin").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("begin")))
    one, none = F.lit(1), F.lit(0)
    return own.select(F.lit(table_name).alias("table_name"), "key", F.inline(F.array_compact(F.array(
        F.struct(F.when(lasts, F.col("begin")).alias("ts"), F.when(lasts, one).otherwise(none).alias("sign"), one.alias("targets")),
        F.when(lasts & F.col("end").isNotNull(), F.struct(F.col("end").alias("ts"), F.lit(-1).alias("sign"), none.alias("targets"))),
    ))))


def least_existence(carry: Column, moves: Column) -> Column:
    """No more than the least count of existence within a day that begins with carry and has these moves(ts, sign)."""
    state = lambda n, least: F.struct(n.alias("n"), least.alias("least"))
    return F.aggregate(F.sort_array(moves), state(carry, carry), lambda s, x: state(s["n"] + x["sign"], F.least(s["least"], s["n"] + x["sign"])))["least"]


def orphans_at(references: DataFrame, existence: DataFrame) -> DataFrame:
    """Rows of references(table_name, row_id, key, ts; sign, if changes) whose key has no existence at ts, with ``reason``; equal rows are one.

    ``existence`` as of :func:`deltas_of_lives`.  The reason is ``missing`` without any row of the target, ``late`` if
    all lives begin later, else ``deleted``.
    """
    refs = references.filter("key is not null and ts is not null")
    # one shuffle by key and day for taking out copies, counting, and the join below
    refs = refs.withColumn("day", F.to_date("ts")).filter("day is not null and table_name is not null").repartition("table_name", "key", "day")
    if "sign" in refs.columns:  # a reference that went is none
        refs = refs.groupBy(*(c for c in refs.columns if c != "sign")).agg(F.sum("sign").alias("sign")).filter("sign > 0")
    else:
        refs = refs.distinct().withColumn("sign", F.lit(1))
    days = Ledger().apply(refs, existence).orphan_days()
    at = refs.join(days, ["table_name", "key", "day"])
    alive = F.col("carry") + F.aggregate("moves", F.lit(0).cast("bigint"), lambda n, x: n + F.when(x["ts"] <= F.col("ts"), x["sign"]).otherwise(0))
    begun = F.col("begun") | F.exists("moves", lambda x: (x["sign"] > 0) & (x["ts"] <= F.col("ts")))
    return (
        at.withColumn("alive", alive).filter("alive <= 0")
        .withColumn("reason", F.when(~F.col("known"), "missing").when(~begun, "late").otherwise("deleted"))
        .drop("day", "sign", "carry", "known", "begun", "moves", "alive")
    )
