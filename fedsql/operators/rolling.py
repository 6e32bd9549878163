"""Totals and averages over trailing periods for every entity and day.

Daily totals come first, so a member with a third of all rows shrinks to one
row a day before anything is shuffled by member.  Each member's calendar is
joined to its daily totals by range: both sides carry coarse date buckets as
wide as the longest period, so a calendar day only meets the totals of its
own and the preceding bucket.  Buckets are joined whole, a bucket's totals as
one short array, and days are unrolled after the join, where each takes the
totals within its bounds: the calendar's days are never shuffled.

Defined results: a row without entity or day is left out; a null or NaN
amount counts zero but its day has activity; days before the first are zero;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Whole cents; null and NaN are zero."""
    return F.coalesce(F.round(F.nanvl(amount, F.lit(0.0)).try_cast("decimal(30,6)") * 100).cast("bigint"), F.lit(0))


def daily_totals(rows: DataFrame) -> DataFrame:
    """(entity, day, cents) -> one row for each entity and day with its total and number of rows."""
    return rows.filter("entity is not null and day is not null").groupBy("entity", "day").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n_rows"))


def trailing(daily: DataFrame, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Every entity and day from its first to last day of activity: ``active``, and ``sum_N`` (cents) for each of periods.

    ``daily`` has at most one row for each entity and day.
    """
    width = max(periods)
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    totals = daily.select("entity", number.alias("at"), "cents").withColumn("bucket", F.floor(F.col("at") / width))
    spans = totals.groupBy("entity").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    calendar = spans.select("entity", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("own"))
    # a total reaches days of its own bucket and of the next; an array has at most 2 * width totals
    reach = totals.select("entity", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("own"), F.struct("at", "cents").alias("total")).groupBy("entity", "own").agg(F.collect_list("total").alias("near"))
    # buckets are few and their days many: a number of tasks given keeps adaptive execution from putting all into one
    tasks = max(2 * daily.sparkSession.sparkContext.defaultParallelism, daily.count() // 2_000_000)
    days = (
        calendar.repartition(tasks, "entity", "own").join(reach.hint("merge"), ["entity", "own"], "left")
        .select("entity", F.coalesce("near", F.array().cast("array<struct<at: int, cents: bigint>>")).alias("near"),
                F.explode(F.sequence(F.greatest("lo", F.col("own") * width), F.least("hi", F.col("own") * width + (width - 1)))).alias("d"))
    )
    none = F.lit(0).cast("bigint")
    start = F.struct(F.lit(False).alias("active"), *(none.alias(f"sum_{p}") for p in periods))

    def step(have: Column, x: Column) -> Column:
        ago = F.col("d") - x["at"]
        return F.struct(
            (have["active"] | (ago == 0)).alias("active"),
            *((have[f"sum_{p}"] + F.when((ago >= 0) & (ago < p), x["cents"]).otherwise(none)).alias(f"sum_{p}") for p in periods),
        )

    within = F.when(F.size("near") == 0, start).otherwise(F.aggregate("near", start, step))
    return days.select("entity", F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int")).alias("day"), F.explode(F.array(within)).alias("t")).select("entity", "day", "t.*")
