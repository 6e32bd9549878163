"""The N best rows of every group.

1. Each partition sorts its rows by group and score (Spark's sort, which
   spills) and keeps its own N best of each group: no other row can be among
   the group's N best.  They are written to the shared folder, once.
2. Where a partition has N rows of a group, its N-th best is a lower bound for
   the whole group's.  The greatest bound of each group that came from more
   than one partition is joined to the kept rows, and rows below it go.
3. The survivors are ranked.

A group that p partitions have rows of sends up to p * N rows, so bounds pay for
groups of many partitions.  Those of the groups with the most partitions,
:data:`MOST_BROADCAST` of them at most (counted before), are broadcast, and
their rows go before anything is shuffled; the other groups' rows are fewer
and are ranked as they are, with the same result.  A group with a third of all
rows sends about N rows in all.

Order: score from high to low, ties by the smaller id.  Rows with one group
and id are copies and count once (with unlike scores the best counts).  Scores
are compared in their own type.  Null groups, ids and scores and NaN scores are
left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from fedsql.session import written

#: Bounds sent to every executor at most: rows of a group, a score and an id, some 3 MB.
MOST_BROADCAST = 50_000


def _ranked(n: int):  # noqa: ANN202
    """Keeps the first n unlike ids of each run of one group, in sorted rows (g, id, score); adds their rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, []  # the group that the batch before ended in, and its ids so far
        for b in batches:
            if not b.num_rows:
                continue
            g, i = b.column("g").to_numpy(), b.column("id").to_numpy()
            fresh = np.r_[True, g[1:] != g[:-1]]
            first = np.flatnonzero(fresh)
            run_no = np.cumsum(fresh) - 1
            # the first time an id comes in its run
            order = np.lexsort((np.arange(len(i)), i, run_no))
            again = np.zeros(len(i), bool)
            again[order[1:]] = (run_no[order[1:]] == run_no[order[:-1]]) & (i[order[1:]] == i[order[:-1]])
            known = len(ids) if last is not None and g[0] == last else 0
            if known:
                head = first[1] if len(first) > 1 else len(g)
                again[:head] |= np.isin(i[:head], ids)
            count = np.cumsum(~again)
            rank = count - np.where(first > 0, count[first - 1], 0)[run_no]
            rank[run_no == 0] += known
            keep = ~again & (rank <= n)
            start = first[-1]
            ids = ([*ids] if known and start == 0 else []) + i[start:][keep[start:]].tolist()
            last = g[-1]
            at = np.flatnonzero(keep)
            if len(at):
                out = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rank[at].astype(np.int32))], names=[*out.schema.names, "rank"])

    return run


def local_best(rows: DataFrame, n: int) -> DataFrame:
    """(g, id, score, rank): each partition's n best rows of each group in rows(g, id, score)."""
    ordered = rows.sortWithinPartitions("g", F.desc("score"), "id")
    schema = T.StructType([*rows.schema.fields, T.StructField("rank", T.IntegerType())])
    return ordered.mapInArrow(_ranked(n), schema)


def bounds(kept: DataFrame, n: int) -> DataFrame:
    """(g, bound, partitions): the greatest n-th best (score, id) of a partition, for groups that several partitions have rows of."""
    # ~id turns the order of ids around without leaving their range
    own = F.when(F.col("rank") == n, F.struct("score", F.bitwise_not("id").alias("turned")))
    return kept.groupBy("g").agg(F.max(own).alias("bound"), F.count(F.when(F.col("rank") == 1, True)).alias("partitions")).filter("partitions > 1 and bound is not null")


def widest(least: DataFrame, most: int) -> DataFrame | None:
    """(g, bound) of the groups with the most partitions, at most ``most``; None if there are none or more are alike."""
    power = F.floor(F.log2(F.col("partitions").cast("double"))).cast("int")
    wide, at = 0, None
    for r in least.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():  # one row for each power of two
        wide += r["count"]
        if wide > most:
            break
        at = r.power
    return None if at is None else least.filter(F.col("partitions") >= 2**at).select("g", "bound")


def top_n(df: DataFrame, group: Column, score: Column, ident: Column, n: int) -> DataFrame:
    """(group_id, rank_no, row_id, score) of ranks 1 to n in each group; group and id are integers, score a number."""
    if n < 1:
        raise ValueError("n must be positive")
    rows = df.select(group.cast("bigint").alias("g"), ident.cast("bigint").alias("id"), score.alias("score"))
    if not isinstance(rows.schema["score"].dataType, T.NumericType):
        rows = rows.withColumn("score", F.col("score").try_cast("double"))
    rows = rows.filter("g is not null and id is not null and score is not null")
    if isinstance(rows.schema["score"].dataType, (T.DoubleType, T.FloatType)):
        rows = rows.filter("not isnan(score)")
    kept = written(local_best(rows, n), "best")
    least = widest(written(bounds(kept, n), "bounds"), MOST_BROADCAST)
    alive = kept
    if least is not None:
        alive = kept.join(F.broadcast(least), "g", "left").filter(F.col("bound").isNull() | (F.struct("score", F.bitwise_not("id").alias("turned")) >= F.col("bound")))
    order = W.partitionBy("g").orderBy(F.desc("score"), F.asc("id"))
    best = alive.select("g", "id", "score").repartition("g").groupBy("g", "id").agg(F.max("score").alias("score"))  # copies in several partitions
    return best.withColumn("rank_no", F.row_number().over(order).cast("bigint")).filter(F.col("rank_no") <= n).select(F.col("g").alias("group_id"), "rank_no", F.col("id").alias("row_id"), "score")
