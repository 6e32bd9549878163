"""Queries over streams: windows over event time, late rows, keyed state, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).format(kind).load(path)


def tumbling(df: DataFrame, at: str, size: str, keys: list[str], aggregates: list[Column], late: str = "0 seconds") -> DataFrame:
    """Aggregates by window and keys; rows later than ``late`` behind the watermark are dropped by a stream."""
    return _windowed(df, F.window(at, size), at, keys, aggregates, late)


def sliding(df: DataFrame, at: str, size: str, step: str, keys: list[str], aggregates: list[Column], late: str = "0 seconds") -> DataFrame:
    return _windowed(df, F.window(at, size, step), at, keys, aggregates, late)


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], aggregates: list[Column], late: str = "0 seconds") -> DataFrame:
    return _windowed(df, F.session_window(at, gap), at, keys, aggregates, late)


def _windowed(df: DataFrame, window: Column, at: str, keys: list[str], aggregates: list[Column], late: str) -> DataFrame:
    marked = df.withWatermark(at, late) if df.isStreaming else df
    grouped = marked.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *(F.col(f"`{c}`") for c in grouped.columns if c not in ("w", *keys)))


def joined(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, within: str, late: str = "0 seconds", how: str = "inner") -> DataFrame:
    """Rows of two streams with equal keys whose times are at most ``within`` apart; both sides' state is kept no longer than that and ``late``.

    The columns are the left side's, then the right side's, keys and times once for each side as ``right_<name>``.
    """
    renamed = {c: f"right_{c}" for c in right.columns if c in left.columns}
    a = left.withWatermark(left_at, late) if left.isStreaming else left
    b = (right.withWatermark(right_at, late) if right.isStreaming else right).withColumnsRenamed(renamed)
    at = renamed.get(right_at, right_at)
    span = F.expr(f"INTERVAL {within}")
    on = (F.col(at) >= F.col(left_at) - span) & (F.col(at) <= F.col(left_at) + span)
    for k in keys:
        on = on & (a[k] == b[renamed.get(k, k)])
    return a.join(b, on, how)


def running(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) of every key so far, kept as state between batches."""
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, total double", "n bigint, total double", "update", "NoTimeout")


def into_table(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Each batch goes to ``sink`` once, however often it is tried, as long as the sink goes by the batch's number.

    ``checkpoint``: the query's own folder in shared storage; started again with it, the query goes on where it was.
    """
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
