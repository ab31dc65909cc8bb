"""Progress events and running metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def percent(current: Column, total: Column) -> Column:
    return F.when(total > 0, current * 100.0 / total).otherwise(0.0)


def throttled(events: DataFrame, every_ms: int = 500) -> DataFrame:
    """``events(key, ts, current, total)`` in batch: per key the first, the last of a count, and one at most every ``every_ms``.

    The state is the time last let through; a key's events stream past it in time order, so memory does not grow with them."""
    rows = events.select("key", "ts", "current", "total")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, last = False, None, None
        for batch in batches:
            keep = []
            columns = [batch.column(0), batch.column(1).cast(pa.int64()), batch.column(2), batch.column(3)]  # microseconds
            for key, now, current, total in zip(*(c.to_pylist() for c in columns), strict=True):
                if not begun or key != at:
                    begun, at, last = True, key, None
                passes = last is None or (current is not None and current == total) or (now is not None and now - last >= every_ms * 1000)
                last = now if passes else last
                keep.append(passes)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition("key").sortWithinPartitions("key", "ts", "current", "total").mapInArrow(run, rows.schema)


def throttle_stream(events: DataFrame, every_ms: int = 500) -> DataFrame:
    """The same on a stream, with the time last let through as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in batches:
            keep = []
            for row in pdf.sort_values("ts").itertuples():
                now = row.ts.value // 1000  # microseconds
                if last is None or row.current == row.total or now - last >= every_ms * 1000:
                    last = now
                    keep.append((key[0], row.ts, row.current, row.total))
            yield pd.DataFrame(keep, columns=["key", "ts", "current", "total"])
        if last is not None:
            state.update((last,))

    return events.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, current long, total long", "last long", "append", GroupStateTimeout.NoTimeout)


def metrics(events: DataFrame, keys: list[str], value: str, ts: str, bounds: list[float]) -> DataFrame:
    """Count, sum, latest value, and a cumulative histogram per label group; works on batches and, in update mode, on streams."""
    buckets = F.array(*(F.count_if(F.col(value) <= b) for b in bounds))
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max_by(value, ts).alias("latest"), buckets.alias("buckets"), F.min(value).alias("least"), F.max(value).alias("most"))


def escaped(value: Column) -> Column:
    """A label's value with back slashes, quotes and line feeds escaped."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def prometheus(rows: DataFrame, name: str, keys: list[str], value: str) -> DataFrame:
    """Metric rows in text exposition form."""
    labels = F.concat_ws(",", *(F.concat(F.lit(k + '="'), escaped(F.coalesce(F.col(k).cast("string"), F.lit(""))), F.lit('"')) for k in keys))
    return rows.select(F.concat(F.lit(name + "{"), labels, F.lit("} "), F.col(value).cast("string")).alias("line"))


def span_times(starts: DataFrame, ends: DataFrame, within: str = "1 hour") -> DataFrame:
    """``starts(span, parent, ts)`` and ``ends(span, ts)`` -> ``(span, parent, ms)``: a span's begin meets its end. On streams both
    sides need a watermark on ``ts``, which lets Spark drop a begin whose end is later than ``within``."""
    a, b = starts.select("span", "parent", F.col("ts").alias("begun")), ends.select(F.col("span").alias("ended_span"), F.col("ts").alias("ended"))
    on = (F.col("span") == F.col("ended_span")) & (F.col("ended") >= F.col("begun")) & (F.col("ended") <= F.col("begun") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).select("span", "parent", (F.unix_millis("ended") - F.unix_millis("begun")).alias("ms"))
