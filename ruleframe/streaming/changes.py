"""File changes as a stream: overlays over a base table, and re-evaluation of changed files only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGE = "path string, content string, saved boolean, seq long"


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path."""
    return changes.groupBy("path").agg(F.max_by(F.struct("content", "saved", "seq"), "seq").alias("c")).select("path", "c.content", "c.saved", "c.seq")


def overlay(base: DataFrame, changes: DataFrame) -> DataFrame:
    """``base(path, content)`` as its reader sees it: unsaved content hides the file's own, a saved change shows the file."""
    working = latest(changes).filter("not saved").select("path", "content")
    return base.select("path", "content").join(working.select("path"), "path", "left_anti").unionByName(working)


def refresh(incidents: DataFrame, changes: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Incidents after ``changes``: those of changed files are dropped, and only these files are searched again."""
    now = latest(changes)
    again = evaluate(now.select("path", "content"))
    return incidents.join(now.select(F.col("path").alias("uri")), "uri", "left_anti").select(*incidents.columns).unionByName(again)


def keep_fresh(stream: DataFrame, store: str, evaluate: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Starts a query that keeps incidents in Parquet versions below ``store``: batch n writes ``store/n``, the last is current.

    A repeated batch writes the same version again, so a restart loses and doubles nothing."""

    def batch(changes: DataFrame, n: int) -> None:
        spark = changes.sparkSession
        before = spark.read.parquet(f"{store}/{n - 1}") if n else evaluate(changes.select("path", "content").limit(0))
        refresh(before, changes, evaluate).write.mode("overwrite").parquet(f"{store}/{n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
