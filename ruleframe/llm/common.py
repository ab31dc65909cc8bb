"""Shared helpers: shared-folder tables, prefix sums without hot tasks, connected components."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows that may be broadcast as a filter or map of a few longs each (about 16 MB); beyond it joins shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to a Python worker at once. Texts can be long, and Spark's own 10,000 rows of them are held three times: by the JVM, in
#: Arrow's buffers and by the worker.
BATCH_ROWS = 2_000
#: Bytes of such a batch, or one longer row; Spark's own bound is 64 MB.
BATCH_BYTES = 4_000_000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes per Arrow batch to ``BATCH_ROWS`` and ``BATCH_BYTES``; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Scratch:
    """Tables in the folder that the cluster shares (``spark.checkpoint.dir``): they cut lineage and survive lost executors.

    Where that is unset, tables go below the warehouse, which a cluster shares as well; never to a folder of the driver's own."""

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ruleframe-stages"
        self.spark, self.label, self.dir = spark, label, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.dir}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later result reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on after a task, and the next one may need other tables."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable:
    """``run`` for ``mapInArrow`` whose memory goes back to the system when the task ends. Before it starts, what the worker holds by
    ``worker_cache`` for tasks of other kinds goes, all but ``keeps``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            held = worker_held()
            for name in held.keys() - {keeps}:
                del held[name]
            yield from run(batches)
        finally:
            give_back()

    return task


def worker_held() -> dict[str, object]:
    """What this Python worker keeps between tasks, by name."""
    module = sys.modules.setdefault("ruleframe_worker_cache", types.ModuleType("ruleframe_worker_cache"))
    return module.__dict__.setdefault("held", {})


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps for its tasks, till ``tidy`` starts one of another kind."""
    held = worker_held()
    if name not in held:
        held[name] = make()
    return held[name]


def text_slices(texts: pa.Array, most_bytes: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of up to ``most_bytes`` bytes, or of one longer text."""
    sizes, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most_bytes, side="right")))
        yield lo, hi
        lo = hi


def in_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of ``column`` have up to ``most_bytes`` bytes, or are one longer text."""
    for batch in batches:
        for lo, hi in text_slices(batch.column(column), most_bytes):
            yield batch.slice(lo, hi - lo)


def pieces(rows: int, each: int = 20_000, least: int = 64) -> int:
    return max(least, -(-rows // each))


def sum_before(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, chunks: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows that stand before a row inside its key.

    The order inside a key is by hash of ``order``, then ``order``. A key's rows are dealt to ``chunks`` by that hash,
    so a key that holds most rows is still spread; only one row per key and chunk meets in a window per key.
    ``keys`` hold no nulls. ``df`` is read twice: pass a stored table.
    """
    dealt = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int")).withColumn("__value", value.cast("long"))
    totals = dealt.groupBy(*keys, "__chunk").agg(F.sum("__value").alias("__total"))
    ahead = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*keys, "__chunk", F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__start"))
    own = W.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = dealt.join(starts, [*keys, "__chunk"])
    return joined.withColumn(out, F.col("__start") + F.coalesce(F.sum("__value").over(own), F.lit(0))).drop("__chunk", "__value", "__start")


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """``(id, component)``: the smallest id that each node of ``edges(src, dst)`` reaches.

    Alternates large-star and small-star steps, each a min-aggregation and a join of edge rows, until the edge set stays.
    Every step's edges are stored, so nothing is collected and a lost executor repeats one step only.
    """
    flat = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    flat = scratch.keep(flat, f"{name}-0")
    state = None
    for step in range(1, rounds):
        # large star: every neighbour above the node goes to the smallest id around the node
        both = flat.unionAll(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: the node and its neighbours below go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        flat = scratch.keep(small, f"{name}-{step}")
        now = flat.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return flat.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(flat.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
