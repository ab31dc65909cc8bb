"""Sharding with byte balance by Karmarkar-Karp differencing.

A group of equal texts is indivisible. Every group starts as a partial partition with its bytes in one part and nothing in
the others; the two partial partitions with the largest spread (largest part less smallest) are combined over and over,
the largest parts of one onto the smallest of the other. Differencing is done inside buckets of bounded size; each bucket
leaves one partial partition, and those are combined in the same way, level by level, until one is left.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.llm.common import Scratch, pieces, sum_before


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines the rows of ``parts`` (n, k) by largest differencing; ``(sums, places)`` with places[i, j]: the part of the
    result that part j of row i went to. Ties go by row number, so the result is fixed by the input's order."""
    n, k = parts.shape
    trees: list[tuple | int] = list(range(n))
    sums = [np.sort(p) for p in parts]
    orders = [np.argsort(p, kind="stable") for p in parts]
    heap = [(int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        mixed = sums[a] + sums[b][::-1]
        order = np.argsort(mixed, kind="stable")
        trees.append((a, b, order))
        sums.append(mixed[order])
        sums[a] = sums[b] = None
        heapq.heappush(heap, (int(sums[-1][0] - sums[-1][-1]), len(trees) - 1))
    root = heap[0][1]
    places, todo = np.empty((n, k), dtype=np.int32), [(root, np.arange(k, dtype=np.int32))]
    while todo:
        node, to = todo.pop()  # to[j]: where this node's j-th smallest part ends
        if node < n:
            places[node, orders[node]] = to
        else:
            a, b, order = trees[node]
            own = np.empty(k, dtype=np.int32)
            own[order] = to
            todo += [(a, own), (b, own[::-1])]
    return sums[root], places


def partition_groups(groups: DataFrame, shards: int, scratch: Scratch, bucket_groups: int = 2_000, fan: int = 256) -> DataFrame:
    """``groups(grp, bytes)`` -> ``(grp, shard)``. A task holds one bucket of about ``bucket_groups`` groups or ``fan`` partial partitions."""
    n = groups.count()
    buckets = max(1, -(-n // bucket_groups))
    names = [f"p{j}" for j in range(shards)]

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "grp"], ascending=[False, True], ignore_index=True)
        parts = np.zeros((len(pdf), shards), dtype=np.int64)
        parts[:, 0] = pdf["bytes"]
        sums, places = difference(parts)
        out = pd.DataFrame({"bucket": pdf["bucket"], "grp": pdf["grp"], "part": places[:, 0]})
        return out.assign(**{name: sums[j] for j, name in enumerate(names)})

    schema = "bucket long, grp string, part int, " + ", ".join(f"{x} long" for x in names)
    placed = groups.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("long")).groupBy("bucket").applyInPandas(first, schema)
    placed = scratch.keep(placed, "placed")
    level = placed.groupBy("bucket").agg(*(F.first(x).alias(x) for x in names))
    placed, step, count = placed.select("grp", "bucket", "part"), 0, buckets

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket", ignore_index=True)
        sums, places = difference(pdf[names].to_numpy(dtype=np.int64))
        out = pd.DataFrame({"bucket": np.repeat(pdf["bucket"].to_numpy(), shards), "part": np.tile(np.arange(shards, dtype=np.int32), len(pdf)), "next": np.repeat(pdf["next"].to_numpy(), shards), "place": places.ravel()})
        return out.assign(**{name: sums[j] for j, name in enumerate(names)})

    schema = "bucket long, part int, next long, place int, " + ", ".join(f"{x} long" for x in names)
    while count > 1:
        step, count = step + 1, -(-count // fan)
        moves = scratch.keep(level.withColumn("next", F.pmod("bucket", F.lit(count))).groupBy("next").applyInPandas(again, schema), f"moves-{step}")
        placed = placed.join(moves.select("bucket", "part", "next", "place"), ["bucket", "part"]).select("grp", F.col("next").alias("bucket"), F.col("place").alias("part"))
        level = moves.groupBy(F.col("next").alias("bucket")).agg(*(F.first(x).alias(x) for x in names))
    return placed.select("grp", F.col("part").alias("shard"))


def shard_by_bytes(docs: DataFrame, scratch: Scratch, shards: int = 16) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has no bytes, the size 1 and the checksum 0, and stands with
    empty texts. Equal texts (by SHA-256) share a shard, whatever their number; shards differ by as little as differencing
    leaves, or by what the largest group makes them. Slots count from 0 without gaps in each shard. Rows that repeat are
    rows of their own. No rows give no rows; columns of ``docs`` beside doc_id and text are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = scratch.keep(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("grp")), "rows")
    groups = scratch.keep(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "groups")
    placed = scratch.keep(rows.join(partition_groups(groups, shards, scratch), "grp"), "rows-placed")
    out = sum_before(placed, ["shard"], ["doc_id", "grp", "size"], F.lit(1), "slot", pieces(rows.count()))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return shard_by_bytes(docs, Scratch(spark, "op3"))
