"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

A window on a plain projection catches a fixed share of all pairs, however many vectors there are, so each list is first cut
into cells by the signs of a few further projections; the cells' number grows with the vectors. In its cell a vector is a
query: those whose projection lies within a window around its own collide with it. Collisions of a pair are counted over all
lists, and pairs that reach the count calibrated for the wanted recall are verified by exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.llm.common import Scratch, components, tidy


@dataclass(frozen=True)
class Lists:
    """``lists`` projections with ``signs`` cell bits each; a pair needs ``least`` collisions within ``width``."""

    lists: int
    signs: int
    width: float
    least: int
    seed: int = 7

    def directions(self, dims: int) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.lists * (self.signs + 1), dims))

    def project(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, places), each (n, lists)."""
        p = (unit @ self.directions(unit.shape[1]).T).reshape(len(unit), self.lists, self.signs + 1)
        return (p[:, :, 1:] > 0) @ (1 << np.arange(self.signs, dtype=np.int64)), p[:, :, 0]


def calibrate(vectors: int, cosine: float, recall: float, cell_size: int = 48, reach: float = 2.2) -> Lists:
    """Signs so that a cell holds about ``cell_size`` vectors; the fewest lists for which a pair at exactly ``cosine`` collides
    twice with probability ``recall``. ``reach``: the window in standard deviations of such a pair's projection difference."""
    signs = max(2, round(math.log2(max(vectors, 1) / cell_size + 1)))
    p = (1 - math.acos(cosine) / math.pi) ** signs * math.erf(reach / math.sqrt(2))
    lists = 2
    while 1 - (1 - p) ** lists - lists * p * (1 - p) ** (lists - 1) < recall:
        lists += 1
    return Lists(lists, signs, reach * math.sqrt(2 - 2 * cosine), 2)


def merged(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``group`` (for each place the first place of its group) after all pairs ``a, b`` have been joined."""
    group = group.copy()
    while len(a):
        x, y = group[a], group[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(group, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(group, above := group[group]):
            group = above
    return group


def links_of_cells(rows: DataFrame, lists: Lists, cosine: float) -> DataFrame:
    """``rows(list, cell, half, side, id, size, vector)`` sorted by ``list, cell, half`` within partitions ->
    ``(id, root, links)``: for each vector and cell, the smallest id that the cell's links reach from it, and the weight of its
    links; both of the links that no earlier list has found."""

    def block(ids: np.ndarray, sizes: np.ndarray, sides: np.ndarray, x: np.ndarray, which: int, cross: bool) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt((x * x).sum(1))
        unit = x / norm[:, None]
        cells, places = lists.project(unit)
        order = np.argsort(places[:, which], kind="stable")
        ids, sizes, sides, unit, cells, places, x, norm = (v[order] for v in (ids, sizes, sides, unit, cells, places, x, norm))
        at = places[:, which]
        ends = np.searchsorted(at, at + lists.width, side="right")
        links, group = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        step = max(1, 200_000 // max(1, len(ids)))
        for lo in range(0, len(ids), step):
            hi = min(len(ids), lo + step)
            a, b = np.nonzero((np.arange(len(ids))[None, :] > np.arange(lo, hi)[:, None]) & (np.arange(len(ids))[None, :] < ends[lo:hi, None]))
            a += lo
            if cross:
                a, b = (v[sides[a] != sides[b]] for v in (a, b))
            if not len(a):
                continue
            hit = (cells[a] == cells[b]) & (np.abs(places[a] - places[b]) <= lists.width)
            good = (hit.sum(1) >= lists.least) & (hit.argmax(1) == which)  # counted over all lists; reported by the first only
            a, b = a[good], b[good]
            near = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= cosine
            a, b = a[near], b[near]
            np.add.at(links, a, sizes[b])
            np.add.at(links, b, sizes[a])
            group = merged(group, a, b)
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, group, ids)
        return np.stack([ids, root[group], links])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key = None

        def flush() -> list:
            if not held or sum(len(h[0]) for h in held) < 2:
                return []
            ids, sizes, sides, x = (np.concatenate([h[k] for h in held]) for k in range(4))
            out = block(ids, sizes, sides, x, key[0], key[3])
            return [out[:, (out[2] > 0)]]

        names = ["id", "root", "links"]
        for batch in batches:
            table = {n: batch.column(n) for n in batch.schema.names}
            keys = np.stack([table[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("list", "cell", "half", "cross")])
            x = table["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            ids, sizes, sides = (table[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("id", "size", "side"))
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), len(batch)]
            done = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if key != (now := tuple(keys[:, lo].tolist())):
                    done += flush()
                    held, key = [], now
                held.append((ids[lo:hi], sizes[lo:hi], sides[lo:hi], x[lo:hi]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in np.concatenate(done, axis=1)], names=names)
        if last := flush():
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in last[0]], names=names)

    return rows.mapInArrow(tidy(run), "id long, root long, links long")


#: Lengths of vectors in one table: models have one, tables of several models a few.
MOST_LENGTHS = 64


def lengths_of(rows: DataFrame) -> list[int]:
    """The lengths that occur, each of which is a set of its own; beyond ``MOST_LENGTHS`` it is an error rather than a result without some."""
    out = [r["d"] for r in rows.filter("embedding is not null").select(F.size("embedding").alias("d")).distinct().orderBy("d").limit(MOST_LENGTHS + 1).collect()]
    if len(out) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    return out


def near_of_length(usable: DataFrame, scratch: Scratch, cosine: float, recall: float, block_rows: int) -> DataFrame:
    """``(vec_id, n_links, component_id)`` of vectors of one length without nulls."""
    same = scratch.keep(usable.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size")), "classes")
    lists = calibrate(same.count(), cosine, recall)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            cells, _ = lists.project(x / np.sqrt((x * x).sum(1))[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), lists.lists).cast(pa.list_(pa.int64()))], names=["id", "cells"])

    cells = same.select("id", "size", "embedding").mapInArrow(tidy(spread), "id long, cells array<long>")
    cells = scratch.keep(cells.select("id", F.posexplode("cells").alias("list", "cell")), "cells")
    full = cells.groupBy("list", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a cell beyond a block is compared block by block: each vector goes to the pairs of its own block with every other
    placed = cells.join(full, ["list", "cell"]).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    half = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    placed = placed.select("list", "cell", half.alias("half"), (F.col("own") != F.col("other")).alias("cross"), F.col("own").alias("side"), "id")
    payload = placed.join(same.select("id", "size", F.col("embedding").alias("vector")), "id").select("list", "cell", "half", "cross", "side", "id", "size", "vector")
    dealt = payload.repartition("list", "cell", "half").sortWithinPartitions("list", "cell", "half")
    found = scratch.keep(links_of_cells(dealt, lists, cosine), "links")
    near = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")), scratch, "components")
    known = same.join(near, "id", "left").join(groups, "id", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return usable.join(known, "embedding").select("vec_id", "n_links", "component_id")


def near_vectors(vectors: DataFrame, scratch: Scratch, cosine: float = 0.95, recall: float = 0.97, block_rows: int = 1_000) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Two vectors link when their cosine in double precision is at least ``cosine`` and their pair is found; a pair at exactly
    ``cosine`` is found with probability ``recall`` or more, a closer one nearly always. Equal arrays stand for one another
    and always link. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of
    different lengths do not link. Rows with a null vec_id link with nothing. No rows give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = scratch.keep(vectors.select("vec_id", F.when(good, F.col("embedding")).alias("embedding")), "rows")
    found = [near_of_length(rows.filter(F.size("embedding") == d), Scratch(spark, f"{scratch.label}-{d}"), cosine, recall, block_rows) for d in lengths_of(rows)]
    alone = rows.filter("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = reduce(DataFrame.unionAll, [*found, alone])
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors, Scratch(spark, "op5"))
