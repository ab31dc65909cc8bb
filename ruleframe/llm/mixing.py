"""Mixing sources by temperature.

Source shares of the tokens are raised to an exponent, found by bisection so that the weights meet a target entropy or no
source is repeated more often than a limit. The weights are realised in tokens: every source is read in epochs, each a
permutation of its documents, up to its budget, and dealt evenly over blocks that each hold all sources by weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ruleframe.llm.common import Scratch


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens) or 1
    raised = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [x / (sum(raised) or 1.0) for x in raised]


def entropy(shares: list[float]) -> float:
    return -sum(x * math.log2(x) for x in shares if x > 0)


def spread(tokens: list[int], shares: list[float]) -> float:
    """How many times more often the most repeated source is read than the least repeated one."""
    rates = [w / t for w, t in zip(shares, tokens, strict=True) if t]
    return max(rates, default=1.0) / min(rates, default=1.0)


def bisect(holds: Callable[[float], bool], steps: int = 60) -> float:
    """The smallest exponent in [0, 1] for which ``holds``; it holds for 1 and, with an exponent, for all larger ones."""
    if holds(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def find_exponent(tokens: list[int], repeats: float | None = None, bits: float | None = None, budget: int | None = None) -> float:
    """The flattest mixture within ``repeats`` (readings of any source; without a budget every document is read once at
    least), or the exponent whose weights have ``bits`` of entropy, whichever is nearer to the sources' own shares."""
    out = 0.0
    if repeats is not None:
        rate = (lambda a: max((w * budget / t for w, t in zip(weights(tokens, a), tokens, strict=True) if t), default=0.0)) if budget else lambda a: spread(tokens, weights(tokens, a))
        out = bisect(lambda a: rate(a) <= repeats * (1 + 1e-12))
    if bits is not None:
        out = max(out, bisect(lambda a: entropy(weights(tokens, a)) <= bits))
    return out


def draw(docs: DataFrame, tokens: Column, scratch: Scratch, repeats: float | None = 2.0, bits: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 17) -> DataFrame:
    """``docs`` with a row for every time that a document is read, and ``__tokens, __epoch, __block``.

    ``budget``: tokens to read; None reads as much as leaves no source short of one full epoch, so that no document is left
    out. A source's last epoch ends with the document that reaches its budget. A null source is the source "". Documents of no
    tokens are read in full epochs only. The permutation of an epoch is by md5 of seed, epoch and doc_id; equal doc_ids follow by tokens.
    ``docs`` is read several times: pass a stored table.
    """
    rows = docs.withColumn("__source", F.coalesce("source", F.lit(""))).withColumn("__tokens", tokens.cast("long"))
    sizes = rows.groupBy("__source").agg(F.sum("__tokens").alias("t")).orderBy("__source").collect()  # a row for each source
    counts = [r["t"] for r in sizes]
    shares = weights(counts, find_exponent(counts, repeats, bits, budget))
    whole = budget or max((t / w for t, w in zip(counts, shares, strict=True) if t), default=0.0)
    goal = [math.floor(w * whole + 0.5) for w in shares]
    blocks = max(1, -(-sum(goal) // block_tokens))
    spark = docs.sparkSession
    plan = [(r["__source"], r["t"], g, max(1, -(-g // r["t"])) if r["t"] else 1) for r, g in zip(sizes, goal, strict=True)]
    plan = F.broadcast(spark.createDataFrame(plan or [("", 0, 0, 1)], "__source string, __all long, __goal long, __epochs long"))
    read = rows.join(plan, "__source").withColumn("__epoch", F.explode(F.sequence(F.lit(0), (F.col("__epochs") - 1).cast("int"))))
    name = F.concat(F.lit(f"{seed}/"), F.col("__epoch").cast("string"), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    read = read.withColumn("__place", F.md5(name)).withColumn("__chunk", F.substring("__place", 1, 3))
    # tokens read before: by chunk of the permutation first, then inside the chunk, so that no source lies in one task
    chunks = read.groupBy("__source", "__epoch", "__chunk").agg(F.sum("__tokens").alias("n"))
    before = W.partitionBy("__source", "__epoch").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("__source", "__epoch", "__chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    own = W.partitionBy("__source", "__epoch", "__chunk").orderBy("__place", "doc_id", "__tokens").rowsBetween(W.unboundedPreceding, -1)
    read = read.join(chunks, ["__source", "__epoch", "__chunk"])
    read = read.withColumn("__at", F.col("__epoch") * F.col("__all") + F.col("__start") + F.coalesce(F.sum("__tokens").over(own), F.lit(0)))
    read = read.filter((F.col("__at") < F.col("__goal")) | ((F.col("__epoch") + 1) * F.col("__all") <= F.col("__goal")))
    block = F.least(F.floor(F.col("__at").cast("double") / F.greatest("__goal", F.lit(1)).cast("double") * F.lit(float(blocks))), F.lit(blocks - 1)).cast("long")
    return read.withColumn("__block", block)


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per reading: ``doc_id, source, n_tokens, epoch, block, slot``; slots count from 0 in each block, in md5 order."""
    scratch = Scratch(spark, "op4")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = scratch.keep(docs.select("doc_id", "source", words.alias("words")), "rows")
    read = draw(rows, F.col("words"), scratch)
    slot = F.row_number().over(W.partitionBy("__block").orderBy(F.md5(F.concat(F.lit("b/"), F.col("__place"))), "doc_id", "__tokens")) - 1  # a block has a bounded number of tokens
    return read.select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.col("__epoch").cast("long").alias("epoch"), F.col("__block").alias("block"), slot.cast("long").alias("slot"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with small sources read up to twice; every document is read once at least."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return draw(docs, words, Scratch(spark, "mixing-stage")).select(*docs.columns)
