"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of a fixed number of characters. Distinct blocks are sorted into integer names, then
adjacent names are paired and the distinct pairs named again, until each document has one integer: equal names and block
counts mean equal texts, without trust in any hash. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ruleframe.llm.common import Scratch, checked_broadcast

#: The white space that normalisation deletes: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def named(distinct: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """Gives each row of ``distinct`` an integer: its rank among the sorted keys of its hash bucket, interleaved by bucket.

    The integer depends on the keys alone, not on how rows are dealt to tasks, so a repeated task gives the same names.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets))
    rank = F.row_number().over(W.partitionBy("__bucket").orderBy(*key)).cast("long")
    return distinct.withColumn("__bucket", bucket).select(*key, (rank * buckets + F.col("__bucket")).alias("name"))


def blocks_of(docs: DataFrame, block_chars: int) -> DataFrame:
    """``docs(row, text)`` -> ``(row, blocks, pos, hash, block)``; an empty text is one empty block."""
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), 0)
    cut = docs.select("row", parts.alias("parts")).select("row", F.greatest(F.size("parts"), F.lit(1)).alias("blocks"), F.posexplode_outer("parts").alias("pos", "block"))
    return cut.select("row", "blocks", F.coalesce("pos", F.lit(0)).alias("pos"), F.xxhash64(F.coalesce("block", F.lit(""))).alias("hash"), F.coalesce("block", F.lit("")).alias("block"))


def name_blocks(docs: DataFrame, scratch: Scratch, block_chars: int, buckets: int) -> DataFrame:
    """``(row, blocks, pos, name)``. A block whose routing hash no other block has is named by that hash's rank, and its
    text stays where it is; blocks that share a hash are sorted, compared and named by their text."""
    light = scratch.keep(blocks_of(docs, block_chars).drop("block"), "blocks")
    counts = light.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    alone = named(counts.filter("n = 1").select("hash"), ["hash"], buckets)
    shared = scratch.keep(counts.filter("n > 1").select("hash"), "shared")
    texts = blocks_of(docs, block_chars).join(checked_broadcast(shared, shared.count()), "hash")
    names = named(texts.select("hash", "block").distinct(), ["hash", "block"], buckets)
    own = light.join(alone, "hash").select("row", "blocks", "pos", (F.col("name") * 2).alias("name"))
    return own.unionAll(texts.join(names, ["hash", "block"]).select("row", "blocks", "pos", (F.col("name") * 2 + 1).alias("name")))


def name_texts(docs: DataFrame, scratch: Scratch, block_chars: int = 4096, buckets: int = 4096) -> DataFrame:
    """``docs(row, text)`` -> ``(row, blocks, name)``, one row per distinct ``row``. Texts are equal when (blocks, name) are."""
    level = scratch.keep(name_blocks(docs, scratch, block_chars, buckets), "names-0")
    longest = level.agg(F.max("blocks")).first()[0] or 1
    done, step = [level.filter("blocks <= 1")], 0
    level = level.filter("blocks > 1")
    while 1 << step < longest:
        step += 1
        # at this level a document of b blocks has ceil(b / 2^step) names; a last one without partner pairs with -1
        left, right = (F.max(F.when(F.col("pos") % 2 == k, F.col("name"))) for k in (0, 1))
        pairs = level.groupBy("row", "blocks", F.shiftright("pos", 1).alias("pos")).agg(left.alias("left"), F.coalesce(right, F.lit(-1)).alias("right"))
        names = named(pairs.select("left", "right").distinct(), ["left", "right"], buckets)
        level = scratch.keep(pairs.join(names, ["left", "right"]).select("row", "blocks", "pos", "name"), f"names-{step}")
        done.append(level.filter(F.col("blocks") <= (1 << step)))
        level = level.filter(F.col("blocks") > (1 << step))
    out = done[0].dropDuplicates(["row"])
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select("row", "blocks", "name")


def exact_duplicates(docs: DataFrame, scratch: Scratch, block_chars: int = 4096) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after deleting ``SPACES``; a null text counts as empty and equals other empty ones.
    Of equal texts, the row with the most code points in the original text stays, then the smallest doc_id (nulls last).
    Rows that repeat both doc_id and text each count in the group size and share one ``kept`` value. No rows give no rows.
    Other columns of ``docs`` are not read. Texts may be of any length.
    """
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", F.length(text).alias("n"), without_spaces(text).alias("text"))
    # names this document among rows of the same doc_id; what is equal between documents is decided by names of blocks
    row = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    member = plain.select("doc_id", "n", row.alias("row"), F.sha2("text", 256).alias("text_sha256"))
    ids = name_texts(plain.select(row.alias("row"), "text"), scratch, block_chars)
    member = scratch.keep(member.join(ids, "row"), "members")
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id")
    groups = member.groupBy("blocks", "name").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    # stored, so that the join's shuffles are plain ones and Spark can split a partition that holds a large group
    out, alone = member.join(scratch.keep(groups, "groups"), ["blocks", "name"], "left"), F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (order == F.col("best"))).alias("kept"), "text_sha256")


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs, Scratch(spark, "op2"))
