"""The corpus pipeline: documents to packed training sequences, in stages that are written and read again one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleframe.llm import packing
from ruleframe.llm.common import Scratch, table
from ruleframe.llm.language_id import language_stage
from ruleframe.llm.line_dedup import line_stage
from ruleframe.llm.mixing import mixing_stage
from ruleframe.llm.shingle_join import near_stage


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op6(spark, docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("shingle_join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Neither the language models nor the least squares of the packing stage can be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
