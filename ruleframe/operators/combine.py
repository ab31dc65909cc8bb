"""Boolean combination and chaining of conditions.

``and`` and ``or`` keep the incidents of all their parts (a union, no intersection) behind a gate: every part, or any part,
must match. A part matches when it has incidents, or with ``negate`` when it has none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.operators.stored import stored


@dataclass(frozen=True)
class Part:
    incidents: DataFrame
    negate: bool = False
    ignore: bool = False  #: counts for the gate, gives no incidents


def combine(parts: list[Part], every: bool) -> DataFrame:
    """One flat condition for many rules at once. The gate is one aggregation per rule over the parts' incidents, joined back by rule;
    the parts are computed once. A rule without any incidents has none to show, whatever its gate says.

    Nested conditions go through :func:`matched`, which tells whether a part holds apart from its incidents."""
    if not parts:
        raise ValueError("a condition needs parts")
    tagged = stored(reduce(DataFrame.unionByName, [p.incidents.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)]), "parts")
    has: list[Column] = [F.max(F.col("__part") == k).alias(f"__has{k}") for k in range(len(parts))]
    flags = tagged.groupBy("rule_id").agg(*has)
    holds = [~F.col(f"__has{k}") if p.negate else F.col(f"__has{k}") for k, p in enumerate(parts)]
    held = flags.filter(reduce(lambda a, b: a & b if every else a | b, holds)).select("rule_id")
    shown = [k for k, p in enumerate(parts) if not p.ignore]
    return tagged.filter(F.col("__part").isin(shown)).drop("__part").join(held, "rule_id", "left_semi")


@dataclass
class Node:
    """A condition of a rule: ``op`` is and, or, or a search, which is known by its number ``leaf``."""

    op: str
    parts: list[Node]
    leaf: int = -1
    negate: bool = False


def matched(node: Node, present: set[int]) -> bool:
    """Whether a condition holds, given the searches that have incidents: a part that has none of its own to show still counts."""
    if node.op == "and":
        out = all([matched(x, present) for x in node.parts])
    elif node.op == "or":
        out = any([matched(x, present) for x in node.parts])
    else:
        out = node.leaf in present
    return out != node.negate


def only_files_of(files: DataFrame, producer: DataFrame) -> DataFrame:
    """The files that a condition before has found: the scan of the next condition in a chain."""
    return files.join(producer.select(F.col("uri").alias("path")).distinct(), "path", "left_semi")


def keep_paths(found: DataFrame, included: DataFrame | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Scopes: with ``included(path)``, only incidents of these files (those without a file go); incidents whose path a regex of
    ``excluded`` matches go; what is no regex is left out of account."""
    if included is not None:
        found = found.join(included.select(F.col("path").alias("uri")).distinct(), "uri", "left_semi").select(*found.columns)
    for pattern in filter(is_regex, excluded or []):
        found = found.filter(~F.coalesce(F.col("uri").rlike(pattern), F.lit(False)))
    return found


def is_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
