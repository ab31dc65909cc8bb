"""Dependency lists and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleframe.functions.text import java
from ruleframe.operators.stored import stored


def distinct_dependencies(deps: DataFrame) -> DataFrame:
    """One row per (file, name, version, resolved id); a direct dependency wins over an indirect one."""
    return deps.groupBy("file_uri", "name", "version", "resolved_id").agg(F.min("indirect").alias("indirect"))


def flatten(spark, edges: DataFrame, roots: DataFrame, most_depth: int = 100) -> DataFrame:
    """``(root, node, depth, paths)``: every node down a dependency graph, with the number of paths of that many steps to it. A path
    of more than ``most_depth`` steps, as in a graph with a cycle, is an error.

    Paths are counted step by step and never listed, so a step has a row for each root and node at most, however many paths there are."""
    edges = stored(edges.select("parent", "child"), "edges")
    level = stored(roots.groupBy(F.col("node").alias("root"), "node").agg(F.count(F.lit(1)).alias("paths")), "paths")
    levels, depth = [level], 0
    while not level.isEmpty():
        if depth > most_depth:
            raise ValueError(f"a path is longer than {most_depth} steps")
        depth += 1
        below = level.join(edges, F.col("node") == F.col("parent")).groupBy("root", F.col("child").alias("node"))
        level = stored(below.agg(F.sum("paths").alias("paths")), "paths")
        levels.append(level)
    return reduce(DataFrame.unionAll, [x.select("root", "node", F.lit(d).alias("depth"), "paths") for d, x in enumerate(levels)])


def two_levels(edges: DataFrame, root: str) -> DataFrame:
    """``(direct, indirect)``: what the root names, with what each of these names (a sorted list)."""
    direct = edges.filter(F.col("parent") == root).select(F.col("child").alias("direct")).distinct()
    below = edges.select(F.col("parent").alias("direct"), "child").distinct()
    return direct.join(below, "direct", "left").groupBy("direct").agg(F.sort_array(F.collect_list("child")).alias("indirect"))


def labelled(deps: DataFrame, patterns: dict[str, str], open_source: str = "open-source", internal: str = "internal") -> DataFrame:
    """Adds ``labels``: those of all patterns that a dependency's name matches, and ``internal`` where no open-source one does.

    Patterns are rules: they are compiled into one expression, and no join is needed."""
    hits = F.array(*(F.when(F.col("name").rlike(java(p)), F.lit(label)) for p, label in patterns.items()))
    hits = F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))
    return deps.withColumn("labels", F.array_sort(F.when(F.array_contains(hits, open_source), hits).otherwise(F.array_append(hits, internal))))


def of_selected(found: DataFrame, selected: DataFrame) -> DataFrame:
    """Incidents in dependency files pass only if a selected dependency's ``prefix`` begins their URI; others always pass.

    Prefixes end on a path boundary, so the join is by hash on the URI's own leading paths and needs no nested loop."""
    parts = F.split("uri", "/")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    marked = found.withColumn("__id", F.xxhash64("rule_id", "uri", "line_no", F.to_json("variables")))
    hit = marked.filter("is_dep").select("__id", F.explode(leads).alias("prefix")).join(selected.select(F.rtrim(F.col("prefix"), F.lit("/")).alias("prefix")).distinct(), "prefix", "left_semi")
    kept = marked.filter("is_dep").join(hit.select("__id").distinct(), "__id", "left_semi")
    return marked.filter("not is_dep").unionByName(kept).drop("__id")


def locations(lines: DataFrame) -> DataFrame:
    """``(path, name, line_no)`` of group and artifact elements on neighbouring lines."""
    from pyspark.sql.window import Window as W

    order = W.partitionBy("path").orderBy("line_no")
    tag = lambda x, c: F.regexp_extract(c, rf"<{x}>\s*([^<\s]+)\s*</{x}>", 1)
    near = lines.withColumn("next", F.concat_ws("\n", F.lead("line").over(order), F.lead("line", 2).over(order)))
    found = near.select("path", "line_no", tag("groupId", "line").alias("g"), tag("artifactId", "next").alias("a")).filter("g <> '' and a <> ''")
    return found.select("path", F.concat_ws(".", "g", "a").alias("name"), "line_no")


def sha_lookup(jars: DataFrame, index: DataFrame) -> DataFrame:
    """Coordinates by SHA-1 of content, else from the embedded properties, else a made-up coordinate."""
    hashed = jars.withColumn("sha1", F.sha1("content"))
    found = hashed.join(index.select("sha1", F.col("gav").alias("by_sha")), "sha1", "left")
    return found.withColumn("gav", F.coalesce("by_sha", "embedded", F.concat(F.lit("unknown:"), F.col("file_name"), F.lit(":0.0.0-SNAPSHOT")))).drop("by_sha")
