"""Dependency listings as tables: coordinates, trees, module graphs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def maven_coordinate(text: Column) -> Column:
    """``group:artifact:type[:classifier]:version[:scope]`` -> name, version, classifier, type; three parts have no version."""
    parts = F.split(text, ":")
    n = F.size(parts)
    return F.struct(
        F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("name"),
        F.when(n == 6, F.get(parts, F.lit(4))).when(n >= 4, F.get(parts, F.lit(3))).otherwise("Unknown").alias("version"),
        F.when(n == 6, F.get(parts, F.lit(3))).otherwise("").alias("classifier"),
        F.when(n >= 5, F.get(parts, n - 1)).otherwise("").alias("type"),
    )


def gradle_coordinate(text: Column) -> Column:
    """``a:b:v``, ``a:b -> w`` and ``a:b:v -> w``; marks (n), (c), (*) are cut off."""
    bare = F.trim(F.regexp_replace(text, r"\s*\((n|c|\*)\)\s*$", ""))
    left, right = F.trim(F.substring_index(bare, "->", 1)), F.trim(F.regexp_extract(bare, r"->\s*(.*)$", 1))
    parts = F.split(left, ":")
    return F.struct(F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("name"), F.when(right != "", right).otherwise(F.coalesce(F.get(parts, F.lit(2)), F.lit(""))).alias("version"))


def go_module(text: Column) -> Column:
    parts = F.split(text, "@")
    return F.struct(F.get(parts, F.lit(0)).alias("name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("version"))


def tree_parents(rows: DataFrame, key: str, order: str, depth: str, node: str) -> DataFrame:
    """Adds ``parent``: the last node above that is one level higher. Every row stands at its own level as a possible parent and at the
    level above as one that seeks; within a level the last parent before a row is its own."""
    both = rows.withColumn("__seeks", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("__level", F.col(depth) - F.col("__seeks").cast("int"))
    before = W.partitionBy(key, "__level").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    above = F.last(F.when(~F.col("__seeks"), F.col(node)), ignorenulls=True).over(before)
    return both.withColumn("parent", F.when(F.col(depth) > 0, above)).filter("__seeks").drop("__seeks", "__level")


def pom_dependencies(files: DataFrame) -> DataFrame:
    """``(path, name, version)`` of a POM's dependency elements, with ``${property}`` put from the POM's own properties."""
    blocks = files.filter(F.regexp_like("path", F.lit(r"(^|/)pom\.xml$"))).select("path", "content", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("block"))
    field = lambda x: F.trim(F.regexp_extract("block", rf"<{x}>\s*([^<]*?)\s*</{x}>", 1))
    version = field("version")
    name = F.regexp_extract(version, r"^\$\{([^}]+)\}$", 1)
    value = F.call_function("regexp_extract", F.col("content"), F.concat(F.lit(r"<\Q"), name, F.lit(r"\E>\s*([^<]*?)\s*</")), F.lit(1))
    return blocks.select("path", F.concat_ws(".", field("groupId"), field("artifactId")).alias("name"), F.when(name != "", value).otherwise(version).alias("version"))


def pom_rows(files: DataFrame) -> DataFrame:
    """The dependencies of all POMs as dependency rows."""
    return pom_dependencies(files).select(F.col("path").alias("file_uri"), "name", "version", F.lit("").alias("type"), F.lit("").alias("resolved_id"), F.lit(False).alias("indirect"))


def go_graph(text: DataFrame) -> DataFrame:
    """``(parent, child)`` from lines of two modules."""
    parts = F.split("value", r"\s+")
    return text.filter(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("parent"), F.get(parts, F.lit(1)).alias("child"))


def maven_listing(lines_: DataFrame) -> DataFrame:
    """``lines_(path, line_no, line)`` of dependency-tree output -> ``(path, module, line_no, depth, name, version, classifier, type, parent)``.

    A module's part begins with its own coordinate, a line of three to five parts without tree marks, which is no dependency. A
    dependency's depth is the width of its marks by three; its parent is the last line above that is one level higher."""
    text = F.trim(F.regexp_replace("line", r"^\[INFO\]\s?", ""))
    rows = lines_.select("path", "line_no", F.regexp_extract(F.regexp_replace("line", r"^\[INFO\]\s?", ""), r"^((?:[|\s]{3})*(?:[+\\]-\s))", 1).alias("marks"), text.alias("text"))
    rows = rows.withColumn("starts", (F.col("marks") == "") & F.col("text").rlike(r"^[\w.-]+(:[\w.-]+){2,4}$"))
    order = W.partitionBy("path").orderBy("line_no")  # one listing
    rows = rows.withColumn("module", F.sum(F.col("starts").cast("int")).over(order)).filter("module > 0 and marks <> ''")
    rows = rows.withColumn("depth", F.floor(F.length("marks") / 3).cast("int") - 1).withColumn("c", maven_coordinate(F.regexp_replace("text", r"^[|\s+\\-]+", "")))
    rows = rows.select("path", "module", "line_no", "depth", "c.*").withColumn("listing", F.concat_ws("#", "path", F.col("module").cast("string")))
    return tree_parents(rows, "listing", "line_no", "depth", "name").drop("listing")


def gradle_listing(lines_: DataFrame) -> DataFrame:
    """``(path, line_no, depth, name, version, parent)`` from lines such as ``|    +--- a:b:1 -> 2``; five characters a level.
    Lines that repeat a part, could not be resolved or are constraints, marked (*), (n), (c) at their end, are no dependencies."""
    lines_ = lines_.filter(~F.col("line").rlike(r"\((n|c|\*)\)\s*$"))
    rows = lines_.select("path", "line_no", F.regexp_extract("line", r"^((?:[|\s]\s{4})*[+\\]---\s)", 1).alias("marks"), "line").filter("marks <> ''")
    rows = rows.withColumn("depth", F.floor(F.length("marks") / 5).cast("int") - 1)
    rows = rows.select("path", "line_no", "depth", gradle_coordinate(F.expr("substring(line, length(marks) + 1)")).alias("c")).select("path", "line_no", "depth", "c.*")
    return tree_parents(rows, "path", "line_no", "depth", "name")


def dependency_json(text: DataFrame) -> DataFrame:
    """``text(value)``: one JSON object of file -> dependencies a row, as external tools print it -> dependency rows."""
    kind = "map<string,array<struct<name:string,version:string,classifier:string,type:string,resolvedIdentifier:string,indirect:boolean>>>"
    files = text.select(F.explode(F.from_json("value", kind)).alias("file_uri", "deps"))
    rows = files.select("file_uri", F.explode("deps").alias("d"))
    return rows.select("file_uri", "d.name", "d.version", F.coalesce("d.classifier", F.lit("")).alias("classifier"), F.coalesce("d.type", F.lit("")).alias("type"), F.coalesce("d.resolvedIdentifier", F.lit("")).alias("resolved_id"), F.coalesce("d.indirect", F.lit(False)).alias("indirect"))


def unresolved_sources(log: DataFrame) -> DataFrame:
    """``log(line)`` of a build that fetches sources -> ``coordinate`` of artifacts that exist but have no sources: those reported
    without sources, less those reported missing themselves."""
    parts = F.struct(F.regexp_extract("line", r"([\w.-]+:[\w.-]+:[\w.-]+):sources:[\w.-]+", 1).alias("head"), F.regexp_extract("line", r":sources:([\w.-]+)", 1).alias("version"))
    bare = log.select(parts.alias("p")).filter("p.head <> ''").select(F.concat_ws(":", "p.head", "p.version").alias("coordinate"))
    absent = log.select(F.regexp_extract("line", r"artifact ([\w.-]+:[\w.-]+:[\w.-]+:[\d][\w.-]*)", 1).alias("coordinate")).filter("coordinate <> ''")
    return bare.distinct().join(absent.distinct(), "coordinate", "left_anti")


def repository_path(group: Column, artifact: Column, version: Column) -> Column:
    """Where a local repository keeps an artifact: the group as directories, then artifact and version."""
    return F.concat_ws("/", F.replace(group, F.lit("."), F.lit("/")), artifact, version, F.concat(artifact, F.lit("-"), version, F.lit(".jar")))


def build_tool(names: set[str]) -> str | None:
    """The tool that a directory's file names call for: Gradle, then an archive, then Maven."""
    if names & {"build.gradle", "build.gradle.kts", "gradlew"}:
        return "gradle"
    if any(x.endswith((".jar", ".war", ".ear")) for x in names):
        return "binary"
    return "maven" if "pom.xml" in names else None


def complete_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts with group, name and version, each once with its packaging."""
    keys = ["group", "artifact", "version", "packaging"]
    named = artifacts.filter(" and ".join(f"coalesce({k}, '') <> ''" for k in keys[:3]))
    return named.dropDuplicates(keys)


def label_patterns(lines_: list[str], label: str, known: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """A pattern a line, with the labels it gives; a pattern that is known gets the label too. A bad pattern is an error."""
    out = {p: list(labels) for p, labels in (known or {}).items()}
    for pattern in lines_:
        re.compile(pattern)
        if label not in out.setdefault(pattern, []):
            out[pattern].append(label)
    return out
