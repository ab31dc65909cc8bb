"""From incidents to violations: messages, variables, snippets, limits, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ruleframe.functions import text as T

#: Defaults: incidents for a rule, snippets for a rule and file, lines around a snippet.
MOST_INCIDENTS, MOST_SNIPPETS, CONTEXT = 1500, 20, 10
ORDER = ("uri", "line_no", "message")


def with_message(found: DataFrame, templates: dict[str, str]) -> DataFrame:
    out = F.lit("")
    for rule, template in templates.items():
        out = F.when(F.col("rule_id") == rule, T.render(template, F.col("variables"), F.col("line_no"))).otherwise(out)
    return found.withColumn("message", out)


def with_custom_variables(found: DataFrame, files: DataFrame, wanted: dict[str, list[dict]]) -> DataFrame:
    """Adds each rule's custom variables, taken by regex from the incident's own line; incidents of other rules are not joined."""
    if not wanted:
        return found
    chosen = F.col("rule_id").isin(sorted(wanted))
    text = files.select(F.col("path").alias("uri"), "content")
    joined = found.filter(chosen).join(text, "uri", "left")
    line = F.coalesce(F.get(F.split("content", "\n", -1), F.col("line_no") - 1), F.lit(""))
    out = F.col("variables")
    for rule, variables in wanted.items():
        values = [(v["name"], T.custom_variable(line, v["pattern"], v.get("defaultValue") or "", v.get("nameOfCaptureGroup"))) for v in variables]
        more = F.map_filter(F.create_map(*(x for name, value in values for x in (F.lit(name), value))), lambda _, value: value.isNotNull())
        old = F.map_filter("variables", lambda k, _: ~F.array_contains(F.map_keys(more), k))
        out = F.when(F.col("rule_id") == rule, F.map_concat(old, more)).otherwise(out)
    return found.filter(~chosen).unionByName(joined.withColumn("variables", out).select(*found.columns))


def distinct_incidents(found: DataFrame) -> DataFrame:
    """One incident for each (rule, uri, message, line); a null line is a line of its own."""
    keys = ["rule_id", "uri", "message", "line_no"]
    return found.groupBy(*keys).agg(F.min_by("variables", F.to_json("variables")).alias("variables"))


def limited(found: DataFrame, most: int = MOST_INCIDENTS) -> DataFrame:
    """The first ``most`` incidents of every rule; 0 is no limit. A rule's incidents are dealt to parts by file, each of which leaves
    ``most`` at most, so a rule with nearly all incidents is no task of its own before only these are left."""
    if not most:
        return found
    order = (F.col("uri"), F.coalesce("line_no", F.lit(0)), F.col("message"))
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    few = found.withColumn("__part", F.pmod(F.xxhash64("uri"), F.lit(256)))
    few = few.withColumn("__rank", rank("rule_id", "__part")).filter(F.col("__rank") <= most).drop("__part", "__rank")
    return few.withColumn("__rank", rank("rule_id")).filter(F.col("__rank") <= most).drop("__rank")


def snippet(content: Column, line: Column, context: int = CONTEXT, trimmed: bool = False) -> Column:
    """The numbered lines from ``context - 1`` before to ``context + 1`` after ``line``, numbers padded to the width of ``line + context``.
    Where the text ends before the last of them, a line feed follows. ``trimmed``: as for Java sources, lines without outer white
    space, a line feed before each."""
    first = F.greatest(line - context + 1, F.lit(1))
    last = line + context + 1
    lines = F.split(F.regexp_replace(content, r"\n\z", ""), "\n", -1)
    parts = F.slice(lines, first, last - first + 1)
    width = F.length((line + context).cast("string"))
    number = lambda i: F.lpad((first + i).cast("string"), F.greatest(width, F.length((first + i).cast("string"))), F.lit(" "))
    shown = F.transform(parts, lambda x, i: F.concat(number(i), F.lit("  "), F.btrim(x) if trimmed else x))
    if trimmed:
        return F.array_join(F.transform(shown, lambda x: F.concat(F.lit("\n"), x)), "")
    return F.concat(F.array_join(shown, "\n"), F.when((F.size(lines) < last) & (F.size(parts) > 0), "\n").otherwise(""))


def first_snippet(*made: Column) -> Column:
    """The first of several providers' snippets that is not empty."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in made))


def with_snippets(found: DataFrame, files: DataFrame, context: int = CONTEXT, most: int = MOST_SNIPPETS) -> DataFrame:
    """Adds ``code_snip``; beyond ``most`` incidents of one rule and file it is null."""
    rank = F.row_number().over(W.partitionBy("rule_id", "uri").orderBy("line_no", "message"))
    joined = found.join(files.select(F.col("path").alias("uri"), "content"), "uri", "left")
    shown = F.col("line_no").isNotNull() & F.col("content").isNotNull()
    shown = shown & (rank <= most) if most else shown
    return joined.withColumn("code_snip", F.when(shown, snippet(F.col("content"), F.col("line_no"), context))).drop("content")


def violations(found: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per rule with incidents: rule columns, ``kind`` (violation, or insight where effort is null or 0), sorted incidents.

    Limit incidents first, so that a rule's list is bounded."""
    shown = ["code_snip"] if "code_snip" in found.columns else []
    item = F.struct("uri", F.coalesce("line_no", F.lit(0)).alias("line_no"), "message", *shown)
    grouped = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_incidents"), F.sort_array(F.collect_list(item)).alias("incidents"))
    kind = F.when(F.coalesce("effort", F.lit(0)) == 0, "insight").otherwise("violation")
    category = F.when(F.lower("category").isin("potential", "optional", "mandatory"), F.lower("category")).otherwise("potential")
    return rules.join(grouped, "rule_id").withColumn("kind", kind).withColumn("category", category)


def unmatched(found: DataFrame, rules: DataFrame) -> DataFrame:
    return rules.join(found.select("rule_id").distinct(), "rule_id", "left_anti").select("ruleset", "rule_id")
