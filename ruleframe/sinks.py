"""Results as files: tables for large results, YAML documents for reports, schemas, progress lines."""

from __future__ import annotations

import json
from itertools import groupby
from pathlib import Path
from typing import IO

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Exit status of a run that must fail when it finds violations.
VIOLATIONS_FOUND = 3


def write_tables(result, base: str, kind: str = "parquet") -> None:
    """All parts of a result as tables below ``base``; nothing passes through the driver."""
    for name in ("violations", "incidents", "unmatched", "skipped", "tags"):
        getattr(result, name).write.mode("overwrite").format(kind).save(f"{base}/{name}")


def rulesets(result) -> list[dict]:
    """Rulesets sorted by name, each with tags, violations, insights, unmatched and skipped rules. For reports: a rule's
    incidents are limited by the run, and the number of rules is that of the rule files."""
    out: dict[str, dict] = {}
    at = lambda name: out.setdefault(name, {"name": name})
    for r in result.violations.orderBy("ruleset", "rule_id").toLocalIterator():
        item = {k: r[k] for k in ("description", "category", "labels", "effort") if r[k]}
        item["incidents"] = [{k: v for k, v in i.asDict().items() if v not in (None, "")} for i in r["incidents"]]
        at(r["ruleset"]).setdefault("violations" if r["kind"] == "violation" else "insights", {})[r["rule_id"]] = item
    for name in ("unmatched", "skipped"):
        for r in getattr(result, name).orderBy("ruleset", "rule_id").toLocalIterator():
            at(r["ruleset"]).setdefault(name, []).append(r["rule_id"])
    for r in result.tags.select("ruleset", "raw").distinct().orderBy("ruleset", "raw").toLocalIterator():
        at(r["ruleset"]).setdefault("tags", []).append(r["raw"])
    return [out[k] for k in sorted(out)]


def write_report(result, path: str) -> None:
    Path(path).write_text(yaml.safe_dump(rulesets(result), sort_keys=False, allow_unicode=True))


def exit_code(result, error_on_violation: bool) -> int:
    return VIOLATIONS_FOUND if error_on_violation and not result.violations.filter("kind = 'violation'").isEmpty() else 0


def dependency_order(deps: DataFrame) -> DataFrame:
    """The order of dependency reports: file, then name, version, type, direct before indirect, resolved id."""
    return deps.orderBy("file_uri", "name", "version", "type", "indirect", "resolved_id")


def write_dependencies(deps: DataFrame, path: str, edges: DataFrame | None = None) -> None:
    """A flat report, or with ``edges(file_uri, parent, child)`` a tree of two levels; one file's part is held at a time."""
    if edges is not None:
        grouped = edges.groupBy("file_uri", "parent").agg(F.sort_array(F.collect_set("child")).alias("children"))
        deps = deps.join(grouped.withColumnRenamed("parent", "name"), ["file_uri", "name"], "left")
    with Path(path).open("w") as out:
        for uri, rows in groupby(dependency_order(deps).toLocalIterator(), key=lambda r: r["file_uri"]):
            items = []
            for r in rows:
                item = {k: v for k, v in r.asDict().items() if v not in (None, "", False, []) and k not in ("file_uri", "children")}
                if edges is not None and r["children"]:
                    item["addedDeps"] = [{"name": c} for c in r["children"]]
                items.append(item)
            yaml.safe_dump([{"fileURI": uri, "dependencies": items}], out, sort_keys=False, allow_unicode=True)


def capability_schema(fields: dict[str, dict[str, str]]) -> dict:
    """An OpenAPI object for capabilities: name -> field -> JSON type."""
    part = lambda f: {"type": "object", "properties": {k: {"type": t} for k, t in f.items()}}
    conditions = {name: {"type": "object", "properties": {name: part(f)}} for name, f in sorted(fields.items())}
    choice = [{"$ref": f"#/components/schemas/{name}"} for name in sorted(fields)]
    nested = {x: {"type": "object", "properties": {x: {"type": "array", "items": {"oneOf": [*choice, {"$ref": "#/components/schemas/and"}, {"$ref": "#/components/schemas/or"}]}}}} for x in ("and", "or")}
    rule = part({"ruleID": "string", "description": "string", "category": "string", "effort": "integer", "message": "string"})
    rule["properties"] |= {"labels": {"type": "array", "items": {"type": "string"}}, "tag": {"type": "array", "items": {"type": "string"}}, "when": {"oneOf": [*choice, *({"$ref": f"#/components/schemas/{x}"} for x in nested)]}}
    return {"openapi": "3.0.0", "info": {"title": "rules", "version": "1"}, "paths": {}, "components": {"schemas": {**conditions, **nested, "rule": rule}}}


class ProgressLines(StreamingQueryListener):
    """One JSON line for each progress event of the session's streams."""

    def __init__(self, out: IO[str]):
        self.out = out

    def line(self, **what) -> None:
        self.out.write(json.dumps(what) + "\n")
        self.out.flush()

    def onQueryStarted(self, event) -> None:
        self.line(stage="started", query=str(event.name or event.id), timestamp=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.line(stage="progress", query=str(p.name or p.id), timestamp=p.timestamp, batch=p.batchId, current=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.line(stage="ended", query=str(event.id), error=event.exception)
