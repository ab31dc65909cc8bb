"""Evaluation of rules over tables: files are scanned once for all content searches of all rules, and gates only ask which searches
have incidents.

>>> result = Analyzer(files=files).run(load("rules/"), selectors=["target=spark"])
>>> result.violations.show()
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleframe.functions import text as T
from ruleframe.functions.labels import incident_selector as chosen
from ruleframe.operators import combine as C
from ruleframe.operators import emit, leaves
from ruleframe.operators.stored import stored
from ruleframe.plans.rules import Condition, Rule, as_table, selected

Search = Callable[["Analyzer", str, dict, DataFrame], DataFrame]


def _files(pattern_key: str, search: Callable) -> Search:
    def run(a: Analyzer, rule: str, fields: dict, files: DataFrame) -> DataFrame:
        return search(files, rule, fields[pattern_key])

    return run


def unquoted(pattern: str) -> str:
    """Without one quote at the front and one at the end, unless that is escaped."""
    pattern = pattern.removeprefix('"')
    return pattern[:-1] if pattern.endswith('"') and not pattern.endswith('\\"') else pattern


def _content(a: Analyzer, rule: str, fields: dict, files: DataFrame) -> DataFrame:
    return leaves.filecontent(files, {rule: unquoted(fields["pattern"])}, fields.get("filePattern"))


def _resources(a: Analyzer, rule: str, fields: dict, files: DataFrame) -> DataFrame:
    wanted = [(rule, fields.get("apiVersion"), fields.get("kind"), fields.get("deprecatedIn"), fields.get("removedIn"), fields.get("replacementAPI"))]
    rows = files.sparkSession.createDataFrame(wanted, "rule_id string, api_version string, kind string, deprecated_in string, removed_in string, replacement string")
    return leaves.k8s_deprecated(leaves.k8s_resources(files), F.broadcast(rows), a.k8s_version)


def _references(a: Analyzer, rule: str, fields: dict, files: DataFrame) -> DataFrame:
    return leaves.references(a.declarations, a.refs, rule, fields["pattern"], a.workspace, a.dependency_dirs)


def _node_references(a: Analyzer, rule: str, fields: dict, files: DataFrame) -> DataFrame:
    return leaves.scoped_references(a.declarations, a.refs, rule, fields["pattern"], a.workspace, a.dependency_dirs)


def _symbols(a: Analyzer, rule: str, fields: dict, files: DataFrame) -> DataFrame:
    note = fields.get("annotated")
    note = note and (note.get("pattern", "*"), {e["name"]: e["value"] for e in note.get("elements", [])})
    return leaves.referenced(a.symbols, rule, fields["pattern"], fields.get("location"), note, files)


def _dependencies(a: Analyzer, rule: str, fields: dict, files: DataFrame) -> DataFrame:
    return leaves.dependency(a.deps, rule, fields.get("name"), fields.get("nameregex") or fields.get("name_regex"), fields.get("lowerbound"), fields.get("upperbound"))


#: Capability -> search. A user's own capability is one more entry.
CAPABILITIES: dict[str, Search] = {
    "builtin.file": _files("pattern", leaves.file),
    "builtin.filecontent": _content,
    "builtin.xml": _files("xpath", leaves.xml),
    "builtin.json": _files("xpath", leaves.json),
    "builtin.xmlPublicID": lambda a, rule, fields, files: leaves.attribute(files, rule, "public-id", fields["regex"]),
    "builtin.hasTags": lambda a, rule, fields, files: leaves.has_tags(a.tags, rule, fields),
    "java.referenced": _symbols,
    "java.dependency": _dependencies,
    "go.dependency": _dependencies,
    "python.dependency": _dependencies,
    "nodejs.dependency": _dependencies,
    "go.referenced": _references,
    "python.referenced": _references,
    "nodejs.referenced": _node_references,
    "yaml.k8sResourceMatched": _resources,
}


@dataclass
class Result:
    violations: DataFrame
    unmatched: DataFrame
    skipped: DataFrame
    tags: DataFrame
    incidents: DataFrame


@dataclass
class Leaf:
    """A search of a rule: its number, whether its incidents are shown, and the searches whose files it is confined to (None: all)."""

    number: int
    rule: str
    condition: Condition
    shown: bool
    source: list[int] | None

    def content_key(self) -> str | None:
        """Content searches over all files share one scan; equal ones are one search."""
        return json.dumps([unquoted(self.condition.value["pattern"]), self.condition.value.get("filePattern"), self.paths()]) if self.condition.op == "builtin.filecontent" else None

    def paths(self) -> list[str] | None:
        paths = self.condition.value.get("filepaths") if isinstance(self.condition.value, dict) else None
        return None if not paths or self.source is not None else [paths] if isinstance(paths, str) else list(paths)


@dataclass
class Analyzer:
    """The tables that rules search; a table that a rule does not need may be left out."""

    files: DataFrame
    deps: DataFrame | None = None
    symbols: DataFrame | None = None
    tags: DataFrame | None = None
    declarations: DataFrame | None = None
    refs: DataFrame | None = None
    workspace: str = ""
    dependency_dirs: list[str] = field(default_factory=list)
    k8s_version: str = "v1.28"
    capabilities: dict[str, Search] = field(default_factory=lambda: dict(CAPABILITIES))

    def known(self, c: Condition) -> Condition | None:
        """The condition without searches that nothing provides: ``and`` goes with any part, ``or`` with all of them."""
        if c.op in ("and", "or"):
            parts = [self.known(x) for x in c.value]
            left = [x for x in parts if x]
            return None if not left or (c.op == "and" and len(left) < len(parts)) else Condition(c.op, left, c.negate, c.ignore, c.name, c.source)
        return c if c.op in self.capabilities else None

    def searches(self, rules: list[Rule]) -> tuple[list[Leaf], dict[str, C.Node]]:
        """All searches of the rules, and each rule's condition over their numbers."""
        found: list[Leaf] = []

        def visit(rule: str, c: Condition, shown: bool, names: dict[str, list[int]]) -> tuple[C.Node, list[int]]:
            """The condition, and the searches whose incidents it has."""
            if c.op in ("and", "or"):
                names, parts, own = dict(names), [], []
                for x in c.value:
                    part, has = visit(rule, x, shown and not x.ignore, names)
                    parts.append(part)
                    own += [] if x.ignore else has
                    if x.name:
                        names[x.name] = has
                return C.Node(c.op, parts, negate=c.negate), own
            paths = c.value.get("filepaths") if isinstance(c.value, dict) else None
            chained = isinstance(paths, str) and c.source in names and paths.strip("'\" ").lower() == "{{" + f"{c.source}.filepaths".lower() + "}}"
            found.append(Leaf(len(found), rule, c, shown, names[c.source] if chained else None))
            return C.Node(c.op, [], len(found) - 1, c.negate), [len(found) - 1]

        return found, {r.rule_id: visit(r.rule_id, r.when, not r.when.ignore, {})[0] for r in rules}

    def content(self, found: list[Leaf]) -> DataFrame | None:
        """``(leaf, uri, line_no, variables)`` of all content searches, from one scan of the files, as a stored table."""
        keys: dict[str, list[int]] = {}
        for x in found:
            if (key := x.content_key()) is not None:
                keys.setdefault(key, []).append(x.number)
        if not keys:
            return None
        patterns, only = {}, {}
        for k, key in enumerate(keys):
            pattern, file_pattern, paths = json.loads(key)
            holds = [T.path_matches(F.col("path"), file_pattern)] if file_pattern else []
            holds += [reduce(lambda a, b: a | b, [T.path_matches(F.col("path"), p) for p in paths])] if paths else []
            patterns[str(k)] = pattern
            if holds:
                only[str(k)] = reduce(lambda a, b: a & b, holds)
        hits = stored(leaves.filecontent(self.files, patterns, only=only), "content")
        of = self.files.sparkSession.createDataFrame([(str(k), n) for k, numbers in enumerate(keys.values()) for n in numbers], "rule_id string, leaf int")  # a row a search
        return hits.join(F.broadcast(of), "rule_id").select("leaf", "uri", "line_no", "variables")

    def found(self, rules: list[Rule]) -> DataFrame:
        """``(rule_id, uri, line_no, variables)`` of the rules whose conditions hold.

        Every search is computed once and stored with its number. Which searches have incidents is all that the gates ask: a list
        no longer than the rules' own conditions, which is looked at here."""
        spark = self.files.sparkSession
        found, gates = self.searches(rules)
        content = self.content(found)
        made: dict[int, DataFrame] = {}
        for x in found:
            files, c = self.files, x.condition
            source = None if x.source is None else reduce(DataFrame.unionByName, [made[n] for n in x.source]) if x.source else spark.createDataFrame([], "leaf int, uri string, line_no int, variables map<string,string>")
            if c.op == "builtin.filecontent":
                out = content.filter(F.col("leaf") == x.number)
                made[x.number] = out if source is None else out.join(source.select("uri").distinct(), "uri", "left_semi").select(out.columns)
                continue
            if source is not None:
                files = C.only_files_of(files, source)
            elif x.paths():
                files = files.filter(reduce(lambda a, b: a | b, [T.path_matches(F.col("path"), p) for p in x.paths()]))
            made[x.number] = self.capabilities[c.op](self, x.rule, c.value, files).select(F.lit(x.number).alias("leaf"), "uri", "line_no", "variables")
        alone = [x.number for x in found if x.condition.op == "builtin.filecontent" and x.source is None]
        rest = [made[x.number] for x in found if x.number not in {*alone}]
        if rest:
            some = [content.join(F.broadcast(spark.createDataFrame([(n,) for n in alone], "leaf int")), "leaf", "left_semi")] if alone else []
            rows = stored(reduce(DataFrame.unionByName, [*some, *rest]), "incidents")
        else:
            rows = content
        present = {r["leaf"] for r in rows.select("leaf").distinct().collect()}  # a number for each search of the rules at most
        shown = [(x.number, x.rule) for x in found if x.shown and x.number in present and C.matched(gates[x.rule], present)]
        return rows.join(F.broadcast(spark.createDataFrame(shown, "leaf int, rule_id string")), "leaf").select("rule_id", "uri", "line_no", "variables")

    def incidents(self, rules: list[Rule], table: DataFrame, incident_selector: str | None, most: int, included: DataFrame | None, excluded: list[str] | None) -> DataFrame:
        """The incidents of ``rules`` with messages, each once, up to ``most`` a rule."""
        found = self.found(rules).join(F.broadcast(table.select("rule_id")), "rule_id", "left_semi")
        found = C.keep_paths(found, included, excluded)
        found = emit.with_custom_variables(found, self.files, {r.rule_id: r.variables for r in rules if r.variables})
        found = emit.with_message(found, {r.rule_id: r.message or "" for r in rules})
        if incident_selector:
            found = found.filter(chosen(F.col("variables"), incident_selector))
        return emit.limited(emit.distinct_incidents(found), most)

    def tags_of(self, found: DataFrame, rules: list[Rule], table: DataFrame) -> DataFrame:
        """``(ruleset, raw, tag)`` of tagging rules: templates filled from each incident, categories cut off in ``tag``."""
        templates = sorted({t for r in rules for t in r.tags})
        tagged = found.join(F.broadcast(table.filter(F.size("tags") > 0).select("rule_id", "ruleset", F.explode("tags").alias("template"))), "rule_id")
        text = reduce(lambda out, t: F.when(F.col("template") == t, T.render(t, F.col("variables"), F.col("line_no"))).otherwise(out), templates, F.lit(None).cast("string"))
        return tagged.select("ruleset", text.alias("raw")).distinct().select("ruleset", "raw", F.explode(T.tags_of(F.col("raw"))).alias("tag"))

    def run(
        self, rules: list[Rule], selectors: list[str] = (), incident_selector: str | None = None, most_incidents: int = emit.MOST_INCIDENTS,
        included: DataFrame | None = None, excluded: list[str] | None = None, snippets: int | None = None, context: int = emit.CONTEXT,
    ) -> Result:
        """``snippets``: how many incidents of a rule and file show their lines (0: all, None: none).

        Rules that nothing can evaluate are left out. Rules that ask for tags come last and see those of all others."""
        spark = self.files.sparkSession
        rules = [replace(r, when=c) for r in rules if (c := self.known(r.when))]
        table, skipped = selected(as_table(spark, rules), list(selectors))
        scope = (incident_selector, most_incidents, included, excluded)
        first, last = [r for r in rules if not asks_for_tags(r.when)], [r for r in rules if asks_for_tags(r.when)]
        parts = [self.incidents(first, table, *scope)] if first else []
        if last:
            known = [t for t in (None if self.tags is None else self.tags.select("tag"), self.tags_of(parts[0], first, table).select("tag") if first else None) if t is not None]
            known = reduce(DataFrame.unionByName, known or [spark.createDataFrame([], "tag string")]).distinct()
            parts.append(replace(self, tags=known).incidents(last, table, *scope))
        if not parts:
            parts = [leaves.incidents(self.files, "", "path").withColumn("message", F.lit("")).limit(0)]
        found = reduce(DataFrame.unionByName, parts)
        tags = self.tags_of(found, rules, table)
        shown = found if snippets is None else emit.with_snippets(found, self.files, context, snippets)
        report = table.filter(F.col("message").isNotNull() | (F.size("tags") > 0))
        return Result(emit.violations(shown, report), emit.unmatched(found, table), skipped, tags, shown)


def asks_for_tags(c: Condition) -> bool:
    return c.op == "builtin.hasTags" or (c.op in ("and", "or") and any(asks_for_tags(x) for x in c.value))
