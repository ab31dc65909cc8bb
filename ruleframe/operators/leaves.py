"""Leaf conditions: searches that turn files, tags, resources, symbols and dependencies into incidents.

An incident is ``(rule_id, uri, line_no, variables)``; ``line_no`` counts from 1 and is null for a whole file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.functions import text as T
from ruleframe.functions.versions import semver, within_bounds
from ruleframe.sources.symbols import known_location

NO_VARIABLES = "map()"


def incidents(df: DataFrame, rule: str | Column, uri: str | Column, line: Column | None = None, variables: Column | None = None) -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    empty = F.create_map().cast("map<string,string>")
    return df.select(
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), col(uri).alias("uri"),
        (line if line is not None else F.lit(None)).cast("int").alias("line_no"), (variables if variables is not None else empty).alias("variables"),
    )


def file(files: DataFrame, rule: str, pattern: str) -> DataFrame:
    return incidents(files.filter(T.path_matches(F.col("path"), pattern)), rule, "path")


def needs_whole_text(pattern: str) -> bool:
    """Patterns that may run over line ends are matched on whole files, others line by line."""
    return any(x in pattern for x in ("\\n", "\\r", "(?s)", "(?m)", "\\s", "[^>", "[^<"))


def in_text(pattern: str) -> str:
    """``pattern`` for whole texts: ``^`` and ``$`` stand at line feeds too."""
    return "(?dm)" + pattern.replace("(?P<", "(?<")


def is_literal(pattern: str) -> bool:
    return bool(pattern) and not any(c in T.META or c == "\n" for c in pattern)


def guard(content: Column, pattern: str) -> Column | None:
    """False only for files that hold no match, so that lines are cut for few files: the pattern on the whole text, if it is matched
    there in any case, or if its matches in a line do not hang on what is around them (anchors, looking ahead or behind)."""
    if is_literal(pattern):
        return F.contains(content, F.lit(pattern))
    if needs_whole_text(pattern):
        return content.rlike(in_text(pattern))
    return None if re.search(r"[\^$]|\\[AzZGbB]|\(\?<?[=!]", pattern) else content.rlike(T.java(pattern))


def hit(key: str, line: Column, match: Column) -> Column:
    return F.struct(F.lit(key).alias("rule_id"), line.cast("int").alias("line_no"), match.alias("match"))


def matches_in_lines(content: Column, key: str, pattern: str) -> Column:
    """An array of (rule_id, line_no, match) of a pattern in every line."""

    def in_line(line: Column, i: Column) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(T.java(pattern)), 0), lambda m: hit(key, i + 1, m))

    return F.flatten(F.transform(F.split(content, "\n", -1), in_line))


#: Marks the first character of a match; a character that Unicode keeps out of texts.
MARK = "\ufdd0"


def matches_in_text(content: Column, key: str, pattern: str) -> Column:
    """As ``matches_in_lines`` over the whole text; a match's line is that of its first character.

    Matches are marked, and the marks of each line counted: every text is read three times, whatever the number of matches."""
    p, plain = F.lit(in_text(pattern)), F.replace(content, F.lit(MARK), F.lit(" "))
    marked = F.regexp_replace(plain, p, F.lit(MARK + "$0"))
    marks = lambda line: F.length(line) - F.length(F.replace(line, F.lit(MARK), F.lit("")))
    lines = F.flatten(F.transform(F.split(marked, "\n", -1), lambda line, i: F.array_repeat(i + 1, marks(line))))
    return F.transform(F.arrays_zip(F.regexp_extract_all(plain, p, 0).alias("match"), lines.alias("line")), lambda x: hit(key, x["line"], x["match"]))


def matches_of_literal(content: Column, key: str, text: str) -> Column:
    """Overlapping occurrences of a text without line feeds. A line is cut before each; only one at its very front makes no cut."""

    def in_line(line: Column, i: Column) -> Column:
        n = F.size(F.split(line, rf"(?=\Q{text}\E)", -1)) - 1 + F.startswith(line, F.lit(text)).cast("int")
        return F.array_repeat(hit(key, i + 1, F.lit(text)), n)

    return F.flatten(F.transform(F.split(content, "\n", -1), in_line))


def filecontent(files: DataFrame, patterns: dict[str, str], file_pattern: str | None = None, only: dict[str, Column] | None = None) -> DataFrame:
    """Matches of every pattern in one scan of the files; variable ``matchingText``. A pattern without regex characters is a text, whose
    overlapping occurrences count. ``only``: conditions on ``path`` for some patterns. Lines are cut only where a file holds a match, as far as the
    whole text can tell."""
    if file_pattern:
        files = files.filter(T.path_matches(F.col("path"), file_pattern))
    content, found = F.col("content"), []
    for key, pattern in patterns.items():
        search = matches_of_literal if is_literal(pattern) else matches_in_text if needs_whole_text(pattern) else matches_in_lines
        holds, path = guard(content, pattern), (only or {}).get(key)
        holds = holds if path is None else path if holds is None else path & holds
        out = search(content, key, pattern)
        if len(patterns) == 1:
            files = files if holds is None else files.filter(holds)
        elif holds is not None:
            out = F.when(holds, out).otherwise(F.array().cast("array<struct<rule_id:string,line_no:int,match:string>>"))
        found.append(out)
    hits = files.select("path", F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("m"))
    return incidents(hits, F.col("m.rule_id"), "path", F.col("m.line_no"), F.create_map(F.lit("matchingText"), F.col("m.match")))


def literal(files: DataFrame, rule: str, text: str) -> DataFrame:
    hits = files.filter(F.contains("content", F.lit(text))).select("path", F.explode(matches_of_literal(F.col("content"), rule, text)).alias("m"))
    return incidents(hits, F.col("m.rule_id"), "path", F.col("m.line_no"), F.create_map(F.lit("matchingText"), F.col("m.match")))


def multiline_grep(files: DataFrame, rule: str, pattern: str, window: int = 3) -> DataFrame:
    """The first place of each file where ``pattern`` matches in a window of up to ``window`` lines (5 at most), without tabs and outer
    spaces, joined by line feeds; ``.`` runs over them. The line is the first of that window."""
    from pyspark.sql.window import Window as W

    window = min(window, 5)
    numbered = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    order = W.partitionBy("path").orderBy("pos").rowsBetween(1 - window, 0)  # one file's lines
    text = F.array_join(F.collect_list(F.trim(F.replace("line", F.lit("\t"), F.lit("")))).over(order), "\n")
    hits = numbered.withColumn("text", text).filter(F.col("text").rlike("(?s)" + pattern.replace("(?P<", "(?<")))
    first = hits.groupBy("path").agg(F.greatest(F.lit(1), F.min("pos") + 2 - window).alias("line_no"))
    return incidents(first, rule, "path", F.col("line_no"))


def element_pattern(content: str) -> str:
    """A pattern for :func:`multiline_grep` that finds an element by its source: up to five lines, trimmed and quoted, with anything between."""
    return ".*?".join(rf"\Q{line.strip()}\E" for line in content.strip().split("\n")[:5])


def well_formed(content: Column) -> Column:
    """Whether tags are balanced, by reducing: elements without elements inside are taken away until none is left.

    Comments, sections and instructions go first. A text that is not reduced within 60 levels counts as malformed."""
    bare = F.regexp_replace(content, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![A-Za-z][^>\[]*(?:\[[^\]]*\])?[^>]*>", "")
    bare = F.regexp_replace(bare, r"&(?!(?:[A-Za-z][\w.-]*|#\d+|#x[0-9A-Fa-f]+);)", "<bad")
    tags = F.regexp_extract_all(bare, F.lit(r"<(/?[A-Za-z_][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*\s*/?)>"), 1)
    rest = F.trim(F.regexp_replace(bare, r"<(/?[A-Za-z_][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*\s*/?)>", ""))
    name = lambda t: F.regexp_extract(t, r"^/?([^\s/]+)", 1)
    # open elements as a path of names; an end tag must close the last, and an attribute's name stands once
    step = lambda s, t: (
        F.when(s.isNull() | t.endswith("/"), s)
        .when(~t.startswith("/"), F.concat(s, F.lit("<"), name(t)))
        .when(F.substring_index(s, "<", -1) == name(t), F.call_function("substring_index", s, F.lit("<"), F.size(F.split(s, "<")) - 1))
    )
    open_ = F.aggregate(tags, F.lit(""), step)
    return (F.size(tags) > 0) & ~F.contains(rest, F.lit("<")) & F.coalesce(open_ == "", F.lit(False))


def xml(files: DataFrame, rule: str, xpath: str) -> DataFrame:
    """XPath over XML files: text or attribute nodes; an element's path gets ``/text()``. Variable ``innerText``, and the first line
    where it stands. Prefixes of namespaces do not count. Files that are not well-formed have no nodes, and stop nothing."""
    path = xpath if "@" in xpath.rsplit("/", 1)[-1] or xpath.endswith("()") else f"{xpath}/text()"
    steps = re.sub(r"(^|/|\[|\(|::|@)[A-Za-z_][\w.-]*:(?=[A-Za-z_*])", r"\1", path)
    plain = F.regexp_replace(F.regexp_replace("content", r"\sxmlns(:[\w.-]+)?\s*=\s*(\"[^\"]*\"|'[^']*')", ""), r"(<\/?|\s)[A-Za-z_][\w.-]*:(?=[A-Za-z_][\w.-]*[\s=>\/])", "$1")
    plain = F.regexp_replace(plain, r"(?s)<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "")  # entities are not read from elsewhere
    chosen = files.filter(F.regexp_like("path", F.lit(r"(?i)\.(x(ht)?ml|jsp|html?)$"))).withColumn("__xml", F.when(well_formed(F.col("content")), plain))
    hits = chosen.select("path", "content", F.explode(F.when(F.col("__xml").isNotNull(), F.xpath(F.coalesce("__xml", F.lit("<none/>")), F.lit(steps)))).alias("found"))
    head = F.substring_index(F.trim("found"), "\n", 1)
    at = F.call_function("locate", head, F.col("content"))
    before = F.substring(F.col("content"), F.lit(1), F.greatest(at - 1, F.lit(0)))
    line = F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)
    variables = F.create_map(F.lit("innerText"), T.compact_xml(F.col("found")))
    return incidents(hits, rule, "path", line, variables)


def attribute(files: DataFrame, rule: str, name: str, regex: str) -> DataFrame:
    """Elements' first attribute ``name`` that ``regex`` matches, in markup that need not be well-formed."""
    found = F.regexp_extract_all("content", F.lit(rf'(?is)<[a-z!][^>]*?\s{name}\s*=\s*"([^"]*)"'), 1)
    hits = files.select("path", F.explode(found).alias("value")).filter(F.col("value").rlike(T.java(regex)))
    return incidents(hits, rule, "path", None, F.create_map(F.lit("matchingXML"), F.col("value")))


def json(files: DataFrame, rule: str, path: str, most_levels: int = 12) -> DataFrame:
    """``/a/b`` from the root, also through arrays; ``//key`` at any depth down to ``most_levels``. Variable ``matchingJSON``. What is no
    JSON has no nodes."""
    tree = files.select("path", F.try_parse_json("content").alias("node")).filter("node is not null")
    text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    if path.startswith("//"):
        found, level = None, tree
        for _ in range(most_levels):
            level = level.select("path", "node").lateralJoin(tree.sparkSession.tvf.variant_explode(F.col("node").outer())).select("path", "key", F.col("value").alias("node"))
            hits = level.filter(F.col("key") == path[2:]).select("path", text(F.col("node")).alias("value"))
            found = hits if found is None else found.unionAll(hits)
            level = level.filter(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)"))
        hits = found
    else:
        level = tree
        for key in path.strip("/").split("/"):
            items = level.lateralJoin(tree.sparkSession.tvf.variant_explode(F.col("node").outer())).select("path", "pos", "key", F.col("value").alias("node"))
            level = items.filter(F.col("key") == key).select("path", "node")
        hits = level.select("path", text(F.col("node")).alias("value"))
    return incidents(hits.filter("value is not null"), rule, "path", None, F.create_map(F.lit("matchingJSON"), F.col("value")))


def has_tags(tags: DataFrame, rule: str, wanted: list[str], key: str | None = None) -> DataFrame:
    """One incident without a file where every wanted tag is among ``tags(tag)``; with ``key``, one for each key that has them all."""
    wanted = sorted({*wanted})
    groups = [key] if key else []
    held = tags.filter(F.col("tag").isin(wanted)).groupBy(*groups).agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == len(wanted))
    return incidents(held, rule, F.col(key) if key else F.lit(None).cast("string"), None, F.create_map(F.lit("tags"), F.lit(",".join(wanted))))


def k8s_resources(files: DataFrame) -> DataFrame:
    """``(uri, doc_idx, api_version, api_line, kind, kind_line)`` for every document of YAML files."""
    docs = files.filter(F.regexp_like("path", F.lit(r"\.ya?ml$"))).select("path", F.posexplode(F.split("content", "(?m)^---.*$", -1)).alias("doc_idx", "doc"), "content")
    value = lambda k: F.regexp_extract("doc", rf"(?m)^{k}:\s*[\"']?([^\s\"'#]+)", 1)
    feeds = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    before = F.aggregate(F.slice(F.split("content", "(?m)^---.*$", -1), F.lit(1), F.col("doc_idx")), F.lit(0), lambda a, d: a + feeds(d))
    line = lambda k: before + feeds(F.regexp_extract("doc", rf"(?s)^(.*?)(?:^|\n){k}:", 1)) + F.when(F.col("doc").rlike(rf"^{k}:"), 1).otherwise(2)
    return docs.select(F.col("path").alias("uri"), "doc_idx", value("apiVersion").alias("api_version"), line("apiVersion").alias("api_line"), value("kind").alias("kind"), line("kind").alias("kind_line")).filter("api_version <> '' and kind <> ''")


def k8s_deprecated(resources: DataFrame, deprecations: DataFrame, target: str) -> DataFrame:
    """Resources whose (apiVersion, kind) is deprecated or removed in ``target``; versions in no valid form never are.

    ``deprecations`` is a rule table; the join is by hash on both names."""
    now = semver(F.lit(target))
    past = lambda c: F.coalesce(now >= semver(F.col(c)), F.lit(False))
    found = resources.join(deprecations, ["api_version", "kind"]).filter(past("deprecated_in") | past("removed_in")).dropDuplicates(["rule_id", "uri", "doc_idx"])
    variables = F.create_map(F.lit("apiVersion"), F.col("api_version"), F.lit("kind"), F.col("kind"), F.lit("replacementAPI"), F.coalesce("replacement", F.lit("")))
    return incidents(found, F.col("rule_id"), "uri", F.col("kind_line"), variables)


def dependency(deps: DataFrame, rule: str, name: str | None = None, name_regex: str | None = None, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Dependencies by exact name (the first of each file) or by regex (all), inside inclusive version bounds."""
    from pyspark.sql.window import Window as W

    hits = deps.filter(F.col("name") == name) if name else deps.filter(F.col("name").rlike(T.java(name_regex)))
    if name:
        hits = hits.withColumn("__n", F.row_number().over(W.partitionBy("file_uri").orderBy("version", "type", "resolved_id"))).filter("__n = 1").drop("__n")
    hits = hits.filter(within_bounds(F.col("version"), lower, upper))
    variables = F.create_map(F.lit("name"), F.col("name"), F.lit("version"), F.coalesce("version", F.lit("")))
    return incidents(hits, rule, "file_uri", None, variables)


def referenced(symbols: DataFrame, rule: str, pattern: str, location: str | None = None, annotated: tuple[str, dict[str, str]] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Symbols by type pattern and location; ``annotated``: an annotation's pattern and element name -> value regex; ``files``: only
    symbols of these paths. An import counts only for whole modules."""
    hits, location = symbols.filter(F.col("name").rlike(T.type_pattern(pattern))), known_location(location)
    if location:
        hits = hits.filter(F.col("location") == location)
        if location == "IMPORT":
            hits = hits.filter(F.col("kind") == "Module")
    if annotated:
        wanted, elements = annotated
        fits = lambda a: a["name"].rlike(T.type_pattern(wanted))
        hits = hits.filter(F.exists("annotations", lambda a: fits(a) & F.lit(True) if not elements else fits(a) & all_elements(a, elements)))
    if files is not None:
        hits = hits.join(files.select(F.col("path").alias("uri")).distinct(), "uri", "left_semi")
    variables = F.create_map(F.lit("name"), F.col("name"), F.lit("kind"), F.col("kind"), F.lit("file"), F.col("uri"))
    return incidents(hits, rule, "uri", F.col("start_line") + 1, variables)


def all_elements(annotation: Column, elements: dict[str, str]) -> Column:
    out = F.lit(True)
    for name, regex in elements.items():
        out = out & F.coalesce(F.try_element_at(annotation["elements"], F.lit(name)).rlike(T.java(regex)), F.lit(False))
    return out


def references(declarations: DataFrame, refs: DataFrame, rule: str, pattern: str, workspace: str, dependency_dirs: list[str]) -> DataFrame:
    """References to the declarations whose name matches, inside ``workspace`` and outside dependency folders, each once."""
    wanted = declarations.filter(F.col("name").rlike(T.symbol_regex(pattern))).select(F.col("symbol_id"))
    hits = refs.join(wanted.distinct(), "symbol_id", "left_semi").filter(T.within_base(F.col("uri"), workspace))
    for d in dependency_dirs:
        hits = hits.filter(~F.contains("uri", F.lit(f"/{d}/")))
    return incidents(hits.dropDuplicates(["uri", "line"]), rule, "uri", F.col("line") + 1, F.create_map(F.lit("file"), F.col("uri")))


def scoped_references(declarations: DataFrame, refs: DataFrame, rule: str, pattern: str, workspace: str, dependency_dirs: list[str]) -> DataFrame:
    """References by ``package/scope#name``: only declarations count whose URI holds ``package/scope``; without ``#`` the whole pattern is
    the name, and any declaration counts."""
    scope, mark, name = pattern.rpartition("#")
    wanted = declarations.filter(F.contains("uri", F.lit(scope))) if mark and scope else declarations
    return references(wanted, refs, rule, name, workspace, dependency_dirs)


def innermost_symbol(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each ``points(uri, line)``, the name of the shortest symbol range around it; points in no range have null.

    A join by file with a range condition, then a minimum, so no pairs leave the aggregation."""
    on = (points["uri"] == symbols["uri"]) & (points["line"] >= symbols["start_line"]) & (points["line"] <= symbols["end_line"])
    found = points.join(symbols, on, "left").groupBy(points["uri"], points["line"])
    span = F.struct((symbols["end_line"] - symbols["start_line"]).alias("span"), symbols["start_line"], symbols["name"])
    return found.agg(F.min(span)["name"].alias("symbol"))
