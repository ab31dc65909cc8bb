"""Patterns, paths, templates and tags as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that make a path pattern more than a plain name.
WILD = "*?[]$^"
# Characters that make a pattern a regex, and HTML escapes.
#: Regex characters; a pattern without them is a literal.
META = ".*+?^$[]{}()|\\"
#: HTML escapes of a template value, in order of replacement.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def glob_to_regex(glob: str) -> str:
    """A shell pattern over one path: ``*`` and ``?`` stay inside a path component."""
    out = ""
    for c in glob:
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]" else re.escape(c)
    return f"^{out}$"


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def path_matches(path: Column, pattern: str) -> Column:
    """A file pattern: a plain name is the whole path or base name; otherwise a regex on ``/path`` or the base name, or, where
    the pattern is no regex, a glob."""
    rooted = F.concat(F.lit("/"), F.ltrim(path, F.lit("/")))
    if not any(c in pattern for c in WILD):
        pattern = f"^{pattern}$"
    try:
        re.compile(pattern)
    except re.error:
        glob = glob_to_regex(pattern)
        return path.rlike(glob) | base_name(path).rlike(glob)
    found = rooted.rlike(pattern) | base_name(path).rlike(pattern)
    if any(c in pattern for c in "*?") and not pattern.startswith("^"):
        glob = glob_to_regex(pattern)
        found = found | path.rlike(glob) | base_name(path).rlike(glob)
    return found


def within_base(path: Column, base: str) -> Column:
    """On or below ``base``, on a path boundary."""
    base = base.rstrip("/")
    return (path == base) | path.startswith(base + "/")


def normal_path(uri: Column) -> Column:
    """``file:`` URIs become paths: percent-decoded, back slashes turned, dots and doubled slashes cleaned; other schemes stay."""
    plain = F.regexp_replace(F.try_url_decode(F.regexp_replace(uri, r"\+", "%2B")), "^file:(//)?", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\\", "/"), "/+", "/"), r"(/\.)+(?=/|$)", "")
    return F.when(uri.rlike("^[a-zA-Z][a-zA-Z0-9+.-]+:") & ~uri.startswith("file:"), uri).otherwise(clean)


def relative_to(uri: Column, base: str) -> Column:
    """A file URI below ``base`` as a path relative to it; others stay."""
    base = base.rstrip("/")
    path = F.regexp_replace(uri, "^file:(//)?", "")
    return F.when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 1 << 30)).otherwise(uri)


def map_prefix(path: Column, mappings: list[tuple[str, str]]) -> Column:
    """The first mapping whose prefix ends on a path boundary rewrites it."""
    out = None
    for old, new in mappings:
        old = old.rstrip("/")
        moved = F.concat(F.lit(new.rstrip("/")), F.substring(path, len(old) + 1, 1 << 30))
        out = F.when(within_base(path, old), moved) if out is None else out.when(within_base(path, old), moved)
    return path if out is None else out.otherwise(path)


def escaped(value: Column) -> Column:
    for raw, safe in ESCAPES:
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def render(template: str, variables: Column, line: Column) -> Column:
    """``{{{name}}}`` puts a variable as it is, ``{{name}}`` HTML-escaped; unknown names are empty; ``lineNumber`` is the line."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\{\s*([\w.-]+)\s*\}\}\}|\{\{\s*([\w.-]+)\s*\}\}", template):
        name = m[1] or m[2]
        value = line.cast("string") if name == "lineNumber" else F.try_element_at(variables, F.lit(name))
        value = F.coalesce(value, F.lit(""))
        parts += [F.lit(template[at : m.start()]), value if m[1] else escaped(value)]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:])) if parts else F.lit(template)


def tags_of(tag: Column) -> Column:
    """``[Category=]a, b`` -> the tags without category; null where the string has another form."""
    good = tag.rlike(r"^(?:[\w \-()]+=)?[\w \-()]+(?:, *[\w \-(),]+)*,?$")
    bare = F.regexp_replace(tag, r"^[\w \-()]+=", "")
    return F.when(good, F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda x: x != ""))


def custom_variable(line: Column, pattern: str, default: str, group: str | None = None) -> Column:
    """A named group, else the only group, else the whole match, trimmed; ``default`` where nothing matches; null with two or
    more unnamed groups."""
    compiled = re.compile(pattern)
    index = compiled.groupindex.get(group) if group else None
    if index is None:
        if compiled.groups > 1:
            return F.when(line.rlike(java(pattern)), F.lit(None).cast("string")).otherwise(F.lit(default))
        index = min(compiled.groups, 1)
    return F.when(line.rlike(java(pattern)), F.trim(F.regexp_extract(line, java(pattern), index))).otherwise(F.lit(default))


def java(pattern: str) -> str:
    """``(?P<name>`` in the spelling that Spark's regular expressions know; ``.`` and ``$`` see line feeds only."""
    return "(?d)" + pattern.replace("(?P<", "(?<")


def compact_xml(xml: Column) -> Column:
    return F.trim(F.regexp_replace(xml, r">\s+<", "><"))


def whole_word(query: str) -> str:
    """A regex for ``query`` as a whole identifier of letters, digits, ``_``, ``$`` and ``#``."""
    quoted = query.replace("\\E", "\\E\\\\E\\Q")
    return rf"(?<![0-9A-Za-z_$#])\Q{quoted}\E(?![0-9A-Za-z_$#])"


def symbol_regex(query: str) -> str:
    """Symbol names: no regex characters means the whole name; case does not count."""
    return f"(?i)^{query}$" if not any(c in query for c in META) else f"(?i){query}"


def type_pattern(pattern: str) -> str:
    """A type or member pattern: ``*`` is any run of characters, ``?`` one; the rest is literal."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
