"""A table of symbols from source text: imports, declarations, calls and annotations, found by one pass of patterns over lines.

Names are as written in the source; types are not resolved. ``symbols(uri, name, kind, location, start_line, annotations)`` is what
``leaves.referenced`` searches; a table from a real language server has the same columns and serves as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.sources.files import lines

NAME = r"[A-Za-z_$][\w$]*"
DOTTED = rf"{NAME}(?:\.(?:{NAME}|\*))*"
#: By file extension: (kind, location, regex with the name as group 1).
PATTERNS: dict[str, list[tuple[str, str, str]]] = {
    "java": [
        ("Module", "IMPORT", rf"^\s*import\s+(?:static\s+)?({DOTTED})\s*;"),
        ("Package", "PACKAGE", rf"^\s*package\s+({DOTTED})\s*;"),
        ("Class", "TYPE", rf"\b(?:class|interface|enum|record)\s+({NAME})"),
        ("Class", "INHERITANCE", rf"\bextends\s+({DOTTED})"),
        ("Class", "IMPLEMENTS_TYPE", rf"\bimplements\s+({DOTTED})"),
        ("Constructor", "CONSTRUCTOR_CALL", rf"\bnew\s+({DOTTED})\s*[(<]"),
        ("Method", "METHOD_CALL", rf"({DOTTED})\s*\("),
        ("Annotation", "ANNOTATION", rf"@({DOTTED})"),
    ],
    "py": [("Module", "IMPORT", rf"^\s*(?:import|from)\s+({DOTTED})"), ("Class", "TYPE", rf"^\s*class\s+({NAME})"), ("Function", "METHOD", rf"^\s*def\s+({NAME})"), ("Function", "METHOD_CALL", rf"({DOTTED})\s*\(")],
    "go": [("Module", "IMPORT", r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$"), ("Struct", "TYPE", rf"^\s*type\s+({NAME})"), ("Function", "METHOD", rf"^\s*func\s+(?:\([^)]*\)\s*)?({NAME})"), ("Function", "METHOD_CALL", rf"({DOTTED})\s*\(")],
    "ts": [("Module", "IMPORT", r"(?:from|require\()\s*['\"]([^'\"]+)['\"]"), ("Class", "TYPE", rf"\b(?:class|interface)\s+({NAME})"), ("Function", "METHOD", rf"\bfunction\s+({NAME})"), ("Function", "METHOD_CALL", rf"({DOTTED})\s*\(")],
}
PATTERNS |= {"tsx": PATTERNS["ts"], "js": PATTERNS["ts"], "jsx": PATTERNS["ts"]}
#: Language names by extension.
LANGUAGES = {"java": "java", "py": "python", "go": "go", "ts": "typescript", "tsx": "typescriptreact", "js": "javascript", "jsx": "javascriptreact", "cs": "csharp", "rs": "rust", "xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml"}


# The names of symbol kinds 1 to 26 of the language server protocol, and the locations of a symbol.
KINDS = ("File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum", "Interface", "Function", "Variable", "Constant", "String", "Number", "Boolean", "Array", "Object", "Key", "Null", "EnumMember", "Struct", "Event", "Operator", "TypeParameter")
LOCATIONS = ("INHERITANCE", "METHOD_CALL", "CONSTRUCTOR_CALL", "ANNOTATION", "IMPLEMENTS_TYPE", "ENUM", "RETURN_TYPE", "IMPORT", "VARIABLE_DECLARATION", "TYPE", "PACKAGE", "FIELD", "METHOD", "CLASS")


def kind_name(number: Column) -> Column:
    """The name of a kind; no name for other numbers."""
    return F.coalesce(F.get(F.array(*map(F.lit, KINDS)), number - 1), F.lit(""))


def known_location(name: str | None) -> str | None:
    """A location in capitals; None, which is any, for an unknown one. A field's declaration is the field."""
    name = (name or "").upper()
    name = "FIELD" if name == "FIELD_DECLARATION" else name
    return name if name in LOCATIONS else None


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    out = F.lit("plaintext")
    for ext, language in LANGUAGES.items():
        out = F.when(extension(path) == ext, language).otherwise(out)
    return out


def annotation_elements(line: Column) -> Column:
    """The annotations that stand in a line: name and elements; ``@A("x")`` has the element ``value``."""
    whole = F.regexp_extract_all(line, F.lit(rf"@{DOTTED}(?:\([^)]*\))?"), 0)

    def parsed(a: Column) -> Column:
        name = F.regexp_extract(a, rf"^@({DOTTED})", 1)
        inner = F.regexp_extract(a, r"\((.*)\)$", 1)
        named = F.regexp_extract_all(inner, F.lit(r"(\w+)\s*=\s*(?:\"[^\"]*\"|[^,]+)"), 0)
        entry = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^\w+\s*=", "")), r"^\"|\"$", "").alias("value"))
        single = F.array(F.struct(F.lit("value").alias("key"), F.regexp_replace(F.trim(inner), r"^\"|\"$", "").alias("value")))
        entries = F.when(F.size(named) > 0, F.transform(named, entry)).when(inner != "", single).otherwise(F.slice(single, 1, 0))
        first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda o: o["key"]), e["key"]) == i + 1)
        return F.struct(name.alias("name"), F.map_from_entries(first).alias("elements"))

    return F.transform(whole, parsed)


def named(kind: str, location: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(location).alias("location"), x.alias("name"))


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of all files with a known extension, from one scan; lines count from 0. A declaration carries the annotations of
    its own line and of the line above."""
    from pyspark.sql.window import Window as W

    source = files.withColumn("ext", extension(F.col("path"))).filter(F.col("ext").isin(sorted(PATTERNS)))
    text = lines(source).withColumn("ext", extension(F.col("path")))
    above = F.lag("line").over(W.partitionBy("path").orderBy("line_no"))  # one file's lines
    text = text.withColumn("notes", F.concat(annotation_elements(F.coalesce(above, F.lit(""))), annotation_elements(F.col("line"))))
    found = []
    for ext, patterns in PATTERNS.items():
        for kind, location, regex in patterns:
            names = F.when(F.col("ext") == ext, F.regexp_extract_all("line", F.lit(regex), 1))
            found.append(F.transform(F.coalesce(names, F.array().cast("array<string>")), named(kind, location)))
    hits = text.select("path", "line_no", "notes", F.explode(F.concat(*found)).alias("s"))
    notes = F.when(F.col("s.location").isin("TYPE", "METHOD", "ANNOTATION"), F.col("notes")).otherwise(F.slice("notes", 1, 0))
    return hits.select(F.col("path").alias("uri"), "s.name", "s.kind", "s.location", (F.col("line_no") - 1).alias("start_line"), notes.alias("annotations"))
