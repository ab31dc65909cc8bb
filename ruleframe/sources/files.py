"""File and line tables."""

from __future__ import annotations

import codecs
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.functions import text as T

# Directories that hold no sources of a project's own.
#: Directories that are left out unless the configuration clears the list.
EXCLUDED_DIRS = ("node_modules", "vendor", ".git", "dist", "build", "target", ".venv", "venv")
#: Files beyond this many bytes are not read.
MOST_BYTES = 100 * 1024 * 1024


def in_excluded_dir(path: Column, more: list[str] | None = None) -> Column:
    """``more``: None keeps the default list, an empty list clears it, others add to it."""
    names = () if more == [] else EXCLUDED_DIRS + tuple(more or ())
    if not names:
        return F.lit(False)
    return path.rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in names) + ")(/|$)")


#: Charsets that Spark decodes itself.
NATIVE = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32")


def decoded(content: Column, charset: str) -> Column:
    """Text of ``content``; a file that ``charset`` cannot be read in is taken as UTF-8."""
    if charset.upper() in NATIVE:
        return F.decode(content, charset)

    @F.pandas_udf("string")
    def decode(contents: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            if data is None:
                return None
            try:
                return data.decode(charset)
            except UnicodeDecodeError:
                return data.decode("utf-8", "replace")

        return contents.map(one)

    codecs.lookup(charset)  # an unknown charset is an error here, not in a task
    return decode(content)


@dataclass(frozen=True)
class Scope:
    """Paths or patterns that a rule or the configuration includes and excludes."""

    included: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    def holds(self, path: Column, patterns: tuple[str, ...]) -> Column:
        """A pattern is a directory that holds the path, or the path or base name itself."""
        return reduce(lambda a, b: a | b, [T.within_base(path, p) | T.path_matches(path, p) for p in patterns])


def in_scope(path: Column, condition: tuple[str, ...] = (), rule: Scope = Scope(), provider: Scope = Scope()) -> Column:  # noqa: B008
    """Includes of all three narrow the search: those of the rule, or else of the configuration, and those of the condition. Excludes of
    the rule take the place of the configuration's."""
    out = F.lit(True)
    if included := rule.included or provider.included:
        out = out & rule.holds(path, included)
    if condition:
        out = out & rule.holds(path, condition)
    if excluded := rule.excluded or provider.excluded:
        out = out & ~rule.holds(path, excluded)
    return out


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """``(tag)`` of a YAML list; none for an empty file."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # a configuration file
    return spark.createDataFrame([(str(t),) for t in dict.fromkeys(yaml.safe_load(text) or [])], "tag string")


def read_tree(spark: SparkSession, base: str, charset: str = "UTF-8", excluded: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``(path, content, size)`` of the files below ``base``: paths relative, content decoded, line ends as line feeds.

    Size and directory filters act on file metadata, before content is decoded."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    root = base.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), f"^\\Q{root}\\E/", "")
    chosen = read.filter(F.col("length") <= most_bytes).withColumn("rel", path).filter(~in_excluded_dir(F.col("rel"), excluded))
    text = decoded(F.col("content"), charset)
    return chosen.select(F.col("rel").alias("path"), F.replace(text, F.lit("\r\n"), F.lit("\n")).alias("content"), F.col("length").alias("size"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return docs.select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.coalesce("n_chars", F.lit(0)).alias("size"))


def lines(files: DataFrame) -> DataFrame:
    """``(path, line_no, line)``, counted from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")
