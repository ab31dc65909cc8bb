"""Archives (jar, war, ear, zip) as tables of entries, with the coordinates that an archive carries or that its paths suggest."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVES = (".jar", ".war", ".ear", ".zip")
SCHEMA = "archive string, path string, depth int, content binary"


def walk(name: str, data: bytes, most_depth: int, most_bytes: int, depth: int = 0) -> Iterator[tuple[str, str, int, bytes]]:
    """Entries of one archive, and those of archives inside it, named ``outer!/inner``. What is no archive has no entries."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir() or info.file_size > most_bytes or ".." in info.filename.split("/"):
                    continue
                content = z.read(info)
                yield name, info.filename, depth, content
                if depth < most_depth and info.filename.lower().endswith(ARCHIVES):
                    yield from walk(f"{name}!/{info.filename}", content, most_depth, most_bytes, depth + 1)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
        return


def entries(archives: DataFrame, most_depth: int = 3, most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """``archives(path, content binary)`` -> ``(archive, path, depth, content)``; a task holds one archive at a time. Entries beyond
    ``most_bytes`` are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.binary())
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(walk(batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b"", most_depth, most_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["archive", "path", "depth", "content"])

    return archives.select("path", "content").mapInArrow(run, SCHEMA)


def read_archives(spark: SparkSession, base: str, **options) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return entries(files.filter(F.lower("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in ARCHIVES) + ")$")), **options)


def project_path(path: Column) -> Column:
    """Where an entry of a web archive lies in a source project: classes below the source root, pages below the web root; other
    entries keep their path, class files elsewhere have none."""
    inner = F.regexp_replace(path, "^(WEB-INF|BOOT-INF)/classes/", "")
    return (
        F.when(path.rlike(r"^(WEB-INF|BOOT-INF)/classes/.*\.class$"), F.concat(F.lit("src/main/java/"), F.regexp_replace(inner, r"\.class$", ".java")))
        .when(path.rlike("^(WEB-INF|BOOT-INF)/classes/"), F.concat(F.lit("src/main/resources/"), inner))
        .when(path.rlike("^(WEB-INF|BOOT-INF)/lib/"), F.lit(None).cast("string"))
        .when(path.rlike(r"\.(jsp|html?|css|js|xhtml)$"), F.concat(F.lit("src/main/webapp/"), path))
        .otherwise(path)
    )


def embedded_coordinates(found: DataFrame) -> DataFrame:
    """``(archive, name, version)`` from ``pom.properties`` entries."""
    text = F.decode("content", "UTF-8")
    value = lambda k: F.regexp_extract(text, rf"(?m)^\s*{k}\s*=\s*(\S+)", 1)
    poms = found.filter(F.regexp_like("path", F.lit(r"(^|/)pom\.properties$")))
    return poms.select("archive", F.concat_ws(".", value("groupId"), value("artifactId")).alias("name"), value("version").alias("version")).filter("name <> '.'")


def path_coordinate(path: Column) -> Column:
    """``/org/x/y/Z.class`` -> name ``org.x.y``, version 0.0.0: the directories as group and artifact."""
    folder = F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/?[^/]*$", "")
    return F.struct(F.replace(folder, F.lit("/"), F.lit(".")).alias("name"), F.lit("0.0.0").alias("version"))
