import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleframe.llm import line_dedup, queries
from ruleframe.llm.common import Scratch
from tests.llm.rows import awkward, frame, sentence


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(spark, rows, edits, least):
    """Walks all lines in order of (doc_id, text's hash, line number); a line goes when it is near any line before it."""
    df = spark.createDataFrame([(d, t) for d, t, *_ in rows], "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    docs = sorted({(r["doc_id"], r["text"], r["h"]) for r in df.collect() if r["text"] is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    lines = [(d, t, k, x.strip(" ")) for d, t, _ in docs for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[3]]
    gone, seen = {}, []
    # |histogram difference| <= 2 * distance: lines beyond that need no table
    distinct = {x: np.bincount([ord(c) % 64 for c in x], minlength=64) for x in {line for *_, line in lines}}
    histograms = np.zeros((len(distinct) + 1, 64), dtype=np.int64)
    for d, t, k, line in lines:
        near = np.flatnonzero(np.abs(histograms[: len(seen)] - distinct[line]).sum(1) <= 2 * edits)
        if any(line == seen[j] or (min(len(line), len(seen[j])) >= least and abs(len(line) - len(seen[j])) <= edits and distance(line, seen[j]) <= edits) for j in near):
            gone.setdefault((d, t), set()).add(k)
        if not any(line == seen[j] for j in near):
            histograms[len(seen)] = distinct[line]
            seen.append(line)
    out = []
    for d, t, *_ in rows:
        go = gone.get((d, t), set())
        out.append((d, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in go), len(go)))
    return sorted(out, key=repr)


def found(spark, rows, edits=2, least=20):
    out = line_dedup.dedup_lines(frame(spark, rows), Scratch(spark, "test"), edits, least)
    assert {"name", "row", "bucket", "line", "block"} <= {*out.columns}
    return sorted(((r["doc_id"], r["text"], r["lines_gone"]) for r in out.collect()), key=repr)


def typo(rng, line, n):
    for _ in range(n):
        k = rng.randrange(len(line))
        line = rng.choice([line[:k] + line[k + 1 :], line[:k] + rng.choice("xyzß") + line[k:], line[:k] + rng.choice("qvw") + line[k + 1 :]])
    return line


@pytest.mark.parametrize("edits,least", [(2, 20), (1, 12), (3, 24), (0, 4)])
def test_against_brute_force(spark, edits, least):
    rng = random.Random(edits)
    base = [sentence(rng, 5) for _ in range(12)]
    rows = [r for r in awkward(rng) if len(r[1] or "") < 3000]
    for k in range(40):
        rows.append((100 + k, "\n".join(typo(rng, rng.choice(base), rng.randrange(0, 4)) if rng.random() < 0.6 else sentence(rng, rng.randrange(1, 9)) for _ in range(5))))
    assert found(spark, rows, edits, least) == brute(spark, rows, edits, least)


def test_banded_distance_against_the_full_table(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(12, 30)))
        b = typo(rng, a, rng.randrange(0, 6))
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, b))
    for edits in (1, 2, 3):
        df = spark.createDataFrame([p for p in pairs if abs(len(p[0]) - len(p[1])) <= edits], "a string, b string").withColumn("near", line_dedup.within(F.col("a"), F.col("b"), edits))
        assert all(r["near"] == (distance(r["a"], r["b"]) <= edits) for r in df.collect())


def test_a_line_in_every_document_stays_once(spark):
    common = "this line stands in every document of all"
    rows = [(k, f"{common}\nown line number {k:06d} with much of its own {k * 7919:09d}") for k in range(300)]
    out = found(spark, rows)
    assert sum(common in t for _, t, _ in out) == 1 and out == brute(spark, rows, 2, 20)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, ""), (None, "a line that is long enough to count")]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == brute(spark, rows, 2, 20)


def test_main_path_is_native(spark, small, capsys):
    queries.QUERIES["op1_line_dedup"](spark, small).explain("extended")
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))


def test_stage_drops_only_documents_that_have_nothing_left(spark):
    line = "the same long line in two documents"
    rows = [(1, line, "en", "s"), (2, line, "en", "s"), (3, "short", "en", "s"), (4, None, "en", "s")]
    docs = frame(spark, rows)
    out = line_dedup.line_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, line, len(line)), (3, "short", 5)]


def test_query_over_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    out = {r["doc_id"]: r for r in queries.QUERIES["op1_line_dedup"](spark, small).collect()}
    assert {*out} == {r["doc_id"] for r in docs} and sum(r["lines_gone"] for r in out.values()) > 0


def test_short_lines_go_only_as_copies(spark):
    rows = [(1, "Share\n\nnext"), (2, "Share\nShore\n\n next "), (3, "text")]
    assert [(r[1], r[2]) for r in found(spark, rows)] == [("Share\n\nnext", 0), ("Shore\n", 2), ("text", 0)]
