import math
import random
from collections import Counter, defaultdict

import pytest

from ruleframe.llm import mixing, queries
from ruleframe.llm.common import Scratch
from tests.llm.rows import awkward, frame


def test_exponent_meets_the_entropy():
    tokens = [1000, 100, 10]
    a = mixing.find_exponent(tokens, bits=1.2)
    assert 0 < a < 1 and mixing.entropy(mixing.weights(tokens, a)) == pytest.approx(1.2, abs=1e-9)


def test_exponent_meets_the_repetition_limit():
    tokens, budget = [1000, 100, 10], 1110
    a = mixing.find_exponent(tokens, repeats=3.0, budget=budget)
    rates = [w * budget / t for w, t in zip(mixing.weights(tokens, a), tokens, strict=True)]
    assert max(rates) == pytest.approx(3.0, rel=1e-6)
    assert mixing.find_exponent([10, 10], repeats=2.0) == 0.0
    assert mixing.find_exponent([], repeats=2.0) == 0.0


def draw(spark, rows, **options):
    docs = frame(spark, rows).select("doc_id", "source", "text", "name", "bucket")
    from pyspark.sql import functions as F

    docs = Scratch(spark, "test").keep(docs.withColumn("words", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))), "docs")
    return mixing.draw(docs, F.col("words"), Scratch(spark, "test"), **options).collect()


def brute(rows, repeats, block_tokens, seed=17):
    """The same permutations and budgets, walked one document after another."""
    import hashlib

    tokens = lambda t: len((t or "").split())
    by = defaultdict(list)
    for d, t, _, s in rows:
        by[s or ""].append((d, tokens(t)))
    names = sorted(by)
    counts = [sum(n for _, n in by[x]) for x in names]
    shares = mixing.weights(counts, mixing.find_exponent(counts, repeats))
    whole = max((t / w for t, w in zip(counts, shares, strict=True) if t), default=0.0)
    goals = [math.floor(w * whole + 0.5) for w in shares]
    blocks = max(1, -(-sum(goals) // block_tokens))
    out = []
    for name, total, goal in zip(names, counts, goals, strict=True):
        at = 0
        for epoch in range(max(1, -(-goal // total)) if total else 1):
            place = lambda d: hashlib.md5(f"{seed}/{epoch}/{'' if d is None else d}".encode()).hexdigest()  # noqa: E731, B023
            for d, n in sorted(by[name], key=lambda x: (place(x[0]), x[0] is not None, x[0] or 0, x[1])):
                if at < goal or (epoch + 1) * total <= goal:
                    out.append((d, name, n, epoch, min(math.floor(at / max(goal, 1) * blocks), blocks - 1)))
                at += n
    return Counter(out)


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 40)), "en", "big" if k % 10 else "small") for k in range(300)]
    rows += [(d, t, None, s) for (d, t), s in zip(awkward(rng)[:6], [None, "", "small", "tiny", "tiny", "empty"], strict=True)]
    out = draw(spark, rows, repeats=2.0, block_tokens=500)
    assert Counter((r["doc_id"], r["source"] or "", r["__tokens"], r["__epoch"], r["__block"]) for r in out) == brute(rows, 2.0, 500)
    assert {d for d, *_ in rows} == {r["doc_id"] for r in out}  # nothing is left out
    assert max(Counter((r["doc_id"], r["source"]) for r in out if r["doc_id"] != 5).values()) <= 3


def test_budgets_are_met_within_a_document(spark):
    rows = [(k, "a b c d e", "en", "x" if k < 90 else "y") for k in range(100)]
    out = draw(spark, rows, repeats=4.0, budget=500)
    got = Counter()
    for r in out:
        got[r["source"]] += r["__tokens"]
    goal = dict(zip("xy", mixing.weights([450, 50], mixing.find_exponent([450, 50], 4.0, None, 500)), strict=True))
    assert all(abs(got[s] - goal[s] * 500) <= 5 for s in "xy")
    assert max(Counter(r["doc_id"] for r in out).values()) <= 4


def test_blocks_hold_all_sources_by_weight(spark):
    rows = [(k, "a b c d", "en", "x" if k < 600 else "y") for k in range(1000)]
    by = defaultdict(Counter)
    for r in draw(spark, rows, repeats=2.0, block_tokens=400):
        by[r["__block"]][r["source"]] += r["__tokens"]
    shares = [c["x"] / sum(c.values()) for c in by.values()]
    assert max(shares) - min(shares) < 0.1


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "a", None, "s"), (1, "a", None, "s")]])
def test_few_rows(spark, rows):
    assert Counter(r["doc_id"] for r in draw(spark, rows)) == Counter(r[0] for r in rows)


def test_query_keeps_every_document_and_numbers_slots(spark, small):
    out = queries.QUERIES["op4_mixing"](spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs}
    slots = defaultdict(list)
    for r in out:
        slots[r["block"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
