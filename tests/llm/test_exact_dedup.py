import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ruleframe.llm import exact_dedup, queries
from ruleframe.llm.common import Scratch
from tests.compare import assert_same
from tests.llm.rows import awkward, frame, sentence


def brute(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    out = []
    for doc_id, text, *_ in rows:
        group = [r for r in rows if norm(r[1]) == norm(text)]
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        kept = (len(text or ""), doc_id) == (len(best[1] or ""), best[0])
        out.append((doc_id, best[0], len(group), kept, hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, block_chars):
    out = exact_dedup.exact_duplicates(frame(spark, rows), Scratch(spark, "test"), block_chars)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("block_chars", [1, 3, 64, 4096])
def test_against_brute_force(spark, block_chars):
    rng = random.Random(3)
    rows = awkward(rng) if block_chars > 3 else [r for r in awkward(rng) if len(r[1] or "") < 3000]
    base = [sentence(rng, 9) for _ in range(6)]
    rows += [(100 + k, rng.choice(base).replace(" ", rng.choice([" ", "  ", "\n"]))) for k in range(60)]
    assert found(spark, rows, block_chars) == brute(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\x0c\xa0", max_size=12)), min_size=1, max_size=12))
def test_any_texts(spark, texts):
    rows = [*enumerate(texts)]
    assert found(spark, rows, 2) == brute(rows)


def test_blocks_that_share_a_routing_hash_are_compared_by_text(spark, monkeypatch):
    from pyspark.sql import functions as F

    same = lambda *c: F.lit(7).cast("long")
    monkeypatch.setattr(exact_dedup, "blocks_of", (lambda f: lambda docs, n: f(docs, n).withColumn("hash", same()))(exact_dedup.blocks_of))
    rows = [(1, "abcabd"), (2, "abcabd"), (3, "abdabc"), (4, "abcabc"), (5, "abc abd")]
    assert found(spark, rows, 3) == brute(rows)


def test_empty_table(spark):
    assert found(spark, [], 8) == []


def test_query_matches_sql(spark, small):
    assert assert_same(queries.QUERIES["op2_exact_dedup"](spark, small), queries.SQL["op2_exact_dedup"], small)
