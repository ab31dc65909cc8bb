import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ruleframe.llm import queries, sharding
from ruleframe.llm.common import Scratch
from tests.llm.rows import awkward, frame, sentence


def check(rows, out, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots, where, loads = defaultdict(list), defaultdict(set), Counter({k: 0 for k in range(shards)})
    for r in out:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        where[(r["text_crc32"], r["size"])].add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in where.values())  # equal texts share a shard
    return loads


@pytest.mark.parametrize("bucket_groups", [5, 2000])
def test_shards_hold_whole_groups_and_are_balanced(spark, bucket_groups, monkeypatch):
    rng = random.Random(5)
    rows = awkward(rng)[:9] + [(100 + k, sentence(rng, rng.randrange(1, 80))) for k in range(400)]
    rows += [(1000 + k, rows[50][1]) for k in range(30)]  # a group of copies
    monkeypatch.setattr(sharding, "partition_groups", (lambda f: lambda g, s, c: f(g, s, c, bucket_groups, 8))(sharding.partition_groups))
    out = sharding.shard_by_bytes(frame(spark, rows), Scratch(spark, "test"), 4).collect()
    loads = check(rows, out, 4)
    assert max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values())


def test_one_group_larger_than_a_fair_share(spark):
    rows = [(k, "the same text in many copies") for k in range(200)] + [(1000 + k, f"text {k}") for k in range(40)]
    loads = check(rows, sharding.shard_by_bytes(frame(spark, rows), Scratch(spark, "test"), 4).collect(), 4)
    rest = sorted(loads.values())[:-1]
    assert rest[-1] - rest[0] <= 16  # the others share what is left


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (1, "a"), (None, "")]])
def test_few_rows(spark, rows):
    check(rows, sharding.shard_by_bytes(frame(spark, rows, 1), Scratch(spark, "test"), 16).collect(), 16)


def test_differencing_against_the_sums_it_reports():
    rng = np.random.default_rng(1)
    parts = np.zeros((200, 5), dtype=np.int64)
    parts[:, 0] = rng.integers(1, 1000, 200)
    sums, places = sharding.difference(parts)
    again = np.zeros(5, dtype=np.int64)
    for row, to in zip(parts, places, strict=True):
        np.add.at(again, to, row)
        assert sorted(to) == [0, 1, 2, 3, 4]
    assert (again == sums).all() and sums.max() - sums.min() <= 2


def test_differencing_is_karmarkar_karp_on_a_textbook_case():
    parts = np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    sums, _ = sharding.difference(parts)
    assert sums.max() - sums.min() == 2  # greedy would leave 4


def test_query_over_the_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    loads = check(rows, queries.QUERIES["op3_sharding"](spark, small).collect(), 16)
    assert min(loads.values()) > 0
