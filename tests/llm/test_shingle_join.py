import random

import numpy as np
import pytest

from ruleframe.llm import queries, shingle_join
from ruleframe.llm.common import Scratch
from tests.llm.rows import awkward, frame, sentence


def grams(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def brute(rows, n, share):
    sets = [grams(t, n) for _, t, *_ in rows]
    ids = [r[0] for r in rows]
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            if share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b]):
                p, q = sorted((find(ids[a]), find(ids[b])))
                parent[q] = p
    return sorted(((i, len(s), find(i)) for i, s in zip(ids, sets, strict=True)), key=repr)


def found(spark, rows, n, share, **options):
    return sorted((tuple(r) for r in shingle_join.near_documents(frame(spark, rows), Scratch(spark, "test"), n, share, **options).collect()), key=repr)


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(["new", "other", "else"]) + str(rng.randrange(50))
    return " ".join(words)


@pytest.mark.parametrize("n,share", [(4, (85, 100)), (5, (80, 100)), (2, (50, 100)), (1, (1, 1))])
def test_against_brute_force(spark, n, share):
    rng = random.Random(n)
    base = [sentence(rng, rng.randrange(20, 160)) for _ in range(12)]
    rows = awkward(rng) + [(100 + k, edited(rng, rng.choice(base), rng.choice([0, 1, 1, 2, 3]))) for k in range(150)]
    rows += [(900 + k, sentence(rng, rng.randrange(1, 7))) for k in range(40)]
    assert found(spark, rows, n, share) == brute(rows, n, share)


def test_large_groups_of_near_copies_and_common_passages(spark):
    rng = random.Random(6)
    base, common = sentence(rng, 120), sentence(rng, 30)
    rows = [(k, edited(rng, base, rng.choice([0, 1, 2, 4, 5]))) for k in range(140)]
    rows += [(500 + k, sentence(rng, rng.randrange(60, 100)) + " " + common) for k in range(80)]
    rows += [(800 + k, base) for k in range(50)]
    assert found(spark, rows, 4, (85, 100), block_rows=16) == brute(rows, 4, (85, 100))


def test_trie_finds_every_component():
    rng = random.Random(1)
    for _ in range(60):
        sets = [np.array(sorted(rng.sample(range(30), rng.randrange(1, 16))), dtype=np.uint64) for _ in range(25)]
        sides = np.array([rng.randrange(2) for _ in sets]) if rng.random() < 0.5 else None
        share = rng.choice([(1, 2), (4, 5), (2, 3)])

        def groups(links):
            parent = list(range(len(sets)))

            def find(a):
                while parent[a] != a:
                    a = parent[a]
                return a

            for a, b in links:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
            return [find(k) for k in range(len(sets))]

        near = lambda a, b: share[1] * len({*a.tolist()} & {*b.tolist()}) >= share[0] * len({*a.tolist()} | {*b.tolist()})  # noqa: E731, B023
        wanted = [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b]) and (sides is None or sides[a] != sides[b])]
        links = shingle_join.trie_links(sets, sides, share)
        assert groups(links) == groups(wanted)
        assert all(near(sets[a], sets[b]) for a, b in links)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b"), (1, "a b"), (None, "a b")]])
def test_few_rows(spark, rows):
    assert found(spark, rows, 4, (85, 100)) == brute(rows, 4, (85, 100))


def test_query_over_the_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op9_shingle_join"](spark, small).collect()), key=repr) == brute(rows, 4, (85, 100))


def test_lists_meet_their_groups_without_a_second_pass_over_the_texts(spark, monkeypatch):
    plans, keep = {}, Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and keep(self, df, name))
    rng = random.Random(7)
    rows = [(k, sentence(rng, 30)) for k in range(20)]
    rows += [(20 + k, rows[k][1] + " more") for k in range(10)]
    assert found(spark, rows, 4, (85, 100)) == brute(rows, 4, (85, 100))
    assert plans["members"].count("MapInArrow") == 1
