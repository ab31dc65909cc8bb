import numpy as np
import pytest

from ruleframe.llm import embedding_dedup, queries
from ruleframe.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, id long, size long, cells string, component long"


def brute(rows, cosine=0.95):
    """(links, components) by the full matrix in double precision."""
    ids, x = [], []
    for i, v in rows:
        ok = i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)
        if ok:
            ids.append(i)
            x.append(np.array(v, dtype=np.float32).astype(np.float64))
    links, parent = {}, {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    if x:
        unit = np.stack(x)
        norm = np.sqrt((unit * unit).sum(1))
        near = (unit @ unit.T) / (norm[:, None] * norm[None, :]) >= cosine - 1e-12
        np.fill_diagonal(near, False)
        links = dict(zip(ids, near.sum(1).tolist(), strict=True))
        for a, b in zip(*np.nonzero(near), strict=True):
            p, q = sorted((find(ids[a]), find(ids[b])))
            parent[q] = p
    return links, {i: find(i) for i in ids}


def found(spark, rows, **options):
    full = [(i, v, 0, 1, 2, "c", 3) for i, v in rows]
    return embedding_dedup.near_vectors(spark.createDataFrame(full, SCHEMA).repartition(3), Scratch(spark, "test"), **options).collect()


def check(rows, out, recall=0.97):
    links, component = brute(rows)
    assert sorted((r["vec_id"] for r in out), key=repr) == sorted((i for i, _ in rows), key=repr)
    total = got = 0
    for r in out:
        wanted = links.get(r["vec_id"], 0)
        assert r["n_links"] <= wanted  # none below the threshold
        total, got = total + wanted, got + r["n_links"]
        assert r["kept"] == (r["vec_id"] == r["component_id"])
        assert r["vec_id"] is None or component.get(r["component_id"], r["component_id"]) == component.get(r["vec_id"], r["vec_id"])
    assert got >= recall * total
    same = sum(r["component_id"] == component.get(r["vec_id"], r["vec_id"]) for r in out)
    assert same >= recall * len(out)
    if got == total:  # no link is missing, and so no component may be wrong
        assert same == len(out)


def clustered(rng, n, dims=32):
    centres = rng.standard_normal((n // 6 + 1, dims))
    near = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dims)) * rng.choice([0.05, 0.15, 0.22, 0.3], (n, 1))
    return [(int(k) * 3 + 1, v.astype(np.float32).tolist()) for k, v in enumerate(near)]


def test_against_brute_force(spark):
    check(r := clustered(np.random.default_rng(1), 1500), found(spark, r))


def test_large_groups_of_copies_and_near_copies_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(32).astype(np.float32)
    rows = [(k, base.tolist()) for k in range(300)]
    rows += [(1000 + k, (base + 0.02 * rng.standard_normal(32)).astype(np.float32).tolist()) for k in range(500)]
    rows += clustered(rng, 300)[50:]
    rows = [(k, v) for k, (_, v) in enumerate(rows)]
    out = found(spark, rows, block_rows=60)
    check(rows, out)
    assert all(r["n_links"] == 799 and r["component_id"] == 0 for r in out if r["vec_id"] < 800)  # the group is whole; only borderline pairs may be missed


def test_a_star_around_the_largest_id_is_one_component(spark):
    turn = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found(spark, [(1, turn(15)), (2, turn(-15)), (5, turn(0))])}
    assert out == {1: (1, 1, True), 2: (1, 1, False), 5: (2, 1, False)}


def test_components_are_those_of_the_links_found(spark):
    # in stars of leaves at right angles around a centre a leaf links with its centre alone, so its count tells the links found
    rng = np.random.default_rng(4)
    rows, stars, at = [], [], 0
    for _ in range(60):
        axes = np.linalg.qr(rng.standard_normal((32, 6)))[0].T
        leaves = [np.cos(np.radians(15)) * axes[0] + np.sin(np.radians(15)) * x for x in axes[1:]]
        stars.append((range(at, at + 5), at + 5))
        rows += [(at + k, v.astype(np.float32).tolist()) for k, v in enumerate([*leaves, axes[0]])]
        at += 6
    out = {r["vec_id"]: r for r in found(spark, rows)}
    assert max(brute(rows)[0].values()) == 5
    for leaves, centre in stars:
        near = [k for k in leaves if out[k]["n_links"]]
        assert out[centre]["n_links"] == len(near)
        assert {k: out[k]["component_id"] for k in [*leaves, centre]} == {k: min(near) if k in near or (k == centre and near) else k for k in [*leaves, centre]}


@pytest.mark.parametrize("cosine", [0.9501, 0.96, 0.97])
def test_recall_of_planted_pairs(spark, cosine):
    """400 pairs at one cosine among as many vectors that are near nothing."""
    rng = np.random.default_rng(int(cosine * 1e4))
    rows = []
    for k in range(400):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        rows += [(2 * k, (3 * a).tolist()), (2 * k + 1, (cosine * a + np.sqrt(1 - cosine**2) * b).tolist()), (10_000 + k, rng.standard_normal(64).tolist())]
    out = found(spark, rows)
    linked = sum(r["n_links"] for r in out) / 800
    print(f"recall at {cosine}: {linked:.4f}")
    assert linked >= 0.95


def test_vectors_of_every_length(spark):
    rng = np.random.default_rng(5)
    rows = [(k, v) for k, (_, v) in enumerate(clustered(rng, 120, 16) + clustered(rng, 60, 8) + clustered(rng, 7, 3))]
    out = {r["vec_id"]: r for r in found(spark, rows)}
    for part in (rows[:120], rows[120:180], rows[180:]):
        check(part, [out[k] for k, _ in part], 0.9)


def test_unusable_vectors_link_with_nothing(spark):
    good = [1.0, 2.0, 3.0]
    rows = [(1, good), (2, good), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 3.0]), (6, [1.0, float("nan"), 3.0]), (7, [float("inf"), 2.0, 3.0]), (8, []), (9, [2.0, 4.0, 6.0]), (10, [-1.0, -2.0, -3.0]), (None, good), (2, good)]
    out = {r["vec_id"]: r for r in found(spark, rows)}
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in out.items() if i in (3, 4, 5, 6, 7, 8, 10)} == {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10)}
    assert out[9]["component_id"] == 1 and out[1]["n_links"] == 3 and out[None]["n_links"] == 0


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])]])
def test_few_rows(spark, rows):
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found(spark, rows)] == [(i, 0, i, True) for i, _ in rows]


def test_query_over_the_table(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check(rows, queries.QUERIES["op5_embedding_dedup"](spark, small).collect())
