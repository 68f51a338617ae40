"""SimHash, cover tree and components against brute force."""
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from coldlake.llm import covertree, simhash
from coldlake.llm.common import components


def least_reachable(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((60, 40), (60, 90), (200, 190)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 40)]
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        linked = {x for a, b in edges if a != b for x in (a, b)}
        want = least_reachable(range(n + 41), edges)
        assert got == {x: want[x] for x in linked}


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hash_is_sparks_own(spark):
    for s in ("", "a", "thé ünï", "x" * 100):
        assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] == simhash.signed(xxhash.xxh64_intdigest(s.encode(), 42))


def test_fingerprints_and_links_match_brute_force(spark, make_docs, edge_rows):
    rng = random.Random(5)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(150)]
    near = [(100 + k, " ".join(base[:k] + ["changed"] + base[k + 1:])) for k in range(40)]
    rows = edge_rows + near
    for limit in (simhash.PAIR_LIMIT, 2):  # 2: crowded blocks go through bit neighbours
        got = simhash.near_duplicates(make_docs(rows), pair_limit=limit).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
        fps = {(i, plain_fingerprint(t)) for i, t in rows}
        assert {(r["doc_id"], r["fp"] % 2**64) for r in got} == fps
        prints = {f for _, f in fps}
        group = least_reachable(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2])
        least = {}
        for i, f in fps:
            if i is not None:
                least[group[f]] = min(i, least.get(group[f], i))
        assert {(r["fp"] % 2**64, r["component_id"]) for r in got} == {(f, least.get(group[f])) for f in prints}
    assert len({r["component_id"] for r in got if r["doc_id"] and r["doc_id"] >= 100}) < 40


@pytest.mark.parametrize("blocks", [3, 4, 5])
def test_links_do_not_depend_on_blocks(spark, blocks):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(50)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)[:30]} | {f ^ 0b111 for f in list(fps)[:10]}
    prints = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = {tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in simhash.links(prints, 2, blocks).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 2}


def test_empty_table(spark, make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0


def vectors(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit(1) for c in ("node", "hash", "vec", "least", "ok", "block")}) if extra else df


def plain_links(rows, threshold):
    good = [(i, np.array(v, dtype=np.float32).astype(float), y) for i, v, y in rows
            if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for (i, a, y), (j, b, z) in itertools.combinations(good, 2):
        if y == z and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
            out.append((i, j))
    return out


def test_cover_tree_pairs_are_exact():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 16)), np.repeat(rng.normal(size=(5, 16)), 30, axis=0) + rng.normal(size=(150, 16)) * 0.2])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[::3] + rng.normal(size=x[::3].shape) * 0.05
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    for threshold in (0.5, 0.93, 0.999):
        u, v = covertree.close_pairs(covertree.CoverTree(x), covertree.CoverTree(y), threshold)
        assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(x @ y.T >= threshold).tolist()))


@pytest.mark.parametrize("block", [1024, 8])
def test_embedding_links_match_brute_force(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(size=8) * 0.18).astype(np.float32).tolist(), i % 2 if i % 12 < 8 else 7) for i in range(90)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, [2 * v for v in rows[0][1]], 0), (203, rows[0][1], None), (204, None, 0), (205, [0.0] * 8, 0),
             (206, [float("nan")] * 8, 0), (207, [None] * 8, 0), (208, [], 0), (209, [1.0, 2.0], 0), (210, [float("inf")] + [1.0] * 7, 0), (None, rows[0][1], 0), (202, [2 * v for v in rows[0][1]], 0)]
    plain = [(k, v, y) for k, (i, v, y) in enumerate(rows) if i is not None]
    edges = plain_links(plain, 0.93)
    ids = {k: rows[k][0] for k, _, _ in plain}
    group = least_reachable(list(ids), edges)
    low = {}
    for k, i in ids.items():
        low[group[k]] = min(i, low.get(group[k], i))
    want = sorted((i, sum(k in e for e in edges), low[group[k]], i == low[group[k]]) for k, i in ids.items())
    got = covertree.near_duplicates(vectors(spark, rows), block=block).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None) == want
    assert [(r["n_links"], r["component_id"]) for r in got if r["vec_id"] is None] == [(0, None)]


def test_links_of_a_crowd_over_many_blocks(spark):
    """Blocks meet in crews: a node of a crowd comes back once per crew pair, not once per block pair, and no link is lost."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=8) + rng.normal(size=(150, 8)) * 0.05, rng.normal(size=(150, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(3, 8, v.tolist(), i * 7919, i, 1) for i, v in enumerate(x)], "label int, dim int, vec array<double>, hash long, node long, n long")
    found = covertree.links(classes, block=4, crew=16).collect()
    close = x @ x.T >= 0.93
    others = {i: 0 for i in range(len(x))}
    for r in found:
        others[r["node"]] += r["others"]
    assert others == {i: int(close[i].sum()) - 1 for i in range(len(x))}
    assert close[:150, :150].sum() > 20_000 and len(found) < 150 * 20
    group = least_reachable(range(len(x)), np.argwhere(close).tolist())
    assert least_reachable(range(len(x)), [(r["node"], r["root"]) for r in found]) == group


def test_no_vectors(spark):
    assert covertree.near_duplicates(vectors(spark, [])).count() == 0
