"""op13: packed products against plain ones, hard negatives against brute force."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldlake.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, id string, vec string, stripe string, crew string, anchor string, score string, place string, positives string, all string, pos string"


@pytest.mark.parametrize("most,kind,fields", [(200, np.int64, 2), (40, np.int64, 3), (2**30, object, 4), (2**61, object, 4), (0, np.int64, 63)])
def test_packed_products_are_exact(most, kind, fields):
    rng = random.Random(most)
    def draw(n):
        rows = [[rng.randint(-most, most) for _ in range(64)] for _ in range(n)]
        return np.array(rows, dtype=object if most > 2**62 else np.int64)
    a, c = draw(9), draw(101)
    packed = negatives.Packed(c, a)
    assert packed.kind is kind and packed.fields >= (fields if most else 1)
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in c] for p in a]
    assert [[int(x) for x in row] for row in packed.scores(a)] == want


def test_one_sided_components_and_no_candidates():
    a, c = np.array([[5, 7]], dtype=np.int64), np.array([[3, 3], [9, 4]], dtype=np.int64)
    assert negatives.Packed(c, a).scores(a).tolist() == [[36, 73]]
    none = np.zeros((0, 2), dtype=np.int64)
    assert negatives.Packed(none, a).scores(a).shape == (1, 0)


def plain(rows, k=5):
    best = {}
    for i, label, vec in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(256 * x) for x in vec):
            continue
        if i not in best or (label, [256 * x for x in vec]) < (best[i][0], [256 * x for x in best[i][1]]):
            best[i] = (label, vec)
    ok = {i: (label, [math.floor(256 * x) for x in vec]) for i, (label, vec) in best.items()}
    out = []
    for a in ok:
        if a % 10:
            continue
        label, v = ok[a]
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in ok.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if ok[i][0] == label][:k]:
            hits = [i for i in order if ok[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(hits[:k], 1)]
    return out


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, *["x"] * 10) for r in rows], SCHEMA).repartition(5)
    return [tuple(r) for r in negatives.mine(df, F.col("id") % 10 == 0, **kw).collect()]


def unit(rng, d=8):
    v = [rng.gauss(0, 1) for _ in range(d)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def test_negatives_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, 0 if k % 3 else rng.randrange(1, 4), unit(rng)) for k in range(400)]
    copied = unit(rng)
    rows += [(1000 + k, k % 3, copied) for k in range(150)]                      # ties across labels
    rows += [(2000, None, unit(rng)), (2010, 1, None), (2020, 1, [0.1, None]), (2030, 1, [float("nan")] * 8), (2040, 1, [float("inf")] * 8),
             (2050, 1, []), (2060, 2, [0.5, 0.25]), (2070, 1, [1e300] + [0.0] * 7), (None, 1, unit(rng)), (2080, 9, unit(rng)), (2090, 0, [0.0] * 8)]
    rows += [(10, 2, unit(rng)), (20, 0, unit(rng)), (20, 0, rows[20][2])]        # repeated ids
    finite = [r for r in rows if r[0] != 2070]
    assert sorted(mined(spark, finite, stripe=64, crew=16)) == sorted(plain(finite))
    assert sorted(mined(spark, finite)) == sorted(plain(finite))
    wide = [r for r in plain(rows) if max(abs(r[4]), abs(r[5])) < 2**63]
    assert sorted(r for r in mined(spark, rows, stripe=64, crew=16) if max(abs(r[4]), abs(r[5])) < 2**63 - 1) == sorted(wide)


def test_small_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, 1, [1.0, 0.0])]) == []
    assert mined(spark, [(10, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.0]), (3, 2, [0.5, 0.0])]) == [(10, 1, 1, 2, 65536, 58880)]


def test_ties_fill_no_more_than_k():
    s = np.full((3, 500), 7, dtype=np.int64)
    rows, cols = negatives.first_k(s, np.ones_like(s, dtype=bool), 5)
    assert rows.tolist() == [0] * 5 + [1] * 5 + [2] * 5 and cols.tolist() == [0, 1, 2, 3, 4] * 3
