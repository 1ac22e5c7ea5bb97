from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from veilscan.llm import linkage as L


def some_sets():
    rng = np.random.default_rng(1)
    sets = []
    for size in (1, 9, 130, 500, 1030, 3000):
        base = rng.integers(0, 2**64, size, np.uint64)
        for part in (0, 0.05, 0.11, 0.14, 0.2, 0.4):
            own = base.copy()
            own[: round(part * size)] = rng.integers(0, 2**64, round(part * size), np.uint64)
            sets.append(np.unique(own))
        sets.append(base[: max(1, size * 17 // 20)])
    return [np.unique(x) for x in sets]


def jaccard(x, y):
    both = len(np.intersect1d(x, y))
    return both / (len(x) + len(y) - both)


@pytest.mark.parametrize("percent", [80, 30])
def test_wide_sketches_lose_no_link(spark, percent):
    sets = some_sets()
    table = pa.table({"item": pa.array(range(len(sets)))} | L.sketch_columns(sets))
    sketches = spark.createDataFrame(table)
    pairs = list(combinations(range(len(sets)), 2))
    kept = {tuple(x) for x in L._closer(spark.createDataFrame(pairs, "a long, b long"), sketches, percent).collect()}
    linked = {(a, b) for a, b in pairs if jaccard(sets[a], sets[b]) * 100 >= percent}
    assert linked <= kept
    assert linked == {(a, b) for a, b in pairs if L.alike(sets[a], sets[b], percent)}
    if percent == 80:
        assert not [x for x in kept if jaccard(sets[x[0]], sets[x[1]]) < 0.65]


def test_members(spark):
    rows = [(1, 5), (1, 5), (2, 5), (2, 7), (2, 7), (2, 8), (3, 9)] + [(4, k) for k in range(300)]
    got = L.members(spark.createDataFrame(rows, "sig long, item long")).collect()
    assert sorted(map(tuple, got)) == [(2, 5), (2, 7), (2, 8)] + [(4, k) for k in range(300)]
