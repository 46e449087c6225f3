"""A near pair of the vector join is compared once in each block, whatever cells and parts it stands in."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tidewatch.llm import vectorjoin


def test_a_pair_meets_once_in_a_block(spark, monkeypatch):
    monkeypatch.setattr(vectorjoin, "CELL", 8)
    rng = np.random.default_rng(3)
    x = vectorjoin.unit(np.repeat(rng.normal(size=(30, 8)), 3, 0) + 0.15 * rng.normal(size=(90, 8)))
    plan = vectorjoin.Plan(x.T @ x, len(x), 0.9, 4)
    rows = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "id long, weight long, vector array<double>")
    met, cells = Counter(), {}
    for r in vectorjoin.assign(rows, spark.sparkContext.broadcast(plan)).collect():
        cells.setdefault((r.block, r.cell), []).append((r.id, r.home))
    for (block, _), group in cells.items():
        met.update((block, *sorted((a, b))) for (a, ha), (b, hb) in combinations(group, 2) if ha or hb)
    near = [(b, i, j) for i, j in combinations(range(len(x)), 2) for b, (p, q) in enumerate(zip(plan.parts(x[i : i + 1]), plan.parts(x[j : j + 1]))) if ((p - q) ** 2).sum() <= plan.budget[b]]
    assert len(near) > 100 and {met[k] for k in near} == {1} and set(met.values()) == {1}


@pytest.mark.parametrize("inner", [True, False])
def test_distances_in_blocks_equal_the_matrix(monkeypatch, inner):
    monkeypatch.setattr(vectorjoin, "ROWS", 16)
    monkeypatch.setattr(vectorjoin, "COLUMNS", 24)
    x = np.random.default_rng(4).normal(size=(131, 5)).astype(np.float32) / 3
    got = sorted((int(a), int(b)) for r, c in vectorjoin.within(x, 57, inner, 0.3) for a, b in zip(r, c))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert got == [(i, j) for i in range(57) for j in range(i + 1 if inner else 57, 131) if d[i, j] <= 0.3 + vectorjoin.SLACK]
