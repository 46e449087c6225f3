"""The interval join by levels against all pairs, and how many rows it makes."""

import random

import pytest

from tidewatch.operators import intervals as I

FORM = "k int, id int, start double, stop double"


def pairs(a, b, closed):
    meet = (lambda x, y: x[2] <= y[3] and x[3] >= y[2]) if closed else (lambda x, y: x[2] < y[3] and x[3] > y[2])
    return sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and None not in (*x[2:], *y[2:]) and meet(x, y))


@pytest.mark.parametrize("closed", [True, False])
def test_mixed_lengths_equal_all_pairs(spark, closed):
    rng = random.Random(3)

    def rows(n):
        out = []
        for i in range(n):
            start = round(rng.uniform(-500, 500), 1)
            out.append((i % 2, i, start, start + rng.choice([0.0, 0.5, 2.0, 8.0, 64.0, 3000.0])))
        return [*out, out[0], (0, n, None, 1.0), (1, n + 1, 5.0, None), (0, n + 2, float("-inf"), float("inf")), (1, n + 3, 4.0, float("inf")), (0, n + 4, 16.0, 16.0)]

    a, b = rows(120), rows(90)
    got = I.overlap_join(spark.createDataFrame(a, FORM), spark.createDataFrame(b, FORM), ["k"], closed)
    assert got.columns == ["k", "id", "start", "stop", "b_id", "b_start", "b_stop"]
    assert sorted((r.id, r.b_id) for r in got.collect()) == pairs(a, b, closed)
    empty = spark.createDataFrame([], FORM)
    assert I.overlap_join(empty, spark.createDataFrame(b, FORM), ["k"], closed).isEmpty()


def test_one_long_interval_makes_few_rows(spark):
    short = spark.range(20_000).selectExpr("1 AS k", "cast(id AS int) AS id", "cast(id AS double) * 3 AS start", "cast(id AS double) * 3 + 1 AS stop")
    both = short.unionByName(spark.createDataFrame([(1, -1, 0.0, 1e9)], FORM))
    lowest, of_a, of_b = I.level_plan(both, both)
    assert len(of_a) == len(of_b) == 2
    a, b = I.on_levels(both, lowest, of_b, 0), I.on_levels(both, lowest, of_a, 1)
    assert a.where("id = -1").count() <= 4 and b.where("id = -1").count() <= 8
    assert a.count() <= 5 * 20_001 and b.count() <= 7 * 20_001
    met = a.join(b.select("k", "_role", "_level", "_cell"), ["k", "_role", "_level", "_cell"]).count()
    assert met <= 8 * 20_001
    assert I.overlap_join(both, both, ["k"]).count() == 20_000 + 2 * 20_000 + 1
