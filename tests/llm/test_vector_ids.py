"""The vector join with repeated ids, several lengths, null ids and further columns."""

import numpy as np

from tidewatch.llm import vectorjoin


def plain(rows):
    """Links and smallest vec_id by row, from all pairs."""
    ok = [i is not None and v is not None and len(v) > 0 and any(v) for i, v in rows]
    u = [np.array(v, float) / np.linalg.norm(v) if o else None for (_, v), o in zip(rows, ok)]
    near = [[a != b and ok[a] and ok[b] and len(u[a]) == len(u[b]) and float(u[a] @ u[b]) >= 0.9 for b in range(len(rows))] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            new = [b for b in range(len(rows)) if near[x][b] and b not in seen]
            seen.update(new)
            todo += new
        low = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], sum(near[a]), low, rows[a][0] is None or rows[a][0] == low))
    return sorted(out, key=repr)


def test_repeated_ids_and_mixed_lengths(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 6))
    rows = [(i % 12, (base[i % 4] + 0.1 * rng.normal(size=6)).tolist()) for i in range(30)]
    rows += [(20 + i, [1.0, 2.0, 3.0 + 0.01 * i]) for i in range(5)] + [(30, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0]), (31, None), (32, [0.0, 0.0])] + [(33, [5.0, 1.0])] * 3
    table = spark.createDataFrame([(i, v, n, 0) for n, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, low long, _key int")
    got = vectorjoin.digest(table).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == plain(rows)


def test_distinct_ids_of_two_lengths(spark):
    rows = [(i, [1.0, 2.0, 3.0 + 0.01 * i]) for i in range(5)] + [(9, [1.0, 2.0, 3.0, 4.0])]
    got = vectorjoin.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == plain(rows)
