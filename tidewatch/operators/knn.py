"""Exact nearest neighbours in tiles of about equal row counts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidewatch.operators.joins import top_k
from tidewatch.session import cut, spread

#: Right rows of a tile, left rows that one task compares with a tile, and distances in one array.
TILE_ROWS, PART_ROWS, ARRAY_CELLS = 2048, 4096, 1 << 21


def knn_join(left: DataFrame, right: DataFrame, features: Sequence[str], k: int, group: str, left_id: str = "id", right_id: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """The k nearest right rows of other groups for every left row: left_id, rank, dist, right_id and the kept right columns (r_ prefix).

    Space is cut at quantiles, one feature inside the other, into tiles of about TILE_ROWS right rows. A left row's k-th distance inside its tile, or where other groups are rare the far
    corners of tiles that hold k of them, bounds its search: it visits the tiles whose boxes lie within, distances are arrays in their tasks, and only each visit's best k become rows.
    Of right rows at one place only those that can be among anyone's k are kept (the smallest 2k ids, k from a group), so copies do not crowd a tile. Ties go to the smaller id.
    Up to four features; rows without a group or with a feature that is null or not finite have no neighbours and are none.
    """
    d = len(features)
    if d > 4:
        raise ValueError("up to four features")
    x = [f"_x{i}" for i in range(d)]
    places = [F.col(f).cast("double").alias(c) for f, c in zip(features, x)]

    def placed(df: DataFrame) -> DataFrame:
        df = df.where(F.col("_g").isNotNull())
        for c in x:
            df = df.where(F.abs(c) < float("inf"))
        return df

    r = placed(right.select(F.col(right_id).alias("r_id"), F.col(group).alias("_g"), *places, *[F.col(c).alias(f"r_{c}") for c in keep]))
    r = top_k(r, [*x, "_g"], [F.col("r_id")], k, "_n").drop("_n")
    r = cut(top_k(r, x, [F.col("r_id")], 2 * k, "_n").drop("_n"))
    rows = placed(left.select(F.col(left_id).alias("_lid"), F.col(group).alias("_g"), *places))
    found = StructType([rows.schema["_lid"], r.schema["r_id"], *[r.schema[f"r_{c}"] for c in keep], StructField("dist", DoubleType())])
    cuts = tile_cuts(r, x, math.ceil((r.count() / TILE_ROWS) ** (1 / d)))
    r = cut(in_tiles(r, x, cuts))
    tiles = tile_table(r, x)
    rows = in_tiles(rows, x, cuts)

    def visits(a: pa.Table, b: pa.Table) -> pa.Table:
        return tiles_to_visit(a, b, x, k, tiles)

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, dist = best(a, b := b.take(pc.sort_indices(b, [("r_id", "ascending")])), x, k, a.column("_bound").to_numpy())
        return pa.table({"_lid": a.column("_lid").take(pa.array(i)), **{c: b.column(c).take(pa.array(j)) for c in ("r_id", *[f"r_{c}" for c in keep])}, "dist": dist})

    wanted = StructType([*[f for f in rows.schema.fields if f.name != "_t"], StructField("_t", LongType()), StructField("_bound", DoubleType())])
    asked = cut(beside(rows, r, visits, wanted))
    out = top_k(beside(asked, r, nearest, found), ["_lid"], [F.col("dist"), F.col("r_id")], k, "rank")
    return out.select(F.col("_lid").alias(left_id), "rank", "dist", "r_id", *[f"r_{c}" for c in keep])


def beside(rows: DataFrame, r: DataFrame, task, schema: StructType) -> DataFrame:
    """task(rows, right rows) for every tile that has rows, in parts of about PART_ROWS rows."""
    parts = rows.groupBy("_t").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("_parts"))
    a = rows.join(parts, "_t").withColumn("_p", F.pmod(F.xxhash64("_lid"), F.col("_parts")).cast("int")).drop("_parts")
    b = r.join(parts, "_t").withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    at = ["_t", "_p"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        # a hash may leave a part of a tile without rows
        return task(a, b) if a.num_rows else empty.empty_table()

    empty = to_arrow_schema(schema)
    return spread(a, *at).groupBy(*at).cogroup(spread(b, *at).groupBy(*at)).applyInArrow(run, schema)


def tile_numbers(at: Sequence[np.ndarray], cuts: Sequence[Mapping[int, np.ndarray]]) -> np.ndarray:
    """The tile of each place by the cut points found so far: one feature's for each tile of the features before it."""
    t = np.zeros(len(at[0]), np.int64)
    for v, by_tile in zip(at, cuts):
        inside = np.zeros(len(t), np.int64)
        for u in np.unique(t).tolist():
            mine = t == u
            inside[mine] = np.searchsorted(by_tile.get(u, ()), v[mine], "right")
        t = t * (1 + max((len(c) for c in by_tile.values()), default=0)) + inside
    return t


def in_tiles(df: DataFrame, x: Sequence[str], cuts: Sequence[Mapping[int, np.ndarray]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = tile_numbers([b.column(c).to_numpy() for c in x], cuts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t)], names=[*b.schema.names, "_t"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("_t", LongType())]))


def tile_cuts(r: DataFrame, x: Sequence[str], n: int) -> list[dict[int, np.ndarray]]:
    """For each feature the cut points into n parts, by tile of the features before it."""
    cuts: list[dict[int, np.ndarray]] = []
    if n > 1:
        for c in x:
            q = F.percentile_approx(c, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")
            cuts.append({row["_t"]: np.array(row["q"]) for row in in_tiles(r, x, cuts).groupBy("_t").agg(q).collect()})
    return cuts


def tile_table(r: DataFrame, x: Sequence[str]) -> dict[str, np.ndarray]:
    """By tile: number, box, rows, and the largest group with its rows."""
    g = r.groupBy("_t", "_g").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{s}{c}") for c in x for s, f in (("lo", F.min), ("hi", F.max))])
    t = g.groupBy("_t").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("_g", "n").alias("g"), *[f(f"{s}{c}").alias(f"{s}{c}") for c in x for s, f in (("lo", F.min), ("hi", F.max))])
    got = t.collect()
    out = {c: np.array([row[c] for row in got]) for c in ("_t", "n", "top", "g")}
    return out | {s: np.array([[row[f"{s}{c}"] for c in x] for row in got]).reshape(len(got), len(x)) for s in ("lo", "hi")}


def matrix(t: pa.Table, x: Sequence[str]) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy() for c in x])


def root(squares: Iterator[np.ndarray]) -> np.ndarray:
    total = 0.0
    for s in squares:
        total = total + s * s
    return np.sqrt(total)


def distances(a: pa.Table, b: pa.Table, x: Sequence[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances of some rows of a to all of b), infinite inside a group."""
    p, q, n = matrix(a, x), matrix(b, x), b.num_rows
    codes = np.unique(np.concatenate([t.column("_g").to_numpy(zero_copy_only=False) for t in (a, b)]), return_inverse=True)[1]
    own, other = codes[: len(p)], codes[len(p) :]
    step = max(1, ARRAY_CELLS // max(1, n))
    for at in range(0, len(p), step):
        d = root(p[at : at + step, i, None] - q[:, i] for i in range(len(x)))
        d[own[at : at + step, None] == other] = np.inf
        yield at, d


def kth(d: np.ndarray, k: int) -> np.ndarray:
    return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def best(a: pa.Table, b: pa.Table, x: Sequence[str], k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of a, row of b and distance of the k nearest rows of b in other groups that lie within the bound; the first rows of b win ties."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at, d in distances(a, b, x) if b.num_rows else ():
        i, j = np.nonzero((d <= np.minimum(kth(d, k), bound[at : at + len(d)])[:, None]) & (d < np.inf))
        dist = d[i, j]
        order = np.lexsort((j, dist, i))
        i, j, dist = i[order], j[order], dist[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[first] + at, j[first], dist[first]))
    return tuple(np.concatenate(c) for c in zip(*out))


def tiles_to_visit(a: pa.Table, b: pa.Table, x: Sequence[str], k: int, tiles: Mapping[str, np.ndarray]) -> pa.Table:
    """The rows of a once for each tile that can hold one of their k nearest, with the bound of their distance."""
    p, g, n = matrix(a, x), a.column("_g").to_numpy(zero_copy_only=False), len(tiles["_t"])
    bound = np.full(len(p), np.inf)
    for at, d in distances(a, b, x) if b.num_rows else ():
        bound[at : at + len(d)] = kth(d, k)
    step, rows, targets = max(1, ARRAY_CELLS // max(1, n)), [], []
    for at in range(0, len(p), step):
        q, limit = p[at : at + step], bound[at : at + step]
        largest = g[at : at + step, None] == tiles["g"]
        rest = tiles["n"] - tiles["top"]
        far = np.flatnonzero(limit == np.inf)
        if len(far) and n:
            # at least so many rows of other groups lie no farther than a tile's far corner
            others = np.where(largest[far], rest, np.maximum(tiles["top"], rest))
            corner = root(np.maximum(np.abs(q[far, i, None] - tiles["lo"][:, i]), np.abs(q[far, i, None] - tiles["hi"][:, i])) for i in range(len(x)))
            order = np.argsort(corner, axis=1)
            reached = np.cumsum(np.take_along_axis(others, order, 1), axis=1) >= k
            enough = reached.any(axis=1)
            limit[far[enough]] = np.take_along_axis(corner, order, 1)[enough, reached.argmax(axis=1)[enough]]
        near = root(np.maximum(0.0, np.maximum(tiles["lo"][:, i] - q[:, i, None], q[:, i, None] - tiles["hi"][:, i])) for i in range(len(x)))
        i, j = np.nonzero((near <= limit[:, None]) & ~(largest & (rest == 0)))
        rows.append(i + at)
        targets.append(tiles["_t"][j].astype(np.int64))
    i = np.concatenate(rows)
    return pa.table({**{c: a.column(c).take(pa.array(i)) for c in ("_lid", "_g", *x)}, "_t": np.concatenate(targets), "_bound": bound[i]})


def knn_residual(df: DataFrame, features: Sequence[str], value: str, group: str, k: int, row_id: str = "id") -> DataFrame:
    """Value minus the mean of its k nearest neighbours from other groups."""
    n = knn_join(df, df, features, k, group, row_id, row_id, keep=[value])
    m = n.groupBy(row_id).agg(F.avg(f"r_{value}").alias("_m"))
    return df.join(m, row_id).withColumn("residual", F.col(value) - F.col("_m")).drop("_m")
