"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c are sqrt(2 - 2 c) apart. They are rotated to the principal axes and split into blocks; each block gets a part of the squared-distance budget
in proportion to its variance, and a pair within the whole budget is within the budget of one block at least. So each block is range-joined by itself, and
every pair found is verified exactly, in double precision, on the vectors as they came.

A block's space is cut by a few of its axes into cells. A vector is at home in one cell and its budget reaches others. Of two near vectors with different homes each reaches the
other's; of two cells just one is the host, so that only one of the two travels. A pair so meets once in each block. It counts in the first block that finds it, for both its vectors,
so that no pair is counted twice and none is sent anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, numbered, stored

COSINE, BLOCKS = 0.9, 4
#: Vectors at home in a cell on average, from which the number of axes that cut follows; so many at most meet so many visitors in one task.
CELL, HOME_ROWS, VISIT_ROWS = 8192, 16_384, 65_536
#: Rows and columns of one block of distances, which stays in a core's cache.
ROWS, COLUMNS = 512, 2048
#: Rounding of single-precision distances; candidates within it are verified like others.
SLACK = 1e-4
ASSIGNED = "block int, cell long, home boolean, id long, weight long, vector {}"
FOUND = "id long, links long, root long"


def usable(column: str):
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)


def vectors(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    y = x / top
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def moments(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of outer products of the unit vectors over all rows: size x size, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            u = unit(vectors(batch, "vector"))
            total += u.T @ u
        yield pa.RecordBatch.from_pydict({"i": np.arange(size * size), "x": total.ravel()})

    sums = rows.select("vector").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size * size)
    for r in sums:
        out[r[0]] = r[1]
    return out.reshape(size, size)


class Plan:
    """Rotation, blocks, budgets, and the axes that cut each block."""

    def __init__(self, moment: np.ndarray, n: int, cosine: float, blocks: int):
        size = len(moment)
        values, axes = np.linalg.eigh(moment)
        order = np.argsort(values)[::-1]
        blocks = min(blocks, size)
        # axes are dealt to the blocks in turn, so that each has some of the wide ones first
        self.columns = [order[b::blocks] for b in range(blocks)]
        self.axes = axes
        self.cosine = cosine
        share = np.array([max(values[c].sum(), 1e-12) for c in self.columns])
        self.budget = (2 - 2 * cosine) * share / share.sum()
        self.cuts = int(max(0, min(16, np.ceil(np.log2(max(1, n / CELL))))))

    def parts(self, u: np.ndarray) -> list[np.ndarray]:
        turned = u @ self.axes
        return [turned[:, c] for c in self.columns]

    def visits(self, part: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and whether at home, for each cell that the budget reaches. An axis cuts at 0; to cross a set of cuts costs the sum of the squared distances to them."""
        cuts = min(self.cuts, part.shape[1])
        row, cell, cost, home = np.arange(len(part)), np.zeros(len(part), np.int64), np.zeros(len(part)), np.ones(len(part), bool)
        for axis in range(cuts):
            x = part[row, axis]
            side = (x >= 0).astype(np.int64)
            over = cost + x * x
            go = over <= budget + SLACK
            row, cell, cost, home = (np.concatenate(p) for p in ((row, row[go]), (cell * 2 + side, cell[go] * 2 + 1 - side[go]), (cost, over[go]), (home, np.zeros(int(go.sum()), bool))))
        return row, cell, home


def hosts(home: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether vectors at home in one cell go to the other; of two different cells just one is the host, by turns the lower and the higher."""
    return (home > cell) == ((home + cell) % 2 == 1)


def assign(rows: DataFrame, plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                u = unit(vectors(part, "vector"))
                for b, x in enumerate(p.parts(u)):
                    row, cell, home = p.visits(x, p.budget[b])
                    own = np.empty(len(x), np.int64)
                    own[row[home]] = cell[home]
                    go = home | hosts(own[row], cell)
                    row, cell, home = row[go], cell[go], home[go]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), b, np.int32)), pa.array(cell), pa.array(home), part.column("id").take(take), part.column("weight").take(take), part.column("vector").take(take)], names=["block", "cell", "home", "id", "weight", "vector"])

    return rows.select("id", "weight", "vector").mapInArrow(run, ASSIGNED.format(dict(rows.dtypes)["vector"]))


def within(x: np.ndarray, rows: int, inner: bool, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs r < c of the vectors x, r among the first `rows`, c behind these or (inner) anywhere, whose squared distance is within the budget, or not more than SLACK above it."""
    norms, one = (x * x).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)
    left = np.concatenate((-2 * x[:rows], norms[:rows], one[:rows]), 1)
    # columns that fill up the last block are far from everything
    right = np.zeros((x.shape[1] + 2, -(-len(x) // COLUMNS) * COLUMNS), np.float32)
    right[-1] = 100
    right[:, : len(x)] = np.concatenate((x, one, norms), 1).T
    space, most = np.empty((ROWS, COLUMNS), np.float32), np.float32(budget + SLACK)
    for begin in range(0, len(x), COLUMNS):
        facing = np.ascontiguousarray(right[:, begin : begin + COLUMNS])
        for at in range(0, rows, ROWS):
            # inner pairs stand above the diagonal
            if begin + COLUMNS <= (at if inner else rows):
                continue
            part = left[at : at + ROWS]
            near = np.matmul(part, facing, out=space[: len(part)]) <= most
            eight = np.flatnonzero(near.view(np.uint64))
            if len(eight):
                i, bit = np.nonzero(near.reshape(-1, 8)[eight])
                r, c = np.divmod(eight[i] * 8 + bit, COLUMNS)
                r, c = r + at, c + begin
                keep = (r < c) & (inner | (c >= rows))
                if keep.any():
                    yield r[keep], c[keep]


def compare(plan):
    """Counts the links of a group's pairs for both vectors, and hangs each vector on the smallest id that links inside the group reach."""

    def run(key, table):
        p, b, inner = plan.value, int(key[0].as_py()), key[3].as_py() == 0
        batch = table.combine_chunks().to_batches()[0]
        # those at home first
        role = batch.column("role").to_numpy(zero_copy_only=False)
        batch = batch.take(pa.array(np.argsort(~role, kind="stable")))
        ids, weight = batch.column("id").to_numpy(), batch.column("weight").to_numpy()
        u = unit(vectors(batch, "vector"))
        single = u.astype(np.float32) @ p.axes[:, p.columns[b]].astype(np.float32)
        links, pairs = np.zeros(len(ids), np.int64), []
        for r, c in within(single, int(role.sum()), inner, p.budget[b]):
            for lo in range(0, len(r), 100_000):
                x, y = r[lo : lo + 100_000], c[lo : lo + 100_000]
                good = np.einsum("ij,ij->i", u[x], u[y]) >= p.cosine
                x, y = x[good], y[good]
                # only the first block within its budget counts a pair
                turned = (u[x] - u[y]) @ p.axes
                turned *= turned
                inside = np.stack([turned[:, k].sum(1) <= t for k, t in zip(p.columns, p.budget, strict=True)], 1)
                inside[:, -1] = True
                first = inside.argmax(1) == b
                x, y = x[first], y[first]
                np.add.at(links, x, weight[y])
                np.add.at(links, y, weight[x])
                pairs.append((x, y))
        x, y = (np.concatenate([q[i] for q in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
        root = ids.copy()
        while len(x):
            new = root.copy()
            np.minimum.at(new, x, root[y])
            np.minimum.at(new, y, root[x])
            if (new == root).all():
                break
            root = new
        tell = links > 0
        return pa.table({"id": ids[tell], "links": links[tell], "root": root[tell]})

    return run


def matched(same: DataFrame, size: int, n: int, cosine: float, blocks: int) -> DataFrame:
    """Links and the smallest id reached, from each group that a vector has links in. same: id, weight, vector; n distinct vectors of one length."""
    plan = same.sparkSession.sparkContext.broadcast(Plan(moments(same, size), n, cosine, blocks))
    cells = assign(same.select("id", "weight", "vector"), plan)
    rows_of = lambda c, most: F.greatest(F.lit(1), F.ceil(F.sum(F.col(c).cast("long")) / most)).cast("int")
    splits = stored(cells.select("block", "cell", "home", (~F.col("home")).alias("_away")).groupBy("block", "cell").agg(rows_of("home", HOME_ROWS).alias("_hs"), rows_of("_away", VISIT_ROWS).alias("_vs")))
    # a group (i, d) is the i-th part of those at home against the (i + d)-th and the d-th part of the visitors; in d = 0 those at home also meet each other
    dealt = cells.join(splits, ["block", "cell"]).withColumn("_p", F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("_hs")).otherwise(F.col("_vs"))).cast("int"))
    place = lambda i, d, role: F.struct(i.cast("int").alias("_i"), d.cast("int").alias("_d"), F.lit(role).alias("role"))
    p, hs = F.col("_p"), F.col("_hs")
    as_row = F.transform(F.sequence(F.lit(0), F.greatest(hs - p, F.col("_vs")) - 1), lambda d: place(p, d, True))
    as_column = F.when(p > 0, F.transform(F.sequence(F.lit(0), p - 1), lambda i: place(i, p - i, False))).otherwise(F.array().cast("array<struct<_i:int,_d:int,role:boolean>>"))
    as_visitor = F.transform(F.sequence(F.lit(0), hs - 1), lambda i: place(i, p, False))
    groups = dealt.select("block", "cell", "id", "weight", "vector", F.explode(F.when(F.col("home"), F.concat(as_row, as_column)).otherwise(as_visitor)).alias("_g"))
    groups = groups.select("block", "cell", "_g._i", "_g._d", "_g.role", "id", "weight", "vector")
    return stored(groups.groupBy("block", "cell", "_i", "_d").applyInArrow(compare(plan), FOUND))


def joined(rows: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vec_id, embedding; see digest()."""
    spark = rows.sparkSession
    # single-precision components stay so until a task computes with them; others become double
    rows = rows if dict(rows.dtypes)["embedding"] == "array<float>" else rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    fits = usable("embedding")
    good = rows.where(fits).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where("vec_id is not null")
    # equal vectors are one, with their number
    same = stored(good.withColumn("_key", F.xxhash64("vector")).groupBy("_key", "vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight")))
    counts = {r[0]: r[1] for r in same.groupBy(F.size("vector")).count().collect()}
    repeated = not same.groupBy("low").count().where("count > 1").isEmpty()
    # a vec_id that stands for several vectors does not name one: then a number does
    same = stored(numbered(same, [], ["_key", "vector"], "id", sum(counts.values()))) if repeated else same.withColumn("id", F.col("low"))
    met = spark.createDataFrame([], FOUND)
    for size, n in sorted(counts.items()):
        if n > 1:
            met = met.unionByName(matched(same.where(F.size("vector") == size), size, n, cosine, blocks))
    links = met.groupBy("id").agg(F.sum("links").alias("_links"))
    parts = components(same.select("id"), met.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    if repeated:
        lowest = same.select("id", "low").join(parts, "id").groupBy("component").agg(F.min("low").alias("_low"))
        parts = parts.join(lowest, "component").select("id", F.col("_low").alias("component"))
    classes = same.join(parts, "id").join(links, "id", "left").select("_key", "vector", "weight", F.coalesce("_links", F.lit(0)).alias("_links"), "component")
    base = rows.select(F.col("vec_id").alias("vec_id"), F.when(fits & F.col("vec_id").isNotNull(), F.col("embedding")).alias("vector")).withColumn("_key", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    out = base.join(classes, ["_key", "vector"], "left")
    component = F.coalesce(F.col("component"), F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce(F.col("_links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def digest(rows: DataFrame) -> DataFrame:
    """Per row of vec_id, embedding: n_links (other vectors of cosine COSINE or more), component_id (smallest vec_id that links reach), kept.

    A vector that is null, empty, zero, or that holds a null or non-finite component links with nothing; so does a row of a null vec_id. Vectors of different lengths never link; each
    length that several vectors have is a join of its own. Different vectors of one vec_id are vectors of their own, in row, links and component. Equal
    vectors are compared once and counted as often as they occur; repeated rows link with each other. Other columns are not looked at. An empty table gives no rows.
    """
    return joined(rows)
