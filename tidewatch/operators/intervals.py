"""Interval algebra on keyed tables of (start, stop).

Questions of the form "does any interval touch this row" are answered by running maxima over the start order, so that no pairs
are built. Only operators whose result is the pairs themselves join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import cells_for, latest_before, scan
from tidewatch.session import cut, spread


def following(df: DataFrame, keys, order: str, value, out: str, n_cells=None) -> DataFrame:
    """The value of the next row of the key, NULL on the last one."""
    return scan(df, keys, order, running={out: ("last", value, False)}, descending=True, n_cells=n_cells)


def merge(df: DataFrame, keys: Sequence[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Union of the intervals of a key; touching intervals become one."""
    n = cells_for(df, keys)
    one = df.groupBy(*keys, F.col(start).alias("start")).agg(F.max(stop).alias("stop"))
    s = scan(one, keys, "start", running={"_reach": ("max", F.col("stop"), False)}, totals={"_end": ("max", F.col("stop"))}, n_cells=n)
    heads = s.where("_reach is null or start > _reach").select(*keys, "start", "_reach", "_end")
    heads = following(heads, keys, "start", F.col("_reach"), "_next", n)
    return heads.select(*keys, "start", F.coalesce("_next", "_end").alias("stop"))


def good_intervals(events: DataFrame, keys: Sequence[str], t: str, gap: float) -> DataFrame:
    """Stretches of events without a gap longer than ``gap``; a key with one event has none."""
    n = cells_for(events, keys)
    one = F.lit(1).cast("long")
    s = scan(events.select(*keys, t), keys, t, running={"_prev": ("last", F.col(t), False)}, totals={"_end": ("max", F.col(t)), "_n": ("sum", one)}, n_cells=n)
    heads = s.where((F.col("_n") > 1) & (F.col("_prev").isNull() | (F.col(t) - F.col("_prev") > gap)))
    heads = following(heads.select(*keys, F.col(t).alias("start"), "_prev", "_end"), keys, "start", F.col("_prev"), "_next", n)
    return heads.select(*keys, "start", F.coalesce("_next", "_end").alias("stop"))


def covered(df: DataFrame, keys: Sequence[str], n_sets, set_id: str = "set_id") -> DataFrame:
    """Where all interval sets of a key hold at once. n_sets: number of sets, an int or a column of df."""
    n = F.lit(n_sets) if isinstance(n_sets, int) else F.col(n_sets)
    cells = cells_for(df, keys)
    ends = df.select(*keys, n.alias("_n"), F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")),
                                                             F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    points = ends.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"), F.max("_n").alias("_n"))
    s = scan(points, keys, "at", running={"depth": ("sum", F.col("d"), True)}, n_cells=cells)
    s = following(s, keys, "at", F.col("at"), "_to", cells)
    return s.where((F.col("depth") == F.col("_n")) & (F.col("_to") > F.col("at"))).select(*keys, F.col("at").alias("start"), F.col("_to").alias("stop"))


def common_time(df: DataFrame, key: str, part: str, set_id: str) -> DataFrame:
    """Intersection of the sets of every part (file), then the union over the parts of a key."""
    n = df.groupBy(key, part).agg(F.countDistinct(set_id).alias("_k"))
    both = covered(df.join(n, [key, part]), [key, part], "_k")
    return merge(both, [key])


#: Width of a level's cells over that of the level below, and the level of intervals without a finite length: its one cell is the whole axis.
LEVEL_STEP, TOP_LEVEL = 4, 600


def _length() -> Column:
    return F.abs(F.col("stop") - F.col("start"))


def _level(lowest: int) -> Column:
    """The level whose cells are as long as the interval or longer."""
    finite = F.ceil(F.log(float(LEVEL_STEP), _length())).cast("int")
    return F.when(F.isnan(_length()) | (_length() == float("inf")), TOP_LEVEL).otherwise(F.greatest(F.lit(lowest), F.coalesce(finite, F.lit(lowest))))


def level_plan(a: DataFrame, b: DataFrame) -> tuple[int, list[int], list[int]]:
    """The lowest level, which follows from the longer of the median lengths, and the levels that either table has. A table of doubles has under 1,100 levels."""
    found = []
    for d in (a, b):
        levels = F.collect_set(F.when(F.col("start").isNotNull() & F.col("stop").isNotNull(), _level(-TOP_LEVEL)))
        found.append(d.agg(F.percentile_approx(F.when(_length() < float("inf"), _length()), 0.5).alias("m"), levels.alias("l")).first())
    lowest = math.ceil(math.log(max(1e-9, *[float(r["m"] or 0.0) for r in found]), LEVEL_STEP))
    return lowest, *[sorted({max(lowest, k) for k in r["l"]}) for r in found]


def on_levels(df: DataFrame, lowest: int, visits: list[int], role: int) -> DataFrame:
    """The rows once for each cell that they touch, with _role, _level, _cell.

    A row is at home on its own level, as a rule in at most two cells, and visits the higher levels among ``visits``. At home it carries its own role, as a visitor the
    other one. Rows of role 1 also meet each other's own level as visitors, so that two rows of one level meet once.
    """
    own = _level(lowest)
    levels = F.array(*[F.lit(k) for k in visits]).cast("array<int>")
    higher = F.filter(levels, lambda k: (k >= own) if role else (k > own))

    def cells(k: Column, r: int) -> Column:
        width = F.pow(F.lit(float(LEVEL_STEP)), k)
        lo, hi = F.floor(F.col("start") / width), F.floor(F.col("stop") / width)
        return F.transform(F.sequence(lo, hi), lambda c: F.struct(F.lit(r).alias("r"), k.cast("int").alias("k"), c.alias("c")))

    places = F.concat(cells(own, role), F.flatten(F.transform(higher, lambda k: cells(k, 1 - role))))
    return df.withColumn("_at", F.explode(places)).select("*", F.col("_at.r").alias("_role"), F.col("_at.k").alias("_level"), F.col("_at.c").alias("_cell")).drop("_at")


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], closed: bool = True) -> DataFrame:
    """All pairs of overlapping intervals of a key; the columns of b get the prefix b_.

    Every interval lives on the level of its own length and visits the longer levels that the other table has, so its copies grow with the number of levels and not with its length.
    A pair meets on the level of its longer interval only, in the cell of its later start. A crowded cell is an ordinary hot join key, which the adaptive skew join splits.
    Intervals with a null end or key meet nothing; those without a finite length meet on a level of their own.
    """
    lowest, levels_a, levels_b = level_plan(a, b)
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    right = on_levels(right.withColumns({"start": F.col("b_start"), "stop": F.col("b_stop")}), lowest, levels_a, 1).drop("start", "stop")
    j = on_levels(a, lowest, levels_b, 0).join(right, [*keys, "_role", "_level", "_cell"])
    if closed:
        hit = (F.col("start") <= F.col("b_stop")) & (F.col("stop") >= F.col("b_start"))
    else:
        hit = (F.col("start") < F.col("b_stop")) & (F.col("stop") > F.col("b_start"))
    home = F.floor(F.greatest("start", "b_start") / F.pow(F.lit(float(LEVEL_STEP)), F.col("_level")))
    return j.where(hit & (F.col("_cell") == home)).drop("_role", "_level", "_cell")


#: Rows of either side that one task compares at once, and rows of the left side in one array.
PART_ROWS, ARRAY_ROWS = 16_384, 64


def overlap_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], row_id: str, origin: str, tol: float) -> DataFrame:
    """Per row of a: how many intervals of b overlap it (closed), how many of these are of its own origin, and how many are of its origin or within ``tol`` degrees of its place.

    a: keys, row_id, origin, start, stop, ra, dec; b: the same without row_id. Rows without any overlap are left out, rows with a null among these columns meet nothing, and
    equal row_ids are counted together. Intervals meet on levels as in overlap_join(), but a cell's pairs are compared as arrays in its task and never become rows. Cells with more
    than PART_ROWS rows are dealt out in parts, so that memory is bounded; the comparisons still grow with the number of pairs.
    """
    place = [*keys, "_role", "_level", "_cell"]
    columns = [*[F.col(k).alias(k) for k in keys], F.col(origin).alias("_origin"), *[F.col(c).cast("double").alias(c) for c in ("start", "stop", "ra", "dec")]]

    a = cut(a.select(F.col(row_id).alias("_id"), *columns).dropna(subset=[*keys, "_origin", "start", "stop", "ra", "dec"]))
    b = cut(b.select(*columns).dropna())
    lowest, levels_a, levels_b = level_plan(a, b)

    def placed(df: DataFrame, visits: list[int], role: int) -> DataFrame:
        first = F.floor(F.col("start") / F.pow(F.lit(float(LEVEL_STEP)), F.col("_level")))
        d = on_levels(df, lowest, visits, role).withColumn("_home", first == F.col("_cell"))
        # the cell of a pair's later start is the one where both meet
        return d.where(first <= F.col("_cell"))

    left, right = placed(a, levels_b, 0), placed(b, levels_a, 1)

    def parts(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias(out))

    sizes = parts(left, "_na").join(parts(right, "_nb"), place)
    every = {n: F.explode(F.sequence(F.lit(0), F.col(f"_n{s}") - 1)) for n, s in (("_i", "a"), ("_j", "b"))}
    left = left.join(sizes, place).withColumn("_i", F.pmod(F.xxhash64("_id", "start", "stop"), F.col("_na")).cast("int")).withColumn("_j", every["_j"]).drop("_na", "_nb")
    right = right.join(sizes, place).withColumn("_j", F.pmod(F.xxhash64("_origin", "start", "stop"), F.col("_nb")).cast("int")).withColumn("_i", every["_i"]).drop("_na", "_nb")
    at = [*place, "_i", "_j"]

    def count(x: pa.Table, y: pa.Table) -> pa.Table:
        got = pair_counts(x, y, tol) if x.num_rows and y.num_rows else np.zeros((3, x.num_rows), np.int64)
        met = got[0] > 0
        return pa.table({"_id": x.column("_id").filter(pa.array(met)), **{f"n{i}": pa.array(got[i][met]) for i in range(3)}})

    schema = f"_id {a.schema["_id"].dataType.simpleString()}, n0 long, n1 long, n2 long"
    n = spread(left, *at).groupBy(*at).cogroup(spread(right, *at).groupBy(*at)).applyInArrow(count, schema)
    return n.groupBy(F.col("_id").alias(row_id)).agg(F.sum("n0").alias("n_any"), F.sum("n1").alias("n_same"), F.sum("n2").alias("n_in_view"))


def pair_counts(x: pa.Table, y: pa.Table, tol: float) -> np.ndarray:
    """(3, rows of x): overlaps, those of the same origin, and those of the same origin or in view, with the rows of y that meet them in one cell."""

    def arrays(t: pa.Table, keep: np.ndarray) -> dict[str, np.ndarray]:
        d = {c: t.column(c).to_numpy()[keep] for c in ("_origin", "start", "stop", "ra", "dec")}
        order = np.argsort(d["dec"], kind="stable")
        d = {c: v[order] for c, v in d.items()} | {"at": keep[order]}
        r, h = np.radians(d["ra"]), np.radians(d["dec"])
        return d | {"xyz": np.column_stack((np.cos(h) * np.cos(r), np.cos(h) * np.sin(r), np.sin(h)))}

    out = np.zeros((3, x.num_rows), np.int64)
    home_x, home_y = (t.column("_home").to_numpy(zero_copy_only=False) for t in (x, y))
    # of two rows that both started in earlier cells the pair belongs to one of those
    for rows, others in ((np.flatnonzero(home_x), np.arange(y.num_rows)), (np.flatnonzero(~home_x), np.flatnonzero(home_y))):
        if len(rows) and len(others):
            a, b = arrays(x, rows), arrays(y, others)
            by_origin = np.argsort(b["_origin"], kind="stable")
            b |= {"by_origin": by_origin, "origins": b["_origin"][by_origin], "starts": np.sort(b["start"]), "stops": np.sort(b["stop"])}
            forward = bool((a["start"] <= a["stop"]).all() and (b["start"] <= b["stop"]).all())
            for i in range(0, len(rows), ARRAY_ROWS):
                part = {c: v[i : i + ARRAY_ROWS] for c, v in a.items()}
                out[:, part["at"]] = array_counts(part, b, tol, forward)
    return out


def array_counts(a: dict[str, np.ndarray], b: dict[str, np.ndarray], tol: float, forward: bool) -> np.ndarray:
    """The three counts of a few rows, which like those of b are in order of declination. forward: no interval ends before it starts."""

    def hits(at: slice) -> np.ndarray:
        return (b["start"][at] <= a["stop"][:, None]) & (b["stop"][at] >= a["start"][:, None])

    def counted(m: np.ndarray) -> np.ndarray:
        return np.array([np.count_nonzero(r) for r in m])

    if forward:
        overlaps = np.searchsorted(b["starts"], a["stop"], "right") - np.searchsorted(b["stops"], a["start"], "left")
    else:
        overlaps = counted(hits(slice(None)))
    lo, hi = np.searchsorted(b["dec"], [a["dec"][0] - tol - 1e-6, a["dec"][-1] + tol + 1e-6])
    cosine, limit = a["xyz"] @ b["xyz"][lo:hi].T, np.cos(np.radians(min(tol, 180.0)))
    view, wide = cosine >= limit + 1e-12, cosine >= limit - 1e-12
    if np.count_nonzero(view) != np.count_nonzero(wide):
        # the last digits decide: the separation as it is defined
        i, j = np.nonzero(view ^ wide)
        (r1, d1), (r2, d2) = ((np.radians(t["ra"][k]), np.radians(t["dec"][k])) for t, k in ((a, i), (b, j + lo)))
        sep = np.degrees(np.arccos(np.clip(np.sin(d1) * np.sin(d2) + np.cos(d1) * np.cos(d2) * np.cos(r1 - r2), -1.0, 1.0)))
        view[i, j] = sep <= tol
    view &= hits(slice(lo, hi))
    first, last = (np.searchsorted(b["origins"], a["_origin"], side) for side in ("left", "right"))
    n = last - first
    i = np.repeat(np.arange(len(n)), n)
    j = b["by_origin"][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    own = (b["start"][j] <= a["stop"][i]) & (b["stop"][j] >= a["start"][i])
    i, j = i[own], j[own]
    seen = (j >= lo) & (j < hi)
    seen[seen] = view[i[seen], j[seen] - lo]
    same = np.bincount(i, minlength=len(n))
    return np.stack((overlaps, same, counted(view) + same - np.bincount(i[seen], minlength=len(n))))


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Common parts of the intervals of two sets."""
    j = overlap_join(a, b, keys, closed=False)
    return j.select(*keys, F.greatest("start", "b_start").alias("start"), F.least("stop", "b_stop").alias("stop")).where("stop > start")


def overlapping(rows: DataFrame, intervals: DataFrame, keys, start="start", stop="stop", closed: bool = True) -> DataFrame:
    """Flag ``hit`` on rows that overlap any interval of their key (closed: shared end points count)."""
    s = latest_before(rows, intervals, keys, stop, "start", {"_reach": ("max", "stop")}, strict=not closed)
    hit = F.col("_reach") >= F.col(start) if closed else F.col("_reach") > F.col(start)
    return s.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_reach")


def inside(points: DataFrame, intervals: DataFrame, keys, t: str) -> DataFrame:
    """Points t with start <= t < stop for any interval of their key."""
    s = latest_before(points, intervals, keys, t, "start", {"_reach": ("max", "stop")}, strict=False)
    return s.where(F.col("_reach") > F.col(t)).drop("_reach")


def outside(rows: DataFrame, exclusions: DataFrame, keys, start="start", stop="stop") -> DataFrame:
    """Rows that touch no exclusion (open overlap)."""
    return overlapping(rows, exclusions, keys, start, stop, closed=False).where("not hit").drop("hit")


def segments(intervals: DataFrame, length: float, grid: float | None = None, slack: float = 0.0) -> DataFrame:
    """Segments of fixed length inside intervals, from the interval start or from the first point of a grid."""
    first = F.col("start") if grid is None else F.ceil(F.col("start") / grid) * F.lit(float(grid))
    n = F.floor((F.col("stop") + F.lit(float(slack)) - first) / F.lit(float(length)))
    d = intervals.withColumns({"_first": first, "_n": n}).where("_n >= 1")
    d = d.withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return d.withColumn("t0", F.col("_first") + F.col("seg") * F.lit(float(length))).withColumn("t1", F.col("t0") + F.lit(float(length))).drop("_first", "_n")


def clean_segments(intervals: DataFrame, exclusions: DataFrame, keys, length: float, grid=None, slack: float = 0.0) -> DataFrame:
    """Segments flagged ``removed`` where they touch an exclusion; the grid runs on through exclusions."""
    s = overlapping(segments(intervals, length, grid, slack), exclusions, keys, "t0", "t1", closed=False)
    return s.withColumnRenamed("hit", "removed")


def capacity(intervals: DataFrame, keys, length: float) -> DataFrame:
    """Total good time and number of whole segments per key."""
    span = F.col("stop") - F.col("start")
    return intervals.groupBy(*keys).agg(F.sum(span).alias("good_time"), F.sum(F.floor(span / F.lit(float(length)))).alias("n_segments"))


def prefix_stop(intervals: DataFrame, keys, length: float, wanted: int) -> DataFrame:
    """Shortest time prefix per key that holds the wanted number of whole segments, NULL when the key is too short."""
    n = F.floor((F.col("stop") - F.col("start")) / F.lit(float(length)))
    s = scan(intervals, keys, "start", running={"_before": ("sum", n, False)}, totals={"total": ("sum", n)})
    here = (F.col("_before") < wanted) & (F.col("_before") + n >= wanted)
    cut = F.col("start") + (F.lit(wanted) - F.col("_before")) * F.lit(float(length))
    return s.groupBy(*keys).agg(F.max("total").alias("total"), F.max(F.when(here, cut)).alias("cutoff"))
