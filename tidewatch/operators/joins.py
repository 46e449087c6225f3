"""Joins by key, by position on the sphere, by interval and by distance."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import sep_deg
from tidewatch.operators.ordered import LIMIT_CONF, MAX_GROUP_ROWS, latest_before
from tidewatch.session import cut
from tidewatch.session import spread as spread_rows

#: Directions in which the width of a key's matches is taken; keys whose farthest pair is sought by one call.
AXES, FAR_KEYS = 16, 256


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Many-to-one join; a key repeated on the right raises instead of multiplying rows."""
    rest = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_b"))
    # the check stands in the join key, so that it holds whatever columns are used later
    ok = F.when(F.col("_n") == 1, F.col(keys[0])).otherwise(F.raise_error(F.lit("duplicate key on the right side")))
    return left.join(one.withColumn(keys[0], ok).drop("_n"), list(keys), how).select(*left.columns, "_b.*")


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left join with a default label for rows that find no partner."""
    j = left.join(right, list(keys), "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def reindex(df: DataFrame, order: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of ``order``; keys absent from df give NULLs."""
    return order.join(df, list(keys), "left")


def only_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keys_df.select(*keys).distinct(), list(keys), "left_semi")


def without_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keys_df.select(*keys).distinct(), list(keys), "left_anti")


def flag_join(left: DataFrame, right: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Multi-key left join that leaves only a true/false flag."""
    r = right.select(*keys).distinct().withColumn(flag, F.lit(True))
    return left.join(r, list(keys), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def cone_join(left: DataFrame, right: DataFrame, tol: float, left_tol: str | None = None) -> DataFrame:
    """All pairs of positions within a tolerance (degrees).

    Both sides carry id, ra, dec; the output has l_*, r_* and sep. The sphere is cut into declination bands and, within a band,
    into right-ascension cells at least one tolerance wide, so that a crowded band is spread. Each left row visits the
    neighbour cells; the exact separation decides.
    """
    height = max(tol, 1e-6) * 1.0001
    bands = int(math.ceil(180.0 / height))

    def band(dec):
        return F.floor((dec + 90.0) / height).cast("int")

    def cells(b):
        """Number of cells around a band: cell width covers the tolerance at the band edge nearer the pole, one band out."""
        edge = F.greatest(F.abs((b - 1) * height - 90.0), F.abs((b + 2) * height - 90.0))
        reach = F.sin(F.radians(F.lit(tol))) / F.cos(F.radians(F.least(edge, F.lit(89.999999))))
        width = F.degrees(F.asin(F.least(reach, F.lit(1.0)))) * 1.0001
        return F.when((edge >= 90.0 - 2 * tol) | (reach >= 0.7), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360.0 / width).cast("int")))

    def turn(ra):
        return F.pmod(ra, F.lit(360.0))

    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_b", band(F.col("r_dec")))
    r = r.withColumn("_c", F.least(F.floor(turn(F.col("r_ra")) / 360.0 * cells(F.col("_b"))).cast("int"), cells(F.col("_b")) - 1))
    lf = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("_b0", band(F.col("l_dec")))
    lf = lf.withColumn("_b", F.explode(F.sequence(F.greatest(F.col("_b0") - 1, F.lit(0)), F.least(F.col("_b0") + 1, F.lit(bands)))))
    n = cells(F.col("_b"))
    home = F.least(F.floor(turn(F.col("l_ra")) / 360.0 * n).cast("int"), n - 1)
    near = F.array_distinct(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.pmod(home + i, n)))
    lf = lf.withColumn("_c", F.explode(near))
    limit = F.col(f"l_{left_tol}") if left_tol else F.lit(float(tol))
    # a small table lies in one or two files: without the exchange one task would make all pairs
    j = spread_rows(lf, "_b", "_c").join(spread_rows(r, "_b", "_c"), ["_b", "_c"]).withColumn("sep", sep_deg("l_ra", "l_dec", "r_ra", "r_dec"))
    return j.where(F.col("sep") <= limit).drop("_b", "_b0", "_c")


def nearest(left: DataFrame, right: DataFrame, tol: float, left_tol: str | None = None, fine: int = 16) -> DataFrame:
    """The nearest right row of every left row within its tolerance; ties go to the smaller id.

    Right rows at one position are reduced to the smallest id. Crowded places are settled by a search of a fraction of the
    tolerance; only the rows left over search the full tolerance.
    """
    rest = [c for c in right.columns if c not in ("ra", "dec")]
    spots = right.groupBy("ra", "dec").agg(F.min_by(F.struct(*rest), "id").alias("_b")).select("ra", "dec", "_b.*")

    def best(rows, width):
        j = cone_join(rows, spots, width, None).where(F.col("sep") <= (F.col(f"l_{left_tol}") if left_tol else F.lit(float(tol))))
        cols = [c for c in j.columns if c != "l_id"]
        return j.groupBy("l_id").agg(F.min_by(F.struct(*cols), F.struct("sep", "r_id")).alias("_m")).select("l_id", "_m.*")

    near = best(left, tol / fine)
    far = best(left.join(near.select(F.col("l_id").alias("id")), "id", "left_anti"), tol)
    return near.unionByName(far)


def neighbour_counts(df: DataFrame, tol: float) -> DataFrame:
    """Number of other rows within the tolerance, 0 included. Rows at one position are counted as one weighted spot."""
    spots = df.groupBy("ra", "dec").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("id"))
    pairs = cone_join(spots, spots, tol)
    near = pairs.groupBy(F.col("l_ra").alias("ra"), F.col("l_dec").alias("dec")).agg((F.sum("r_w") - 1).alias("n_near"))
    return df.join(near, ["ra", "dec"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def ambiguous(matches: DataFrame, key: str, cls: str, ra: str, dec: str, spread: float, salt: str, n_salts: int | None = None,
              centre: tuple[str, str, str] | None = None) -> DataFrame:
    """Matches per key: number of classes, largest separation of two matches, and whether the key is rejected.

    centre: columns with the position of the key itself and a match's separation from it, where the matches have them (see far_pairs). Without them:
    the two farthest points are corners of the convex hull. Every batch is reduced to the hulls of its keys inside the map stage, then
    every (key, salt), then every key, before the few corners are paired. Positions of one key must lie within a hemisphere.
    """
    if centre:
        return _ambiguous_around(matches, key, cls, ra, dec, spread, salt, centre)
    n_salts = n_salts or int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = matches.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(cls).alias("n_cls"), F.first(F.struct(ra, dec)).alias("_o"))
    pts = matches.select(key, ra, dec, F.pmod(F.xxhash64(salt), F.lit(n_salts)).alias("_s")).join(counts.select(key, "_o"), key)
    plane = _gnomonic(pts, ra, dec)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plane.schema.fields)

    def by_batch(parts):
        for part in parts:
            yield pd.concat([_hull(g) for _, g in part.groupby(key)]) if len(part) else part

    corners = plane.mapInPandas(by_batch, schema).groupBy(key, "_s").applyInPandas(_hull, schema)
    corners = corners.withColumn("_s", F.lit(0).cast("long")).groupBy(key, "_s").applyInPandas(_hull, schema).select(key, ra, dec)
    other = corners.select(key, F.col(ra).alias("_ra2"), F.col(dec).alias("_dec2"))
    far = corners.join(other, key).groupBy(key).agg(F.max(sep_deg(ra, dec, "_ra2", "_dec2")).alias("extent"))
    g = counts.drop("_o").join(far, key)
    g = g.withColumn("extent", F.when(F.col("n") > 1, F.col("extent")).otherwise(F.lit(0.0)))
    return g.withColumn("rejected", (F.col("n_cls") > 1) | (F.col("extent") > spread))


def _ambiguous_around(matches: DataFrame, key: str, cls: str, ra: str, dec: str, spread: float, salt: str, centre: tuple[str, str, str]) -> DataFrame:
    """ambiguous with known centres. A match can only be one of the two farthest if its distance from the centre and the largest such distance reach a lower bound of the extent.

    The bound is the widest range of a key's matches along AXES directions of the plane that touches the sphere at the centre: sums of one pass, so that few matches leave it.
    """
    c_ra, c_dec, sep = centre
    a, d, d0 = F.radians(F.col(ra)) - F.radians(F.col(c_ra)), F.radians(F.col(dec)), F.radians(F.col(c_dec))
    flat = matches.select(key, cls, sep, (F.cos(d) * F.sin(a)).alias("_x"), (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)).alias("_y"))
    along = [F.col("_x") * math.cos(math.pi * i / AXES) + F.col("_y") * math.sin(math.pi * i / AXES) for i in range(AXES)]
    by_class = cut(flat.groupBy(key, cls).agg(F.count(F.lit(1)).alias("n"), F.max(sep).alias("_far"), *[F.max(w).alias(f"_h{i}") for i, w in enumerate(along)], *[F.min(w).alias(f"_l{i}") for i, w in enumerate(along)]))
    counts = by_class.groupBy(key).agg(F.sum("n").alias("n"), F.count(cls).alias("n_cls"), F.max("_far").alias("_far"),
                                       *[F.max(f"_h{i}").alias(f"_h{i}") for i in range(AXES)], *[F.min(f"_l{i}").alias(f"_l{i}") for i in range(AXES)])
    width = F.greatest(*[F.col(f"_h{i}") - F.col(f"_l{i}") for i in range(AXES)])
    bound = F.degrees(2.0 * F.asin(F.least(width / 2.0, F.lit(1.0))))
    counts = cut(counts.select(key, "n", "n_cls", (bound - F.col("_far") - 1e-5).alias("_least")))
    rim = matches.join(counts.select(F.col(key).alias("_key"), "_least", "n"), (F.col(key) == F.col("_key")) & (F.col(sep) >= F.col("_least"))).select(key, ra, dec, salt, "n")
    limit = int(matches.sparkSession.conf.get(LIMIT_CONF, str(MAX_GROUP_ROWS)))
    extent = far_pairs(rim.where(F.col("n") <= limit), key, ra, dec, max(1, -(-counts.count() // FAR_KEYS)))
    if counts.where(F.col("n") > limit).limit(1).count():
        hot = ambiguous(rim.where(F.col("n") > limit).withColumn("_cls", F.lit(0)), key, "_cls", ra, dec, spread, salt)
        extent = extent.unionByName(hot.select(key, "extent"))
    g = counts.join(extent, key).withColumn("extent", F.when(F.col("n") > 1, F.col("extent")).otherwise(F.lit(0.0)))
    return g.select(key, "n", "n_cls", "extent", ((F.col("n_cls") > 1) | (F.col("extent") > spread)).alias("rejected"))


def far_pairs(points: DataFrame, key: str, ra: str, dec: str, n: int) -> DataFrame:
    """(key, extent): the largest separation of two points of a key, itself included; a task compares the points of one key after the other."""
    kind = dict(points.dtypes)[key]

    def farthest(part: pa.Table) -> pa.Table:
        part = part.sort_by(key)
        keys = part.column(key).to_pandas()
        lon, lat = np.radians(part.column(ra).to_numpy()), np.radians(part.column(dec).to_numpy())
        xyz = np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
        starts = np.flatnonzero((keys != keys.shift()).to_numpy())
        one, two = [], []
        for a, z in zip(starts, np.append(starts[1:], len(keys)), strict=True):
            best = (-1.0, a, a)
            for lo in range(a, z, 1024):
                gap = 1.0 - xyz[lo : min(lo + 1024, z)] @ xyz[lo:z].T
                i, j = np.unravel_index(gap.argmax(), gap.shape)
                best = max(best, (float(gap[i, j]), lo + int(i), lo + int(j)))
            one.append(best[1])
            two.append(best[2])
        first, second = part.take(pa.array(one)), part.take(pa.array(two))
        return pa.table({key: first.column(key), "_ra": first.column(ra), "_dec": first.column(dec), "_ra2": second.column(ra), "_dec2": second.column(dec)})

    dealt = points.select(key, ra, dec, F.pmod(F.xxhash64(key), F.lit(n)).alias("_part"))
    pairs = dealt.groupBy("_part").applyInArrow(farthest, f"`{key}` {kind}, _ra double, _dec double, _ra2 double, _dec2 double")
    return pairs.select(key, sep_deg("_ra", "_dec", "_ra2", "_dec2").alias("extent"))


def _gnomonic(pts: DataFrame, ra: str, dec: str) -> DataFrame:
    """Project around one reference position per row (_o), which turns great circles into straight lines."""
    a, d = F.radians(F.col(ra)) - F.radians(F.col(f"_o.{ra}")), F.radians(F.col(dec))
    d0 = F.radians(F.col(f"_o.{dec}"))
    depth = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    x, y = F.cos(d) * F.sin(a) / depth, (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / depth
    return pts.withColumns({"_x": x, "_y": y}).drop("_o")


def _hull(part):
    """Corner rows of the planar convex hull of one part."""
    part = part.drop_duplicates(["_x", "_y"]).sort_values(["_x", "_y"])
    if len(part) < 4:
        return part
    xy = part[["_x", "_y"]].to_numpy()

    def chain(rows):
        keep = []
        for i in rows:
            while len(keep) > 1:
                (ax, ay), (bx, by) = xy[keep[-2]], xy[keep[-1]]
                if (bx - ax) * (xy[i, 1] - ay) - (by - ay) * (xy[i, 0] - ax) > 0:
                    break
                keep.pop()
            keep.append(i)
        return keep

    corners = sorted(set(chain(range(len(xy)))) | set(chain(range(len(xy) - 1, -1, -1))))
    return part.iloc[corners]


def interp_join(df: DataFrame, x: str, grid: DataFrame, gx: str, gy: Sequence[str]) -> DataFrame:
    """Piecewise-linear interpolation in a grid, clamped at its ends.

    The grid may have any length: two ordered scans bracket each x. A null x gives null; at a grid point that is repeated one of its rows decides.
    """
    g = grid.select(F.col(gx).cast("double").alias("_gx"), *[F.col(c).cast("double").alias(c) for c in gy]).where("_gx is not null")
    g = g.groupBy("_gx").agg(F.min(F.struct(*gy)).alias("_v")).select("_gx", "_v.*")
    packed = g.withColumn("_k", F.lit(0)).withColumn("_p", F.struct("_gx", *gy)).withColumn("_neg", -F.col("_gx"))
    d = df.withColumn("_k", F.lit(0)).withColumn("_nx", -F.col(x))
    d = latest_before(d, packed.select("_k", "_gx", "_p"), ["_k"], x, "_gx", {"_a": ("last", "_p")}, strict=False)
    d = latest_before(d, packed.select("_k", "_neg", "_p"), ["_k"], "_nx", "_neg", {"_b": ("last", "_p")}, strict=False)
    a, b = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    frac = F.coalesce(F.try_divide(F.col(x) - a["_gx"], b["_gx"] - a["_gx"]), F.lit(0.0))
    d = d.withColumn("_f", F.when(F.col(x).isNotNull(), frac))
    return d.withColumns({c: a[c] + (b[c] - a[c]) * F.col("_f") for c in gy}).drop("_k", "_nx", "_a", "_b", "_f")


def fractional_rebin(df: DataFrame, keys: Sequence[str], lo: str, hi: str, value: str, err: str, edges: Sequence[float]) -> DataFrame:
    """Move channel values to new bins by overlap share: sum(w v), error sqrt(sum(w^2 e^2))."""
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"))
                     for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))])
    hit = F.filter(bins, lambda s: (s["a"] < F.col(hi)) & (s["b"] > F.col(lo)))
    d = df.withColumn("_s", F.explode(hit))
    share = (F.least(F.col(hi), F.col("_s.b")) - F.greatest(F.col(lo), F.col("_s.a"))) / (F.col(hi) - F.col(lo))
    d = d.withColumn("_w", share)
    return d.groupBy(*keys, F.col("_s.bin").alias("bin")).agg(
        F.sum(F.col("_w") * F.col(value)).alias(value), F.sqrt(F.sum(F.pow(F.col("_w") * F.col(err), 2.0))).alias(err))


def fold_response(flux: DataFrame, response: DataFrame, keys: Sequence[str], energy: str, channel: str, value: str, flux_col: str) -> DataFrame:
    """Vector times sparse matrix: sum over energy bins of flux x response, per channel."""
    j = flux.join(response, energy)
    return j.groupBy(*keys, channel).agg(F.sum(F.col(flux_col) * F.col(value)).alias("folded"))


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, label: str, atol: float) -> DataFrame:
    """One row: largest difference, label changes, keys missing on either side, and whether the runs agree."""
    x = a.select(*keys, F.col(value).alias("_va"), F.col(label).alias("_la"), F.lit(1).alias("_ina"))
    y = b.select(*keys, F.col(value).alias("_vb"), F.col(label).alias("_lb"), F.lit(1).alias("_inb"))
    j = x.join(y, list(keys), "full_outer")
    g = j.agg(
        F.max(F.abs(F.col("_va") - F.col("_vb"))).alias("max_abs_diff"),
        F.sum(F.when(F.col("_la") != F.col("_lb"), 1).otherwise(0)).alias("label_changes"),
        F.sum(F.when(F.col("_inb").isNull(), 1).otherwise(0)).alias("only_first"),
        F.sum(F.when(F.col("_ina").isNull(), 1).otherwise(0)).alias("only_second"))
    ok = (F.col("max_abs_diff") <= atol) & (F.col("label_changes") == 0) & (F.col("only_first") == 0) & (F.col("only_second") == 0)
    return g.withColumn("passed", ok)


def canonical_ids(a: DataFrame, b: DataFrame, tol: float) -> DataFrame:
    """Identity map of a onto b (id, ra, dec, label): the canonical id and whether the labels conflict."""
    m = nearest(a, b, tol).select(F.col("l_id").alias("id"), F.col("r_id").alias("match_id"), F.col("r_label").alias("match_label"), "sep")
    j = a.select("id", "label").join(m, "id", "left")
    return j.withColumns({"canonical": F.coalesce(F.concat(F.lit("b"), F.col("match_id").cast("string")), F.concat(F.lit("a"), F.col("id").cast("string"))),
                          "conflict": F.coalesce(F.col("label") != F.col("match_label"), F.lit(False))})


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """The first k rows per key. Spark keeps only k rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
