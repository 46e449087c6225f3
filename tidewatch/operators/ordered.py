"""Ordered computations over groups of any size.

A window over PARTITION BY key sorts a whole key in one task, which fails when one key holds a large part of the table.
The size of the largest key is therefore counted first (one map-side aggregation over the key columns). While it stays below
the limit, a plain window is used. Beyond it the order axis is cut into cells that hold about the same number of rows, every
(key, cell) is summarised with map-side aggregation, the summaries of the earlier cells become one carry row per cell, and the
window runs over (key, cell) only. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import col
from tidewatch.session import cut

MAX_CELLS = 8192
MAX_GROUP_ROWS = 2_000_000
LIMIT_CONF = "spark.tidewatch.maxGroupRows"


def cells_for(df: DataFrame, keys: Sequence[str]) -> int:
    """0 when every key fits a plain window, else the number of cells to use."""
    limit = int(df.sparkSession.conf.get(LIMIT_CONF, str(MAX_GROUP_ROWS)))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest = g.agg(F.max("n")).first()[0] or 0
    return 0 if largest <= limit else default_cells(df)


def default_cells(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(MAX_CELLS, 2 * parts))


def with_cells(df: DataFrame, order: str, tie: str | None = None, n_cells: int | None = None, out: str = "_cell") -> DataFrame:
    """Add a cell number that is monotone in (order, tie).

    ``order`` is numeric (a double or an integer below 2**53), ``tie`` numeric or text. A value that alone fills more than one cell
    gets cells of its own, divided by ``tie``. Only the (bounded) list of cut points comes to the driver.
    """
    n = n_cells or default_cells(df)
    probs = [i / n for i in range(1, n)]
    text_tie = tie is not None and dict(df.dtypes)[tie] == "string"
    cols = [order] + ([tie] if tie and not text_tie else [])
    cuts = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).approxQuantile(cols, probs, 0.5 / n)
    first = sorted(set(cuts[0]))
    if not first:
        return df.withColumn(out, F.lit(0).cast("long"))
    heavy = sorted({v for v in first if cuts[0].count(v) > 1}) if tie else []
    at, c = f"{out}_at", F.col(order).cast("double")
    cell = bucket_number(df, c, first, at)
    on_cut = F.element_at(F.array(*[F.lit(v) for v in first]), F.greatest(F.col(at), F.lit(1)).cast("int")) == c
    number = F.col(at) * 2 - F.when((F.col(at) > 0) & on_cut, 1).otherwise(0)
    if heavy:
        sub = f"{out}_sub"
        if text_tie:
            second = _text_cuts(df.where(c.isin(heavy)), tie, n)
            below = F.size(F.filter(F.array(*[F.lit(x) for x in second]), lambda x: x <= F.col(tie)))
            cell = cell.withColumn(sub, F.when(c.isin(heavy), below))
        else:
            second = sorted(set(cuts[1]))
            cell = bucket_number(cell, F.when(c.isin(heavy), F.col(tie).cast("double")), second, sub)
        number = number * (len(second) + 2) + F.coalesce(F.col(sub) + 1, F.lit(0))
        return cell.withColumn(out, F.coalesce(number, F.lit(-1)).cast("long")).drop(at, sub)
    return cell.withColumn(out, F.coalesce(number, F.lit(-1)).cast("long")).drop(at)


def _text_cuts(df: DataFrame, c: str, n: int) -> list[str]:
    """Cut points of a text column: every fourth of a bounded sample, the rows with the smallest hashes."""
    rows = df.select(F.col(c).alias("c")).where("c is not null").orderBy(F.xxhash64("c"), "c").limit(4 * n).collect()
    values = sorted(r["c"] for r in rows)
    return sorted(set(values[3::4]))


def bucket_number(df: DataFrame, c: Column, cuts: Sequence[float], out: str) -> DataFrame:
    """How many of the sorted cut points are at or below c (binary search)."""
    src = f"{out}_in"
    splits = [float("-inf"), *cuts, float("inf")]
    b = Bucketizer(splits=splits, inputCol=src, outputCol=out, handleInvalid="keep")
    return b.transform(df.withColumn(src, c)).drop(src)


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: Sequence[str] = (),
    *,
    running: Mapping[str, tuple[str, Column, bool]] | None = None,
    totals: Mapping[str, tuple[str, Column]] | None = None,
    descending: bool = False,
    cell: Column | None = None,
    n_cells: int | None = None,
) -> DataFrame:
    """Running and total aggregates per key in (order, tie) sequence.

    running: output name -> (kind, value, inclusive) with kind sum, max, min or last (the latest non-null value).
    totals: output name -> (kind, value) over the whole key.
    cell: a monotone cell expression when the axis is known to be uniform, else cut points are estimated.
    """
    running, totals, keys, tie = dict(running or {}), dict(totals or {}), list(keys), list(tie)
    if n_cells is None:
        n_cells = cells_for(df, keys)
    if n_cells == 0:
        return _plain_scan(df, keys, [order, *tie], running, totals, descending)
    df = cut(df)
    if cell is None:
        base = with_cells(df, order, tie[0] if tie else None, n_cells)
    else:
        base = df.withColumn("_cell", cell)
    plain = df.columns
    seq = [order, *tie]
    aggs = []
    for i, (kind, value, _) in enumerate(running.values()):
        base = base.withColumn(f"_r{i}", value)
        if kind == "last":
            pos = F.struct(*[F.col(c) for c in seq])
            pick = F.min_by if descending else F.max_by
            aggs.append(pick(f"_r{i}", F.when(F.col(f"_r{i}").isNotNull(), pos)).alias(f"_r{i}"))
        else:
            aggs.append(_AGG[kind](f"_r{i}").alias(f"_r{i}"))
    for i, (kind, value) in enumerate(totals.values()):
        base = base.withColumn(f"_t{i}", value)
        aggs.append(_AGG[kind](f"_t{i}").alias(f"_t{i}"))

    def by(c):
        return F.col(c).desc() if descending else F.col(c).asc()

    part = keys or [F.lit(0)]
    before = Window.partitionBy(*part).orderBy(by("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    carry = base.groupBy(*keys, "_cell").agg(*aggs)
    carried = [F.col(k) for k in keys] + [F.col("_cell"), F.lit(0).alias("_row")]
    for i, (kind, _, _) in enumerate(running.values()):
        c = F.last(f"_r{i}", ignorenulls=True).over(before) if kind == "last" else _AGG[kind](f"_r{i}").over(before)
        carried.append(c.alias(f"_r{i}"))
    for i, (kind, _) in enumerate(totals.values()):
        carried.append(_AGG[kind](f"_t{i}").over(whole).alias(f"_g{i}"))
    both = base.withColumn("_row", F.lit(1)).drop(*[f"_t{i}" for i in range(len(totals))])
    both = both.unionByName(carry.select(*carried), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_cell").orderBy(F.col("_row"), *[by(c) for c in seq])
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    new = []
    for i, (name, (kind, _, inclusive)) in enumerate(running.items()):
        w = upto if inclusive else ahead
        if kind == "last":
            c = F.last(f"_r{i}", ignorenulls=True).over(w)
        else:
            c = _AGG[kind](f"_r{i}").over(w)
            c = F.coalesce(c, F.lit(0)) if kind == "sum" else c
        new.append(c.alias(name))
    for i, name in enumerate(totals):
        new.append(F.first(f"_g{i}", ignorenulls=True).over(upto).alias(name))
    kept = [F.col(c) for c in plain if c not in running and c not in totals]
    return both.select(*kept, *new, "_row").where("_row = 1").drop("_row")


def _plain_scan(df, keys, seq, running, totals, descending) -> DataFrame:
    """The same as scan for keys that fit one task."""
    part = keys or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in seq])
    new = {}
    for name, (kind, value, inclusive) in running.items():
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        c = F.last(value, ignorenulls=True) if kind == "last" else _AGG[kind](value)
        c = c.over(frame)
        new[name] = F.coalesce(c, F.lit(0)) if kind == "sum" else c
    for name, (kind, value) in totals.items():
        new[name] = _AGG[kind](value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = [F.col(c) for c in df.columns if c not in new]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (an aggregate without keys) to every row; one row is what the hint broadcasts."""
    key = F.lit(0)
    return df.withColumn("_one", key).join(F.broadcast(one.withColumn("_one", key)), "_one").drop("_one")


def row_index(df, keys, order, tie=(), out="rn", total=None, **kw) -> DataFrame:
    """1-based position in the key, and optionally the size of the key."""
    one = F.lit(1).cast("long")
    return scan(df, keys, order, tie, running={out: ("sum", one, True)}, totals={total: ("sum", one)} if total else None, **kw)


def equal_count_bins(df, keys, order, tie=(), k=15, out="bin", **kw) -> DataFrame:
    """k bins of equal count (the larger ones first), numbered from 1."""
    d = row_index(df, keys, order, tie, out="_rn", total="_n", **kw)
    small, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    edge = extra * (small + 1)
    later = F.when(small > 0, extra + F.floor((F.col("_rn") - 1 - edge) / F.greatest(small, F.lit(1))))
    b = F.when(F.col("_rn") <= edge, F.floor((F.col("_rn") - 1) / (small + 1))).otherwise(later)
    return d.withColumn(out, (b + 1).cast("int")).drop("_rn", "_n")


def value_counts(df, keys, value, weight: Column | None = None) -> DataFrame:
    """Distinct non-missing values per key with their weight: the small form on which ranks and quantiles work."""
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(col(value).isNotNull()).groupBy(*keys, col(value).alias("_v")).agg(w.alias("_w"))


def percentiles(df, keys, value, probs: Mapping[str, float], n_cells: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation per key: one row per key, one column per probability."""
    n_cells = cells_for(df, keys) if n_cells is None else n_cells
    if n_cells == 0:
        p = df.groupBy(*keys).agg(F.percentile(col(value).cast("double"), F.array(*[F.lit(float(x)) for x in probs.values()])).alias("_p"))
        return p.where("_p is not null").select(*keys, *[F.col("_p")[i].alias(name) for i, name in enumerate(probs)])
    c = value_counts(df, keys, value).withColumn("_v", F.col("_v").cast("double"))
    return count_percentiles(c, keys, probs, n_cells)


def count_percentiles(counts, keys, probs: Mapping[str, float], n_cells: int | None = None) -> DataFrame:
    """The same from distinct values (_v) with whole-number weights (_w)."""
    s = scan(counts, keys, "_v", running={"_hi": ("sum", F.col("_w"), True)}, totals={"_n": ("sum", F.col("_w"))}, n_cells=n_cells)
    s = s.withColumn("_lo", F.col("_hi") - F.col("_w"))
    aggs = []
    for i, p in enumerate(probs.values()):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for tag, at in (("a", F.floor(pos)), ("b", F.ceil(pos))):
            aggs.append(F.max(F.when((F.col("_lo") <= at) & (at < F.col("_hi")), F.col("_v"))).alias(f"_{tag}{i}"))
    g = s.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    out = [F.col(k) for k in keys]
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        out.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (pos - F.floor(pos))).alias(name))
    return g.select(*out)


def average_ranks(df, keys, value, out="rank", n_cells=None) -> DataFrame:
    """Distinct values per key with the mean rank of their ties, their count and the size of the key."""
    c = value_counts(df, keys, value).withColumn("_v", F.col("_v").cast("double"))
    s = scan(c, keys, "_v", running={"_hi": ("sum", F.col("_w"), True)}, totals={"_n": ("sum", F.col("_w"))}, n_cells=n_cells)
    return s.select(*keys, F.col("_v"), F.col("_w"), F.col("_n"), (F.col("_hi") - (F.col("_w") - 1) / 2.0).alias(out))


def spearman(df, keys, x, y, out="rho", n_cells=None) -> DataFrame:
    """Rank correlation per key over rows where both values are present.

    Rows are first reduced to distinct (x, y) pairs; ranks are centred so that the sums stay accurate for long tables.
    """
    d = df.where(col(x).isNotNull() & col(y).isNotNull())
    n_cells = cells_for(d, keys) if n_cells is None else n_cells
    pairs = d.groupBy(*keys, col(x).cast("double").alias("_x"), col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_c"))
    rx = average_ranks(d, keys, x, "_rx", n_cells).select(*keys, F.col("_v").alias("_x"), (F.col("_rx") - (F.col("_n") + 1) / 2.0).alias("_dx"))
    ry = average_ranks(d, keys, y, "_ry", n_cells).select(*keys, F.col("_v").alias("_y"), (F.col("_ry") - (F.col("_n") + 1) / 2.0).alias("_dy"))
    j = pairs.join(rx, [*keys, "_x"]).join(ry, [*keys, "_y"])
    c = F.col("_c")
    g = j.groupBy(*keys).agg(
        F.coalesce(F.sum(c), F.lit(0)).alias("n"),
        F.sum(c * F.col("_dx") * F.col("_dy")).alias("_xy"),
        F.sum(c * F.col("_dx") * F.col("_dx")).alias("_xx"),
        F.sum(c * F.col("_dy") * F.col("_dy")).alias("_yy"),
    )
    return g.select(*keys, "n", F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))).alias(out))


def latest_before(probe: DataFrame, events: DataFrame, keys, probe_at: str, event_at: str, values: Mapping[str, tuple[str, str]],
                  strict: bool = True, n_cells=None) -> DataFrame:
    """As-of lookup without pairing rows: for each probe, aggregates of all events of its key placed before it.

    values: output -> (kind, event column) with kind max, min, sum or last. strict=False also counts events at the same place.
    """
    p = probe.withColumn("_at", F.col(probe_at).cast("double")).withColumn("_side", F.lit(0 if strict else 1))
    e = events.select(*keys, F.col(event_at).cast("double").alias("_at"), F.lit(1 if strict else 0).alias("_side"),
                      *[F.col(c).alias(f"_e{i}") for i, (_, c) in enumerate(values.values())], F.lit(True).alias("_event"))
    both = p.unionByName(e, allowMissingColumns=True)
    run = {name: (kind, F.col(f"_e{i}"), False) for i, (name, (kind, _)) in enumerate(values.items())}
    s = scan(both, keys, "_at", ["_side"], running=run, n_cells=n_cells)
    return s.where("_event is null").drop("_at", "_side", "_event", *[f"_e{i}" for i in range(len(values))])
