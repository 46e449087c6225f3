"""Selection: ordered bins, reproducible random ranks, candidate rounds, sampling, ranks and report order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import hash_cell, hash_long, hash_text
from tidewatch.operators.joins import top_k
from tidewatch.operators.ordered import cells_for, equal_count_bins, row_index, scan
from tidewatch.session import cut, spread


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order; only one candidate per key and task is shuffled."""
    rest = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return g.select(*key, "_b.*")


def random_rank(df: DataFrame, keys: Sequence[str], row_id: str, seed: int, out: str = "rank", n_cells: int | None = None) -> DataFrame:
    """Reproducible random rank inside a group: position by the MD5 of seed and row id."""
    d = df.withColumn("_h", hash_text(seed, F.col(row_id)))
    return row_index(d, keys, "_h", [row_id], out=out, cell=hash_cell("_h", 3), n_cells=n_cells).withColumn(out, F.col(out).cast("int")).drop("_h")


def stratified_candidates(df: DataFrame, group: str, t: str, row_id: str, bins: int, seed: int) -> DataFrame:
    """Equal-count time bins per group (``bin``) and a random rank inside every bin (``rank``)."""
    n = cells_for(df, [group])
    return random_rank(equal_count_bins(df, [group], t, [row_id], k=bins, n_cells=n), [group, "bin"], row_id, seed, n_cells=n)


def capped(df: DataFrame, keys: Sequence[str], cap: int, row_id: str, seed: int) -> DataFrame:
    """At most ``cap`` rows per group, chosen at random."""
    d = df.withColumn("_h", hash_text(seed, F.col(row_id)))
    return top_k(d, keys, [F.col("_h"), F.col(row_id)], cap, "_rn").drop("_h", "_rn")


def first_acceptable(cands: DataFrame, keys: Sequence[str], rank: str, ok: Column, max_tries: int) -> DataFrame:
    """Audit of the tried candidates: those up to the first acceptable one, at most max_tries, with ``accepted``."""
    c = cut(cands.where(F.col(rank) <= max_tries))
    best = c.where(ok).groupBy(*keys).agg(F.min(rank).alias("_best"))
    j = c.join(best, list(keys), "left")
    tried = j.where(F.col(rank) <= F.coalesce(F.col("_best"), F.lit(max_tries)))
    return tried.withColumn("accepted", F.coalesce(F.col(rank) == F.col("_best"), F.lit(False))).drop("_best")


def replacements(accepted: DataFrame, cands: DataFrame, keys: Sequence[str], rank: str, good: Column, clean: Column, rounds: int = 3, scan_ranks: int = 6) -> DataFrame:
    """For every bin whose accepted row must be replaced, ``rounds`` rounds over the candidates not tried yet.

    A round tries up to ``scan_ranks`` candidates and ends at the first good one. If that one is clean it replaces the accepted row, else the next round begins behind it.
    Output per bin: status (replaced; not clean: all rounds used; no candidate: none left to try) and the rank of the replacement.
    """
    a = accepted.select(*keys, F.col(rank).alias("_from"))
    c = cands.withColumns({"_clean": F.coalesce(clean, F.lit(False)), "_good": F.coalesce(good, F.lit(False))}).join(a, list(keys)).where(F.col(rank) > F.col("_from"))
    nxt = top_k(c, keys, [F.col(rank)], rounds * scan_ranks, "_i")
    tries = nxt.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", rank, "_good", "_clean"))).alias("_t"))
    start = F.struct(F.lit(1).alias("turn"), F.lit(0).alias("n"), F.lit(None).cast(dict(cands.dtypes)[rank]).alias("new"))

    def step(state, x):
        stop = state["new"].isNotNull() | (state["turn"] > rounds)
        last = x["_good"] | (state["n"] + 1 >= scan_ranks)
        turn = F.when(last, state["turn"] + 1).otherwise(state["turn"])
        n = F.when(last, 0).otherwise(state["n"] + 1)
        new = F.when(x["_good"] & x["_clean"], x[rank])
        after = F.struct(turn.alias("turn"), n.alias("n"), new.alias("new"))
        return F.when(stop, state).otherwise(after)

    j = a.join(tries, list(keys), "left").withColumn("_s", F.aggregate(F.coalesce("_t", F.array().cast(dict(tries.dtypes)["_t"])), start, step))
    status = F.when(F.col("_s.new").isNotNull(), "replaced").when(F.col("_s.turn") > rounds, "not clean").otherwise("no candidate")
    return j.select(*keys, F.col("_from").alias("old_rank"), F.col("_s.new").alias("new_rank"), status.alias("status"))


def sample_k(rows: DataFrame, group: str, index: str, size: str, draws: int, ks: Sequence[int], seed: int) -> DataFrame:
    """k rows per (draw, group) without replacement, for several k at once: (draw, k, group, index).

    rows: one row per (group, index 0..size-1). Positions come from a hash sequence, of which the first k distinct ones are kept: the same for groups of any size and
    whatever other k are asked for. The work grows with draws x groups x k and not with the table; a group of fewer than k rows gives all of them.
    """
    top = max(ks)
    groups = rows.groupBy(group).agg(F.max(size).alias("_n"))
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    m = 2 * top + 20
    while True:
        seq = spread(groups.select(group, "_n", draw), group, "draw").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        seq = seq.withColumn(index, hash_long(seed, F.col("draw"), F.col(group), F.col("_i")) % F.col("_n"))
        first = cut(seq.groupBy("draw", group, index).agg(F.min("_i").alias("_i"), F.max("_n").alias("_n")))
        short = first.groupBy("draw", group).agg(F.count(F.lit(1)).alias("c"), F.max("_n").alias("_n")).where(F.col("c") < F.least(F.lit(top), F.col("_n")))
        if short.limit(1).count() == 0:
            break
        m *= 2
    picked = top_k(first, ["draw", group], [F.col("_i")], top, "_rn")
    return picked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("_rn") <= F.col("k")).select("draw", "k", group, index)


def holm(df: DataFrame, family: Sequence[str], test: str, p: str) -> DataFrame:
    """Step-down adjustment: running maximum of (m - rank) p, at most 1."""
    r = row_index(df, family, p, [test], out="_rn", total="_m")
    r = r.withColumn("_raw", F.least(F.lit(1.0), (F.col("_m") - F.col("_rn") + 1) * F.col(p)))
    return scan(r, family, p, [test], running={"p_adjusted": ("max", F.col("_raw"), True)}).drop("_rn", "_m", "_raw")


def clean_series(df: DataFrame, key: str, bands: dict[str, str], n_sigma: float, snr: float, min_count: int) -> DataFrame:
    """Drop points with low signal to noise or above mean + n_sigma (sample deviation) in any band, then groups left too small."""
    ok = None
    for b, e in bands.items():
        good = F.try_divide(F.col(b), F.col(e)) > snr
        ok = good if ok is None else ok & good
    d = df.where(ok)
    stats = d.groupBy(key).agg(*[x for b in bands for x in (F.avg(b).alias(f"_m_{b}"), F.stddev_samp(b).alias(f"_s_{b}"))])
    j = d.join(stats, key)
    for b in bands:
        j = j.where(F.col(b) <= F.col(f"_m_{b}") + n_sigma * F.coalesce(F.col(f"_s_{b}"), F.lit(0.0)))
    j = j.select(*d.columns)
    big = j.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_count)
    return j.join(big.select(key), key, "left_semi")


def margin(df: DataFrame, probs: dict[str, str], sigmas: dict[str, str]) -> DataFrame:
    """Most probable class and whether its lead is within the summed errors of the first two.

    Probabilities equal to 12 digits are a tie, which the class name decides; its lead is 0, any other is the difference of the probabilities as they are. A class without a
    probability takes no part, a missing error counts as none beside a known one.
    """
    items = F.array(*[F.struct((-F.round(F.col(probs[c]), 12)).alias("neg"), F.lit(c).alias("cls"), F.col(probs[c]).alias("p"), F.col(sigmas[c]).alias("sd")) for c in probs])
    s = F.array_sort(F.filter(items, lambda x: x["neg"].isNotNull()))
    first, second = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    lead = F.when(first["neg"] == second["neg"], 0.0).otherwise(first["p"] - second["p"])
    sd = F.coalesce(first["sd"] + second["sd"], first["sd"], second["sd"])
    return df.withColumns({"cls": first["cls"], "lead": lead, "indeterminate": lead < sd})


def reliability(rho) -> Column:
    """Spearman-Brown: reliability of the full length from the correlation of the halves."""
    return F.try_divide(2.0 * F.col(rho), 1.0 + F.col(rho))


def report_order(df: DataFrame, block: str, order: Sequence[Column], header: DataFrame) -> DataFrame:
    """Report rows in order inside their block, after one header row per block."""
    from pyspark.sql import Window

    w = Window.partitionBy(block).orderBy(F.col("_body"), *order)
    both = header.withColumn("_body", F.lit(0)).unionByName(df.withColumn("_body", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("line", F.row_number().over(w)).drop("_body")

