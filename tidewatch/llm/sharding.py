"""Sharding by balanced label propagation.

Documents of one group are linked. A group of more documents than a shard holds is first cut into parts that fit; such a part, or a whole smaller group, is a hub. Every
document starts with a label by hash. In each round every hub that has no place yet asks for the shard whose label most of its documents have, among the shards
that still have room for all of it; a shard takes the largest hubs that ask, up to its quota, and those refused ask again in the next round. When no hub fits
anywhere, fewer hubs than shards are left: their documents fill the remaining places one shard after the other, and documents without links fill the rest.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import known, numbered, stored, text_or_empty

SHARDS = 8


def hubs_of(rows: DataFrame, shards: int, n: int) -> DataFrame:
    """The rows with their hub (null without links). Groups above the largest quota are cut, by a gapless number, into parts of the smallest quota and a rest."""
    quota, part = -(-n // shards), max(1, n // shards)
    sizes = rows.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").withColumn("_weight", F.col("_size"))
    # rows without a group do not go through the join: they would all meet in the task of the null key
    sized = stored(known(rows.where("group is not null"), sizes, "group", n))
    name = lambda number: F.concat_ws(":", F.col("group").cast("string"), number.cast("string"))
    large = numbered(sized.where(F.col("_size") > quota), ["group"], ["doc_id", "group"], "_turn", n)
    out = large.withColumn("hub", name(F.floor(F.col("_turn") / part))).drop("_turn")
    small = sized.where(F.col("_size").isNull() | (F.col("_size") <= quota)).withColumn("hub", F.when(F.col("_size").isNotNull(), name(F.lit(0))))
    alone = rows.where("group is null").withColumn("hub", F.lit(None).cast("string"))
    return out.unionByName(small).drop("_size").unionByName(alone)


def wanted(room: list[int], turn: int) -> Column:
    """The shard whose label most documents of the hub have, of those with room for all of it; ties by hash. Null if none has room."""
    offers = [
        F.when(F.col("size") <= r, F.struct(F.element_at("labels", F.lit(s + 1)).alias("c"), F.xxhash64("hub", F.lit(s), F.lit(turn)).alias("t"), F.lit(s).alias("s")))
        for s, r in enumerate(room)
    ]
    return F.array_max(F.array(*offers))["s"]


def propagated(hubs: DataFrame, room: list[int]) -> tuple[DataFrame, DataFrame, list[int]]:
    """Hubs with a place (hub, size, want), hubs for which no shard has room, and the room left. hubs: hub, size, labels (documents by label).

    What a round takes is stated by one row per shard: the size at which it fills up and how many hubs of that size it takes; larger ones are all taken. The largest
    hub that asks always fits, so each round places hubs until none fits.
    """
    left, room, taken, turn = stored(hubs), list(room), [], 0
    while True:
        asks = left.withColumn("want", wanted(room, turn))
        classes = asks.where("want is not null").groupBy("want", "size").agg(F.count(F.lit(1)).alias("n"))
        falling = Window.partitionBy("want").orderBy(F.desc("size"))
        upto = classes.withColumn("upto", F.sum(F.col("n") * F.col("size")).over(falling)).withColumn("before", F.col("upto") - F.col("n") * F.col("size"))
        over = F.col("upto") > F.element_at(F.array(*[F.lit(r) for r in room]), F.col("want") + 1)
        full = F.max(F.when(over, F.struct("size", "before")))
        found = upto.groupBy("want").agg(F.max("upto").alias("upto"), F.sum("n").alias("n"), full.alias("full")).collect()
        if not found:
            break
        at: dict[int, tuple[int, int]] = {}
        for r in found:
            s = r["want"]
            if r["full"] is None:
                room[s] -= r["upto"]
            else:
                size, before = r["full"]
                at[s] = (size, (room[s] - before) // size)
                room[s] -= before + at[s][0] * at[s][1]
        edge = F.lit(None).cast("long")
        take = F.lit(None).cast("long")
        for s, (size, k) in at.items():
            edge = F.when(F.col("want") == s, F.lit(size)).otherwise(edge)
            take = F.when(F.col("want") == s, F.lit(k)).otherwise(take)
        marked = asks.withColumn("_edge", edge)
        tied = numbered(marked.where("size = _edge"), ["want"], ["hub"], "_rank", sum(r["n"] for r in found)).withColumn("_ok", F.col("_rank") < take).drop("_rank")
        clear = marked.where("_edge is null or size <> _edge").withColumn("_ok", F.col("want").isNotNull() & (F.col("_edge").isNull() | (F.col("size") > F.col("_edge"))))
        done = stored(clear.unionByName(tied).drop("_edge"))
        taken.append(done.where("_ok").select("hub", "size", "want"))
        left = done.where("not _ok").select("hub", "size", "labels")
        turn += 1
    placed = left.select("hub", "size", F.lit(0).alias("want")).limit(0)
    for t in taken:
        placed = placed.unionByName(t)
    return placed, left, room


def assigned(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows with a shard; counts of the shards differ by one at most. rows: doc_id, group (documents of one group are linked; null: none)."""
    n = rows.count()
    linked = stored(hubs_of(rows, shards, n))
    label = F.pmod(F.xxhash64("doc_id"), F.lit(shards))
    labels = F.array(*[F.count(F.when(label == s, 1)) for s in range(shards)])
    hubs = linked.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("size"), labels.alias("labels"))
    placed, left, room = propagated(hubs, [n // shards + (s < n % shards) for s in range(shards)])
    put = stored(known(linked.where("hub is not null"), placed.withColumnRenamed("size", "_weight"), "hub", n))
    # fewer than shards: each is larger than any room, and together they are not larger than all room
    rest = sorted((r["size"], r["hub"]) for r in left.select("hub", "size").collect())
    starts = dict(zip([h for _, h in rest], accumulate([s for s, _ in rest], initial=0)))
    first = F.lit(0)
    for hub, at in starts.items():
        first = F.when(F.col("hub") == hub, F.lit(at)).otherwise(first)
    cut = numbered(put.where("want is null"), ["hub"], ["doc_id", "group"], "_turn", n).withColumn("_turn", F.col("_turn") + first)
    idle = numbered(linked.where("hub is null").withColumn("want", F.lit(None).cast("int")), [], ["doc_id", "group"], "_turn", n)
    waiting = cut.unionByName(idle.withColumn("_turn", F.col("_turn") + sum(s for s, _ in rest)))
    order = sorted(range(shards), key=lambda s: (-room[s], s))
    ends = F.array(*[F.lit(e).cast("long") for e in accumulate(room[s] for s in order)])
    turn = F.size(F.filter(ends, lambda e: e <= F.col("_turn")))
    dealt = waiting.withColumn("want", F.element_at(F.array(*[F.lit(s) for s in order]), turn + 1)).drop("_turn")
    return stored(put.where("want is not null").unionByName(dealt).withColumn("shard", F.col("want").cast("int")).drop("want", "hub"))


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: links (pairs of documents of one group), cut (those in different shards), groups (of two or more), cut_groups. placed: group, shard."""
    pairs = lambda c: c.cast("decimal(38,0)") * (c - 1)
    inside = placed.where("group is not null").groupBy("group", "shard").agg(F.count(F.lit(1)).alias("c"))
    by_group = inside.groupBy("group").agg(F.sum("c").alias("n"), F.sum(pairs(F.col("c"))).alias("kept"), F.count(F.lit(1)).alias("shards")).where("n > 1")
    total, kept = F.sum(pairs(F.col("n"))), F.sum("kept")
    zero = F.lit(0).cast("long")
    return by_group.agg(F.coalesce((total / 2).cast("long"), zero).alias("links"), F.coalesce(((total - kept) / 2).cast("long"), zero).alias("cut"),
                        F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("shards") > 1, 1)).alias("cut_groups"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ("rows": counts at most one apart), shard, slot (gapless from 0 in each shard), grown_shard (null under this law).

    docs: doc_id, text. Links join documents of equal text. A null text has size 1 and counts as empty, as do empty texts: they are one group. Repeated rows
    are rows of their own; null ids are placed like others. An empty table gives no rows. Other columns are not looked at.
    """
    text = text_or_empty()
    rows = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.sha2(text, 256).alias("group")))
    placed = assigned(rows, shards)
    slots = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", rows.count())
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
