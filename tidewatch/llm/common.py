"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir

#: Rows of one numbering cell; a cell is numbered by one task.
CELL_ROWS = 50_000


def stored(df: DataFrame, codec: str = "snappy", file_rows: int = 0) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and still there when an executor is lost. file_rows: the most rows of a file (0: no limit)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(df: DataFrame, groups: list[str], order: list[str], to: str, rows: int) -> DataFrame:
    """A gapless number from 0 within each group, in an order that a hash of the order columns begins.

    A group may hold any share of the rows: it is cut into cells by the hash, a cell is numbered by one task, and the cells' sizes, a small
    table, give each cell its first number. rows: about how many rows there are; it sets the number of cells, and so the order, alone.
    """
    cells = max(1, -(-rows // CELL_ROWS))
    with_cell = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    inner = Window.partitionBy(*groups, "_cell").orderBy(*order)
    sizes = with_cell.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    same = F.col("_cell") == F.col("_c")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = with_cell.withColumn("_at", F.row_number().over(inner) - 1).join(firsts, same)
    return out.withColumn(to, (F.col("_first") + F.col("_at")).cast("long")).drop("_cell", "_c", "_first", "_at", *[f"_g{i}" for i in range(len(groups))])


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The connected components: id, component (the smallest id that links reach, its own included).

    nodes: id (distinct); edges: a, b (any direction; repeated pairs and loops do no harm). Large-star and small-star rounds on the links alone:
    each node's neighbours are hung on the smallest of them, until nothing changes. A node's neighbours are never gathered, only their minimum.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, done = mark(links), False
    for _ in range(rounds):
        if not before[0]:
            done = True
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(down.select("u", F.col("m").alias("v"))).distinct()
        links = stored(small)
        after = mark(links)
        done, before = after == before, after
        if done:
            break
    if not done:
        raise RuntimeError(f"components not found in {rounds} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes["id"] == roots["u"], "left").select("id", F.coalesce("component", "id").alias("component"))


#: Keys that are frequent enough to be sent to all tasks: each has over one HOT_KEYS-th of all rows, so there are never more of them.
HOT_KEYS = 65_536


def known(rows: DataFrame, table: DataFrame, key: str | list[str], n: int, hot_keys: int = HOT_KEYS) -> DataFrame:
    """The rows with the columns that the table has for their key (null where it has none); keys are distinct there, and its column _weight (dropped) says how many rows have the key.

    n: how many rows there are. Keys with more than n / hot_keys rows, of which there are fewer than hot_keys, are broadcast, so their rows stay where they are;
    the others are shuffled, and no key of the table then brings more than n / hot_keys rows to a task.
    """
    frequent = F.col("_weight") * hot_keys > n
    hot, rest = table.where(frequent).drop("_weight"), table.where(~frequent).drop("_weight")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left"))
