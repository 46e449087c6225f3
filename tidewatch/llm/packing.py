"""Packing by optimal length buckets.

A document becomes sequences of at most `longest` tokens. The global histogram of their lengths, a table of at most `longest` rows, is all that
the driver sees; dynamic programming over it chooses the bucket boundaries that minimise padding. Inside a bucket each batch takes as many sequences as the
token budget holds at the bucket's boundary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import numbered, stored, text_or_empty

#: Tokens of a sequence at most; buckets; padded tokens of a batch at most.
LONGEST, BUCKETS, BUDGET = 2048, 16, 32_768
#: Fixed value: a word with the spaces before it, or one other character.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds, ascending, of at most `buckets` buckets with the least padding; of equal solutions the one with fewer, then smaller bounds.

    lengths: distinct, ascending. best[j] is the least padding of the first j lengths in k buckets; a bucket's padding is its bound times its sequences less its tokens.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(counts))).astype(float)
    tokens = np.concatenate(([0], np.cumsum(lengths * counts))).astype(float)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts: list[np.ndarray] = []
    totals: list[float] = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        best = new
        cuts.append(cut)
        totals.append(best[n])
    used = int(np.argmin(np.round(totals, 6)))
    at, bounds = n, []
    for k in range(used, -1, -1):
        bounds.append(int(lengths[at - 1]))
        at = int(cuts[k][at])
    return bounds[::-1]


def token_count(column: str = "text") -> Column:
    """Words and single other characters of a text; of a null none. Another tokenizer's counts may be given as a column of the documents instead."""
    return F.regexp_count(text_or_empty(column), F.lit(TOKEN)).cast("long")


def bpe_counts(docs: DataFrame, ranks_path: str, pattern: str, to: str = "n_tokens") -> DataFrame:
    """The rows with a column of byte-pair token counts; ranks_path names a file of base64 tokens and ranks that every executor can open."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return pd.Series([len(coder.encode_ordinary(t or "")) for t in texts], dtype="int64")

    return docs.withColumn(to, count(F.col("text").cast("string")))


def sequences(docs: DataFrame, tokens: Column, longest: int = LONGEST) -> DataFrame:
    """doc_id, piece, length: each document cut after every `longest` tokens. A document without tokens is one sequence of length 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(tokens, F.lit(0)).cast("long").alias("_n"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_n") / longest)).cast("int")
    cut = rows.select("doc_id", "_n", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(longest), F.col("_n") - F.col("piece") * longest).cast("int").alias("length"))


def packed(docs: DataFrame, tokens: Column | None = None, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, piece, length, bucket, bound (padded length), batch (from 0 inside the bucket), slot (from 0 inside the batch).

    docs: doc_id, text, or a tokens column. Null and empty texts have length 0 and the smallest bucket. Rows of equal doc_id are sequences of their own, in
    either order. Every batch of a bucket but its last is full: max(1, budget // bound) sequences. An empty table gives no rows.
    """
    rows = stored(sequences(docs, token_count() if tokens is None else tokens, longest))
    histogram = sorted((r[0], r[1]) for r in rows.groupBy("length").count().collect())
    lengths, counts = (np.array([h[i] for h in histogram], np.int64) for i in (0, 1))
    bounds = boundaries(lengths, counts, buckets)
    spark = docs.sparkSession
    steps = spark.createDataFrame(pd.DataFrame({"length": lengths.astype("int32"), "bucket": np.searchsorted(bounds, lengths).astype("int32"), "bound": np.array(bounds, "int32")[np.searchsorted(bounds, lengths)] if bounds else lengths.astype("int32")}), "length int, bucket int, bound int")
    placed = rows.join(F.broadcast(steps), "length")
    at = numbered(placed, ["bucket"], ["doc_id", "piece"], "_place", int(counts.sum()))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bound")))).cast("long")
    return at.withColumn("batch", F.floor(F.col("_place") / room).cast("long")).withColumn("slot", (F.col("_place") % room).cast("int")).select("doc_id", "piece", "length", "bucket", "bound", "batch", "slot")
