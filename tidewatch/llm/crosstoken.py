"""Alignment of two tokenizers by merge-path partitioning.

Tokenizers A and B cut the same bytes; the ascending ends of A's and of B's tokens are merged. A diagonal d of the merge path holds all splits of the first d ends,
i of A and d - i of B; a binary search finds the one on the path, so a merge of any length falls into pieces of equal work that need nothing
from each other. Each step of a piece that reaches a new byte is an overlap of one A with one B token, and an end of both is a cut between groups; the piece's
open groups at its two ends are stitched with those of its neighbours. A document of one piece is done where it was encoded; the pieces of longer ones are dealt over
all tasks. What a pair of ids counts in the whole table then comes from one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import tokens
from tidewatch.llm.common import known, stored

#: Ends merged in one piece; texts encoded at once.
WORK, AT_ONCE = 16_384, 256
VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")

#: groups is null while pieces wait to be stitched; a waiting piece has its ids, those of the one A and B token after it, and the bytes before its first A and B token.
ALIGNED = "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, counts array<int>"
WAITING = "piece int, first_b_cut boolean, own_a int, own_b int, start_a long, start_b long, a binary, b binary"
PARTIAL = "_row long, doc_id long, piece int, n_a long, n_b long, n_cuts long, n_links long, head_a string, head_b string, middle string, tail_a string, tail_b string, pairs array<long>, counts array<int>"


def splits(a_end: np.ndarray, b_end: np.ndarray, work: int) -> np.ndarray:
    """How many ends of A lie before each of the diagonals 0, work, 2 * work, ..., and the last one; of equal ends A's comes first."""
    n, m = len(a_end), len(b_end)
    diagonal = np.append(np.arange(0, n + m, work), n + m)
    low, high = np.maximum(0, diagonal - m), np.minimum(diagonal, n)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # the path takes A's end `middle` before B's end `diagonal - middle - 1` if it is not larger
        take = open_.copy()
        take[open_] = a_end[middle[open_]] <= b_end[diagonal[open_] - middle[open_] - 1]
        low, high = np.where(open_ & take, middle + 1, low), np.where(open_ & ~take, middle, high)
    return low


def overlaps(a_end: np.ndarray, b_end: np.ndarray, own_a: int, own_b: int, first_b_cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A, B, cuts) of one piece: places of the tokens of each overlap, and the places after B's tokens that end with an A token.

    The piece takes own_a ends of A and own_b of B; where A or B has one more token, it is there as well. first_b_cut: B's first end is the A end just before the piece.
    """
    a, b = a_end[:own_a], b_end[:own_b]
    with_a = np.searchsorted(b, a, "left")  # the B token in which an A token ends
    with_b = np.searchsorted(a, b, "right")  # the A token in which a B token ends, if A has no end there
    tie = np.zeros(own_b, bool)
    inside = with_b > 0
    tie[inside] = a[with_b[inside] - 1] == b[inside]
    if own_b and first_b_cut:
        tie[0] = True
    return np.concatenate((np.arange(own_a), with_b[~tie])), np.concatenate((with_a, np.flatnonzero(~tie))), np.flatnonzero(tie) + 1


class Names:
    """Decimal ids with the sign that follows them: inside a group's side, at the end of A's side, at the end of a group."""

    def __init__(self, n_a: int, n_b: int):
        self.a = [f"{i}," for i in range(n_a)] + [f"{i}|" for i in range(n_a)]
        self.b = [f"{i}," for i in range(n_b)] + [f"{i};" for i in range(n_b)]
        self.n_a, self.n_b = n_a, n_b

    def groups(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """Whole groups in order, each with ";" after it: group g has A's tokens up to cut_a[g] and B's up to cut_b[g]."""
        if not len(cut_a):
            return ""
        a, b = a[: cut_a[-1]].astype(np.int64), b[: cut_b[-1]].astype(np.int64)
        a[cut_a - 1] += self.n_a
        b[cut_b - 1] += self.n_b
        at_a = np.arange(len(a)) + np.repeat(np.append(0, cut_b[:-1]), np.diff(cut_a, prepend=0))
        at_b = np.arange(len(b)) + np.repeat(cut_a, np.diff(cut_b, prepend=0))
        out = np.empty(len(a) + len(b), object)
        out[at_a] = list(map(self.a.__getitem__, a.tolist()))
        out[at_b] = list(map(self.b.__getitem__, b.tolist()))
        return "".join(out.tolist())

    def side(self, ids: np.ndarray) -> str:
        return "".join(f"{i}," for i in ids.tolist())


def merged(names: Names, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, own_a: int, own_b: int, first_b_cut: bool) -> dict:
    """A piece's row of PARTIAL, but for the names of its document and piece."""
    of_a, of_b, cut_b = overlaps(a_end, b_end, own_a, own_b, first_b_cut)
    cut_a = np.searchsorted(a_end[:own_a], b_end[cut_b - 1], "right")  # 0 where the cut's A token belongs to the piece before
    pairs, counts = np.unique(a[of_a].astype(np.int64) * names.n_b + b[of_b], return_counts=True)
    head_a, head_b = (cut_a[0], cut_b[0]) if len(cut_b) else (own_a, own_b)
    middle = names.groups(a[head_a:], b[head_b:], cut_a[1:] - head_a, cut_b[1:] - head_b)
    last_a, last_b = (cut_a[-1], cut_b[-1]) if len(cut_b) else (own_a, own_b)
    return {
        "n_a": own_a, "n_b": own_b, "n_cuts": len(cut_b), "n_links": len(of_a), "head_a": names.side(a[:head_a]), "head_b": names.side(b[:head_b]), "middle": middle,
        "tail_a": names.side(a[last_a:own_a]), "tail_b": names.side(b[last_b:own_b]), "pairs": pairs, "counts": counts.astype(np.int32),
    }


def stitched(parts: list[dict]) -> str:
    """The document's groups from its pieces in order, without a sign after the last."""
    out, a, b = [], "", ""
    for part in parts:
        a, b = a + part["head_a"], b + part["head_b"]
        if part["n_cuts"]:
            out.append(f"{a[:-1]}|{b[:-1]};{part['middle']}")
            a, b = part["tail_a"], part["tail_b"]
    return "".join(out)[:-1]


def in_task(paths: tuple[str, str], work: int):
    """Encodes texts, merges documents of one piece, and cuts the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = tokens.two_encoders(*paths)
        names = Names(len(encoders.bytes_a), len(encoders.bytes_b))
        narrow_a, narrow_b = narrow(names)
        schema = arrow_schema(f"{ALIGNED}, {WAITING}")
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                out = []
                for row, doc_id, (a, b) in zip(batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), encoders.ids(batch.column("text").to_pylist()), strict=True):
                    a_end, b_end = np.cumsum(encoders.length_a[a]), np.cumsum(encoders.length_b[b])
                    base = {"_row": row, "doc_id": doc_id}
                    if len(a) + len(b) <= work:
                        part = merged(names, a, b, a_end, b_end, len(a), len(b), False) if len(a) else {"n_a": 0, "n_b": 0, "n_cuts": 0, "n_links": 0, "pairs": [], "counts": []}
                        groups = stitched([part]) if len(a) else ""
                        out.append(base | {c: part[c] for c in ("n_a", "n_b", "n_links", "pairs", "counts")} | {"n_groups": part["n_cuts"], "groups": groups})
                        continue
                    ends = splits(a_end, b_end, work)
                    for piece, (i, next_i) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                        j, next_j = piece * work - i, min((piece + 1) * work, len(a) + len(b)) - next_i
                        out.append(base | {
                            "piece": piece, "first_b_cut": bool(i and j < len(b) and a_end[i - 1] == b_end[j]), "own_a": next_i - i, "own_b": next_j - j,
                            "start_a": int(a_end[i - 1]) if i else 0, "start_b": int(b_end[j - 1]) if j else 0, "a": a[i : next_i + 1].astype(narrow_a).tobytes(), "b": b[j : next_j + 1].astype(narrow_b).tobytes(),
                        })
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def narrow(names: Names) -> list[str]:
    """The kinds of number in which waiting pieces carry ids of A and of B."""
    return ["<u2" if n <= 1 << 16 else "<u4" for n in (names.n_a, names.n_b)]


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, work: int = WORK, hashed: bool = False) -> DataFrame:
    """_row, doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: ids of A and B), pairs (id of A times B's vocabulary plus id of B; distinct) and their counts, stored.

    docs: doc_id, text; other columns are not looked at. A null or empty text, and one whose tokens do not give back its bytes, has zeros and ''. Each row is
    aligned by itself, whatever its doc_id, and has its own _row. hashed: groups is replaced by its lower-case hex SHA-256 ('' stays). An empty table gives no rows.
    """
    paths = paths or tuple(tokens.place(v) for v in VOCABULARIES)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def shape(df: DataFrame) -> DataFrame:
        return df.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))) if hashed else df

    first = stored(shape(rows.mapInArrow(in_task(paths, work), f"{ALIGNED}, {WAITING}")), "zstd")
    columns = [c.split(" ")[0] for c in ALIGNED.split(", ")]
    waiting = first.where("piece is not null").select("_row", "doc_id", *[c.split(" ")[0] for c in WAITING.split(", ")])
    if waiting.isEmpty():
        return first.select(columns)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = tokens.two_encoders(*paths)
        names = Names(len(encoders.bytes_a), len(encoders.bytes_b))
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (np.frombuffer(r[c], kind) for c, kind in zip(("a", "b"), narrow(names), strict=True))
                a_end, b_end = r["start_a"] + np.cumsum(encoders.length_a[a]), r["start_b"] + np.cumsum(encoders.length_b[b])
                part = merged(names, a, b, a_end, b_end, r["own_a"], r["own_b"], r["first_b_cut"])
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in ("_row", "doc_id", "piece")} | part], schema=arrow_schema(PARTIAL))

    def stitch(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("piece")
        pairs, where = np.unique(np.concatenate(list(parts["pairs"])), return_inverse=True)
        counts = np.bincount(where, np.concatenate(list(parts["counts"]))).astype(np.int32)
        sums = {c: int(parts[c].sum()) for c in ("n_a", "n_b", "n_links")}
        whole = {"_row": parts["_row"].iloc[0], "doc_id": parts["doc_id"].iloc[0], "n_groups": int(parts["n_cuts"].sum()), "groups": stitched(parts.to_dict("records")), "pairs": pairs, "counts": counts}
        return pd.DataFrame([{c: (whole | sums)[c] for c in columns}]).astype({"doc_id": "Int64"})

    # pieces of one document meet in one task, but no more of them than one row's text gives
    done = waiting.repartition("_row", "piece").mapInArrow(merge, PARTIAL).groupBy("_row").applyInPandas(stitch, ALIGNED)
    return first.where("piece is null").select(columns).union(stored(shape(done)).select(columns))


def pair_counts(alignments: DataFrame, n_b: int) -> DataFrame:
    """pair, total (links that hold it), best (no pair of the same B id has more), _weight (rows that hold it), stored."""
    totals = stored(alignments.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total"), F.count(F.lit(1)).alias("_weight")))
    most = totals.groupBy((F.col("pair") % n_b).alias("_b")).agg(F.max("total").alias("_most"))
    return stored(totals.join(most, F.col("pair") % n_b == F.col("_b")).select("pair", "total", (F.col("total") == F.col("_most")).alias("best"), "_weight"))


def digest(docs: DataFrame, paths: tuple[str, str] | None = None, work: int = WORK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of aligned() rows; nulls, empty texts and repeated rows as there.

    n_best: links whose pair no other A id surpasses for its B id in the whole table, ties included; count_sum: the sum of the links' pair counts.
    """
    paths = paths or tuple(tokens.place(v) for v in VOCABULARIES)
    rows = aligned(docs, paths, work, hashed=True)
    n_b = len(tokens.two_encoders(*paths).bytes_b)
    counts = pair_counts(rows, n_b)
    n = int(counts.agg(F.sum("_weight")).first()[0] or 0)
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("links"))
    scores = known(each, counts, "pair", n).groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("total")).alias("count_sum"))
    out = rows.select("_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("groups").alias("groups_sha256")).join(scores, "_row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
