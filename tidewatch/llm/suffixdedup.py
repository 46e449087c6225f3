"""Repeated byte strings, removed where they start later than elsewhere.

Every string of LENGTH bytes has an anchor: of its GRAM-byte pieces the leftmost of the smallest hash. Equal strings have equal anchors, so strings meet by
their anchor's hash. The strings of one anchor occurrence follow each other; they are one region. Regions of equal content need no comparison, only
their first occurrence counts. A string reaches some way to the left of its anchor and the rest of the way to the right, so that it holds one of SIDES pieces around
the anchor whole; regions of different content that have none of these pieces in common share no string. Where regions of one anchor may share some, their bytes are gathered into shards, and the Burrows-Wheeler transform of a
shard is searched by threshold-bounded interval expansion: intervals of suffixes with a common prefix are extended backwards breadth first, which finds the common-prefix
lengths of neighbouring suffixes by increasing value; what is not found below LENGTH is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.bytehash import Hashed, mix
from tidewatch.llm.common import shuffle_parts, stored
from tidewatch.llm.fmindex import Wavelet

LENGTH, GRAM = 100, 16
#: Bytes that a task takes at once: of texts, of which it sends each region content once; and of regions in a shard.
BLOCK, SHARD = 24 << 20, 1 << 20
#: Different regions of one anchor that are compared in a shard; with more, each of their strings is dealt out by its own hash.
WIDE = 4000
#: Pieces around an anchor, of which each string holds one; a region has 16 bits of each one's hash in its column pieces, 0 for those that it doesn't hold.
SIDES = 4
ANCHORS = "h long, c long, pieces long, doc long, start int, n int, others binary"
REPEATS = "doc long, start int, n int, h long, kind int"
#: Kinds of repeats: all strings of the region go; its strings are to be compared in a shard; or one by one.
GONE, COMPARE, SINGLE = 0, 1, 2


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that follow each other in data and end at `ends`: for each region the anchor's hash, the content's hash, those of pieces, the first string's start and their number."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(data)
    if n < LENGTH:
        return none
    width = LENGTH - GRAM + 1
    words = np.lib.stride_tricks.as_strided(data, (n - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    grams = n - GRAM + 1
    low = words[:grams] * np.uint64(0x9E3779B97F4A7C15)
    low ^= low >> np.uint64(32)
    low = (low + words[8 : 8 + grams]) * np.uint64(0xD6E8FEB86659FD93)
    low ^= low >> np.uint64(32)
    low *= np.uint64(0xD6E8FEB86659FD93)
    hashed = low
    del words
    # leftmost smallest of each run of `width` grams: runs of powers of two, then two that overlap
    at = np.arange(grams, dtype=np.int32)
    span = 1
    while span * 2 <= width:
        right = low[span:]
        take = right < low[: len(right)]
        low, at = np.where(take, right, low[: len(right)]), np.where(take, at[span:], at[: len(right)])
        span *= 2
    step = width - span
    strings = n - LENGTH + 1
    take = low[step : step + strings] < low[:strings]
    place = np.where(take, at[step : step + strings], at[:strings])
    starts = np.concatenate(([0], ends[:-1]))
    long = ends - starts >= LENGTH
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside)[:strings] > 0)
    if not len(valid):
        return none
    p = place[valid]
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (valid[1:] != valid[:-1] + 1))))
    count = np.diff(np.append(new, len(valid)))
    first = valid[new]
    sums, end, at = Hashed(data), first + count + LENGTH - 1, p[new]
    content = sums.of(first, end)
    # a string that reaches between edge j and edge j + 1 to the left reaches so far to the right
    edges = [(LENGTH - GRAM) * j // SIDES for j in range(SIDES + 1)]
    pieces = np.zeros(len(at), np.uint64)
    for j in range(SIDES):
        a, z = at - edges[j], at + LENGTH - edges[j + 1]
        has = np.flatnonzero((a >= first) & (z <= end))
        pieces[has] |= np.maximum(sums.of(a[has], z[has]) >> np.uint64(48), np.uint64(1)) << np.uint64(16 * j)
    return hashed[at].view(np.int64), content.view(np.int64), pieces.view(np.int64), first, count


def region_rows(docs: DataFrame) -> DataFrame:
    """ANCHORS, one row for each content of a region in a block of texts; others holds the later occurrences as pairs of integers."""

    def flush(ids: list[int], texts: list[bytes]) -> pd.DataFrame:
        ends = np.cumsum([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        parts, at, begun = [], 0, 0
        while at < len(ends):  # a few MB at once, for the temporary arrays
            to = max(at + 1, int(np.searchsorted(ends, begun + (2 << 20))))
            h, c, b, s, k = anchors(data[begun : ends[to - 1]], ends[at:to] - begun)
            doc = np.searchsorted(ends[at:to] - begun, s, side="right") + at
            parts.append((h, c, b, doc, s + begun - np.where(doc > 0, ends[doc - 1], 0), k))
            begun, at = int(ends[to - 1]), to
        h, c, b, doc, s, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        ident = np.array(ids, np.int64)[doc]
        order = np.lexsort((s, ident, c, h))
        h, c, b, ident, s, k = h[order], c[order], b[order], ident[order], s[order], k[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))) if len(h) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(h)))
        others: list[bytes | None] = [None] * len(head)
        both = np.stack((ident, s), 1) if len(h) else np.zeros((0, 2), np.int64)
        for i in np.flatnonzero(size > 1).tolist():
            others[i] = both[head[i] + 1 : head[i] + size[i]].tobytes()
        return pd.DataFrame({"h": h[head], "c": c[head], "pieces": b[head], "doc": ident[head], "start": s[head].astype(np.int32), "n": k[head].astype(np.int32), "others": others})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                raw = bytes(text)
                if len(raw) >= LENGTH:
                    ids.append(doc)
                    texts.append(raw)
                    size += len(raw)
                if size >= BLOCK:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield flush(ids, texts)

    return docs.mapInPandas(run, ANCHORS)


def alike(h: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Which regions may share a string with another one of their anchor: those with a piece in common."""
    out = np.zeros(len(h), bool)
    for j in range(SIDES):
        piece = pieces.view(np.uint64) >> np.uint64(16 * j) & np.uint64(0xFFFF)
        has = np.flatnonzero(piece)
        _, which, number = np.unique(mix(h[has].view(np.uint64) ^ mix(piece[has])), return_inverse=True, return_counts=True)
        out[has] |= number[which] > 1
    return out


def repeats(rows: DataFrame) -> DataFrame:
    """REPEATS of the regions whose anchor occurs more than once. Rows of an anchor arrive in order; what is held of one is bounded by WIDE."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, int, int]] = []  # first occurrences of the present anchor's contents
        anchor, content, first, wide, out = None, None, (None, None), False, []

        def close() -> None:
            if not wide and len(held) > 1:
                out.extend((d, s, k, anchor, COMPARE, b) for d, s, k, b in held)
            held.clear()

        for batch in batches:
            # most anchors occur once and without others: they are passed over together
            h = batch["h"].to_numpy()
            lone = np.ones(len(h), bool)
            lone[1:] &= h[1:] != h[:-1]
            lone[:-1] &= h[1:] != h[:-1]
            lone &= batch["others"].isna().to_numpy()
            lone[0] = lone[-1] = False
            for a, c, b, d, s, k, o in batch[~lone].itertuples(index=False):
                if a != anchor:
                    close()
                    anchor, content, wide = a, None, False
                if c != content:
                    content, first = c, (d, s)
                    if wide:
                        out.append((d, s, k, a, SINGLE, 0))
                    else:
                        held.append((d, s, k, b))
                        if len(held) > WIDE:
                            wide = True
                            out.extend((x, y, z, a, SINGLE, 0) for x, y, z, _ in held)
                            held.clear()
                elif (d, s) != first:
                    out.append((d, s, k, 0, GONE, 0))
                if o is not None:
                    for x, y in np.frombuffer(o, np.int64).reshape(-1, 2).tolist():
                        if (x, y) != first:
                            out.append((x, y, k, 0, GONE, 0))
            if len(out) >= 50_000:
                yield frame(out)
                out.clear()
        close()
        yield frame(out)

    def frame(out: list) -> pd.DataFrame:
        x = pd.DataFrame(out, columns=["doc", "start", "n", "h", "kind", "pieces"], dtype="int64")
        apart = (x["kind"] == COMPARE).to_numpy()
        apart[apart] = ~alike(x["h"].to_numpy()[apart], x["pieces"].to_numpy()[apart])
        return x[~apart].drop(columns="pieces")

    parts = shuffle_parts(rows.sparkSession)
    return stored(rows.repartition(parts, "h").sortWithinPartitions("h", "c", "doc", "start").mapInPandas(run, REPEATS))


def suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least; symbols below 2 ** 9."""
    n = len(symbols)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = symbols
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key << np.uint64(9) | padded[i : i + n]
    order = np.argsort(key)
    width = 7
    while True:
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if width >= depth or rank[order[-1]] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - width)] = rank[width:] + 1
        key = rank * np.int64(n + 1) + follow
        order = np.argsort(key)
        width *= 2


def long_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place whether its suffix shares `length` symbols or more with the one before.

    An interval of the order holds the suffixes that begin with one string. Each is extended backwards by all symbols before it, by ranks in the transform; the
    place behind the new interval, if no shorter string has ended there, has just the old string's length as its common prefix. Places that no string below `length` ends
    at are left.
    """
    n = len(symbols)
    order = suffixes(symbols, length)
    last = symbols[order - 1]
    bits = int(symbols.max()).bit_length()
    wavelet = Wavelet(last, bits)
    first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=1 << bits))))
    closed = np.zeros(n + 1, bool)
    closed[[0, n]] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        a, z, code = lo, hi, np.zeros(len(lo), np.int64)
        for level in range(bits):  # down the wavelet levels, both branches, without the empty ones
            ones = wavelet.ones[level]
            a1, z1 = ones[a].astype(np.int64), ones[z].astype(np.int64)
            a0, z0 = a - a1, z - z1
            zero, one = a0 < z0, a1 < z1
            base = wavelet.zeros[level]
            a, z, code = np.concatenate((a0[zero], base + a1[one])), np.concatenate((z0[zero], base + z1[one])), np.concatenate((code[zero] * 2, code[one] * 2 + 1))
        # a and z now are ranks shifted by the place where the symbol's run begins on the lowest level
        run = wavelet.run[code]
        new_lo, new_hi = first[code] + a - run, first[code] + z - run
        fresh = np.flatnonzero(~closed[new_hi] & (code > 0))
        ends, one = np.unique(new_hi[fresh], return_index=True)
        closed[ends] = True
        lo, hi = new_lo[fresh][one], ends
        if not len(lo):
            break
    return order, ~closed[:n]


def shard_repeats(regions: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(doc, start, number) of the strings that occur at an earlier (doc, start) in the shard. regions: doc, start, bytes."""
    sizes = np.array([len(r[2]) + 1 for r in regions])
    ends = np.cumsum(sizes)
    symbols = np.zeros(int(ends[-1]), np.int64)
    symbols[:] = np.frombuffer(b"\0".join(r[2] for r in regions) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[ends - 1] = 0
    order, long = long_prefixes(symbols, LENGTH)
    region = np.searchsorted(ends, order, side="right")
    offset = order - (ends[region] - sizes[region])
    whole = offset + LENGTH <= sizes[region] - 1
    group = np.cumsum(~long)
    group, region, offset = group[whole], region[whole], offset[whole]
    doc = np.array([r[0] for r in regions], np.int64)[region]
    start = np.array([r[1] for r in regions], np.int64)[region] + offset
    by = np.lexsort((start, doc, group))
    group, doc, start = group[by], doc[by], start[by]
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    at = np.repeat(head, np.diff(np.append(head, len(group))))
    later = (doc != doc[at]) | (start != start[at])
    return ranges(doc[later], start[later])


def ranges(doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of following starts of a document as (doc, first, number)."""
    if not len(doc):
        return []
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))))
    last = np.append(new[1:], len(doc)) - 1
    return [(int(d), int(a), int(z - a + 1)) for d, a, z in zip(doc[new], start[new], start[last], strict=True)]


def regions_of(wanted: DataFrame, texts: DataFrame, kind: int) -> DataFrame:
    """The bytes of the wanted regions: h, doc, start, body."""
    lists = wanted.where(F.col("kind") == kind).groupBy("doc").agg(F.collect_list(F.struct("start", "n", "h")).alias("_r"))
    cut = texts.join(lists, "doc").select("doc", "text", F.explode("_r").alias("_r"))
    return cut.select("_r.h", "doc", "_r.start", F.substring(F.col("text"), F.col("_r.start") + 1, F.col("_r.n") + LENGTH - 1).alias("body"))


def compared(regions: DataFrame) -> DataFrame:
    """Ranges of repeated strings by shards of anchors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        for batch in batches:
            for h, d, s, body in batch.itertuples(index=False):
                if size >= SHARD and h != last:
                    yield pd.DataFrame(shard_repeats(held), columns=["doc", "start", "n"])
                    held, size = [], 0
                held.append((d, s, body))
                size += len(body)
                last = h
        if held:
            yield pd.DataFrame(shard_repeats(held), columns=["doc", "start", "n"])

    parts = shuffle_parts(regions.sparkSession)
    return regions.repartition(parts, "h").sortWithinPartitions("h").mapInPandas(run, "doc long, start int, n int")


def singly(regions: DataFrame) -> DataFrame:
    """Ranges of repeated strings where an anchor has too many regions for a shard: each string meets its equals by two hashes."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, d, s, body in batch.itertuples(index=False):
                data = np.frombuffer(body, np.uint8)
                at = np.arange(len(data) - LENGTH + 1)
                yield pd.DataFrame({"a": Hashed(data, 1).of(at, at + LENGTH).view(np.int64), "b": Hashed(data, 2).of(at, at + LENGTH).view(np.int64), "doc": d, "start": (s + at).astype(np.int32)})

    strings = regions.mapInPandas(deal, "a long, b long, doc long, start int")
    firsts = strings.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("_f"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return strings.join(firsts, ["a", "b"]).where((F.col("doc") != F.col("_f.doc")) | (F.col("start") != F.col("_f.start"))).select("doc", "start", F.lit(1).alias("n"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary: the bytes that stay, in order), n_bytes, spans (array of struct<start, end>, bytes, end exclusive: the maximal removed runs).

    docs: doc_id, text. A null text is empty; a null doc_id stands before all others. Rows of one doc_id are taken for one document: repeated rows get the same result,
    and nothing of one counts as earlier than the same place of another. Texts under LENGTH bytes stay whole. An empty table gives no rows.
    """
    least = -(2**63)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    found = repeats(region_rows(texts))
    kinds = {r[0] for r in found.groupBy("kind").count().collect()}
    gone = found.where(F.col("kind") == GONE).select("doc", "start", "n")
    if COMPARE in kinds:
        gone = gone.union(compared(regions_of(found, texts, COMPARE)))
    if SINGLE in kinds:
        gone = gone.union(singly(regions_of(found, texts, SINGLE)))
    marks = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("marks"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(batch["doc"], batch["text"], batch["marks"], strict=True):
                spans: list[list[int]] = []
                for a, k in sorted((m["start"], m["n"]) for m in found) if found is not None else ():
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], a + k + LENGTH - 1)
                    else:
                        spans.append([a, a + k + LENGTH - 1])
                left, at = [], 0
                for a, z in spans:
                    left.append(text[at:a])
                    at = z
                left.append(text[at:])
                rows.append((doc, b"".join(left), len(text), [{"start": a, "end": z} for a, z in spans]))
            yield pd.DataFrame(rows, columns=["doc", "kept", "n_bytes", "spans"])

    out = texts.join(marks, "doc", "left").mapInPandas(cut, "doc long, kept binary, n_bytes long, spans array<struct<start:int,end:int>>")
    return out.select(F.when(F.col("doc") != least, F.col("doc")).alias("doc_id"), "kept", "n_bytes", "spans")


def digest(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return deduplicated(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
