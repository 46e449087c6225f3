"""Benchmark decontamination by an FM-index for each training shard.

A shard is a run of documents inside one task. Its words become numbers, known only for words of the test phrases; all others are
separators, and runs of known words shorter than the shortest phrase can hold no phrase and are left out. Phrases are searched backwards
through the wavelet ranks, occurrences are located by the kept suffix positions, and the spans they cover are merged for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import fmindex
from tidewatch.llm.bytehash import words
from tidewatch.llm.common import stored

#: Words of a window.
WINDOW = 13
#: A document is contaminated if 1 / SHARE of its words at least are inside occurrences.
SHARE = 20
#: Symbols of a shard's index, at least; a longer document has a shard of its own.
SHARD = 1 << 20
#: UTF-8 bytes of test items that are sent to the executors at once; a larger set goes in several blocks.
BLOCK_BYTES = 16 << 20

RESULT = "_row long, doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


class Phrases:
    """The distinct windows of a block of test items, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.ids: list[str | None] = []
        self.codes: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            code = [self.codes.setdefault(w, len(self.codes) + 1) for w in words(text)]
            if code:
                self.ids.append(item)
                for window in {tuple(code[i : i + WINDOW]) for i in range(max(1, len(code) - WINDOW + 1))}:
                    owners.setdefault(window, []).append(len(self.ids) - 1)
        self.owners = list(owners.values())
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.table = np.zeros((len(owners), WINDOW), np.int64)
        for i, w in enumerate(owners):
            self.table[i, WINDOW - len(w) :] = w
        self.shortest = int(self.lengths.min(initial=WINDOW))


class Shard:
    def __init__(self, phrases: Phrases):
        self.phrases, self.rows, self.parts, self.starts, self.size = phrases, [], [], [], 0

    def add(self, row: int, doc_id, text: str | None) -> None:
        get = self.phrases.codes.get
        code = np.array([get(w, 0) for w in words(text)], np.int64)
        known = np.concatenate(([0], (code > 0).astype(np.int8), [0]))
        step = np.diff(known)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = end - start >= self.phrases.shortest
        for a, z in zip(start[long], end[long], strict=True):
            self.parts += [code[a:z], np.zeros(1, np.int64)]
            self.starts.append((self.size, len(self.rows), a))
            self.size += int(z - a) + 1
        self.rows.append((row, doc_id, len(code)))

    def result(self) -> pd.DataFrame:
        spans: list[list] = [[] for _ in self.rows]
        items: list[list] = [[] for _ in self.rows]
        if self.size and len(self.phrases.owners):
            index = fmindex.Index(np.concatenate(self.parts))
            lo, hi = index.search(self.phrases.table, self.phrases.lengths)
            found = np.flatnonzero(lo < hi)
            count = hi[found] - lo[found]
            phrase = np.repeat(found, count)
            row = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            at = index.locate(row)
            starts = np.array(self.starts, np.int64)
            run = np.searchsorted(starts[:, 0], at, side="right") - 1
            doc, word = starts[run, 1], at - starts[run, 0] + starts[run, 2]
            length = self.phrases.lengths[phrase]
            for d, p in np.unique(np.stack((doc, phrase), 1), axis=0):
                items[d] += self.phrases.owners[p]
            order = np.lexsort((word, doc))
            for d, a, z in zip(doc[order].tolist(), word[order].tolist(), (word + length)[order].tolist(), strict=True):
                if spans[d] and a <= spans[d][-1][1]:
                    spans[d][-1][1] = max(z, spans[d][-1][1])
                else:
                    spans[d].append([a, z])
        out = pd.DataFrame({"_row": [r[0] for r in self.rows], "doc_id": pd.array([r[1] for r in self.rows], dtype="Int64"), "n_words": [r[2] for r in self.rows]})
        out["spans"] = pd.Series([[{"start": a, "end": z} for a, z in s] for s in spans], dtype=object)
        out["items"] = pd.Series([sorted({self.phrases.ids[i] for i in x}, key=lambda t: (t is None, t)) for x in items], dtype=object)
        return out


def search_block(docs: DataFrame, phrases) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Shard(phrases.value)
        for batch in batches:
            for row, doc_id, text in zip(batch["_row"], batch["doc_id"], batch["text"], strict=True):
                shard.add(row, None if pd.isna(doc_id) else int(doc_id), text)
                if shard.size >= SHARD:
                    yield shard.result()
                    shard = Shard(phrases.value)
            if len(shard.rows) >= 20_000:
                yield shard.result()
                shard = Shard(phrases.value)
        yield shard.result()

    return docs.select("_row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, RESULT)


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, spans (merged word ranges inside occurrences, end exclusive), items (ids whose windows occur, sorted as strings; null, as one, last).

    docs: doc_id, text; benchmark: item_id, text. Each row is looked at by itself, whatever its doc_id. Null and empty texts have no words; an item without words has
    no window; repeated items count under each id, and items of a null id as one. Columns beyond these are not looked at. The set of items is sent out in blocks of
    BLOCK_BYTES, each against all documents.
    """
    return located(with_rows(docs.select("doc_id", "text")), benchmark).drop("_row")


def with_rows(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_row", F.monotonically_increasing_id())


def located(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """occurrences() with the number _row of with_rows()."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) * 2 // BLOCK_BYTES))
    if blocks > 1:
        docs = stored(docs.select("_row", "doc_id", "text"))  # a row has the same number in every block
    parts = []
    for block in range(blocks):
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        phrases = spark.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in rows.collect()]))
        parts.append(search_block(docs, phrases))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    same = [F.first(c).alias(c) for c in ("doc_id", "n_words")]
    one = every.groupBy("_row").agg(*same, F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return one.withColumn("spans", merged("spans"))


def merged(column: str):
    """Ranges merged where they touch or overlap."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(out, x):
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (x["start"] <= F.try_element_at(out, F.lit(-1))["end"]), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(F.col(column)), empty, step)


def judged(found: DataFrame) -> DataFrame:
    """occurrences() with n_hit, n_items and contaminated (n_hit > 0 and SHARE * n_hit >= n_words)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    with_hits = found.withColumn("n_hit", hit)
    return with_hits.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns as they were. Each row is judged by its own text, whatever its doc_id."""
    rows = stored(with_rows(docs))
    bad = judged(located(rows, benchmark)).where("contaminated").select("_row")
    return rows.join(bad, "_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return judged(occurrences(docs, benchmark)).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


