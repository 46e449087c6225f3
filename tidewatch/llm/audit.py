"""Filter interaction audit over a sparse document-term matrix.

A shard is a run of documents inside one task: its words get numbers of the shard, and its documents rows of a compressed sparse matrix. The shards' word lists,
far smaller than the texts, meet in one dictionary that numbers the words of the whole table without gaps, and every shard's columns are renumbered with it.
Row sums are the documents' words and nonzero counts their different words; with the flags that the text itself and its copies give they become one
number of five bits, and a table of counts by part and number answers every order of the filters.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import CELL_ROWS, known, shuffle_parts, stored, text_or_empty

#: The filters' letters, and their limits.
FILTERS, LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS, CAPITALS = "ABCDE", 50, 65, 5, rb"[#$%&*|]", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that only continue a code point.
CONTINUING = bytes(range(0x80, 0xC0))
#: Text bytes of a shard, at least; a longer document has a shard of its own.
SHARD_BYTES = 8 << 20
#: Shards of a stored file, at most: a reader holds as many at once.
SHARDS_A_FILE = 4
#: Cells, or shards, of a task: there are more tasks than the session's shuffle partitions where these would hold more.
CELLS_A_TASK, SHARDS_A_TASK = 16, 8


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def marks(data: bytes) -> int:
    """The bits of C and D for a text in UTF-8."""
    capitals = len(data) - len(data.translate(None, CAPITALS))
    length = len(data.translate(None, CONTINUING))
    return bit("C") * (100 * capitals > MOST_CAPITALS * length) + bit("D") * bool(re.search(SIGNS, data))


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 31 as four rows of bytes, the lowest first: the upper ones are nearly all 0, which compression takes away."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard (number), the other columns of docs as arrays (one element a document), marks (bits of C and D), indptr, gaps (places in words, each less the one before it in its document) and counts as planes(), n_words, words (distinct, as they first occur).

    docs: text (not null) and any other columns. Words are the longest runs without the characters space and U+0009 to U+000D, in their own case.
    """
    carried = [*[c for c in docs.columns if c != "text"], "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, size, held, found = 0, 0, [], []

        def shard() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            # split at exactly the six characters that end a word
            lists = pc.ascii_split_whitespace(rows.column("text").chunk(0))
            document = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
            coded = lists.flatten().dictionary_encode()
            place, words = coded.indices.to_numpy(), coded.dictionary
            empty = pc.index(words, pa.scalar("", words.type)).as_py()
            if empty >= 0:
                document, place = document[place != empty], place[place != empty]
                place, words = place - (place > empty), pa.concat_arrays([words[:empty], words[empty + 1 :]])
            used = (document << 32) | place
            used.sort()
            at = np.flatnonzero(np.diff(used, prepend=-1))
            counts, used = np.diff(at, append=len(used)), used[at]
            ends = np.searchsorted(used, np.arange(rows.num_rows + 1) << 32)
            place = used & 0xFFFFFFFF
            gaps = np.diff(place, prepend=0)
            starts = ends[:-1][np.diff(ends) > 0]
            gaps[starts] = place[starts]
            columns = [*[rows.column(c).chunk(0) for c in carried[:-1]], pa.array(found, pa.int32()), pa.array(ends, pa.int64()), words]
            *lists, listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns]
            return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + made]), *lists, *[pa.array([planes(x)]) for x in (gaps, counts)], pa.array([len(words)]), listed],
                                              names=["shard", *carried, "indptr", "gaps", "counts", "n_words", "words"])

        for batch in batches:
            begin = 0
            for i, text in enumerate(batch.column("text")):
                data = text.as_py().encode()
                found.append(marks(data))
                size += len(data) + 1
                if size >= shard_bytes:
                    held.append(batch[begin : i + 1])
                    yield shard()
                    made, size, held, found, begin = made + 1, 0, [], [], i + 1
            if begin < batch.num_rows:
                held.append(batch[begin:])
        if held:
            yield shard()

    lists = ", ".join(f"`{c}` array<{k}>" for c, k in docs.dtypes if c != "text")
    lists = f"{lists}, " if lists else ""
    return docs.select("text", *carried[:-1]).mapInArrow(run, f"shard long, {lists}marks array<int>, indptr array<long>, gaps binary, counts binary, n_words long, words array<string>")


def matrix(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(dictionary, matrix): dictionary has word, word_id (distinct, from 0); matrix is shards() without words and with indices (word_ids) for gaps, counts as an array.

    A document's row is its slice of indices (in the order of first use in its shard) and counts. No word is left out and none are hashed together: a hash only deals the
    words into cells, where they are ranked; word_id is rank times cells plus cell. Word lists are shuffled once to the cells and once, as numbers, to their shards.
    Spark reads a file's shards into memory together, so a file holds few of them; tasks are as many as the words and shards ask for.
    """
    least = shuffle_parts(docs.sparkSession)

    def dealt(rows: DataFrame, key: str, parts: int) -> DataFrame:
        return rows.repartition(parts, key) if parts > least else rows

    local = stored(shards(docs, shard_bytes), "zstd", SHARDS_A_FILE)
    made, n_words = local.agg(F.count(F.lit(1)), F.sum("n_words")).first()
    cells, groups = max(1, -(-(n_words or 0) // CELL_ROWS)), -(-made // SHARDS_A_TASK)
    listed = local.select("shard", F.posexplode("words").alias("place", "word")).withColumn("_cell", F.pmod(F.xxhash64("word"), F.lit(cells)))
    # a word stands once in a shard's list at most, so no word has more rows here than there are shards
    rank = F.dense_rank().over(Window.partitionBy("_cell").orderBy("word")).cast("long") - 1
    coded = dealt(listed, "_cell", -(-cells // CELLS_A_TASK)).withColumn("word_id", rank * cells + F.col("_cell"))

    def renumber(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        ids = np.zeros(pairs.num_rows, np.int64)
        ids[pairs.column("place").to_numpy()] = pairs.column("word_id").to_numpy()
        ends = rows.column("indptr").combine_chunks().flatten().to_numpy()
        gaps, counts = (from_planes(rows.column(c)[0].as_buffer()) for c in ("gaps", "counts"))
        total = np.append(0, np.cumsum(gaps.astype(np.int64)))
        index = total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))
        new = [pa.ListArray.from_arrays(pa.array([0, len(index)], pa.int32()), pa.array(x)) for x in (counts, ids[index] if len(index) else np.zeros(0, np.int64))]
        return rows.drop(["gaps", "counts"]).append_column("counts", new[0]).append_column("indices", new[1])

    rows = local.drop("words", "n_words")
    kept = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c not in ("gaps", "counts"))
    pairs, rows = (dealt(x, "shard", groups) for x in (coded.select("shard", "place", "word_id"), rows))
    joined = pairs.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(renumber, f"{kept}, counts array<int>, indices array<long>")
    return coded.select("word", "word_id").distinct(), joined


def row_counts(csr: DataFrame) -> DataFrame:
    """The carried columns of each document, words (row sum) and distinct_words (nonzero count) of a matrix."""
    kinds = {c: k[6:-1] for c, k in csr.dtypes if c not in ("shard", "indptr", "indices", "counts")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends, counts = (batch.column(c)[i].values.to_numpy() for c in ("indptr", "counts"))
                total = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[i].values for c in kinds], pa.array(np.diff(total[ends])), pa.array(np.diff(ends))], names=[*kinds, "words", "distinct_words"])

    out = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return csr.drop("shard", "indices").mapInArrow(run, f"{out}, words long, distinct_words long")


def firsts(rows: DataFrame, n: int) -> DataFrame:
    """The rows with _first: where other rows have the same _text, the smallest doc_id of them all; else null. rows: doc_id, _text (a hash)."""
    repeated = rows.groupBy("_text").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_weight")).where("_weight > 1")
    return known(rows, stored(repeated), "_text", n)


def flags(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: doc_id, part, failed (bit 0 for A to bit 4 for E), good, toxic.

    docs: doc_id, text, source; labels: doc_id, quality, toxic. A null text is empty, a null source the part ''. E needs a smaller doc_id with the very same text, so a row of
    null doc_id never fails it and makes no other row fail it, and of equal doc_ids with equal texts neither fails because of the other. A document is good if any label
    row of its doc_id has quality 1, and toxic likewise; null ids have no labels. Other columns of either table are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    _, csr = matrix(rows.select("*", F.sha2("text", 256).alias("_text")), shard_bytes)
    counted = F.when(F.col("words") < LEAST_WORDS, bit("A")).otherwise(0) + F.when(100 * F.col("distinct_words") < LEAST_DISTINCT * F.col("words"), bit("B")).otherwise(0)
    facts = stored(row_counts(csr).select("doc_id", "part", "_text", (F.col("marks") + counted).alias("marks")))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("_l")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    joined = firsts(facts, facts.count()).join(marks, F.col("doc_id") == F.col("_l"), "left")
    failed = F.col("marks") + F.when(F.col("_first") < F.col("doc_id"), bit("E")).otherwise(0)
    return joined.select("doc_id", "part", failed.cast("int").alias("failed"), (F.coalesce("_good", F.lit(0)) == 1).alias("good"), (F.coalesce("_toxic", F.lit(0)) == 1).alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bits of the filters before, bit of the step's filter) for all orders."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            out.append(("".join(order), step, before, bit(letter)))
            before |= bit(letter)
    return out


def audited(flagged: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part and all 120 orders. flagged: part, failed, good, toxic.

    The documents become at most 32 counts a part first; those alone are held against the 600 steps. No documents, no parts, no rows.
    """
    counts = flagged.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("g"), F.sum(F.col("toxic").cast("long")).alias("t"))
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("bit")) for o, s, b, f in orders()])
    held = counts.select("part", "failed", "n", "g", "t", F.explode(steps).alias("s")).select("part", "failed", "n", "g", "t", "s.*")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    gone = F.col("failed").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, column: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0)).cast("long")

    share = F.col("n") * (F.lit(120) / F.bit_count("failed")).cast("long")  # a document is removed by each of its filters in as many orders
    return held.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"), total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(~gone & fails, "g").alias("good_lost"), total(~gone & fails, "t").alias("toxic_lost"), F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audited(flags()) of whole tables."""
    return audited(flags(docs, labels))
