"""Toxicity by class-conditional Kneser-Ney models.

A bigram model of toxic and one of ordinary text, from labelled rows. Counts are of documents, so that a burst inside one document counts once. Each class interpolates its
discounted continuation counts (how many different words a word follows) with backoff counts that both classes share, and its discounted bigram counts with the bigram's share in
both classes, moved by what its own lower order says; discounts come from counts of counts. A rare expression so has nearly the same chance in both. A log ratio weighs as much as its
evidence: with g twice the log-likelihood gained by telling the classes apart, 1 - EVIDENCE / g of it counts. Counts and log ratios are tables of words and pairs of words, named by
64-bit hashes, and grow with the labelled rows; a text's distinct words and pairs meet them and are summed. The score is a logistic function, fitted on labelled rows that the models
have not seen, of the difference of log-likelihoods by word.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewatch.llm.bytehash import mix, word_hashes
from tidewatch.llm.common import known as copies_known
from tidewatch.llm.common import stored, text_or_empty

#: Labelled rows that are sent to executors at most; more are joined by a shuffle, with the same result.
BROADCAST_ROWS = 1_000_000
#: A bitmap of 2 ** FILTER_BITS bits tells the tasks which words and pairs have a ratio.
FILTER_BITS = 26
#: Words and pairs that have more than one HOT_KEYS-th of all labelled sightings, of which there are fewer than HOT_KEYS, are sent to the tasks; the others are joined.
HOT_KEYS = 65_536
#: crc32(doc_id) mod 5: 0 is held out, 1 fits the logistic function, the rest the models.
PARTS, HELD_OUT, CALIBRATION = 5, 0, 1
#: Twice the log-likelihood that chance alone exceeds once in a hundred expressions (chi-square of one degree, fixed value).
EVIDENCE = 6.63
#: Words that a task counts before it passes them on.
FLUSH = 1 << 20
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def part(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")) % PARTS


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the rows that may be learnt from; a document labelled twice counts as toxic if one label says so."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    return usable.where(part() != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the hash of the word before (0 before the first), its own, and that of the pair."""
    w = word_hashes(text)
    v = np.concatenate((np.zeros(min(1, len(w)), np.uint64), w[:-1]))
    return v, w, mix(mix(v + np.uint64(1)) + w)


COUNTS = ("toxic", "ordinary", "first_toxic", "first_ordinary")


def pair_counts(rows: DataFrame) -> DataFrame:
    """v, w, and documents of either class that hold the pair of neighbouring words, and in how many it has the first w. rows: text, toxic.

    The last two summed over v are the documents with w. A task counts before the shuffle; its rows are in order of v, as are those of a stored part, so that v takes little room.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[tuple]] = [[], []]
        size = 0

        def counts() -> pd.DataFrame:
            out = []
            for c, some in enumerate(held):
                v, w, key, first = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (list(zip(*some, strict=True)) or [()] * 4))
                _, at, to, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                first = np.bincount(to, weights=first, minlength=len(n)).astype(np.int64)
                values = (n * c, n * (1 - c), first * c, first * (1 - c))
                out.append(pd.DataFrame({"v": v[at].view(np.int64), "w": w[at].view(np.int64), **dict(zip(COUNTS, values, strict=True))}))
            return pd.concat(out).sort_values(["v", "w"])

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                v, w, key = hashed(text)
                first = np.zeros(len(w), np.int64)
                first[np.unique(w, return_index=True)[1]] = 1
                key, at = np.unique(key, return_index=True)
                held[int(toxic)].append((v[at], w[at], key, first[at]))
                size += len(key)
                if size >= FLUSH:
                    yield counts()
                    held, size = [[], []], 0
        yield counts()

    out = rows.mapInPandas(run, "v long, w long, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.groupBy("v", "w").agg(*[F.sum(c).alias(c) for c in COUNTS]).sortWithinPartitions("v", "w")


@F.pandas_udf(LongType())
def pair_key(v: pd.Series, w: pd.Series) -> pd.Series:
    """The hash that hashed() gives a pair."""
    v, w = (x.to_numpy(np.int64).view(np.uint64) for x in (v, w))
    return pd.Series(mix(mix(v + np.uint64(1)) + w).view(np.int64))


@dataclass
class Model:
    """key, ratio: the weighed log ratio of toxic to ordinary chance of a word, and for a pair what it differs by from its second word's; 0 for what has no row.

    sent: bits of the keys of ratios, and the keys (in order) and ratios of what is frequent, which has no row in ratios.
    """

    ratios: DataFrame
    sent: Broadcast
    line: np.ndarray  # logistic coefficients


def evidence(toxic: str, ordinary: str, n: dict[str, int]) -> Column:
    """Twice the log-likelihood gained if documents of either class hold an expression at a rate of their own."""
    both = (F.col(toxic) + F.col(ordinary)) / float(n["toxic"] + n["ordinary"])
    parts = [F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * float(n[k])))).otherwise(0.0) for c, k in ((toxic, "toxic"), (ordinary, "ordinary"))]
    return (parts[0] + parts[1]) * 2


def discount(once: int | None, twice: int | None) -> float:
    """Kneser and Ney's estimate from the numbers of what was counted once and twice."""
    return (once or 0) / ((once or 0) + 2 * (twice or 0)) if once else 0.5


def taken(rows: DataFrame, columns: dict[str, str]) -> dict[str, tuple[float, int, int]]:
    """By class the discount, the sum of the counts and the number of those above 0."""
    sums = rows.agg(*[f.alias(f"{c}{i}") for c, x in columns.items() for i, f in enumerate((F.count_if(F.col(x) == 1), F.count_if(F.col(x) == 2), F.sum(x), F.count_if(F.col(x) > 0)))]).first()
    return {c: (discount(sums[f"{c}0"], sums[f"{c}1"]), sums[f"{c}2"] or 0, sums[f"{c}3"]) for c in columns}


def log_ratios(pairs: DataFrame, n: dict[str, int]) -> DataFrame:
    """Model.ratios of pair_counts() with the labelled sightings as weight, for all words and pairs whose evidence is above EVIDENCE. n: labelled documents by class."""
    classes = ("toxic", "ordinary")
    words = stored(pairs.groupBy("w").agg(*[F.count_if(F.col(c) > 0).alias(f"f_{c}") for c in classes], *[F.sum(f"first_{c}").alias(c) for c in classes]))
    low = taken(words, {c: f"f_{c}" for c in classes})
    total = sum(x[1] for x in low.values()) + 0.5 * words.count() or 1.0
    more = float(max(1, min(x[1] for x in low.values())))
    shared = F.expr("f_toxic + f_ordinary + 0.5D") / F.lit(float(total))

    def chance(c: str) -> Column:
        d, size, kinds = low[c]
        return (F.greatest(F.col(f"f_{c}") - d, F.lit(0.0)) + (d * kinds + more) * shared) / (size + more)

    plain = words.select("w", *classes, *[chance(c).alias(f"p_{c}") for c in classes]).withColumn("single", F.log(F.col("p_toxic") / F.col("p_ordinary")))
    weight = F.col("toxic") + F.col("ordinary")

    def weighed(rows: DataFrame, key: Column, value: Column) -> DataFrame:
        some = rows.withColumn("_g", evidence("toxic", "ordinary", n)).where(F.col("_g") > EVIDENCE)
        return some.select(key.alias("key"), (value * (1 - EVIDENCE / F.col("_g"))).alias("ratio"), weight.alias("weight"))

    high = taken(pairs, {c: c for c in classes})
    before = pairs.groupBy("v").agg(*[f.alias(f"{tag}_{c}") for c in classes for tag, f in (("n", F.sum(c)), ("t", F.count_if(F.col(c) > 0)))])
    telling = pairs.where(evidence("toxic", "ordinary", n) > EVIDENCE).select("v", "w", *classes)
    both = telling.join(before, "v").join(plain.select("w", "p_toxic", "p_ordinary", "single"), "w")
    seen = F.col("n_toxic") + F.col("n_ordinary")

    def follows(c: str) -> Column:
        pooled = weight / seen * F.col(f"p_{c}") * 2 / (F.col("p_toxic") + F.col("p_ordinary"))
        return (F.greatest(F.col(c) - high[c][0], F.lit(0.0)) + (high[c][0] * F.col(f"t_{c}") + seen + 1) * pooled) / (F.col(f"n_{c}") + seen + 1)

    return weighed(plain, F.col("w"), F.col("single")).union(weighed(both, pair_key("v", "w"), F.log(follows("toxic") / follows("ordinary")) - F.col("single")))


def bits(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64) & ((1 << FILTER_BITS) - 1)


def sent(ratios: DataFrame, hot: Column) -> Broadcast:
    """Model.sent. The bitmap is put together on the executors, 64 bits a row: at most 2 ** (FILTER_BITS - 6) rows, whatever the number of keys."""
    low = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    word = F.shiftright(low, 6).cast("int").alias("at")
    table = ratios.where(~hot).select(word, F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    known = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    known[table.column("at").to_numpy()] = table.column("bit").to_numpy()
    frequent = ratios.where(hot).select("key", "ratio").toArrow()
    keys, values = (frequent.column(c).to_numpy() for c in ("key", "ratio"))
    order = np.argsort(keys.view(np.uint64))
    return ratios.sparkSession.sparkContext.broadcast((known, keys.view(np.uint64)[order], values[order]))


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with the text's name: two 64-bit hashes of it."""
    text = text_or_empty()
    return docs.withColumns({"_text_a": F.xxhash64(text), "_text_b": F.xxhash64(F.lit(1), text)})


def features(docs: DataFrame, ratios: DataFrame, sent: Broadcast) -> DataFrame:
    """_text_a, _text_b of each different text with its number of copies and a, b, c: the mean log ratio by word, that times the root of the number of words, and the log of the number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, hot, value = sent.value
        made = 0
        for batch in batches:
            held = []
            size = 0
            for i, text in enumerate(batch["text"]):
                _, w, pair = hashed(text)
                key, n = np.unique(np.concatenate((w, pair)), return_counts=True)
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1) if len(hot) else np.zeros(len(key), int)
                frequent = hot[at] == key if len(hot) else np.zeros(len(key), bool)
                here = (value[at[frequent]] * n[frequent]).sum() if len(hot) else 0.0
                low = bits(key)
                some = ~frequent & ((known[low >> 6] >> (low & 63)) & 1 > 0)
                made += 1
                # what is summed here has a key of its own, which deals it over the tasks of the join
                key, m, done = np.append(key[some], mix(w[:1] + np.uint64(made)) if len(w) else np.zeros(1, np.uint64)), np.append(n[some], here), np.append(np.zeros(some.sum(), bool), True)
                held.append((np.full(len(key), i), key, m, done))
                size += len(key)
                if size >= FLUSH or i == len(batch) - 1:
                    row, keys, m, done = (np.concatenate(x) for x in zip(*held, strict=True))
                    keep = ~done | (m != 0)
                    row, keys, m, done = row[keep], keys[keep], m[keep], done[keep]
                    yield pd.DataFrame({"_text_a": batch["_text_a"].to_numpy()[row], "_text_b": batch["_text_b"].to_numpy()[row], "key": keys.view(np.int64), "m": m.astype(float), "done": done})
                    held, size = [], 0

    name = ["_text_a", "_text_b"]
    texts = keyed(docs.select(text_or_empty().alias("text")))
    met = texts.mapInPandas(run, "_text_a long, _text_b long, key long, m double, done boolean").join(ratios, "key", "left")
    sums = met.groupBy(*name).agg(F.sum(F.when(F.col("done"), F.col("m")).otherwise(F.col("m") * F.coalesce("ratio", F.lit(0.0)))).alias("sum"))
    # each copy of a text has brought its words
    copies = texts.select(*name, F.regexp_count("text", F.lit(WORD)).alias("n")).groupBy(*name).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    total = F.coalesce(F.col("sum") / F.col("copies"), F.lit(0.0))
    some = F.greatest(F.col("n"), F.lit(1))
    return copies.join(sums, name, "left").select(*name, "copies", (total / some).alias("a"), (total / F.sqrt(some)).alias("b"), F.log1p("n").alias("c"))


def fit_line(rows: DataFrame) -> np.ndarray:
    """Newton's steps for a logistic function with a small penalty, on standardised columns; each step is one aggregate. rows: a, b, c, toxic."""
    first = rows.agg(*[f(c) for f in (F.avg, F.stddev_pop) for c in "abc"]).first()
    mean, dev = np.array(first[:3]), np.array(first[3:]) + 1e-9
    z = [F.lit(1.0), *[(F.col(c) - float(m)) / float(d) for c, m, d in zip("abc", mean, dev, strict=True)]]
    b = np.zeros(4)
    penalty = np.diag([0.0] + [1e-2] * 3) + 1e-9 * np.eye(4)
    upper = [(i, j) for i in range(4) for j in range(i, 4)]
    for _ in range(60):
        line = sum(float(k) * x for k, x in zip(b, z, strict=True))
        p = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(40.0)), F.lit(-40.0))))
        named = rows.select(F.col("toxic"), p.alias("p"), *[x.alias(f"z{i}") for i, x in enumerate(z)])
        sums = named.agg(*[F.sum(F.expr(f"z{i} * z{j} * p * (1 - p)")) for i, j in upper], *[F.sum(F.expr(f"z{i} * (toxic - p)")) for i in range(4)]).first()
        curve = np.zeros((4, 4))
        for (i, j), x in zip(upper, sums[:10], strict=True):
            curve[i, j] = curve[j, i] = x
        step = np.linalg.solve(curve + penalty, np.array(sums[10:]) - penalty @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate(([b[0] - (b[1:] * mean / dev).sum()], b[1:] / dev))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The models, or None without labelled rows of both classes in either part."""
    rows = stored(labelled(labels))
    have = {(r[0], r[1]): r[2] for r in rows.groupBy((part() == CALIBRATION).alias("c"), "toxic").count().collect()}
    if len(have) < 4:
        return None
    small = sum(have.values()) <= BROADCAST_ROWS

    def with_label(which: Column) -> DataFrame:
        some = rows.where(which)
        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(some) if small else some, "doc_id").select("text", "toxic")

    learnt = with_label(part() != CALIBRATION)
    n = {"toxic": 0, "ordinary": 0} | {("ordinary", "toxic")[r[0]]: r[1] for r in learnt.groupBy("toxic").count().collect()}
    if not all(n.values()):
        return None
    ratios = stored(log_ratios(stored(pair_counts(learnt), "zstd"), n))
    hot = F.col("weight") * HOT_KEYS > (ratios.agg(F.sum("weight")).first()[0] or 0)
    known, rest = sent(ratios, hot), ratios.where(~hot).select("key", "ratio")
    learn = with_label(part() == CALIBRATION)
    x = keyed(learn).select("_text_a", "_text_b", "toxic").join(features(learn, rest, known), ["_text_a", "_text_b"])
    x = stored(x.select("a", "b", "c", "toxic"))
    if x.select("toxic").distinct().count() < 2:
        return None
    return Model(rest, known, fit_line(x))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    docs: doc_id, text; labels: doc_id, toxic. A null text counts as empty; an empty text is scored by the logistic function without any word. Without labelled rows of
    both classes every score is 0. Repeated rows get equal scores; columns named score and predicted are replaced, others stay.
    """
    model = fit(docs, labels)
    base = docs.drop("score", "predicted")
    if model is None:
        return base.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    k = [float(x) for x in model.line]
    line = k[0] + k[1] * F.col("a") + k[2] * F.col("b") + k[3] * F.col("c")
    score = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(40.0)), F.lit(-40.0))))
    by_text = stored(features(docs, model.ratios, model.sent).select("_text_a", "_text_b", score.alias("score"), F.col("copies").alias("_weight")))
    n = by_text.agg(F.coalesce(F.sum("_weight"), F.lit(0))).first()[0]
    # texts of very many copies are sent to the rows, so that their rows stay where they are
    out = copies_known(keyed(base), by_text, ["_text_a", "_text_b"], n).select(*[F.col(f"`{c}`") for c in base.columns], "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below 0.5, columns as they were."""
    return scored(docs, labels).where("predicted = 0").select(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"), labels).select("doc_id", (part() == HELD_OUT).alias("held_out"), "score", "predicted")
