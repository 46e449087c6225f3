"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled by how often it has occurred before, so that repeats count. A sketch takes the
ELEMENTS labelled shingles of the smallest hashes and keeps them in text order (several minima for each of SKETCHES orders): two texts agree in it if they share these shingles in the same
order, which a small edit distance makes likely and a reordering unlikely. Texts that agree in one of SKETCHES sketches are candidates. They are
verified exactly: of shingle sequences of n and m with a common subsequence of c the similarity is c / (n + m - c), the Jaccard index if nothing
is moved, and it can reach THRESHOLD only inside a band around the diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.bytehash import mix, word_hashes
from tidewatch.llm.common import components, numbered, stored, text_or_empty

WORDS, THRESHOLD = 5, 0.8
#: A pair of similarity s in order agrees in a sketch with a chance of about s ** ELEMENTS; at 0.8 it is missed in all with a chance below 0.0001, and texts that
#: share no more than a common passage hardly ever meet.
SKETCHES, ELEMENTS = 32, 6
#: Texts of so few shingles, too few to choose from, have further sketches of fewer elements.
SHORT, SHORT_SKETCHES, SHORT_ELEMENTS = 30, 14, 2
SEEDS = mix(np.arange(1, SKETCHES + SHORT_SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
#: Places of a signature, a byte each: for each part of the hash space what its smallest labelled shingle is, 0 for none. Of pairs that similarity 0.8 links a share
#: of 0.8 of the places that are not empty in both agree, with a deviation of 0.0125 for long texts and less for short ones; PROBABLE is 4 deviations below.
PLACES, PROBABLE = 1024, 0.75
#: Members of a bucket that a task compares by signature with so many others.
CHUNK = 1500


def shingles(text: str | None) -> np.ndarray:
    """Hash of each run of WORDS words; of all words if there are fewer; none for no words."""
    word = word_hashes(text)
    n = len(word)
    if not n:
        return word
    size = min(n, WORDS)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = mix(out + word[i : n - size + 1 + i])
    return out


def labelled(shingle: np.ndarray) -> np.ndarray:
    """The hashes with the number of earlier equal ones mixed in."""
    order = np.argsort(shingle, kind="stable")
    ordered = shingle[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    at = np.arange(len(shingle))
    times = np.empty(len(shingle), np.uint64)
    times[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return mix(shingle + times * np.uint64(0x9E3779B97F4A7C15))


def ordered_minima(base: np.ndarray, seeds: np.ndarray, elements: int) -> np.ndarray:
    """For each seed a hash of the `elements` labelled shingles that come first in the seed's order of hashes, taken in text order."""
    n, out = len(base), []
    least = min(elements, n)
    at_once = max(1, (1 << 22) // n)
    for lo in range(0, len(seeds), at_once):
        some = seeds[lo : lo + at_once]
        value = base[None, :] * some[:, None]
        top = np.partition(value, least - 1, axis=1)[:, least - 1]
        row, place = np.nonzero(value <= top[:, None])
        if len(row) != least * len(some):  # equal hashes of different shingles
            place = np.sort(np.argsort(value, axis=1, kind="stable")[:, :least], axis=1)
        chosen = base[place.reshape(len(some), least)]
        h = some.copy()
        for i in range(least):
            h = mix(h + chosen[:, i])
        out.append(h)
    return np.concatenate(out)


def sketches(shingle: np.ndarray) -> np.ndarray:
    base = labelled(shingle)
    out = ordered_minima(base, SEEDS[:SKETCHES], ELEMENTS)
    if len(base) <= SHORT:
        out = np.concatenate((out, ordered_minima(base, SEEDS[SKETCHES:], SHORT_ELEMENTS)))
    return out


def signature(shingle: np.ndarray) -> np.ndarray:
    h = np.sort(labelled(shingle))
    place = (h >> np.uint64(54)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    out = np.zeros(PLACES, np.uint8)
    out[place[first]] = (h[first] >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    return out


def common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose pairs are at most `band` off the diagonal. Bit-parallel: a word of the band's width holds a row."""
    head = 0
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[:least] != b[:least])
    head = int(differ[0]) if len(differ) else least
    a, b = a[head:], b[head:]
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - least :][::-1] != b[len(b) - least :][::-1])
    tail = int(differ[0]) if len(differ) else least
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, list[int]] = {}
    for i, x in enumerate(b.tolist()):
        places.setdefault(x, []).append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    row, gone = full, 0  # bit i of row stands for position lo + i of b; a 0 is a step of the common length
    lo = -band
    for i, x in enumerate(a.tolist()):
        new = i - band
        for _ in range(new - lo):
            gone += not row & 1
            row = row >> 1 | 1 << (width - 1)
        lo = new
        match = 0
        for p in places.get(x, ()):
            if lo <= p < lo + width:
                match |= 1 << (p - lo)
        hit = row & match
        row = ((row + hit) | (row - hit)) & full
    return head + tail + gone + width - bin(row).count("1")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < THRESHOLD * max(n, m):
        return n == m
    need = int(np.ceil(THRESHOLD * (n + m) / (1 + THRESHOLD) - 1e-9))
    band = n + m - 2 * need  # so many shingles may be left out of either together
    once, times = np.unique(a, return_counts=True)
    other, more = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(once, other, assume_unique=True, return_indices=True)
    if np.minimum(times[i], more[j]).sum() < need:
        return False
    return common(a, b, band) >= need


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n (shingles), sketches, signature; null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", "text", F.sha2("text", 256).alias("digest"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "n": [len(s) for s in held], "sketches": [sketches(s).view(np.int64).tolist() if len(s) else [] for s in held], "signature": [signature(s).tobytes() if len(s) else b"" for s in held]})

    return stored(rows.mapInPandas(run, "doc_id long, digest string, n int, sketches array<long>, signature binary"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b that are similar. texts: id, text. Each pair's texts meet in a row; a leader's pairs may be dealt to several tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, None
        for batch in batches:
            good = []
            for a, s, t in zip(batch["a"], batch["s"], batch["t"], strict=True):
                if a != last:
                    last, left = a, shingles(s)
                good.append(similar(left, shingles(t)))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
    both = right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a")
    return both.select("a", "b", "s", "t").mapInPandas(run, "a long, b long")


def close(n: str, m: str):
    return F.least(n, m) >= THRESHOLD * F.greatest(n, m)


def probable(rows: DataFrame) -> DataFrame:
    """Pairs a, b of a bucket's members in different components whose signatures agree enough. rows: bucket, k, id, n, component, signature, sketches.

    Only ids of probable pairs leave the task, and each from the bucket of the first sketch that it agrees in. A large bucket is cut into chunks; each chunk meets each other in a task of its own.
    """
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks"))
    dealt = rows.join(sizes, "bucket").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int"))
    met = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).withColumn("_i", F.least("chunk", "_o")).withColumn("_j", F.greatest("chunk", "_o"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["_i"].iloc[0]), int(group["_j"].iloc[0])
        ids, n, part, chunk = (group[c].to_numpy() for c in ("id", "n", "component", "chunk"))
        sig = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), PLACES)
        filled = sig > 0
        k = int(group["k"].iloc[0])
        before = np.array([v[:k] for v in group["sketches"]], np.int64).reshape(len(group), k)
        others = np.flatnonzero(chunk == j)
        found = []
        for x in np.flatnonzero(chunk == i):
            y = others[(part[others] != part[x]) & (np.minimum(n[others], n[x]) >= THRESHOLD * np.maximum(n[others], n[x]))]
            if i == j:
                y = y[ids[y] > ids[x]]
            y = y[~(before[y] == before[x]).any(1)]
            for lo in range(0, len(y), 4096):
                z = y[lo : lo + 4096]
                same = ((sig[z] == sig[x]) & filled[x]).sum(1)
                z = z[same >= PROBABLE * (filled[z] | filled[x]).sum(1)]
                found.append(np.stack((np.minimum(ids[z], ids[x]), np.maximum(ids[z], ids[x])), 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return met.groupBy("bucket", "_i", "_j").applyInPandas(run, "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, component, n (shingles): component is the smallest doc_id of the near duplicates that links of similarity THRESHOLD connect.

    docs: doc_id (distinct), text. Exact copies are one text, whatever their number; null counts as empty, and texts without words link with equal texts alone.
    The members of a bucket (texts that agree in a sketch) are first compared with its smallest, which connects nearly all of them. What is then still apart is compared by
    signature inside tasks, and probable pairs again by alignment, so that no link between parts is lost.
    """
    all_rows = classes(docs)
    first = all_rows.groupBy("digest").agg(F.min("doc_id").alias("text_id"))
    members = all_rows.select("doc_id", "digest", "n").join(first, "digest")
    firsts = first.where("text_id is not null").select(F.col("text_id").alias("id"), F.col("digest").alias("_d"))
    one = all_rows.join(firsts, (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("_d"))).select("id", "n", "sketches", "signature").dropDuplicates(["id"])
    one = stored(one)
    buckets = one.where("n > 0").select("id", "n", F.posexplode("sketches").alias("k", "value")).withColumn("bucket", F.xxhash64("k", "value")).select("bucket", "k", "id", "n")
    heads = buckets.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("h"), F.count("*").alias("size")).where("size > 1").select("bucket", "h")
    entries = stored(buckets.join(heads, "bucket").select("bucket", "k", "id", "n", F.col("h.id").alias("head"), F.col("h.n").alias("head_n")))
    wanted = entries.select("id").distinct()
    all_texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    texts = stored(all_texts.join(wanted, "id", "left_semi").dropDuplicates(["id"]))
    nodes = one.select("id")
    pairs = entries.where((F.col("id") != F.col("head")) & close("n", "head_n")).select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(verified(pairs, texts))
    joined = stored(components(nodes, links))
    part = entries.select("bucket", "k", "id", "n").join(joined, "id")
    apart = part.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    rest = part.join(apart, "bucket").join(one.select("id", "signature", "sketches"), "id")
    more = stored(verified(stored(probable(rest).distinct()), texts))
    if not more.isEmpty():
        joined = stored(components(nodes, links.union(more)))
    return members.select("doc_id", "text_id", "n").join(joined.select(F.col("id").alias("text_id"), "component"), "text_id", "left").select("doc_id", "text_id", F.coalesce("component", "text_id").alias("component"), "n")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group one document stays, that of the smallest doc_id (of different texts under one doc_id, that of the smallest SHA-256); columns as they were.

    Rows of equal doc_id and text count as one: whichever of them stays, the others go. Rows of a null doc_id stay. An empty table gives no rows.
    """
    named = docs.where("doc_id is not null")
    sha = F.sha2(text_or_empty(), 256)
    texts = named.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    if not texts.where("rows > 1").isEmpty():
        return distinct_kept(docs, named, sha)
    kept = grouped(named.select("doc_id", "text")).where("doc_id = component").select(F.col("doc_id").alias("_kept"))
    return named.join(kept, named["doc_id"] == kept["_kept"], "left_semi").unionByName(docs.where("doc_id is null"))


def distinct_kept(docs: DataFrame, named: DataFrame, sha: Column) -> DataFrame:
    """keep_one() where doc_ids repeat: each pair of doc_id and text gets a number, which the search takes as its id. A row travels as one column, so no name clashes."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = stored(named.select(F.col("doc_id").cast("long").alias("id"), sha.alias("sha"), row.alias("row")).dropDuplicates(["id", "sha"]))
    keyed = stored(numbered(once, [], ["id", "sha"], "key", once.count()))
    parts = grouped(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("key"), "component")
    first = keyed.select("key", "id", "sha").join(parts, "key").groupBy("component").agg(F.min(F.struct("id", "sha", "key")).alias("first")).select(F.col("first.key").alias("key"))
    return keyed.join(first, "key", "left_semi").select("row.*").unionByName(docs.where("doc_id is null"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the near-duplicate group), text_id (smallest of the equal texts), kept, n_shingles."""
    return grouped(docs).select("doc_id", F.col("component").alias("class_id"), "text_id", (F.col("doc_id") == F.col("component")).alias("kept"), F.col("n").cast("long").alias("n_shingles"))
