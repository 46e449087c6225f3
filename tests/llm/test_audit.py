"""The filter interaction audit against plain Python, and its matrix against the words of the texts."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import audit
from tidewatch.llm.common import known

DOCS = "doc_id long, text string, source string, _text string, part string, words int, shard string"
LABELS = "doc_id long, quality int, toxic int, part string"
LONG = " ".join(f"w{i % 700}" for i in range(40_000))
TEXTS = [
    None, "", " \t\r\n\x0b\f ", "a b c", "a b c", "A\x1cB\x85c\xa0d　e Ünï $ C", "# " * 60, " ".join(f"x{i}" for i in range(50)), " ".join(f"x{i}" for i in range(49)), "x y " * 13 + " ".join(f"z{i}" for i in range(24)),
    LONG, LONG, "É" * 20 + "A", "AB" + "c" * 38, "ABC" + "c" * 57, "a b c",
]
ROWS = [(i if i % 5 else None, t, ["s", None, "", "hot"][i % 4]) for i, t in enumerate(TEXTS)] + [(3, "a b c", "hot"), (3, "a b c", "hot"), (2, "a b c", "s")]


def fails(rows):
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    out = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        f = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        out.append((i, s or "", f + "E" * (i is not None and low[t] < i)))
    return out


@pytest.mark.parametrize("shard_bytes", [audit.SHARD_BYTES, 40])
def test_audit_equals_a_plain_count(spark, shard_bytes):
    labels = [(3, 1, 0, "p"), (3, 0, 1, "p"), (4, None, None, "p"), (7, 1, None, "p"), (None, 1, 1, "p"), (99, 1, 1, "p"), (11, 0, 1, "p")]
    docs = spark.createDataFrame([(*r, "t", "p", 1, "x") for r in ROWS], DOCS)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audited(audit.flags(docs, spark.createDataFrame(labels, LABELS), shard_bytes)).collect()}
    good, toxic = {i for i, q, _, _ in labels if q == 1} - {None}, {i for i, _, t, _ in labels if t == 1} - {None}
    want, shares = {}, Counter()
    judged = fails(ROWS)
    for part in {p for _, p, _ in judged}:
        for order in itertools.permutations("ABCDE"):
            alive = [(i, f) for i, p, f in judged if p == part]
            whole = list(alive)
            for step, x in enumerate(order, 1):
                removed = [(i, f) for i, f in alive if x in f]
                alive = [(i, f) for i, f in alive if x not in f]
                redundant = sum(x in f for _, f in whole) - len(removed)
                want[(part, "".join(order), step)] = [len(alive), len(removed), redundant, sum(f == x for _, f in whole), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
                shares[(part, x)] += len(removed)
    assert got == {k: (*v, shares[(k[0], k[1][k[2] - 1])]) for k, v in want.items()}


@pytest.mark.parametrize("shard_bytes", [audit.SHARD_BYTES, 1, 300])
def test_matrix_is_the_words_of_the_texts(spark, shard_bytes):
    texts = [t or "" for t in TEXTS]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3)
    dictionary, csr = audit.matrix(docs, shard_bytes)
    word = {r.word_id: r.word for r in dictionary.collect()}
    assert min(word) == 0 and len(set(word.values())) == len(word) == dictionary.count()
    seen = {}
    for r in csr.collect():
        for k, key in enumerate(r.key):
            a, z = r.indptr[k : k + 2]
            seen[key] = {word[i]: n for i, n in zip(r.indices[a:z], r.counts[a:z], strict=True)}
    assert seen == {i: dict(Counter(re.findall("[^\x20\x09-\x0d]+", t))) for i, t in enumerate(texts)}


def test_a_reader_gets_few_shards_at_once(spark, monkeypatch):
    kept, keep = [], audit.stored
    monkeypatch.setattr(audit, "stored", lambda *a: kept.append(keep(*a)) or kept[-1])
    docs = spark.createDataFrame([(i, f"a b{i} a") for i in range(10)], "key long, text string").coalesce(1)
    _, csr = audit.matrix(docs, 1)
    files = [r["count"] for r in kept[0].groupBy(F.input_file_name()).count().collect()]
    assert sum(files) == csr.count() == 10 and max(files) <= 4


def test_tasks_grow_with_the_shards(spark):
    # eighty shards at eight shuffle partitions: ten tasks
    docs = spark.createDataFrame([(i, f"a b{i} a") for i in range(80)], "key long, text string")
    _, csr = audit.matrix(docs, 1)
    assert csr.rdd.getNumPartitions() == 10 and csr.count() == 80


def test_planes_are_the_numbers():
    for numbers in ([], [0], [5, 1, 2**31 - 1, 65_536, 255]):
        assert audit.from_planes(audit.planes(np.array(numbers, np.int64))).tolist() == numbers


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.digest(docs, labels).count() == 0
    assert audit.digest(spark.createDataFrame([(1, "a", "s", "", "", 1, "")], DOCS), labels).count() == 600


@pytest.mark.parametrize("hot", [2, 10, 65_536])
def test_known_keeps_every_row(spark, hot):
    keys = np.random.default_rng(1).zipf(1.5, 500) % 40
    rows = spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], "i long, k long")
    table = rows.where("k % 3 <> 0").groupBy("k").agg(F.count("*").alias("_weight"), F.min("i").alias("low"))
    got = sorted((r.i, r.k, r.low) for r in known(rows, table, "k", 500, hot).collect())
    first = {}
    for i, k in enumerate(keys.tolist()):
        first.setdefault(k, i)
    assert [(i, k, low if low is not None else -1) for i, k, low in got] == [(i, k, first[k] if k % 3 else -1) for i, k in enumerate(keys.tolist())]
