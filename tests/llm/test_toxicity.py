"""The toxicity models against plain Python, and texts that one word tells apart."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidewatch.llm import toxicity

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def part(i):
    return zlib.crc32(str(i).encode()) % 5


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def steps(text):
    w = words(text)
    return list(zip(["", *w[:-1]], w))


def gained(a, b, n):
    share = (a + b) / (n[1] + n[0])
    return 2 * sum(k * math.log(k / (share * size)) for k, size in ((a, n[1]), (b, n[0])) if k)


def discount(values):
    once, twice = (sum(1 for x in values if x == k) for k in (1, 2))
    return once / (once + 2 * twice) if once else 0.5


def plain_scores(texts, labels):
    learnt = [(texts[i], y) for i, y in labels if part(i) > 1]
    n = collections.Counter(y for _, y in learnt)
    pairs, docs, follow, size, kinds = ([collections.Counter(), collections.Counter()] for _ in range(5))
    for text, y in learnt:
        pairs[y].update(set(steps(text)))
        docs[y].update(set(words(text)))
    for c in (0, 1):
        for (v, w), k in pairs[c].items():
            follow[c][w] += 1
            size[c][v] += k
            kinds[c][v] += 1
    every = set(follow[0]) | set(follow[1])
    sums = [sum(f.values()) for f in follow]
    total, more = sum(sums) + 0.5 * len(every), max(1, min(sums))
    low, high = [discount(f.values()) for f in follow], [discount(p.values()) for p in pairs]

    def single(w, c):
        shared = (follow[0][w] + follow[1][w] + 0.5) / total
        return (max(follow[c][w] - low[c], 0) + (low[c] * len(follow[c]) + more) * shared) / (sums[c] + more)

    def after(v, w, c):
        seen = size[0][v] + size[1][v]
        pooled = (pairs[0][v, w] + pairs[1][v, w]) / seen * single(w, c) * 2 / (single(w, 0) + single(w, 1))
        return (max(pairs[c][v, w] - high[c], 0) + (high[c] * kinds[c][v] + seen + 1) * pooled) / (size[c][v] + seen + 1)

    def weighed(x, g):
        return x * (1 - toxicity.EVIDENCE / g) if g > toxicity.EVIDENCE else 0

    def ratio(v, w):
        if w not in every:
            return 0
        one = math.log(single(w, 1) / single(w, 0))
        out = weighed(one, gained(docs[1][w], docs[0][w], n))
        if pairs[0][v, w] + pairs[1][v, w]:
            out += weighed(math.log(after(v, w, 1) / after(v, w, 0)) - one, gained(pairs[1][v, w], pairs[0][v, w], n))
        return out

    def inputs(text):
        s, k = sum(ratio(v, w) for v, w in steps(text)), len(words(text))
        return s / max(1, k), s / math.sqrt(max(1, k)), math.log1p(k)

    x = np.array([inputs(texts[i]) for i, _ in labels if part(i) == 1])
    y = np.array([y for i, y in labels if part(i) == 1])
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z, b, penalty = np.c_[np.ones(len(x)), (x - mean) / dev], np.zeros(4), np.diag([0, 0.01, 0.01, 0.01])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        b = b + np.clip(np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(4), z.T @ (y - p) - penalty @ b), -5, 5)
    line = np.c_[np.ones(len(texts)), (np.array([inputs(t) for t in texts]) - mean) / dev] @ b
    return 1 / (1 + np.exp(-np.clip(line, -40, 40)))


def run(spark, texts, labels):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = toxicity.digest(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(texts)
    return {r.doc_id: r for r in out}


@pytest.mark.parametrize("hot", [0, 65_536, 40])
def test_scores_equal_plain_models(spark, monkeypatch, hot):
    monkeypatch.setattr(toxicity, "HOT_KEYS", hot)
    rng = random.Random(11)
    mild, rude = [f"w{i}" for i in range(12)] + ["Ä", "naïve"], ["Slur", "jeer"]
    labels = [(i, int(rng.random() < 0.3)) for i in range(50)]
    texts = [" ".join(rng.choice(mild + (rude if y or rng.random() < 0.2 else [])) for _ in range(rng.randint(3, 25))) for _, y in labels]
    texts += [None, "", "slur jeer", "unseen words", texts[0], texts[0]]
    got, want = run(spark, texts, labels), plain_scores(texts, labels)
    assert len({round(x, 6) for x in want}) > 20
    assert max(abs(got[i].score - x) for i, x in enumerate(want)) < 1e-6


@pytest.mark.parametrize("form", ["this is a {} day today", "{0} {0} {0} {0} {0} {0} {0} {0} {0}"])
def test_one_word_tells_texts_apart(spark, form):
    labels = [(i, i % 2) for i in range(400)]
    texts = [form.format(("good", "bad")[y]) for _, y in labels]
    got = run(spark, texts, labels)
    assert all(got[i].predicted == y for i, y in labels)


def test_odd_tables(spark):
    labels = [(i, i % 2) for i in range(60)] + [(3, 0), (3, 1), (None, 1)]
    texts = [("plain words here", "slur words here")[i % 2] for i in range(60)]
    d = spark.createDataFrame([*enumerate(texts), (7, texts[7]), (None, "slur words here"), (None, None)], "doc_id long, text string")
    d = d.selectExpr("doc_id", "text", "1 as score", "2 as `a.b`", "3 as ratio", "4 as copies", "5 as key", "6 as toxic")
    table = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'x' as text", "0 as score")
    out = toxicity.scored(d, table)
    rows = out.collect()
    assert len(rows) == 63 and {r["a.b"] for r in rows} == {2} and {r.copies for r in rows} == {4}
    assert len({r.score for r in rows if r.text == "slur words here"}) == 1
    assert toxicity.scored(d.limit(0), table).count() == 0
