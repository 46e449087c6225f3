"""Vector join, near duplicates, repeated byte strings and archives against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import neardup, suffixdedup, vectorjoin, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("cell, home, visit", [(8192, 4096, 32768), (8, 5, 9)])
def test_vector_join_equals_matrix(spark, monkeypatch, cell, home, visit):
    monkeypatch.setattr(vectorjoin, "CELL", cell)
    monkeypatch.setattr(vectorjoin, "HOME_ROWS", home)
    monkeypatch.setattr(vectorjoin, "VISIT_ROWS", visit)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 12))
    v = np.concatenate([base[rng.integers(0, 20, 60)] + 0.25 * rng.normal(size=(60, 12)), base[:3] * 7, base[:3] * 7, rng.normal(size=(30, 12))]).astype(float)
    odd = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0]]
    rows = [(i, x) for i, x in enumerate(v.tolist() + odd)]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    for _ in range(200):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(v))])
    got = {r.vec_id: r for r in vectorjoin.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    for i in range(len(rows)):
        want = (int(near[i].sum()), int(label[i])) if i < len(v) else (0, i)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (*want, want[1] == i), i
    assert vectorjoin.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def jaccard(a, b):
    m = sum((a & b).values())
    return m / (sum(a.values()) + sum(b.values()) - m)


def shingled(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", "", "one", "one", "ONE", "two words"]
    for _ in range(30):
        t = [word() for _ in range(rng.choice([8, 40, 150]))]
        texts.append(" ".join(t))
        for _ in range(rng.randint(0, 3)):
            c = list(t)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(c))
                c[at : at + 1] = rng.choice([[], [word()], [c[at], word()]])
            texts.append(" ".join(c))
    texts += [texts[20]] * 3
    s = [shingled(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (s[i] and s[j] and jaccard(s[i], s[j]) >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in neardup.digest(docs(spark, texts)).collect()}
    assert {i: got[i].class_id for i in got} == {i: find(i) for i in range(len(texts))}
    kept = neardup.keep_one(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({find(i) for i in range(len(texts))}) and kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    assert neardup.digest(docs(spark, [])).count() == 0


def test_alignment_equals_table():
    rng = random.Random(3)
    for _ in range(200):
        a = np.array([rng.randrange(6) for _ in range(rng.randint(0, 25))], np.uint64)
        b = a.copy() if rng.random() < 0.3 else np.array([rng.randrange(6) for _ in range(rng.randint(0, 25))], np.uint64)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert neardup.common(a, b, 30) == t[-1, -1]
        if len(a) and len(b):
            assert neardup.similar(a, b) == (t[-1, -1] >= 0.8 * (len(a) + len(b) - t[-1, -1]) - 1e-9)


def brute_repeats(texts):
    seen, out = {}, {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen[raw[p : p + 100]] = 1
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(gone[p] and (p == 0 or not gone[p - 1]) for p in range(len(raw))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("wide", [4000, 1])
def test_repeats_equal_scan(spark, monkeypatch, wide):
    monkeypatch.setattr(suffixdedup, "WIDE", wide)
    monkeypatch.setattr(suffixdedup, "BLOCK", 3000)
    monkeypatch.setattr(suffixdedup, "SHARD", 2000)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    line, passage = text(70), text(130)
    texts = [None, "", "short", "x" * 99, "x" * 100, "x" * 450, text(400)]
    texts += [text(rng.randint(0, 120)) + rng.choice([line, passage, line + passage, passage[:101]]) + text(rng.randint(0, 120)) for _ in range(40)]
    texts += [texts[10], texts[10], texts[5], "ab" * 300, texts[6] + texts[7]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.digest(docs(spark, texts)).collect()}
    assert got == brute_repeats(texts)
    assert suffixdedup.digest(docs(spark, [])).count() == 0


def test_interval_expansion_equals_comparison():
    rng = np.random.default_rng(2)
    for alphabet in (2, 4):
        s = np.append(rng.integers(1, alphabet + 1, 600), 0)
        s[300:380] = s[20:100]
        order, long = suffixdedup.long_prefixes(s, 12)
        twice = np.concatenate((s, s))  # a string that runs over the end goes on at the start, which only those with the separator do
        for i in range(1, len(order)):
            a, b = twice[order[i - 1] :][:12], twice[order[i] :][:12]
            if 0 not in a and 0 not in b:
                assert long[i] == (a == b).all(), i


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", 100_000)
    rng = random.Random(6)
    big = "".join(rng.choice("abc\r\né") for _ in range(200_000))
    html = [None, "", "small", "small", "é" * 500, "é" * 500, "x" * 999, "x" * 999, big, big, "y" * 65_536, "WARC/1.1\r\n\r\n" * 200]
    rows = [(i, f"http://h/{i}\r\nX: y", t, 1) for i, t in enumerate(html)] + [(None, None, "z" * 2000, 1), (50, None, "z" * 2000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    got = {r.page_id: r for r in warc.digest(pages).collect()}
    assert len(got) == len(rows)
    for i, _, t, _ in rows:
        raw = (t or "").encode()
        top = max((j for j, _, x, _ in rows if j is not None and (x or "") == (t or "")), default=None)
        revisit = len(raw) >= 1000 and i != top
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None)
    assert warc.digest(pages.limit(0)).count() == 0
    state = hashlib.sha1()
    for r in warc.running(warc.chunk_rows(warc.decided(pages.where("page_id = 9")), 1000)).collect():
        state.update(r.chunk)
        assert r.running_sha1 == state.hexdigest() and len(r.chunk) <= 1000
    assert state.hexdigest() == hashlib.sha1(big.encode()).hexdigest()


def test_keep_one_with_repeated_ids_and_clashing_names(spark):
    words = [f"w{i}" for i in range(60)]
    a, near, b, c = " ".join(words), " ".join([*words[:-1], "x"]), "one two three four five six", " ".join(f"v{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, a), (2, near), (3, b), (3, c), (4, c), (5, b), (6, ""), (6, None), (None, a), (None, a)]
    table = spark.createDataFrame([(i, t, True, n, "d") for n, (i, t) in enumerate(rows)], "doc_id long, text string, _is boolean, id int, digest string")
    kept = neardup.keep_one(table)
    assert kept.columns == table.columns
    got = kept.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, a), (3, b), (3, c), (6, ""), (0, a), (0, a)])
    # distinct ids take the other way
    some = neardup.keep_one(table.where("id in (0, 3, 4, 6, 10)")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in some) == sorted([(1, a), (3, b), (4, c), (0, a)])
    assert neardup.keep_one(table.limit(0)).count() == 0
