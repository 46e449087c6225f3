"""Alignment of two tokenizers against a plain walk over all token pairs."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import crosstoken, tokens

DOCS = "doc_id long, text string, _row long, groups string, pairs string, piece int"
TEXTS = [
    None, "", " ", "a", "Hello world, it's 2024!", "Hello world, it's 2024!", "a▁b", "über 世界🙂 naïve", "x" * 5000, "the quick brown fox jumped over the lazy dogs. " * 400, "<|endoftext|> and <s> </s> <unk> <0x41>",
    "tab\tnew\n\nline  two   spaces ", "ｆｕｌｌ ﬁ é", "\x00\x1c\x85", "antidisestablishmentarianism pneumonoultramicroscopicsilicovolcanoconiosis",
]


def plain(text):
    e = tokens.two_encoders(*[tokens.place(v) for v in crosstoken.VOCABULARIES])
    a, b = e.a.encode(" " + (text or ""), add_special_tokens=False).ids, e.b.encode(text or "")
    want = (" " + (text or "")).encode()
    if not text or b"".join(e.bytes_a[i] for i in a) != want or b"".join(e.bytes_b[i] for i in b) != want:
        return [], [], [], []

    def ranges(ids, table):
        at = 0
        for i in ids:
            yield at, at + len(table[i]), i
            at += len(table[i])

    ra, rb = list(ranges(a, e.bytes_a)), list(ranges(b, e.bytes_b))
    links, low = [], 0
    for s, z, i in ra:
        while rb[low][1] <= s:
            low += 1
        k = low
        while k < len(rb) and rb[k][0] < z:
            links.append((i, rb[k][2]))
            k += 1
    cuts = sorted({z for _, z, _ in ra} & {z for _, z, _ in rb})
    groups = [(",".join(str(i) for s, z, i in ra if lo <= s < hi), ",".join(str(i) for s, z, i in rb if lo <= s < hi)) for lo, hi in zip([0, *cuts[:-1]], cuts)] if len(ra) < 3000 else None
    return a, b, links, groups


@pytest.mark.parametrize("work", [crosstoken.WORK, 1, 7, 100])
def test_digest_equals_a_plain_walk(spark, work):
    texts = TEXTS if work >= 100 else [t for t in TEXTS if len(t or "") < 200]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1, "g", "p", 2) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id if r.doc_id is not None else 3: r for r in crosstoken.digest(docs, work=work).collect()}
    every = [plain(t) for t in texts]
    counts = Counter(link for _, _, links, _ in every for link in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    for i, (a, b, links, groups) in enumerate(every):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_links) == (len(a), len(b), len(links)), texts[i]
        assert r.count_sum == sum(counts[x] for x in links) and r.n_best == sum(counts[x] == most[x[1]] for x in links)
        if groups is not None:
            assert r.n_groups == len(groups)
            text = ";".join("|".join(g) for g in groups)
            assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if groups else "")


def test_pieces_do_not_change_the_groups(spark):
    docs = spark.createDataFrame([(i, t, 1, "g", "p", 2) for i, t in enumerate(TEXTS)], DOCS)
    rows = [{r.doc_id: (r.groups, dict(zip(r.pairs, r.counts))) for r in crosstoken.aligned(docs, work=w).collect()} for w in (1 << 30, 501, 64)]
    assert rows[0] == rows[1] == rows[2]
    assert rows[0][4][0].count(";") + 1 == rows[0][4][0].count("|") > 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.lists(st.integers(1, 5), min_size=1, max_size=40), st.integers(1, 9))
def test_splits_lie_on_the_merge_path(a, b, work):
    a, b = np.cumsum(a), np.cumsum(b)
    path, i, j = [0], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and (j == len(b) or a[i] <= b[j]):
            i += 1
        else:
            j += 1
        path.append(i)
    assert crosstoken.splits(a, b, work).tolist() == [path[d] for d in [*range(0, len(a) + len(b), work), len(a) + len(b)]]


def test_empty(spark):
    assert crosstoken.digest(spark.createDataFrame([], DOCS)).count() == 0
