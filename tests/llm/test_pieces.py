"""Regions of one anchor are compared only where they hold a piece around it in common, and no repeat is lost by that."""

import random

import pytest

from tidewatch.llm import suffixdedup


def found(spark, texts):
    rows = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "doc long, text binary")
    return suffixdedup.repeats(suffixdedup.region_rows(rows)).collect()


def test_a_common_anchor_alone_is_not_compared(spark):
    rng = random.Random(2)
    # a phrase of 40 bytes in 60 texts: its pieces of GRAM bytes are anchors that they share, no string of LENGTH bytes is
    phrase = rng.randbytes(40)
    texts = [rng.randbytes(120) + phrase + rng.randbytes(120) for _ in range(60)]
    assert found(spark, texts) == []
    # a passage of LENGTH bytes is
    passage = rng.randbytes(100)
    texts = [rng.randbytes(120) + passage + rng.randbytes(120) for _ in range(2)]
    assert sorted((r.doc, r.kind) for r in found(spark, texts)) == [(0, suffixdedup.COMPARE), (1, suffixdedup.COMPARE)]


@pytest.mark.parametrize("wide", [4000, 3])
def test_copies_cut_at_every_place(spark, monkeypatch, wide):
    monkeypatch.setattr(suffixdedup, "WIDE", wide)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(260)
    # pieces of a passage, 100 bytes or a little longer, from every place, each in a surrounding of its own
    texts = [text(30) + passage + text(30)] + [text(50) + passage[a : a + 100 + rng.randint(0, 3)] + text(50) for a in range(0, 157, 2)]
    seen, want = set(), []
    for t in texts:
        gone = set()
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(t[i : i + 100])
        want.append(len(gone))
    got = suffixdedup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == want and sum(w > 0 for w in want) == len(texts) - 1
