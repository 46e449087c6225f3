"""Sum-of-squares packing against whole-text encoding and a plain loop over gaps."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import squares, tokens

DOCS = "doc_id long, text string, length long, _row string, piece string"
TEXTS = [None, "", " ", "One two, three.", "One two, three.", "l'été n'est-ce pas 'tis it's IT'S", "x" * 70_000, "word and more　of it\x1c \n\t" * 900, "<|endoftext|> a <|startoftext|>b", "é 가가 1١½2", "a. b! c? " * 5000]


def plain(lengths, capacity):
    """Every open gap's change of the sum of squares is computed from the whole sum."""
    gaps, out = [], []
    for x in lengths:
        best = None
        total = defaultdict(int)
        for g in gaps:
            if g:
                total[g] += 1
        for g in sorted({g for g in gaps if g >= x and g}):
            after = dict(total)
            after[g] -= 1
            if g > x:
                after[g - x] = after.get(g - x, 0) + 1
            score = sum(v * v for v in after.values())
            if best is None or score < best[0]:
                best = (score, g)
        if best is None:
            gaps.append(capacity - x)
            out.append(capacity)
        else:
            gaps[gaps.index(best[1])] -= x
            out.append(best[1])
    return len(gaps), out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_places_take_the_smallest_sum_of_squares(lengths):
    sequence, offset = squares.places(np.array(lengths, np.int64), 20)
    n, gaps = plain(lengths, 20)
    assert len(set(sequence.tolist())) == n and (20 - offset).tolist() == gaps


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab Zé'.,;:\n\t 　́▁ßΣσ1９½世🙂\x1c\x85\x00-_|<>s가ᅡ", max_size=20))
def test_parts_give_the_ids_of_the_text(text):
    encoder = tokens.word_encoder(tokens.place(squares.VOCABULARY))
    assert np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == encoder.coder.encode(text, add_special_tokens=False).ids


def test_forgotten_parts_are_encoded_again():
    encoder = tokens.WordEncoder(tokens.place(squares.VOCABULARY))
    encoder.parts.size = 3
    texts = ["one two three four", "five one", "", "two, six!"]
    assert [encoder.ids([t])[0] for t in texts] == [tokens.word_encoder(tokens.place(squares.VOCABULARY)).ids([t])[0] for t in texts]


@pytest.mark.parametrize("group_rows", [squares.GROUP_ROWS, 4])
def test_packed_holds_every_token_once(spark, group_rows):
    docs = spark.createDataFrame([(i % 9 or None, t, 7, "x", "y") for i, t in enumerate(TEXTS + TEXTS)], DOCS)
    rows = squares.packed(docs, group_rows=group_rows).collect()
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokens.place(squares.VOCABULARY))
    want = []
    for i, t in enumerate(TEXTS + TEXTS):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i % 9 or -1, k, s, ids[s : s + 2048]) for k, s in enumerate(range(0, len(ids), 2048))]
    got = [(r.doc_id or -1, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    filled = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4
        filled[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in filled.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    whole = {r.sequence_id: bytes(r.ids) for r in squares.sequences(squares.packed(docs, group_rows=group_rows)).collect()}
    assert sorted(whole.values()) == sorted(b"".join(p[2] for p in sorted(parts)) for parts in filled.values())


def test_digest_and_few_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = squares.digest(docs).collect()
    full = {(r.doc_id, r.piece): r for r in squares.packed(docs).collect()}
    assert len(rows) == len(full)
    assert all(r.ids_crc32 == zlib.crc32(full[(r.doc_id, r.piece)].ids) for r in rows)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) + 3


def test_empty(spark):
    assert squares.packed(spark.createDataFrame([], DOCS)).count() == 0
    assert squares.sequences(squares.packed(spark.createDataFrame([], DOCS))).count() == 0
