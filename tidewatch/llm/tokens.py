"""Public tokenizers inside tasks: whole texts in, token ids out, each distinct part of a text encoded once in a worker.

A text is cut only where its tokenizer cuts in any case, so the ids of the parts, put together, are the ids of the text. Parts repeat
far more often than texts do; their ids stay in a table of bounded size that outlives a batch.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable

import numpy as np

#: Parts that a worker remembers; beyond it the table starts anew. It changes no result.
REMEMBERED = 1_000_000
#: Parts that are encoded in one call.
TOGETHER = 500
#: Letters that no tokenizer here joins with the ASCII signs next to them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: ASCII other than letters and the apostrophe (contractions begin with it).
SIGNS = r"\x00-&(-@\[-`{-\x7f"
#: A run of letters up to a sign, a run of signs up to a letter, or what reaches to the next place of that kind.
WORD_PARTS = re.compile(
    f"[{LETTERS}]++(?=[{SIGNS}'])|[{SIGNS}]++(?=[{LETTERS}])|(?:[{SIGNS}](?![{LETTERS}])|[{LETTERS}](?![{SIGNS}'])|[^{LETTERS}{SIGNS}])*+(?:[{SIGNS}](?=[{LETTERS}])|[{LETTERS}](?=[{SIGNS}'])|\\Z)", re.S
)
#: One space between two visible characters: it begins a token of its own in a byte-level tokenizer and in one of pieces.
BETWEEN = re.compile("(?<=[!-~À-ÖØ-öø-ɏ]) (?=[!-~À-ÖØ-öø-ɏ])")


def place(name: str) -> str:
    """The file of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered:
    """Byte strings of the parts seen last, made in batches by `make`."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], size: int = REMEMBERED):
        self.make, self.size, self.table = make, size, {}

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """The parts' byte strings put together, for each list of parts."""
        table = self.table
        asked = set().union(*lists)
        new = list(asked.difference(table))
        if new:
            if len(table) + len(new) > self.size:
                table = self.table = {p: table[p] for p in asked.intersection(table)}
            table.update(zip(new, self.make(new), strict=True))
        get = table.__getitem__
        return [b"".join(map(get, parts)) for parts in lists]


class WordEncoder:
    """A byte-pair tokenizer that drops white space and never joins a letter with a sign, except after an apostrophe."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        added = self.coder.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.mark = next(((i, t.content) for i, t in added.items() if t.special and sum(map(bool, WORD_PARTS.findall(t.content))) > 1), None)
        self.parts = Remembered(self.parts_encoded)

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def parts_encoded(self, parts: list[str]) -> list[bytes]:
        """Parts are cut inside special tokens' strings too, so none holds one: many of them are encoded as one text with a special token in between."""
        if not self.mark:
            return self.encoded(parts)
        mark, string = self.mark
        blocks = [string.join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]
        out: list[bytes] = []
        for encoding in self.coder.encode_batch_fast(blocks, add_special_tokens=False):
            ids = np.array(encoding.ids, "<u4")
            whole, at = ids.tobytes(), 4 * np.flatnonzero(ids == mark)
            out += [whole[a:z] for a, z in zip([0, *(at + 4).tolist()], [*at.tolist(), len(whole)], strict=True)]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts (unsigned 32 bits, little-endian), without special tokens being added; one that stands in a text keeps its id."""
        marked = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        out = self.parts.joined([WORD_PARTS.findall(t) for t in texts])
        for i, ids in zip(marked, self.encoded([texts[i] for i in marked]) if marked else [], strict=True):
            out[i] = ids
        return out


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TwoEncoders:
    """Byte-level tokenizer A on a space and the text, piece tokenizer B on the text (it adds the space itself)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, n_a, n_b = byte_alphabet(), self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(alphabet[c] for c in entries[i]) if i in entries and all(c in alphabet for c in entries[i]) else b"" for i in range(n_a)]
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # a piece with a space after another character could reach over the place where texts are cut
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces)
        self.parts_a, self.parts_b = Remembered(self.encoded_a), Remembered(self.encoded_b)

    def encoded_a(self, texts: list[str]) -> list[bytes]:
        out = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return [np.array(ids, "<u4").tobytes() if self.same(t, ids, self.bytes_a) else b"" for t, ids in zip(texts, out, strict=True)]

    def encoded_b(self, texts: list[str]) -> list[bytes]:
        out = self.b.encode(texts, num_threads=1)
        return [np.array(ids, "<u4").tobytes() if self.same(t, ids, self.bytes_b) else b"" for t, ids in zip(texts, out, strict=True)]

    @staticmethod
    def same(text: str, ids: list[int], table: list[bytes]) -> bool:
        return b"".join([table[i] for i in ids]) == (" " + text).encode()

    def ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of A and of B; none for a null or empty text and for one whose tokens do not give its bytes back."""
        none = np.zeros(0, "<u4")
        lists = [(BETWEEN.split(t) if self.cut else [t]) if t else [] for t in texts]
        out = []
        for t, *ids in zip(texts, self.parts_a.joined(lists), self.parts_b.joined(lists), strict=True):
            a, b = (np.frombuffer(x, "<u4") for x in ids)
            # a part that does not give its bytes back has no ids, so its bytes are missing
            size = len(t.encode()) + 1 if t else 0
            out.append((a, b) if int(self.length_a[a].sum()) == size == int(self.length_b[b].sum()) else (none, none))
        return out


@functools.lru_cache(maxsize=4)
def two_encoders(path_a: str, path_b: str) -> TwoEncoders:
    return TwoEncoders(path_a, path_b)
