"""Token ids of whole texts by a public tokenizer file.

Texts are split at ASCII white space, pieces of Latin letters also at the
punctuation after them; each distinct part of a batch is encoded once, and a
bounded memo keeps parts from batch to batch. That equals encoding
the whole text for tokenizers that drop white space between words, as
word_bpe_49k.json does; `by_word=False` encodes whole texts for any other file.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that a worker's memo holds; once half of them are new, those not met meanwhile go.
MEMO_PIECES = 120_000
#: Words joined for one call of the tokenizer.
JOINED = 500
SLICE_BYTES = 1 << 20

_TAIL = "".join(c for c in string.punctuation if c not in "'<|>")
_LOWER = string.ascii_lowercase + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_UPPER = string.ascii_uppercase + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file lies; callers may pass any path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of many texts at once; one per worker and file."""

    def __init__(self, path: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        self.memo: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, heads: list[str]) -> None:
        """Words of letters only, each one pre-token: many in one call, cut apart where words end."""
        groups = [heads[i : i + JOINED] for i in range(0, len(heads), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(group):
                self.memo.update(zip(group, self._each(group)))
                continue
            raw, a = ids.tobytes(), 0
            for word, b in zip(group, (cut * 4).tolist()):
                self.memo[word] = raw[a:b]
                a = b

    def ids(self, parts: pa.Array) -> pa.Array:
        """Ids of distinct parts without white space, each as the bytes of little-endian 32-bit numbers."""
        if len(self.memo) > MEMO_PIECES // 2:
            self.memo, self.before = {"": b""}, self.memo
        memo, before, names = self.memo, self.before, parts.to_numpy(zero_copy_only=False).tolist()
        out = list(map(memo.get, names))
        fresh = []
        for i in [i for i, known in enumerate(out) if known is None]:
            known = before.get(names[i])
            if known is None:
                fresh.append(i)
            else:
                out[i] = memo[names[i]] = known
        if fresh:
            plain = pc.equal(pc.utf8_ltrim(parts.take(pa.array(fresh)), _LOWER), "").to_numpy(zero_copy_only=False).tolist()
            self._letters([names[i] for i, letters in zip(fresh, plain) if letters])
            rest = [names[i] for i, letters in zip(fresh, plain) if not letters]
            memo.update(zip(rest, self._each(rest)))
            for i in fresh:
                out[i] = memo[names[i]]
        return pa.array(out, pa.large_binary())

    def pieces(self, pieces: pa.Array) -> pa.Array:
        """The same of pieces: Latin letters and the punctuation after them are two parts, any other piece is one."""
        after = pc.utf8_ltrim(pieces, _UPPER + _LOWER)
        two = pc.and_(pc.equal(pc.ascii_ltrim(after, _TAIL), ""), pc.less(pc.binary_length(after), pc.binary_length(pieces)))
        heads = pc.if_else(two, pc.utf8_lower(pc.ascii_rtrim(pieces, _TAIL)), pieces)
        parts = pa.concat_arrays([heads, pc.if_else(two, after, "")]).dictionary_encode()
        order = parts.indices.to_numpy().reshape(2, -1).T.ravel()
        _, offsets, raw = self.ids(parts.dictionary).take(pa.array(order)).buffers()
        ends = np.frombuffer(offsets, np.int64, len(order) + 1)[::2]
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends.tobytes()), raw or pa.py_buffer(b"")])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, little-endian 32 bit, and where each row's begin and end; null text has none."""
        column = pc.fill_null(column.cast(pa.string()), "")
        if not self.by_word:
            rows = self._each(column.to_pylist())
            lengths = np.array([len(x) // 4 for x in rows], np.int64)
            return np.frombuffer(b"".join(rows), "<u4"), np.concatenate([[0], np.cumsum(lengths)])
        split = pc.ascii_split_whitespace(column)
        distinct = split.flatten().dictionary_encode()
        if not len(distinct):
            return np.zeros(0, "<u4"), np.zeros(len(column) + 1, np.int64)
        _, offsets, raw = self.pieces(distinct.dictionary).take(distinct.indices).buffers()
        total = np.frombuffer(offsets, np.int64, len(distinct) + 1) // 4
        cut = split.offsets.to_numpy()
        return np.frombuffer(raw or b"", "<u4", total[-1]), total[cut - cut[0]]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_word: bool = True) -> Encoder:
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = Encoder(path, by_word)
    return _ENCODERS[path, by_word]


def encoded(batches: Iterator[pa.RecordBatch], path: str, by_word: bool = True):
    """For each bounded slice: the rows, all their ids, and where each row's ids begin and end."""
    from ._text import slices

    own = encoder(path, by_word)
    for batch in slices(batches, limit=SLICE_BYTES):
        yield (batch, *own.encode(batch.column("text")))
