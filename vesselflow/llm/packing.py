"""Best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_rows, texts, written
from ._text import give_back
from .tokens import encoded, tokenizer_path

LENGTH = 4096
END_ID = 1
#: Open sequences that a packing task holds; beyond it the fullest closes.
OPEN = 512
#: Sequences' worth of tokens that one task packs; more tokens make more tasks.
TASK_SEQUENCES = 4096
#: Tasks number sequences within this range.
STRIDE = 1 << 40

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, mixed long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Open bins in a bitset keyed by free space; at most `most`, and the fullest closes first."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open, self.made = length, most, 0, 0
        self.bits = 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        own = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return own

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece: the least free space that holds it, else a new bin."""
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            own = self._take(free)
        else:
            own, free = self.made, self.length
            self.made += 1
        left = free - size
        if left:
            self.bins[left].append(own)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return own, self.length - free


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, by_word: bool = True) -> DataFrame:
    """Every document's ids, `end_id` after them, cut into pieces of `length` only where they are longer.

    Null text is empty and gives the one id `end_id`; a repeated row gives its
    pieces again; an empty table gives no rows.
    """
    arrow_rows(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches):
        end = np.array([end_id], "<u4").tobytes()
        for batch, ids, at in encoded(batches, path, by_word):
            raw = ids.tobytes()
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = raw[4 * a : 4 * b] + end
                for k, s in enumerate(range(0, b - a + 1, length)):
                    part = own[4 * s : 4 * (s + length)]
                    rows.append((doc, k, s, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, PIECES.rpartition(",")[0]).withColumn("mixed", F.xxhash64("doc_id", "piece", "ids_crc32"))


def pack(cut: DataFrame, length: int = LENGTH, most: int = OPEN, task_sequences: int = TASK_SEQUENCES) -> DataFrame:
    """Place pieces (written before: they are read twice) into sequences by best fit.

    Full pieces are sequences of their own. The others are dealt by a hash over
    as many tasks as the tokens need; each task takes its pieces in hash order,
    so a task that runs again packs alike.
    """
    total = cut.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, round(total / (length * task_sequences)))

    def run(batches):
        bins, base = None, 0
        for batch in batches:
            if bins is None:
                from pyspark import TaskContext

                base = TaskContext.get().partitionId() * STRIDE
                bins = OpenBins(length, most)
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            own = np.array(placed, np.int64).reshape(-1, 2)
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*keep, pa.array(own[:, 0] + base), pa.array(own[:, 1])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
        give_back()

    spread = cut.repartition(tasks, "mixed").sortWithinPartitions("mixed", "doc_id", "piece", "start")
    return spread.drop("mixed").mapInArrow(run, PACKED)


def best_fit(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, most: int = OPEN) -> DataFrame:
    """Tokenise whole texts and pack them.

    A null or empty text is its end token alone; a very long one is cut into
    pieces; repeated rows are packed each; of sequences with equally much space one
    is taken, the same one in a rerun, and ties in hash order go by doc_id, piece
    and start. Other columns, whatever their names, are left out. An empty table gives
    no rows.
    """
    return pack(written(pieces(docs, path, length, end_id), "pieces"), length, most)
