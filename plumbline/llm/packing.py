"""Sum-of-squares online packing of documents into windows of tokens.

Each task packs its own documents as they come.  A document longer than a
window fills whole windows first; the rest goes, unsplit, to the fill level h
that makes the sum of squared counts of partially filled windows least
(Csirik et al.): from level h it moves one window to h + s, so the change is
2 (N[h + s] - N[h] + 1), and a new window changes 2 N[s] + 1.  The counts are
one array of levels.  When the input ends, the least filled windows are cut
freely to top up the fullest ones, so that a task leaves at most one window
with padding.  No row is shuffled.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, portions

WINDOW = 4096
_FIELDS = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Packs pieces (start, bytes, info) of one task.

    A window is a list of pieces; ``levels[h]`` counts the partially filled
    windows with h tokens, ``open[h]`` holds them.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def place(self, size: int) -> int:
        """The level (0: a new window) that a piece of ``size`` tokens goes to."""
        n, w = self.levels, self.window
        after = n[size : w + 1].copy()
        after[-1] = 0  # a full window isn't counted
        here = n[: w + 1 - size]
        delta = 2 * (after - here + 1)
        delta[-1] = 1 - 2 * here[-1]
        delta[0] = 2 * n[size] + 1
        delta[1:][here[1:] == 0] = np.iinfo(np.int64).max
        # ties: the fullest level
        return len(delta) - 1 - int(np.argmin(delta[::-1]))

    def add(self, start: int, ids: bytes, info: tuple):
        """Place one document; yields the windows that are full now."""
        at, step = 0, 4 * self.window
        while len(ids) - at >= step:
            yield [(start + at // 4, ids[at : at + step], info)]
            at += step
        rest = ids[at:]
        if not rest:
            return
        size = len(rest) // 4
        level = self.place(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
        pieces.append((start + at // 4, rest, info))
        if level + size == self.window:
            yield pieces
        else:
            self.open[level + size].append(pieces)
            self.levels[level + size] += 1

    def close(self):
        """Cut the emptiest windows to fill the fullest; one may stay partial."""
        left = [(h, p) for h in sorted(self.open, reverse=True) for p in self.open[h]]
        i, j = 0, len(left) - 1
        while i < j:
            (need, full), (have, spare) = left[i], left[j]
            need = self.window - need
            while need and spare:
                start, ids, info = spare.pop()
                take = min(need, len(ids) // 4)
                keep = len(ids) // 4 - take
                full.append((start + keep, ids[4 * keep :], info))
                if keep:
                    spare.append((start, ids[: 4 * keep], info))
                need, have = need - take, have - take
            left[j] = (have, spare)
            left[i] = (self.window - need, full)
            if not need:
                yield full
                i += 1
            if not spare:
                j -= 1
        if i == j and left[i][1]:
            yield left[i][1]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: int | None = None) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its ids by ``vocabulary`` and then ``end_id``; a null or
    empty text is that one id.  Each id lies in exactly one piece.  Rows with
    a null or repeated id are packed like any other.  sequence_id is the
    task's number and a count in it, unique over the table; an empty table
    gives an empty result.  A worker keeps ``keep`` words (``KEEP`` if not given).
    """

    def run(batches):
        enc = encoder(vocabulary, keep)
        packer, number = SumOfSquares(window), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def emit(pieces):
            nonlocal number
            at = 0
            for start, ids, (key, total) in pieces:
                n = len(ids) // 4
                rows.append((key, start, n, zlib.crc32(ids), total, number, at))
                at += n
            number += 1

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return batch

        for b in batches:
            for first, end in portions(b.column(1)):
                part = b.slice(first, end - first)
                ids, edges = enc.encode_column(part.column(1), end_id)
                at = edges.tolist()
                for key, lo, hi in zip(part.column(0).to_pylist(), at, at[1:]):
                    for pieces in packer.add(0, ids[lo:hi].tobytes(), (key, hi - lo)):
                        emit(pieces)
                yield flush()
            # Arrow's pool keeps a batch's memory, for as long as the worker lives, unless told
            b = part = ids = None
            pa.default_memory_pool().release_unused()
        for pieces in packer.close():
            emit(pieces)
        yield flush()

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, _FIELDS)
    return out.withColumnRenamed("id", id_col)
