"""Periodic runs of words, by recompression.

The texts of a portion, put one after the other with a word of its own between
any two, are compressed in rounds: neighbouring repeats of a symbol become one
symbol (block compression), then neighbours of a left and a right kind become
one (pair compression).  That is a run-length grammar in which equal stretches
have equal symbols but for their edges, so the longest common extension of two
places is found by rising through its levels while the symbols agree, and by
going down where they don't (Jez, 2016; I, 2017).  No suffix array is made.

A run of period q and at least four times its length has 3q places in a row
whose words equal those q further on; so one of them is a multiple of 3q.  The
candidates are those places for every q, harmonically many, and an extension to
either side of each tells the run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has this many words, and this many periods, at least.
LEAST, POWER = 6, 4
#: Characters of text that a grammar is made of (one text more at most), and candidates at a time.
PORTION, CANDIDATES = 4 << 20, 1 << 20


class Level:
    """Symbols of a level, the words that each spans, and what they are made of
    in the level below: symbol k of the places first[k] to first[k + 1]."""

    def __init__(self, symbols: np.ndarray, width: np.ndarray, first: np.ndarray | None = None, parent: np.ndarray | None = None, blocks: bool = False):
        self.symbols, self.width, self.first, self.parent, self.blocks = symbols, width, first, parent, blocks


def _joined(low: Level, starts: np.ndarray, symbols: np.ndarray, blocks: bool) -> Level:
    first = np.append(np.flatnonzero(starts), len(starts)).astype(np.int32)
    ends = np.append(0, np.cumsum(low.width, dtype=np.int64))
    return Level(symbols, np.diff(ends[first]).astype(np.int32), first, (np.cumsum(starts) - 1).astype(np.int32), blocks)


def _blocks(low: Level, free: int) -> tuple[Level | None, int]:
    """The level in which a symbol's neighbouring repeats are one symbol."""
    s = low.symbols
    starts = np.append(True, s[1:] != s[:-1])
    if starts.all():
        return None, free
    at = np.flatnonzero(starts)
    size, out = np.diff(np.append(at, len(s))), s[at].copy()
    many = size > 1
    _, name = np.unique(out[many] * (len(s) + 1) + size[many], return_inverse=True)
    out[many] = free + name
    return _joined(low, starts, out, True), free + int(name.max()) + 1


def _pairs(low: Level, free: int, borders: int, round_: int) -> tuple[Level | None, int]:
    """The level in which each neighbours of a left and a right symbol are one.

    A symbol's kind is a bit of a hash of it, another one each round, so that
    it is alike wherever the symbol stands; of the two ways to call the kinds
    that with more pairs is taken.  Borders, the symbols under ``borders``, are
    of no kind.
    """
    s = low.symbols
    mix = (s.astype(np.uint64) + np.uint64(round_ + 1)) * np.uint64(0x9E3779B97F4A7C15)
    kind = ((mix ^ mix >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40) & np.uint64(1)).astype(np.int8)
    kind[s < borders] = 2
    up, down = (kind[:-1] == 0) & (kind[1:] == 1), (kind[:-1] == 1) & (kind[1:] == 0)
    pair = up if up.sum() >= down.sum() else down
    if not pair.any():
        return None, free
    starts = np.append(True, ~pair)
    at = np.flatnonzero(starts)
    out, two = s[at].copy(), np.append(pair, False)[at]
    left = at[two]
    _, name = np.unique(s[left] * free + s[left + 1], return_inverse=True)
    out[two] = free + name
    return _joined(low, starts, out, False), free + int(name.max()) + 1


def grammar(words: np.ndarray, borders: int) -> list[Level]:
    """Levels over a sequence of words; numbers under ``borders`` stand between texts."""
    levels = [Level(words.astype(np.int64), np.ones(len(words), np.int32))]
    free, round_, idle = int(words.max()) + 1, 0, 0
    # a lone symbol between borders can't shrink; unlucky rounds are few
    while len(levels[-1].symbols) > 2 * borders - 1 and idle < 20:
        block, free = _blocks(levels[-1], free)
        if block is not None:
            levels.append(block)
        pair, free = _pairs(levels[-1], free, borders, round_)
        if pair is not None:
            levels.append(pair)
        idle, round_ = 0 if block is not None or pair is not None else idle + 1, round_ + 1
    return levels


def extension(levels: list[Level], p: np.ndarray, q: np.ndarray, back: bool = False) -> np.ndarray:
    """Words for which what begins (``back``: ends) at the places p and q is alike; p and q differ."""
    p, q, words = p.astype(np.int64), q.astype(np.int64), np.zeros(len(p), np.int64)
    step, stopped, live = -1 if back else 1, [], np.arange(len(p))

    def take(at: np.ndarray, low: Level, high: Level | None, rise: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pass what is alike on a level; the places that differ, and those to look at one level up."""
        differ, up = [], []
        while len(at):
            same = low.symbols[p[at]] == low.symbols[q[at]]
            differ.append(at[~same])
            at, n = at[same], 1
            if high is not None and (rise or high.blocks):
                left, whole = [], np.full(len(at), rise)
                for x in (p[at], q[at]):
                    begin, end = high.first[high.parent[x]], high.first[high.parent[x] + 1]
                    left.append(x - begin + 1 if back else end - x)
                    whole &= left[-1] == end - begin
                up.append(at[whole])
                n = np.minimum(*left)[~whole] if high.blocks else 1
                at = at[~whole]
            words[at] += n * low.width[p[at]]
            p[at] += step * n
            q[at] += step * n
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *differ]), np.concatenate([none, *up])

    for low, high in zip(levels, [*levels[1:], None]):
        differ, live = take(live, low, high, True)
        stopped.append(differ)
        if high is not None:
            p[live], q[live] = high.parent[p[live]], high.parent[q[live]]
    live = np.zeros(0, np.int64)
    for k in range(len(levels) - 1, 0, -1):
        high = levels[k]
        live = np.concatenate([live, stopped[k]])
        for x in (p, q):
            x[live] = high.first[x[live] + 1] - 1 if back else high.first[x[live]]
        take(live, levels[k - 1], high, False)
    return words


def _candidates(begin: np.ndarray, size: np.ndarray):
    """Arrays (place, period): for each text and period q the multiples of 3q."""
    text = np.repeat(np.arange(len(size)), size // POWER)
    ends = np.cumsum(size // POWER)
    period = np.arange(len(text)) - np.repeat(ends - size // POWER, size // POWER) + 1
    step = (POWER - 1) * period
    many = -(-(size[text] - period) // step)
    upto = np.cumsum(many)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, side="right")))
        m = many[at:end]
        k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(begin[text[at:end]], m) + k * np.repeat(step[at:end], m), np.repeat(period[at:end], m)
        at = end


def find(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts of ``size`` words each, in that order."""
    texts = len(size)
    begin = np.cumsum(size + 1) - size  # place 0 is the first border
    s = np.empty(int(size.sum()) + texts + 1, np.int64)
    border = np.append(0, begin + size)
    s[border] = np.arange(texts + 1)
    inner = np.ones(len(s), bool)
    inner[border] = False
    s[inner] = words.astype(np.int64) + texts + 1
    levels, found = None, []
    for place, period in _candidates(begin, size):
        alike = s[place] == s[place + period]
        place, period = place[alike], period[alike]
        if not len(place):
            continue
        levels = levels or grammar(s, texts + 1)
        right = extension(levels, place, place + period)
        left = extension(levels, place - 1, place + period - 1, back=True)
        length = left + right + period
        long = length >= np.maximum(LEAST, POWER * period)
        found.append(np.stack([place[long] - left[long], length[long], period[long]]))
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    # a run is also found by multiples of its period; the smallest is its own
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
    start, length, period = start[first], length[first], period[first]
    text = np.searchsorted(begin, start, side="right") - 1
    start = start - begin[text] if len(start) else start
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and the number of each text's."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, n = lists.flatten(), lists.value_lengths().to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    ends = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    edges = np.append(0, np.cumsum(n))
    return words.filter(full), np.diff(ends[edges])


def _batch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words, size = _split(texts.cast(pa.large_string()))
    text, start, length, period = find(words.dictionary_encode().indices.to_numpy(), size)
    offsets = np.append(0, np.cumsum(size))
    # words after a run's first period go
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, offsets[text] + start + period, 1)
    np.add.at(drop, offsets[text] + start + length, -1)
    keep = np.cumsum(drop)[:-1] == 0
    left = np.append(0, np.cumsum(keep))[offsets]
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.filter(pa.array(keep))), pa.scalar(" ", pa.large_string()))
    each = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    upto = np.searchsorted(text, np.arange(len(size) + 1))
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(upto, pa.int32()), each), collapsed.cast(pa.string())], ["id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, runs array<struct<start, length, period>>, collapsed) of each row.

    Words are what lies between blanks of ASCII, numbered from 0.  A run is a
    stretch of at least ``LEAST`` words and ``POWER`` times its smallest period
    that can't be longer; runs come by start, then period.  ``collapsed`` is
    the text, words joined by one blank, without those that a run has after
    its first period.  Null is empty; empty texts have no runs; rows with null
    or repeated ids are rows like any other; other columns are ignored; an
    empty table gives an empty result.  A task holds the grammar of about
    ``PORTION`` characters of text, or of one text that is longer.
    """

    def run(batches):
        for b in batches:
            sizes, at, sum_ = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist(), 0, 0
            for end, n in enumerate(sizes, 1):
                sum_ += n
                if sum_ >= PORTION or end == len(sizes):
                    yield _batch(b.column(0).slice(at, end - at), b.column(1).slice(at, end - at))
                    at, sum_ = end, 0

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    out = out.mapInArrow(run, "id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
