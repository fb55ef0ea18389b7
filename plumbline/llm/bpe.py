"""Byte-level BPE by DuckDB recursive queries inside each partition.

Texts are cut by the pattern into pieces; a piece that is a token is done.
All others become token-position rows (word, position, token), one per byte.
Each step of the recursive query joins neighbouring rows with the merge
table, takes each word's leftmost pair of least rank and contracts it, until
no word has a mergeable pair.  A query keeps the rows of all its steps, about
half the square of a word's length, so it takes words of at most ``LONG``
bytes and ``ROWS`` such rows.  Longer pieces are merged in linear memory, all
pairs of the least rank in a step.  Decoding is an ordered aggregation of the ids.

A worker keeps what it has encoded, so that a repeated piece is looked up;
all of a text is encoded, and a full store keeps what the portion at hand uses.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stretches of text, and pieces, that a worker keeps before it starts anew.
KEEP, KEEP_PIECES = 800_000, 900_000
#: A longer stretch is encoded but not kept, and a longer piece is merged outside the recursive query.
LONG = 256
#: Words, bytes of words and rows of all steps in one recursive query.
WORDS, WORD_BYTES, ROWS = 20_000, 1 << 21, 1 << 23
#: Characters of text that are encoded at a time, and ids that one query decodes.
STEP, DECODED = 4 << 20, 1 << 21

#: Unicode's White_Space, which is what \s means to the rank files' library.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_STRETCH = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Marks that are pieces of their own at the end of a stretch, after a letter or digit.
_CLOSING = ".,;:!?)"

# A row is one token of a word: nt and np are the next token and its position.
# A key packs rank, position and next position, so that its minimum is the
# leftmost pair of least rank: 17, 23 and 23 bits.
_MERGE = """
WITH RECURSIVE step(i, w, p, t) AS (
    SELECT 0, w, p, t FROM words
  UNION ALL
    SELECT c.i + 1, c.w, c.p, CASE WHEN c.p = (b.k >> 23) & 8388607 THEN (b.k >> 46)::INTEGER ELSE c.t END
    FROM step c JOIN (
        SELECT n.w, min((m.r::BIGINT << 46) | (n.p::BIGINT << 23) | n.np::BIGINT) AS k
        FROM (SELECT w, p, t, lead(t) OVER v AS nt, lead(p) OVER v AS np FROM step WINDOW v AS (PARTITION BY w ORDER BY p)) n
        JOIN merges m ON m.a = n.t AND m.b = n.nt
        GROUP BY n.w
    ) b ON b.w = c.w
    WHERE c.p <> (b.k & 8388607)
)
SELECT s.w, s.t FROM step s JOIN (SELECT w, max(i) AS i FROM step GROUP BY w) e ON s.w = e.w AND s.i = e.i ORDER BY s.w, s.p
"""
_DECODE = "SELECT d, list(t ORDER BY p) AS ts FROM ids GROUP BY d ORDER BY d"
#: Above all ranks: the pair doesn't merge.
_NONE = 1 << 62
_CODECS: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        held = dict.fromkeys(range(max(self.ranks.values()) + 1), b"") | {r: b for b, r in self.ranks.items()}
        self.tokens = pa.array(list(held.values()), pa.large_binary())
        # the pattern's classes spelled out, as this library's \s has four more characters
        own = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.pattern = regex.compile(own)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [
            (a, b, r)
            for token, r in self.ranks.items()
            for i in range(1, len(token))
            if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None
        ]
        a, b, r = (np.array(c, dtype=np.int64) for c in zip(*pairs))
        order = np.argsort(a << 32 | b)
        self.keys, self.results = (a << 32 | b)[order], r[order]
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "512MB", "temp_directory": ""})
        self.db.register("pairs", pa.table({k: pa.array(c, pa.int32()) for k, c in zip("abr", (a, b, r))}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM pairs")
        self.known: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word of at most ``LONG`` bytes, as bytes: one recursive query."""
        lens = np.array([len(x) for x in words])
        first = np.repeat(np.cumsum(lens) - lens, lens)
        w = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        p = (np.arange(lens.sum()) - first).astype(np.int32)
        self.db.register("words", pa.table({"w": w, "p": p, "t": self.bytes[np.frombuffer(b"".join(words), np.uint8)]}))
        got = self.db.sql(_MERGE).to_arrow_table()
        self.db.unregister("words")
        counts = np.bincount(got.column("w").to_numpy(), minlength=len(words))
        raw, ends = got.column("t").to_numpy().astype("<u4").tobytes(), np.cumsum(counts).tolist()
        return [raw[4 * (e - c) : 4 * e] for e, c in zip(ends, counts.tolist())]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens; _NONE where they don't merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.results[at], _NONE)

    def merge_long(self, word: bytes) -> bytes:
        """The ids of one word of any length, as bytes.

        Tokens are a linked list over the places of their first bytes.  Each
        step takes the least rank and contracts its pairs from the left; of
        pairs that overlap every second one.  A step ends at the first merge
        that makes a pair of lower rank, as that one is next.
        """
        n = len(word)
        t = self.bytes[np.frombuffer(word, np.uint8)].astype(np.int64)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive, rank = np.ones(n, dtype=bool), np.full(n, _NONE)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at, ranks):
            order = np.argsort(ranks, kind="stable")
            order = order[: np.searchsorted(ranks[order], _NONE)]
            cuts = np.flatnonzero(np.diff(ranks[order])) + 1
            for part in np.split(order, cuts) if len(order) else ():
                r = int(ranks[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(at[part])

        rank[:-1] = self._rank(t[:-1], t[1:])
        add(np.arange(n), rank)
        while heap:
            r = heapq.heappop(heap)
            found = np.unique(np.concatenate(places.pop(r)))
            found = found[rank[found] == r]
            if not len(found):
                continue
            first = np.concatenate(([True], found[1:] != nxt[found[:-1]]))
            starts = np.flatnonzero(first)
            p = found[(np.arange(len(found)) - starts[np.cumsum(first) - 1]) % 2 == 0]
            gone = nxt[p]
            # the pairs that each merge makes when those left of it are done
            token, none = np.full(len(p), r), np.full(len(p), _NONE)
            alive[gone] = False
            left = np.where(prv[p] >= 0, self._rank(np.where(alive[prv[p]], t[prv[p]], r), token), none)
            alive[gone] = True
            right = np.where(nxt[gone] < n, self._rank(token, t[np.minimum(nxt[gone], n - 1)]), none)
            lower = np.flatnonzero(np.minimum(left, right) < r)
            if len(lower):
                p, gone = p[: lower[0] + 1], gone[: lower[0] + 1]
                rest = found[found > gone[-1]]
                add(rest, rank[rest])
            after = nxt[gone]
            t[p], nxt[p] = r, after
            prv[after[after < n]] = p[after < n]
            alive[gone], rank[gone] = False, _NONE
            before = prv[p]
            at = np.unique(np.concatenate((before[before >= 0], p)))
            last = nxt[at] >= n
            rank[at[last]] = _NONE
            at = at[~last]
            rank[at] = self._rank(t[at], t[nxt[at]])
            add(at, rank[at])
        return t[alive].astype("<u4").tobytes()

    def split(self, stretch: str) -> list[bytes]:
        """The pieces of a stretch; the plain ones don't need the pattern."""
        word = stretch.rstrip(_CLOSING)
        if word.isalpha() or word[:1] == " " and word[1:].isalpha():
            tail = stretch[len(word) :]
            return [word.encode(), tail.encode()] if tail else [word.encode()]
        return [x.encode("utf-8", "surrogatepass") for x in self.pattern.findall(stretch)]

    def learn(self, stretches: set[str]) -> dict[str, bytes]:
        cut = {s: self.split(s) for s in stretches}
        wanted = {p for pieces in cut.values() for p in pieces}
        done = {p: i for p in wanted if (i := self.pieces.get(p)) is not None}
        done.update((p, np.array([r], "<u4").tobytes()) for p in wanted if p not in done and (r := self.ranks.get(p)) is not None)
        todo = sorted((p for p in wanted if p not in done), key=len)
        done.update((p, self.merge_long(p)) for p in todo if len(p) > LONG)
        todo = [p for p in todo if len(p) <= LONG]
        at = 0
        while at < len(todo):
            end, size, rows = at, 0, 0
            while end < len(todo) and end - at < WORDS and (size + len(todo[end]) <= WORD_BYTES and rows <= ROWS or end == at):
                size += len(todo[end])
                rows += len(todo[end]) ** 2 // 2
                end += 1
            done.update(zip(todo[at:end], self.merge(todo[at:end])))
            at = end
        if len(self.pieces) + len(todo) > KEEP_PIECES:
            self.pieces = {p: i for p, i in done.items() if p in self.pieces}
        self.pieces.update((p, done[p]) for p in todo)
        return {s: done[ps[0]] if len(ps) == 1 else b"".join(map(done.__getitem__, ps)) for s, ps in cut.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [_STRETCH.findall(t) for t in texts]
        wanted = set().union(*cut) if cut else set()
        new = {s for s in wanted if s not in self.known}
        if len(self.known) + len(new) > KEEP:
            # what this portion uses stays
            self.known = {s: self.known[s] for s in wanted if s in self.known}
        got = self.learn(new) if new else {}
        self.known.update((s, i) for s, i in got.items() if len(s) <= LONG)
        known, rest = self.known, {s: i for s, i in got.items() if len(s) > LONG}
        find = (lambda s: rest[s] if s in rest else known[s]) if rest else known.__getitem__
        return [b"".join(map(find, c)) for c in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids; long ones are decoded in segments,
        so that a query holds at most ``DECODED`` ids."""
        out: list[list[bytes]] = [[] for _ in ids]
        owners, parts, size = [], [], 0
        for k, x in enumerate(ids):
            for at in range(0, len(x), 4 * DECODED):
                part = x[at : at + 4 * DECODED]
                if size + len(part) > 4 * DECODED:
                    self._decode(owners, parts, out)
                    owners, parts, size = [], [], 0
                owners.append(k)
                parts.append(part)
                size += len(part)
        if parts:
            self._decode(owners, parts, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _decode(self, owners: list[int], parts: list[bytes], out: list[list[bytes]]) -> None:
        """Ordered aggregation by DuckDB; its lists are taken from the vocabulary as one column."""
        t = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
        d = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) // 4 for x in parts])
        self.db.register("ids", pa.table({"d": d, "p": np.arange(len(t), dtype=np.int64), "t": t}))
        lists = self.db.sql(_DECODE).to_arrow_table().column("ts").combine_chunks()
        self.db.unregister("ids")
        taken = self.tokens.take(lists.flatten())
        _, offsets, data = taken.buffers()
        edges = np.frombuffer(offsets, np.int64)[: len(taken) + 1]
        ends = edges[np.cumsum(lists.value_lengths().to_numpy())].tolist()
        raw, at = memoryview(data), int(edges[0])
        for k, end in zip(owners, ends):
            out[k].append(bytes(raw[at:end]))
            at = end


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a rank file; loaded once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _portions(texts: list[str]):
    """Runs of texts of about STEP characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < STEP or end == at):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary, decoded binary) per row; whole texts.

    Ids are little-endian unsigned 32-bit integers.  Null is empty and has no
    ids; rows with null or repeated ids are encoded like any other; an empty
    table gives an empty result.  Other columns are ignored.
    """

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for at, end in _portions(texts):
                ids = c.encode(texts[at:end])
                yield pa.RecordBatch.from_arrays([b.column(0)[at:end], pa.array(ids, pa.binary()), pa.array(c.decode(ids), pa.binary())], ["id", "ids", "decoded"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` reduced to id_col, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for at, end in _portions(texts):
                ids = c.encode(texts[at:end])
                sha = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[at:end], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha(ids)), pa.array(sha(c.decode(ids)))], ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
