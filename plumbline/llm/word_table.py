"""BPE by a table of distinct words.

Texts are cut into the words of the tokenizer's pre-tokenizer.  A task keeps
each text as the sequence of its words' numbers in a block of texts, and each
word of the block once; so a word, however frequent, is told once a block.
Words go to buckets by their hash; a bucket's task encodes each of its distinct
words once, and the ids go back to the blocks, where they are put at the places
that the numbers tell.  Decoding looks the pieces of ids up in the id-to-piece
table; its ids are dense, so that join is by position.

A block's words of one bucket travel as one packed row, since rows of single
words would be several times as large.  Frequent words have small numbers:
bucket b of B has the numbers b, b + B, b + 2B and so on, by falling count.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from ..shared import fresh_path
from .bpe import SPACE

#: Characters of a block (one text more at most), and those cut at a time.
BLOCK, STEP = 8 << 20, 4 << 20
#: Bytes of text for which there is a bucket of words.
BUCKET = 16 << 20
#: Places of a text that are worked on at a time.
PLACES = 1 << 21

_STRETCH = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: No word lies across such a place, and none depends on what is before it.
_BORDER = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: A stretch of letters that all versions of Unicode know, one blank before it, one mark after it.
_PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]?)")
_HELD: dict = {}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
        raise ValueError("the file must be a byte-level BPE without a normalizer")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens must match as they are")
    return spec


def _alphabet() -> dict[str, int]:
    """The file's character of each byte: printable ones are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pieces:
    """The id-to-piece table of a tokenizer file."""

    def __init__(self, path: str):
        spec, byte = _spec(path), _alphabet()
        named = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        piece = lambda t: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.table = pa.array([piece(named[i]) if i in named else b"" for i in range(max(named) + 1)], pa.large_binary())

    def spell(self, ids: np.ndarray) -> bytes:
        taken = self.table.take(pa.array(ids[ids < len(self.table)]))
        _, offsets, data = taken.buffers()
        edges = np.frombuffer(offsets, np.int64)
        return bytes(memoryview(data)[edges[0] : edges[len(taken)]]) if len(taken) else b""


class Vocabulary:
    """A worker's view of a tokenizer file: its cutter, its model and its added tokens."""

    def __init__(self, path: str):
        self.added = {t["content"]: t["id"] for t in _spec(path)["added_tokens"] if t["content"]}
        whole = Tokenizer.from_file(path)
        self.cutter, self.model = whole.pre_tokenizer, whole.model
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.byte = {b: c for c, b in _alphabet().items()}

    def words(self, stretch: str) -> list[str]:
        if (m := _PLAIN.fullmatch(stretch)) is None:
            return [w for w, _ in self.cutter.pre_tokenize_str(stretch)]
        word, mark = m.groups()
        word = word.encode().decode("latin-1").translate(self.byte)
        return [word, mark] if mark else [word]

    def ids(self, word: str) -> bytes:
        found = [self.added[word]] if word in self.added else [t.id for t in self.model.tokenize(word)]
        return np.array(found, "<u4").tobytes()


def _held(kind, path: str):
    """A worker's own, loaded once."""
    if (kind, path) not in _HELD:
        _HELD[kind, path] = kind(path)
    return _HELD[kind, path]


class _Stretches(dict):
    """Numbers of a block's stretches; a new one is cut into words."""

    def __init__(self, cut):
        super().__init__()
        self.cut, self.words, self.parts, self.sizes = cut, {}, [], []

    def __missing__(self, stretch):
        return self.add(stretch, self.cut(stretch))

    def add(self, stretch: str, words: list[str]) -> int:
        self[stretch] = n = len(self)
        self.parts += [self.words.setdefault(w, len(self.words)) for w in words]
        self.sizes.append(len(words))
        return n


def _spread(starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the parts of the things ``at``, one thing after the other."""
    n = sizes[at]
    ends = np.cumsum(n)
    return np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _portions(text: str):
    at = 0
    while len(text) - at > STEP and (m := _BORDER.search(text, at + STEP)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class _Block:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, _Stretches(vocabulary.words)
        self.ids, self.found, self.size = [], [], 0

    def add(self, key, text: str) -> None:
        marks, found = self.vocabulary.marks, []
        # odd parts are added tokens, which are words of their own
        for i, part in enumerate(marks.split(text) if marks else [text]):
            if i % 2:
                mark = ("mark", part)
                found.append(np.array([self.known[mark] if mark in self.known else self.known.add(mark, [part])], np.int32))
            else:
                for x in _portions(part):
                    found.append(np.fromiter(map(self.known.__getitem__, _STRETCH.findall(x)), np.int32))
        self.ids.append(key)
        self.found.append(np.concatenate(found))
        self.size += len(text)

    def _parts(self, most: int = 1 << 20):
        """The stretches of all texts, many at a time."""
        held, n = [np.zeros(0, np.int32)], 0
        for found in self.found:
            held.append(found)
            n += len(found)
            if n >= most:
                yield np.concatenate(held)
                held, n = [np.zeros(0, np.int32)], 0
        yield np.concatenate(held)

    def rows(self, number: int, buckets: int):
        """The block's texts as sequences of word numbers, then its words, a pack a bucket."""
        sizes, parts, words = np.array(self.known.sizes, np.int64), np.array(self.known.parts, np.int64), list(self.known.words)
        starts, often = np.cumsum(sizes) - sizes, sum(np.bincount(f, minlength=len(sizes)) for f in self._parts())
        counts = np.bincount(parts, np.repeat(often, sizes), len(words))
        bucket = np.array([zlib.crc32(w.encode()) for w in words], np.int64) % buckets
        order = np.lexsort((-counts, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        numbers = np.empty(len(words), np.int64)
        numbers[order] = bucket[order] + buckets * (np.arange(len(words)) - edges[bucket[order]])
        parts = numbers[parts]
        for k in range(0, len(self.ids), 1024):
            seqs = [_zipped(b"".join(_varint(parts[_spread(starts, sizes, f[j : j + PLACES])]) for j in range(0, len(f), PLACES))) for f in self.found[k : k + 1024]]
            yield _cut_rows(number, ids=self.ids[k : k + 1024], seq=seqs)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            pack = "\n".join(words[i] for i in order[edges[b] : edges[b + 1]])
            yield _cut_rows(number, bucket=[b], seq=[_zipped(pack.encode())])


_CUT = "block long, bucket int, id long, seq binary"


def _cut_rows(block: int, bucket=None, ids=None, seq=None) -> pa.RecordBatch:
    n, column = len(seq), lambda x, kind: pa.nulls(len(seq), kind) if x is None else pa.array(x, kind)
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * n, pa.int64()), column(bucket, pa.int32()), column(ids, pa.int64()), pa.array(seq, pa.binary())], ["block", "bucket", "id", "seq"]
    )


def _zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzipped(raw: bytes) -> bytes:
    size = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], size, "zstd", asbytes=True) if size else b""


def _varint(numbers: np.ndarray) -> bytes:
    """Seven bits a byte, low ones first; a byte's top bit tells that another follows."""
    x = numbers.astype(np.int64)
    size = 1 + sum((x >> 7 * k > 0).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(x) else 0, np.uint8)
    for k in range(5):
        m = size > k
        out[(ends - size)[m] + k] = (x[m] >> 7 * k & 127) | np.where(size[m] > k + 1, 128, 0)
    return out.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        m = last - first >= k
        out[m] |= (b[first[m] + k] & 127) << 7 * k
    return out


def cut(docs: DataFrame, path: str, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as sequences of word numbers, and each block's words once.

    ``seq`` has a text's numbers, or, where ``bucket`` isn't null, that
    bucket's words, in the file's alphabet, which has no line feed.
    """

    def run(batches):
        v, task, number = _held(Vocabulary, path), TaskContext.get().partitionId(), 0
        block = _Block(v)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                block.add(key, text.as_py() or "")
                if block.size >= BLOCK:
                    yield from block.rows(task << 32 | number, buckets)
                    number, block = number + 1, _Block(v)
        if block.ids:
            yield from block.rows(task << 32 | number, buckets)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, _CUT)


def encode_words(packs: DataFrame, path: str) -> DataFrame:
    """(block, bucket, sizes, ids) of packs of words: each distinct word of a bucket is encoded once."""

    def run(group: pa.Table) -> pa.Table:
        v, known, sizes, ids = _held(Vocabulary, path), {}, [], []
        for pack in group.column("seq"):
            found = []
            for w in _unzipped(pack.as_py()).decode().split("\n"):
                if (x := known.get(w)) is None:
                    x = known[w] = v.ids(w)
                found.append(x)
            sizes.append(_zipped(_varint(np.array([len(x) // 4 for x in found]))))
            ids.append(_zipped(_varint(np.frombuffer(b"".join(found), "<u4"))))
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return packs.groupBy("bucket").applyInArrow(run, "block long, bucket int, sizes binary, ids binary")


def _meet(texts: pa.Table, packs: pa.Table, buckets: int, pieces: Pieces | None) -> pa.Table:
    """The ids of a block's texts, from its words' ids, and what the ids spell."""
    counts, ids = ([_numbers(_unzipped(x.as_py())) for x in packs.column(c)] for c in ("sizes", "ids"))
    own, out, decoded = packs.column("bucket").to_pylist(), [], []
    sizes = np.zeros(max((b + buckets * len(n) for b, n in zip(own, counts)), default=0), np.int64)
    starts, before = np.zeros(len(sizes), np.int64), 0
    for b, n in zip(own, counts):
        at = b + buckets * np.arange(len(n))
        sizes[at], starts[at] = n, before + np.cumsum(n) - n
        before += int(n.sum())
    flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype("<u4")
    for seq in texts.column("seq"):
        at = _numbers(_unzipped(seq.as_py()))
        out.append(b"".join(flat[_spread(starts, sizes, at[k : k + PLACES])].tobytes() for k in range(0, len(at), PLACES)))
        if pieces:
            decoded.append(_spelled(pieces, out[-1]))
    got = {"id": texts.column("id"), "ids": pa.array(out, pa.binary())}
    return pa.table(got | {"decoded": pa.array(decoded, pa.string())} if pieces else got)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, ids binary) per row: whole texts' ids, little-endian unsigned
    32-bit integers, as the tokenizers library encodes them without added
    special tokens (such a token's string in a text is the token); and
    ``decoded``, if it is asked for, the text that the ids spell.

    Null is empty and has no ids; rows with null or repeated ids are encoded
    like any other; an empty table gives an empty result; other columns are
    ignored.  A task holds a block of about ``BLOCK`` characters, or one text
    that is longer.
    """
    spark, where = docs.sparkSession, fresh_path(docs.sparkSession, "cut")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-size // BUCKET))
    # a bucketed table, so that the texts needn't be shuffled to meet their words; its name is needed only to read it
    name = "cut_" + where.rsplit("-", 1)[1]
    cut(docs, path, buckets, id_col, text_col).write.bucketBy(max(1, min(100_000, -(-size // BLOCK))), "block").option("path", where).saveAsTable(name)
    rows = spark.table(name)
    coded = encode_words(rows.filter("bucket is not null").select("block", "bucket", "seq"), path)
    texts = rows.filter("bucket is null").select("block", "id", "seq")

    def meet(t: pa.Table, p: pa.Table) -> pa.Table:
        return _meet(t, p, buckets, _held(Pieces, path) if decoded else None)

    # a block of empty texts has no words, and its texts have no ids
    met = texts.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(meet, "id long, ids binary" + ", decoded string" * decoded)
    spark.sql(f"DROP TABLE {name}")
    return met.withColumnRenamed("id", id_col)


def _spelled(pieces: Pieces, raw: bytes) -> str:
    ids = np.frombuffer(raw, "<u4")
    return b"".join(pieces.spell(ids[k : k + PLACES]) for k in range(0, len(ids), PLACES)).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``: the text that the ids of each row spell.

    Bytes that are no UTF-8 become replacement characters, as in the library;
    ids that the file doesn't know spell nothing; null ids stay null.
    """
    schema = StructType([*encoded.schema]).add(out_col, "string")
    where = encoded.columns.index(ids_col)

    def run(batches):
        v = _held(Pieces, path)
        for b in batches:
            at, size = 0, 0
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in b.column(where)]
            for end, n in enumerate(sizes, 1):
                size += n
                if size >= 16 << 20 or end == len(sizes):
                    some = b.slice(at, end - at)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([_spelled(v, x.as_py()) if x.is_valid else None for x in some.column(where)], pa.string())], [*b.schema.names, out_col])
                    at, size = end, 0

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` reduced to id_col, n_tokens, ids_sha256, decoded_sha256."""
    both = encode(docs, path, id_col, text_col, decoded=True)
    return both.select(
        id_col, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )
