"""Token ids on disk as wavelet matrices, one compressed file per shard.

A wavelet matrix (Claude, Navarro, 2012) stores n symbols of b bits as b
bit-planes; each plane is the next bit of all symbols, which are then stably
parted by it, zeros first.  With rank on the planes a file supports access to
any token, counting a token in a range, and finding its k-th occurrence.

File layout, little-endian: magic, a JSON header's length, the header
(levels, tokens, zeros of each plane, documents, block bits, offsets), the
zstd-compressed document directory (id int64, start int64), then for each
plane its blocks, each zstd-compressed; the directory holds the ones before
each block, so rank reads one block.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise
from .files import opened, whole_file
from .tokens import encoder

MAGIC = b"WVMX0001"
BLOCK_BITS = 1 << 16
#: UTF-8 bytes of text in a shard, and in a task that writes shards; beyond so
#: many tasks each has more (its sort spills, and it still holds one shard).
SHARD_BYTES, TASK_BYTES, TASKS = 8 << 20, 24 << 20, 50_000
NULL_ID = -(1 << 63)


def build(out, ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, end_id: int) -> None:
    """Write the matrix of ``ids`` with its document directory to ``out``."""
    levels = max(1, int(ids.max(initial=1)).bit_length())
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    press = zstandard.ZstdCompressor(level=1).compress
    zeros, planes = [], []
    for level in range(levels - 1, -1, -1):
        bit = now & now.dtype.type(1 << level) != 0
        packed = np.packbits(bit, bitorder="little")
        step = BLOCK_BITS // 8
        blocks = [press(packed[i : i + step]) for i in range(0, len(packed), step)]
        ones = [0, *np.cumsum([int(np.bitwise_count(packed[i : i + step]).sum()) for i in range(0, len(packed), step)]).tolist()]
        zeros.append(int(len(bit) - ones[-1]))
        planes.append((blocks, ones))
        if level:
            now = np.concatenate([now[~bit], now[bit]])
    directory = press(np.stack([doc_ids, starts]).astype("<i8").tobytes())
    head = {
        "levels": levels, "tokens": len(ids), "docs": len(doc_ids), "end": end_id, "zeros": zeros, "directory": len(directory),
        "sizes": [[len(b) for b in blocks] for blocks, _ in planes], "ones": [ones for _, ones in planes],
    }
    text = zlib.compress(json.dumps(head).encode())
    out.write(MAGIC + struct.pack("<Q", len(text)) + text + directory)
    for blocks, _ in planes:
        for b in blocks:
            out.write(b)


class WaveletFile:
    """Reads a shard file; rank, access, count and select read single blocks."""

    def __init__(self, f):
        self.f = f
        magic = f.read(len(MAGIC))
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (n,) = struct.unpack("<Q", f.read(8))
        self.head = json.loads(zlib.decompress(f.read(n)))
        self.levels, self.n = self.head["levels"], self.head["tokens"]
        self.unpress = zstandard.ZstdDecompressor().decompress
        d = np.frombuffer(self.unpress(f.read(self.head["directory"])), "<i8").reshape(2, -1)
        self.doc_ids, self.starts = d[0], d[1]
        at = len(MAGIC) + 8 + n + self.head["directory"]
        self.at = []
        for sizes in self.head["sizes"]:
            self.at.append(at + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) if sizes else np.array([at]))
            at += sum(sizes)

    def _block(self, plane: int, k: int) -> np.ndarray:
        self.f.seek(int(self.at[plane][k]))
        raw = self.unpress(self.f.read(self.head["sizes"][plane][k]))
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")

    def rank1(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        k, rest = divmod(i, BLOCK_BITS)
        return self.head["ones"][plane][k] + (int(self._block(plane, k)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        value = 0
        for plane in range(self.levels):
            k, rest = divmod(i, BLOCK_BITS)
            bit = int(self._block(plane, k)[rest])
            ones = self.rank1(plane, i)
            value = value << 1 | bit
            i = self.head["zeros"][plane] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for plane in range(self.levels):
            a, b = self.rank1(plane, lo), self.rank1(plane, hi)
            lo, hi = (self.head["zeros"][plane] + a, self.head["zeros"][plane] + b) if token >> (self.levels - 1 - plane) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` in positions lo..hi-1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane."""
        ones = np.array(self.head["ones"][plane])
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        found = np.flatnonzero(self._block(plane, block) == bit)
        return block * BLOCK_BITS + int(found[k - before[block]])

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for plane in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - plane) & 1
            i = self._select(plane, bit, i - self.head["zeros"][plane] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All tokens in order: the planes are undone from the last to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for plane in range(self.levels - 1, -1, -1):
            sizes = self.head["sizes"][plane]
            self.f.seek(int(self.at[plane][0]))
            raw = self.f.read(sum(sizes))
            ends = np.cumsum(sizes).tolist()
            packed = b"".join(self.unpress(raw[e - s : e]) for s, e in zip(sizes, ends))
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little", count=self.n).view(bool)
            back = np.empty(self.n, kind)
            back[~bit] = now[: self.head["zeros"][plane]]
            back[bit] = now[self.head["zeros"][plane] :] | kind(1 << (self.levels - 1 - plane))
            now = back
        return now


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append ``end_id``, write files of about ``shard_bytes`` of text.

    Returns the manifest (part, shard, path, n_docs, n_tokens), already
    written.  Rows are dealt by ranges of (id, hash of the text) and sorted
    there; a task cuts its sorted rows into shards by their bytes as they
    come, so that it holds one shard, however many rows share an id and
    however long they are; only a longer single text makes a larger shard.
    Null texts are empty; rows with a null id come first and are stored under
    the smallest int64; rows with one id are ordered by their text's hash.  An
    empty table gives an empty manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, min(TASKS, -(-size // TASK_BYTES)))
    dealt = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h", "t")
    folder = fresh_path(docs.sparkSession, "wavelet")

    def write(batches):
        enc, part, shard = encoder(vocabulary), TaskContext.get().partitionId(), 0
        held, n = [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            ids, starts = enc.encode_column(table.column("t").chunk(0), end_id)
            keys = table.column("id").fill_null(NULL_ID).to_numpy()
            path = f"{folder}/part-{part:06d}-{shard:05d}.wvm"
            with whole_file(path) as out:
                build(out, ids, keys, starts[:-1], end_id)
            cols = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["part", "shard", "path", "n_docs", "n_tokens"])

        for b in batches:
            b = b.select(["id", "t"])
            ends = np.cumsum(pc.binary_length(b.column("t")).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                # rows up to the one that fills the shard
                done = int(ends[at - 1]) if at else 0
                to = min(b.num_rows, int(np.searchsorted(ends, done + shard_bytes - n, side="left")) + 1)
                held.append(b.slice(at, to - at))
                n, at = n + int(ends[to - 1]) - done, to
                if n >= shard_bytes:
                    yield flush()
                    shard, held, n = shard + 1, [], 0
        if held:
            yield flush()

    return materialise(dealt.mapInArrow(write, "part int, shard int, path string, n_docs long, n_tokens long"), "manifest")


def read_documents(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the shard files: id, start, n_tokens, ids_crc32."""
    # running totals over the parts (a row a task), then over the files of a part
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select("path", (F.col("base") + F.col("own")).alias("before"))

    def read(batches):
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with opened(path) as f:
                    w = WaveletFile(f)
                    raw = w.decode().astype("<u4").tobytes()
                ends = np.append(w.starts[1:], w.n)
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(w.starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if i == NULL_ID else i for i in w.doc_ids.tolist()], pa.int64()), pa.array(w.starts + before), pa.array(ends - w.starts), pa.array(crc, pa.int64())],
                    ["id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, min(manifest.count(), 100_000))
    out = files.repartition(n, "path").mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)
