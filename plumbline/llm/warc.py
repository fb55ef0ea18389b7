"""WARC archives by way of a chunked record table.

A payload is rows (record, chunk number, bytes); a writer streams them into a
gzip member per record and carries the SHA-1 digest from chunk to chunk, so
that neither it nor the reader holds a whole record.  Of records with equal
payloads of at least ``REVISIT`` bytes that with the largest id is written
with its payload, the others as revisits of it, whose payload isn't moved.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, fresh_path, materialise, with_row_key
from .files import opened, whole_file

#: Payloads of fewer bytes are never revisits.
REVISIT = 1000
CHUNK = 1 << 20
_READ = 1 << 16
_ID = re.compile(rb"^<urn:page:(-?\d+|null)>$")


def chunk_table(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", chunk: int = CHUNK) -> DataFrame:
    """The record table: rows (id, url, bytes, sha1, refers, chunk_no, chunk).

    ``refers`` is the id of the record that holds the same payload, null where
    the record is a response; then the payload follows in chunks of at most
    ``chunk`` bytes.  A revisit or an empty payload is one row with an empty
    chunk.  Digests alone are compared; payloads meet only the keys of the
    rows that are revisits, so a payload of many rows is no hot key, and where
    revisits are few no payload is shuffled.
    """
    body = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    key, = free_names(pages, "row")
    rows = with_row_key(pages, key).select(F.col(key).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("bytes", F.octet_length("body").cast("long")).withColumn("sha1", F.sha1("body"))
    digests = materialise(rows.filter(F.col("bytes") >= REVISIT).select("row", "id", "bytes", "sha1"), "digests")
    held = digests.groupBy("sha1", "bytes").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1")
    found = digests.join(held, ["sha1", "bytes"]).filter(~F.col("id").eqNullSafe(F.col("top"))).select("row", F.col("top").alias("refers"))
    joined = rows.join(materialise(found.filter("refers is not null"), "revisits"), "row", "left")
    joined = joined.withColumn("body", F.when(F.col("refers").isNull(), F.col("body")).otherwise(F.lit(b"")))
    # chunk numbers are exploded, and each chunk is cut as its row is made, so a record is never held twice
    numbers = F.expr(f"sequence(0, greatest(0, cast((octet_length(body) - 1) div {chunk} as int)))")
    one = joined.select("id", "url", "bytes", "sha1", "refers", "body", F.explode(numbers).alias("chunk_no"))
    return one.select("id", "url", "bytes", "sha1", "refers", "chunk_no", F.expr(f"substring(body, chunk_no * {chunk} + 1, {chunk})").alias("chunk"))


def _clean(s: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", s or "")


def _head(r: dict) -> bytes:
    """The header block of a record, given its first chunk's row."""
    revisit, key = r["refers"] is not None, "null" if r["id"] is None else r["id"]
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{key}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(r['url'])}", f"WARC-Payload-Digest: sha1:{r['sha1']}", f"X-Payload-Length: {r['bytes']}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{r['refers']}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else r['bytes']}", "", ""]
    return "\r\n".join(head).encode()


def write_archives(chunks: DataFrame, name: str = "warc") -> DataFrame:
    """Write the record table to gzip WARC files, one per task that has rows.

    Returns the manifest (path, records), already written.  A record's chunks
    lie next to each other in a task, in order, as ``chunk_table`` makes them.
    """
    spark = chunks.sparkSession
    folder = fresh_path(spark, name)

    def write(batches):
        rows = (r for b in batches for r in b.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        path, records = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        member = sha = want = None

        def finish():
            if want is not None and sha.hexdigest() != want:
                raise ValueError("a payload changed while it was written")
            if member is not None:
                out.write(member.compress(b"\r\n\r\n") + member.flush())

        with whole_file(path) as out:
            for r in chain([first], rows):
                if r["chunk_no"] == 0:
                    finish()
                    member, sha, want = zlib.compressobj(4, zlib.DEFLATED, 31), hashlib.sha1(), r["sha1"] if r["refers"] is None else None
                    out.write(member.compress(_head(r)))
                    records += 1
                sha.update(r["chunk"])
                out.write(member.compress(r["chunk"]))
            finish()
        yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})

    return materialise(chunks.mapInArrow(write, "path string, records long"), f"{name}-manifest")


class _Members:
    """The unpacked bytes of a multi-member gzip file, a piece at a time."""

    def __init__(self, f):
        self.f, self.data, self.un, self.rest = f, b"", zlib.decompressobj(31), b""

    def _more(self) -> bool:
        raw = self.rest or self.f.read(_READ)
        self.rest = b""
        if not raw:
            return False
        self.data += self.un.decompress(raw, _READ)
        self.rest = self.un.unconsumed_tail
        if self.un.eof:
            self.rest, self.un = self.un.unused_data, zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.data:
            if not self._more():
                return None
        line, _, self.data = self.data.partition(b"\r\n")
        return line

    def body(self, n: int):
        while n:
            if not self.data and not self._more():
                raise EOFError("a record is cut short")
            piece, self.data = self.data[:n], self.data[n:]
            n -= len(piece)
            if piece:
                yield piece


def read_records(f):
    """(headers, digest and length of the block as read) of each record of a stream."""
    src = _Members(f)
    while (line := src.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        heads = {}
        while h := src.line():
            k, _, v = h.partition(b": ")
            heads[k.lower()] = v
        sha, n = hashlib.sha1(), 0
        for piece in src.body(int(heads[b"content-length"])):
            sha.update(piece)
            n += len(piece)
        yield heads, sha.hexdigest(), n


def read_archives(manifest: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per record of the archives: id_col, payload_bytes, payload_digest,
    record_type, refers_to.  A response's digest and length are those of the
    block as read; a revisit's are in its headers."""

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with opened(path) as f:
                    for h, digest, n in read_records(f):
                        key = _ID.match(h[b"warc-record-id"])[1]
                        kind = h[b"warc-type"].decode()
                        refers = _ID.match(h[b"warc-refers-to"])[1] if b"warc-refers-to" in h else None
                        told = h[b"warc-payload-digest"].decode().removeprefix("sha1:")
                        if kind == "response" and told != digest:
                            raise ValueError(f"record {key!r} of {path} doesn't hold what its digest tells")
                        rows.append((None if key == b"null" else int(key), int(h[b"x-payload-length"]) if refers else n, told if refers else digest, kind, None if refers is None else int(refers)))
                cols = list(zip(*rows)) if rows else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, min(manifest.count(), 100_000))
    out = manifest.select("path").repartition(n, "path").mapInArrow(read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return out.withColumnRenamed("id", id_col)


def archive(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write every row as a WARC record and read the archives back.

    A null payload is empty.  A row with a null id revisits a record with its
    payload and an id, if there is one, else it is a response.  Rows that
    repeat an id are records of their own; those that share the largest id of
    a payload are all responses.  An empty table gives an empty result.
    """
    return read_archives(write_archives(chunk_table(pages, id_col, payload_col, url_col)), id_col)
