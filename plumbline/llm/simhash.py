"""SimHash near-dedup with deletion-variant signatures.

A document's fingerprint is 64 bits, taken by majority over the XXH64 values
of its word 3-shingles.  Fingerprints that differ in at most three bits are
linked.  Cut into two segments of 32 bits, such a pair differs by at most one
bit in one of them (three differing bits can't be two in both), so each
segment is indexed under its 32 one-wildcard variants (a variant blanks one
bit); a pair that links shares a variant, which an equality join finds, and
the full distance is then verified.

Equal fingerprints are one node, so exact copies never meet in pairs.  A
variant shared by more than ``DENSE`` fingerprints isn't self-joined: its
members are split into blocks, each pair of blocks is one bounded task, and a
task returns a spanning forest of its links instead of every pair.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_names, materialise, with_row_key

SHINGLE = 3
DISTANCE = 3
#: Members of one variant that are joined in pairs; more go by blocks.
DENSE = 64
#: Fingerprints in a block.
BLOCK = 1024
#: Fingerprints of a block pair that are compared with all its others at a time.
_STRIP = 128
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles hashed at a time, which bounds memory for very long texts.
_STEP = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """The signed 64-bit fingerprint of one text; 0 for a null or wordless one."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    total = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    hash_, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, _STEP):
        part = words[at : at + _STEP + SHINGLE - 1]
        grams = zip(part, part[1:], part[2:]) if len(part) >= SHINGLE else [part]
        values = np.array([hash_(join(g), 42) for g in grams], dtype=np.uint64)
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, fp long) for every row, whole texts; null text counts as empty.
    With ``row_col``, a long column, its value follows as row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint_of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["id", "fp", "row"][: b.num_columns])

    one = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")]
    row = [F.col(row_col).alias("row")] if row_col else []
    return docs.select(*one, *row).mapInArrow(run, "id long, fp long" + (", row long" if row_col else ""))


def _variants(nodes: DataFrame) -> DataFrame:
    """64 rows a fingerprint: the variant's key (segment, blanked bit, rest)."""
    # few bytes make many rows, so they are dealt to as many tasks as a shuffle has
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = nodes.select("fp").repartition(parts, "fp").select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    return one.selectExpr(
        "fp",
        "shiftleft(cast(v as bigint), 32) | (shiftrightunsigned(fp, 32 * (v div 32)) & 4294967295L & ~shiftleft(1L, cast(v % 32 as int))) AS sig",
    )


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one block pair as (member, least member of its component)."""
    u = np.unique(pdf["fp"].to_numpy(dtype=np.int64))
    bits = u.view(np.uint64)
    strips = [slice(at, at + _STRIP) for at in range(0, len(u), _STRIP)]
    near = np.empty((len(u), len(u)), dtype=bool)
    for s in strips:
        near[s] = np.bitwise_count(bits[s, None] ^ bits[None, :]) <= DISTANCE
    label = np.arange(len(u))
    while True:
        new = np.concatenate([np.where(near[s], label[None, :], len(u)).min(axis=1) for s in strips])
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(u))
    return pd.DataFrame({"a": u[own], "b": u[label[own]]})


def links(nodes: DataFrame, dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``nodes`` (column fp).

    All links of variants with up to ``dense`` members; of larger ones a
    spanning forest for each pair of blocks, which keeps every component.
    """
    variants = _variants(nodes)
    shared = variants.groupBy("sig").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    shared = materialise(shared, "variants")
    close = F.expr(f"bit_count(a ^ b) <= {DISTANCE}")
    twos = shared.filter("n = 2").select("a", "b").filter(close)
    members = materialise(variants.join(shared.filter("n > 2").select("sig", "n"), "sig"), "members")
    few = members.filter(F.col("n") <= dense).select("sig", "fp")
    pairs = (
        few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "sig")
        .filter(F.col("a") < F.col("b")).filter(close).select("a", "b")
    )
    many = (
        members.filter(F.col("n") > dense)
        .withColumn("k", F.ceil(F.col("n") / F.lit(block)).cast("int"))
        .withColumn("own", F.expr("cast(pmod(xxhash64(fp), k) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
        .select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    )
    spans = many.groupBy("sig", "x", "y").applyInPandas(_forest, "a long, b long")
    return twos.union(pairs).union(spans).distinct()


def _rooted(nodes: DataFrame) -> DataFrame:
    """``nodes`` (column fp) with root, the least fingerprint of the component."""
    labels = connected_components(links(nodes))
    return nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links, the row's own
    included.  Null or wordless texts have fingerprint zero and link like any
    other.  Rows with a null id take part and get the component's smallest
    non-null id (null if it has none); repeated rows are returned as often as
    they come; an empty table gives an empty result.  Other columns are
    ignored, whatever their names.
    """
    fps = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    rooted = _rooted(nodes)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group stays.

    It is the row with the smallest id, with all its columns; a null id comes
    last, and of rows that share the id the first in the table stays.  Rows
    are told apart by a key of their own, so a repeated id may stay in one
    group and go in another.  An empty table stays empty.
    """
    columns = docs.columns
    key, own = free_names(docs, "key", "gone")
    docs = with_row_key(docs, key)
    fps = materialise(fingerprints(docs, id_col, text_col, key), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    nodes = materialise(fps.groupBy("fp").agg(least.alias("first")), "nodes")
    stays = _rooted(nodes).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    gone = fps.select("row").join(stays, "row", "left_anti").withColumnRenamed("row", own)
    return docs.join(gone, docs[key] == gone[own], "left_anti").select(*columns)
