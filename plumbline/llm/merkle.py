"""Merkle manifest of a dataset, kept as a postorder append log.

Each group of rows (a source) is a tree of fan-out 16 over its rows' digests,
and the groups' roots are the leaves of one more tree.  A node's digest is the
sha256 of its children's digests as hex text.

Builders take aligned runs of ``RUN`` leaves and append their nodes in the
order in which they are complete, children before parents; the roots of runs
are the leaves of the next round's builders.  In that order a node's place
follows in closed form from its level, its number and the leaves of the tree
(``position``), so the siblings of a leaf are addressed, not searched for.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import fresh_path
from .common import materialise

FAN, LEVELS = 16, 3
#: Leaves of a builder, and rows of a range of the order.
RUN, RANGE_ROWS = FAN**LEVELS, 50_000
#: Name of the tree over the groups; names of groups are empty or begin with a colon.
TOP = "top"
_NODES = "tree string, n long, run long, first long, nodes binary"


def height(n: int) -> int:
    """Levels above n leaves; a lone leaf is its own root."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def position(level: int, i: int, n: int) -> int:
    """Place in the log, from 0, of the i-th node of a level of a tree of n leaves."""
    begin, end = i * FAN**level, min((i + 1) * FAN**level, n)
    below = sum(-(-end // FAN**j) for j in range(level + 1))
    return below + sum(begin // FAN**j for j in range(level + 1, height(n) + 1)) - 1


def siblings(level: int, i: int, n: int) -> tuple[int, range]:
    """The number, in its level, of the first node of i's run, and the run."""
    first = i // FAN * FAN
    return first, range(first, min(first + FAN, -(-n // FAN**level)))


def parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def grown(leaves: list[bytes], levels: int) -> list[tuple[int, int, bytes]]:
    """(level, number, digest) of all nodes over a run of leaves, in the order of completion."""
    out, open_ = [], [[] for _ in range(levels + 1)]
    count = [0] * (levels + 1)

    def add(level: int, digest: bytes) -> None:
        out.append((level, count[level], digest))
        count[level] += 1
        open_[level].append(digest)

    for k, leaf in enumerate(leaves):
        add(0, leaf)
        for level in range(levels):
            if len(open_[level]) == FAN or k == len(leaves) - 1:
                digest = parent(open_[level])
                open_[level] = []
                add(level + 1, digest)
            else:
                break
    return out


def tree_name(group: Column) -> Column:
    """A group's tree; in the order of these names null is first, then come UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit(":"), group.cast("string")), F.lit(""))


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 of the values: "-" for null, else the number of UTF-8 bytes, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (tree, leaf and other columns) with i, the number of each leaf
    in its tree by ``order`` (null first, then the leaf), and n, the leaves of the tree.

    Rows are dealt into ranges of (tree, order, leaf, row), so that no tree,
    and no repeated row, is one task; each range's totals give the rows before it.
    """
    rows = materialise(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    keys = ["tree", *order, "leaf", "_row"]
    ranges = max(leaves.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    dealt = materialise(rows.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("tree", "_range").agg(F.count("*").alias("_n"))  # a row a tree and range that has it
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("tree", "_range", before.alias("_before"), F.sum("_n").over(own).alias("n"))
    nth = F.row_number().over(Window.partitionBy("tree", "_range").orderBy(*keys[1:]))
    out = dealt.join(totals, ["tree", "_range"]).withColumn("i", F.col("_before") + nth - 1)
    return materialise(out.drop("_row", "_range", "_before").withColumn("run", F.floor(F.col("i") / RUN)), "numbered")


@dataclass
class Log:
    """``nodes``: the log; a row has the nodes from place ``first`` on, 32 bytes
    each, of the run ``run`` of leaves or, where that is null, of a later round.
    ``roots``: tree, n, root."""

    nodes: DataFrame
    roots: DataFrame


def _next_round(base: int):
    """A builder over roots of the level ``base``; each of its nodes is a row."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        n, begin, tree = group.column("n")[0].as_py(), group.column("i")[0].as_py(), group.column("tree")[0].as_py()
        nodes = [(base + k, begin // FAN**k + c, d) for k, c, d in grown(group.column("leaf").to_pylist(), min(LEVELS, height(n) - base)) if k]
        m, longs = len(nodes), lambda x: pa.array(x, pa.int64())
        return pa.table(
            {"tree": [tree] * m, "n": longs([n] * m), "run": longs([None] * m), "first": longs([position(k, c, n) for k, c, _ in nodes]), "nodes": [d for _, _, d in nodes],
             "level": pa.array([k for k, _, _ in nodes], pa.int32()), "i": longs([c for _, c, _ in nodes])}
        )

    return run


def build(leaves: DataFrame) -> Log:
    """The log of the trees whose ``numbered`` leaves these are."""
    spark = leaves.sparkSession

    def first_round(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        n, run, tree = group.column("n")[0].as_py(), group.column("run")[0].as_py(), group.column("tree")[0].as_py()
        nodes = grown(group.column("leaf").to_pylist(), min(LEVELS, height(n)))
        return pa.table({"tree": [tree], "n": pa.array([n], pa.int64()), "run": pa.array([run], pa.int64()), "first": pa.array([position(0, run * RUN, n)], pa.int64()), "nodes": [b"".join(d for _, _, d in nodes)]})

    where = fresh_path(spark, "merkle-log")
    picked = leaves.select("tree", "n", "run", "i", "leaf")
    picked.groupBy("tree", "run").applyInArrow(first_round, _NODES).write.parquet(where)
    log = spark.read.schema(_NODES).parquet(where)
    last = F.substring("nodes", F.octet_length("nodes") - 31, F.lit(32))
    tops = log.select("tree", "n", F.col("run").alias("i"), last.alias("leaf"))
    most, level = log.agg(F.max("n")).first()[0] or 0, LEVELS
    while FAN**level < most:
        part = tops.filter(F.col("n") > FAN**level).withColumn("set", F.floor(F.col("i") / RUN)).groupBy("tree", "set")
        added = materialise(part.applyInArrow(_next_round(level), _NODES + ", level int, i long"), "merkle-round")
        added.drop("level", "i").write.mode("append").parquet(where)
        level += LEVELS
        tops = added.filter(F.col("level") == level).select("tree", "n", "i", F.col("nodes").alias("leaf"))
    whole = spark.read.schema(_NODES).parquet(where)
    # the node that is last in the log of a tree is its root
    end = F.col("first") + F.octet_length("nodes") / 32
    roots = whole.groupBy("tree").agg(F.max("n").alias("n"), F.max_by(last, end).alias("root"))
    return Log(whole, materialise(roots, "merkle-roots"))


def _paths(log: Log) -> DataFrame:
    """(tree, run, path): the siblings on the way from a run's root to its tree's root."""

    def ask(batches):
        for b in batches:
            for tree, n, run in zip(*(b.column(c).to_pylist() for c in range(3))):
                rows, i = [], run
                for level in range(LEVELS, height(n)):
                    _, span = siblings(level, i, n)
                    rows += [(level, position(level, c, n)) for c in span if c != i]
                    i //= FAN
                if rows:
                    m = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * m, pa.string()), pa.array([run] * m, pa.int64()), pa.array([p for _, p in rows], pa.int64()), pa.array(range(m), pa.int32())], ["tree", "run", "at", "place"])

    last = F.substring("nodes", F.octet_length("nodes") - 31, F.lit(32))
    held = log.nodes.filter(F.col("n") > RUN).select("tree", (F.col("first") + F.octet_length("nodes") / 32 - 1).cast("long").alias("at"), last.alias("node"))
    asked = log.nodes.filter(F.col("run").isNotNull() & (F.col("n") > RUN)).select("tree", "n", "run").mapInArrow(ask, "tree string, run long, at long, place int")
    # 15 siblings a level at most
    found = asked.join(held, ["tree", "at"]).groupBy("tree", "run").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("found"))
    return found.select("tree", "run", F.col("found.node").alias("path"))


def fold(digest: bytes, i: int, n: int, path: list[bytes]) -> bytes:
    """The root that follows from a leaf, its number and its siblings, level by level."""
    at = 0
    for level in range(height(n)):
        first, span = siblings(level, i, n)
        k = len(span) - 1
        own = i - first
        digest = parent([*path[at : at + own], digest, *path[at + own : at + k]])
        at, i = at + k, i // FAN
    return digest


def proofs(leaves: DataFrame, log: Log, carried: list[str] | None = None, of_tree: DataFrame | None = None) -> DataFrame:
    """(carried, tree, i, n, leaf, columns of ``of_tree``, path) of each leaf.

    ``path`` has its siblings' digests on the way to its tree's root, level by
    level, left to right.  ``of_tree`` has a row of further columns for each
    tree; it meets the runs, not the leaves, so a large tree is no hot key.
    """
    carried, more = carried or [], [c for c in of_tree.columns if c != "tree"] if of_tree is not None else []
    segments = log.nodes.filter("run is not null").join(_paths(log), ["tree", "run"], "left")
    if of_tree is not None:
        segments = segments.join(of_tree, "tree")
    segments = segments.select(F.col("tree").alias("s_tree"), F.col("run").alias("s_run"), "first", "nodes", F.col("path").alias("s_path"), *more)
    cols = [*carried, "tree", "i", "n", "leaf"]
    kinds = [(c, leaves.schema[c].dataType) for c in cols] + [(c, of_tree.schema[c].dataType) for c in more]
    schema = ", ".join(f"`{c}` {kind.simpleString()}" for c, kind in kinds) + ", path array<binary>"

    def prove(own: pa.Table, segment: pa.Table) -> pa.Table:
        out, m = [], own.num_rows
        if m:
            n = own.column("n")[0].as_py()
            nodes, first, rest = (segment.column(c)[0].as_py() for c in ("nodes", "first", "s_path"))
            for i in own.column("i").to_pylist():
                path, at = [], i
                for level in range(min(LEVELS, height(n))):
                    for c in siblings(level, at, n)[1]:
                        if c != at:
                            p = 32 * (position(level, c, n) - first)
                            path.append(nodes[p : p + 32])
                    at //= FAN
                out.append(path + (rest or []))
        got = own.select(cols)
        for c in more:
            got = got.append_column(c, segment.column(c).take(pa.array([0] * m, pa.int64())))
        return got.append_column("path", pa.array(out, pa.list_(pa.binary())))

    return leaves.select(*cols, "run").groupBy("tree", "run").cogroup(segments.groupBy("s_tree", "s_run")).applyInArrow(prove, schema)


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, changed: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root, path (siblings), folded, verified of each row.

    A leaf is the digest of ``columns``; trees are the values of ``group``
    (null is one of them) and their leaves ascend by ``key`` (null first;
    rows that share a key by their leaf, and rows alike in both are
    interchangeable).  ``changed`` is the digest of the row as it is found
    now, null if it is unchanged; ``folded`` is what it and the siblings give.
    An empty table gives an empty result; other columns are ignored; a text is
    digested where it is read and never travels.
    """
    now = changed if changed is not None else F.lit(None).cast("binary")
    rows = docs.select(F.col(key).alias("key"), tree_name(F.col(group)).alias("tree"), leaf_digest([F.col(c) for c in columns]).alias("leaf"), now.alias("changed"))
    leaves = numbered(rows, ["key"])
    log = build(leaves)
    tops = numbered(log.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf")), ["name"])
    top = build(tops)
    one = top.roots.select(F.hex("root")).first()  # a row, or none of an empty table
    above = proofs(tops, top, ["name"]).select(F.col("name").alias("tree"), F.col("i").alias("top_i"), F.col("n").alias("top_n"), F.col("leaf").alias("subroot"), F.col("path").alias("top_path"))
    ways = proofs(leaves, log, ["key", "changed"], above)

    def check(batches):
        for b in batches:
            t, folded, path = b.to_pydict(), [], []
            for k in range(b.num_rows):
                sub = fold(t["changed"][k] or t["leaf"][k], t["i"][k], t["n"][k], t["path"][k])
                folded.append(fold(sub, t["top_i"][k], t["top_n"][k], t["top_path"][k]))
                path.append(t["path"][k] + t["top_path"][k])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "leaf", "subroot")), pa.array(path, pa.list_(pa.binary())), pa.array(folded, pa.binary())], ["key", "leaf", "subroot", "path", "folded"])

    kind = docs.schema[key].dataType.simpleString()
    out = ways.mapInArrow(check, f"key {kind}, leaf binary, subroot binary, path array<binary>, folded binary")
    out = out.withColumn("root", F.unhex(F.lit(one[0] if one else None)))
    return out.withColumn("verified", F.col("folded") == F.col("root")).withColumnRenamed("key", key)
