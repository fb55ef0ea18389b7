"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the exact neighbour graph is cut into balanced parts
that keep neighbours together, and a small classifier (one hidden layer) is
trained to tell a vector's part (Dong et al., 2020).  Every row of the table
is then put into its most probable part.  A query goes to its several most
probable parts, where all rows are ranked by the exact distance in double
precision.  How many parts it visits is set on the sample: the least number
with which held-out sample queries find ``TARGET`` of their neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Bound of the sample that parts and classifier are fitted on.
SAMPLE = 8192
NEIGHBOURS = 10
#: Parts grow with the square root of the rows, up to this many.
PARTS = 64
HIDDEN = 128
EPOCHS = 30
TARGET = 0.97
#: Rows and queries that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 20_000


def parts_for(rows: int, most: int = PARTS) -> int:
    """Parts of a table: an eighth of the root of its rows, 2 at least (one
    for a table too small to hold two of 16)."""
    return max(1, min(most, max(2, round(rows**0.5 / 8)), rows // 32))


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Ids of the k nearest other rows of each row."""
    sq = (x * x).sum(axis=1)
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), block):
        d = sq[None, :] - 2 * x[at : at + block] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + block] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 25, slack: float = 1.15, seed: int = 1) -> np.ndarray:
    """Part of each row: at most ``slack`` times an equal share, few cut edges.

    Starts from balanced halving along principal directions, then moves rows
    to the part that most of their neighbours (either way) are in, in random
    order, while that part has room.
    """
    part = np.zeros(len(x), dtype=np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        g = max(groups, key=len)
        groups = [q for q in groups if q is not g]
        c = x[g] - x[g].mean(axis=0)
        v = np.random.default_rng(seed).normal(size=x.shape[1])
        for _ in range(15):
            v = c.T @ (c @ v)
            v /= np.linalg.norm(v) or 1
        o = g[np.argsort(c @ v, kind="stable")]
        groups += [o[: len(o) // 2], o[len(o) // 2 :]]
    for i, g in enumerate(groups):
        part[g] = i
    src = np.repeat(np.arange(len(x)), graph.shape[1])
    a, b = np.concatenate([src, graph.ravel()]), np.concatenate([graph.ravel(), src])
    order = np.argsort(a, kind="stable")
    b, ends = b[order], np.searchsorted(a[order], np.arange(len(x) + 1))
    room, size, rng = int(slack * len(x) / parts) + 1, np.bincount(part, minlength=parts), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(part[b[ends[i] : ends[i + 1]]], minlength=parts)
            votes = np.where(size < room, votes, -1)
            votes[part[i]] = max(votes[part[i]], 0) if size[part[i]] >= room else votes[part[i]]
            own = int((part[b[ends[i] : ends[i + 1]]] == part[i]).sum())
            best = int(votes.argmax())
            if votes[best] > own:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer: probabilities of the parts of a vector."""

    def __init__(self, dim: int, parts: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
        self.mean, self.scale = np.zeros(dim), 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0)
        return h @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, soft: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 2e-3, seed: int = 5) -> None:
        """Adam on cross entropy against the shares of neighbours in each part."""
        self.mean = x.mean(axis=0)
        self.scale = float(x.std()) or 1.0
        rng = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                z = (x[at] - self.mean) / self.scale
                h = np.maximum(z @ self.w[0] + self.w[1], 0)
                s = h @ self.w[2] + self.w[3]
                p = np.exp(s - s.max(axis=1, keepdims=True))
                g = (p / p.sum(axis=1, keepdims=True) - soft[at]) / len(at)
                gh = g @ self.w[2].T * (h > 0)
                t += 1
                for i, d in enumerate([z.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def train(sample: np.ndarray, parts: int, target: float = TARGET) -> tuple[Router, int, int]:
    """(router, parts, probes) from sample vectors."""
    x = sample.astype(np.float64)
    if parts < 2:
        return Router(x.shape[1], 1), 1, 1
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, graph, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), NEIGHBOURS), part[graph].ravel()), 1 / NEIGHBOURS)
    soft = 0.5 * soft + 0.5 * np.eye(parts)[part]
    fit = np.arange(len(x)) % 5 != 0
    router = Router(x.shape[1], parts)
    router.fit(x[fit], soft[fit])
    scores = router.scores(x)
    home, held = scores.argmax(axis=1), np.flatnonzero(~fit)
    ranks = np.argsort(np.argsort(-scores[held], axis=1), axis=1)
    visited = ranks[np.arange(len(held))[:, None], home[graph[held]]]
    recall = [(visited < m).mean() for m in range(1, parts + 1)]
    return router, parts, next((m for m, r in enumerate(recall, 1) if r >= target), parts)


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _best(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, qids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance): the k ids nearest to each query, but its own, by
    exact distance, ties by id.  The nearest of the rows that share an id counts."""
    order = np.argsort(ids, kind="stable")
    ids, x, q, out = ids[order], rows[order].astype(np.float64), queries.astype(np.float64), []
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    alone, sq = ids[first], (x * x).sum(axis=1)
    rounding = 1e-9 * (1 + float(sq.max(initial=0)))
    for at in range(0, len(q), 256):
        d = sq[None, :] - 2 * q[at : at + 256] @ x.T + (q[at : at + 256] ** 2).sum(axis=1)[:, None]
        least = d if len(first) == len(ids) else np.minimum.reduceat(d, first, axis=1)
        for j in range(len(d)):
            each = np.where(alone == qids[at + j], np.inf, least[j])
            n = min(k, int(np.isfinite(each).sum()))
            if not n:
                continue
            # all that rounding could have put beyond the k-th
            edge = np.partition(each, n - 1)[n - 1] + rounding
            near = np.flatnonzero((d[j] <= edge) & (ids != qids[at + j]))
            dist = np.sqrt(((x[near] - q[at + j]) ** 2).sum(axis=1))
            nearest = np.lexsort((dist, ids[near]))
            nearest = nearest[np.append(True, np.diff(ids[near][nearest]) != 0)]
            o = nearest[np.lexsort((ids[near][nearest], dist[nearest]))[:k]]
            out.append((np.full(len(o), qids[at + j]), ids[near][o], dist[o]))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(c) for c in zip(none, *out))


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found rows.

    ``queries`` tells which rows are queries; every row is indexed and is a
    candidate of every query but its own.  Rows with a null id, and vectors
    that are null, empty, zero or hold null or non-finite components, take no
    part; nor do vectors whose length isn't the table's most frequent one
    (ties: the longest).  Rows that repeat an id are one candidate each, and
    the nearest of them counts; a repeated query id has its vectors ranked
    together.  Both hold within each block of rows, so an id may have any
    number of rows.  An empty table gives an empty result; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("is_query")).filter("id is not null").filter(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == sizes["n"])
    few = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # at most ``sample`` vectors
    router, parts, probes = train(np.array([r["v"] for r in few]), parts or parts_for(sizes["rows"]))
    shared = spark.sparkContext.broadcast(router)

    def route(batches):
        for b in batches:
            order = np.argsort(-shared.value.scores(_matrix(b.column(1)).astype(np.float64)), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], [*b.schema.names, "parts"])

    routed = rows.mapInArrow(route, "id long, v array<double>, is_query boolean, parts array<int>")
    # rows are dealt by a number of their own, so that an id of many rows is in many blocks
    routed = materialise(routed.withColumn("row", F.monotonically_increasing_id()), "routed")
    # blocks bound the rows and the queries that meet in a task, however full a part is
    spread = lambda n, most: F.ceil(n / F.lit(most)).cast("int")
    full = routed.groupBy(F.col("parts")[0].alias("part")).agg(spread(F.count("*"), BLOCK_ROWS).alias("blocks"))
    asked = routed.filter("is_query").select(F.explode("parts").alias("part")).groupBy("part").agg(spread(F.count("*"), BLOCK_QUERIES).alias("sets"))
    grid = F.broadcast(full.join(asked, "part"))  # a row for each part
    base = (
        routed.select("id", "v", "row", F.col("parts")[0].alias("part")).join(grid, "part")
        .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        .withColumn("set", F.explode(F.expr("sequence(0, sets - 1)"))).select("part", "block", "set", "id", "v")
    )
    ask = (
        routed.filter("is_query").select("id", "v", "row", F.explode("parts").alias("part")).join(grid, "part")
        .withColumn("set", F.pmod(F.xxhash64("row"), F.col("sets")).cast("int"))
        .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select("part", "block", "set", "id", "v")
    ).toDF("q_part", "q_block", "q_set", "q_id", "q_v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            got = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            got = _best(_matrix(left.column("v")), left.column("id").to_numpy(), _matrix(right.column("q_v")), right.column("q_id").to_numpy(), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, got))))

    near = base.groupBy("part", "block", "set").cogroup(ask.groupBy("q_part", "q_block", "q_set")).applyInArrow(meet, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
