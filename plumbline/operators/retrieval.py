"""Vector retrieval: exact top-k and what is built on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Rows and queries that meet in one task, and distances that it holds at once.
BLOCK_ROWS, BLOCK_QUERIES, TILE = 10_000, 4096, 1 << 18
#: Smaller tables are dealt into so many blocks too, as far as these have LEAST_ROWS.
LEAST_BLOCKS, LEAST_ROWS = 16, 256


def rounded(c: Column, places: int) -> Column:
    """A double to so many places by its product with a power of ten, as SQL engines on C's ``round`` do it."""
    return F.round(c * 10.0**places) / 10.0**places


def _nearest(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, distance) of each query's k nearest rows, ties by id."""
    out = []
    sq, step = np.einsum("ij,ij->i", x, x), max(1, TILE // len(x))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        d = (-2 * part) @ x.T
        d += np.einsum("ij,ij->i", part, part)[:, None] + sq[None, :]
        np.maximum(d, 0, out=d)
        d.round(9, out=d)
        d.round(6, out=d)
        n = min(k, d.shape[1])
        edge = np.partition(d, n - 1, axis=1)[:, n - 1]
        who, where = np.nonzero(d <= edge[:, None])
        order = np.lexsort((ids[where], d[who, where], who))
        who, where = who[order], where[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        who, where = who[place < n], where[place < n]
        out.append((qids[at + who], ids[where], d[who, where]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _meet(k: int):
    """Ranks a block of rows (doc_id, v) for a set of queries (query_id, q)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            none = pa.array([], pa.int64())
            return pa.table({"query_id": none, "doc_id": none, "distance": pa.array([], pa.float64())})
        matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        found = _nearest(left.column("doc_id").to_numpy(), matrix(left.column("v")), right.column("query_id").to_numpy(), matrix(right.column("q")), k)
        return pa.table(dict(zip(("query_id", "doc_id", "distance"), found)))

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of all blocks' finds: rank, doc_id, distance and score of each query."""
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    ranked = found.withColumn("distance", F.round("distance", 6)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.withColumn("score", F.round(1 / (1 + F.col("distance")), 6))


def _sides(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v is not null")
    ask = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("q")).filter("q is not null")
    return rows, ask


_FOUND = "query_id long, doc_id long, distance double"


def blocks_for(rows: int) -> int:
    """Blocks of a table: of BLOCK_ROWS at most, and enough of them for all cores where rows allow."""
    return max(1, -(-rows // BLOCK_ROWS), min(LEAST_BLOCKS, rows // LEAST_ROWS))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, doc_id, distance (squared L2), score = 1 / (1 + distance).

    ``queries`` has query_id and vector.  Blocks of rows meet sets of queries,
    both of bounded size, in a task each, which keeps k rows a query; then k
    are kept over all blocks.  Distances round to 6 places and ties go to the
    smaller id.  Only the numbers of rows reach the driver.
    """
    rows, ask = _sides(vectors, queries, id_col, vector_col)
    blocks, sets = blocks_for(rows.count()), max(1, -(-ask.count() // BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).withColumn("set", every(sets))
    ask = ask.withColumn("q_set", F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int")).withColumn("q_block", every(blocks))
    return _best(base.groupBy("block", "set").cogroup(ask.groupBy("q_block", "q_set")).applyInArrow(_meet(k), _FOUND), k)


#: Vectors that cells are fitted on, and rows that a cell is meant to hold.
CELL_SAMPLE, CELL_ROWS = 20_000, 1000


def cells_for(rows: int) -> int:
    """Cells of a table: the root of its rows, but no more than ``CELL_ROWS`` ask for nor the sample can tell apart."""
    return max(4, min(round(rows**0.5), max(16, rows // CELL_ROWS), CELL_SAMPLE // 20))


def _lists(rows: DataFrame, cells: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """Every row with its cell, and the cells' centres, fitted on a bounded sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    with_features = rows.withColumn("features", array_to_vector("v"))
    share = min(1.0, CELL_SAMPLE / max(rows.count(), 1))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(with_features.sample(share, seed=seed))
    return model.transform(with_features).select("doc_id", "v", F.col("prediction").alias("cell")), np.array(model.clusterCenters())


def cell_top_k(vectors: DataFrame, queries: DataFrame, k: int, cells: int | None = None, share: float = 0.75, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1) -> DataFrame:
    """The result of ``top_k``, as far as it lies in each query's nearest cells.

    Inverted lists: k-means cells grow with the rows; every row is in one cell.
    A query goes to the nearest cells, ``share`` of them.  Rows of a cell are
    dealt into blocks, a cell's queries into sets, and they meet as matrices,
    so no pair of a row and a query is a row of a table.
    """
    rows, ask = _sides(vectors, queries, id_col, vector_col)
    rows = written(rows, "vectors")
    cells = min(cells or cells_for(rows.count()), max(1, rows.count()))
    if rows.isEmpty():
        return _best(rows.sparkSession.createDataFrame([], _FOUND), k)
    listed, centres = _lists(rows, cells, seed)
    listed, probes = written(listed, "cells"), max(1, round(share * len(centres)))

    def near(batches):
        for b in batches:
            q = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            d = (centres * centres).sum(1)[None, :] - 2 * q @ centres.T
            order = np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(order.tolist(), pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    asked = written(ask.mapInArrow(near, "query_id long, q array<double>, cells array<int>"), "asked").select("query_id", "q", F.explode("cells").alias("cell"))
    count = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    grid = count(listed, BLOCK_ROWS, "blocks").join(count(asked, BLOCK_QUERIES, "sets"), "cell")
    grid = F.broadcast(grid)  # a row a cell, of which there are CELL_SAMPLE / 20 at most
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    base = listed.join(grid, "cell").withColumn("block", part("doc_id", "blocks")).select("cell", "block", F.explode(F.expr("sequence(0, sets - 1)")).alias("set"), "doc_id", "v")
    ask = asked.join(grid, "cell").withColumn("q_set", part("query_id", "sets")).select(F.col("cell").alias("q_cell"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("q_block"), "q_set", "query_id", "q")
    return _best(base.groupBy("cell", "block", "set").cogroup(ask.groupBy("q_cell", "q_block", "q_set")).applyInArrow(_meet(k), _FOUND), k)


def reranked(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best candidates of each query by a new score, ties by id."""
    c = candidates.withColumn("new_score", F.round(score, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "doc_id")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mmr(candidates: DataFrame, vectors: DataFrame, k: int, weight: float = 0.7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Greedy choice of k from each query's candidates: relevance against the
    largest dot product with what is chosen; ties go to the earlier candidate."""
    c = candidates.join(vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v")), "doc_id").select("query_id", "doc_id", "rank", "score", "v")

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        v = np.array(t.column("v").to_pylist(), dtype=np.float64)
        rel = t.column("score").to_numpy()
        chosen = [0]
        while len(chosen) < min(k, len(v)):
            s = np.round(weight * rel - (1 - weight) * (v @ v[chosen].T).max(axis=1), 6)
            s[chosen] = -np.inf
            chosen.append(int(s.argmax()))
        out = t.take(chosen)
        return pa.table({"query_id": out.column("query_id"), "doc_id": out.column("doc_id"), "rank": pa.array(range(1, len(chosen) + 1), pa.int32())})

    return c.groupBy("query_id").applyInArrow(choose, "query_id long, doc_id long, rank int")
