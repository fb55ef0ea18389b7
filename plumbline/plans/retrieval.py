"""Queries of retrieval and of what is made of its results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.profile import r6
from .base import query, table

#: Every fiftieth vector is a query, against all rows.
EACH = 50
_TOP = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), d AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM v a, v b WHERE a.vec_id % {EACH} = 0),
    t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INTEGER) AS rank, doc_id, distance, round(1 / (1 + distance), 6) AS score FROM d)"""


def top(spark, sf, k):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return R.top_k(v, v.filter(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k)


COLS = ["query_id", "rank", "doc_id", "distance", "score"]


@query("ret_similarity", _TOP + " SELECT * FROM t WHERE rank <= 5")
def ret_similarity(spark, sf):
    return top(spark, sf, 5).select(*COLS)


@query("join_vector_topk", _TOP + " SELECT query_id, doc_id, distance FROM t WHERE rank <= 3")
def join_vector_topk(spark, sf):
    return top(spark, sf, 3).select("query_id", "doc_id", "distance")


_MMR_STEP = "SELECT query_id, doc_id, {n} AS rank FROM (SELECT c.query_id, c.doc_id, row_number() OVER (PARTITION BY c.query_id ORDER BY round(0.7 * c.score - 0.3 * max(list_sum(list_transform(list_zip(x.e, y.e), lambda z: z[1] * z[2]))), 6) DESC, any_value(c.rank)) AS k FROM c JOIN v x ON x.vec_id = c.doc_id JOIN ({chosen}) s ON s.query_id = c.query_id JOIN v y ON y.vec_id = s.doc_id WHERE (c.query_id, c.doc_id) NOT IN (SELECT (query_id, doc_id) FROM ({chosen})) GROUP BY c.query_id, c.doc_id, c.score) WHERE k = 1"


@query("ret_mmr", _TOP + ", c AS (SELECT * FROM t WHERE rank <= 9), s1 AS (SELECT query_id, doc_id, 1 AS rank FROM c WHERE rank = 1), s2 AS (" + _MMR_STEP.format(n=2, chosen="SELECT * FROM s1") + "), s3 AS (" + _MMR_STEP.format(n=3, chosen="SELECT * FROM s1 UNION ALL SELECT * FROM s2") + ") SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3")
def ret_mmr(spark, sf):
    return R.mmr(top(spark, sf, 9), table(spark, sf, "embeddings"), 3)


@query("ret_weighted", _TOP + ", c AS (SELECT t.*, 7e-1 * score + 1e-1 * coalesce(CASE WHEN d.doc_id % 3 > 0 THEN n_chars % 11 / 10 END, 1) + 1e-1 * coalesce(quality, 1) + 1e-1 * (least(1 + 1e-1 * coalesce(toxic, 0), 2) - 1) AS ns FROM t LEFT JOIN labels l ON l.doc_id = t.doc_id LEFT JOIN documents d ON d.doc_id = t.doc_id WHERE rank <= 10) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(ns, 6) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(ns, 8) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(ns, 6) DESC, doc_id) <= 5")
def ret_weighted(spark, sf):
    """Similarity, recency, quality and citations; what is missing counts 1, 1 and 0."""
    recency = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") % 11 / 10).alias("recency"))
    c = top(spark, sf, 10).join(table(spark, sf, "labels"), "doc_id", "left").join(recency, "doc_id", "left")
    s = 0.7 * F.col("score") + 0.1 * F.coalesce("recency", F.lit(1.0)) + 0.1 * F.coalesce("quality", F.lit(1)) + 0.1 * (F.least(1 + 0.1 * F.coalesce("toxic", F.lit(0)), F.lit(2.0)) - 1)
    return R.reranked(c, s, 5).select("query_id", "rank", "doc_id", F.round(s, 8).alias("score"))


@query("ret_rerank", _TOP + ", c AS (SELECT t.*, round(score * CASE WHEN w < 50 THEN 0.8 WHEN w > 500 THEN 0.9 ELSE 1 END, 6) AS ns FROM t JOIN (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS w FROM documents) d USING (doc_id) WHERE rank <= 15) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ns DESC, doc_id) AS INTEGER) AS rank, doc_id, ns AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ns DESC, doc_id) <= 5")
def ret_rerank(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\S+")).alias("w"))
    c = top(spark, sf, 15).join(words, "doc_id")
    return R.reranked(c, F.col("score") * F.when(F.col("w") < 50, 0.8).when(F.col("w") > 500, 0.9).otherwise(1.0), 5).select("query_id", "rank", "doc_id", F.col("new_score").alias("score"))


@query("ret_ann")
def ret_ann(spark, sf, k=5):
    """Inverted lists: k-means cells, three quarters of them for a query, exact ranks there."""
    v = table(spark, sf, "embeddings")
    asked = v.filter(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.cell_top_k(v, asked, k).select(*COLS)


@query("ret_index_stats", "SELECT 'flat' AS type, max(len(embedding)) AS dimension, count(*) AS vectors, (SELECT count(*) FROM documents) AS chunks, count(*) <> (SELECT count(*) FROM documents) AS mismatch FROM embeddings")
def ret_index_stats(spark, sf):
    v = table(spark, sf, "embeddings").agg(F.max(F.size("embedding")).cast("long").alias("dimension"), F.count("*").alias("vectors"))
    c = table(spark, sf, "documents").agg(F.count("*").alias("chunks"))  # one row each
    return v.join(F.broadcast(c)).select(F.lit("flat").alias("type"), "dimension", "vectors", "chunks", (F.col("vectors") != F.col("chunks")).alias("mismatch"))


_DOC = "c AS (SELECT t.*, source, text FROM t JOIN documents USING (doc_id) WHERE rank <= 4)"


def ranked_docs(spark, sf):
    return top(spark, sf, 4).join(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")


@query("txt_context", _TOP + f", {_DOC}, x AS (SELECT query_id, string_agg('Document ' || rank || ' - ' || source || ':' || chr(10) || substr(text, 1, 2000), chr(10) || chr(10) ORDER BY rank) AS x FROM c GROUP BY 1), y AS (SELECT query_id, CASE WHEN length(x) > 6000 THEN substr(x, 1, 6000) || '...' ELSE x END AS x FROM x) SELECT query_id, md5(x) AS context_md5, length(x) AS context_chars FROM y")
def txt_context(spark, sf):
    part = F.concat(F.lit("Document "), F.col("rank").cast("string"), F.lit(" - "), "source", F.lit(":\n"), F.left("text", F.lit(2000)))
    x = ranked_docs(spark, sf).select("query_id", "rank", part.alias("part")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda s: s["part"]), "\n\n").alias("x"))
    x = x.withColumn("x", F.when(F.char_length("x") > 6000, F.concat(F.left("x", F.lit(6000)), F.lit("..."))).otherwise(F.col("x")))
    return x.select("query_id", F.md5("x").alias("context_md5"), F.char_length("x").cast("long").alias("context_chars"))


@query("txt_references", _TOP + f", {_DOC} SELECT query_id, string_agg(rank || '. ' || CASE WHEN doc_id % 2 = 0 THEN '[' || source || '](http://d/' || doc_id || ')' ELSE source END, chr(10) ORDER BY rank) AS refs FROM c GROUP BY 1")
def txt_references(spark, sf):
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), "source", F.lit("](http://d/"), F.col("doc_id").cast("string"), F.lit(")"))).otherwise(F.col("source")))
    return ranked_docs(spark, sf).select("query_id", "rank", line.alias("l")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "l"))), lambda s: s["l"]), "\n").alias("refs"))


@query("agg_retrieval_stats", _TOP + " SELECT query_id, round(avg(score), 4) AS avg_score, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids, string_agg('chunk_' || doc_id, ',' ORDER BY rank) AS chunk_ids, string_agg(rank || ':' || doc_id || ':' || printf('%.4f', score), ',' ORDER BY rank) AS docs_metrics, count(*) AS n FROM t WHERE rank <= 5 GROUP BY 1")
def agg_retrieval_stats(spark, sf):
    """Mean score, ids and each document's rank and score of every query, without contents."""
    g = top(spark, sf, 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("h"), F.count("*").alias("n"))
    listed = lambda f: F.array_join(F.transform("h", f), ",")
    text = lambda c: c.cast("string")
    # the sum in the order of ranks, and as SQL rounds: not the decimal that a double is shown as, but its own value
    mean = F.aggregate("h", F.lit(0.0), lambda a, s: a + s["score"]) / F.col("n")
    return g.select(
        "query_id", R.rounded(mean, 4).alias("avg_score"), listed(lambda s: text(s["doc_id"])).alias("doc_ids"), listed(lambda s: F.concat(F.lit("chunk_"), text(s["doc_id"]))).alias("chunk_ids"),
        listed(lambda s: F.concat_ws(":", text(s["rank"]), text(s["doc_id"]), F.format_number(s["score"], 4))).alias("docs_metrics"), "n",
    )
