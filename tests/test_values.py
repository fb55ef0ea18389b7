"""Values of the queries that have no SQL, by plain Python over the same tables."""

import json
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from plumbline import registry
from plumbline.functions import text as T
from plumbline.plans import text as PT


def hashed(t, dim=64):
    v = np.zeros(dim)
    for w in t.lower().split():
        h = zlib.crc32(w.encode())
        v[h % dim] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def test_hashing_encoder():
    texts = ["", "  ", "one", " One  two\tone ", "ÄÖ äö　x", "a b a b c", "b " * 1000]
    got = PT.hashing_encoder()(pa.array(texts))
    assert np.allclose(got, [hashed(t) for t in texts], atol=1e-6)
    assert PT.hashing_encoder(8)(pa.array([], pa.string())).shape == (0, 8)


def test_embedded_in_batches(spark, monkeypatch):
    monkeypatch.setattr(PT, "ENCODED", 10)
    rows = [(i, t, "clash") for i, t in enumerate(["one two", None, "", "three " * 30, "four"] * 5)]
    df = spark.createDataFrame(rows, "id int, t string, out string").coalesce(1)
    got = {r.id: r.embedding for r in PT.embedded(df, "t", PT.hashing_encoder()).collect()}
    for i, t, _ in rows:
        assert got[i] is None if t is None else np.allclose(got[i], hashed(t), atol=1e-6)


def test_embed_job(spark, sf):
    """Every chunk once, with the vector of its heading twice and its content."""
    chunks = {f"chunk_{r.doc_id}_{r.chunk_id}": r for r in PT.chunk_rows(spark, sf).collect()}
    got = registry.queries()["txt_embed_job"](spark, sf).collect()
    assert len({r.chunk_id for r in got}) == len(got) == len(chunks)
    for r in got:
        c = chunks[r.chunk_id]
        head, body = (c.header or "").strip(), (c.content or "").strip()
        t = f"{head}. {head}. {body}" if head and body else head or body
        assert np.allclose(r.embedding, hashed(t), atol=1e-5) and r.metadata == {"lang": c.lang, "source": c.source}


def test_baseline_build(spark, sf):
    (row,) = registry.queries()["agg_baseline_build"](spark, sf).collect()
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    cut = float(np.quantile([d["doc_id"] for d in docs], 0.7))
    train = [d for d in docs if d["doc_id"] <= cut]
    assert json.loads(row.sizes) == {"train": len(train), "validation": len(docs) - len(train)}
    assert row.schema == "doc_id:bigint,n_chars:bigint,text:string"
    stats = {s["column"]: s for s in json.loads(row.stats)}
    for name, values in (("n_chars", [d["n_chars"] for d in train]), ("text", [None if d["text"] is None else len(d["text"]) for d in train])):
        known = [v for v in values if v is not None]
        s = stats.pop(name)
        assert s["kind"] == ("numeric" if name == "n_chars" else "text")
        assert (s["low"], s["high"]) == (min(known), max(known)) and s["mean"] == pytest.approx(np.mean(known), abs=1e-6)
        assert s["null_pct"] == pytest.approx(100 * (1 - len(known) / len(values)), abs=1e-6)
        assert ("std" not in s or s["std"] is None) if name == "text" else s["std"] == pytest.approx(np.std(known), abs=1e-6)
    assert not stats
    checks = {"ids": all(d["doc_id"] is not None for d in train), "n_chars": 2 * sum((d["n_chars"] or 0) > 0 for d in train) > len(train), "text": any(d["text"] is not None for d in train)}
    assert json.loads(row.checks) == checks and not math.isnan(cut)


def test_retrieval_stats_at_ties(spark, tmp_path):
    """Scores that lie on a five at the fifth place print by their own value, as in the SQL."""
    scores = [k / 1e6 for k in range(300050, 999999, 7900)]
    rows = [(0, [0.0])] + [(50 * i + j, [1000.0 * i + (1 / s - 1) ** 0.5 * (j > 0)]) for i in range(1, len(scores) // 4) for j, s in enumerate([1.0, *scores[4 * i - 4 : 4 * i]])]
    pq.write_table(pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "label": ["a"] * len(rows)}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = {r[0]: r for r in con.execute("SELECT query_id, avg_score, doc_ids, chunk_ids, docs_metrics, n FROM (" + registry.oracle_sql()["agg_retrieval_stats"] + ")").fetchall()}
    got = {r.query_id: (r.query_id, r.avg_score, r.doc_ids, r.chunk_ids, r.docs_metrics, r.n) for r in registry.queries()["agg_retrieval_stats"](spark, str(tmp_path)).collect()}
    assert got == want


def test_strip_as_in_sql(spark):
    """Blanks go at both ends only: those before a rare line end stay, and a long run inside costs no more than its length."""
    texts = ["", " \t\r\n", " a b \n", "a \u0085", "a  ", " a ", "a" + " " * 200_000 + "b ", None]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select(T.strip(F.col("t")).alias("s")).collect()]
    con = duckdb.connect()
    assert got == [con.execute(f"SELECT {PT.strip('x')} FROM (SELECT ?::VARCHAR AS x)", [t]).fetchone()[0] for t in texts]
