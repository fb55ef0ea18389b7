"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ann, bpe, digest, lang_id, merkle, packing, runs, secrets, sharding, simhash, warc, wavelet, word_table
from .common import constants, free_names, range_bounds, range_bucket, ship, with_row_key

#: Rows in a range of ids whose neighbours meet in one task, and ranges of rows
#: with and without an id at most (then a range holds more rows; its sort and
#: its window spill).
CHAIN_ROWS, CHAINS = 2048, 65_536
#: Columns of a leaf of the manifest, in their order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op2_wavelet(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    manifest = wavelet.write_shards(_table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_documents(manifest)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def with_next(rows: DataFrame, id_col: str, row_col: str, columns: list[str], prefix: str) -> DataFrame:
    """Each row with ``columns`` of the row that follows in descending id order.

    After the last row comes the first.  The order is kept inside ranges of
    the id; the first row of each range is also sent, as a copy, to the range
    that comes before it, so no window spans the table.  Null ids come last;
    rows that share an id, or have none, follow each other by a hash of
    ``row_col``, which is different in every row, and are several ranges where
    they are many.  At most 3 ``CHAINS`` first rows' keys reach the driver.
    """
    bucket, copy, sent, mix = free_names(rows, "bucket", "copy", "sent", "mix")
    n, none = rows.agg(F.count("*"), F.count_if(F.col(id_col).isNull())).first()
    cuts = range_bounds(rows, id_col, min(CHAINS, -(-n // CHAIN_ROWS)))
    often = {c: cuts.count(c) for c in set(cuts) if cuts.count(c) > 1} if len(set(cuts)) < len(cuts) else {}
    # an id that fills several ranges is a range of its own, dealt over as many parts
    bounds = sorted(set(cuts) | {c - 1 for c in often})
    parts = [max(1, min(CHAINS, -(-none // CHAIN_ROWS)))] + [often.get(c, 1) + (c in often) for c in bounds] + [1]
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + p)
    keyed = rows.withColumn(mix, F.xxhash64(row_col))
    at = range_bucket(F.col(id_col), bounds) + 1
    part = F.pmod(F.shiftrightunsigned(mix, 1), F.get(constants(parts), at))
    cut = keyed.withColumn(bucket, (F.get(constants(starts[:-1]), at) + part).cast("int"))
    head = F.min(F.struct(F.col(id_col).isNull().alias("a"), F.bitwise_not(id_col).alias("b"), F.col(mix).alias("c"), F.col(row_col).alias("row")))
    heads = {r[0]: r[1] for r in cut.groupBy(bucket).agg(head["row"].alias("row")).collect()}
    # the head of a range also goes to the range before; that of the first to the last
    chain = sorted(heads, reverse=True)
    target = {b: chain[i - 1] for i, b in enumerate(chain)}
    size = starts[-1]
    is_head = F.get(constants([heads.get(b, -1) for b in range(size)]), F.col(bucket)) == F.col(row_col)
    to = F.get(constants([target.get(b, -1) for b in range(size)], "int"), F.col(bucket))
    both = cut.withColumn(sent, F.explode(F.array_compact(F.array(F.struct(F.col(bucket).alias("b"), F.lit(0).alias("copy")), F.when(is_head, F.struct(to.alias("b"), F.lit(1).alias("copy")))))))
    # plain columns and one select, so that all windows share one exchange
    both = both.withColumn(bucket, F.col(sent)["b"]).withColumn(copy, F.col(sent)["copy"]).drop(sent)
    order = Window.partitionBy(bucket).orderBy(copy, F.desc_nulls_last(id_col), mix)
    out = both.select("*", *[F.lead(c).over(order).alias(prefix + c) for c in columns])
    return out.filter(F.col(copy) == 0).drop(bucket, copy, mix)


def op7_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row_key(_table(spark, sf_dir, "documents"), "row").select("doc_id", "row", F.coalesce("text", F.lit("")).alias("text"))
    rows = digest.with_digest(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = with_next(rows, "doc_id", "row", ["text", "fingerprint"], "next_")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - cut), F.left("next_text", cut))
    rows = digest.with_canonical(rows.withColumn("edited", edited), "edited", "canon").withColumn("own", digest.digest(F.col("canon")))
    # where a collision lengthened the text's digest, an equal canonical form has it too
    own = F.col("own")
    same = F.when(own == F.substring("fingerprint", 1, 32), F.col("canon") == digest.canonical(F.col("text")))
    mark = F.when(F.coalesce(same, F.lit(False)), F.col("fingerprint")).when(own == F.col("fingerprint"), F.concat(own, F.lit("-"), F.sha2("canon", 256))).otherwise(own)
    rows = rows.withColumn("edited_fingerprint", mark)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        digest.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), digest.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "k", "start", F.char_length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " "))

    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col("text"))
    found = runs.periodic_runs(docs.select("doc_id", text.alias("text")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return out.withColumn("exponent_milli", F.expr("1000 * length div period"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = [F.col(c) for c in LEAF if c != "text"] + [F.translate("text", string.ascii_uppercase, string.ascii_lowercase)]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle.manifest(docs, LEAF, "source", "doc_id", F.when(tampered, merkle.leaf_digest(found)))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    proof = F.sha2(F.lower(F.array_join(F.transform("path", F.hex), "")).cast("binary"), 256)
    return out.select("doc_id", text("leaf"), text("subroot"), text("root"), proof.alias("proof_sha256"), text("folded").alias("folded_root"), "verified")


def op13_word_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return word_table.digests(_table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_simhash": op1_simhash, "op2_wavelet": op2_wavelet, "op3_warc": op3_warc, "op4_packing": op4_packing, "op5_byte_bpe": op5_byte_bpe,
    "op6_ann": op6_ann, "op7_digest": op7_digest, "op8_language": op8_language, "op9_sharding": op9_sharding, "op10_secrets": op10_secrets,
    "op11_runs": op11_runs, "op12_merkle": op12_merkle, "op13_word_bpe": op13_word_bpe,
}



def _crc32_sql(text: str) -> str:
    """crc32 of ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT for _ in range(8)]), lambda x, _z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda h: ascii(h)::BIGINT)), lambda c, b: {bits}), 4294967295)"


# pairs of equal words q apart that follow each other are stretches of period q
_RUNS_SQL = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_crc32_sql('doc_id::VARCHAR')} AS h FROM documents),
    k AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, h // 10 AS g FROM d),
    p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM k),
    words AS (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
    pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
    listed AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
    FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _merkle_sql() -> str:
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in [*LEAF[:-1], text]) + ")"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    rise = lambda keys, name: f"""SELECT {keys}lvl + 1, i // 16, sha256(string_agg(dig, '' ORDER BY i)) FROM
        (SELECT *, count(*) OVER (PARTITION BY {keys}lvl) AS m FROM {name}) WHERE m > 1 GROUP BY {keys}lvl, i // 16"""  # noqa: E731
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(':' || source, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(low)} END AS now FROM documents),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
        up(tree, lvl, i, dig) AS (SELECT tree, 0, i, leaf FROM leaves UNION ALL {rise('tree, ', 'up')}),
        subs AS (SELECT tree, dig AS subroot, lvl AS h, row_number() OVER (ORDER BY tree) - 1 AS r FROM up u WHERE lvl = (SELECT max(lvl) FROM up v WHERE v.tree = u.tree)),
        high(lvl, i, dig) AS (SELECT 0, r, subroot FROM subs UNION ALL {rise('', 'high')}),
        nodes AS (SELECT u.tree, lvl AS step, lvl, i, dig FROM up u JOIN subs s ON u.tree = s.tree AND lvl < h UNION ALL SELECT s.tree, h + lvl, lvl, i, dig FROM high, subs s WHERE lvl < (SELECT max(lvl) FROM high)),
        fold(tree, i, step, dig, proof) AS (
            SELECT tree, i, 0, coalesce(now, leaf), '' FROM leaves
            UNION ALL
            SELECT f.tree, f.i, f.step + 1, sha256(string_agg(CASE WHEN n.i = f.own THEN f.dig ELSE n.dig END, '' ORDER BY n.i)), any_value(proof) || coalesce(string_agg(CASE WHEN n.i <> f.own THEN n.dig END, '' ORDER BY n.i), '')
            FROM (SELECT f.*, CASE WHEN step < h THEN i // (1::BIGINT << (4 * step)) ELSE r // (1::BIGINT << (4 * (step - h))) END AS own FROM fold f JOIN subs USING (tree)) f
            JOIN nodes n ON n.tree = f.tree AND n.step = f.step AND n.i // 16 = f.own // 16
            GROUP BY f.tree, f.i, f.step),
        done AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY tree, i ORDER BY step DESC) = 1),
        root AS (SELECT dig AS root FROM high ORDER BY lvl DESC LIMIT 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, dig AS folded_root, dig = root AS verified FROM leaves JOIN done USING (tree, i) JOIN subs USING (tree), root
    """


ORACLE_SQL = {
    "op11_runs": _RUNS_SQL,
    "op12_merkle": _merkle_sql(),
    # records: equal payloads of 1000 bytes or more revisit that with the largest id
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS top FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
        FROM g
    """,
    # exact nearest neighbours; at sf0.01 queries visit all three parts, so the found ones are these
    "op6_ann": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
        d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM d)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
