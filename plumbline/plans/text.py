"""Queries of the text operators."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from ..functions import sql as SQL
from ..functions import text as T
from .base import q, query, table

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def docs(spark, sf):
    return table(spark, sf, "documents")


def strip(s):
    return STRIP.format(s)


def out(c, name="result"):
    return [F.md5(c).alias(f"{name}_md5"), F.char_length(c).cast("long").alias(f"{name}_chars")]


_MARKS = [m for h in T.REFERENCE_HEADINGS for m in ("\n" + h, "\r\n" + h, h + "\n")]
_FIRST = "least(" + ", ".join(f"nullif(strpos(lower({{t}}), {q(m)}), 0)" for m in _MARKS) + ")"


def refs_sql(t):
    f = _FIRST.replace("{t}", t)
    return strip(f"CASE WHEN {f} IS NULL THEN {t} ELSE substr({t}, 1, {f} - 1) END")


def clean_sql(t):
    for p, r in ((T.BRACKETS, ""), (T.AUTHOR_YEAR, ""), ("(?im)" + T.CAPTION, ""), (r"[\n\t]+", " "), (r"\s{2,}", " "), (T.NOT_ALLOWED, "")):
        t = f"regexp_replace({t}, {q(p)}, '{r}', 'g')"
    return strip(t)


_REF_TEXT = "concat(text, CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'References' || chr(10) || '[1] Smith, 2020' ELSE '' END)"


@query("txt_strip_refs", f"WITH d AS (SELECT doc_id, {_REF_TEXT} AS t FROM documents), r AS (SELECT doc_id, {refs_sql('t')} AS r FROM d) SELECT doc_id, md5(r) AS result_md5, length(r) AS result_chars FROM r")
def txt_strip_refs(spark, sf):
    t = F.concat("text", F.when(F.col("doc_id") % 4 == 0, "\nReferences\n[1] Smith, 2020").otherwise(""))
    return docs(spark, sf).select("doc_id", *out(T.strip_references(t)))


_NOISY = "concat('Table 1', chr(10), text, ' [1, 2] (Smith et al, 2020)', chr(10), 'Fig. 3')"


@query("txt_clean", f"WITH d AS (SELECT doc_id, {_NOISY} AS t FROM documents), r AS (SELECT doc_id, {clean_sql('t')} AS r FROM d) SELECT doc_id, md5(r) AS result_md5, length(r) AS result_chars FROM r")
def txt_clean(spark, sf):
    t = F.concat(F.lit("Table 1\n"), "text", F.lit(" [1, 2] (Smith et al, 2020)\nFig. 3"))
    return docs(spark, sf).select("doc_id", *out(T.clean(t)))


def html_sql(t):
    for tag in T.HTML_BLOCKS:
        t = f"regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->|<[^>]+>', chr(10), 'g')"
    for a, b in T.HTML_ENTITIES:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return f"regexp_replace({t}, '\\s*\\n\\s*', chr(10), 'g')"


@query("txt_html", f"WITH h AS (SELECT page_id, {html_sql('html')} AS t FROM pages), s AS (SELECT page_id, {refs_sql('t')} AS t FROM h), r AS (SELECT page_id, {clean_sql('t')} AS r FROM s) SELECT page_id, md5(r) AS result_md5, length(r) AS result_chars FROM r")
def txt_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", *out(T.clean(T.strip_references(T.html_text(F.col("html"))))))


def _part(p):
    return f"nullif({strip(f'regexp_extract(html, {q(p)}, 1)')}, '')"


@query("txt_title", f"SELECT page_id, coalesce({_part('(?is)<title[^>]*>(.*?)</title>')}, {_part('(?is)<h1[^>]*>(.*?)</h1>')}, 'Untitled') AS title FROM pages")
def txt_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.title(F.col("html")).alias("title"))


_DATED = "html || CASE page_id % 4 WHEN 0 THEN '<meta name=\"date\" content=\"2024-01-15\">' WHEN 1 THEN 'Updated on 2023-02-03' WHEN 2 THEN '<meta itemprop=\"dateModified\" content=\"2022-01-01\">' ELSE '' END"


@query("txt_pubdate", f"SELECT page_id, coalesce({', '.join(f'nullif(regexp_extract(h, {q(p)}, 1), chr(0)[1:0])' for p in T.date_patterns())}) AS published FROM (SELECT page_id, {_DATED} AS h FROM pages)".replace("chr(0)[1:0]", "''"))
def txt_pubdate(spark, sf):
    h = F.concat("html", F.when(F.col("page_id") % 4 == 0, '<meta name="date" content="2024-01-15">').when(F.col("page_id") % 4 == 1, "Updated on 2023-02-03").when(F.col("page_id") % 4 == 2, '<meta itemprop="dateModified" content="2022-01-01">').otherwise(""))
    return table(spark, sf, "pages").select("page_id", T.publish_date(h).alias("published"))


_HOST = "regexp_extract(lower({u}), '^[a-z]+://([^/?#]*)', 1)"
_URL = "CASE page_id % 5 WHEN 0 THEN replace(url, '.com/', '.nih.gov/') WHEN 1 THEN replace(url, '.org/', '.de/') WHEN 2 THEN replace(url, '.net/', '.springer.com/article/') ELSE url END"
_META = "html || CASE page_id % 7 WHEN 0 THEN '<meta name=\"geo.country\" content=\"FR\">' WHEN 1 THEN '<meta property=\"og:locale\" content=\"en_GB\">' ELSE '' END"


def url_column():
    p = F.col("page_id") % 5
    return F.when(p == 0, F.replace("url", F.lit(".com/"), F.lit(".nih.gov/"))).when(p == 1, F.replace("url", F.lit(".org/"), F.lit(".de/"))).when(p == 2, F.replace("url", F.lit(".net/"), F.lit(".springer.com/article/"))).otherwise(F.col("url"))


@query("txt_country", f"WITH p AS (SELECT page_id, {_HOST.format(u=_URL)} AS h, {_META} AS html FROM pages) SELECT page_id, coalesce(" + ", ".join(f"CASE WHEN contains(h, '{d}') THEN '{c}' END" for d, c in T.COUNTRY_DOMAINS)
       + f", nullif(regexp_extract(html, {q(T.COUNTRY_META)}, 1), ''), nullif(regexp_extract(html, {q(T.COUNTRY_LOCALE)}, 1), ''), " + ", ".join(f"CASE WHEN regexp_extract(h, '([^.]*)$', 1) = '{d}' THEN '{c}' END" for d, c in T.COUNTRY_TLDS) + ", 'Unknown') AS country FROM p")
def txt_country(spark, sf):
    p = F.col("page_id") % 7
    html = F.concat("html", F.when(p == 0, '<meta name="geo.country" content="FR">').when(p == 1, '<meta property="og:locale" content="en_GB">').otherwise(""))
    return table(spark, sf, "pages").select("page_id", T.country(url_column(), html).alias("country"))


def _any(c, ps):
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in ps) + ")"


@query("txt_source_type", f"WITH p AS (SELECT page_id, lower({_URL}) AS u, {_HOST.format(u=_URL)} AS h FROM pages) SELECT page_id, CASE WHEN {_any('u', T.SOURCE_TYPES[0][1])} THEN CASE WHEN contains(u, 'pmc') THEN 'PubMed Central' WHEN contains(u, 'pubmed') THEN 'PubMed' ELSE 'NIH' END "
       + " ".join(f"WHEN {_any('u', ps)} THEN '{n}'" for n, ps in T.SOURCE_TYPES[1:]) + f" WHEN regexp_matches(u, '/articles?/') AND {_any('h', T.OPEN_JOURNALS)} THEN 'Open Access Journal' ELSE 'Medical Website' END AS source_type FROM p")
def txt_source_type(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.source_type(url_column()).alias("source_type"))


KEYWORDS = ["the", "and", "und", "der", "para", "una", "avec", "les", "licensed under"]


def topics_sql(words):
    """A list of the words that stand in a text, by Unicode's letters and digits."""
    hit = lambda k: f"CASE WHEN regexp_matches(lower(text), '(^|[^{T.WORD}]){k}([^{T.WORD}]|$)') THEN '{k}' END"
    return f"list_filter([{', '.join(map(hit, words))}], lambda x: x IS NOT NULL)"


@query("txt_topics", f"SELECT doc_id, array_to_string(list_sort({topics_sql(KEYWORDS)}), ',') AS topics FROM documents")
def txt_topics(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.topics(F.col("text"), KEYWORDS), ",").alias("topics"))


WORDS, TOKENS = "len(regexp_extract_all({}, '\\S+'))", "len(regexp_extract_all({}, '[W]+|[^W\\s]'))".replace("W", T.WORD.replace("{", "{{").replace("}", "}}"))


@query("txt_counts", f"SELECT doc_id, {WORDS.format('text')} AS words, {TOKENS.format('text')} AS tokens FROM documents")
def txt_counts(spark, sf):
    return docs(spark, sf).select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"), T.token_count(F.col("text")).cast("long").alias("tokens"))


_NAMES = "[c_name, 'Editorial Team', upper(c_mktsegment[1]) || lower(c_mktsegment[2:]), 'Dr. Jane ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Doe', '2024-01-02', 'For Lung Cancer', 'john ' || c_mktsegment]"


@query("txt_authors", f"SELECT c_custkey, array_to_string(list_filter({_NAMES}, lambda x: length({strip('x')}) <= 100 AND NOT regexp_matches({strip('x')}, {q('(?i)' + '|'.join(T.NOT_NAMES))}) AND (regexp_matches({strip('x')}, {q(T.NAME_ONE)}) OR regexp_matches({strip('x')}, {q(T.NAME_FEW)}) OR (regexp_matches({strip('x')}, {q(T.NAME_FOUR)}) AND regexp_matches({strip('x')}, {q(T.NAME_TITLE)})))), '|') AS authors FROM customer")
def txt_authors(spark, sf):
    seg = F.concat(F.upper(F.left("c_mktsegment", F.lit(1))), F.lower(F.substring("c_mktsegment", 2, 100)))
    names = F.array("c_name", F.lit("Editorial Team"), seg, F.concat(F.lit("Dr. Jane "), seg, F.lit(" Doe")), F.lit("2024-01-02"), F.lit("For Lung Cancer"), F.concat(F.lit("john "), "c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(T.authors(names), "|").alias("authors"))


_FRONT = "concat('---', chr(10), 'lang: ', lang, chr(10), 'source: \"', source, '\"', chr(10), 'url: http://a/', doc_id, chr(10), '---', chr(10), text)"


@query("txt_frontmatter", f"WITH d AS (SELECT doc_id, lang, source, {strip('text')} AS t FROM documents) SELECT doc_id, lang, source, 'http://a/' || doc_id AS url, 3 AS n_keys, md5(t) AS content_md5, length(t) AS content_chars FROM d")
def txt_frontmatter(spark, sf):
    t = F.concat(F.lit("---\nlang: "), "lang", F.lit('\nsource: "'), "source", F.lit('"\nurl: http://a/'), F.col("doc_id").cast("string"), F.lit("\n---\n"), "text")
    meta, content = T.front_matter(t)
    return docs(spark, sf).select("doc_id", meta.alias("m"), content.alias("c")).select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"), F.col("m")["url"].alias("url"), F.size("m").alias("n_keys"), *out(F.col("c"), "content"))


# documents have few headings of their own: some lines are put before them
_LEAD = ["**Bold lead**", "RESULTS AND METHODS", "Overview of things", "2.1. Numbered Part", "What is this?", "The Summary Part"]
_HEADED = "concat(CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {q(x)} || chr(10)" for i, x in enumerate(_LEAD)) + " ELSE '' END, text)"


def headed():
    c = F.lit("")
    for i, x in enumerate(_LEAD):
        c = F.when(F.col("doc_id") % 7 == i, F.lit(x + "\n")).otherwise(c)
    return F.concat(c, "text")


_W = WORDS.format("s")
LEVEL_SQL = f"""CASE WHEN s = '' OR regexp_matches(s, '^#{{1,6}}\\s') THEN 0 WHEN regexp_matches(s, {q(T.BOLD)}) AND {WORDS.format("regexp_replace(s, '^(\\*\\*|__)|(\\*\\*|__)$', '', 'g')")} <= 10 THEN 2
    WHEN upper(s) = s AND lower(s) <> s AND ({_W} BETWEEN 2 AND 12 OR ({_W} = 1 AND contains(s, '-'))) THEN 2
    WHEN {_W} < 20 AND nw > {_W} AND NOT regexp_matches(s, '[.,;!?]$') AND regexp_matches(lower(s), {q(T.ANY_WORD)}) THEN 1
    WHEN {_W} < 20 AND nw > {_W} AND NOT regexp_matches(s, '[.,;!?]$') AND regexp_matches(s, '^\\d+\\.?\\d*\\.?\\s+[A-Z]') THEN 2
    WHEN regexp_matches(s, '^\\d+(\\.\\d+)*\\.\\s+[A-Z]') AND length(s) < 80 THEN 2 WHEN regexp_matches(s, '\\?$') AND {_W} <= 12 AND regexp_matches(s, '^\\p{{Lu}}') THEN 3
    WHEN {_W} BETWEEN 2 AND 10 AND regexp_matches(s, {q(T.ONE_WORD)}) AND len(regexp_extract_all(s, '(^|\\s)\\p{{Lu}}')) >= {_W} * 0.6 THEN 1 ELSE 0 END"""
LINES_SQL = f"""WITH t AS (SELECT doc_id, {_HEADED} AS text FROM documents), l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM t),
    l1 AS (SELECT *, {strip('line')} AS s, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY pos), '') AS nxt FROM l0), l2 AS (SELECT *, {WORDS.format('nxt')} AS nw FROM l1), l AS (SELECT doc_id, pos, line, s, {LEVEL_SQL} AS level FROM l2),
    has AS (SELECT doc_id, bool_or(regexp_matches(line, '^\\s*#{{1,6}}\\s+\\S')) AS h FROM l GROUP BY doc_id),
    m AS (SELECT doc_id, pos, CASE WHEN NOT h AND level > 0 THEN repeat('#', level) || ' ' || regexp_replace(s, '^\\*\\*(.+?)\\*\\*$|^__(.+?)__$', '\\1\\2') ELSE line END AS line FROM l JOIN has USING (doc_id))"""


@query("txt_heading", LINES_SQL + " SELECT doc_id, CAST(pos AS INTEGER) AS pos, level FROM l WHERE level > 0")
def txt_heading(spark, sf):
    rows = T.with_lines(docs(spark, sf).select("doc_id", headed().alias("t")), "t")
    return rows.select("doc_id", F.explode_outer("lines").alias("r")).select("doc_id", "r.pos", "r.level").filter("level > 0")


@query("txt_mark_headers", LINES_SQL + ", r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS r FROM m GROUP BY doc_id) SELECT doc_id, md5(r) AS result_md5, length(r) AS result_chars FROM r")
def txt_mark_headers(spark, sf):
    return T.with_marked(docs(spark, sf).select("doc_id", headed().alias("t")), "t", "m").select("doc_id", *out(F.col("m")))


CHUNK_SQL = LINES_SQL + f""", k0 AS (SELECT *, length(regexp_extract({strip('line')}, {q(T.HEADER)}, 1)) AS n FROM m), k1 AS (SELECT *, min(CASE WHEN n > 0 THEN n END) OVER (PARTITION BY doc_id) AS mn FROM k0),
    k2 AS (SELECT *, n > 0 AND n <= CASE WHEN coalesce(mn, 6) = 6 THEN 1 ELSE mn END AS b FROM k1), k3 AS (SELECT *, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM k2),
    k4 AS (SELECT doc_id, c, coalesce(max(CASE WHEN b THEN regexp_extract({strip('line')}, {q(T.HEADER)}, 2) END), 'Introduction') AS header, coalesce(max(CASE WHEN b THEN n END), 0)::INTEGER AS level, {strip("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT b), '')")} AS content FROM k3 GROUP BY doc_id, c),
    chunk AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS INTEGER) AS chunk_id, header, level, content, {TOKENS.format('content')} AS tokens FROM k4 WHERE content <> '')"""


def chunk_rows(spark, sf):
    # an outer explode, as for an inner one the arrays are worked out once more in a filter
    marked = T.with_marked(docs(spark, sf).select("doc_id", "lang", "source", headed().alias("t")), "t", "m").drop("t")
    rows = T.with_chunks(marked, "m").select("doc_id", "lang", "source", F.posexplode_outer("chunks").alias("chunk_id", "c")).filter("c is not null")
    return rows.select("doc_id", "lang", "source", "chunk_id", "c.header", "c.level", "c.content", T.token_count(F.col("c.content")).cast("long").alias("tokens"))


@query("txt_chunk", CHUNK_SQL + " SELECT doc_id, chunk_id, header, level, md5(content) AS content_md5, tokens FROM chunk")
def txt_chunk(spark, sf):
    return chunk_rows(spark, sf).select("doc_id", "chunk_id", "header", "level", F.md5("content").alias("content_md5"), "tokens")


@query("txt_chunk_sql", CHUNK_SQL + " SELECT doc_id, chunk_id, header, level, md5(content) AS content_md5, tokens, length(content) - length(replace(content, chr(10), '')) + 1 AS lines FROM chunk")
def txt_chunk_sql(spark, sf):
    """The chunks by functions that SQL calls by name."""
    SQL.register(spark)
    marked = T.with_marked(docs(spark, sf).select("doc_id", headed().alias("t")), "t", "text").select("doc_id", "text")
    return spark.sql(
        "SELECT doc_id, chunk_id, header, level, md5(content) AS content_md5, token_count(content) AS tokens, CAST(regexp_count(content, '\n') + 1 AS BIGINT) AS lines FROM chunk(TABLE(SELECT * FROM {marked}))",
        marked=marked,
    )


@query("txt_chunk_docs", CHUNK_SQL + " SELECT doc_id, chunk_id, coalesce(nullif(d.source, ''), header) AS title, header AS section_header, level AS section_level, md5(content) AS content_md5, tokens AS chunk_token_count, lang AS country FROM chunk JOIN documents d USING (doc_id)")
def txt_chunk_docs(spark, sf):
    return chunk_rows(spark, sf).select("doc_id", "chunk_id", F.coalesce(F.nullif("source", F.lit("")), "header").alias("title"), F.col("header").alias("section_header"), F.col("level").alias("section_level"), F.md5("content").alias("content_md5"), F.col("tokens").alias("chunk_token_count"), F.col("lang").alias("country"))


@query("txt_chunk_stats", CHUNK_SQL + " SELECT count(*) AS n, min(tokens) AS min, max(tokens) AS max, round(avg(tokens), 6) AS mean FROM chunk")
def txt_chunk_stats(spark, sf):
    return chunk_rows(spark, sf).agg(F.count("*").alias("n"), F.min("tokens").alias("min"), F.max("tokens").alias("max"), F.round(F.avg("tokens"), 6).alias("mean"))


@query("txt_embed_text", f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS t, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {strip('text')} END AS c FROM documents), r AS (SELECT doc_id, CASE WHEN t <> '' AND c <> '' THEN t || '. ' || t || '. ' || c WHEN t <> '' THEN t ELSE c END AS r FROM d) SELECT doc_id, md5(r) AS result_md5, length(r) AS result_chars FROM r")
def txt_embed_text(spark, sf):
    return docs(spark, sf).select("doc_id", *out(T.embed_text(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")))))


#: Characters of text that an encoder gets at a time.
ENCODED = 4 << 20


def hashing_encoder(dim: int = 64):
    """The default encoder: signed word hashes in ``dim`` buckets, unit length.

    An encoder is a function from an Arrow array of texts to a matrix with a
    row for each.  This one splits whole columns and hashes each distinct word
    of a column once.
    """

    def encode(texts: pa.Array) -> np.ndarray:
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
        text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary())
        h = np.fromiter(map(zlib.crc32, words.to_numpy(zero_copy_only=False)), np.int64, len(words))
        # an empty word is no word; the ends of a text with blanks there have one
        sign = np.where(h >> 16 & 1, 1.0, -1.0) * (pc.binary_length(words).to_numpy() > 0)
        at = coded.indices.to_numpy()
        out = np.bincount(text * dim + (h % dim)[at], sign[at], len(lists) * dim).reshape(-1, dim).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def embedded(rows: DataFrame, text: str, encoder, out: str = "embedding") -> DataFrame:
    """``rows`` with the vector that ``encoder`` gives each text, in batches of
    about ``ENCODED`` characters; null texts have none."""
    schema, where = StructType([*rows.schema]).add(out, ArrayType(FloatType())), rows.columns.index(text)

    def run(batches):
        for b in batches:
            sizes, at, size = pc.fill_null(pc.binary_length(b.column(where)), 0).to_pylist(), 0, 0
            for end, n in enumerate(sizes, 1):
                size += n
                if size >= ENCODED or end == len(sizes):
                    some = b.slice(at, end - at)
                    texts = some.column(where)
                    matrix = np.asarray(encoder(pc.fill_null(texts, "")), np.float32)
                    null, dim = pc.is_null(texts), matrix.shape[1]
                    offsets = pa.array(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32))
                    vectors = pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), pa.float32()), mask=null if null.true_count else None)
                    yield pa.RecordBatch.from_arrays([*some.columns, vectors], [*b.schema.names, out])
                    at, size = end, 0

    return rows.mapInArrow(run, schema)


@query("txt_embed_job")
def txt_embed_job(spark, sf, encoder=None):
    """Embeds every chunk with a pluggable encoder; blank texts have no row."""
    rows = chunk_rows(spark, sf).withColumn("t", T.embed_text(F.col("header"), F.col("content"))).filter("t <> ''")
    rows = rows.select(F.concat_ws("_", F.lit("chunk"), "doc_id", "chunk_id").alias("chunk_id"), "t", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    return embedded(rows, "t", encoder or hashing_encoder()).select("chunk_id", "embedding", "metadata")


@query("vec_normalize", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 3)) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v) SELECT vec_id, round(norm, 4) AS norm, round(list_sum(list_transform(e, lambda x: x / CASE WHEN norm = 0 THEN 1 ELSE norm END)), 5) AS total, round(e[1] / CASE WHEN norm = 0 THEN 1 ELSE norm END, 5) AS first FROM n")
def vec_normalize(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    v = v.withColumn("norm", norm).withColumn("u", F.transform("e", lambda x: x / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))))
    return v.select("vec_id", F.round("norm", 4).alias("norm"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.col("u")[0], 5).alias("first"))


_CLASS = "CASE p_partkey % 4 WHEN 0 THEN 'Adenocarcinoma_left.lobe_T2' WHEN 1 THEN 'Bengin cases' WHEN 2 THEN 'large.cell.carcinoma' ELSE p_type || ' x.y' END"


@query("txt_class_norm", f"WITH p AS (SELECT p_partkey, lower(trim({_CLASS})) AS n FROM part), c AS (SELECT p_partkey, CASE WHEN contains(n, '_') AND contains(n, 'carcinoma') THEN split_part(n, '_', 1) ELSE n END AS n FROM p) SELECT p_partkey, CASE n " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in T.CLASS_NAMES) + " ELSE regexp_replace(n, '[ .]', '_', 'g') END AS class FROM c")
def txt_class_norm(spark, sf):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Adenocarcinoma_left.lobe_T2").when(k == 1, "Bengin cases").when(k == 2, "large.cell.carcinoma").otherwise(F.concat("p_type", F.lit(" x.y")))
    return table(spark, sf, "part").select("p_partkey", T.class_name(name).alias("class"))


# Age groups.
AGE_BINS = [("Young Adult", 18, 35), ("Middle Age", 36, 55), ("Senior", 56, 75), ("Elderly", 76, 120)]


@query("prj_bins", "SELECT p_partkey, CASE " + " ".join(f"WHEN p_size * 2.5 BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in AGE_BINS) + " ELSE 'Unknown' END AS age_group FROM part")
def prj_bins(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.bins(F.col("p_size") * 2.5, AGE_BINS).alias("age_group"))


def _rule(c, rules, default):
    return "CASE " + " ".join(f"WHEN {_any(c, terms)} THEN '{n}'" for n, terms in rules) + f" ELSE '{default}' END"


@query("prj_query_slices", f"SELECT conv_id, turn, CASE WHEN {WORDS.format('text')} > 20 THEN 'complex' WHEN {WORDS.format('text')} > 10 THEN 'moderate' ELSE 'simple' END AS complexity, {_rule('lower(text)', T.QUERY_DOMAINS, 'general')} AS domain, {_rule('lower(text)', T.QUERY_TYPES, 'general')} AS query_type FROM conversations WHERE role = 'user'")
def prj_query_slices(spark, sf):
    w, low = T.word_count(F.col("text")), F.lower("text")
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.when(w > 20, "complex").when(w > 10, "moderate").otherwise("simple").alias("complexity"), T.first_rule(low, T.QUERY_DOMAINS, "general").alias("domain"), T.first_rule(low, T.QUERY_TYPES, "general").alias("query_type"))


CONTEXT_SOURCES = [("first", ["the ", "der "]), ("second", ["las ", "les "])]
PAIRS_SQL = "pair AS (SELECT * FROM (SELECT conv_id, turn, role, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"


def pairs(spark, sf):
    """User turns with the assistant turn that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next_role"))
    return c.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", "question", "answer")


_CTX = "concat(answer, ' x.', CASE conv_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'uk' ELSE 'zz' END, ' ', 1995 + conv_id % 30)"


@query("prj_context_slices", f"WITH {PAIRS_SQL}, c AS (SELECT conv_id, turn, lower(question) AS lq, question, lower(question || ' ' || answer) AS both_, {_CTX} AS ctx, lower({_CTX}) AS lc FROM pair) SELECT conv_id, turn, CASE WHEN {WORDS.format('question')} > 15 OR {_any('lq', T.COMPLEX_TERMS)} THEN 'complex' WHEN {WORDS.format('question')} > 8 THEN 'moderate' ELSE 'simple' END AS complexity, {_rule('both_', T.SPECIALTIES, 'general_medicine')} AS specialty, {_rule('lc', CONTEXT_SOURCES, 'unknown')} AS source_class, "
       + _rule("lc", [(c, ["." + t]) for t, c in T.COUNTRY_TLDS], "unknown") + " AS country_class, CASE WHEN regexp_extract(ctx, '(20|19)\\d{2}') = '' THEN 'unknown' WHEN regexp_extract(ctx, '(20|19)\\d{2}')::INT >= 2020 THEN 'recent' WHEN regexp_extract(ctx, '(20|19)\\d{2}')::INT >= 2010 THEN 'moderate' ELSE 'old' END AS publish_year_category FROM c")
def prj_context_slices(spark, sf):
    tld = F.when(F.col("conv_id") % 3 == 0, "de").when(F.col("conv_id") % 3 == 1, "uk").otherwise("zz")
    ctx = F.concat("answer", F.lit(" x."), tld, F.lit(" "), (1995 + F.col("conv_id") % 30).cast("string"))
    lq, lc, w = F.lower("question"), F.lower(ctx), T.word_count(F.col("question"))
    year = F.regexp_extract(ctx, r"(20|19)\d{2}", 0)
    return pairs(spark, sf).select(
        "conv_id", "turn", F.when((w > 15) | F.greatest(*[lq.contains(t) for t in T.COMPLEX_TERMS]), "complex").when(w > 8, "moderate").otherwise("simple").alias("complexity"),
        T.first_rule(F.lower(F.concat_ws(" ", "question", "answer")), T.SPECIALTIES, "general_medicine").alias("specialty"), T.first_rule(lc, CONTEXT_SOURCES, "unknown").alias("source_class"),
        T.first_rule(lc, [(c, ["." + t]) for t, c in T.COUNTRY_TLDS], "unknown").alias("country_class"),
        F.when(year == "", "unknown").when(year.cast("int") >= 2020, "recent").when(year.cast("int") >= 2010, "moderate").otherwise("old").alias("publish_year_category"),
    )


@query("prj_binary_labels", "WITH e AS (SELECT event_id, value % 1 AS sem, value / 10 % 1 AS gro FROM events WHERE event_type <> 'error') SELECT event_id, CAST(0.5 * sem + 0.5 * gro > 0.6 AS INTEGER) AS y_true, CAST(sem > 0.5 AND gro > 0.7 AS INTEGER) AS y_pred FROM e")
def prj_binary_labels(spark, sf):
    sem, gro = F.col("value") % 1, F.col("value") / 10 % 1
    return table(spark, sf, "events").filter("event_type <> 'error'").select("event_id", (0.5 * sem + 0.5 * gro > 0.6).cast("int").alias("y_true"), ((sem > 0.5) & (gro > 0.7)).cast("int").alias("y_pred"))


@query("prj_ts_normalize", "SELECT event_id, strftime(date_trunc('second', ts - INTERVAL 2 HOUR), '%Y-%m-%d %H:%M:%S') AS ts_utc FROM events")
def prj_ts_normalize(spark, sf, zone="+02:00"):
    return table(spark, sf, "events").select("event_id", F.date_format(F.date_trunc("second", F.to_utc_timestamp(F.col("ts").cast("timestamp"), zone)), "yyyy-MM-dd HH:mm:ss").alias("ts_utc"))


def _ow(c):
    return f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^{T.WORD}\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(q(x) for x in T.STOP_WORDS)}))"


@query("txt_overlap", f"""WITH {PAIRS_SQL}, w AS (SELECT conv_id, turn, {_ow('answer')} AS a, {_ow('question')} AS b FROM pair), s AS (SELECT *, list_distinct(a) AS sa, list_distinct(b) AS sb, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS ba, list_distinct(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1])) AS bb FROM w),
    c AS (SELECT *, len(list_intersect(sa, sb))::DOUBLE AS k, len(list_intersect(ba, bb))::DOUBLE AS kb, len(sa) > 0 AND len(sb) > 0 AS ok FROM s)
    SELECT conv_id, turn, CASE WHEN ok THEN round(k / len(sa), 6) ELSE 0 END AS keyword_precision, CASE WHEN ok THEN round(k / len(sb), 6) ELSE 0 END AS keyword_recall, CASE WHEN ok THEN round(2 * k / (len(sa) + len(sb)), 6) ELSE 0 END AS keyword_f1,
    CASE WHEN ok THEN round(k / (len(sa) + len(sb) - k), 6) ELSE 0 END AS unigram_overlap, CASE WHEN ok AND len(ba) > 0 AND len(bb) > 0 THEN round(kb / (len(ba) + len(bb) - kb), 6) ELSE 0 END AS bigram_overlap FROM c""")
def txt_overlap(spark, sf):
    return T.with_overlap(pairs(spark, sf), "answer", "question").select("conv_id", "turn", *T.OVERLAP)
