"""The ten operators against brute force, on the smallest tables and on edge rows."""

import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import ann, bpe, digest, lang_id, packing, queries, secrets, sharding, simhash, warc, wavelet
from plumbline.llm.files import opened

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, t string, row string, part string, bucket string"
EDGES = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two"), (5, "one  two\nthree four"), (6, "ONE two three four"), (7, "Straße été Привет 你好 \U0001f600!"),
    (8, "x" * 3000), (9, "a b c " * 2000), (10, "a b c " * 2000), (None, "a null id"), (3, "one"), (12, "12 34 -- 56"), (13, "fi ne space\x1c\x85end  \n "), (14, "<|endoftext|> it's 'S we'll"),
]


def frame(spark, rows=EDGES):
    return spark.createDataFrame([(i, t, "en", "s", 1, "c", "c", "c", "c", "c", "c") for i, t in rows], DOC_SCHEMA)


def docs_of(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def brute_fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    fps = [brute_fp(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted((str(d), f"{fps[i]:016x}", str(min(least[find(i)], default=None))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("kind", ["table", "edges"])
def test_simhash(spark, sf, kind):
    df = spark.read.parquet(f"{sf}/documents.parquet") if kind == "table" else frame(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_groups(df).collect())
    assert got == brute_groups(rows)


def test_simhash_links_dense_blocks(spark):
    rng = np.random.default_rng(0)
    centre = int(rng.integers(1 << 62))
    fps = set()
    while len(fps) < 300:
        x = centre
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps |= {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 100)}
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in simhash.connected_components(simhash.links(nodes, dense=8, block=32)).collect()}
    order = sorted(fps)
    label = {x: x for x in order}
    changed = True
    while changed:
        changed = False
        for x in order:
            m = min(label[y] for y in order if bin((x ^ y) & (1 << 64) - 1).count("1") <= 3)
            if m < label[x]:
                label[x], changed = m, True
    assert {x: got.get(x, x) for x in order} == label


def test_empty_tables(spark, sf):
    empty = frame(spark).limit(0)
    assert simhash.simhash_groups(empty).count() == 0
    assert wavelet.read_documents(wavelet.write_shards(empty, WORDS)).count() == 0
    assert packing.pack(empty, WORDS).count() == 0
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert digest.with_digest(empty).count() == 0
    assert lang_id.identify(empty).count() == 0
    assert sharding.shard_by_bytes(empty).count() == 0
    assert secrets.scan(empty).count() == 0
    assert queries.with_next(empty.withColumn("own", F.monotonically_increasing_id()), "doc_id", "own", ["text"], "next_").count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0


def token_ids(texts):
    t = Tokenizer.from_file(WORDS)
    return [np.array([*e.ids, 2], "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["table", "edges"])
def test_wavelet(spark, sf, kind):
    df = spark.read.parquet(f"{sf}/documents.parquet") if kind == "table" else frame(spark)
    hashed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in hashed)
    ids = token_ids([t for *_, t in rows])
    expected, at = [], 0
    for (has, d, *_), raw in zip(rows, ids):
        expected.append((d if has else None, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    manifest = wavelet.write_shards(df, WORDS, shard_bytes=60_000)
    assert kind == "edges" or manifest.count() > 3
    got = wavelet.read_documents(manifest).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected
    first = manifest.orderBy("part", "shard").first()
    with opened(first.path) as f:
        w = wavelet.WaveletFile(f)
        all_ids = np.frombuffer(b"".join(ids), "<u4")[: w.n]
        for i in (0, 1, w.n // 2, w.n - 1):
            token = int(all_ids[i])
            assert w.access(i) == token
            assert w.count(token) == int((all_ids == token).sum())
            assert w.count(token, 3, w.n // 2 + 3) == int((all_ids[3 : w.n // 2 + 3] == token).sum())
            k = int((all_ids[:i] == token).sum())
            assert w.occurrence(token, k) == i
        assert w.count(10**6) == 0
        with pytest.raises(IndexError):
            w.occurrence(int(all_ids[0]), w.n)


@pytest.mark.parametrize("kind", ["table", "edges"])
def test_packing(spark, sf, kind):
    df = spark.read.parquet(f"{sf}/documents.parquet") if kind == "table" else frame(spark)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    whole = defaultdict(list)
    for (d, _), raw in zip(rows, token_ids([t for _, t in rows])):
        whole[d].append(raw)
    got = packing.pack(df, WORDS).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= packing.WINDOW
    assert set(pieces) == set(whole)
    for d, ps in pieces.items():
        if len(whole[d]) == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(whole[d][0]) // 4
                assert p.ids_crc32 == zlib.crc32(whole[d][0][4 * at : 4 * (at + p.length)])
                at += p.length
            assert at == ps[0].doc_tokens
    assert sum(r.length for r in got) == sum(len(x) // 4 for v in whole.values() for x in v)
    if kind == "table":
        assert sum(r.length for r in got) / (len(seqs) * packing.WINDOW) > 0.97


def test_sum_of_squares_rule():
    p = packing.SumOfSquares(8)
    ids = lambda n: b"\0" * 4 * n
    rng = np.random.default_rng(1)
    for n in rng.integers(1, 8, 300).tolist():
        levels = p.levels.copy()
        changes = {}
        for h in range(0, 9 - n):
            if h == 0 or levels[h]:
                after = levels.copy()
                after[h] -= h > 0
                if h + n < 8:
                    after[h + n] += 1
                changes[h] = int((after[1:8] ** 2).sum())
        assert changes[p.place(n)] == min(changes.values())
        list(p.add(0, ids(n), (0, n)))
    assert len([w for w in p.close() if sum(len(i) // 4 for _, i, _ in w) < 8]) <= 1


@pytest.mark.parametrize("kind", ["table", "edges"])
def test_bpe(spark, sf, kind):
    df = spark.read.parquet(f"{sf}/documents.parquet") if kind == "table" else frame(spark)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    expected = []
    for r in df.collect():
        ids = lib.encode_ordinary(r.text or "")
        expected.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(expected)
    whole = bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in whole) == sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_warc(spark, sf):
    big, chunked = "same " * 400, "é" * 5000
    extra = [(-1, "u\r\nx", big), (-2, "u", big), (-3, None, None), (-4, "u", ""), (None, "u", big), (-6, "u", chunked), (-7, "u", "tiny"), (-8, "u", "tiny"), (-6, "u", chunked)]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").union(spark.createDataFrame(extra, "page_id long, url string, html string"))
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    top = {}
    for d, b in rows:
        if d is not None and len(b) >= 1000:
            top[b] = max(top.get(b, d), d)
    expected = []
    for d, b in rows:
        revisit = b in top and sum(x == b for _, x in rows) > 1 and top[b] != d
        expected.append((str(d), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", str(top[b] if revisit else None)))
    chunks = warc.chunk_table(pages, chunk=1000)
    assert chunks.agg(F.max(F.octet_length("chunk"))).first()[0] <= 1000
    got = warc.read_archives(warc.write_archives(chunks)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(expected)


def brute_near(rows, queries, k=10):
    out = []
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q)
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d[:k])]
    return out


def test_ann_small_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows[7] = (7, rows[6][1])
    bad = [(100, None), (200, []), (300, [0.0] * 4), (400, [1.0, None, 0.0, 0.0]), (500, [float("nan")] * 4), (600, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (700, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()]
    want = brute_near(rows, [r for r in rows if r[0] % 10 == 0])
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def recall(df):
    rows = df.collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    shares = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((v - v[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        shares.append(len(got[ids[i]] & set(ids[np.argsort(d)[:10]].tolist())) / 10)
    return np.mean(shares)


def test_ann_recall(spark, monkeypatch):
    """The registered settings, on more rows than the fitted sample has too."""
    probes = []
    monkeypatch.setattr(ann, "train", lambda *a, f=ann.train: probes.append((r := f(*a))[1:]) or r)
    assert recall(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")) >= 0.9
    rng, n = np.random.default_rng(5), 20_000
    centres = rng.normal(size=(200, 32)) * 4
    x = (centres[rng.integers(0, 200, n)] + rng.normal(size=(n, 32))).tolist()
    assert recall(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")) >= 0.9
    assert all(parts > 1 for parts, _ in probes) and probes[1][1] * 3 < probes[1][0]


def brute_canon(text):
    low = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(low.split())


@pytest.mark.parametrize("kind", ["table", "edges"])
def test_digest(spark, sf, kind):
    df = spark.read.parquet(f"{sf}/documents.parquet") if kind == "table" else frame(spark, [*EDGES, (20, "Ａ b\n"), (21, "a  B"), (22, "ét"), (23, "ÉT")])
    got = digest.with_digest(df).select("text", "fingerprint").collect()
    by = defaultdict(set)
    for r in got:
        by[r.fingerprint].add(brute_canon(r.text or ""))
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len({brute_canon(r.text or "") for r in got})


@pytest.mark.parametrize("compared", [1000, 3])
def test_digest_collisions(spark, monkeypatch, compared):
    monkeypatch.setattr(digest, "COMPARED_ROWS", compared)
    rows = [(i, f"text {i // 2}") for i in range(200)]
    got = digest.with_digest(frame(spark, rows), width=1).collect()
    by = defaultdict(set)
    for r in got:
        by[r.fingerprint].add(r.text)
    assert len(by) == 100 and all(len(v) == 1 for v in by.values())


def test_op7_edits(spark, sf):
    docs = docs_of(spark, sf)
    order = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in queries.op7_digest(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, d in enumerate(order):
        text, nxt = docs[d], docs[order[(i + 1) % len(order)]]
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[:k]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(brute_canon(text) == brute_canon(edited)) == float(r.fingerprint == r.edited_fingerprint)
        assert r.near_next == float(brute_canon(text) == brute_canon(nxt))


def test_with_next_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(queries, "CHAIN_ROWS", 7)
    ids = list(range(0, 300, 3))
    df = spark.createDataFrame([(i, str(i), j, "c") for j, i in enumerate(ids)], "doc_id long, text string, own long, bucket string")
    got = {r.doc_id: r.next_text for r in queries.with_next(df, "doc_id", "own", ["text"], "next_").collect()}
    assert got == {i: str(ids[(j - 1) % len(ids)]) for j, i in enumerate(ids)}
    # ids that repeat or are null: every row follows exactly one, in descending order of ids
    rows = [(i, j) for j, i in enumerate([5] * 60 + [None] * 40 + ids[:50])]
    df = spark.createDataFrame([(i, f"{i}/{j}", j) for i, j in rows], "doc_id long, text string, own long")
    got = {r.text: r.next_text for r in queries.with_next(df, "doc_id", "own", ["text"], "next_").collect()}
    assert sorted(got) == sorted(got.values()) == sorted(f"{i}/{j}" for i, j in rows)
    key = lambda t: -1 if t.startswith("None") else int(t.split("/")[0])
    up = [(t, n) for t, n in got.items() if key(n) > key(t)]
    assert len(up) == 1 and key(up[0][0]) == -1 and key(up[0][1]) == ids[49]


def test_range_bucket_of_many_cuts(spark):
    from plumbline.llm.common import range_bucket

    bounds = list(range(0, 160_000, 20))
    df = spark.range(0, 200_000).select("id", range_bucket(F.col("id"), bounds).alias("b"))
    assert df.filter("b <> least(8000, cast(ceil(id / 20) as int))").count() == 0


def test_language(spark, sf):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in df.collect()}
    got = lang_id.identify(df).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    # lang of held-out rows isn't read
    other = df.withColumn("lang", F.when(lang_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, lang_id.identify(other).collect())) == sorted(map(tuple, got))


def test_language_edges(spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(frame(spark)).collect()}
    assert got[0] == got[1] == got[2] == got[12] == ("und", 0.0)
    assert lang_id.identify(frame(spark)).count() == len(EDGES)


def test_counts_in_steps(monkeypatch):
    text = "The quick bröwn fox. " * 40
    whole = lang_id.counts(text)
    monkeypatch.setattr(lang_id, "_STEP", 37)
    assert (lang_id.counts(text) == whole).all()


@pytest.mark.parametrize("kind", ["table", "edges"])
def test_sharding(spark, sf, kind):
    df = spark.read.parquet(f"{sf}/documents.parquet") if kind == "table" else frame(spark)
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    out = sharding.shard_by_bytes(df, range_rows=11)
    got = out.collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len(b) + 16, zlib.crc32(b)) for d, b in rows)
    total, largest, by = sum(r.size for r in got), max(r.size for r in got), defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(40))
    room = largest + sharding.GROUP_SHARE * total / 40
    for s, rs in by.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - total / 40) <= room
    # a group of equal texts is parted only if it is larger than its share
    groups = defaultdict(list)
    for r in got:
        groups[r.text_crc32, r.size].append(r)
    for (_, size), g in groups.items():
        assert len({r.shard for r in g}) == 1 or size * len(g) > sharding.GROUP_SHARE * total / 40


def test_sharding_writes(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(df, str(tmp_path / "out"), shards=5)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 5


def test_secrets(spark, sf):
    big = "/root/testdata/sf0.01/documents.parquet"
    df = spark.read.parquet(big)
    got = secrets.scan(df).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    expected = sorted((d, m.start(), m[0]) for d, t in texts.items() for m in re.finditer(secrets.CANDIDATE, t or ""))
    assert sorted((r.id, r.start, r.value) for r in got) == expected
    planted = {(d, m.start(1)) for d, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")}
    assert planted and planted == {(r.id, r.start) for r in got if r.is_secret}
    clean = secrets.redact(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    after = {r.doc_id: r for r in clean.collect()}
    for d, t in texts.items():
        assert after[d].text == re.sub(r'(?<=token = ")[0-9a-f]{40}(?=")', secrets.MASK, t or "") and after[d].n_chars == len(after[d].text)


def test_secrets_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = secrets.dictionary(df)
    rows = secrets.labelled_findings(df)
    fit, held = rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0")
    model = secrets.fit(fit, pieces)
    got = secrets.classify(held, pieces, model).selectExpr("avg(cast(is_secret = (label = 1) as double))").first()[0]
    assert got > 0.97
    with pytest.raises(ValueError):
        secrets.fit(rows.filter("label = 0"), pieces)


def test_secrets_edges(spark):
    rows = [*EDGES, (30, 'x token = "0123456789abcdef0123456789abcdef01234567" y token = "0123456789abcdef0123456789abcdef01234567"')]
    df = frame(spark, rows)
    out = secrets.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert secrets.candidates(df).filter("id = 30").count() == 2
    assert {r.doc_id: r.text for r in out.collect()}[30] == 'x token = "[SECRET]" y token = "[SECRET]"'
    # a table of one row has a model as well, and columns of any name stay as they are
    one = spark.createDataFrame([(1, rows[-1][1], "s", "a", "b", "c", "d")], "doc_id long, text string, source string, key string, row string, secrets string, redacted string")
    assert [tuple(r) for r in secrets.redact(one).collect()] == [(1, 'x token = "[SECRET]" y token = "[SECRET]"', "s", "a", "b", "c", "d")]


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "secret_scan", "pack"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) > 0.95 * docs.filter(F.col("text").rlike(r"\p{L}")).count()
    one = corpus_pipeline.near_dedup(spark, kept, sf)
    assert sorted(r.doc_id for r in one.collect()) == sorted({int(c) for _, _, c in brute_groups(rows)})
    safe = corpus_pipeline.secret_scan(spark, one, sf)
    assert safe.columns == docs.columns and safe.count() == one.count()
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in safe.collect()}


def test_keep_one_per_group_by_row(spark):
    long = "the quick brown fox jumps over the lazy dog and runs on through the wood " * 8
    rows = [(5, long)] * 6 + [(None, "alpha beta gamma delta")] * 3 + [(2, "moons and stars above"), (2, "an unlike text altogether"), (1, "moons and stars above"), (9, "an unlike text altogether")]
    kept = simhash.keep_one_per_group(frame(spark, rows))
    assert kept.columns == frame(spark).columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, [(5, long), (None, "alpha beta gamma delta"), (1, "moons and stars above"), (2, "an unlike text altogether")]))


def test_redact_null_id(spark):
    planted = 'x token = "0123456789abcdef0123456789abcdef01234567" y'
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    extra = spark.createDataFrame([(None, planted, "s"), (None, "plain", "s")], "doc_id long, text string, source string")
    got = {r.text for r in secrets.redact(table.union(extra)).filter("doc_id is null").collect()}
    assert got == {'x token = "[SECRET]" y', "plain"}


def test_secrets_short_and_assigned(spark):
    sample = [
        ('the password = "hT9!x#2@q" stays', "hT9!x#2@q"), ("DB_PASSWORD: w7$Kp%3z end", "w7$Kp%3z"), ('{"pwd": "Sunny@8412"}', "Sunny@8412"),
        ("api_key=9f86d081884c7d659a2feaa0c55ad015a3bf4f1b next", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"), ("export TOKEN=ghp_aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5", "ghp_aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5"),
    ]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    extra = spark.createDataFrame([(-1 - i, t, "") for i, (t, _) in enumerate(sample)] + [(-9, "His secret: never give up", "")], "doc_id long, text string, source string")
    found = {(r.id, r.start, r.value, r.left[-1:]) for r in secrets.candidates(extra).collect()}
    assert {(-1 - i, t.index(v), v, t[t.index(v) - 1]) for i, (t, v) in enumerate(sample)} | {(-9, 12, "never", " ")} == found
    got = {r.doc_id: r.text for r in secrets.redact(table.union(extra)).filter("doc_id < 0").collect()}
    assert got == {-1 - i: t.replace(v, secrets.MASK) for i, (t, v) in enumerate(sample)} | {-9: "His secret: never give up"}


def test_bpe_long_pieces():
    rng, ranks = np.random.default_rng(3), bpe.load_ranks(RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    letters = lambda n, of: "".join(rng.choice(list(of), n))
    texts = ["x" * 100_001, "abc" * 40_000, letters(100_000, "etaoinshrdlu"), letters(40_000, "的一是不了人我在有他"), "z" * ((8 << 20) + 3)]
    for text, got in zip(texts, codec.encode(texts)):
        assert got == np.array(lib.encode_ordinary(text), "<u4").tobytes()


class Task:
    """Stands for a DataFrame; holds the function that ``mapInArrow`` is given."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    withColumnRenamed = select


def test_pack_holds_portions_of_a_batch(spark, monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from plumbline.llm import tokens

    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(tokens, "PORTION", 1 << 17)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    texts = [f"w{i % 97} and the river {i % 89} of words " * 150 for i in range(2000)] + [None, "", "x" * 300_000]
    batch = pa.record_batch({"id": pa.array(range(len(texts))), "t": pa.array(texts)})
    run = packing.pack(Task(), WORDS, keep=tokens.FEW).run
    list(run([batch.slice(0, 10)]))  # loads the vocabulary
    tracemalloc.start()
    got = defaultdict(int)
    for out in run(iter([batch])):
        for r in out.to_pylist():
            got[r["id"]] += r["length"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = tokens.WordEncoder(WORDS).encode_column(batch.column(1), 2)[1]
    assert [got[i] for i in range(len(texts))] == np.diff(whole).tolist()
    assert peak < 20e6  # the ids of all texts are 13 MB, and were held four times
    assert tokens._ENCODERS[WORDS].keep == tokens.FEW < tokens.KEEP


def test_forest_of_a_large_block_pair_in_strips(spark):
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    centres = rng.integers(-(2**63), 2**63, 40, dtype=np.int64)
    flips = np.int64(1) << rng.integers(0, 63, (2048, 2), dtype=np.int64)
    fps = np.unique(centres[rng.integers(0, 40, 2048)] ^ flips[:, 0] ^ flips[:, 1])
    tracemalloc.start()
    got = simhash._forest(pd.DataFrame({"fp": fps}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    root = {f: f for f in fps.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= simhash.DISTANCE
    for i, j in zip(*np.nonzero(near)):
        a, b = find(int(fps[i])), find(int(fps[j]))
        root[max(a, b)] = min(a, b)
    want = {f: find(f) for f in root if find(f) != f}
    assert dict(zip(got["a"].tolist(), got["b"].tolist())) == want
