"""Word-table BPE, the Merkle manifest and periodic runs: brute force, edge rows, small portions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import EDGES, frame
from tokenizers import Tokenizer

from plumbline.llm import ann, merkle, queries, runs, sharding, warc, word_table

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a", "B", "é", "ß", "1", "٣", "½", " ", "  ", "\n", "\t", "\r\n", "\xa0", " ", "　", "'s", "'t", "'ll", "'S", "!", "-", "<|endoftext|>", " <|endoftext|> ", "<|endoftext", "你", "\U0001f600",
    "́", "‍", "\U00010940", "\x1c", "\x85", "\x00", "ſ", "\U0002ebf0", "word", "Ünïcode",
]


def sha(x):
    return hashlib.sha256(x).hexdigest()


def library(rows):
    """The digests by the tokenizers library itself."""
    tok = Tokenizer.from_file(BYTES)
    out = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((str(d), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode())))
    return sorted(out)


def mixed(seed, n, most=40):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(0, most)))) for i in range(n)]


@pytest.mark.parametrize("kind", ["table", "edges", "mixed", "portions"])
def test_word_bpe(spark, sf, kind, monkeypatch):
    if kind == "table":
        df = spark.read.parquet(f"{sf}/documents.parquet")
        rows = [(r.doc_id, r.text) for r in df.collect()]
    else:
        rows = EDGES if kind == "edges" else mixed(3, 1500) + [(7000, "x" * 100_000), (7001, " " * 20_000), (7002, "\n" * 999 + "a")] if kind == "mixed" else mixed(4, 300)
        df = frame(spark, rows)
    if kind == "portions":
        for name, n in (("STEP", 50), ("BLOCK", 300), ("BUCKET", 2000), ("PLACES", 7)):
            monkeypatch.setattr(word_table, name, n)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_table.digests(df, BYTES).collect())
    assert got == library(rows)


def test_word_bpe_block_in_portions():
    """Cutting by small portions, in this process, gives the words that whole texts have."""
    v = word_table.Vocabulary(BYTES)
    step, word_table.STEP = word_table.STEP, 20
    try:
        for _, t in mixed(5, 200, 80):
            got = [w for part in word_table._portions(t) for s in word_table._STRETCH.findall(part) for w in v.words(s)]
            assert got == [w for w, _ in v.cutter.pre_tokenize_str(t)]
    finally:
        word_table.STEP = step


def test_word_bpe_numbers():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**32 - 1])
    assert (word_table._numbers(word_table._varint(x)) == x).all()
    assert len(word_table._numbers(b"")) == 0 and word_table._varint(x[:0]) == b""


def test_word_bpe_decodes_any_ids(spark):
    tok = Tokenizer.from_file(BYTES)
    lists = [[], [50256], [128, 129, 200], list(range(300)), [40, 50256, 255]]
    df = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes()), "extra") for i, x in enumerate(lists)] + [(9, None, "null")], "k long, ids binary, decoded_ string")
    got = {r.k: r.decoded for r in word_table.decode(df, BYTES).collect()}
    assert got == {i: tok.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)} | {9: None}


def brute_root(leaves):
    """(root, list of levels) of hex digests, by the definition."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + 16]).encode()) for i in range(0, len(low), 16)])
    return levels[-1][0], levels


def brute_path(levels, i):
    out = []
    for level in levels[:-1]:
        g = i // 16 * 16
        out += [level[c] for c in range(g, min(g + 16, len(level))) if c != i]
        i //= 16
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4096, 4097, 5000, 70000])
def test_merkle_positions(n):
    log = merkle.grown([b"x"] * n, merkle.height(n))
    assert [merkle.position(level, c, n) for level, c, _ in log] == list(range(len(log)))
    assert [level for level, _, _ in log][-1] == merkle.height(n)


@pytest.mark.parametrize("run", [merkle.RUN, 16])
def test_merkle(spark, run, monkeypatch):
    """Trees of many sizes, in several rounds of builders where runs are short."""
    if run == 16:
        monkeypatch.setattr(merkle, "LEVELS", 1)
        monkeypatch.setattr(merkle, "RUN", 16)
        monkeypatch.setattr(merkle, "RANGE_ROWS", 100)
    sizes = {None: 3, "a": 1, "b": 16, "ä": 17, "hot": 700, "z": 256, "": 2}
    rows = [(k, s, f"text {k % 50} of {s}") for s, n in sizes.items() for k in range(n)] + [(5, "b", "repeated"), (5, "b", "repeated"), (None, "b", None), (None, "z", "no id")]
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, text string, tree string, i long")
    changed = F.when(F.col("doc_id") % 3 == 0, merkle.leaf_digest([F.col("doc_id"), F.upper("text")]))
    got = merkle.manifest(df, ["doc_id", "text"], "source", "doc_id", changed).collect()

    def leaf(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode())

    trees = {s: sorted(((d is not None, d or 0), leaf(d, t), d, t) for d, g, t in rows if g == s) for s in sizes}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: brute_root([x[1] for x in trees[s]]) for s in order}
    root, high = brute_root([built[s][0] for s in order])
    want = []
    for k, s in enumerate(order):
        for i, (_, digest, d, t) in enumerate(trees[s]):
            path = brute_path(built[s][1], i) + brute_path(high, k)
            changes = d is not None and d % 3 == 0 and t is not None and t.upper() != t
            want.append((str(d), digest, built[s][0], root, sha("".join(path).encode()), not changes))
    shown = sorted((str(r.doc_id), r.leaf.hex(), r.subroot.hex(), r.root.hex(), sha("".join(p.hex() for p in r.path).encode()), r.verified) for r in got)
    assert shown == sorted(want)
    assert all((r.folded == r.root) == r.verified for r in got)


def test_merkle_fold_tells_the_changed_root():
    leaves = [sha(str(i).encode()) for i in range(300)]
    _, levels = brute_root(leaves)
    other = leaves[:]
    other[41] = sha(b"other")
    assert merkle.fold(bytes.fromhex(other[41]), 41, 300, [bytes.fromhex(x) for x in brute_path(levels, 41)]).hex() == brute_root(other)[0]


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in out.items())


def periodic(rng):
    k, w = rng.choice([1, 2, 2, 3, 5, 50]), []
    for _ in range(rng.randint(0, 6)):
        w += [rng.randrange(k) for _ in range(rng.randint(1, 9))] * rng.randint(1, rng.choice([1, 3, 9, 30]))
    return w


def test_runs_against_brute_force(monkeypatch):
    rng = random.Random(5)
    for trial in range(150):
        texts = [periodic(rng) for _ in range(rng.randint(1, 12))]
        monkeypatch.setattr(runs, "CANDIDATES", rng.choice([7, 1 << 20]))
        got = [[] for _ in texts]
        for t, s, length, q in zip(*(x.tolist() for x in runs.find(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts])))):
            got[t].append((s, q, length))
        assert got == [brute_runs(t) for t in texts]


def test_grammar_extensions():
    """Extensions to both sides, from all pairs of places, against comparing word by word."""
    rng = random.Random(7)
    for _ in range(25):
        w = np.array([0, *(1 + x + 1 for x in periodic(rng) or [1]), 1], np.int64)
        levels = runs.grammar(w, 2)
        p, q = (x.ravel() for x in np.meshgrid(np.arange(len(w)), np.arange(len(w))))
        p, q = p[p != q], q[p != q]
        for back in (False, True):
            got = runs.extension(levels, p, q, back)
            for a, b, n in zip(p[::17].tolist(), q[::17].tolist(), got[::17].tolist()):
                k = 0
                while 0 <= min(a, b) and max(a, b) < len(w) and w[a] == w[b]:
                    a, b, k = a + (-1 if back else 1), b + (-1 if back else 1), k + 1
                assert n == k


def collapsed(words, found):
    gone = {i for s, q, length in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_rows(spark, monkeypatch):
    rng = random.Random(9)
    rows = EDGES + [(100 + i, rng.choice([" ", "\n", " \t "]).join(f"w{x}" for x in periodic(rng))) for i in range(60)] + [(300, "a\xa0b " * 8), (301, "long " * 30_000), (301, "long " * 30_000)]
    monkeypatch.setattr(runs, "PORTION", 500)
    got = sorted((str(r.doc_id), [(x.start, x.period, x.length) for x in r.runs], r.collapsed) for r in runs.periodic_runs(frame(spark, rows)).collect())
    want = []
    for d, t in rows:
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t or "").split(" ") if w]
        found = brute_runs(words) if len(words) < 5000 or len(set(words)) > 3 else None
        if found is None:  # one word, or a short period, throughout
            q = len(set(words))
            found = [(0, q, len(words))] if all(a == b for a, b in zip(words, words[q:])) else brute_runs(words)
        want.append((str(d), found, collapsed(words, found)))
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["op11_runs", "op12_merkle"])
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, cur.fetchall()))


def test_runs_query_plants_repeats(spark, tmp_path):
    """The query's rewritten texts against the rule, null and empty texts and null ids among them."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(i % 60))) for i in range(400)] + [(None, "a b"), (20, None), (21, "")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op11_runs(spark, str(tmp_path)).collect())
    want = []
    for d, t in rows:
        w = (t or "").split()
        h, n = zlib.crc32(str(d).encode()), len(w)
        if d is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        s, q, length = min(found, key=lambda r: (-r[2], r[0], r[1])) if found else (None, None, None)
        text = "".join(f"{a},{c},{b}\n" for a, b, c in found)
        want.append((str(d), len(found), s, length, q, 1000 * length // q if found else None, sha(text.encode()), sha(collapsed(w, found).encode())))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty_tables(spark, tmp_path):
    frame(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("op11_runs", "op12_merkle", "op13_word_bpe"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def brute_nearest(rows, asked, k=10):
    """{query id: [(id, distance)]}; an id's nearest row counts, a query id's rows are ranked together."""
    out = {}
    for q in {i for i, v in rows if i is not None and i % asked == 0}:
        best = {}
        for i, v in rows:
            if i is not None and i != q:
                d = min(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())) for j, w in rows if j == q)
                best[i] = min(best.get(i, np.inf), d)
        out[q] = sorted(((d, i) for i, d in best.items()))[:k]
    return out


@pytest.mark.parametrize("blocks", [20_000, 9])
def test_ann_repeated_ids(spark, blocks, monkeypatch):
    """An id on a third of the rows, beside a query; queries of several rows; columns with the names used inside."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(2)
    rows = [(i % 60, rng.normal(size=4).tolist()) for i in range(80)] + [(7, [0.01 * k, 0.0, 0.0, 0.0]) for k in range(1, 41)] + [(10, [0.0, 0.0, 0.0, 0.001])] * 3 + [(None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6, 7) for i, v in rows], "vec_id long, embedding array<double>, id int, v int, part int, block int, `set` int, row int, is_query int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0, parts=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, 10)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [i for _, i, _ in found] == [i for _, i in want[q]]
        assert [s for _, _, s in found] == pytest.approx([d for d, _ in want[q]], abs=1e-12)


def test_ann_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [5.0, 1.0]), (2, [0.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 1.0)]


@pytest.mark.parametrize("most", [65_536, 3])
def test_next_of_many_null_ids(spark, most, monkeypatch):
    """A third of the rows without an id, another third under one id; ranges are bounded, and every row has its next."""
    monkeypatch.setattr(queries, "CHAIN_ROWS", 5)
    monkeypatch.setattr(queries, "CHAINS", most)
    rows = [(None, f"n{k}", k) for k in range(60)] + [(7, f"h{k}", 100 + k) for k in range(60)] + [(k, f"t{k}", 200 + k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    collected = []
    take = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(len(out := take(self))) or out)
    out = queries.with_next(df, "doc_id", "row", ["text", "doc_id"], "next_")
    monkeypatch.undo()
    assert max(collected) <= 3 * most
    got = {r.text: (r.doc_id, r.next_text, r.next_doc_id) for r in out.collect()}
    assert len(got) == 180 and len({n for _, n, _ in got.values()}) == 180
    # one cycle through all rows, ids descending, null ones last
    order, at = [], min(got)
    for _ in range(180):
        order.append(got[at][0])
        assert got[at][2] == got[got[at][1]][0]
        at = got[at][1]
    k = max(i for i in range(180) if (order[i - 1] is None) and order[i] is not None)
    turned = [-1 if x is None else x for x in order[k:] + order[:k]]
    assert turned == sorted(turned, reverse=True)


def test_write_shards_keeps_every_row(spark, tmp_path):
    """Null and repeated ids, repeated rows, and columns named like the folders."""
    rows = EDGES + EDGES[:4] + [(None, "x"), (None, "x")]
    df = spark.createDataFrame([(i, t, n % 3, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, shard int, _row int")
    sharding.write_shards(df, str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(str(tuple(r)) for r in back.select(df.columns).collect()) == sorted(str(tuple(r)) for r in df.collect())
    sizes = back.groupBy("_shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n")).collect()
    assert {r._shard for r in sizes} <= set(range(5)) and sum(r.n for r in sizes) == sum(len((t or "").encode()) + 16 for _, t in rows)
    own = {r.text: r._shard for r in back.filter("length(text) between 1 and 30").collect()}
    assert all(own[t] == s for t, s in ((r.text, r._shard) for r in back.collect()) if t in own)


def test_warc_of_a_hot_payload(spark):
    """A third of the rows with one payload, null ids among them, columns with the names used inside."""
    hot, cold = "<p>" + "h" * 2000, lambda k: f"<p>{k} " + "c" * (900 + k)
    rows = [(k if k % 7 else None, hot if k % 3 == 0 else cold(k % 40)) for k in range(150)] + [(10, hot), (149, hot), (3, None), (4, "")]
    df = spark.createDataFrame([(i, f"http://x/{n}", h, 1, 2, 3, 4) for n, (i, h) in enumerate(rows)], "page_id long, url string, html string, row int, id int, body int, refers int")
    top, often = {}, {}
    for i, h in rows:
        b = (h or "").encode()
        often[b] = often.get(b, 0) + 1
        if i is not None:
            top[b] = max(i, top.get(b, i))
    want = []
    for i, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and often[b] > 1 and b in top and i != top[b]
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", str(top[b] if revisit else None)))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.archive(df).collect()]
    assert sorted(got) == sorted(want)
