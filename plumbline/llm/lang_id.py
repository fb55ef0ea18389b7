"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weights of character 1- to 3-grams, hashed to a fixed
number of buckets; document frequencies are counted over every training
document.  The weights are fitted with follow-the-regularised-leader (FTRL-
proximal, McMahan et al., 2013) under L1 and L2 penalties on a bounded sample:
the ``PER_LANGUAGE`` training documents of each language with the least
xxhash64 of their id (one text where an id repeats).  A fifth of the sample isn't fitted but sets the
temperature that calibrates the scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: The bound of the sample that the classifier is fitted on, for each language.
PER_LANGUAGE = 500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_STEP = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of a text's hashed n-grams; None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    total = np.zeros(BUCKETS, dtype=np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for at in range(0, len(text), _STEP):
        # what isn't a letter is one blank; overlapping ends keep every n-gram once
        part = text[max(0, at - 2) : at + _STEP].lower()
        cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.where((cp < 128) & ~((cp >= 97) & (cp <= 122)), np.uint32(32), cp)
        skip = 2 if at else 0
        a = cp * _MIX[0]
        two = a[:-1] ^ (cp[1:] + np.uint32(0x7F4A7C15)) * _MIX[1]
        three = two[:-1] ^ (cp[2:] + np.uint32(0x165667B1)) * _MIX[2]
        grams = [a[skip:], two[max(0, skip - 1) :], three]
        mixed = np.concatenate(grams)
        mixed = (mixed ^ mixed >> np.uint32(15)) * _MIX[1]
        total += np.bincount(mixed >> shift, minlength=BUCKETS)
    return total


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Sparse TF-IDF of a text, of length 1."""
    c = counts(text)
    if c is None:
        return None
    at = np.flatnonzero(c)
    x = (1 + np.log(c[at])) * idf[at]
    return at.astype(np.int32), (x / np.sqrt((x * x).sum())).astype(np.float32)


class Model:
    """Languages, weights (languages x buckets), idf and temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.langs, self.weights, self.idf, self.temperature = langs, weights, idf, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text, self.idf) if self.langs else None
        if x is None:
            return UNKNOWN, 0.0
        z = self.weights[:, x[0]] @ x[1] / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.langs[k], float(p[k] / p.sum())


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], langs: int, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights by FTRL-proximal over rows (label, buckets, values)."""
    z = np.zeros((langs, BUCKETS), np.float64)
    n = np.zeros((langs, BUCKETS), np.float64)

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, at, x = rows[i]
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(p, x)
            g2 = ns + g * g
            z[:, at] = zs + g - (np.sqrt(g2) - np.sqrt(ns)) / ALPHA * w
            n[:, at] = g2
    return weights(z, n).astype(np.float32)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log likelihood (golden section)."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on rows with a non-null language and id; without any, nothing is learned."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")).filter("id is not null and lang is not null")

    def frequency(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                c = counts(t.as_py())
                if c is not None:
                    df += c > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS).astype(np.int32)), pa.array(np.append(df[at], n))], ["bucket", "n"])

    # at most BUCKETS + 1 rows reach the driver
    found = rows.select("t").mapInArrow(frequency, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in found:
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    # about four times as many ids as are wanted pass a language's threshold, so that few are ranked
    ids = rows.select("id", "lang", F.xxhash64("id").alias("h"))
    sizes = ids.groupBy("lang").agg(F.approx_count_distinct("id").alias("n"))  # a row a language
    place = F.col("h") / F.lit(2.0**64) + 0.5  # from 0 to 1 in the order of h
    few = ids.join(F.broadcast(sizes), "lang").filter(place * F.col("n") <= 4 * per_language).select("id", "lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language).select("id").distinct()
    sample = rows.join(F.broadcast(chosen), "id", "left_semi")  # per_language ids a language
    # one text of each id, so that a repeated id doesn't break the bound
    sample = sample.groupBy("id", "lang").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("id", "t", "lang")

    def extract(batches):
        for b in batches:
            got = [(i, l, *x) for i, l, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1)) if (x := features(t.as_py(), idf)) is not None]
            ids, langs, at, x = zip(*got) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "lang", "at", "x"])

    got = sorted(sample.mapInArrow(extract, "id long, lang string, at binary, x binary").collect(), key=lambda r: (r["id"], r["lang"], bytes(r["at"])))
    langs = sorted({r["lang"] for r in got})
    data = [(langs.index(r["lang"]), np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in got]
    fit, held = [d for i, d in enumerate(data) if i % 5], data[::5]
    weights = fit_ftrl(fit, len(langs)) if langs else np.zeros((0, BUCKETS), np.float32)
    scores = np.array([weights[:, at] @ x for _, at, x in held]) if langs else np.zeros((0, 0))
    return Model(langs, weights, idf, fit_temperature(scores, np.array([y for y, _, _ in held], dtype=int)))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row, with lang_pred and score (0 to 1).

    A null text or one without letters is ``und`` with score 0.  Only the text
    is an input of the prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("_t"))

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*b.schema.names[: len(keep)], "lang_pred", "score"]
            )

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns[:-1]), "lang_pred string, score double"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def held_out(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; rows with a null id are held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred, score of every row.

    Learns only from rows that aren't held out and have a language; repeated
    rows are predicted alike; without any training row every row is ``und``.
    """
    model = train(docs.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    out = predict(docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")), model, ["id", "held_out"])
    return out.withColumnRenamed("id", id_col)
