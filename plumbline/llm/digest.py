"""Canonical exact document digests, by DataFrame functions alone.

A text's canonical form is Unicode NFKC, full case folding, white space runs
folded to one blank, ends trimmed.  Its digest is 128 bits: two XXH64 values under
different seeds.  Rows are grouped by digest, and inside every group of more
than one the canonical bytes are compared with those of one member, so that a
collision can't pass for a copy: a row whose bytes differ gets a longer digest.

Spark has no normalisation or case folding of its own; ``reflect`` calls the
ICU classes that Spark ships, and only for texts beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialise

#: Repeated digests that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Rows of one digest that are compared in one task.
COMPARED_ROWS = 1000


def _wide(t: Column) -> Column:
    return t.rlike(r"[^\x00-\x7F]")


def _normal(t: Column) -> Column:
    return F.when(_wide(t), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))).otherwise(t)


def _caseless(t: Column) -> Column:
    """Full case folding: sharp s is ss, a final sigma a sigma."""
    return F.when(_wide(t), F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), t, F.lit(True))).otherwise(F.lower(t))


def _folded(low: Column) -> Column:
    # a normal form may change once more when its case is folded
    return F.trim(F.regexp_replace(_normal(low), r"(?U)\s+", " "))


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    return _folded(_caseless(_normal(_text(text))))


def with_canonical(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with ``canonical`` of a column.

    Spark takes ``reflect`` for non-deterministic and works an expression that
    holds it out at each mention; steps that are columns are worked out once.
    """
    step = out_col + "_step"
    while step in docs.columns:
        step += "_"
    low = docs.withColumn(step, _normal(_text(F.col(text_col))))
    low = low.withColumn(step, _caseless(F.col(step)))
    return low.withColumn(out_col, _folded(F.col(step))).drop(step)


def digest(canon: Column) -> Column:
    """32 hex digits: XXH64 under two seeds."""
    one = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(one(1), one(2))


def _sound(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, canon) rows whose digest another canonical form has taken."""
    short = rows.select(F.substring("fp", 1, width).alias("fp"), key, "canon")
    counts = short.groupBy("fp").agg(F.count("*").alias("n"), F.min(key).alias("_first")).filter("n > 1")
    counts = materialise(counts, "repeated")
    # so few digests repeat (48 bytes each) that only texts that share one are shuffled; else all are
    small = counts.count() <= BROADCAST_ROWS
    shared = short.join(F.broadcast(counts) if small else counts, "fp")
    # a digest of many rows is dealt over several tasks, each with a copy of the text to compare with
    parts = F.ceil(F.col("n") / COMPARED_ROWS).cast("int")
    first = shared.filter(F.col(key) == F.col("_first")).groupBy("fp").agg(F.min("canon").alias("held"), F.max("n").alias("n"))
    first = first.select("fp", "held", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rest = shared.filter(F.col(key) != F.col("_first")).withColumn("part", F.pmod(F.xxhash64(key), parts).cast("int"))
    return rest.join(first, ["fp", "part"]).filter("canon <> held").select(key, "canon").distinct()


def with_digest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", out_col: str = "fingerprint", width: int = 32) -> DataFrame:
    """``docs`` with ``out_col``: equal canonical texts have equal digests, and
    unequal ones have unequal digests.

    ``width`` shortens the digest (for tests of collisions).  Null text is
    empty.  Rows with a null id are digested but take no part in the byte
    comparison; a column named like ``out_col`` is replaced; an empty table
    stays empty.
    """
    rows = with_canonical(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("t")), "t", "canon").select("_id", "canon", digest(F.col("canon")).alias("fp"))
    clash = materialise(_sound(rows.filter("_id is not null"), "_id", width), "clashes")
    out = with_canonical(docs.drop(out_col), text_col, out_col)
    out = out.withColumn(out_col, F.substring(digest(F.col(out_col)), 1, width))
    if clash.isEmpty():
        return out
    own, long = free_names(out, "clash", "long")
    ids = clash.select(F.col("_id").alias(own), F.sha2("canon", 256).alias(long)).groupBy(own).agg(F.max(long).alias(long))
    got = out.join(ids, F.col(id_col) == F.col(own), "left")
    return got.withColumn(out_col, F.when(F.col(long).isNotNull(), F.concat(out_col, F.lit("-"), long)).otherwise(F.col(out_col))).drop(own, long)


def likeness(a: Column, b: Column) -> Column:
    """1 if two digests are equal, else 0: an exact digest knows no nearness."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))
