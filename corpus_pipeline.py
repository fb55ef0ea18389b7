"""Corpus preparation: language ID, near-dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before has
kept, and returns a DataFrame that is written as Parquet and reread as the
next one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import lang_id, packing, secrets, simhash
from plumbline.llm.common import materialise, ship
from plumbline.llm.tokens import FEW

#: A document whose calibrated language score is lower is rejected.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; null and letterless texts, and
    those of no clear language, go.  The model is trained on the stage's own
    labelled documents that aren't held out."""
    ship(spark)
    model = lang_id.train(docs.filter(~lang_id.held_out(F.col("doc_id"))))
    if not model.langs:  # nothing was labelled, so nothing can be rejected but letterless text
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return lang_id.predict(docs, model, docs.columns).filter((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest id."""
    ship(spark)
    return simhash.keep_one_per_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep=FEW)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("pack", pack)]

#: No stage of learned decisions is SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
