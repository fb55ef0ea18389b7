"""Functions that SQL calls by name, against the built-in forms."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import sql as SQL
from plumbline.functions import text as T

TEXTS = [
    "lead\n# A\nx\n## B\ny\n# C\n\n# D\nz", "###### six\nbody", "", None, "no head", "## a\n\n##b\n## \n##  c d  \ntext\r\n### deeper\nmore", "# A\r\nx\r\n# B\r\ny", "\x0b# odd\x0c\nv", "#\xa0no break\nw", "# line sep\nq",
    "####### seven\nx\n###### six\ny\n##### five\nz", "# a\n" * 5 + "end", "\n\n\n", "# héad 你\n\U0001f600 text",
]


def test_chunk_is_the_built_in_form(spark):
    SQL.register(spark)
    df = spark.createDataFrame([(i, t, f"c{i}") for i, t in enumerate(TEXTS)], "k long, Text string, level_ string")
    df.createOrReplaceTempView("texts")
    want = [(r.k, r.level_, r.pos, r.c.header, r.c.level, r.c.content) for r in T.with_chunks(df, "Text").select("k", "level_", F.posexplode_outer("chunks").alias("pos", "c")).filter("c is not null").collect()]
    for by in ("", "PARTITION BY k", "WITH SINGLE PARTITION"):
        got = spark.sql(f"SELECT * FROM chunk(TABLE(texts) {by})")
        assert got.columns == ["k", "level_", "chunk_id", "header", "level", "content"]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert spark.sql("SELECT * FROM chunk(TABLE(SELECT * FROM texts WHERE false))").count() == 0


def test_chunk_needs_a_text(spark):
    SQL.register(spark)
    with pytest.raises(Exception, match="column named text"):
        spark.sql("SELECT * FROM chunk(TABLE(SELECT 1 AS x))").collect()


def test_counts_are_the_built_in_forms(spark):
    SQL.register(spark)
    spark.createDataFrame([(t,) for t in [*TEXTS, "It's 12.5 %, naïve_x — ok?", " \t "]], "t string").createOrReplaceTempView("counted")
    got = spark.sql("SELECT t, token_count(t) AS tokens, word_count(t) AS words FROM counted")
    for r in got.select("*", T.token_count(F.col("t")).alias("a"), T.word_count(F.col("t")).alias("b")).collect():
        assert (r.tokens, r.words) == (r.a, r.b)
