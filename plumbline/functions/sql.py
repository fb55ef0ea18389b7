"""Functions that SQL can call by name, beside the built-in forms.

``register`` makes them known to a session:

- ``chunk(TABLE(t) [PARTITION BY ...])``: the chunks of a table of texts, as a
  Python table function.  Any columns but ``text`` are carried along.
- ``token_count(text)``, ``word_count(text)``: SQL functions that Spark puts
  into the plan, so they cost what the expressions cost.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import text as T

#: What a blank of the built-in form is, and what its "." isn't.
_BLANK, _ENDS = " \t\n\x0b\f\r", "\n\r\x85\u2028\u2029"
_HEADER = re.compile(rf"(#{{1,6}})[{_BLANK}]+([^{_ENDS}]+)")


def cut(text: str) -> list[tuple[str, int, str]]:
    """(header, level, content) of a text's chunks; see ``functions.text.with_chunks``."""
    lines = text.split("\n")
    heads = [_HEADER.fullmatch(line.strip(_BLANK)) for line in lines]
    top = min((len(h[1]) for h in heads if h), default=6)
    top = 1 if top == 6 else top
    starts = [i for i, h in enumerate(heads) if h and len(h[1]) <= top]
    out = []
    for a, b in zip([-1, *starts], [*starts, len(lines)]):
        content = "\n".join(lines[a + 1 : b]).strip(_BLANK)
        if content:
            out.append(("Introduction", 0, content) if a < 0 else (heads[a][2], len(heads[a][1]), content))
    return out


class Chunk:
    """Table function: a row for each chunk of each row's ``text``."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("chunk takes a table: chunk(TABLE(t))")
        fields = [f for f in table.dataType if f.name.lower() != "text"]
        if len(fields) == len(table.dataType.fields):
            raise ValueError("the table needs a column named text")
        schema = StructType(fields).add("chunk_id", IntegerType()).add("header", StringType()).add("level", IntegerType()).add("content", StringType())
        return AnalyzeResult(schema=schema)

    def eval(self, row: Row):
        names = row.__fields__
        text = next(row[i] for i, n in enumerate(names) if n.lower() == "text")
        kept = [row[i] for i, n in enumerate(names) if n.lower() != "text"]
        for i, (header, level, content) in enumerate(cut(text) if text is not None else ()):
            yield (*kept, i, header, level, content)


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("chunk", udtf(Chunk))
    quoted = lambda s: "r'" + s + "'" if "'" not in s else 'r"' + s + '"'
    counts = {"token_count": rf"[{T.WORD}]+|[^{T.WORD}\s]", "word_count": r"\S+"}
    for name, pattern in counts.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS BIGINT RETURN regexp_count(t, {quoted(pattern)})")
