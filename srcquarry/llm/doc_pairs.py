"""Functions paired with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .islands import documented_pairs


def doc_pairs(chunks: DataFrame, *, key: str, language: str, body: str, doc: str) -> DataFrame:
    """One row per documented function: key, ``fn_name``, ``signature``, ``doc``, ``code``.

    ``body`` is the source text of a chunk and ``doc`` the comments before it (null or empty: none).
    Functions with no or trivial documentation give no row, nor do rows with a null body or a
    language other than python, go and cpp. Repeated rows repeat their pairs; an empty table gives
    none. Only the named columns are read. ``signature`` ends with the colon or before the brace of the body, ``code`` is the
    function from its signature to the end of its body. Rows in which no comment or string can document a function
    are dropped before anything is sent to Python.
    """
    src = chunks.select(
        F.col(key).alias("key"), F.col(language).alias("language"), F.col(body).alias("body"), F.col(doc).alias("doc")
    ).where(F.col("language").isin("python", "go", "cpp") & (F.length("body") > 0))
    marks = (
        F.when(F.col("language") == "python", F.col("body").rlike("[\"'#]"))
        .when(F.col("language") == "go", F.col("body").rlike(r"(//[^\n]*|\*/)\s*func\b"))
        .otherwise(F.col("body").rlike("/[/*]") & F.col("body").rlike(r"\b(class|struct|union|namespace|extern)\b|[};]\s*/[/*]|\A\s*/[/*]"))
    )
    src = src.where((F.length("doc") > 0) | F.coalesce(marks, F.lit(False)))
    key_type = src.schema["key"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, langs, bodies, docs = (batch.column(i) for i in range(4))
            at, rows = [], []
            for i, (lang, text, comment) in enumerate(zip(langs.to_pylist(), bodies.to_pylist(), docs.to_pylist())):
                for pair in documented_pairs(lang, text, comment):
                    at.append(i)
                    rows.append(pair)
            columns = [pa.array([r[j] for r in rows], pa.string()) for j in range(4)]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), *columns], ["key", "fn_name", "signature", "doc", "code"]
            )

    out = src.mapInArrow(extract, f"key {key_type}, fn_name string, signature string, doc string, code string")
    return out.select(F.col("key").alias(key), "fn_name", "signature", "doc", "code")
