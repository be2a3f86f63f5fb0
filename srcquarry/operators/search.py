"""Exact nearest-neighbour search: filter first, then rank."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import distance_to, similarity

DIMENSIONS = 64
WORD = regex.compile(r"[\p{L}\p{N}_]+")


def check_query(text: str | None, top_k: int) -> None:
    """Raises ValueError before anything is read."""
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be at least 1")
    if not isinstance(text, str) or not text.strip():
        raise ValueError("the query text is blank")


def path_filter(path: Column, fragment: str | None) -> Column:
    """Case-sensitive substring of the absolute path; no filter for None or ''."""
    return F.contains(path, F.lit(fragment)) if fragment else F.lit(True)


def top_k(rows: DataFrame, vector: Sequence[float], *, k: int, id_: str, embedding: str, where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to a vector, with ``distance`` and ``similarity``, ties by id.

    The filter is applied before ranking. Each task keeps k rows, so the result never gathers more than
    tasks times k rows. Rows with null or zero vectors have no distance and are left out.
    """
    found = rows if where is None else rows.where(where)
    ranked = found.withColumn("distance", distance_to(F.col(embedding), vector)).where(F.col("distance").isNotNull())
    return ranked.orderBy("distance", id_).limit(k).withColumn("similarity", similarity(F.col("distance")))


def top_k_batch(queries: DataFrame, rows: DataFrame, *, k: int, id_: str, embedding: str, query_rows: int = 2_000, base_rows: int = 20_000) -> DataFrame:
    """For every query the ``k`` nearest rows: ``query_id``, ``rank``, id, ``distance`` (rounded to 9 digits).

    Queries and rows are cut into blocks by hash; every pair of blocks meets in one task as a matrix product
    that keeps k rows per query, and the partial results are merged. What meets in a task is bounded by the
    block sizes, however many queries or rows there are. Null or zero vectors take no part.
    """
    nq = max(1, -(-queries.count() // query_rows))
    nb = max(1, -(-rows.count() // base_rows))
    qb, bb = F.pmod(F.xxhash64(id_), F.lit(nq)), F.pmod(F.xxhash64(id_, F.lit(1)), F.lit(nb))
    left = queries.select(F.col(id_).alias("id"), F.col(embedding).alias("v"), qb.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bb"))
    right = rows.select(F.col(id_).alias("id"), F.col(embedding).alias("v"), bb.alias("bb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    kind = queries.schema[id_].dataType.simpleString()

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "distance": []})
        if q.empty or b.empty:
            return empty
        a, c = np.array(q.v.tolist(), dtype=float), np.array(b.v.tolist(), dtype=float)
        na, nc = np.linalg.norm(a, axis=1), np.linalg.norm(c, axis=1)
        a, qid, c, cid = a[na > 0] / na[na > 0, None], q.id.to_numpy()[na > 0], c[nc > 0] / nc[nc > 0, None], b.id.to_numpy()[nc > 0]
        if not len(a) or not len(c):
            return empty
        by_id = np.argsort(cid, kind="stable")
        c, cid = c[by_id], cid[by_id]
        d = np.round(1.0 - a @ c.T, 9)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(qid, best.shape[1]), "id": cid[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()})

    ok = F.col("v").isNotNull()
    partial = left.where(ok).groupBy("qb", "bb").cogroup(right.where(ok).groupBy("qb", "bb")).applyInPandas(meet, f"query_id {kind}, id {kind}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_), "distance")


@lru_cache(maxsize=200_000)
def word_code(word: str) -> int:
    """A number under DIMENSIONS by the word's hash."""
    return hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[0] % DIMENSIONS


def hash_embedding(text: Column) -> Column:
    """The default offline embedding: how often each word code occurs; null for null texts and texts without words.

    A batch of texts is counted at once.
    """

    def count(texts: pd.Series) -> pd.Series:
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        codes = np.fromiter((word_code(w) for words in found for w in words), dtype=np.int64, count=int(sizes.sum()))
        places = np.repeat(np.arange(len(sizes)), sizes) * DIMENSIONS + codes
        counts = np.bincount(places, minlength=len(sizes) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float32)
        return pd.Series([v if n else None for v, n in zip(counts, sizes)], dtype=object)

    return F.pandas_udf(count, T.ArrayType(T.FloatType()))(text)


def embed_one(spark: SparkSession, text: str, embed=hash_embedding) -> list[float] | None:
    """The vector of one text by the same embedding that the rows have."""
    return spark.createDataFrame([(text,)], "t string").select(embed(F.col("t")).alias("v")).first()["v"]
