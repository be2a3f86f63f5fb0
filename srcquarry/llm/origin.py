"""Generated, minified, vendored and data files among source files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut
from .layout import bundled, looks, shingles
from .validity import valid_in

#: Share of shingles of five words (Jaccard) from which a file is a copy of a known file.
COPY_SIMILARITY = 0.8
#: Known files up to these bounds are sent to all tasks; above, files are joined to them by shingles.
MAX_KNOWN_FILES = 2_000
MAX_KNOWN_CHARS = 16_000_000


def _copy_of(own: set, every: set, known: list[tuple[str, set]]) -> str | None:
    common = own & every
    if len(common) < COPY_SIMILARITY * len(own) / 2:
        return None
    best = max(((len(own & k) / len(own | k), name) for name, k in known), default=(0.0, None))
    return best[1] if best[0] >= COPY_SIMILARITY else None


def _hash64(shingle: tuple[str, ...]) -> int:
    """The same on every executor, unlike the interpreter's own hash."""
    return int.from_bytes(hashlib.blake2b("\0".join(shingle).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _copies_by_join(files: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """``digest`` and ``copy_of`` of the texts that are copies of a known one, by a join on shingle hashes; both sides may be large.

    Texts are told apart by their SHA-256, known files by name and SHA-256. Only the rarest hashes of a text are
    joined, which is exact: two texts that share the needed part of their hashes share one of these. Shingles of a
    licence in every file are the last to be among them.
    """

    def hashes(df: DataFrame, name: Column, body: str) -> DataFrame:
        def run(batches):
            for b in batches:
                sets = [sorted({_hash64(s) for s in shingles(t)}) if t else [] for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int64()))], ["name", "digest", "hs"])

        rows = df.select(name.alias("name"), F.sha2(F.col(body), 256).alias("digest"), F.col(body).alias("t")).where(F.col("t").isNotNull())
        return rows.dropDuplicates(["name", "digest"]).mapInArrow(run, "name string, digest string, hs array<bigint>")

    a, k = hashes(files, F.lit(""), text), hashes(known, F.coalesce("name", F.lit("")), "content")
    a, k = cut(a.select("digest", "hs").where(F.size("hs") > 0)), cut(k.select("name", F.col("digest").alias("known"), "hs").where(F.size("hs") > 0))
    frequency = k.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("f"))

    def rarest(df: DataFrame, id_: list[str]) -> DataFrame:
        """The hashes of each text that must hold one of any copy's: the rarest ones, as many as a copy may lack, and one more."""
        w = Window.partitionBy(*id_).orderBy(F.coalesce("f", F.lit(0)), "h")
        rows = df.select(*id_, F.size("hs").alias("n"), F.explode("hs").alias("h")).join(frequency, "h", "left").withColumn("r", F.row_number().over(w))
        return rows.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * COPY_SIMILARITY) + 1) & F.col("f").isNotNull()).select(*id_, "h")

    near = rarest(a, ["digest"]).join(rarest(k, ["name", "known"]), "h").select("digest", "name", "known").distinct()
    sets = near.join(a, "digest").join(k.withColumnRenamed("hs", "ks"), ["name", "known"])
    common = F.size(F.array_intersect("hs", "ks"))
    alike = sets.select("digest", "name", (common / (F.size("hs") + F.size("ks") - common)).alias("alike")).where(F.col("alike") >= COPY_SIMILARITY)
    return alike.groupBy("digest").agg(F.max(F.struct("alike", "name"))["name"].alias("copy_of"))


def classify_origin(files: DataFrame, known: DataFrame, *, key: str, path: str, text: str, language: str) -> DataFrame:
    """One row per row of ``files``: key, ``origin`` and ``copy_of``.

    ``origin`` is 'hand-written', 'generated', 'minified', 'vendored' or 'data'. A file in a directory
    for bundled code, with the text of a known file (``known``: name, content; similarity of five-word
    shingles 0.8 or more) or with a head comment that says so is vendored. Otherwise the file is lexed
    and written in canonical form: extreme expansion marks minified files, uniform numbered
    declarations generated ones, dominance of literal data blobs. A file that is not valid in its
    language counts as hand-written, whatever it looks like; null and blank texts do too.

    ``known`` is sent to all tasks while it is within MAX_KNOWN_FILES and MAX_KNOWN_CHARS; beyond, files
    are joined to it by shingle hashes, with the same result; ``copy_of`` is the most similar file, the last name
    of equals, and empty for one without a name. Repeated rows are classified each; an empty table gives none;
    null paths and languages are allowed. Only the named columns are read.
    """
    bound = known.agg(F.count("*").alias("n"), F.sum(F.char_length("content")).alias("c")).first()
    small = bound["n"] <= MAX_KNOWN_FILES and (bound["c"] or 0) <= MAX_KNOWN_CHARS
    rows = [(r["name"] or "", r["content"]) for r in known.select("name", "content").collect()] if small else []
    src = files.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(language).alias("l"), F.col(text).alias("t"), F.sha2(F.col(text), 256).alias("d"))
    key_type = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [(name, s) for name, body in rows if body and (s := shingles(body))]
        every = set().union(*(s for _, s in sets)) if sets else set()
        for batch in batches:
            origins, copies = [], []
            for p, lang, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                origin, copy = None, None
                if body and body.strip():
                    if bundled(p):
                        origin = "bundled"
                    else:
                        own = shingles(body)
                        copy = _copy_of(own, every, sets) if own and sets else None
                        origin = "vendored" if copy is not None else looks(body, lang)
                    if (origin or not small) and valid_in(body, lang) is False:
                        origin, copy = "invalid", None
                origins.append(origin or "hand-written")
                copies.append(copy)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(origins, pa.string()), pa.array(copies, pa.string()), batch.column(4)], ["k", "origin", "copy_of", "d"])

    out = src.mapInArrow(run, f"k {key_type}, origin string, copy_of string, d string")
    if not small:
        joined = _copies_by_join(files, known, text).withColumnRenamed("copy_of", "joined_copy")
        copied = F.col("joined_copy").isNotNull() & ~F.col("origin").isin("invalid", "bundled")
        out = out.join(joined, F.col("d") == F.col("digest"), "left").select(
            "k", F.when(copied, "vendored").otherwise(F.col("origin")).alias("origin"), F.when(copied, F.col("joined_copy")).alias("copy_of")
        )
    origin = F.when(F.col("origin") == "invalid", "hand-written").when(F.col("origin") == "bundled", "vendored").otherwise(F.col("origin"))
    return out.select(F.col("k").alias(key), origin.alias("origin"), "copy_of")
