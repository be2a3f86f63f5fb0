"""Planning, building and searching an index of one repository.

Every build is a new immutable generation of two Parquet tables, ``rows`` and ``files``; it becomes visible by
one atomic replacement of the manifest. Files whose content is unchanged keep their rows and vectors.
"""

from __future__ import annotations

import contextlib
import hashlib
import inspect
import os
import platform
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import routing
from ..functions import text as text_functions
from ..functions.identity import row_id
from ..functions.tokenizers import bpe_counter
from ..operators import code, markdown, packing
from ..operators.code import parse_files
from ..operators.diff import plan_diff
from ..operators.markdown import sections
from ..operators.packing import pack_long
from ..operators.search import check_query, embed_one, hash_embedding, path_filter, top_k
from ..operators.slicing import SPECIAL, check_budget, prepare
from ..sources.repository import repository_files
from ..tables import cut
from . import store

@lru_cache(maxsize=1)
def parser_fingerprint() -> str:
    """A hash of the code that makes chunks of files, and of the version of the interpreter whose parser it uses."""
    digest = hashlib.sha256(platform.python_version().encode())
    for module in (code, markdown, packing, routing, text_functions):
        digest.update(inspect.getsource(module).encode())
    return digest.hexdigest()


def fingerprint(max_tokens: int, embedding: str, tokenizer: str | None = None) -> dict[str, str]:
    """What must agree between the builds of an index, and between an index and its queries."""
    chunker = f"chars-{max_tokens}"
    if tokenizer:
        with open(tokenizer, "rb") as f:
            chunker = f"tokens-{max_tokens}-{hashlib.sha256(f.read()).hexdigest()}"
    return {"parser": parser_fingerprint(), "chunker": chunker, "embedding": embedding}


def file_chunks(files: DataFrame) -> DataFrame:
    """Parser output of files (relative_path, file_path, language, sha256, text) of all languages."""
    keep = ["relative_path", "file_path", "language", "sha256"]
    symbols = parse_files(files, keep=keep, text="text", language="language")
    notes = files.where(F.col("language") == "markdown")
    cut = sections(notes, key="relative_path", text="text", name=F.element_at(F.split("relative_path", "/"), -1))
    packed = pack_long(cut, keep=["relative_path", "title", "heading_path"], text="body", first_line="start_line")
    ordinal = F.row_number().over(_by_file("relative_path", "start_line", "part")) - 1
    notes_chunks = packed.withColumn("chunk_ordinal", ordinal.cast("int")).join(notes.select(*keep), "relative_path").select(
        *keep,
        "chunk_ordinal",
        F.lit("document_section").alias("type"),
        F.when(F.col("part") > 0, F.concat("title", F.lit(" part "), "part")).otherwise(F.col("title")).alias("name"),
        F.col("heading_path").alias("signature"),
        "body",
        F.lit("").alias("doc"),
        "start_line",
        "end_line",
    )
    return symbols.unionByName(notes_chunks)


def _by_file(path: str, *order: str):
    return Window.partitionBy(path).orderBy(*order)


def index_rows(chunks: DataFrame, embed: Callable[[Column], Column], max_tokens: int, tokenizer: str | None = None) -> DataFrame:
    """Stored rows of chunks: slices with ids that are stable across builds, and vectors."""
    prepared = prepare(chunks, max_tokens=max_tokens, make_counter=bpe_counter(tokenizer) if tokenizer else None)
    order = _by_file("relative_path", "chunk_ordinal", "source_field", "char_start")
    numbered = prepared.withColumn("slice_no", (F.row_number().over(order) - 1).cast("int")).drop("chunk_ordinal").withColumnRenamed("slice_no", "chunk_ordinal")
    return numbered.withColumnRenamed("sha256", "file_sha256").withColumn("id", row_id(F.col("relative_path"), F.col("file_sha256"), F.col("chunk_ordinal"))).withColumn(
        "embedding", embed(F.col("document"))
    )


def _tables(db: str, collection: str) -> tuple[str, str]:
    base = os.path.join(db, "generations", collection)
    return os.path.join(base, "rows"), os.path.join(base, "files")


def _manifest_files(spark: SparkSession, db: str, manifest: dict | None) -> DataFrame:
    if manifest is None:
        return spark.createDataFrame([], "relative_path string, sha256 string, chunks bigint")
    return spark.read.parquet(_tables(db, manifest["collection"])[1])


def plan(spark: SparkSession, repo: str, db: str) -> dict:
    """What a build would do; reads sources and manifest only.

    ``changed_files`` is a table (``relative_path``, ``change``), ``changes`` counts it; the list of files does not
    pass through the driver.
    """
    repo = os.path.abspath(repo)
    if not os.path.isdir(repo):
        raise ValueError("no such repository")
    store.validate_location(db, repo)
    with store.operation_lock(db, create=False):
        store.validate_owner(db, repo)
        manifest = store.active_index(db)
        pending = store.read_json(os.path.join(db, store.PENDING)) is not None
        files = repository_files(spark, repo).select("relative_path", "sha256")
        changed_files = plan_diff(files, _manifest_files(spark, db, manifest), key=["relative_path"], digest="sha256")
        changes = {r["change"]: r["count"] for r in changed_files.groupBy("change").count().collect()}
        foreign = manifest is None and store.holds_other_data(db)
        parser_changed = manifest is not None and manifest["fingerprint"].get("parser") != parser_fingerprint()
        status = "migration_required" if foreign else "first_build" if manifest is None else "fingerprint_changed" if parser_changed else "content_changes" if changes else "no_changes"
        return {
            "repo_dir": repo,
            "db_path": os.path.abspath(db),
            "status": status,
            "recommended_mode": "full" if manifest is None or parser_changed else "incremental" if changes else "skip",
            "changes": changes,
            "changed_files": changed_files,
            "file_count": files.count(),
            "pending_build": pending,
            "active_collection": manifest["collection"] if manifest else None,
            "note": "Compared by content; chunker and embedding are compared when the index is built.",
        }


def build(
    spark: SparkSession,
    repo: str,
    db: str,
    *,
    full: bool = False,
    max_tokens: int = 256,
    embed: Callable[[Column], Column] = hash_embedding,
    embedding: str = "hash-64",
    tokenizer: str | None = None,
) -> dict:
    """Build or update the index. A failure leaves the active generation as it was.

    ``max_tokens`` counts characters, or tokens of the ``tokenizer`` file. ``embedding`` names what ``embed`` does.
    """
    check_budget(max_tokens)
    repo = os.path.abspath(repo)
    store.validate_location(db, repo)
    with store.operation_lock(db, create=True):
        store.validate_owner(db, repo)
        manifest = store.active_index(db)
        now = fingerprint(max_tokens, embedding, tokenizer)
        if manifest is None and not full and store.holds_other_data(db):
            raise ValueError("the folder holds data of another kind: a full build is needed")
        if manifest is not None and manifest["fingerprint"] != now and not full:
            raise ValueError("parser, chunker or embedding changed: a full build is needed")
        files = repository_files(spark, repo)
        seen = cut(files.select("relative_path", "sha256"))
        n_files = seen.count()
        old_files = _manifest_files(spark, db, manifest)
        diff = plan_diff(seen, old_files, key=["relative_path"], digest="sha256")
        counts = {r[0]: r[1] for r in diff.groupBy("change").count().collect()}
        if manifest is not None:
            rows_path = _tables(db, manifest["collection"])[0]
            if spark.read.parquet(rows_path).count() != manifest["chunks"]:
                raise RuntimeError("the active generation does not have the rows its manifest names")
            if not full and not counts:
                return {"mode": "skip", "reason": "content_unchanged", "collection_count": manifest["chunks"], "collection_name": manifest["collection"]}
        collection = f"gen_{uuid.uuid4().hex}"
        store.atomic_json(os.path.join(db, store.PENDING), {"repo_dir": repo, "schema": store.SCHEMA, "collection": collection, "status": "building"})
        reuse = manifest is not None and not full
        todo = files.join(diff.where("change <> 'D'").select("relative_path"), "relative_path", "left_semi") if reuse else files
        rows = index_rows(file_chunks(todo), embed, max_tokens, tokenizer)
        kept = None
        if reuse:
            unchanged = seen.select("relative_path", F.col("sha256").alias("file_sha256"))
            kept = spark.read.parquet(rows_path).join(unchanged, ["relative_path", "file_sha256"], "left_semi")
            held = kept.groupBy("relative_path").agg(F.count("*").alias("held"))
            same = old_files.join(seen, ["relative_path", "sha256"], "left_semi").join(held, "relative_path", "left")
            if not same.where(F.coalesce("held", F.lit(0)) != F.col("chunks")).isEmpty():
                raise RuntimeError("an unchanged file does not have the rows its manifest names")
            rows = rows.unionByName(kept)
        rows_out, files_out = _tables(db, collection)
        rows.write.parquet(rows_out)
        stored = spark.read.parquet(rows_out)
        chunks = stored.groupBy("relative_path").agg(F.count("*").alias("chunks"))
        seen.join(chunks, "relative_path", "left").select("relative_path", "sha256", F.coalesce("chunks", F.lit(0)).alias("chunks")).write.parquet(files_out)
        total = stored.agg(F.count("*"), F.count_distinct("id")).first()
        again = repository_files(spark, repo).select("relative_path", "sha256")
        if not plan_diff(again, seen, key=["relative_path"], digest="sha256").isEmpty():
            raise RuntimeError("the sources changed during the build")
        if total[0] != total[1] or total[0] != (spark.read.parquet(files_out).agg(F.sum("chunks")).first()[0] or 0):
            raise RuntimeError("the new generation is not consistent")
        store.atomic_json(
            os.path.join(db, store.ACTIVE),
            {"schema": store.SCHEMA, "repo_dir": repo, "collection": collection, "fingerprint": now, "chunks": total[0]},
        )
        with contextlib.suppress(OSError):
            os.unlink(os.path.join(db, store.PENDING))
        parsed = counts.get("A", 0) + counts.get("M", 0) if reuse else n_files
        return {
            "mode": "incremental" if reuse else "full",
            "parsed_files": parsed,
            "reused_files": n_files - parsed,
            "deleted_files": counts.get("D", 0),
            "collection_count": total[0],
            "collection_name": collection,
        }


def query(
    spark: SparkSession,
    db: str,
    text: str,
    *,
    k: int = 5,
    path: str | None = None,
    repo: str | None = None,
    max_tokens: int = 256,
    embed: Callable[[Column], Column] = hash_embedding,
    embedding: str = "hash-64",
    tokenizer: str | None = None,
) -> DataFrame:
    """The ``k`` stored rows nearest to a text, with ``distance`` and ``similarity``; input is checked before anything is opened.

    An index that was built with another chunker or embedding is an error.
    """
    check_query(text, k)
    if (bpe_counter(tokenizer)()(text) if tokenizer else len(text) + SPECIAL) > max_tokens:
        raise ValueError("the query text is over the token budget")
    with store.operation_lock(db, create=False):
        if repo is not None:
            store.validate_owner(db, os.path.abspath(repo))
        manifest = store.active_index(db)
        if manifest is None:
            raise ValueError("there is no index")
        now = fingerprint(max_tokens, embedding, tokenizer)
        if any(manifest["fingerprint"].get(part) != now[part] for part in ("chunker", "embedding")):
            raise RuntimeError("the index was built with another chunker or embedding: use these, or build it anew")
        rows = spark.read.parquet(_tables(db, manifest["collection"])[0])
        if rows.count() != manifest["chunks"]:
            raise RuntimeError("the active generation does not have the rows its manifest names")
        vector = embed_one(spark, text, embed)
        where = path_filter(F.col("file_path"), path) if vector else F.lit(False)
        return top_k(rows, vector or [1.0], k=k, id_="id", embedding="embedding", where=where).drop("embedding")
