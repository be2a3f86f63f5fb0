"""Differences between the files of a repository and its index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan_diff(snapshot: DataFrame, manifest: DataFrame, *, key: list[str], digest: str) -> DataFrame:
    """key, ``change``: 'A' only in the snapshot, 'M' with another digest, 'D' only in the manifest. Unchanged files give no row."""
    new = snapshot.select(*key, F.col(digest).alias("__new"), F.lit(True).alias("__in_new"))
    old = manifest.select(*key, F.col(digest).alias("__old"), F.lit(True).alias("__in_old"))
    both = new.join(old, key, "full")
    change = F.when(F.col("__in_old").isNull(), "A").when(F.col("__in_new").isNull(), "D").when(~F.col("__new").eqNullSafe(F.col("__old")), "M")
    return both.select(*key, change.alias("change")).where(F.col("change").isNotNull())


def plan_status(*, migration: Column, first: Column, parser_changed: Column, changes: Column) -> tuple[Column, Column]:
    """Status and recommended mode of a build, by precedence."""
    status = (
        F.when(migration, "migration_required")
        .when(first, "first_build")
        .when(parser_changed, "fingerprint_changed")
        .when(changes > 0, "content_changes")
        .otherwise("no_changes")
    )
    mode = F.when(migration | first | parser_changed, "full").when(changes > 0, "incremental").otherwise("skip")
    return status, mode


def fingerprints_differ(a: Column, b: Column, keys: list[str] | None = None) -> Column:
    """Whether two fingerprint maps differ, in the given keys or in any."""
    if keys is not None:
        out = F.lit(False)
        for k in keys:
            out = out | ~a[k].eqNullSafe(b[k])
        return out
    every = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.exists(every, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
