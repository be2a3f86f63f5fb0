"""Content hashes and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FILE_BYTES = 1_048_576


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def project_identity(path: Column) -> Column:
    """The last part of an absolute path ('root' for the root itself), a dash and 16 digits of the path's hash."""
    label = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.concat(F.coalesce(F.nullif(label, F.lit("")), F.lit("root")), F.lit("-"), F.substring(F.sha2(path.cast("binary"), 256), 1, 16))


def row_id(name: Column, digest: Column, ordinal: Column) -> Column:
    """The stable id of a slice: the hash of file name, file hash and number in the file, with zero bytes between."""
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.sha2(F.concat(name, zero, digest, zero, ordinal.cast("string")).cast("binary"), 256)


def within_size(text: Column, limit: int = MAX_FILE_BYTES) -> Column:
    return F.octet_length(text) <= limit
