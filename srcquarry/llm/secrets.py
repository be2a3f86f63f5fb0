"""Credentials in texts: where they stand, and the texts without them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .secrets_scan import Hit, scan

REDACTED = "REDACTED"
_PEM_RUN = re.compile(r"(\\[nrt])|-----(?:BEGIN|END)[A-Z0-9 ]+-----|[A-Za-z0-9+/=]{8,}")


def redact(text: str, hits: list[Hit]) -> str:
    """The text with every hit replaced; quotes, escapes, line breaks and key markers stay."""
    out, at = [], 0
    for h in hits:
        out.append(text[at : h.start])
        if h.kind == "pem":
            out.append(_PEM_RUN.sub(lambda m: m[0] if m[1] or m[0].startswith("-----") else REDACTED, text[h.start : h.end]))
        elif h.kind != "more":
            out.append(REDACTED)
        at = h.end
    out.append(text[at:])
    return "".join(out)


def find_credentials(texts: DataFrame, *, key: list[str], text: str, language: str) -> DataFrame:
    """One row per text that holds credentials: key, ``hits``, ``redacted_text``.

    ``hits`` is an array of ``line_no`` (1-based, lines end with \\n; the line of the value's first
    character), ``start``, ``end`` (code points) and ``kind``. A value joined from several literals or
    lines is one hit. Encoded literals are opened and redacted whole. Texts that are null, empty or
    without credentials give no row; very long texts are read whole; a null ``language`` is treated as
    prose; repeated rows repeat their result; an empty table gives none. Only the named columns are read.
    """
    src = texts.select(*[F.col(k) for k in key], F.col(language).alias("__lang"), F.col(text).alias("__text")).where(F.length("__text") > 3)
    n = len(key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n])
    hit_type = pa.list_(pa.struct([("line_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, clean = [], [], []
            for i, (lang, body) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())):
                hits = scan(body, lang)
                if not hits:
                    continue
                at.append(i)
                clean.append(redact(body, hits))
                rows, line, before = [], 1, 0
                for j, h in enumerate(hits):
                    if h.kind == "more":
                        rows[-1]["end"] = h.end
                        continue
                    line += body.count("\n", before, h.start)
                    before = h.start
                    rows.append({"line_no": line, "start": h.start, "end": h.end, "kind": h.kind})
                found.append(rows)
            keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(found, hit_type), pa.array(clean, pa.string())], [*batch.schema.names[:n], "hits", "redacted_text"]
            )

    return src.mapInArrow(
        run, f"{fields}, hits array<struct<line_no:int,start:int,end:int,kind:string>>, redacted_text string"
    )
