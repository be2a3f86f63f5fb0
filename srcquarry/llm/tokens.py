"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (byte-level BPE ranks); a parameter of every operator, never copied into the repository.
DEFAULT_VOCABULARY = os.environ.get("SRCQUARRY_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Texts longer than this are encoded span by span.
MAX_CALL = 20_000
# Fixed value: the published word pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places where the pattern starts a new word whatever stands around them, the last one first: white space behind
#: other text, and changes between letters, digits and other signs, but not behind other signs (contractions).
_START = regex.compile(r"(?r)(?<=\S)(?=[ \n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])")


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str = PATTERN):
    """The encoding of a vocabulary file, built once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def spans(text: str) -> Iterator[str]:
    """The text in spans that have together the tokens of the whole: each starts where the pattern starts a word.

    Spans have about MAX_CALL characters; a longer word is one span.
    """
    at, n, look = 0, len(text), MAX_CALL
    while n - at > look:
        m = _START.search(text, at + 1, at + look)
        if m is None or m.start() <= at:
            look *= 2
            continue
        yield text[at : m.start()]
        at, look = m.start(), MAX_CALL
    if at < n:
        yield text[at:]


def count(text: str | None, path: str) -> int:
    """Tokens of a text; 0 for null."""
    if not text:
        return 0
    encode = tokenizer(path).encode_ordinary
    if len(text) <= MAX_CALL:
        return len(encode(text))
    return sum(len(encode(s)) for s in spans(text))


def cut_to(text: str, limit: int, path: str) -> list[tuple[str, int]]:
    """The text in parts of at most ``limit`` tokens each, with their counts; joined they are the text.

    Parts end at a line break or space in their second half where there is one, and between characters
    otherwise. The count of a part is that of its own text.
    """
    n = count(text, path)
    if n <= limit:
        return [(text, n)]
    encoding = tokenizer(path)
    parts: list[tuple[str, int]] = []
    at, window = 0, 6 * limit
    while at < len(text):
        ids = encoding.encode_ordinary(text[at : at + window])
        if len(ids) <= limit and at + window < len(text):
            window *= 2
            continue
        if len(ids) <= limit:
            parts.append((text[at:], len(ids)))
            break
        end = at + len(encoding.decode_bytes(ids[:limit]).decode("utf-8", "ignore"))
        soft = max(text.rfind("\n", at + (end - at) // 2, end), text.rfind(" ", at + (end - at) // 2, end))
        end = soft if soft > at else max(end, at + 1)
        while end > at + 1 and (n := count(text[at:end], path)) > limit:
            end = max(at + 1, end - max(1, n - limit))
        parts.append((text[at:end], count(text[at:end], path)))
        at, window = end, 6 * limit
    return parts


def with_token_counts(items: DataFrame, *, keep: list[str], text: str, path: str = DEFAULT_VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the token count of ``text`` (0 for null); texts do not leave the task."""
    src = items.select(*[F.col(k) for k in keep], F.col(text).alias("__text"))
    n = len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pa.array([count(t, path) for t in b.column(n).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], counts], [*b.schema.names[:n], name])

    return src.mapInArrow(run, f"{fields}, `{name}` bigint" if fields else f"`{name}` bigint")
