"""Symbols of Python, Go and C++ files as chunks, with the text between them.

Python is read by the interpreter's parser; Go and C++ by a token pattern and bracket depth, which is enough
for declarations at the top level. Parsing runs in Arrow batches, one file per row.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200


class Node(NamedTuple):
    start: int
    end: int
    type: str
    name: str
    signature: str
    doc: str


_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?\*/|R\"([^()\\\s]{0,16})\(.*?\)\1\"|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)*'|^[ \t]*\#(?:[^\n\\]|\\.)*|[{}()\[\];\n]",
    re.S | re.M,
)
_GO_HEAD = re.compile(r"(func|type|const|var)\b(?:\s*\([^)]*\))?\s*(\w+)?")
_CPP_KIND = (
    (re.compile(r"template\b"), "template"), (re.compile(r"(?:typedef)\b"), "typedef"), (re.compile(r"using\b"), "using"),
    (re.compile(r"namespace\b"), "namespace"), (re.compile(r"enum\b"), "enum"), (re.compile(r"struct\b[^()]*$"), "struct"), (re.compile(r"class\b[^()]*$"), "class"),
)


#: Lines as the parser counts them: no other sign than these ends one.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def _python(text: str) -> list[Node]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError) as e:
            raise ValueError(f"syntax error: {e}") from None
        except (RecursionError, MemoryError):
            raise ValueError("syntax error: too deeply nested") from None
    lines = _LINE.findall(text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    out = []
    for n in tree.body:
        if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        first = min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1
        doc, i = [], first - 1
        while i >= 0 and (lines[i].lstrip().startswith("#") or not lines[i].strip() and not doc):
            if lines[i].strip():
                doc.insert(0, lines[i].rstrip())
            i -= 1
        body = text[starts[first] : starts[n.end_lineno]]
        kind = "class" if isinstance(n, ast.ClassDef) else "function"
        out.append(Node(starts[first], starts[first] + len(body.rstrip("\r\n")), kind, n.name, body.split("\n", 1)[0].strip(), "\n".join(doc)))
    return out


def _statements(text: str, newline_ends: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, comments before) of the top-level statements; raises ValueError where brackets do not match."""
    stack: list[str] = []
    comments: list[str] = []
    at: int | None = None
    pair = {")": "(", "]": "[", "}": "{"}
    last = 0

    def flush(end):
        nonlocal at, comments
        if at is not None and text[at:end].strip():
            yield at, end, "\n".join(comments)
        at, comments = None, []

    for m in _TOKEN.finditer(text):
        t = m[0]
        between = text[last : m.start()]
        if at is None and between.strip():
            at = last + len(between) - len(between.lstrip())
        last = m.end()
        if t[:2] in ("//", "/*"):
            if at is None:
                comments.append(t)
            continue
        if t.lstrip()[:1] == "#":
            if at is None:
                yield m.start(), m.end(), "\n".join(comments)
                comments = []
            continue
        if at is None and t != "\n":
            at = m.start()
        if t in "([{":
            stack.append(t)
        elif t in ")]}":
            if not stack or stack.pop() != pair[t]:
                raise ValueError("syntax error: brackets do not match")
            if t == "}" and not stack and not newline_ends and not re.match(r"\s*(?:;|[\w*&]+\s*(?:;|=|\[)|,|\))", text[m.end() : m.end() + 80]):
                yield from flush(m.end())
        elif t == ";" and not stack or t == "\n" and newline_ends and not stack and at is not None:
            yield from flush(m.end() if t == ";" else m.start())
    if stack:
        raise ValueError("syntax error: brackets do not match")
    if text[last:].strip() and at is None:
        at = last
    yield from flush(len(text))


def _go(text: str) -> list[Node]:
    out = []
    for start, end, doc in _statements(text, True):
        body = text[start:end]
        m = _GO_HEAD.match(body)
        if not m:
            continue
        kind = "method" if m[1] == "func" and re.match(r"func\s*\(", body) else {"func": "function"}.get(m[1], m[1])
        brace = body.find("{")
        signature = (body[:brace] if brace > 0 else body.split("\n", 1)[0]).strip()
        out.append(Node(start, end, kind, m[2] if m[1] == "func" and m[2] else "<anonymous>", signature, doc))
    return out


def _cpp(text: str) -> list[Node]:
    out = []
    for start, end, doc in _statements(text, False):
        body = text[start:end]
        if body.lstrip().startswith("#"):
            m = re.match(r"\s*#\s*define\s+(\w+)", body)
            if m:
                out.append(Node(start, end, "macro", m[1], body.strip(), doc))
            continue
        head = re.split(r"[{;]", body, maxsplit=1)[0].strip()
        kind = next((k for p, k in _CPP_KIND if p.match(head)), "function" if "(" in head.split("=")[0] else "variable")
        name = re.search(r"(~?\w+)\s*\(", head) if kind in ("function", "template") else None
        name = name or re.search(r"(?:class|struct|enum(?:\s+class)?|namespace|using)\s+(\w+)", head) or re.search(r"(\w+)\s*(?:\[[^\]]*\]\s*)*(?:=|$)", head)
        out.append(Node(start, end, kind, name[1] if name else "<anonymous>", head, doc))
    return out


#: The parsers by language: a function from a text to its nodes, in order. ``parse_files`` takes further ones.
PARSERS: dict[str, Callable[[str], list[Node]]] = {"python": _python, "go": _go, "cpp": _cpp}


def _windows(text: str, line: int, limit: int, overlap: int) -> list[tuple[str, int, int]]:
    out = []
    for i in range(0, len(text), limit - overlap if limit > overlap else limit):
        piece = text[i : i + limit]
        if piece.strip():
            first = line + text.count("\n", 0, i)
            out.append((piece, first, first + piece.count("\n")))
    return out


def _members(body: str, parent: str, line: int, limit: int, overlap: int) -> list[tuple]:
    """The members of a long class or namespace as chunks of their own, named ``Parent::child``; trifles are left out."""
    inner = body.find("{") + 1
    end = body.rfind("}")
    out = []
    for n in _cpp(re.sub(r"\b(?:public|private|protected)\s*:(?!:)", lambda m: " " * len(m[0]), body[inner:end])):
        own = body[inner + n.start : inner + n.end]
        if len(own.strip()) < 10:
            continue
        first = line + body.count("\n", 0, inner + n.start)
        kind = "member" if n.type == "variable" else n.type
        parts = [(own, first, first + own.count("\n"))] if len(own) <= limit else _windows(own, first, limit, overlap)
        signature = n.signature if len(own) <= limit else ""
        out += [(kind, f"{parent}::{n.name}", signature, b, n.doc, x, y) for b, x, y in parts]
    return out


def chunks_of(text: str, language: str, *, limit: int = LIMIT, overlap: int = OVERLAP, parser: Callable[[str], list[Node]] | None = None) -> list[tuple]:
    """(type, name, signature, body, doc, start_line, end_line) of a file: the text between symbols first, then the symbols."""
    nodes = (parser or PARSERS[language])(text)
    gaps, symbols, at = [], [], 0
    for n in [*nodes, Node(len(text), len(text), "", "", "", "")]:
        gap = text[at : n.start]
        if gap.strip():
            gaps += [("other", "", "", b, "", x, y) for b, x, y in _windows(gap, 1 + text.count("\n", 0, at), limit, overlap)]
        at = n.end
        if n.type:
            body, line = text[n.start : n.end], 1 + text.count("\n", 0, n.start)
            if len(body) <= limit:
                symbols.append((n.type, n.name, n.signature, body, n.doc, line, line + body.count("\n")))
            elif language == "cpp" and n.type in ("class", "struct", "namespace"):
                symbols += _members(body, n.name, line, limit, overlap)
            else:
                symbols += [(n.type, n.name, n.signature, b, n.doc, x, y) for b, x, y in _windows(body, line, limit, overlap)]
    return gaps + symbols


def parse_files(
    files: DataFrame,
    *,
    keep: list[str],
    text: str,
    language: str,
    on_error: str = "raise",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    parsers: dict[str, Callable[[str], list[Node]]] | None = None,
) -> DataFrame:
    """Chunks of Python, Go and C++ files: ``keep``, ``chunk_ordinal``, ``type``, ``name``, ``signature``, ``body``, ``doc``, ``start_line``, ``end_line``.

    A file that does not parse fails the job, or with ``on_error='report'`` gives one chunk of type 'syntax_error'
    with the whole text, and what is wrong as its ``doc``. Blank and null texts and other languages give none.
    Symbols longer than ``limit`` are cut into windows with ``overlap``. ``parsers`` adds languages or replaces the
    parser of one; it gives the nodes of a text, or raises ValueError.
    """
    if on_error not in ("raise", "report"):
        raise ValueError("on_error is 'raise' or 'report'")
    known = {**PARSERS, **(parsers or {})}
    src = files.where(F.col(language).isin(*known) & F.col(text).isNotNull()).select(*keep, F.col(language).alias("__lang"), F.col(text).alias("__text"))
    n = len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n])
    names = ["chunk_ordinal", "type", "name", "signature", "body", "doc", "start_line", "end_line"]
    kinds = [pa.int32(), *[pa.string()] * 5, pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, (lang, body) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())):
                try:
                    found = chunks_of(body, lang, limit=limit, overlap=overlap, parser=known[lang])
                except ValueError as e:
                    if on_error == "raise":
                        raise
                    found = [("syntax_error", "", "", body, str(e), 1, max(1, len(_LINE.findall(body))))]
                at += [i] * len(found)
                rows += [(k, *c) for k, c in enumerate(found)]
            keys = [b.column(k).take(pa.array(at, pa.int64())) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array([r[j] for r in rows], kinds[j]) for j in range(8)]], [*b.schema.names[:n], *names])

    return src.mapInArrow(run, f"{fields}, chunk_ordinal int, type string, name string, signature string, body string, doc string, start_line int, end_line int")
