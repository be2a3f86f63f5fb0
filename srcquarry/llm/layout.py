"""Layout of source files: lexing, canonical form, and what the difference to the original tells."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

# Directory names that hold bundled third-party code, and head comments that tell the origin of a file.
BUNDLED_DIRS = frozenset(
    "vendor vendors vendored _vendor _vendored third_party third-party thirdparty third_parties _third_party 3rdparty 3rd_party 3rd-party external externals extern externs "
    "deps _deps node_modules bower_components web_modules jspm_packages godeps bundled bundles submodules subprojects pods carthage site-packages dist-packages".split()
)
GENERATED_HEAD = re.compile(
    r"(?i)^\W*(?:code generated\b|generated (?:by|from|with|code|file)\b|(?:<|@)?auto-?_?generated\b|@generated\b|autogenerated\b|automatically generated\b"
    r"|this (?:file|code|module) (?:was|is|has been) (?:\w+ly )?(?:auto-?)?(?:generated|produced|emitted|written by|created by)\b"
    r"|machine[- ](?:written|generated)\b|do not (?:edit|modify)\b|automatisch (?:erzeugt|generiert)\b|(?:archivo |código )?generado (?:por|automáticamente)\b|(?:fichier |code )?généré (?:par|automatiquement)\b"
    r"|(?:本文件|此文件|该文件).*(?:自动)?生成|自动生成)"
)
THIRD_PARTY_HEAD = re.compile(
    r"(?i)^\W*(?:vendored (?:from|copy)\b|bundled (?:from\b|copy\b|[\w.-]+ (?:source|copy|code)\b)|(?:imported|copied|taken|adapted) from the [\w.-]+ (?:project|library|package)\b"
    r"|this (?:file )?is a (?:third[- ]party|vendored|verbatim|bundled) copy\b|third[- ]party copy\b|embedded copy of\b)"
)
NOT_GENERATED = re.compile(r"(?i)\bnot (?:auto-?)?generated\b|\bby hand\b(?!: run)|hand-?written")

_SKIP = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\#[^\n]*"
    r'|[rRbBuUfFL]{0,2}(?:"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')|`[^`]*`|[rRbBuUfFL]{0,2}(?:"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')',
    re.S,
)
_NUMBER = re.compile(r"\b\d[\w.]*")
_NAME = re.compile(r"[^\W\d]\w*")
_DIGITS = re.compile(r"\d+")
_FOR = re.compile(r"\bfor\s*\([^){}]*;[^){}]*;")
_LOGIC = re.compile(r"\b(?:def|func|return|import|class|for|if|lambda|while|switch)\b|^[ \t]*#[ \t]*include", re.M)
_HEAD_END = re.compile(r"\s*(?://|#(?!\s*(?:include|pragma|define|if|ifdef|ifndef|undef|line)\b)|/\*|\*|<!--|\"\"\"|\'\'\'|;|--)")
_KEYWORDS = frozenset(
    "def class func type struct interface const var static inline constexpr int long void bool auto return import from package if for while switch template public private async int32 int64 string byte map range enum namespace lambda".split()
)
_SPACE = re.compile(r"[ \t]+")
_INNER_SPACE = re.compile(r"(?<=[^\s])[ \t]+")
_BREAK = re.compile(r" ?([{;}]) ?\n?")
_BROKEN = {"{": " {\n", ";": ";\n", "}": "\n}\n"}
_JOINED = re.compile(r"(?<=[^\s;{}\x0f])[ \t]*\n[ \t]*(?!#)")
_DIRECTIVE = re.compile(r"^[ \t]*#[^\n]*", re.M)
_GO_ON = re.compile(r"(?<=[(\[,.+\-*/%&|^<>=!:])[ \t]*\n[ \t]*|(?<=[A-Za-z0-9_)\]}\"])[ \t]*\n[ \t]*(?=[)\]])")
# Brackets and colons that are done with, while the ones around them are looked for.
_HIDE = str.maketrans("()[]{}:;", "\x03\x04\x05\x06\x07\x08\x0e\x02")
_SHOW = {b: a for a, b in _HIDE.items()}
_PY_OPEN = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
_BLOCK = re.compile(r"((?:async )?(?:def|if|elif|for|while|class|else|try|with|except|finally)\b[^\n]*?:)[ \t]+(?=[^\s#])")

#: Canonical lines per original line from which a file is minified, and the line length that goes with it.
MINIFIED_EXPANSION = 1.6
MINIFIED_WIDTH = 140
#: Share of the code's characters in literal data from which a file without functions is a data blob.
DATA_SHARE = 0.85
#: Share of the declarations in one of the two commonest forms from which a file is generated.
UNIFORM_SHARE = 0.9
UNIFORM_LEAST = 6
#: Share of these that must count on, which tells the output of a loop from a list of settings.
COUNTED_SHARE = 0.6


class Layout(NamedTuple):
    lines: int
    canonical_lines: int
    same_lines: int
    width: float
    data_share: float
    uniform_share: float
    counted_share: float
    declarations: int
    logic: bool


def head_comment(text: str) -> list[str]:
    """The lines of comment at the start of a file, before any code."""
    found = []
    for m in re.finditer(r"[^\r\n]+", text):
        line = m[0]
        s = line.strip()
        if not s:
            continue
        if not _HEAD_END.match(line):
            if found and found[-1].startswith(("/*", '"""', "'''")) and "*/" not in found[-1]:
                found.append(s)
                continue
            break
        found.append(s)
    return found


def bundled(path: str | None) -> bool:
    """Whether a directory of the path is one for bundled code."""
    return any(part.lower() in BUNDLED_DIRS for part in (path or "").split("/")[:-1])


def canonical(code: str, language: str | None) -> list[tuple[int, str]]:
    """The lines of lexed code written anew: (depth, statement), blanks reduced to single ones.

    Python: one statement a line, brackets closed on their line, bodies below the colon, depth by indentation.
    Other languages: a line ends at a semicolon outside the head of a loop and at braces, in Go also where a
    statement ends with its line; depth by braces. Preprocessor lines stay lines.
    """
    rows: list[tuple[int, str]] = []
    if language == "python":
        pad, n = code, 1
        while n:  # brackets from the inside out: their line breaks become blanks
            pad, n = _PY_OPEN.subn(lambda m: m[0].replace("\n", " ").translate(_HIDE), pad)
        levels = [0]
        for line in _INNER_SPACE.sub(" ", pad).split("\n"):
            text = line.strip()
            if not text:
                continue
            indent = len(line) - len(line.lstrip())
            while indent < levels[-1]:
                levels.pop()
            if indent > levels[-1]:
                levels.append(indent)
            depth = len(levels) - 1
            if ":" not in text[:-1] and ";" not in text:
                rows.append((depth, text))
                continue
            for part in text.split(";"):
                while m := _BLOCK.match(part.strip()):
                    rows.append((depth, m[1]))
                    part, depth = part.strip()[m.end() :], depth + 1
                if part.strip():
                    rows.append((depth, part.strip()))
        return list(zip([depth for depth, _ in rows], "\n".join([row for _, row in rows]).translate(_SHOW).split("\n"))) if rows else []
    flat = _DIRECTIVE.sub(lambda m: m[0].translate(_HIDE) + "\x0f", code) if "#" in code else code
    flat = _FOR.sub(lambda m: m[0].replace(";", "\x02"), flat)
    flat = (_GO_ON if language == "go" else _JOINED).sub(" ", flat)
    depth = 0
    broken = _BREAK.sub(lambda m: _BROKEN[m[1]], _SPACE.sub(" ", flat))
    for line in broken.split("\n"):
        text = line.strip()
        if not text:
            continue
        if text == "}":
            depth = max(0, depth - 1)
        rows.append((depth, text))
        if text[-1] == "{":
            depth += 1
    if "\x02" not in flat and "\x0f" not in flat:
        return rows
    return [(depth, row.translate(_SHOW).rstrip("\x0f")) for depth, row in rows]


def layout(text: str, language: str | None) -> Layout:
    """Lex a file, write it anew in canonical form, and measure the original against that.

    ``same_lines`` of the original stand in the canonical form as they are, ``canonical_lines`` against ``lines``
    is how far the file expands. A declaration is a canonical line at depth 0 with all deeper lines that follow.
    Declarations have the same form if they differ in names and numbers only and if their originals have the same
    layout; ``uniform_share`` is that of the two commonest forms, ``counted_share`` the share of declarations of
    these forms whose numbers or numbered names count on from those of the one before. Literal data are numbers
    and long string literals without words.
    """
    data = 0

    def lex(m: re.Match) -> str:
        nonlocal data
        t = m[0]
        c = t[0]
        if c == "#":
            return t if language != "python" and re.match(r"#[ \t]*(?:include|define|pragma|if|el|end|undef|error|line)", t) else ""
        if c == "/":
            return "\n" if "\n" in t else ""
        n = len(t)
        if n > 24 and (" " not in t.strip("\"'`") or n > 400 and t.count(" ") < n / 30):
            data += n
            return '"' + "\x01" * (n - 2) + '"'
        return '""'

    code = _SKIP.sub(lex, text.replace("\r", ""))
    original = [r.strip() for r in _SPACE.sub(" ", code).split("\n") if r and not r.isspace()]
    rows = canonical(code, language)
    there = {row for _, row in rows}
    same = sum([row in there for row in original])
    size = len(code) - code.count(" ") - code.count("\t") - code.count("\n")
    digits = sum(map(len, _NUMBER.findall(code)))
    if digits * 3 > size:  # in tables, separators belong to the data
        digits += code.count(",")
    uniform, counted, n = _uniformity(rows)
    width = (len(text) - text.count(" ")) / max(1, len(original))
    return Layout(len(original), len(rows), same, width, min(1.0, (data + digits) / size) if size else 0.0, uniform, counted, n, _LOGIC.search(code) is not None)


def _uniformity(rows: list[tuple[int, str]]) -> tuple[float, float, int]:
    """Share of the declarations in the two commonest forms, share of these that count on, and number of declarations."""
    starts = [i for i, (depth, row) in enumerate(rows) if depth == 0 and row != "}" and not row.startswith(("import", "from ", "package", "#"))]
    if len(starts) < UNIFORM_LEAST:
        return 0.0, 0.0, len(starts)
    heads = Counter(_form(rows[i][1]) for i in starts)
    if sum(v for _, v in heads.most_common(2)) < UNIFORM_SHARE * len(starts):
        return 0.0, 0.0, len(starts)
    forms: Counter[str] = Counter()
    counts: dict[str, list[int]] = {}
    for i, j in zip(starts, [*starts[1:], len(rows)]):
        form = "\n".join(f"{depth} {_form(row)}" for depth, row in rows[i:j])
        forms[form] += 1
        number = _DIGITS.findall(rows[i][1].split("=")[0])
        counts.setdefault(form, []).append(int(number[-1][-9:]) if number else -1)
    best = [f for f, _ in forms.most_common(2)]
    steps = [0 <= b - a <= 4 for f in best for a, b in zip(counts[f], counts[f][1:]) if b >= 0 and a >= 0]
    whole = sum(max(0, len(counts[f]) - 1) for f in best)
    return sum(forms[f] for f in best) / len(starts), sum(steps) / whole if whole else 0.0, len(starts)


def _form(row: str) -> str:
    return _NAME.sub(lambda m: m[0] if m[0] in _KEYWORDS else "a", _NUMBER.sub("0", row))


def shingles(text: str, size: int = 5) -> set[tuple[str, ...]]:
    """The sets of ``size`` words in a row, words being what white space separates: layout does not count."""
    t = text.split()
    return set(zip(*[t[i:] for i in range(size)])) if len(t) >= size else {tuple(t)} if t else set()


def looks(text: str, language: str | None) -> str | None:
    """'generated', 'vendored', 'minified' or 'data' by head comment and layout, or None for hand-written text."""
    for line in head_comment(text):
        if NOT_GENERATED.search(line) and not re.search(r"(?i)do not edit by hand", line):
            continue
        if GENERATED_HEAD.match(line):
            return "generated"
        if THIRD_PARTY_HEAD.match(line):
            return "vendored"
    if language == "markdown":
        return None
    f = layout(text, language)
    if f.data_share >= DATA_SHARE and not f.logic and len(text) >= 120:
        return "data"
    expansion = f.canonical_lines / max(1, f.lines)
    if f.canonical_lines >= 8 and (expansion >= 6 or expansion >= MINIFIED_EXPANSION and (f.width >= MINIFIED_WIDTH or language == "python")):
        return "minified"
    if f.uniform_share >= UNIFORM_SHARE and f.declarations >= UNIFORM_LEAST and f.counted_share >= COUNTED_SHARE:
        return "generated"
    return None
