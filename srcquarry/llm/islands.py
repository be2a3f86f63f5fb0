"""Island grammars for functions and their documentation in Python, Go and C++.

Only documentation comments, annotations, signatures and balanced bodies are recognised; strings
and other comments are stepped over as tokens, and everything else is skipped as water. Broken
code around an island does not matter.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .doc_text import informative


class Pair(NamedTuple):
    name: str
    signature: str
    doc: str
    code: str


_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(", re.M)
_PY_SKIP = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|#[^\n]*|[()\[\]{}:]', re.S)
_PY_DOC = re.compile(
    r"(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*[rRuU]?"
    r'("""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')[ \t]*(?:#[^\n]*)?(?:[\r\n;]|\Z)',
    re.S,
)
_PY_TEXT = re.compile(r'(?P<c>#[^\n]*)|"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', re.S)
_PY_GROUP = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
_PY_STRING = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'', re.S)


def _py_header_end(text: str, at: int) -> int:
    """The place after the colon that ends the signature whose parenthesis opens before ``at``; -1 if none."""
    depth = 1
    for m in _PY_SKIP.finditer(text, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return -1
        elif c == ":" and depth == 0:
            return m.end()
    return -1


def _py_mask(text: str) -> str:
    """The text at its length with comments blank, and strings and bracket groups without line breaks: only block structure is left."""
    masked = _PY_TEXT.sub(lambda m: (" " if m["c"] else "x") * len(m[0]), text)
    n = 1
    while n:
        masked, n = _PY_GROUP.subn(lambda m: "x" * len(m[0]), masked)
    return masked


def _py_body_end(masked: str, at: int, indent: str) -> int:
    """Where the body behind a header ends: after the last line that stands deeper than the header."""
    line_end = masked.find("\n", at)
    if line_end < 0:
        return len(masked.rstrip())
    end = at + len(masked[at:line_end].rstrip())
    width = len(indent.expandtabs(8))
    for m in re.compile(r"([ \t]*)([^\s][^\n]*)?(?:\n|\Z)").finditer(masked, line_end + 1):
        if m[2]:
            if len(m[1].expandtabs(8)) <= width:
                break
            end = m.start() + len(m[0].rstrip())
    return end


def _py_comments(lines: list[str], at: int, indent: str) -> str:
    """Comment lines right before line ``at``; blank lines do not matter, other indentation ends the run."""
    found = []
    for i in range(at - 1, -1, -1):
        s = lines[i].strip()
        if not s:
            continue
        if s[0] != "#" or not lines[i].startswith(indent + "#"):
            break
        found.append(s)
    return "\n".join(reversed(found))


def python_pairs(body: str, doc: str) -> list[Pair]:
    """Functions at the top level, or directly in the class that the chunk is."""
    hits = list(_PY_DEF.finditer(body))
    if not hits:
        return []
    spans = [m.span() for m in _PY_STRING.finditer(body)] if len(hits) > 1 and ('"""' in body or "'''" in body) else []
    lead = body.lstrip("\r\n")
    is_class = bool(re.match(r"[ \t]*(?:@[^\n]*\n[ \t]*)*class\b", lead))
    hits = [m for m in hits if not any(a < m.start() < b for a, b in spans)]
    if not hits:
        return []
    level = min(len(m[1].expandtabs(8)) for m in hits)
    lines = body.split("\n") if is_class or len(hits) > 1 else []
    found = []
    masked = ""
    for n, m in enumerate(hits):
        if len(m[1].expandtabs(8)) != level:
            continue
        end = _py_header_end(body, m.end())
        if end < 0:
            continue
        pieces = []
        if is_class or found or n:
            row = body.count("\n", 0, m.start())
            while row and lines[row - 1].lstrip().startswith("@") and lines[row - 1].startswith(m[1] + "@"):
                row -= 1
            pieces.append(_py_comments(lines, row, m[1]))
        elif doc:
            pieces.append(doc)
        text = _PY_DOC.match(body, end)
        if text:
            quote = text[1]
            pieces.append(quote[3:-3] if quote[:3] in ('"""', "'''") else quote[1:-1])
        if any(pieces):
            masked = masked or _py_mask(body)
            start = m.start() + len(m[1])
            found.append(Pair(m[2], body[start:end], "\n".join(p for p in pieces if p), body[start : _py_body_end(masked, end, m[1])]))
    return found


_GO_FUNC = re.compile(r"func[ \t]*(?:\([^)]*\)[ \t]*)?([^\W\d]\w*)[ \t]*(?:\[[^\]]*\])?\(")
_GO_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|`[^`]*(?:`|\Z)|\'(?:[^\'\\\n]|\\.)*\'|[{}()]|^func\b', re.S | re.M)
_GO_TYPE = re.compile(r"\b(?:interface|struct)[ \t]*$")
_C_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    r'|R"([^()\\\s]{0,16})\(.*?\)\1"|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|^[ \t]*#(?:[^\n\\]|\\.)*'
    r"|[{}();]|(?<!:):(?!:)",
    re.S | re.M,
)
_C_NAME = re.compile(r"(~?[^\W\d]\w*|operator\s*(?:\(\)|\[\]|[^\s\w(]+|\w+))\s*\($")
_C_CLASS = re.compile(r"(?:template\s*<[^{;]*?>\s*)?(?:typedef\s+)?(?:class|struct|union)\b[^;{(]*$")
_C_SCOPE = re.compile(r"(?:inline\s+)?namespace\b[^;{(]*$|extern\s*\"[^\"]*\"$")
_C_ACCESS = re.compile(r"\b(?:public|private|protected)\s*$")
_C_VALUE = re.compile(r"(?<!operator)(?<!operator )(?<![=!<>+*/%&|^-])=(?!=)")
_C_GROUP = re.compile(r"\([^()]*\)")
_C_WORDS = frozenset({"if", "for", "while", "switch", "catch", "return", "sizeof", "alignas", "decltype", "noexcept", "defined"})


def _closing(tokens: list[re.Match], i: int) -> int:
    """The token that closes the brace at token ``i``; the last token where none does."""
    depth = 0
    for j in range(i, len(tokens)):
        c = tokens[j][0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return j
    return len(tokens) - 1


class _Notes:
    """The comments right before a place: a run without code between; a comment behind code on its line is none of them."""

    def __init__(self, text: str, at: int) -> None:
        self.text, self.start, self.found = text, at, []

    def see(self, m: re.Match) -> None:
        gap = self.text[self.start : m.start()]
        if gap.strip():
            return
        if self.found or "\n" in gap or not self.text[: self.start].strip():
            self.found.append(m[0])
        self.start = m.end()

    def clear(self, at: int) -> None:
        self.start, self.found = at, []


def go_pairs(body: str, doc: str) -> list[Pair]:
    """The functions and methods at the top level of the chunk; ``doc`` stands before the first if no code does."""
    if "func" not in body:
        return []
    tokens = list(_GO_TOKEN.finditer(body))
    notes, found, i, depth = _Notes(body, 0), [], 0, 0
    while i < len(tokens):
        m = tokens[i]
        c = m[0]
        if c in "({":
            depth += 1
        elif c in ")}":
            depth -= 1
        elif c[:2] in ("//", "/*"):
            if depth == 0:
                notes.see(m)
        elif c == "func" and depth == 0 and (head := _GO_FUNC.match(body, m.start())):
            brace = _go_body(body, tokens, i)
            end = _closing(tokens, brace) if brace else i
            stop = tokens[end].end() if brace and tokens[end][0] == "}" else len(body) if brace else head.end()
            before = [] if body[notes.start : m.start()].strip() else notes.found
            own = [doc] if doc and not found and not _GO_TOKEN.sub(lambda t: "" if t[0][0] == "/" else t[0], body[: m.start()]).strip() else []
            if brace and (own or before):
                found.append(Pair(head[1], body[m.start() : tokens[brace].start()].strip(), "\n".join([*own, *before]), body[m.start() : stop].rstrip()))
            notes.clear(stop)
            i = end
        i += 1
    return found


def _go_body(body: str, tokens: list[re.Match], i: int) -> int:
    """The token of the brace that opens the body of the function at token ``i``; 0 if it has none. Braces of types are stepped over."""
    paren, j, last = 0, i + 1, tokens[i].end()
    while j < len(tokens):
        c = tokens[j][0]
        if not paren and "\n" in body[last : tokens[j].start()]:
            return 0
        if c in "()":
            paren += 1 if c == "(" else -1
        elif c == "{":
            if not paren and not _GO_TYPE.search(body[max(0, tokens[j].start() - 32) : tokens[j].start()]):
                return j
            j = _closing(tokens, j)
        elif c == "func" and not paren:
            return 0
        last = tokens[j].end()
        j += 1
    return 0


def _c_name(head: str) -> str | None:
    """The identifier before the first parenthesis that opens at the outermost level of a declarator."""
    at = head.find("(")
    while at >= 0:
        m = _C_NAME.search(head, 0, at + 1)
        if m and m[1] not in _C_WORDS:
            return m[1]
        at = head.find("(", at + 1)
    return None


def _c_plain(head: str) -> str:
    """A declarator without its parentheses."""
    n = 1
    while n:
        head, n = _C_GROUP.subn("", head)
    return head


def cpp_pairs(body: str, doc: str) -> list[Pair]:
    """The functions at the top level of the chunk, also in namespaces, or the methods defined directly in the class that it is."""
    if not doc and "//" not in body and "/*" not in body:
        return []
    return _c_pairs(body, list(_C_TOKEN.finditer(body)), 0, 0, doc, True)[0]


def _c_pairs(body: str, tokens: list[re.Match], i: int, at: int, doc: str, top: bool) -> tuple[list[Pair], int]:
    """Definitions from token ``i`` to the brace that closes their scope, and the token behind it."""
    notes, found, paren, inits, first = _Notes(body, at), [], 0, False, True
    while i < len(tokens):
        m = tokens[i]
        c = m[0]
        i += 1
        if c[:2] in ("//", "/*"):
            if not paren:
                notes.see(m)
        elif c == "(":
            paren += 1
        elif c == ")":
            paren -= 1
        elif c == "{":
            head = body[notes.start : m.start()].strip()
            if paren > 0 or inits and body[: m.start()].rstrip()[-1:] not in (")", "}"):
                i = _closing(tokens, i - 1) + 1  # a value: default argument or member initialiser
                continue
            if _C_SCOPE.match(head) or top and first and _C_CLASS.match(head):
                scope = _C_SCOPE.match(head) is not None
                inner, i = _c_pairs(body, tokens, i, m.end(), "", top and scope)
                found += inner
                notes.clear(tokens[i - 1].end())
                first = first and scope
                continue
            j = _closing(tokens, i - 1)
            i = j + 1
            if "(" not in head or _C_VALUE.search(_c_plain(head)):
                continue  # a type or a value; it ends with its semicolon
            name, end = _c_name(head), tokens[j].end() if tokens[j][0] == "}" else len(body)
            own = ([doc] if doc and first else []) + notes.found
            if name and own:
                start = notes.start + len(body[notes.start : m.start()]) - len(body[notes.start : m.start()].lstrip())
                found.append(Pair(name, head, "\n".join(own), body[start:end]))
            notes.clear(end)
            paren, inits, first = 0, False, False
        elif c == "}":
            if not top or at:
                break
            notes.clear(m.end())
        elif c == ";" and paren <= 0:
            first = first and not body[notes.start : m.start()].strip()
            notes.clear(m.end())
            paren, inits = 0, False
        elif c == ":" and not paren:
            if _C_ACCESS.search(body[max(0, m.start() - 12) : m.start()]):
                notes.clear(m.end())
            elif ")" in body[notes.start : m.start()]:
                inits = True
        elif c.lstrip()[:1] == "#" and not body[notes.start : m.start()].strip():
            notes.clear(m.end())
    return found, i


_GRAMMARS = {"python": python_pairs, "go": go_pairs, "cpp": cpp_pairs}


def documented_pairs(language: str | None, body: str | None, doc: str | None) -> list[Pair]:
    """Functions of a chunk with non-trivial documentation, in order; none for other languages or null bodies."""
    grammar = _GRAMMARS.get(language or "")
    if grammar is None or not body:
        return []
    return [p for p in grammar(body, doc or "") if informative(p.doc, p.name)]
