"""Syntax of Go source files."""

from __future__ import annotations

import re
from itertools import islice

from .grammar_common import START_TOKENS, Reducer, TokenSymbols, symbols

# The keywords of the language, with the symbols used here.
_WORDS = {
    "package": "p", "import": "m", "func": "F", "type": "y", "struct": "S", "interface": "I", "map": "M", "chan": "c",
    "var": "v", "const": "C", "if": "i", "else": "l", "for": "f", "range": "R", "switch": "s", "select": "X", "case": "k",
    "default": "D", "return": "r", "break": "b", "continue": "b", "fallthrough": "b", "goto": "g", "defer": "d", "go": "d",
}
_OPS = {":=": "W", "++": "P", "--": "P", "<-": "A", "...": "E", "*": "*", "&": "&", "!": "!", "=": "=", "+": "u", "-": "u", "^": "u", "~": "u"}
_TOKEN = re.compile(
    r"//[^\n]*|/\*(?s:.*?)\*/|[^\W\d]\w*"
    r"|(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?\w*"
    r'|"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))\''
    r"|<<=|>>=|&\^=|&\^|\.\.\.|:=|\+\+|--|<-|&&|\|\||<<|>>|[-+*/%&|^=!<>]=|[-+*/%&|^<>=!.,;:(){}\[\]~]|\n|[^\s]"
)
_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]*|(?:[1-9][\d_]*|0)\.?[\d_]*(?:[eE][+-]?\d+)?|0\d*\.[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?")
_BINARY = frozenset("&& || == != < <= > >= / % | << >> &^".split())
_ASSIGN = frozenset("+= -= *= /= %= &= |= ^= <<= >>= &^=".split())


def _classify(token: str) -> str:
    c = token[0]
    if token[:2] == "//":
        return ""
    if token[:2] == "/*":
        return "\n" if "\n" in token else ""
    if c == "\n":
        return "\n"
    if c.isalpha() or c == "_":
        return _WORDS.get(token, "a")
    if c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
        return "0" if _NUMBER.fullmatch(token) else "\x00"
    if c in "\"`'":
        return ("0" if c == "'" else '"') if len(token) > 1 else "\x00"
    if token in _OPS:
        return _OPS[token]
    if token in _BINARY:
        return "B"
    if token in _ASSIGN:
        return "="
    return token if c in ".,;:(){}[]" and len(token) == 1 else "\x00"


def _patterns():
    args, params, imports, group, of_type = (symbols("(", 1 << i) for i in range(5))
    index, size, generic = (symbols("[", 1 << i) for i in range(3))
    block, literal, fields, methods, clauses = (symbols("{", 1 << i) for i in range(5))
    type_name = re.compile(rf"a(?:\.a)?{generic}?")
    base = rf"(?:a(?:\.a)?{generic}?|S{fields}|I{methods}|{of_type})"
    prefix = rf"(?:\*|{size}|A?cA?|M{generic})"
    plain = rf"(?:{prefix}*{base})"
    type_ = rf"(?:{prefix}*(?:{base}|F{params}(?:{params}|{plain})?))"
    # An operand with all that follows it becomes one symbol; a name alone stays a name. Literals after a bare
    # type name stay, because a block may follow a name in the head of a statement.
    post = rf"(?:\.a|\.{of_type}|{index}|{generic}|{args})"
    operand = re.compile(
        rf'(?:0|"|F{params}(?:{params}|{type_})?{block}|F{params}(?:{params}|{plain})?(?={args})|{prefix}+{base}(?:{args}|{literal})|S{fields}{literal}|a|{args}|{of_type}){post}*'
    )

    def operands(inside: str) -> str:
        return operand.sub(lambda m: "a" if type_name.fullmatch(m[0]) else "x", inside)

    unary = r"[u*&!A]*"
    head = rf"{unary}[ax](?:[uB*&]{unary}[ax])*"
    one = rf"{unary}[ax](?:{literal}{post}*)?"
    e = rf"{one}(?:[uB*&]{one})*"

    def simple(x: str) -> str:
        return rf"(?:{x}(?:,{x})*(?:P|[=W]{x}(?:,{x})*|A{x})?)"

    es, simple_head, simple_any = rf"{e}(?:,{e})*", simple(head), simple(e)
    test = rf"(?:(?:{simple_head})?;)?{head}{block}"
    spec = rf"a(?:,a)*(?:{type_})?(?:={es})?"
    type_spec = rf"a{generic}?=?{type_}"
    arg = rf"(?:{e}|{type_})"
    statement = (
        rf"(?:i{test}(?:li{test})*(?:l{block})?"
        rf"|f(?:(?:{simple_head})?;(?:{head})?;(?:{simple_head})?|(?:{head}(?:,{head})*[=W])?R{head}|{head})?{block}"
        rf"|s(?:(?:{simple_head})?;)?(?:{simple_head})?{clauses}|X{clauses}|{block}"
        rf"|r(?:{es})?|d{e}|ba?|ga|[vC](?:{spec}|{group})|y(?:{type_spec}|{group})|{simple_any})"
    )
    statements = rf"(?:(?>a:)?(?>{statement})?;)*(?>a:)?(?>{statement})?"
    element = rf"(?:(?:{e}|{literal}):)?(?:{e}|{literal})"
    parameter = rf"(?:aE?{type_}|E?{type_})"
    field = rf'(?:a(?:,a)*{type_}|\*?a(?:\.a)?{generic}?)"?'
    method = rf"(?:a{params}(?:{params}|{type_})?|u?{type_}(?:Bu?{type_})*)"
    types = rf"(?:a?u?{type_}(?:Bu?{type_})*)(?:,a?u?{type_}(?:Bu?{type_})*)*,?"
    readings = {
        "(": [
            (1, "operands", rf"(?:{arg}(?:,{arg})*E?,?)?"),
            (2, "raw", rf"(?:{parameter}(?:,{parameter})*,?)?"),
            (4, "raw", r'(?:;|[a.]?";?)*'),
            (8, "operands", rf"(?:;|(?:{spec}|{type_spec});?)*"),
            (16, "raw", rf"(?:y|{type_})"),
        ],
        "[": [(1, "operands", rf"(?:{e}|(?:{e})?:(?:{e})?(?::{e})?),?"), (2, "operands", rf"(?:{e}|E)?"), (4, "raw", types)],
        "{": [
            (1, "operands", statements),
            (2, "operands", rf"(?:{element}(?:,{element})*,?)?"),
            (4, "raw", rf"(?:;|{field};?)*"),
            (8, "raw", rf"(?:;|{method};?)*"),
            (16, "operands", rf";*(?:(?:k(?:{arg}(?:,{arg})*|{simple_any})|D):{statements})*"),
        ],
    }
    top = rf"(?:F{params}?a{generic}?{params}(?:{params}|{type_})?{block}?|[vC](?:{spec}|{group})|y(?:{type_spec}|{group}))"
    unit = re.compile(rf';*pa(?:;+m(?:[a.]?"|{imports}))*(?:;+(?>{top}))*;*')
    values = re.compile(r"=([^;]*)")

    def unit_view(flat: str) -> str:
        return values.sub(lambda m: "=" + operands(m[1]), flat)

    return Reducer(readings, {"raw": str, "operands": operands}), unit, unit_view


_SYMBOLS = TokenSymbols(_classify)
_REDUCER, _UNIT, _UNIT_VIEW = _patterns()
_SEMICOLON = re.compile(r"(?<=[a0\"brP)\]}])\n+")


_PACKAGE = re.compile(r"[;\n]*(?:pa|\Z)")


def valid(text: str) -> bool:
    """Whether the text is a syntactically valid Go file.

    The start of the text is looked at first, which settles most texts of other languages.
    """
    text = text.lstrip("\ufeff") + "\n"
    start = "".join([_SYMBOLS[m[0]] for m in islice(_TOKEN.finditer(text), START_TOKENS[0])])
    if "\x00" in start or not _PACKAGE.match(start):
        return False
    skeleton = "".join(map(_SYMBOLS.__getitem__, _TOKEN.findall(text)))
    if "\x00" in skeleton:
        return False
    flat = _REDUCER.reduce(_SEMICOLON.sub(";", skeleton).replace("\n", ""))
    return flat is not None and _UNIT.fullmatch(_UNIT_VIEW(flat)) is not None
