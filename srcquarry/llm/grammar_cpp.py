"""Syntax of C++17 and C source files; includes are not resolved and names need not be declared."""

from __future__ import annotations

import re
from itertools import chain, islice

from .grammar_common import START_TOKENS, Reducer, TokenSymbols, symbols

# The keywords of the language, grouped by the symbol used here.
_WORDS = {
    word: symbol
    for symbol, group in {
        "t": "int long short char bool float double unsigned signed void auto wchar_t char8_t char16_t char32_t _Bool",
        "q": "const volatile static inline constexpr extern virtual explicit friend mutable register thread_local restrict __restrict __inline _Noreturn _Thread_local consteval constinit",
        "0": "this nullptr true false",
        "n": "typename", "c": "class struct union", "e": "enum", "N": "namespace", "T": "template", "u": "using", "y": "typedef",
        "o": "operator", "i": "if", "l": "else", "f": "for", "w": "while", "d": "do", "s": "switch", "k": "case", "D": "default",
        "b": "break continue", "r": "return co_return", "g": "goto", "Y": "try", "C": "catch", "h": "throw co_yield", "W": "new", "X": "delete",
        "z": "sizeof alignof alignas decltype noexcept typeid co_await _Alignof _Alignas", "p": "public private protected",
        "K": "const_cast static_cast dynamic_cast reinterpret_cast", "A": "static_assert _Static_assert", "M": "__attribute__ __declspec __extension__",
        "B": "and or xor bitand bitor not_eq", "!": "not compl",
    }.items()
    for word in group.split()
}
_OPS = {
    "::": "S", "->": "V", "->*": "B", ".*": "B", "++": "P", "--": "P", "=": "=", "+": "U", "-": "U", "*": "*", "&": "&", "&&": "J",
    "!": "!", "~": "~", "<": "<", ">": ">", "?": "?", "...": "E", ".": ".",
}
_TOKEN = re.compile(
    r"\\\r?\n|//(?:[^\n\\]|\\\r?\n|\\.)*|/\*(?s:.*?)\*/"
    r"|^[ \t]*\#(?:[^\n\\/]|\\\r?\n|\\.|/(?![/*]))*"
    r'|(?:u8|[uUL])?R"([^()\\\s]{0,16})\((?s:.*?)\)\1"|(?:u8|[uUL])?"(?:[^"\\\n]|\\(?s:.))*"|(?:u8|[uUL])?\'(?:[^\'\\\n]|\\.)+\''
    r"|[^\W\d]\w*|\.?\d(?:[\w.]|[eEpP][+-]|'(?=\w))*"
    r"|<=>|->\*|<<=|\.\.\.|::|->|\+\+|--|&&|\|\||<<(?!=)|[-+*/%&|^=!<]=|>>=|>=|[-+*/%&|^<>=!~?.,;:(){}\[\]]|\S",
    re.M,
)
_NUMBER = re.compile(
    r"(?:0[xX][\da-fA-F']+(?:\.[\da-fA-F']*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)(?:[uUlLzZ]{0,3}|[fF]|_\w+|h|min|s|ms|us|ns)"
)
_DIRECTIVE = re.compile(
    r"\s*#\s*(?:include\s*(?:<[^>\n]+>|\"[^\"\n]+\"|\w+.*)|define\s+\w+.*|undef\s+\w+|pragma\b.*|ifn?def\s+\w+|if\b.+|elif\b.+|elifn?def\b.+|else\b.*|endif\b.*|error\b.*|warning\b.*|line\b.*|import\b.*)?\s*",
    re.S,
)
_BINARY = frozenset("|| == != <= >= / % | ^ << <=>".split())
_ASSIGN = frozenset("+= -= *= /= %= &= |= ^= <<= >>=".split())
_IF = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|endif)\b", re.M)


def _classify(token: str) -> str:
    c = token[0]
    if token[:2] in ("//", "/*") or c == "\\" and len(token) > 1:
        return ""
    if "#" in token and token.lstrip()[:1] == "#":
        return "" if _DIRECTIVE.fullmatch(token) else "\x00"
    last = token[-1]
    if last == '"' or last == "'":
        return ('"' if last == '"' else "0") if len(token) > 1 else "\x00"
    if c.isalpha() or c == "_":
        return _WORDS.get(token, "a")
    if c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
        return "0" if _NUMBER.fullmatch(token) else "\x00"
    if token in _OPS:
        return _OPS[token]
    if token in _BINARY:
        return "B"
    if token in _ASSIGN:
        return "="
    return token if len(token) == 1 and c in ",;:(){}[]" else "\x00"


#: Template argument lists, and the parameter lists of template heads, once inner ones are gone.
_LIST = re.compile("(?<=[aKT])<(?:[qnceta0SEUB*&JD,.=\"!-]|(?<=T)a)*>")


#: Those that hold no logical operator: what looks like another list may be two comparisons.
_SURE_LIST = re.compile("(?<=[aKT])<(?:[qnceta0SEU*&D,.=\"!-]|(?<=T)a)*>")
_ATTRIBUTE = re.compile("M[\ue000-\ue0ff]?")


def _untemplate(inside: str, lists: re.Pattern = _LIST) -> str:
    if "M" in inside:
        inside = _ATTRIBUTE.sub("", inside)
    while "<" in inside:
        shorter = lists.sub("", inside)
        if shorter == inside:
            break
        inside = shorter
    return inside


def _compare(inside: str) -> str:
    """Like ``_untemplate``, with comparisons joined by logical operators left as they are."""
    return _untemplate(inside, _SURE_LIST)


def _patterns():
    args, params, loop, type_id, condition = (symbols("(", 1 << i) for i in range(5))
    index, attribute, capture = (symbols("[", 1 << i) for i in range(3))
    block, init, members, enums, scope = (symbols("{", 1 << i) for i in range(5))
    any_p = "[\ue000-\ue0ff]"
    name = r"(?:S?a(?:ST?a)*)"
    attr = rf"{attribute}*"
    ptr = r"(?:[*&J]q*)*"

    def types(leaf: str) -> str:
        return rf"(?:(?:[qn]|{attribute})*(?:t[qt]*|[ce]?{leaf}q*|z{any_p}q*))"

    type_ = types(name)
    op = rf"o(?:[UB*&J<>=!~P,]+|{any_p}|{index}|[WX]{index}?|\"a|{type_}{ptr})"
    # An operand with all that follows it becomes one symbol; a name alone stays a name.
    no_head = "(?<![ifwsCz])"
    lam = rf"{capture}{params}?(?:[qa]|z{args}?)*(?:V{type_}{ptr})?{block}"
    primary = rf'(?:0|"+|{lam}|W{args}?{type_}\**{index}*(?:{args}|{init})?|K{args}|{no_head}{args}|{name}(?:{init})?|n{name}(?={args}|{init})|t+(?={args}|{init})|z{any_p}|{op}(?={args}))'
    post = rf"(?:{args}|{index}|[.V]T?~?(?:{name}|{op})|P|(?<!{any_p}){init}|E)"
    operand = re.compile(rf"(?:{no_head}{type_id}[U*&J!~P]*)*{primary}{post}*")
    plain_name = re.compile(name)

    def operands(inside: str) -> str:
        return operand.sub(lambda m: "a" if plain_name.fullmatch(m[0]) else "0" if m[0][0] in '0"' and len(m[0]) == m[0].count(m[0][0]) else "x", inside)

    unary = rf"(?:[U*&J!~Ph]|z(?!{any_p})|X{index}?)*"
    flat = rf"{unary}[ax0](?:(?:[UB*&J<=]|>=?>?){unary}[ax0])*"
    e = rf"(?:h|{flat}(?:\?{flat}(?:\?{flat}:{flat})*:{flat})*(?:={init})?)"
    es = rf"{e}(?:,{e})*"
    value = rf"(?:{e}|{init})"
    loose = types("a")
    declarator = rf"{ptr}(?:[ax]|{args}{params}|{capture})(?:{index})*{attr}(?:={value}|{args}|{init}|:{e})?"
    decl = rf"{loose}{declarator}(?:,{declarator})*"
    # Outside of blocks only the values after '=' are read as operands: declarators need their parameters.
    right = re.compile(r"(?<!o)(?<!ua)=((?![DX0];)[^;,]*)")
    read_value = re.compile(value)

    def values(inside: str) -> str:
        return right.sub(lambda m: "=x" if read_value.fullmatch(operands(m[1])) else "=\x00", inside)

    w_declarator = rf"{ptr}(?:{name}|{args}{params}|{capture})(?:{index})*{attr}(?:=[x0]|{args}|{init}|:[a0])?"
    w_decl = rf"{type_}{w_declarator}(?:,{w_declarator})*"
    trailer = rf"(?:[qa&J]|z{args}?|h{params}|{attribute})*(?:V{type_}{ptr})?"
    func = rf"(?:[qn]|{attribute})*(?:{type_}{ptr})?(?:S?(?:aS)*)(?:~a|{op}|a){params}{trailer}"
    inits = rf"(?::{name}(?:{args}|{init})E?(?:,{name}(?:{args}|{init})E?)*)?"
    bases = rf"(?::[pq]*{name}E?(?:,[pq]*{name}E?)*)"
    after = rf"(?:{w_declarator}(?:,{w_declarator})*)?;"
    klass = rf"[qy]*c{attr}{name}?a?{bases}?{members}q*{after}|[qy]*e?c{name};"
    enum = rf"[qy]*ec?{attr}{name}?(?::{type_})?(?:{enums}{after}|;)"
    outer = (
        rf"(?:;|{attr}(?:T(?:a(?=[qntcau]))?)*(?:{klass}|{enum}|{func}(?:{inits}{block}|(?:=[0DX])?;)|{w_decl};|u{name}=[^;\x00]*;)"
        rf"|q?N{attr}{name}?{scope}|N{name}=x;|q\"(?:{scope}|{func}(?:{block}|;)|{w_decl};)|u[Nne]?{name}(?:,{name})*;"
        rf"|y{w_decl};|y{type_}{ptr}{args}{params};|y{type_}{ptr}{name}{params};|q{name};|A{args};|T{type_}{w_declarator};)"
    )
    control = rf"(?:iq?{condition}|f{loop}|w{condition}|s{condition}|l|d|k{flat}(?:E{flat})?:(?!:)|D:|a:(?!:)|{attribute})"
    statement = (
        rf"(?:{control})*(?:{block}|;|{e}(?:,{e})*;|{decl};|r{value}?;|b;|ga;|u[Nn]?[ax];|u[ax]={loose}{ptr};|y{decl};"
        rf"|Y{block}(?:C{params}{block})+|[qy]*c[ax]{bases}?{members}?;|[qy]*c[ax]?{members};|[qy]*ec?[ax]?(?::{loose})?{enums}?;|A[ax];|A{args};|N[ax]=[ax];)"
    )
    parameter = rf"{type_}{ptr}E?(?:a|{args}{params}|{index})?(?:{index})*{attr}(?:=x)?"
    item = rf"(?:{value}|{loose}{ptr}{any_p}?)E?"
    element = rf"(?:(?:(?:\.a|{index})+=?)?{value}E?|a:{value})"
    readings = {
        "(": [
            (1, "operands", rf"(?:{item}(?:,{item})*)?|{ptr}a?|{loose}{ptr}|[*&J]q*a{params}"),
            (2, "values", rf"(?:{parameter}(?:,{parameter})*(?:,?E)?|E|t)?"),
            (4, "operands", rf"(?:{decl}|{es})?;(?:{e}|{decl})?;(?:{es})?|(?:(?:{decl}|{es});)?{loose}{ptr}(?:a|{index}|{capture}):{value}"),
            (8, "raw", rf"{type_}{ptr}(?:{any_p}{{1,2}})?{index}*"),
            (16, "operands", rf"(?:(?:{decl}|{es})?;)?(?:{es}|{decl})"),
        ],
        "[": [
            (1, "operands", rf"(?:{value}(?:E{value})?)?"),
            (2, "raw", "[\ue100-\ue1ff]"),
            (4, "raw", r"(?:[&=]|(?:[&*]?[a0]E?(?:=[^,;=]+)?))?(?:,[&*]?[a0]E?(?:=[^,;=]+)?)*"),
        ],
        "{": [
            (1, "operands", rf"(?>{statement})*"),
            (2, "operands", rf"(?:{element}(?:,{element})*,?)?"),
            (4, "values", rf"(?>pa?:|{outer})*"),
            (8, "values", rf"(?:a{attr}(?:=x)?(?:,a{attr}(?:=x)?)*,?)?"),
            (16, "values", rf"(?>{outer})*"),
        ],
    }
    return Reducer(readings, {"raw": str, "operands": operands, "values": values}, _untemplate, _compare), re.compile(rf"(?>{outer})*"), values


#: Names in capitals may be macros that stand for something other than an expression.
_MACRO = re.compile(r"(?:[A-Z_][A-Z0-9]*_[A-Z0-9_]*|[A-Z][A-Z0-9]{3,}|__\w+|[A-Z]\w*_[A-Z]{2,})")
_PAREN = "[\ue000-\ue0ff]"
_MACRO_TYPE = re.compile(rf"m{_PAREN}(?=[*&q]*a|[*&q]+(?:m|{_PAREN})|m(?!{_PAREN}))")
# What may follow a macro before a declaration: a type with what it declares, so that a lone name of a type in capitals stays.
_DECLARES = rf"[qtnceyTNu]|S?[am](?:S[am])*(?:[*&J]q*)*[qam]|S?[am](?:S[am])*[*&J]+q*{_PAREN}|[am]{_PAREN}|~"
_MACRO_BEFORE = re.compile(rf"^(?:m{_PAREN}?;?)+(?={_DECLARES})|(?:(?<=;)(?:m{_PAREN}?;?)+|(?<=[\ue200-\ue2ff])(?:m{_PAREN};?|m(?![;,=]))+)(?={_DECLARES}|$)")
_MACRO_AFTER = re.compile(rf"(?:(?<=[\ue000-\ue1ff])|(?<=[\ue000-\ue0ff]q)|(?<=[tam*&J]a))(?:m{_PAREN}?)+(?=[;,={{\ue200-\ue2ff]|$)")
_MACRO_INSIDE = re.compile(rf"(?<=[tce])m{_PAREN}?(?=[qtcea*])|(?<=q)m{_PAREN}?(?=[qtce]|S?[am](?:S[am])*[*&Jq]*[am])|(?<=[*&J])m(?=[am])|(?<=[am])m(?=[am]{_PAREN})")
_MACRO_STRING = re.compile('(?<=")[am](?=")')


def _without_macros(inside: str) -> str:
    """The contents of a group with macros that wrap or decorate declarations taken out; others are names."""
    if "m" in inside:
        inside = _MACRO_TYPE.sub("t", inside)
        inside = _MACRO_BEFORE.sub("", inside)
        inside = _MACRO_AFTER.sub("", inside)
        inside = _MACRO_INSIDE.sub("", inside)
        inside = inside.replace("m", "a")
    if '"' in inside:
        inside = _MACRO_STRING.sub("", inside)
    return _untemplate(inside)


def _classify_macros(token: str) -> str:
    symbol = _classify(token)
    return "m" if symbol == "a" and _MACRO.fullmatch(token) else symbol


_SYMBOLS = TokenSymbols(_classify)
_MACRO_SYMBOLS = TokenSymbols(_classify_macros)
_REDUCER, _UNIT, _UNIT_VIEW = _patterns()
_MACRO_REDUCER = _REDUCER.with_tidies(_without_macros)


def _parses(tokens: list[str], symbols_of: TokenSymbols, reducer: Reducer, tidy) -> bool:
    skeleton = "".join([symbols_of[t] for t in tokens])
    if "\x00" in skeleton:
        return False
    flat = reducer.reduce(skeleton)
    return flat is not None and _UNIT.fullmatch(_UNIT_VIEW(tidy(flat))) is not None


def valid(text: str) -> bool:
    """Whether the text is a syntactically valid C++ or C file.

    A text that does not parse as it stands is parsed once more with names in capitals read as macros, which
    may wrap or decorate declarations.
    """
    text = text.lstrip("\ufeff")
    if "#" in text:
        depth = 0
        for m in _IF.finditer(text):
            depth += -1 if m[1] == "endif" else 1
            if depth < 0:
                return False
        if depth:
            return False
    found = (m[0] for m in _TOKEN.finditer(text))
    start: list[str] = []
    for n in START_TOKENS:
        start += islice(found, n - len(start))
        plain = _starts(start, _SYMBOLS, _REDUCER)
        if not plain and not _starts(start, _MACRO_SYMBOLS, _MACRO_REDUCER):
            return False
    tokens = list(chain(start, found))
    if plain and _parses(tokens, _SYMBOLS, _REDUCER, _untemplate):
        return True
    return any(map(_MACRO.fullmatch, tokens)) and _parses(tokens, _MACRO_SYMBOLS, _MACRO_REDUCER, _without_macros)


def _starts(tokens: list[str], symbols_of: TokenSymbols, reducer: Reducer) -> bool:
    """Whether a text may go on from these first tokens: no foreign token, no whole group that cannot be read."""
    skeleton = "".join([symbols_of[t] for t in tokens])
    return "\x00" not in skeleton and reducer.start(skeleton) is not None
