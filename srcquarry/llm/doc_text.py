"""Whether a documentation comment tells a reader anything beyond the name of what it documents."""

from __future__ import annotations

import re

# Words and phrases that carry no description.
REMINDER = re.compile(
    r"(?:todo|fixme|xxx|hack|tbd|wip|待办|待补|待完善|noch offen|offen\b|sin documentar|pendiente|por hacer|non documenté"
    r"|à (?:faire|documenter|compléter)|nicht dokumentiert|undocumented|not documented)",
    re.I,
)
DIRECTIVE = re.compile(
    r"(?:noqa\b|type:\s*ignore|pylint:|pyright:|mypy:|fmt:\s*(?:on|off|skip)|isort:|pragma\b|nosec\b|nolint|clang-format|clang-tidy"
    r"|cppcheck|eslint|lint:|go:[a-z]|\+build\b|export [A-Za-z_]\w*$|-\*-|vim:|coverage:|NOSONAR|@suppress|@formatter)",
    re.I,
)
LICENCE = re.compile(
    r"(?:copyright\b|\(c\)\s*\d{4}|©|spdx-|licen[cs]ed under|all rights reserved|alle rechte vorbehalten|todos los derechos"
    r"|tous droits réservés|版权所有|redistribution and use|permission is hereby granted)",
    re.I,
)
POINTER = re.compile(
    r"(?:@?see\b|\\see\b|refer to\b|cf\b|same as\b|as (?:above|below|before)|siehe\b|wie oben|véase\b|ver arriba|voir\b|idem\b|dito\b|ditto\b|同上|同前|见上|见下|参见|如上)",
    re.I,
)
EMPTY_WORDS = frozenset(
    "a an the this that these it its is are be do does done of for to and or in on with by as from at function functions method "
    "methods func fn def routine procedure helper implementation implements implement doc docs docstring documentation comment "
    "description describes none na nil null void n name self here".split()
)
EMPTY_CJK = frozenset({"无", "略", "函数", "方法", "说明", "文档", "暂无"})

_TAG = re.compile(r"^[@\\](?:brief|short|details?|summary|note|remarks?|description)\b[:\s]*", re.I)
_FIELD = re.compile(
    r"^(?:[@\\:](?:t?param|arg|returns?|retval|throws?|raises?|exception|type|rtype|since|author|version|date|file|ingroup|pre|post)\b"
    r"(?:\[[^\]]*\])?\s*(?:[\w.*&]+)?[:\s]*)",
    re.I,
)
_SECTION = re.compile(r"^(?:args?|arguments|parameters?|params|returns?|yields?|raises?|throws|examples?|notes?|attributes)\s*:\s*$", re.I)
_ITEM = re.compile(r"^[\w*]+(?:\s*\([^)]*\))?\s*:\s+")
_WORD = re.compile(r"[^\W\d_]+", re.U)
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
#: Sentence ends; also places where a sentence starts without one before it, as in comments joined to one line.
_SENTENCE = re.compile(
    r"(?<=[.!?;{}])\s+(?=\S)|(?<=[。！？；])|\s[-=*#~_]{3,}\s|^[-=*#~_/]{3,}\s+"
    r"|(?<=[A-Za-z0-9)])\s+(?=[A-Z]\w*[a-z]\w*\s+[a-z0-9])|(?<=[A-Za-z0-9)])\s+(?=[a-z]+_\w+\s+[a-z]+\s+[a-z])"
    r"|(?<=[A-Za-z0-9).])\s+(?=[\u4e00-\u9fff])|(?<=[\u4e00-\u9fff])\s+(?=[A-Z])"
)
_CODE = re.compile(
    r"""(?:.*[;{}]\s*$                                             # statement or brace at the end
      |[\])}({\[,;:.]*$                                            # punctuation only
      |>>>.*|\.\.\.\s.*
      |[\w.\[\]"'>*&-]+(?:\s*,\s*[\w.\[\]"'*&]+)*(?::\s*\w+)?\s*(?::=|[-+*/%|&^]?=(?!=)|<<=?|>>=?)\s*\S+.*
      |(?:\+\+|--)\w+|\w+(?:\+\+|--)
      |[A-Za-z_][\w.]*(?:::\w+)*(?:->\w+)?\([^()]*(?:\([^()]*\)[^()]*)*\)[:;,]?
      |\w+\([^)]*\)\s+for\s+\w+\s+in\s+.*
      |(?:if|elif|for|while|with|switch|try|else|except|finally|case|default|catch|def|class|func|async|match)\b[^.]*[:{]\s*
      |(?:return|break|continue|pass|yield|raise|del|global|goto|defer|go|throw)(?:\s+[^\s.]+)?
      |(?:return|assert|raise|yield|throw)\s+\S*[=!<>()\[\]+*/%"'].*
      |(?:import|from|package|using|include|\#include)\s+[\w.<>"/:]+(?:\s+import\s+.*)?
      |(?:const|var|let|auto|int|long|static|void|bool|char|float|double|string|unsigned|type)\s+[\w*&<>:\[\]]+(?:\s*(?:=|\(|\[|:=|struct|int|string).*)
      |log\.\w+\(.*|\}\s*else.*|@\w+(?:\([^)]*\))?)$""",
    re.X,
)


def strip_markup(comment: str) -> list[str]:
    """The text lines of a comment or docstring without comment marks."""
    out = []
    for line in comment.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = line.strip()
        if s.startswith(("///", "//!")):
            s = s[3:]
        elif s.startswith("//"):
            s = s[2:]
        elif s.startswith("#") and not s.startswith("#include"):
            s = s.lstrip("#!:")
        else:
            if s.startswith(("/**", "/*!")):
                s = s[3:]
            elif s.startswith("/*"):
                s = s[2:]
            elif s.startswith("*") and not s.startswith("*/"):
                s = s[1:]
        s = s.strip()
        if s.endswith("*/"):
            s = s[:-2]
        out.append(s.strip().lstrip("<").strip())
    return out


def words_of(text: str) -> list[str]:
    """Lower-case words; identifiers are cut at case changes and underscores."""
    found = []
    for w in _WORD.findall(text):
        found += [p.lower() for p in _CAMEL.findall(w)] if w.isascii() and not w.islower() and not w.isupper() else [w.lower()]
    return found


def _known(word: str, stems: frozenset[str]) -> bool:
    if word in EMPTY_WORDS or word in stems:
        return True
    for end in ("s", "es", "ed", "d", "ing", "er", "or", "ies"):
        if word.endswith(end) and (word[: -len(end)] in stems or word[: -len(end)] + "e" in stems or word[: -len(end)] + "y" in stems):
            return True
    return False


def _sentence_tells(sentence: str, stems: frozenset[str], least: int) -> bool:
    s = sentence.strip().strip("-=*#~_.:'\"` \t")
    if not s or REMINDER.match(s) or DIRECTIVE.match(s) or LICENCE.match(s):
        return False
    cjk = _CJK.findall(s)
    if len(cjk) >= 4:
        return not (POINTER.match(s) and len(cjk) < 9)
    words = words_of(s)
    if POINTER.match(s) and len(words) <= 9:
        return False
    if cjk and (s in EMPTY_CJK or not words):
        return False
    fresh = [w for w in words if len(w) > 1 and not _known(w, stems)]
    return len(words) >= least and len(fresh) >= 2 or least <= 2 and len(fresh) >= 1 and len(words) >= 3


def informative(comment: str | None, name: str | None) -> bool:
    """True if any sentence describes something beyond the name.

    Reminders, separators, tool directives, licence text, disabled code, pointers elsewhere and
    restated names are trivial, whatever their length. A short phrase in a parameter or return
    field is trivial, a sentence there is not. Null and blank comments are trivial.
    """
    if not comment or not comment.strip():
        return False
    stems = frozenset(words_of(name or ""))
    field = licence = False
    for line in strip_markup(comment):
        if not line:
            licence = False
            continue
        if _SECTION.match(line):
            field, licence = True, False
            continue
        if licence and re.match(r"(?:you may|under the|see the|this (?:file|program|software)|the software|without|distributed)", line, re.I):
            continue
        tagged = _TAG.sub("", line)
        own = _FIELD.match(tagged)
        text = tagged[own.end() :] if own else tagged
        if field and not own:
            text = _ITEM.sub("", text)
        if _is_code(text):
            continue
        least = 4 if own or field else 2
        for part in _SENTENCE.split(text):
            if LICENCE.search(part):
                licence = True
            elif not _is_code(part.strip()) and _sentence_tells(part, stems, least):
                return True
    return False


def _is_code(text: str) -> bool:
    if _CJK.search(text):
        return bool(re.match(r">>>|.*[;{}]$", text))
    if len(_SENTENCE.split(text)) > 1 and re.search(r"\b[A-Z][a-z]+ [a-z]+ [a-z]+ [a-z]+", text):
        return False  # code and prose joined: judged part by part
    return bool(_CODE.match(text))
