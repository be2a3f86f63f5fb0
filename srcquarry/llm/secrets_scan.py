"""Recognition of credentials in one text: names, notations, encoded layers, key containers."""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote_to_bytes


class Hit(NamedTuple):
    start: int
    end: int
    kind: str


# Public shapes of credentials that need no name beside them.
_SHAPES = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?P<aws>A(?:KIA|SIA)[A-Z0-9]{16})(?![A-Za-z0-9])"
    r"|(?P<token>gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[\w-]{12,}|sk-[A-Za-z0-9_-]{20,}"
    r"|[a-z]{2}_(?:live|test|prod)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}|AIza[\w-]{30,}|(?P<short>[a-z]{2,6}[.-])[A-Za-z0-9_-]{20,})"
    r"|(?P<jwt>eyJ[\w-]{6,}\.eyJ[\w-]{6,}(?:\.[\w-]*)?)"
    r")"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[0-9+.-]*+([A-Za-z][A-Za-z0-9+.-]*+://[^\s\"'`<>\\]+)")
_USERINFO = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^:@/?#\s]*):(.+)@[^@/?#\s]+(?:[/?#]|$)")
_QUERY = re.compile(
    r"[?&#;](?:[\w.-]*(?:token|secret|password|passwd|pwd|apikey|api[_-]key|access[_-]key|signature)|sig|key|auth|code)=([^&#\s]+)", re.I
)
_HOOK = re.compile(r"/(?:hooks?|webhooks?|services)/(?:[A-Z0-9]{6,}/)+([A-Za-z0-9_-]{16,})")
_SCHEME = re.compile(r"\b(Bearer|Basic|Token|ApiKey)\s+([A-Za-z0-9+/=._~-]{6,})")
_CLI = re.compile(r"(?:^|\s)(?:-u|--user)[ =]+[\"']?([^\s:\"']+):([^\s\"']+)")
_CLI_NAME = re.compile(r"(?:^|\s)--?((?:[\w-]*-)?(?:password|passwd|token|secret|api-?key))(?:[ =]+)[\"']?([^\s\"']+)")
_PROSE = re.compile(
    r"[`'\"]([^`'\"\s]{4,})[`'\"]\s+(?:as|is|for)\s+(?:the|its|your|a)\s+(?:\w+\s+)?(?:password|passphrase|secret|token|key|credential)\b"
    r"|\b(?:password|passphrase|secret|token|api key|credential|passwd|pwd)\s+(?:is|was|=|remains|stays|of|to)\s+[`'\"]([^`'\"\s]{4,})[`'\"]",
    re.I,
)
_HOT = re.compile(
    r"[Pp]ass|PASS|[Pp]wd|PWD|[_.-][Pp]w\b|Pw\b|PW\b|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Kk]ey\b|KEY\b|[Cc]red|CRED|[Aa]uth|AUTH|[Ll]ogin\b|LOGIN\b"
)
_NAME_CHARS = re.compile(r"[\w.-]*")
_STRING = re.compile(
    r"(?:[rRbBuUfF]{1,2}|L|u8|@|\$)?(?:R\"([^()\\\s]{0,16})\((?P<raw>.*?)\)\1\""
    r"|\"\"\"(?P<t1>.*?)(?:\"\"\"|\Z)|'''(?P<t2>.*?)(?:'''|\Z)|`(?P<bt>[^`]*)(?:`|\Z)"
    r"|\"(?P<dq>(?:[^\"\\\n]|\\.)*)(?:\"|(?=\n)|\Z)|'(?P<sq>(?:[^'\\\n]|\\.)*)(?:'|(?=\n)|\Z))",
    re.S,
)
_JOIN = re.compile(r"\s*(?:\+\s*|\.\s+|\\\r?\n\s*)?(?=[\"'`]|[rRbBuUfF]{1,2}[\"'])")
_AFTER_NAME = re.compile(
    r"(?P<q>[\"']?)(?P<c>\s*=?\s*\*/)?\]?\s*(?P<t>(?:\[\]|\[\d*\]|:\s*[\w.\[\]| ]{2,24}(?==)))?\s*(?P<op>:=|=>|=(?!=)|:(?!:)|,)?\s*(?P<w>(?:(?:\[\]byte|byte|bytes|string|str|String|std::string)\s*[({])?)\s*"
)
_BARE = re.compile(r"[^\s\"'`<>|]+")
_PLACEHOLDER = re.compile(
    r"(?i)(?:<[^>]*>|\$\{?[\w.]*\}?|\$\([^)]*\)|%\(?\w*\)?[sd]?|\{\{?[^}]*\}?\}|\[[\w ]*\]|__\w*__|#\{.*\})\.?$"
    r"|.*(?:changeme|change[_-]me|change[_-]this|placeholder|redacted|your[_-]|[_-]here$|put[_-]|insert[_-]|xxxx|\*\*\*|\.\.\.|not[_-]?set|undefined"
    r"|(?<![a-z])(?:example|dummy|sample|replace|todo|fixme)(?![a-z]))"
    r"|(?:none|null|nil|true|false|test|foo|bar|secret|password|token|key|empty|default|unset|n/?a)$"
    r"|(.)\1*$"
)
_WORD_ONLY = re.compile(r"[A-Za-z]+(?:[-_ ./:][A-Za-z]+)*$")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

# Words of names that hold, or do not hold, a credential.
_HEADS = frozenset("password passwd pwd passphrase pass pw secret secrets token apikey credential credentials cred creds login passcode".split())
_KEYED = frozenset("api secret service access private signing auth encryption master account client deploy admin license webhook hmac".split())
_NOT_BEFORE = frozenset("public pad mask eos bos unk sep cls max num min next prev previous cur current first last stop start begin end special total n count csrf".split())
_GLUED = re.compile(
    r"(?:api|secret|service|access|private|signing|auth|encryption|master|account|client|deploy|admin|license|webhook|hmac|db|smtp|root|refresh|bearer|user)"
    r"(?:password|passwd|passphrase|pwd|pass|pw|secret|token|key|credentials?|creds)$"
)
_ASSIGNED = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*(?::=|=(?!=))\s*(?=[\"'`])")
_USED = re.compile(r"\(\s*([A-Za-z_]\w*)\s*\)")
_READERS = frozenset("read get load fetch lookup find resolve decode env getenv require ask prompt hash check verify mask is has".split())


@lru_cache(maxsize=65536)
def secret_name(name: str) -> int:
    """2: the name says that its value is a credential; 1: it may be one; 0: it is none."""
    words = [w.lower() for w in _PARTS.findall(name)]
    while len(words) > 1 and (words[-1].isdigit() or words[-1] in ("value", "default", "prod", "dev", "live", "old", "new")):
        words.pop()
    if not words or any(w in _NOT_BEFORE for w in words):
        return 0
    last = words[-1]
    if last == "key":
        return 2 if len(words) > 1 and words[-2] in _KEYED | _HEADS else 1
    if last == "auth" or last == "authorization":
        return 1
    if last in _HEADS:
        return 1 if len(words) == 1 and last in ("token", "login", "pass", "cred", "creds") else 2
    return 2 if _GLUED.match(last) else 0


def placeholder(value: str) -> bool:
    return not value or bool(_PLACEHOLDER.match(value))


def _mixed(value: str) -> int:
    """How many kinds of characters the value has: lower, upper, digit, other."""
    return (
        any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value) + any(not c.isalnum() for c in value)
    )


def _random(value: str) -> bool:
    """A long token without words: letters and digits mixed all along."""
    return len(value) >= 16 and bool(re.match(r"[A-Za-z0-9+/=_.~-]+$", value)) and any(c.isdigit() for c in value) and _mixed(value) >= 2 and not _WORD_ONLY.match(value)


def _scrambled(value: str) -> bool:
    """Letters only, but in no case pattern of words: several runs of capitals among small letters."""
    return len(value) >= 14 and value.isalpha() and sum(c.islower() for c in value) * 4 >= len(value) and len(re.findall(r"[A-Z]{2,}", value)) >= 2


def credible(value: str, sure: int) -> bool:
    """Whether a value beside a secret-bearing name can grant access."""
    v = value.strip()
    if _scrambled(v) and not placeholder(v):
        return True
    if len(v) < 4 or placeholder(v) or _WORD_ONLY.match(v) or any(c.isspace() for c in v):
        return False
    if re.match(r"[-+]?[\d.,_]+%?$", v) or re.match(r"(?:https?|file)://", v) or re.match(r"(?:[\w.-]*/)+[\w.-]*$", v) and not _random(v.replace("/", "")):
        return False
    if re.match(r"(?:ssh-(?:rsa|ed25519|dss)|ecdsa-)", v) or re.match(r"sha\d{3}-", v) or re.match(r"v?\d+\.\d+(\.\d+)?$", v):
        return False
    if sure >= 2:
        return _mixed(v) >= 2
    return _random(v) or _mixed(v) >= 3 and any(c.isdigit() for c in v) and len(v) >= 6


# --- key containers -----------------------------------------------------------------------------


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of one DER element, or None."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


# Object identifiers of password-based encryption (PKCS#5, PKCS#12) and of PKCS#7 data and signed data.
_PBE = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
_CONTENT = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x07\x01", b"\x2a\x86\x48\x86\xf7\x0d\x01\x07\x02")


_OPENSSH = b"openssh-key-v1\0"


def _openssh(data: bytes) -> bool:
    """Whether bytes are an OpenSSH private key, or its start: cipher, derivation and its options, number of keys, public keys, private part."""
    at, end = len(_OPENSSH), len(data)

    def string(most: int) -> bytes | None:
        """The next length-prefixed field, cut off where the data end; None if its length cannot be."""
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big") if at + 4 <= end else 0
        if size > most:
            return None
        field, at = data[at + 4 : at + 4 + size], at + 4 + size
        return field

    for most in (64, 64):  # names
        name = string(most)
        if name is None or not all(33 <= b < 127 for b in name):
            return False
    if string(1 << 12) is None:
        return False
    keys = int.from_bytes(data[at : at + 4], "big") if at + 4 <= end else 1
    at += 4
    return 1 <= keys <= 64 and all(string(1 << 16) is not None for _ in range(min(keys, 64))) and string(1 << 24) is not None


def key_container(data: bytes) -> str | None:
    """The kind of private key a binary text holds, by its grammar: PKCS#1, PKCS#8 also encrypted, PKCS#12, SEC1 in DER, OpenSSH also cut off."""
    if data.startswith(_OPENSSH):
        return "openssh" if _openssh(data) else None
    top = _der(data, 0, len(data))
    if not top or top[0] != 0x30 or len(data) - top[2] > 4 or top[2] - top[1] < 24:
        return None
    first = _der(data, top[1], top[2])
    if first and first[0] == 0x30:
        inner, second = _der(data, first[1], first[2]), _der(data, first[2], top[2])
        sealed = inner and inner[0] == 0x06 and data[inner[1] : inner[2]].startswith(_PBE)
        return "encrypted" if sealed and second and second[0] == 0x04 else None
    if not first or first[0] != 0x02 or first[2] - first[1] != 1:
        return None
    version, second = data[first[1]], _der(data, first[2], top[2])
    if not second:
        return None
    if version == 3 and second[0] == 0x30:
        inner = _der(data, second[1], second[2])
        return "pkcs12" if inner and inner[0] == 0x06 and data[inner[1] : inner[2]] in _CONTENT else None
    if version in (0, 1) and second[0] == 0x30:
        inner = _der(data, second[1], second[2])
        third = _der(data, second[2], top[2])
        return "pkcs8" if inner and inner[0] == 0x06 and third and third[0] == 0x04 else None
    if version in (0, 1) and second[0] == 0x02:
        return "pkcs1"
    return "sec1" if version == 1 and second[0] == 0x04 else None


# --- encoded layers -----------------------------------------------------------------------------

_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9_-]{16,}={0,2})(?![A-Za-z0-9+/_=-])")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{16,}+|[0-9A-F]{16,}+)(?![A-Za-z0-9])")
# Runs of base64 or hex that go on in the next line or in the next literal joined to theirs.
_JOINED = re.compile(
    r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+"
    r"(?:(?:(?:\\n)?[\"'`]\s*+(?:\+\s*+|\.\s++|\\\r?\n\s*+)?[rRbBuUfF]{0,2}[\"'`]|(?:\\r)?(?:\\n)?\\?\r?\n[ \t]*+(?=[A-Za-z0-9+/_-]++={0,2}[ \t]*(?:\r?\n|\Z|[\"'`\\]))|\\n)"
    r"[A-Za-z0-9+/_-]++)++={0,2}"
)
_JOINED_SEP = re.compile(r"(?:\\[rn]|[\"'`])[^A-Za-z0-9]*[rRbBuUfF]{0,2}[\"'`]|(?:\\[rn])+\s*|\\?\r?\n[ \t]*")
_PCT = re.compile(r"(?:[\w.~!*'()-]++|%[0-9A-Fa-f]{2})++")
_PCT_CORE = re.compile(r"(?:%[0-9A-Fa-f]{2}){3}")
_ESC = re.compile(r"(?:[\w .:/@+=-]++|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[0-7]{3})++")
_ESC_CORE = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[0-7]{3}){4}")
_ESC_ONE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\([0-7]{3})")


def _printable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\r\n\t" for c in text) else None


def _unbase64(s: str) -> bytes | None:
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _runs(text: str, run: re.Pattern, core: re.Pattern):
    """Matches of ``run`` that hold a ``core``, in linear time however long they are."""
    return (m for m in run.finditer(text) if core.search(text, m.start(), m.end())) if core.search(text) else ()


def _decoded(text: str):
    """(start, end, bytes) of the encoded literals of a text."""
    for m in _B64.finditer(text):
        data = _unbase64(m[0])
        if data and (data[:1] == b"0" or data[:4] == b"open" or _printable(data)):
            yield m.start(), m.end(), data
    for m in _HEX.finditer(text):
        data = bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 else b""
        if data[:1] == b"0" or _printable(data):
            yield m.start(), m.end(), data
    if "%" in text:
        for m in _runs(text, _PCT, _PCT_CORE):
            yield m.start(), m.end(), unquote_to_bytes(m[0])
    if "\\" in text:
        for m in _runs(text, _ESC, _ESC_CORE):
            plain = _ESC_ONE.sub(lambda x: chr(int(x[1] or x[2], 16) if x[1] or x[2] else int(x[3], 8)), m[0])
            yield m.start(), m.end(), plain.encode("utf-8", "surrogatepass")


def _joined(text: str):
    """(spans, bytes) of encoded runs wrapped over lines or joined from several literals."""
    for m in _JOINED.finditer(text):
        spans, at = [], m.start()
        for sep in _JOINED_SEP.finditer(text, m.start(), m.end()):
            spans.append((at, sep.start()))
            at = sep.end()
        spans.append((at, m.end()))
        whole = "".join(text[a:b] for a, b in spans)
        data = bytes.fromhex(whole) if len(whole) % 2 == 0 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", whole) else None
        for found in (data, _unbase64(whole)):
            if found:
                yield spans, found


_ARMOUR = re.compile(r"^[\w-]+: [^\n]*$|^\s*(?://+|[#*]+)|[\"'`][\s+.,;()\\]*[\"'`]?|\\[nrt]|[\s,;()|>*#\\-]+", re.M)
_MATERIAL = re.compile(r"[A-Za-z0-9+/=_]+")


def pem_kind(body: str) -> str | None:
    """The kind of key between the markers of a PEM block.

    The body is freed of header lines, quotes, escapes and signs of comments and joins, decoded and read by the
    grammars of key containers. 'pem' is a body of key material in no known container, as in blocks cut off; None
    is a body of other text.
    """
    lines = [x for x in _ARMOUR.split(body.replace("\\n", "\n").replace("\\r", "")) if x]
    material = [x for x in lines if _MATERIAL.fullmatch(x)]
    whole = "".join(material)
    data = _unbase64(whole)
    kind = key_container(data) if data else None
    if kind:
        return kind
    long = sum(len(x) for x in material if len(x) >= 16 and not x.isalpha())
    return "pem" if long and long >= 0.7 * sum(map(len, lines)) else None


def _layers_hold(data: bytes) -> bool:
    """Whether an opened literal holds a credential in any layer. A layer has fewer characters than its literal, so this ends."""
    todo = [data]
    while todo:
        data = todo.pop()
        if key_container(data):
            return True
        text = _printable(data)
        if text and len(text) >= 6:
            if _plain(text, None):
                return True
            todo += [inner for _, _, inner in _decoded(text) if inner]
            todo += [inner for _, inner in _joined(text)]
    return False


# --- scanning -----------------------------------------------------------------------------------


def _literals(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of the contents of the string literals joined from ``at`` on, and the end of the last."""
    spans = []
    m = _STRING.match(text, at)
    while m:
        group = next((g for g in ("raw", "t1", "t2", "bt", "dq", "sq") if m[g] is not None), None)
        if group is None or m.end() == at:
            break
        spans.append(m.span(group))
        at = m.end()
        j = _JOIN.match(text, at)
        m = _STRING.match(text, j.end()) if j else None
        if m and j and "\n" in j[0] and not (j[0].strip() or text[spans[0][0] - 1 : spans[0][0]] == '"'):
            break
    return spans, at


def _assignments(text: str) -> dict[str, list[tuple[int, int]]]:
    """Where each variable is given a string literal: (place of the name, place of the literal)."""
    found: dict[str, list[tuple[int, int]]] = {}
    for m in _ASSIGNED.finditer(text):
        found.setdefault(m[1], []).append((m.start(), m.end()))
    return found


def _used(text: str, name: str, variable: str, before: int, sure: int, assigned: dict[str, list[tuple[int, int]]]) -> list[Hit]:
    """The literal last assigned to a variable that is handed to a function whose name says what it takes."""
    if _PARTS.findall(name)[0].lower() in _READERS:
        return []
    places = assigned.get(variable, ())
    k = bisect_left(places, (before, 0))
    if not k:
        return []
    spans, _ = _literals(text, places[k - 1][1])
    if not spans or not credible("".join(text[a:b] for a, b in spans), sure):
        return []
    return [Hit(a, b, "more" if i else "named") for i, (a, b) in enumerate(x for x in spans if x[1] > x[0])]


def _named(text: str, code: bool) -> list[Hit]:
    """Values beside names that say they are credentials."""
    hits, done, assigned = [], -1, None
    for hot in _HOT.finditer(text):
        if hot.start() < done:
            continue
        left = hot.start()
        while left and (text[left - 1].isalnum() or text[left - 1] in "_-"):
            left -= 1
        right = _NAME_CHARS.match(text, hot.end()).end()
        while right > hot.end() and text[right - 1] in ".-":
            right -= 1
        name = text[left:right].strip("-_.")
        done = right
        sure = secret_name(name)
        if not sure:
            continue
        use = _USED.match(text, right)
        if use:
            if assigned is None:
                assigned = _assignments(text)
            hits += _used(text, name, use[1], left, sure, assigned)
            continue
        quoted = left > 0 and text[left - 1] in "\"'"
        m = _AFTER_NAME.match(text, right)
        op = m["op"]
        in_comment = m["c"] is not None
        if not op and not in_comment or op == "," and not (quoted and m["q"]):
            continue
        at = m.end()
        if text[at : at + 1] in ("\"", "'", "`") or _STRING.match(text, at) and text[at : at + 1] in "rRbBuUfFL@":
            spans, _ = _literals(text, at)
            value = "".join(text[a:b] for a, b in spans)
            body = re.sub(r"^(?:Bearer|Basic|Token)\s+", "", value)
            if body != value:
                continue  # told by its scheme
            if spans and credible(value, sure) and not _PEM.search(value):
                parts = [(a, b) for a, b in spans if b > a]
                hits += [Hit(a, b, "more" if i else "named") for i, (a, b) in enumerate(parts)]
                done = max(done, spans[-1][1])
            continue
        if quoted or m["w"] or op not in ("=", ":"):
            continue
        line_start = text.rfind("\n", 0, left) + 1
        before = text[line_start:left]
        comment = re.match(r"\s*(?:#|//|/?\*|--|;|<!--)", before) is not None
        if "\n" in text[right:at]:
            continue
        if code and not comment:
            continue
        if not code and not comment and not re.match(r"\s*(?:[-*>|]\s*)*(?:export\s+|set\s+|env\s+)?[`\"']?$", before):
            continue
        bare = _BARE.match(text, at)
        if bare:
            value = bare[0].rstrip(",;")
            rest = text[bare.end() : text.find("\n", bare.end()) if "\n" in text[bare.end() :] else len(text)].strip(" \t\r*/->")
            if rest and comment and not re.match(r"[#(]", rest):
                continue
            strong = 2 if sure == 2 or comment else 1
            if credible(value, strong) and "(" not in value:
                hits.append(Hit(at, at + len(value), "named"))
                done = max(done, at + len(value))
    return hits


_HASH_COMMENT = re.compile(_STRING.pattern + r"|(?P<comment>#[^\n]*)", re.S)
_SLASH_COMMENT = re.compile(
    r"R\"([^()\\\s]{0,16})\(.*?\)\1\"|`[^`]*(?:`|\Z)|\"(?:[^\"\\\n]|\\.)*+(?:\"|(?=\n)|\Z)|(?<![0-9A-Za-z_])'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z)"
    r"|(?P<comment>//[^\n]*(?:\n[ \t]*//[^\n]*)*|/\*.*?(?:\*/|\Z))",
    re.S,
)


def _prose(text: str, language: str | None) -> list[Hit]:
    """Values told in prose: anywhere in prose, in the comments of code."""
    found = [(m, 1 if m[1] else 2) for m in _PROSE.finditer(text)]
    if found and language not in (None, "markdown"):
        comment = _HASH_COMMENT if language == "python" else _SLASH_COMMENT
        spans = [m.span("comment") for m in comment.finditer(text) if m["comment"] is not None]
        found = [(m, g) for a, b in spans for m in _PROSE.finditer(text, a, b) for g in (1 if m[1] else 2,)]
    return [Hit(m.start(g), m.end(g), "prose") for m, g in found if credible(m[g], 2)]


def _plain(text: str, language: str | None) -> list[Hit]:
    """Spans of the credentials that stand in a text as they are, in any order."""
    code = language not in (None, "markdown")
    hits: list[Hit] = []
    if "PRIVATE KEY" in text:
        at = 0
        while m := _PEM.search(text, at):
            end = _PEM_END.search(text, m.end())
            stop = end.end() if end else len(text)
            if not end:
                quote = re.compile(r"\"\"\"|'''|`|\n\s*\n").search(text, m.end())
                stop = quote.start() if quote else stop
            if not end and not text[m.end() :].strip(" \t\r\n\\n\"'"):
                hits.append(Hit(m.start(), m.end(), "pem"))  # the text ends here, the key goes on elsewhere
            elif pem_kind(text[m.end() : end.start() if end else stop]):
                hits.append(Hit(m.start(), stop, "pem"))
            at = stop
    for m in _SHAPES.finditer(text):
        v = m[0]
        if re.search(r"(?i)x{6,}|(.)\1{7,}|example|your", v) or m["token"] and not any(c.isdigit() for c in v):
            continue
        if m["short"] and not re.match(r"(?=.*[a-z])(?=.*[A-Z])(?=.*\d)", v[len(m["short"]) :]):
            continue
        hits.append(Hit(m.start(), m.end(), "aws" if m["aws"] else "jwt" if m["jwt"] else "token"))
    if "://" in text:
        for m in _URL.finditer(text):
            url, at = m[1].rstrip(".,;)"), m.start(1)
            u = _USERINFO.match(url)
            if u and not placeholder(u[2]) and len(u[2]) >= 3 and not re.match(r"[$<{%]", u[2]):
                hits.append(Hit(at + u.start(2), at + u.end(2), "url"))
            for q in _QUERY.finditer(url):
                if credible(q[1], 1):
                    hits.append(Hit(at + q.start(1), at + q.end(1), "url"))
            h = _HOOK.search(url)
            if h and (_mixed(h[1]) >= 2 or _scrambled(h[1])) and not placeholder(h[1]):
                hits.append(Hit(at + h.start(1), at + h.end(1), "url"))
    if "Bearer" in text or "Basic" in text or "Token " in text or "ApiKey" in text:
        for m in _SCHEME.finditer(text):
            v = m[2]
            if m[1] == "Basic":
                data = _unbase64(v)
                pair = _printable(data) if data else None
                if pair and ":" in pair and not placeholder(pair.split(":", 1)[1]):
                    hits.append(Hit(m.start(2), m.end(2), "header"))
            elif credible(v, 1) and (_random(v) or _scrambled(v)):
                hits.append(Hit(m.start(2), m.end(2), "header"))
    if "-u" in text or "--" in text:
        for m in _CLI.finditer(text):
            if not placeholder(m[2]) and len(m[2]) >= 4 and not m[2].startswith("$"):
                hits.append(Hit(m.start(2), m.end(2), "cli"))
        for m in _CLI_NAME.finditer(text):
            if credible(m[2], 2):
                hits.append(Hit(m.start(2), m.end(2), "cli"))
    hits += _named(text, code)
    hits += _prose(text, language)
    return hits


def scan(text: str, language: str | None) -> list[Hit]:
    """Spans of the credentials of a text, in order, without overlaps.

    ``language`` None or 'markdown' allows bare values after a name and values told in prose; in code these
    count in comments only. Encoded literals are opened layer by layer, however many there are, and scanned again: a literal
    that holds a credential in any layer is one itself. The spans of a value joined from several literals
    follow each other with kind 'more' after the first.
    """
    if not text:
        return []
    hits = _plain(text, language)
    for spans, data in _joined(text):
        if _layers_hold(data):
            hits += [Hit(a, b, "more" if i else "encoded") for i, (a, b) in enumerate(spans)]
    for a, b, data in _decoded(text):
        if data and _layers_hold(data):
            hits.append(Hit(a, b, "encoded"))
    hits.sort(key=lambda h: (h.start, -h.end))
    kept: list[Hit] = []
    for h in hits:
        if kept and h.start < kept[-1].end:
            if h.end > kept[-1].end:
                kept[-1] = kept[-1]._replace(end=h.end)
            continue
        kept.append(h)
    return kept
