"""Bottom-up checking of bracketed token skeletons.

A source text is cut into tokens by one pattern and every token becomes one symbol. Bracket groups are
then reduced from the inside out: the contents of a group, in which inner groups are already single
symbols, are a flat text, so each way of reading a group is a regular expression. The symbol that
replaces a group carries the set of readings its contents allow.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from copy import copy

_INNER = re.compile(r"([(\[{])([^()\[\]{}]*)([)\]}])")
_PAIR = {"(": ")", "[": "]", "{": "}"}
_BASE = {"(": 0xE000, "[": 0xE100, "{": 0xE200}
#: Skeletons of groups up to this length are remembered.
MEMO_LENGTH = 160
MEMO_SIZE = 100_000


def symbols(bracket: str, bit: int, bits: int = 6) -> str:
    """A character class of the group symbols of ``bracket`` whose readings include ``bit``."""
    base = _BASE[bracket]
    return "[" + "".join(chr(base + m) for m in range(1 << bits) if m & bit) + "]"


class TokenSymbols(dict):
    """Token text to symbol, computed once per distinct token."""

    def __init__(self, classify: Callable[[str], str]):
        super().__init__()
        self.classify = classify

    def __missing__(self, token: str) -> str:
        symbol = self.classify(token)
        if len(self) > MEMO_SIZE:
            self.clear()
        if len(token) < 64:
            self[token] = symbol
        return symbol


class Unreadable(Exception):
    """A bracket group that has no reading: the text cannot be valid, whatever stands around the group."""


#: Tokens of the start of a text that are looked at alone: a foreign token or unreadable group there settles the matter.
START_TOKENS = (32, 128)


class Reducer:
    """Reduces all bracket groups of a skeleton.

    ``readings`` has (bit, view, pattern) per bracket; a view is a rewriting of the contents that patterns are
    matched on, such as the one in which operands are single symbols. Small views keep the patterns small.
    """

    def __init__(self, readings: dict[str, list[tuple[int, str, str]]], views: dict[str, Callable[[str], str]], *tidies: Callable[[str], str]):
        self.readings = {b: [(bit, view, re.compile(p)) for bit, view, p in rs] for b, rs in readings.items()}
        self.views = views
        self.tidies = tidies or (str,)
        self.memo: dict[str, str] = {}

    def with_tidies(self, *tidies: Callable[[str], str]) -> "Reducer":
        """The same readings behind other tidyings of the contents."""
        other = copy(self)
        other.tidies, other.memo = tidies, {}
        return other

    def group(self, m: re.Match) -> str:
        whole = m[0]
        known = self.memo.get(whole)
        if known is not None:
            return known
        bracket, inside, end = m[1], m[2], m[3]
        mask = 0
        if _PAIR[bracket] == end:
            for tidy in self.tidies:  # a later one counts only where the earlier ones leave no reading
                tidied = tidy(inside)
                seen: dict[str, str] = {}
                for bit, view, pattern in self.readings[bracket]:
                    if view not in seen:
                        seen[view] = self.views[view](tidied)
                    if pattern.fullmatch(seen[view]):
                        mask |= bit
                if mask:
                    break
        if not mask:
            raise Unreadable
        symbol = chr(_BASE[bracket] + mask)
        if len(whole) <= MEMO_LENGTH:
            if len(self.memo) > MEMO_SIZE:
                self.memo.clear()
            self.memo[whole] = symbol
        return symbol

    def reduce(self, skeleton: str) -> str | None:
        """The skeleton without brackets, or None if a group cannot be read or brackets do not match."""
        shorter = self.start(skeleton)
        return None if shorter is None or re.search(r"[()\[\]{}]", shorter) else shorter

    def start(self, skeleton: str) -> str | None:
        """The skeleton of the start of a text with all whole groups reduced, or None if one of them cannot be read."""
        try:
            while True:
                skeleton, n = _INNER.subn(self.group, skeleton)
                if not n:
                    return skeleton
        except Unreadable:
            return None
