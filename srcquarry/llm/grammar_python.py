"""Syntax of Python 3 source files, by the interpreter's own parser."""

from __future__ import annotations

import ast
import symtable
import warnings


def valid(text: str) -> bool:
    """Whether the text is a syntactically valid Python 3 file.

    Building a symbol table needs no objects for the tree and is faster; the few texts it rejects are
    parsed once more, because it also rejects some texts that are syntactically valid.
    """
    text = text.removeprefix("\ufeff")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            symtable.symtable(text, "f", "exec")
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
            pass
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
            return False
