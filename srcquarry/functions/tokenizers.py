"""Token counters for slicing. A counter is built once per task from a vocabulary file whose path is a parameter."""

from __future__ import annotations

import os
from collections.abc import Callable

DEFAULT_FILE = os.environ.get("SRCQUARRY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def bpe_counter(path: str = DEFAULT_FILE) -> Callable[[], Callable[[str], int]]:
    """A maker of counters for a tokenizer file; truncation and padding stored in the file are switched off."""

    def make() -> Callable[[str], int]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        return lambda text: len(tokenizer.encode(text).ids)

    return make
