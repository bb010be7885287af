"""Sizes of texts in tokens of a public byte-level BPE tokenizer.

The tokenizer cuts a text at a fixed pattern and merges bytes inside each
piece only, so a text's size is the sum over its pieces.  Pieces repeat far
more than texts do; each Python worker keeps the sizes of those it has seen.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

#: Folder of the vocabulary files, and the file used unless told otherwise.
VOCABULARIES = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same cuts with the faster module of the standard library.  Its classes
#: differ for numbers that aren't decimal digits and four control characters;
#: texts with one of these take the exact pattern.
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_KEEP = 400_000


@lru_cache(None)
def _odd() -> frozenset[str]:
    odd = (c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) in ("No", "Nl") or (c.isnumeric() and not c.isdecimal()))
    return frozenset("\x1c\x1d\x1e\x1f").union(odd)


class Sizes(dict):
    """Sizes of pieces; an unknown piece is encoded, short ones are kept."""

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 40:
            if len(self) >= _KEEP:
                self.clear()
            self[piece] = n
        return n


class Tokenizer:
    """A vocabulary with its sizes cache; one per worker and file."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = regex.compile(PATTERN)
        self.sizes = Sizes(self.encoding)

    def pieces(self, text: str) -> list[str]:
        """The pieces of the text; together they are the text."""
        return (_FAST if _odd().isdisjoint(text) else self.exact).findall(text)

    def count(self, text: str | None) -> int:
        return sum(map(self.sizes.__getitem__, self.pieces(text))) if text else 0


@lru_cache(4)
def tokenizer(folder: str = VOCABULARIES, name: str = VOCABULARY) -> Tokenizer:
    return Tokenizer(os.path.join(folder, name))


def token_count(text: Column, folder: str = VOCABULARIES, name: str = VOCABULARY) -> Column:
    """The number of tokens of a text; 0 for null and empty ones."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(folder, name)
        for batch in batches:
            yield pd.Series([tok.count(x) for x in batch], dtype="int32")

    return count(text)
