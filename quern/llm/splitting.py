"""Splitting oversized texts at natural boundaries.

A text above the limit is cut at the strongest boundary near its middle, and
so are its halves as long as they exceed the limit less the overlap.  Then
every piece but the first gets the tokens before it.  A text is one row, so the
work is a projection: no shuffle, and no group to skew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quern.llm.tokens import VOCABULARIES, VOCABULARY, Tokenizer, tokenizer

_NEWLINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_OTHER, _CLAUSE, _STOP, _BLANK, _LINE, _LINES = range(6)
#: Room for the tokens that a cut inside a word may add when pieces are encoded alone.
SLACK = 4


class _Kinds(dict):
    """What a piece of the tokenizer's pattern is to a boundary; 8 is added if it starts with white space."""

    def __missing__(self, piece: str) -> int:
        if piece.isspace():
            lines = len(_NEWLINE.findall(piece))
            kind = 8 + (_LINES if lines > 1 else _LINE if lines else _BLANK)
        else:
            end = piece.rstrip("\"')]}»”’*_")[-1:] or piece[-1:]
            kind = (_STOP if end in ".!?…。！？" else _CLAUSE if end in ",;:–—|•·、，；" else _OTHER) + 8 * piece[0].isspace()
        if len(piece) <= 40:
            if len(self) > 400_000:
                self.clear()
            self[piece] = kind
        return kind


_kinds = _Kinds()


def _units(tok: Tokenizer, text: str, long: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The text's units, their sizes, and the strength of the boundary before each.

    5 a blank line, 4 a line end, 3 the end of a sentence, 2 of a clause, 1 a
    blank, 0 between other pieces, -1 inside a piece of more than ``long`` tokens,
    between characters.
    """
    units = tok.pieces(text)
    sizes = np.fromiter(map(tok.sizes.__getitem__, units), dtype=np.int64, count=len(units))
    kinds = np.fromiter(map(_kinds.__getitem__, units), dtype=np.int64, count=len(units))
    spaced, kinds = kinds >= 8, kinds % 8
    strength = np.zeros(len(units), dtype=np.int64)
    was = kinds[:-1]
    blank = spaced[1:] | (was >= _BLANK)
    strength[1:] = np.where(blank, 1, 0)
    strength[1:][(was == _CLAUSE) & spaced[1:]] = 2
    strength[1:][(was == _STOP) & spaced[1:]] = 3
    strength[1:][was == _LINE] = 4
    strength[1:][was == _LINES] = 5
    two = (was[1:] == _LINE) & (was[:-1] == _LINE)  # two line ends that are pieces of their own
    strength[2:][two] = 5
    strength[(kinds >= _LINE)] = np.minimum(strength[(kinds >= _LINE)], 1)  # before a line end
    if not (sizes > long).any():
        return units, sizes, strength
    out, counts, levels = [], [], []
    for u, n, s in zip(units, sizes.tolist(), strength.tolist()):
        if n <= long:
            out.append(u), counts.append(n), levels.append(s)
            continue
        held, tokens, first = b"", 0, True
        for part in tok.encoding.decode_tokens_bytes(tok.encoding.encode_ordinary(u)):
            held, tokens = held + part, tokens + 1
            try:
                whole = held.decode()
            except UnicodeDecodeError:
                continue  # inside a character
            out.append(whole), counts.append(tokens), levels.append(s if first else -1)
            held, tokens, first = b"", 0, False
    return out, np.array(counts), np.array(levels)


def split_text(tok: Tokenizer, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str, int]]:
    """``(first token, first own token, end token, piece, first own character)`` of each piece of a text above the limit; else nothing."""
    room = limit - overlap - SLACK
    units, sizes, strength = _units(tok, text, max(1, min(room // 8, overlap or room)))
    ends = np.cumsum(sizes)
    if not len(ends) or ends[-1] <= limit:
        return []
    starts = ends - sizes
    cuts, todo = [], [(0, len(units))]
    while todo:
        a, b = todo.pop()
        size = ends[b - 1] - starts[a]
        if size <= room or b - a < 2:
            continue
        middle = starts[a] + size / 2
        lo = max(a + 1, int(np.searchsorted(starts[a:b], starts[a] + size / 4)) + a)
        hi = min(b, int(np.searchsorted(starts[a:b], starts[a] + 3 * size / 4, side="right")) + a)
        if lo >= hi:
            at = min(max(a + 1, int(np.searchsorted(starts[a:b], middle)) + a), b - 1)
        else:
            near = strength[lo:hi]
            best = np.flatnonzero(near == near.max()) + lo
            at = int(best[np.abs(starts[best] - middle).argmin()])
        cuts.append(at)
        todo += [(a, at), (at, b)]
    chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), dtype=np.int64, count=len(units)))])
    bounds = [0, *sorted(cuts), len(units)]
    out = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        begin, char = int(starts[a]), int(chars[a])
        if i and overlap:
            begin = max(0, begin - overlap)
            u = int(np.searchsorted(starts, begin, side="right")) - 1
            char, inside = int(chars[u]), begin - int(starts[u])
            if inside:
                parts = tok.encoding.decode_tokens_bytes(tok.encoding.encode_ordinary(units[u]))
                while inside:
                    try:
                        char += len(b"".join(parts[:inside]).decode())
                        break
                    except UnicodeDecodeError:
                        inside -= 1
                begin = int(starts[u]) + inside
        out.append((begin, int(starts[a]), int(ends[b - 1]), text[char : int(chars[b])], int(chars[a]) - char))
    return out


def split_long(df: DataFrame, key: str, text: str, limit: int, overlap: int, folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """The pieces of every text above ``limit`` tokens.

    ``key, piece_no, first_token, own_from, end_token, n_tokens, n_shared,
    overlap_chars, piece``: ``piece_no`` counts from 1; a piece is the tokens from
    ``first_token`` to before ``end_token`` of its text, of which those before
    ``own_from`` are shared with the piece before.  The pieces without their
    first ``overlap_chars`` characters are the text again.  ``n_shared`` is the
    overlap, up to three more if it would else begin inside a character, fewer
    only where less text stands before.  No piece exceeds the limit.

    Texts within the limit, null and empty ones have no pieces; a row that is
    repeated is cut once for each.
    """
    if not 0 <= overlap < limit - SLACK - 1:
        raise ValueError("the overlap must leave room within the limit")
    schema = "array<struct<first_token:int,own_from:int,end_token:int,piece:string,overlap_chars:int>>"

    @F.pandas_udf(schema)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(folder, name)
        names = ("first_token", "own_from", "end_token", "piece", "overlap_chars")
        for batch in batches:
            yield pd.Series([[dict(zip(names, p)) for p in split_text(tok, x, limit, overlap)] if x else [] for x in batch])

    # a token has at least one byte, so shorter texts needn't go to Python
    long = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.octet_length("t") > limit)
    out = long.select("k", F.posexplode(pieces("t")).alias("i", "x"))
    return out.select(
        F.col("k").alias(key),
        (F.col("i") + 1).alias("piece_no"),
        "x.first_token",
        "x.own_from",
        "x.end_token",
        (F.col("x.end_token") - F.col("x.first_token")).alias("n_tokens"),
        (F.col("x.own_from") - F.col("x.first_token")).alias("n_shared"),
        "x.overlap_chars",
        "x.piece",
    )
