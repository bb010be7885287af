"""Arrow functions for what no built-in expression says."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

# Elements that start a line of their own.
BLOCKS = frozenset("p div br h1 h2 h3 h4 h5 h6 tr section".split())


class _Flat(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS or tag == "li":
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def flat_text(markup: str | None, twice: bool = False) -> str:
    """Plain text of a description, with its lines kept; entities are read once before the markup, and once more if ``twice``."""
    if not markup:
        return ""
    import re

    text = html.unescape(html.unescape(markup) if twice else markup)
    parser = _Flat()
    parser.feed(text)
    parser.close()
    text = "".join(parser.parts).replace("\u00a0", " ")
    text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def html_text(markup: Column, twice: Column) -> Column:
    @F.pandas_udf("string")
    def flat(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, more in batches:
            yield pd.Series([flat_text(t, bool(m)) for t, m in zip(text, more)])

    return flat(markup, twice)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of two word sets: 100 if one holds the other, else the best of the shared words and both wholes."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not left or not right):
        return 100.0
    one, two = f"{shared} {left}".strip(), f"{shared} {right}".strip()
    best = indel_ratio(one, two)
    return max(best, indel_ratio(shared, one), indel_ratio(shared, two)) if shared else best


def name_similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([int(token_set_ratio(p, q)) for p, q in zip(x, y)], dtype="int32")

    return score(a, b)
