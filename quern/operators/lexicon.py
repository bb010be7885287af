"""Terms of a list in texts.

A list is bounded by being written by people; it becomes one generated
expression, so matching is a projection over the texts.  A plain ``contains``
goes before each pattern.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def first_term(text: Column, terms: Sequence[str]) -> Column:
    """The first of the terms, in their order, that the text contains; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]) if terms else F.lit(None).cast("string")


# Nouns that end a post's name, between which and its field other words may stand, and words of analytics.
POSTS = ("analyst", "analysts", "administrator", "engineer", "specialist")
ANALYTICS = r"(?i)\b(?:analyst|analytics|analysis|data|business intelligence|bi|insights|reporting|quantitative|statistic)\w*\b"


def title_tier(title: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """``tier, term`` of a normalised title by a list of ``(term, tier)``, whose order counts; both null if no term fits.

    Tier 'N' goes first: such a term must stand as words, with up to 26
    characters before its last word if that is a post; the term is then the
    text found.  An 'A' term anywhere in the title comes next, 'A-partial' unless
    it is all of it before a qualifier; then 'C' beside a word of analytics, then 'B'.
    """
    of = lambda tier: [t.strip().lower() for t, k in terms if k.strip() == tier]
    found = lambda tier, term: F.struct(tier.alias("tier"), term.alias("term"))
    # one array of terms for a tier, as a chain of conditions for each would be a very long expression
    first = lambda tier: F.get(F.filter(F.array(*map(F.lit, of(tier))), lambda t: F.contains(title, t)), F.lit(0)) if of(tier) else F.lit(None).cast("string")
    patterns = []
    for t in of("N"):
        words = t.split()
        head = r"\s+".join(map(re.escape, words[:-1]))
        patterns.append(rf"{head}\b[\w\s/&,-]{{0,26}}?\b{re.escape(words[-1])}" if len(words) >= 2 and words[-1] in POSTS else re.escape(t))
    none = F.lit(None).cast("string")
    refused = F.coalesce(*[F.nullif(F.regexp_extract(title, rf"(?<![a-z])({p})(?![a-z])", 1), F.lit("")) for p in patterns], none)
    bare = F.trim(F.regexp_replace(title, r"[,\-–|/(].*$", ""))
    a, b, c = first("A"), first("B"), F.when(title.rlike(ANALYTICS), first("C"))
    return (
        F.when(title.rlike(rf"(?<![a-z])(?:{'|'.join(patterns)})(?![a-z])") if patterns else F.lit(False), found(F.lit("N"), refused))
        .when(a.isNotNull(), found(F.when((bare == a) | (title == a), "A").otherwise("A-partial"), a))
        .when(c.isNotNull(), found(F.lit("C"), c))
        .when(b.isNotNull(), found(F.lit("B"), b))
        .otherwise(found(none, none))
    )


def term_pattern(forms: Sequence[str]) -> str:
    """Matches any of the forms where no letter or digit goes on."""
    return rf"(?<![a-z0-9])(?:{'|'.join(re.escape(f) for f in sorted(set(forms), key=lambda f: (-len(f), f)))})(?![a-z0-9])"


def has_term(low: Column, forms: Sequence[str]) -> Column:
    """Whether a text in lower case has one of the forms as words."""
    forms = [f.lower() for f in forms if f]
    maybe = None
    for f in forms:
        maybe = F.contains(low, F.lit(f)) if maybe is None else maybe | F.contains(low, F.lit(f))
    return F.coalesce(maybe & low.rlike(term_pattern(forms)), F.lit(False))


def _prefix_pattern(forms: Sequence[str]) -> str:
    """A pattern of all forms with common beginnings written once; of forms that begin alike the longest is tried first."""
    ends, by = "" in forms, {}
    for f in forms:
        if f:
            by.setdefault(f[0], []).append(f[1:])
    ways = [re.escape(c) + _prefix_pattern(rest) for c, rest in sorted(by.items())]
    if not ways:
        return ""
    body = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
    return f"(?:{body})?" if ends else body


def terms_in(low: Column, lexicon: Sequence[tuple[str, Sequence[str], int]]) -> Column:
    """``names, weight`` of the entries ``(name, forms, weight)`` that a text in lower case has, in the list's order.

    One pass over the text finds the longest form that begins at each place; the
    shorter ones that begin there with it are known from the list.
    """
    entries: dict[str, list[int]] = {}
    for i, (_, forms, _) in enumerate(lexicon):
        for f in {f.lower() for f in forms if f}:
            entries.setdefault(f, []).append(i)
    none = F.array().cast("array<int>")
    if not entries:
        return F.struct(F.array().cast("array<string>").alias("names"), F.lit(0).alias("weight"))
    word = re.compile("[a-z0-9]")
    ends = lambda long, short: long.startswith(short) and not word.match(long[len(short) :])
    meant = {f: sorted({i for g, own in entries.items() if ends(f, g) for i in own}) for f in entries}
    pairs = [x for f, own in meant.items() for x in (F.lit(f), F.array(*map(F.lit, own)))]
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(rf"(?<![a-z0-9])(?=({_prefix_pattern(list(entries))})(?![a-z0-9]))"), 1))
    at = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda f: F.coalesce(F.try_element_at(F.create_map(*pairs), f), none)))))
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, _, w in lexicon])
    hits = F.transform(at, lambda i: F.get(listed, i))
    return F.struct(F.transform(hits, lambda h: h["name"]).alias("names"), F.aggregate(hits, F.lit(0), lambda n, h: n + h["weight"]).alias("weight"))


def term_hits(low: Column, forms: Sequence[str]) -> Column:
    """How often a text in lower case has any of the forms."""
    forms = [f.lower() for f in forms if f]
    return F.when(has_term(low, forms), F.regexp_count(low, F.lit(term_pattern(forms)))).otherwise(0)
