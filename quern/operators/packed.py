"""Splitting fields that pack several values into one text.

The text is split on its quote characters: odd pieces are literals and pass
unchanged, even pieces are cut at delimiters.  An array fold puts the pieces
together again and ``posexplode`` gives the ordinals.  Everything is a built-in
expression, so a split is a narrow projection without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Countries whose own name holds an "and".
AND_COUNTRIES = (
    "Antigua and Barbuda",
    "Bosnia and Herzegovina",
    "Heard Island and McDonald Islands",
    "Saint Kitts and Nevis",
    "Saint Pierre and Miquelon",
    "Saint Vincent and the Grenadines",
    "Sao Tome and Principe",
    "São Tomé and Príncipe",
    "South Georgia and the South Sandwich Islands",
    "St. Kitts and Nevis",
    "St. Vincent and the Grenadines",
    "Svalbard and Jan Mayen",
    "Trinidad and Tobago",
    "Turks and Caicos Islands",
    "Wallis and Futuna",
)

_Q, _CUT, _AND, _AMP = "\u0002", "\u0001", "\u0003", "\u0004"
#: A delimiter counts only if no bracket that is open before it closes after it.
_OUTSIDE = r"(?![^(\[{]*[)\]}])"
_STRONG = r";|·•/\t\n\r"
_LIST = r";|,/·•\t\n\r"
#: What stands alone in a list cut by commas, and so takes no ", Region" after it.
_ALONE = r"(?:[A-Z]{2}-[A-Z]{2}-[^,\u0001]+|(?i:remote|anywhere|worldwide|multiple locations|united states|usa)\b[^,(\u0001]*(?:\([^)\u0001]*\)[^,\u0001]*)?|\d+ [Ll]ocations?)"


def _apostrophes(text: Column) -> Column:
    """Single quotes become quote marks where they enclose a whole piece."""
    edge = r"\[;|,/·•\t\n\r&+"
    body = r"(?:[^'\u0002]|(?<=\w)'(?=\w))*"
    return F.regexp_replace(text, rf"(^|[{edge}]|\b(?:and|or)\b)(\s*)'({body})'(?=\s*(?:$|[\]{edge}]|(?:and|or)\b))", f"$1$2{_Q}$3{_Q}")


def _cut_places(piece: Column) -> Column:
    joined = "|".join(f"{a}(?= and {b})" for a, b in (c.split(" and ", 1) for c in AND_COUNTRIES))
    piece = F.regexp_replace(piece, rf"(?i)\b({joined}) and ", f"$1{_AND}")
    joined = "|".join(f"{a}(?= & {b})" for a, b in (c.split(" and ", 1) for c in AND_COUNTRIES))
    piece = F.regexp_replace(piece, rf"(?i)\b({joined}) & ", f"$1{_AMP}")
    words = r"(?:(?:and|or)\s+)?"
    piece = F.regexp_replace(piece, rf"(?:\s*[{_STRONG}]\s*{words}|(?:^|\s+)[&+](?:\s+|$)|(?:^|,?\s+)(?:and|or)(?:\s+|$)){_OUTSIDE}", _CUT)
    # commas between "City, Region" pairs; next to a literal they always cut
    piece = F.regexp_replace(piece, r"^\s*,|,\s*$", _CUT)
    pair = r"(?:[^,\u0001(]+(?:\([^)]*\)[^,\u0001(]*)*,[^,\u0001(]+(?:\([^)]*\)[^,\u0001(]*)*)"
    country = r"(?!\s*(?:USA?|U\.S\.(?:A\.)?|United States(?: of America)?)\s*(?:\u0001|$))"
    piece = F.regexp_replace(piece, rf"(?<=^|\u0001)\s*({_ALONE}),\s*", f"$1{_CUT}")
    piece = F.regexp_replace(piece, rf"({pair}),{country}\s*{words}", f"$1{_CUT}")
    # the rest of a list may start with something that stands alone
    return F.regexp_replace(piece, rf"(?<=\u0001)\s*({_ALONE}),\s*", f"$1{_CUT}")


def _cut_list(piece: Column) -> Column:
    return F.regexp_replace(piece, rf"[{_LIST}]{_OUTSIDE}", _CUT)


def unpack(text: Column, kind: str = "place") -> Column:
    """The values packed into ``text`` as an array in their order.

    ``kind`` 'place' keeps "City, Region" together and knows "and", "or", "&"
    and "+" as delimiters; 'list' cuts at every ``; | , /``, bullet, tab and
    line end.  Text in brackets is never cut.  Quotes that enclose a value go,
    a doubled quote inside one is read as one, other quotes stay.  With an odd
    number of quotes they are ordinary text.  Empty pieces are left out.  Null,
    empty and blank texts give an empty array.
    """
    if kind not in ("place", "list"):
        raise ValueError(f"unknown kind {kind!r}")
    plain = F.regexp_replace(text, f"[{_CUT}{_Q}{_AND}{_AMP}]", " ")
    even = F.length(F.regexp_replace(plain, '[^"]', "")) % 2 == 0
    marked = F.when(even, F.translate(plain, '"', _Q)).otherwise(plain)
    # an array literal loses its brackets
    marked = F.regexp_replace(marked, rf"^\s*\[\s*({_Q}[\s\S]*{_Q})\s*\]\s*$", "$1")
    marked = _apostrophes(marked)
    pieces = F.split(marked, _Q)
    cut = _cut_places if kind == "place" else _cut_list
    last = F.size(pieces) - 1
    folded = F.transform(
        pieces,
        lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(_Q), p, F.lit(_Q))).when((p == "") & (i > 0) & (i < last), F.lit("")).otherwise(cut(p)),
    )
    whole = F.replace(F.array_join(folded, ""), F.lit(_Q + _Q), F.lit('"'))
    # a literal that is empty was folded into one quote
    blank = r"^[\s ]+|[\s ]+$"

    def clean(item: Column) -> Column:
        item = F.regexp_replace(item, blank, "")
        item = F.regexp_replace(item, rf"^{_Q}([\s\S]*){_Q}$", "$1")
        item = F.translate(item, _Q, '"')
        item = F.replace(F.replace(item, F.lit(_AND), F.lit(" and ")), F.lit(_AMP), F.lit(" & "))
        return F.regexp_replace(item, blank, "")

    items = F.filter(F.transform(F.split(whole, _CUT), clean), lambda x: x != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def split_packed(df: DataFrame, value: str, kind: str = "place", at_least: int = 1, pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per value of ``df[value]``, with all columns of ``df`` beside it.

    ``pos`` counts from 1.  Rows with fewer than ``at_least`` values are left
    out.  ``pos`` and ``item`` replace columns of the same name.  Rows that are
    repeated stay repeated; an empty table gives an empty one.
    """
    keep = [c for c in df.columns if c not in (pos, item)]
    values = "__quern_values"
    out = df.withColumn(values, unpack(F.col(f"`{value}`"), kind)).filter(F.size(values) >= at_least)
    return out.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(values).alias("__p", item)).select(
        *[F.col(f"`{c}`") for c in keep], (F.col("__p") + 1).cast("int").alias(pos), item
    )


def found_packed(postings: DataFrame, skills: DataFrame) -> DataFrame:
    """``kind, record_id, pos, item`` of every field that packs two or more values."""
    places = postings.select(F.col("posting_id").alias("record_id"), F.col("location_raw").alias("v"))
    # repeated rows of a posting must not repeat its values; fields that can't hold two go before the shuffle
    places = places.filter(F.size(unpack(F.col("v"), "place")) >= 2).distinct()
    places = split_packed(places, "v", "place", at_least=2).select(F.lit("location").alias("kind"), "record_id", "pos", "item")
    names = skills.select(F.col("skill_id").cast("long").alias("record_id"), F.col("aliases").alias("v"))
    names = split_packed(names.distinct(), "v", "list", at_least=2).select(F.lit("alias").alias("kind"), "record_id", "pos", "item")
    return places.unionByName(names)
