"""Column builders for text, names, titles, addresses and dates.

All are built-in expressions; a builder takes and returns columns and never
starts a job.  Null texts count as empty unless told otherwise.
"""

from __future__ import annotations

import unicodedata
from html.entities import html5, name2codepoint

from pyspark.sql import Column, functions as F



def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _folding() -> tuple[str, str]:
    """Every character that is an ASCII one without its marks, by Unicode's own decomposition, and what it is."""
    pairs = [(c, p) for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x20000)]) if len(p := _plain(c)) == 1 and p != c and p.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _ligatures() -> list[tuple[str, str]]:
    """Letters that stand for several."""
    return [(c, p) for c in map(chr, [0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB07)]) if (p := _plain(c)).isascii()]


_MARKED, _UNMARKED = _folding()


def fold_accents(text: Column) -> Column:
    """Letters without their marks, full-width and other forms as plain ones."""
    text = F.translate(F.regexp_replace(text, r"[\u0300-\u036f]", ""), _MARKED, _UNMARKED)
    for c, plain in _ligatures():
        text = F.replace(text, F.lit(c), F.lit(plain))
    return text


def _entities() -> dict[str, str]:
    """The named entities of HTML 4, by the standard library's table, and those that HTML 5 adds for ASCII."""
    return {k: chr(v) for k, v in name2codepoint.items()} | {k[:-1]: v for k, v in html5.items() if k.endswith(";") and len(v) == 1 and v.isascii()}


def unescape(text: Column) -> Column:
    """A text with its entities, named or by number, read once; what is none stays as written."""
    named = F.create_map(*[F.lit(x) for kv in _entities().items() for x in kv])
    pieces = F.split(text, "&")

    def read(piece: Column, i: Column) -> Column:
        body = F.regexp_extract(piece, r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        rest = F.substring(piece, F.length(body) + 2, F.length(piece))
        digits = F.when(F.lower(body).startswith("#x"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).otherwise(F.substring(body, F.lit(2), F.length(body)))
        number = F.when(body.startswith("#"), digits.try_cast("int"))
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        sign = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        sign = F.coalesce(sign, F.try_element_at(named, body))
        return F.when(i == 0, piece).when((body != "") & sign.isNotNull(), F.concat(sign, rest)).otherwise(F.concat(F.lit("&"), piece))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, read), "")).otherwise(text)


def collapse(text: Column) -> Column:
    """Single blanks, no blanks around line ends, at most one blank line, trimmed."""
    text = F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"[ \t]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences and lines as an array; a stop after a single capital, as in an abbreviation, ends none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])(?<![A-Z]\.)\s+|\n+")
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


# Words at the end of a name that say nothing of who it is.
LEGAL_WORDS = "INC INCORPORATED LLC LTD LIMITED CORP CORPORATION CO COMPANY LP LLP PLC PC PLLC GMBH SA NV AG PTE PVT SAS BV AB PBC SPC DBA COM".split()
GEO_WORDS = "USA US AMERICA AMERICAS NORTHAMERICA NA GLOBAL INTERNATIONAL WORLDWIDE".split()
DESCRIPTOR_WORDS = "HOLDINGS HOLDING GROUP SERVICES SERVICE SOLUTIONS TECHNOLOGIES TECHNOLOGY SYSTEMS LABS LABORATORIES PARTNERS VENTURES ENTERPRISES CONSULTING".split()
ENTITY_WORDS = (
    "INC INCORPORATED LLC LLP LP PLC PBC CORP CORPORATION CO COMPANY LTD LIMITED GMBH NV SA AG KK PTE PVT "
    "US USA U S AMERICA AMERICAS HOLDINGS HOLDING SERVICES SERVICE NATIONAL ASSOCIATION"
).split()


def tail_pattern(words: list[str]) -> str:
    """Matches a name that ends in the words; group 1 is the name without them, never empty."""
    return rf"^(\S+(?: \S+)*?)(?: (?:{'|'.join(words)}))+$"


DESCRIPTOR_PATTERN = rf"^(\S+ \S+(?: \S+)*) (?:{'|'.join(DESCRIPTOR_WORDS)})$"


def simple_key(name: Column) -> Column:
    """Upper case letters and digits of a name without accents and a leading THE."""
    text = F.replace(F.upper(fold_accents(F.coalesce(name, F.lit("")))), F.lit("&"), F.lit(" AND "))
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Z0-9 ]+", " "), " +", " "))
    return F.trim(F.regexp_replace(text, r"^THE( |$)", ""))


def employer_norm(name: Column) -> Column:
    """A name's key: legal and country words off its end, one descriptor if two words stay, legal words again."""
    key = simple_key(name)
    for words in (LEGAL_WORDS, GEO_WORDS):
        key = F.regexp_replace(key, tail_pattern(words), "$1")
    key = F.regexp_replace(key, DESCRIPTOR_PATTERN, "$1")
    return F.regexp_replace(key, tail_pattern(LEGAL_WORDS), "$1")


def stem_words(norm: Column) -> Column:
    """The words of a normalised name that aren't entity words or numbers."""
    return F.filter(F.split(norm, " "), lambda t: (t != "") & ~t.isin(ENTITY_WORDS) & ~t.rlike(r"^\d+$"))


def entity_stem(norm: Column) -> Column:
    return F.array_join(stem_words(norm), " ")


_BRACKETED = r"[\(\[\{][^\)\]\}]*[\)\]\}]"
_LEVEL = r"(?:i{1,3}|iv|[1-4])"
# Words of a title that don't name the post.
TITLE_NOISE = "remote hybrid onsite on site fulltime full time contract temporary us usa united states".split()


def title_norm(title: Column) -> Column:
    """A title as compared: entities read, lower case, plain quotes and dashes, single blanks."""
    text = F.lower(unescape(F.coalesce(title, F.lit(""))))
    text = F.translate(text, "’–—", "'--")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def title_level(title: Column) -> Column:
    """The level at the end of a title, upper case; null without one, and for the first, which says nothing."""
    text = F.trim(F.regexp_replace(F.regexp_replace(title_norm(title), _BRACKETED, " "), r"[,\-/|]+", " "))
    level = F.upper(F.regexp_extract(text, rf"\b({_LEVEL})$", 1))
    return F.when(~level.isin("", "I", "1"), level)


def level_penalty(title: Column) -> Column:
    """Points that a level costs: 4 for the second, 8 for those above, else none."""
    level = title_level(title)
    return F.when(level.isin("II", "2"), -4).when(level.isNotNull(), -8).otherwise(0)


def title_key(title: Column) -> Column:
    """The sorted distinct words of a title, without bracketed text, numbers of requisitions, levels and noise."""
    text = F.regexp_replace(title_norm(title), _BRACKETED, " ")
    text = F.regexp_replace(text, r"\b(?:r|req|jr|job)?[-_]?\d{4,}\b", " ")
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9 ]+", " "), " +", " ")), " ")
    words = F.filter(words, lambda t: (t != "") & ~t.isin(TITLE_NOISE))
    kept = F.regexp_replace(F.array_join(words, " "), rf"(?:^| ){_LEVEL}(?: {_LEVEL})*$", "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(kept, " "), lambda t: t != ""))), " ")


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def iso_instant(text: Column) -> Column:
    """An ISO time in UTC as ``YYYY-MM-DDTHH:MM:SSZ``; null if it is none."""
    at = F.try_to_timestamp(F.when(F.trim(text).rlike(r"^\d{4}-\d\d-\d\d"), F.trim(text)))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def millis_instant(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis.cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def recency_key(text: Column) -> Column:
    """Orders partial dates newest first: ``(no date, -year, -month, -day)``; what can't be read is no date."""
    part = lambda i: F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", i).try_cast("int")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.struct(part(1).isNull().cast("int").alias("none"), (-zero(part(1))).alias("y"), (-zero(part(2))).alias("m"), (-zero(part(3))).alias("d"))


def form_encode(text: Column) -> Column:
    return F.url_encode(F.coalesce(text, F.lit("")))


def numbers(text: Column) -> Column:
    """The numbers of a text as written, without the commas between digits."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1)
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"\.0+$", ""))


def camel_slug(*words_of: tuple[Column, int]) -> Column:
    """The first words of each text, capitalised and joined."""
    parts = []
    for text, n in words_of:
        words = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
        parts.append(F.array_join(F.transform(F.slice(words, 1, n), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), ""))
    return F.concat(*parts)


# The states by name, in the order in which names are tried.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY",
    "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO",
    "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}


def place_key(place: Column) -> Column:
    """``city|ST`` of a place that names its state by name or code, ``remote-us`` or the place in lower case."""
    text = F.trim(place)
    low = F.lower(text)
    city = F.trim(F.regexp_extract(low, r"^([^,]+),", 1))
    code = F.regexp_extract(text, r",\s*([A-Z]{2})\b", 1)
    dashed = F.regexp_extract(text, r"^US-([A-Z]{2})-", 1)
    named = F.coalesce(*[F.when(F.trim(F.regexp_extract(low, r",\s*([a-z ]+)", 1)).startswith(name), code) for name, code in sorted(STATES.items(), key=lambda x: -len(x[0]))])
    known = lambda c: c.isin(sorted(STATES.values()))
    return (
        F.when(low.rlike(r"^remote\b"), F.lit("remote-us"))
        .when(known(dashed), F.concat(F.replace(F.lower(F.regexp_extract(text, r"^US-[A-Z]{2}-(.*)$", 1)), F.lit("-"), F.lit(" ")), F.lit("|"), dashed))
        .when(known(code), F.concat(city, F.lit("|"), code))
        .when(named.isNotNull(), F.concat(city, F.lit("|"), named))
        .otherwise(low)
    )


# The hosts' forms of a board's address.
def posting_address(url: Column) -> Column:
    """``source, token, id`` of a posting's address, empty where it has none."""
    plain = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[?#].*$", "")
    plain = F.regexp_replace(plain, "/+$", "")
    board = r"(?i)^https?://boards\.([a-z]+)\.[^/]+/([^/]+)/jobs/(.+)$"
    own = r"(?i)^https?://careers\.()([^./]+)\.[^/]+/openings/(.+)$"
    pick = lambda i: F.when(plain.rlike(board), F.regexp_extract(plain, board, i)).otherwise(F.regexp_extract(plain, own, i))
    return F.struct(F.lower(pick(1)).alias("source"), F.lower(pick(2)).alias("token"), pick(3).alias("id"))


def institution_variants(name: Column) -> Column:
    """Plainer and plainer spellings: in full, without brackets, without what follows a comma or "at", and with trailing qualifiers off one by one."""
    base = F.coalesce(name, F.lit(""))
    bare = F.trim(F.regexp_replace(base, r"\s*\([^)]*\)", ""))
    city = F.trim(F.regexp_replace(bare, r"(?:,\s*[^,]*| (?:at|in) [A-Z].*| [-–] .*)$", ""))
    words = F.split(city, r"\s+")
    tail = rf"^(?:{'|'.join(sorted({*LEGAL_WORDS, *GEO_WORDS}))})$"
    keep = F.aggregate(words, F.lit(0), lambda n, w: F.when(F.upper(F.regexp_replace(w, r"[.,]", "")).rlike(tail), n + 1).otherwise(F.lit(0)))
    peeled = F.transform(F.sequence(F.lit(0), F.least(keep, F.size(words) - 1)), lambda n: F.array_join(F.slice(words, F.lit(1), F.size(words) - n), " "))
    out = F.transform(F.concat(F.array(base, bare), peeled), lambda v: F.trim(F.regexp_replace(v, r"^The\s+", "")))
    out = F.filter(out, lambda v: v != "")
    low = F.transform(out, lambda v: F.lower(v))
    return F.filter(out, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def plain_company(name: Column) -> Column:
    """The plainest spelling of a company, without the punctuation that this leaves."""
    return F.regexp_replace(F.coalesce(F.element_at(institution_variants(name), -1), F.lit("")), r"^[ ,.;]+|[ ,.;]+$", "")


# First words of a name that are a board of somebody else.
NO_SLUG = (
    "data tech group global us usa inc the american national international first general united new one "
    "advanced premier systems solutions services technologies"
).split()


def slug_candidates(name: Column, most: int = 5) -> Column:
    """Names that a company's board may have, the likeliest first: all words, the first two, the first; of four letters or more."""
    words = F.filter(F.split(F.lower(employer_norm(name)), " "), lambda w: w != "")
    two = F.when(F.size(words) >= 2, F.slice(words, 1, 2))
    out = F.array(F.array_join(words, ""), F.array_join(words, "-"), F.array_join(two, ""), F.array_join(two, "-"), F.get(words, F.lit(0)))
    return F.slice(F.array_distinct(F.filter(out, lambda s: s.isNotNull() & (F.length(s) >= 4) & ~s.isin(NO_SLUG))), 1, most)


def site_names(tenant: Column, templates: tuple[str, ...]) -> Column:
    """The templates with the tenant in lower case, with a capital and in upper case for ``{t}``, ``{T}`` and ``{U}``."""
    def filled(template: str) -> Column:
        out = F.lit(template)
        for mark, form in (("{t}", F.lower(tenant)), ("{T}", F.concat(F.upper(F.substring(tenant, 1, 1)), F.lower(F.substring(tenant, F.lit(2), F.length(tenant))))), ("{U}", F.upper(tenant))):
            out = F.replace(out, F.lit(mark), form)
        return out

    return F.array(*map(filled, templates))


def occupation_base(code: Column) -> Column:
    """An occupation code without its detail: what stands before the first stop."""
    return F.upper(F.trim(F.split_part(F.trim(F.coalesce(code.cast("string"), F.lit(""))), F.lit("."), F.lit(1))))


def snippet(text: Column, size: int = 400) -> Column:
    return F.substring(text, 1, size)


def pick_name(*names: Column, placeholder: str = r"(?i)^(?:unknown|untitled|n/?a|-)?$") -> Column:
    """The first name that is no placeholder, else the first that isn't empty."""
    plain = [F.trim(F.coalesce(n, F.lit(""))) for n in names]
    return F.coalesce(*[F.when(~n.rlike(placeholder), n) for n in plain], *[F.nullif(n, F.lit("")) for n in plain])


def is_slug(text: Column) -> Column:
    """Whether a text may name a folder: letters, digits, dashes and underscores, beginning with a letter or digit."""
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,119}$"), F.lit(False))


def years_required(text: Column, context: int = 80, most: int = 20) -> Column:
    """The least number of years that a text asks for: with the word experience, and without years of education or schooling, within so many characters; null if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    span = r"(\d{1,2})\s*\+?\s*(?:-\s*\d{1,2}\s*)?(?:years?|yrs?)"
    pieces = F.split(F.regexp_replace(F.regexp_replace(low, "[\u0001\u0002]", " "), span, "\u0001$0\u0002"), "[\u0001\u0002]")

    def asked(i: Column) -> Column:
        found = F.get(pieces, i)
        before = F.array_join(F.slice(pieces, F.lit(1), i), "")
        after = F.array_join(F.slice(pieces, i + 2, F.size(pieces)), "")
        near = F.concat(F.substring(before, F.lit(-context), F.lit(context)), found, F.substring(after, 1, context))
        n = F.regexp_extract(found, r"^\d{1,2}", 0).try_cast("int")
        return F.when(F.contains(near, F.lit("experience")) & ~near.rlike("years? of (?:education|schooling)") & (n <= most), n)

    at = F.when(F.size(pieces) >= 3, F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.array_min(F.transform(at, asked))
