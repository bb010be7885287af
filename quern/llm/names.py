"""Variant spellings of organisations' names, and the entities behind them.

A name is read into its parts: the kind of organisation, the proper name, the
trade, the legal form, a second name and its initials.  Records are then
resolved by merging and rematching: matched records become one profile with the
spellings, trades and initials of all, and what a profile has anew enters
blocking again until nothing merges.  Blocking is by a spelling with one letter
left out, which any two spellings share that differ by a letter more, less or
other, or two changed over; with two left out where the trade agrees too.  The
built-in ``levenshtein`` verifies every pair that shares a block.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F

from quern.operators.components import components
from quern.session import counted, written

# The vocabulary of the names, to be replaced for another domain: trades, of which a firm has one, and words that go with any of them.
TRADES = (
    "ANALYTICS AVIATION BIOLABS CAPITAL CERAMICS DENTAL ENERGY FOODS FORESTRY FREIGHT HEALTH HOSPITALITY INSURANCE LEARNING "
    "LOGISTICS MAPPING MATERIALS MEDIA OPTICS PAYMENTS RECRUITING ROBOTICS SHIPPING SOFTWARE STAFFING TALENT TEXTILES"
).split()
FILLERS = "DESK GROUP HOLDINGS INTERNATIONAL LABORATORIES NETWORKS PARTNERS SERVICES SOLUTIONS SYSTEMS TECHNOLOGIES WORKS".split()
SCHOOL_WORDS = "CENTER CHILDRENS COLLEGE HOSPITAL INSTITUTE MEDICAL STATE TECHNOLOGY UNIVERSITY".split()
LEGAL_FORMS = {
    "INC": "INC", "INCORPORATED": "INC", "CORP": "CORP", "CORPORATION": "CORP", "CO": "CO", "COMPANY": "CO", "LTD": "LTD", "LIMITED": "LTD",
    "LLC": "LLC", "LP": "LP", "LLP": "LP", "PLC": "LTD", "GMBH": "LTD",
}
FORMS = sorted(set(LEGAL_FORMS.values()))
# Usual short forms that the rule of `_shortened` doesn't settle.
SHORT_WORDS = {
    "CAP": "CAPITAL", "CHILD": "CHILDRENS", "CHILDREN": "CHILDRENS", "CENTRE": "CENTER", "FRT": "FREIGHT", "INS": "INSURANCE", "INST": "INSTITUTE", "LAB": "LABORATORIES",
    "LABS": "LABORATORIES", "MED": "MEDICAL", "ST": "STATE", "SERV": "SERVICES", "SVCS": "SERVICES", "SOL": "SOLUTIONS", "SYS": "SYSTEMS", "TECH": "TECHNOLOGIES", "TECHS": "TECHNOLOGIES",
}

_WORDS = frozenset((*TRADES, *FILLERS, *SCHOOL_WORDS))
_LONGEST = max(map(len, _WORDS)) + 1  # a typing error may add a letter
_SMALL = {"THE", "OF", "AND", "AT", "FOR", "US", "USA", "AMERICA", "HQ", "CAREERS", "JOBS"}
_SECOND = re.compile(r"\s+(?:d/?b/?a|a/?k/?a|t/a|trading as|doing business as|formerly)[:\s]+", re.I)
_AGENCY = re.compile(r"^\s*(?:on behalf of|client\s*:|for our client\s*:?)\s*", re.I)


def _without_one(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))} | {word}


@lru_cache(None)
def _typos() -> dict[str, str]:
    """Vocabulary words of five letters or more by what is left without a letter."""
    out: dict[str, str | None] = {}
    for w in sorted(_WORDS):
        if len(w) >= 5:
            for v in _without_one(w):
                out[v] = w if out.get(v, w) == w else None
    return {k: v for k, v in out.items() if v}


@lru_cache(200_000)
def _shortened(token: str) -> str | None:
    """The one vocabulary word of which a token is the beginning, the beginning and consonants of the rest, or its first letter and consonants."""
    found = None
    for w in _WORDS if len(token) > 1 else ():
        if len(w) < len(token) + 2 or w[0] != token[0]:
            continue
        n = len(os.path.commonprefix([token, w]))
        rest, left = token[n:], iter(w[n:])
        if (n < 3 and not rest) or set(rest) & set("AEIOU") or not all(c in left for c in rest):
            continue
        if found:
            return None
        found = w
    return found


@lru_cache(200_000)
def _word(token: str) -> str | None:
    """The vocabulary word a token stands for."""
    if token in _WORDS:
        return token
    if token in SHORT_WORDS:
        return SHORT_WORDS[token]
    if short := _shortened(token):
        return short
    if len(token) < 5:
        return None
    for v in sorted(_without_one(token), key=len, reverse=True):
        w = _typos().get(v)
        if w and abs(len(w) - len(token)) <= 1:
            return w
    return None


@lru_cache(200_000)
def _ends(token: str) -> tuple[str, str] | None:
    """A proper name and the vocabulary word written onto its end, rather as it stands than with a typing error."""
    sizes = range(min(len(token) - 4, _LONGEST), 3, -1)
    for n in sizes:
        word = token[-n:] if token[-n:] in _WORDS else SHORT_WORDS.get(token[-n:])
        if word:
            return token[:-n], word
    for n in sizes:
        if n >= 6 and (word := _word(token[-n:])) and (word in TRADES or word in SCHOOL_WORDS):
            return token[:-n], word
    return None


def read_name(text: str | None) -> tuple[str, str, str, str, str]:
    """``(kind, proper, trade, legal, second)`` of a name; all empty if it has no proper name.

    kind is 'FIRM' or the words that make a school of one sort; second is the
    proper name of a second name.  Site, state and country are left out.
    """
    if not text or not text.strip():
        return ("",) * 5
    text = _AGENCY.sub("", text)
    parts = _SECOND.split(text, maxsplit=1)
    second = read_name(parts[1])[1] if len(parts) > 1 else ""
    plain = "".join(c for c in unicodedata.normalize("NFKD", parts[0]) if not unicodedata.combining(c))
    plain = re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})", " ", plain).upper()
    plain = re.sub(r"['’`]", "", plain)
    plain = re.sub(r"\bL\.? ?L\.? ?C\b\.?", "LLC", re.sub(r"\bL\.? ?P\b\.?", "LP", re.sub(r"\bU\.? ?S\.?(?: ?A\b\.?)?(?=\W|$)", "USA", plain)))
    plain = re.sub(r"\bLIMITED LIABILITY (?:COMPANY|CO)\b", "LLC", re.sub(r"\bLIMITED PARTNERSHIP\b", "LP", plain))
    plain = re.sub(r"\bU\b\.?(?=\s+OF\b)", "UNIVERSITY", plain)
    whole = [_word(t) for t in re.findall(r"[A-Z0-9]+", plain)]
    school = any(w in SCHOOL_WORDS and w not in ("STATE", "CENTER") for w in whole) or any((e := _ends(t)) and e[1] in ("UNIVERSITY", "COLLEGE", "HOSPITAL", "INSTITUTE", "TECHNOLOGY") for t in re.findall(r"[A-Z0-9]+", plain))
    plain = re.sub(r"\([^)]*\)", " ", plain)
    legal = ""
    for t in re.findall(r"[A-Z]+", plain):
        legal = LEGAL_FORMS.get(t, legal)
    plain = re.sub(r"\s[-–]\s.*$", " ", plain)
    if school:
        plain = re.sub(r"\s+AT\s+.*$", " ", plain)
        head, _, tail = plain.partition(",")
        if tail:
            # "Place, University of" is turned around; else a site follows
            plain = f"{tail} {head}" if re.search(r"\bOF\s*$", tail) else head
    proper, trades, kinds = [], [], set()
    for t in re.findall(r"[A-Z0-9]+", plain):
        if t in LEGAL_FORMS or t in _SMALL:
            continue
        word = _word(t)
        if word is None and (cut := _ends(t)):
            proper.append(cut[0])
            word = cut[1]
        elif word is None:
            proper.append(t)
            continue
        if word in TRADES:
            trades.append(word)
        elif word in SCHOOL_WORDS:
            kinds.add(word)
        if word == "HOSPITALITY" and school:
            kinds.add("HOSPITAL")
        if word == "TECHNOLOGIES" and school:
            kinds.add("TECHNOLOGY")
    if school and {"HOSP"} & set(re.findall(r"[A-Z]+", plain)):
        kinds.add("HOSPITAL")
    if not proper:
        # what was taken for a short form is the name where there is no other
        proper = [t for t in re.findall(r"[A-Z0-9]+", plain) if t not in _WORDS and t not in SHORT_WORDS and t not in LEGAL_FORMS and _shortened(t)]
    name = "".join(proper)
    if not school and "HOSP" in proper:
        proper.remove("HOSP")
        trades.append("HOSPITALITY")
        name = "".join(proper)
    elif "HOSP" in proper:
        name = "".join(p for p in proper if p != "HOSP")
    if not name or re.fullmatch(r"UNDISCLOSED(?:CLIENT)?|CLIENT|CONFIDENTIAL(?:CLIENT)?", name):
        return ("",) * 5
    if not school:
        return "FIRM", name, trades[0] if trades else "", legal, second
    kinds -= {"CENTER"} | ({"UNIVERSITY"} if "MEDICAL" in kinds else set())
    return " ".join(sorted(kinds)), name, "", "", second


def initials_of(text: str | None) -> str:
    """The first letters of a name's words, the proper ones first for a firm; of a text that is nothing but initials, '=' and these; empty if fewer than two."""
    if not text or not text.strip():
        return ""
    plain = _SECOND.split(_AGENCY.sub("", text), maxsplit=1)[0]
    plain = re.sub(r"\([^)]*\)|\s[-–]\s.*$", " ", plain)
    tokens = [t for t in re.findall(r"[^\W_]+", plain.replace(".", "") if re.search(r"\b(?:[A-Z]\.){2,}", plain) else plain) if t.upper() not in LEGAL_FORMS]
    if len(tokens) == 1 and re.fullmatch(r"[A-Z]{2,5}", tokens[0]):
        return "=" + tokens[0]
    known = [_word(t.upper()) for t in tokens]
    words = [t.upper() for t in tokens if t.upper() not in _SMALL]
    if not any(w in SCHOOL_WORDS for w in known):
        words.sort(key=lambda t: _word(t) is not None)
    return "".join(t[0] for t in words) if len(words) > 1 else ""


PARTS = "struct<kind:string,proper:string,trade:string,legal:string,second:string,initials:string>"


def name_parts(text: Column) -> Column:
    """The parts of a name, by ``read_name`` and ``initials_of``."""

    @F.pandas_udf(PARTS)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*read_name(x), initials_of(x)) for x in texts], columns=["kind", "proper", "trade", "legal", "second", "initials"], dtype=object)

    return read(text)


#: Letters from which a spelling may differ by one edit, and by two; in a shorter name an edit makes another name.
ONE_FROM, TWO_FROM = 6, 9


def without_one(word: Column) -> Column:
    """A word and what is left of it without any one letter; short words as they are."""
    n = F.length(word)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.when(n >= ONE_FROM, F.array_distinct(F.concat(F.array(word), less))).otherwise(F.array(word))


def without_two(word: Column) -> Column:
    """The same for up to two letters of long words; two spellings of one name that isn't on file share one."""
    less = F.when(F.length(word) >= TWO_FROM, F.flatten(F.transform(without_one(word), without_one))).otherwise(without_one(word))
    return F.array_distinct(less)


def edits(a: Column, b: Column) -> Column:
    """Edits between two spellings, two letters changed over counting as one: 0, 1, 2, or null for more."""
    d = F.levenshtein(a, b, 4)
    letters = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
    bag = F.levenshtein(letters(a), letters(b), 2)
    return F.when(d <= 1, d).when((d == 2) & (bag == 0), 1).when(d == 2, 2).when((d == 3) & (bag >= 0), 2).when((d == 4) & (bag == 0), 2)


def _spread(df: DataFrame) -> DataFrame:
    """Rows that each become many, over as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _pairs(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """``a, b, sort, edits`` of names of ``fresh`` with names of ``known`` that share a block and are near enough.

    ``sort`` is 's' for two of one kind and trade, 'c' for a bare firm's name
    ``a`` and one with a trade ``b``, 'b' for two bare ones.  A name stands once
    for each kind and trade, however many records have it, so a block holds
    distinct spellings of one name and never the records of a hot one.
    """
    bare = lambda t: (F.col(f"{t}kind") == "FIRM") & (F.col(f"{t}trade") == "")

    def keys(names: DataFrame) -> DataFrame:
        none = F.array().cast("array<bigint>")
        own = F.when(~bare(""), F.transform(without_two(F.col("proper")), lambda v: F.xxhash64(F.lit("trade"), "scope", "kind", "trade", v)))
        any_ = F.when(F.col("kind") == "FIRM", F.transform(without_one(F.col("proper")), lambda v: F.xxhash64(F.lit("any"), "scope", v)))
        return _spread(names).select("id", bare("").alias("bare"), F.explode(F.concat(F.coalesce(own, none), F.coalesce(any_, none))).alias("key"))

    x, y = keys(fresh).toDF("a", "abare", "key"), keys(known).toDF("b", "bbare", "key")
    # of a bare name and another the bare one comes first; either end of two alike may be fresh
    met = x.join(y.hint("merge"), "key")  # a planner that knows the sizes before the explode would broadcast.filter(F.col("a") != F.col("b"))
    turn = (F.col("bbare") & ~F.col("abare")) | ((F.col("abare") == F.col("bbare")) & (F.col("a") > F.col("b")))
    met = met.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b")).distinct()
    side = lambda c: known.select(*[F.col(k).alias(f"{c}_{k}" if k != "id" else c) for k in ("id", "kind", "trade", "proper")])
    both = met.join(side("a"), "a").join(side("b"), "b").withColumn("edits", edits(F.col("a_proper"), F.col("b_proper"))).filter("edits is not null")
    abare, bbare = bare("a_"), bare("b_")
    alike = ~abare & ~bbare & (F.col("a_kind") == F.col("b_kind")) & (F.col("a_trade") == F.col("b_trade"))
    sort = F.when(alike, "s").when(abare & bbare & (F.col("edits") <= 1), "b").when(abare & ~bbare & (F.col("b_kind") == "FIRM") & (F.col("edits") <= 1), "c")
    return both.select("a", "b", sort.alias("sort"), F.col("edits").cast("int")).filter("sort is not null")


def resolve(records: DataFrame, most_rounds: int = 8) -> DataFrame:
    """``node, root`` for ``records(node, kind, proper, trade, legal, second, initials, weight)``; with a column ``scope``, each scope by itself.

    Records of one kind match if they share a proper name, but for a typing
    error or two, and a trade.  A firm's profile without a trade joins the
    profile of its name that has most of its legal form, then most weight; if
    no name is near and its name is nothing but initials, the one profile that
    has these initials among those of its spellings and none of another legal
    form.  A second name is a name of its profile like the first.

    A merged profile has every name with every trade of its records; names that
    it so has anew are blocked and compared in the next round, until there are
    none.  ``initials`` is an array.
    """
    if "scope" not in records.columns:
        records = records.withColumn("scope", F.lit(""))
    form = F.when((F.col("kind") == "FIRM") & (F.col("trade") == ""), F.col("legal")).otherwise("")
    rows = records.select("scope", "node", "kind", "trade", "legal", "weight", "initials", form.alias("form"), F.explode(F.array_distinct(F.array("proper", "second"))).alias("proper"), (F.col("proper")).alias("first"))
    rows = rows.filter("proper <> ''").withColumn("id", F.xxhash64("scope", "kind", "trade", "form", "proper"))
    rows = written(rows.withColumn("main", F.xxhash64("scope", "kind", "trade", "form", "first")), "names")
    names = rows.select("id", "scope", "kind", "trade", "proper").distinct()
    links = rows.filter("id <> main").select(F.col("id").alias("a"), F.col("main").alias("b"))
    owned = rows.filter("id = main").groupBy("id").agg(F.sum("weight").alias("total"), *[F.sum(F.when(F.col("legal") == f, F.col("weight"))).alias(f"w_{f}") for f in FORMS], F.flatten(F.collect_set("initials")).alias("initials"))
    fresh = names
    for _ in range(most_rounds):
        pairs = written(_pairs(fresh, names), "pairs")
        links = links.unionByName(pairs.filter("sort = 's'").select("a", "b"))
        held = names.join(components(links).toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        # what a profile's records say together; it is bare if none of a firm's has a trade
        told = held.join(owned, "id", "left").groupBy("root").agg(
            (F.max("trade") == "").alias("no_trade"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.flatten(F.collect_set("initials")).alias("initials"), *[F.coalesce(F.sum(f"w_{f}"), F.lit(0)).alias(f"w_{f}") for f in FORMS]
        )
        form = F.coalesce(*[F.when(F.col(f"w_{f}") > 0, f) for f in FORMS], F.lit(""))
        seen = Observation()
        held = held.join(told, "root").withColumns({"bare": F.col("no_trade") & (F.col("kind") == "FIRM"), "form": form}).drop("no_trade")
        held = written(held.observe(seen, F.count_if(F.exists("initials", lambda i: i.startswith("="))).alias("short")), "profiles")
        ends = lambda c: held.select(F.col("id").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("root", "bare", "form", "total", *[f"w_{f}" for f in FORMS])])
        # profiles of a firm's bare name choose one with a trade
        met = pairs.filter("sort <> 's'").join(ends("a"), "a").join(ends("b"), "b").filter("a_bare")
        same_form = F.coalesce(*[F.when(F.col("a_form") == f, F.col(f"b_w_{f}")) for f in FORMS], F.lit(0))
        order = F.struct(-F.col("edits"), same_form, F.col("b_total"), F.col("b_root"))
        chosen = met.filter("sort = 'c' and not b_bare").groupBy(F.col("a_root").alias("a")).agg(F.max_by("b_root", order).alias("b"))
        if seen.get["short"]:
            chosen = written(chosen, "chosen")
            chosen = chosen.unionByName(_by_initials(held, chosen))
        chosen = written(chosen, "chosen")
        # those that have no choice are one organisation by their name
        free = met.filter("sort = 'b' and b_bare").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
        free = free.join(chosen.select("a"), "a", "left_anti").join(chosen.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b")
        links = written(links.unionByName(chosen).unionByName(free), "links")
        merged = components(chosen.unionByName(free)).toDF("root", "top")
        held = written(held.select("id", "root", "scope", "kind", "trade", "proper").join(merged, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"), "merged")
        # a profile's names with its trades that it didn't have so far
        firms = held.filter("kind = 'FIRM'").groupBy("root", "scope").agg(F.collect_set("trade").alias("trades"), F.collect_set("proper").alias("propers"), F.collect_set(F.struct("trade", "proper")).alias("had")).filter(F.size("trades") > 1)
        anew = firms.withColumn("trade", F.explode("trades")).withColumn("proper", F.explode("propers")).filter((F.col("trade") != "") & ~F.array_contains("had", F.struct("trade", "proper")))
        anew = anew.select(F.xxhash64("scope", F.lit("FIRM"), "trade", F.lit(""), "proper").alias("id"), "root", "scope", F.lit("FIRM").alias("kind"), "trade", "proper")
        anew, n = counted(anew, "anew")
        if not n:
            return rows.filter("id = main").join(held.select("id", "root"), "id").select("node", "root").distinct()
        links = links.unionByName(anew.select(F.col("id").alias("a"), F.col("root").alias("b")))
        fresh = anew.select("id", "scope", "kind", "trade", "proper").distinct()
        names = names.unionByName(fresh).distinct()
    raise RuntimeError("the profiles did not settle")


def _by_initials(held: DataFrame, chosen: DataFrame) -> DataFrame:
    """``a, b``: bare profiles that have nothing but initials and no choice, and the one profile that has these and no other legal form alone."""
    profiles = held.groupBy("root", "scope", "bare", "form").agg(F.first("initials").alias("initials"), *[F.first(f"w_{f}").alias(f"w_{f}") for f in FORMS])
    each = profiles.select("*", F.explode(F.array_distinct("initials")).alias("i"))
    seek = each.filter(F.col("bare") & F.col("i").startswith("=")).select(F.col("root").alias("a"), "scope", F.col("form").alias("own"), F.substring("i", 2, 5).alias("i")).join(chosen.select("a"), "a", "left_anti")
    both = seek.join(each.filter(~F.col("i").startswith("=")), ["scope", "i"]).filter("a <> root")
    fits = (F.col("own") == "") | (F.col("form") == "") | F.coalesce(*[F.when(F.col("own") == f, F.col(f"w_{f}") > 0) for f in FORMS], F.lit(False))
    one = both.filter(fits).groupBy("a").agg(F.min("root").alias("b"), F.count_distinct("root").alias("n"))
    return one.filter("n = 1").select("a", "b")


def name_nodes(texts: DataFrame) -> DataFrame:
    """``text, node, parts...`` for ``texts(text, weight)``; names without a proper name are left out.

    Names of the same parts are one node; a bare name's legal form is a part, as
    it helps to choose among firms of that name.
    """
    read = texts.withColumn("p", name_parts(F.col("text"))).select("text", "weight", "p.*").filter("proper <> ''")
    form = F.when((F.col("kind") == "FIRM") & (F.col("trade") == ""), F.col("legal")).otherwise("")
    return read.withColumn("node", F.concat_ws("|", "kind", "proper", "trade", form, "second"))


def name_records(read: DataFrame) -> DataFrame:
    """A record per node for ``resolve``; its legal form is the one it mostly has."""
    keys = [c for c in ("scope", "node", "kind", "proper", "trade", "second") if c in read.columns]
    by_form = read.groupBy(*keys, "legal").agg(F.sum("weight").alias("w"), F.collect_set("initials").alias("i"))
    return by_form.groupBy(*keys).agg(F.max_by("legal", F.struct("w", "legal")).alias("legal"), F.sum("w").alias("weight"), F.array_remove(F.array_distinct(F.flatten(F.collect_set("i"))), "").alias("initials"))


def found_names(employers: DataFrame, aggs: DataFrame, contacts: DataFrame) -> DataFrame:
    """``name_a, name_b``: the pairs of texts that name the same organisation."""
    who = name_classes(employers, aggs, contacts).select(F.col("name_class").alias("root"), F.col("text").alias("name_a"))
    return who.join(who.select("root", F.col("name_a").alias("name_b")), "root").filter("name_a < name_b").select("name_a", "name_b")


def name_classes(employers: DataFrame, aggs: DataFrame, contacts: DataFrame) -> DataFrame:
    """``text, name_class``: the organisation of every distinct text that names one; null, blank and undisclosed names have no row."""
    texts = employers.select(F.col("display_name").alias("text")).unionByName(aggs.select(F.col("display_name").alias("text"))).unionByName(contacts.select(F.col("institution").alias("text")))
    texts = texts.filter(F.trim("text") != "").groupBy("text").agg(F.count("*").alias("weight"))
    read = written(name_nodes(_spread(texts)), "read")
    return read.select("text", "node").join(resolve(name_records(read)), "node").select("text", F.col("root").alias("name_class"))
