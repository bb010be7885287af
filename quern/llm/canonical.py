"""Mapping free-entered values to the entries of a canonical list.

Built-in expressions and joins only.  Each entry is spelled out in the ways
people write it: words turned around, shortened by rule or one of them left out.
All values are joined with the spellings by the pigeonhole principle: a spelling
is cut into k + 1 segments, of which a value within k edits must hold one at
nearly its place, so an equality join on (length, segment, substring) finds all
candidates and the built-in ``levenshtein`` decides.  A spelling that allows no
edit is one segment.  What no spelling is near comes out of an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.session import counted, written

# Words beside the name of a post or skill.
RANKS = ("sr", "senior", "jr", "junior", "lead", "principal", "staff")
LEVELS = ("i", "ii", "iii", "iv")
SKILL_REMARKS = ("strong", "basic", "advanced", "expert", "proficient", "solid", "hands on", "handson", "working knowledge of", "knowledge of", "experience with", "experience in", "familiar with", "certified", "certification", "years", "year", "yrs", "yr")
NOTICES = ("apply now", "now hiring", "urgent", "new", "full time", "part time", "nights", r"\d+ month contract", r"r\d{4,}", r"(?:#\s*)?req[- ]?\d+", r"jr\d{4,}")

#: Edits in which candidates are looked for, the letters from which a spelling allows any, and those that a further step of cost asks for.
EDITS, SHORTEST, PER_COST = 2, 5, 2
#: The most segments that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def _typed(key: Column, spelling: Column, dist: Column, cost: Column) -> Column:
    """Whether the edits between them are a typing error.

    One edit or two letters changed over; two edits only in a full spelling of
    nine letters or more, as a short form two edits away may be another word.
    """
    letters = lambda x: F.array_sort(F.split(x, ""))
    return (dist <= 1) | (letters(key) == letters(spelling)) | ((cost == 0) & (F.length(spelling) >= 9))


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]+", "")


def _plain(text: Column) -> Column:
    """Lower case with accents off and blanks single."""
    text = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ’", "aaaaaaceeeeiiiinoooooouuuuyy'")
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


# Endings and how they are shortened.
ENDINGS = {"ment": "mt", "ing": "g", "tion": "n", "er": "r", "ist": "st"}


def _forms(word: Column) -> Column:
    """A word and its other forms, with what each costs.

    1 for its plural, a doubled consonant before -er, its beginning, the word
    without vowels from some letter on, and its beginning or consonants with a
    shortened ending; 2 for its first letter, one to three later consonants and the
    last one, or its beginning and last letter.
    """
    none = F.array().cast("array<string>")
    after = lambda x, n: F.substring(x, F.lit(n + 1), F.length(x))
    plain = lambda x, n=1: F.concat(F.substring(x, 1, n), F.regexp_replace(after(x, n), "[aeiou]", ""))
    begins = lambda x, least, less: F.when(F.length(x) >= least + less, F.transform(F.sequence(F.lit(least), F.length(x) - less), lambda n: F.substring(x, F.lit(1), n))).otherwise(none)
    bare = plain(word)
    barer = F.regexp_replace(bare, "(?<=.)y", "")
    inner = F.concat(F.substring(word, 1, 1), F.regexp_replace(after(word, 1), "[aeiou](?=.)", ""))
    doubled = F.regexp_replace(word, "([^aeiou])er$", "$1$1er")

    def ended(end: str, to: str) -> Column:
        stem = F.substring(word, F.lit(1), F.greatest(F.lit(0), F.length(word) - len(end)))
        heads = F.array(F.substring(stem, 1, 3), F.substring(stem, 1, 4), F.array_join(F.array_distinct(F.split(plain(stem), "")), ""))
        return F.when(word.endswith(end), F.transform(heads, lambda x: F.concat(x, F.lit(to)))).otherwise(none)

    near = F.concat(F.array(bare, barer, inner, F.regexp_replace(barer, r"(.)\1", "$1"), F.concat(word, F.lit("s")), doubled, plain(doubled), plain(word, 2), plain(word, 3)), begins(word, 3, 2), *[ended(*e) for e in ENDINGS.items()])
    between = F.filter(F.split(F.substring(bare, F.lit(2), F.length(bare) - 2), ""), lambda c: c != "")
    more = lambda taken: F.flatten(F.transform(taken, lambda t: F.transform(F.slice(between, t["at"] + 2, F.size(between)), lambda c, i: F.struct(F.concat(t["x"], c).alias("x"), (t["at"] + 1 + i).alias("at")))))
    ones = F.transform(between, lambda c, i: F.struct(c.alias("x"), i.alias("at")))
    twos = more(ones)
    some = F.transform(F.concat(ones, twos, more(twos)), lambda t: t["x"])
    far = F.concat(F.transform(some, lambda x: F.concat(F.substring(word, 1, 1), x, F.substring(bare, -1, 1))), F.transform(begins(word, 3, 3), lambda x: F.concat(x, F.substring(word, -1, 1))))
    usable = lambda forms: F.filter(F.array_distinct(forms), lambda s: (s != word) & (F.length(s) > 2))
    cost = lambda forms, n: F.transform(forms, lambda s: F.struct(s.alias("s"), F.lit(n).alias("c")))
    return F.concat(cost(F.array(word), 0), cost(usable(near), 1), cost(F.array_except(usable(far), near), 2))


def _spell(words: Column, most: int) -> Column:
    """All ways to write the words in this order whose short forms cost at most ``most`` together."""
    start = F.array(F.struct(F.lit("").alias("s"), F.lit(0).alias("c")))
    return F.aggregate(
        words,
        start,
        lambda done, word: F.filter(
            F.flatten(F.transform(done, lambda a: F.transform(_forms(word), lambda f: F.struct(F.concat(a["s"], f["s"]).alias("s"), (a["c"] + f["c"]).alias("c"))))),
            lambda x: x["c"] <= most,
        ),
    )


def _turned(words: Column) -> Column:
    n = F.size(words)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.slice(words, i + 1, n - i), F.slice(words, F.lit(1), i)))


def spellings(entries: DataFrame, shorten: bool) -> DataFrame:
    """``ref_id, spelling, cost`` for ``entries(ref_id, name)``.

    With ``shorten`` words may be shortened (at a cost of three together) and one
    of three or more left out (2).  A spelling that several entries have at the
    least cost fits none of them.
    """
    words = F.filter(F.split(_plain(F.col("name")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    base = entries.filter(F.length(F.trim("name")) > 0).select("ref_id", words.alias("w")).filter(F.size("w") > 0)
    if shorten:
        n = F.size("w")
        out = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n), lambda i: F.filter(F.col("w"), lambda x, j: j + 1 != i)))
        less = base.select("ref_id", F.explode(out).alias("w")).withColumn("left", F.lit(2))
        base = base.withColumn("left", F.lit(0)).unionByName(less)
        parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ways = base.select("ref_id", "left", F.explode(_turned(F.col("w"))).alias("w")).repartition(parts).select("ref_id", "left", F.explode(_spell(F.col("w"), 3)).alias("x"))
        ways = ways.select("ref_id", F.col("x.s").alias("spelling"), (F.col("left") + F.col("x.c")).alias("cost"))
    else:
        turned = base.select("ref_id", F.explode(_turned(F.filter("w", lambda x: x != "of"))).alias("w")).withColumn("cost", F.lit(1))
        ways = base.withColumn("cost", F.lit(0)).unionByName(turned).select("ref_id", F.array_join("w", "").alias("spelling"), "cost")
    ways = ways.withColumn("spelling", _letters(F.col("spelling"))).filter("spelling <> ''")
    # a word left out and two shortened leave too little to go by
    ways = ways.filter("cost <= 4").groupBy("spelling", "ref_id").agg(F.min("cost").alias("cost"))
    by_cost = Window.partitionBy("spelling")
    ways = ways.withColumn("least", F.min("cost").over(by_cost)).filter("cost = least").withColumn("n", F.count("*").over(by_cost))
    return ways.filter("n = 1").select("ref_id", "spelling", "cost")


_SEGMENT = "substring(spelling, seg_at + 1, seg_len)"


def near_spellings(keys: DataFrame, ways: DataFrame) -> DataFrame:
    """``key, ref_id, dist, cost`` of every key within the edits that a spelling allows.

    A spelling of ``SHORTEST`` letters or more allows ``EDITS`` if its cost is
    below 2 or it is long for its cost; any other allows none.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edits = (F.col("l") >= SHORTEST) & ((F.col("cost") < 2) | ((F.col("cost") <= 3) & (F.col("l") >= 6 + PER_COST * F.col("cost"))))
    refs = ways.withColumn("l", F.length("spelling")).withColumn("k", F.when(edits, EDITS).otherwise(0))
    refs = refs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    seg_at, next_at = "cast(floor(i * l / (k + 1)) as int)", "cast(floor((i + 1) * l / (k + 1)) as int)"
    refs = refs.withColumn("seg_at", F.expr(seg_at)).withColumn("seg_len", F.expr(f"{next_at} - seg_at")).withColumn("part", F.expr(_SEGMENT))
    refs, n = counted(refs.select("k", "l", "i", "part", "spelling", "ref_id", "cost"), "segments")
    # substrings of a key where a spelling of l letters could have its i-th segment; the whole key for spellings that allow no edit
    keys = keys.withColumn("kl", F.length("key")).repartition(parts).withColumn("k", F.explode(F.array(F.lit(0), F.lit(EDITS))))
    keys = keys.withColumn("l", F.explode(F.sequence(F.greatest(F.lit(1), F.col("kl") - F.col("k")), F.col("kl") + F.col("k")))).filter(f"k = 0 or l >= {SHORTEST}")
    keys = keys.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("at", F.expr(seg_at)).withColumn("seg_len", F.expr(f"{next_at} - at"))
    # with i edits at most before the segment and k - i after it in one of the two counts
    places = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("k")), F.least(F.col("kl") - F.col("seg_len"), F.col("at") + F.col("k")))
    keys = keys.filter("kl >= seg_len and at - k <= kl - seg_len").withColumn("p", F.explode(places))
    keys = keys.select("key", "k", "l", "i", F.expr("substring(key, p + 1, seg_len)").alias("part"))
    # a list written by people: its segments go to the values, which so don't move
    pairs = keys.join(F.broadcast(refs) if n <= BROADCAST_ROWS else refs, ["k", "l", "i", "part"]).select("key", "spelling", "ref_id", "cost", "k").distinct()
    pairs = pairs.withColumn("dist", F.expr("levenshtein(key, spelling, k)")).filter("dist >= 0").filter(_typed(F.col("key"), F.col("spelling"), F.col("dist"), F.col("cost")))
    return pairs.select("key", "ref_id", "dist", "cost")


def match(values: DataFrame, ways: DataFrame) -> DataFrame:
    """``value, ref_id, dist`` of the values of ``values(value, keys)`` that an entry fits.

    ``keys`` are the value's readings, the first being the fullest.  The first
    reading that equals a spelling counts, else the first that is near one; of
    several fits the one with the fewest edits, then the least cost; a tie
    between entries fits none.  ``dist`` is the number of edits.
    """
    readings = values.select("value", F.posexplode("keys").alias("rank", "key")).filter("key <> ''")
    readings = written(readings, "readings")
    near = written(near_spellings(readings.select("key").distinct(), ways), "near")
    fits = readings.join(near, "key").groupBy("value", "ref_id").agg(F.min(F.struct((F.col("dist") > 0).alias("edited"), F.col("rank"), F.col("dist"), F.col("cost"))).alias("fit"))
    best = fits.groupBy("value").agg(F.min("fit").alias("fit"))
    return fits.join(best, ["value", "fit"]).groupBy("value").agg(F.min("ref_id").alias("ref_id"), F.count("*").alias("n"), F.min("fit.dist").alias("dist")).filter("n = 1").drop("n")


def title_keys(title: Column) -> Column:
    """Readings of a title: without notices, then without what follows a dash, bar, colon or comma."""
    text = F.regexp_replace(_plain(title), r"\([^)]*\)|\[[^\]]*\]|\*[^*]{0,12}\*|[*]+", " ")
    notice = "|".join(NOTICES)
    text = F.regexp_replace(text, rf"(?:^|\s|(?<=[,|:@/#–-]))(?:[,|:@/#–-]+\s*)?\b(?:{notice})\b\s*[:!]?(?=\s|$)", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    place = F.regexp_replace(text, r"\s+[–-]\s+[a-z .']+, [a-z]{2}$", "")

    def bare(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"[^\p{L}]+", " "), r"^\s+|\s+$", "")
        x = F.regexp_replace(x, rf"^(?:(?:{'|'.join(RANKS)})\s+)+", "")
        return _letters(F.regexp_replace(x, rf"(?:\s+(?:{'|'.join(LEVELS)}))+$", ""))

    head = F.regexp_replace(place, r"\s+(?:[–|:@/#]|-+)\s.*$|\s*[|:@#].*$", "")
    last = F.regexp_replace(place, r"\s+(?:[–|:@/#]|-+)\s+(?:(?!\s-+\s)[^–|:@/#])*$", "")
    return F.array_distinct(F.transform(F.array(place, last, head, F.regexp_replace(place, r",[^,]*$", "")), bare))


def skill_keys(text: Column) -> Column:
    """Readings of a skill: without version, level and remark."""
    text = F.regexp_replace(_plain(text), r"\([^)]*\)|\[[^\]]*\]|[*®™]+", " ")
    text = F.regexp_replace(text, r"\s[-–:]\s+\d.*$|\bv?\d[\d.]*\+?", " ")
    remark = "|".join(SKILL_REMARKS)
    less = F.regexp_replace(F.regexp_replace(text, r"(?<=\s)hands-on|^hands-on", " "), rf"(?:^|\s)(?:(?:{remark})(?:\s+|$))+", " ")
    return F.array_distinct(F.array(_letters(less), _letters(text), _letters(F.regexp_replace(less, r"\sof\s", ""))))


def found_canonical(postings: DataFrame, entered: DataFrame, titles: DataFrame, skills: DataFrame) -> DataFrame:
    """``kind, record_id, ref_id``: the entry of every title and skill, 0 where the list has none."""
    from quern.operators.packed import split_packed

    terms = spellings(titles.select(F.col("term_id").alias("ref_id"), F.col("term").alias("name")), shorten=True)
    names = skills.select(F.col("skill_id").alias("ref_id"), F.col("canonical").alias("name"))
    aliases = split_packed(skills.select(F.col("skill_id").alias("ref_id"), "aliases"), "aliases", "list").select("ref_id", F.col("item").alias("name"))
    known = spellings(names.unionByName(aliases), shorten=False)
    parts = []
    for kind, rows, ways, keys in (
        ("title", postings.select(F.col("posting_id").alias("record_id"), F.col("title").alias("value")), terms, title_keys),
        ("skill", entered.select(F.col("entry_id").alias("record_id"), F.col("skill_text").alias("value")), known, skill_keys),
    ):
        if kind == "title":
            rows = rows.filter(F.length(F.regexp_replace("value", r"[\s ]+", "")) > 0)
        rows = rows.filter("record_id is not null").distinct()
        values = rows.select("value").distinct().withColumn("keys", keys(F.coalesce("value", F.lit(""))))
        hits = written(match(values, written(ways, "ways")), "hits")
        matched = rows.join(hits.drop("dist"), "value").select("record_id", "ref_id")
        # what no entry fits comes out with 0
        rest = rows.select("record_id").join(matched.select("record_id"), "record_id", "left_anti").select("record_id", F.lit(0).alias("ref_id"))
        both = matched.unionByName(rest).groupBy("record_id").agg(F.max("ref_id").cast("int").alias("ref_id"))
        parts.append(both.select(F.lit(kind).alias("kind"), F.col("record_id").cast("long"), "ref_id"))
    return parts[0].unionByName(parts[1])
