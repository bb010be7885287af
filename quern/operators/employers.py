"""Filing statistics of employers: folding, re-keying, combining and indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import employer_norm, entity_stem, simple_key, stem_words

_COUNTS = ("certified", "analyst_certified", "denied")


def fold_filings(rows: DataFrame, name: str, counts: dict[str, Column], decided: Column, states: Column, order: Column) -> DataFrame:
    """A row per normalised name: sums, the latest date, the distinct states and the first name in ``order``.

    ``states`` is an array column.  Rows without a name are left out.  Sums and
    sets are combined before the shuffle.
    """
    keyed = rows.select(employer_norm(F.col(name)).alias("norm_name"), F.trim(name).alias("display_name"), *[c.alias(k) for k, c in counts.items()], decided.alias("decided"), states.alias("states"), order.alias("o"))
    keyed = keyed.filter("norm_name <> ''")
    totals = keyed.groupBy("norm_name").agg(
        F.min_by("display_name", F.struct("o", "display_name")).alias("display_name"),
        *[F.sum(F.coalesce(k, F.lit(0))).cast("long").alias(k) for k in counts],
        F.max(F.substring("decided", 1, 10)).alias("last_decision"),
    )
    named = keyed.select("norm_name", F.explode("states").alias("s")).withColumn("s", F.upper(F.trim("s"))).filter("s <> ''")
    named = named.groupBy("norm_name").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("states"))
    return totals.join(named, "norm_name", "left").withColumn("states", F.coalesce("states", F.lit("")))


def filing_counts(status: Column, occupation: Column, analysts: tuple[str, ...]) -> dict[str, Column]:
    """What a filing adds to its employer's counts: certified, also if withdrawn later, certified for one of the occupations by their base codes, and denied."""
    from quern.functions.text import occupation_base

    state = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    certified = state.startswith("CERTIFIED")
    return {"certified": certified.cast("int"), "analyst_certified": (certified & occupation_base(occupation).isin(*analysts)).cast("int"), "denied": state.startswith("DENIED").cast("int")}


def latest_files(files: DataFrame, years: int = 2) -> DataFrame:
    """``fiscal_year, quarter, name, url`` of the newest years' files, each year's by the highest quarter; a name without a quarter is a whole year's, one without a year is passed over."""
    year = F.regexp_extract("name", r"FY(\d{4})", 1).try_cast("int")
    quarter = F.coalesce(F.regexp_extract("name", r"FY\d{4}_Q(\d)", 1).try_cast("int"), F.lit(4))
    rows = files.select(year.alias("fiscal_year"), quarter.alias("quarter"), "name", "url").filter("fiscal_year is not null")
    best = rows.groupBy("fiscal_year").agg(F.max_by(F.struct("quarter", "name", "url"), F.struct(F.col("quarter"), F.col("name"))).alias("f"))
    return best.select("fiscal_year", "f.*").orderBy(F.desc("fiscal_year")).limit(years)


def rekey(employers: DataFrame) -> DataFrame:
    """Statistics under the normalised display name; the spelling with most filings names the merged row."""
    key = F.coalesce(F.nullif(employer_norm(F.col("display_name")), F.lit("")), F.col("norm_name"))
    keyed = employers.withColumn("norm_name", key).filter("norm_name is not null")
    return keyed.groupBy("norm_name").agg(
        F.max_by("display_name", F.struct(F.coalesce("certified", F.lit(0)), "display_name")).alias("display_name"),
        *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in _COUNTS],
        F.max(F.coalesce("last_decision", F.lit(""))).alias("last_decision"),
    )


# Single words that are no evidence of a common owner.
GENERIC_STEMS = (
    "CONSULTING TECHNOLOGY TECHNOLOGIES SOLUTIONS SYSTEMS PARTNERS CAPITAL GLOBAL INTERNATIONAL ENTERPRISES VENTURES MANAGEMENT ANALYTICS DIGITAL LABS "
    "LABORATORY STAFFING RECRUITING SOFTWARE DATA HEALTH HEALTHCARE MEDICAL FINANCIAL INSURANCE BANK UNIVERSITY COLLEGE SCHOOL DISTRICT HOSPITAL CLINIC "
    "FOUNDATION INSTITUTE RESEARCH ENGINEERING CONSTRUCTION LOGISTICS TRANSPORT RETAIL ENERGY"
).split()

# Words that many institutions' names share, with the single words above.
GENERIC_WORDS = (
    "UNIVERSITY UNIVERSITIES COLLEGE SCHOOL MEDICAL CENTER CENTERS CENTRE HOSPITAL HOSPITALS "
    "HEALTH HEALTHCARE SCIENCES SCIENCE INSTITUTE INSTITUTES RESEARCH LABORATORY LABORATORIES "
    "CLINIC FOUNDATION SYSTEM SYSTEMS DEPARTMENT DIVISION FACULTY GRADUATE NATIONAL STATE "
    "REGIONAL MEMORIAL CHILDRENS CHILDREN GENERAL COMMUNITY COMPREHENSIVE CANCER HEART BRAIN "
    "TRUSTEES BOARD REGENTS AUTHORITY TRUST THE OF AND FOR AT IN S "
    "ARTIFICIAL INTELLIGENCE MACHINE LEARNING AI ML ADVANCED APPLIED INNOVATION "
    "INNOVATIONS CLOUD CYBER SMART GROUP COMPANY CORP INCORPORATED"
).split() + GENERIC_STEMS


def _word_lists(employers: DataFrame, key: str, name: str) -> DataFrame:
    return employers.select(F.col(key).alias("k"), stem_words(employer_norm(F.col(name))).alias("w"))


def _kin(lists: DataFrame) -> DataFrame:
    """``w, short``: pairs of different word lists of one institution, both ways round.

    The words of the one must start those of the other, or end them after
    generic words alone; two words at least, one of them not generic.  A list
    meets its own beginnings and ends by equality.
    """
    generic = lambda w: w.isin(GENERIC_WORDS)
    own = F.exists("w", lambda x: ~generic(x))
    # starts: all whole beginnings of two words or more that say something; ends: the same from the other side
    spoken = lists.filter(own & (F.size("w") >= 2)).select(F.col("w").alias("short"))
    begin = lists.select("w", F.explode(F.when(F.size("w") > 2, F.sequence(F.lit(2), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))).alias("n"))
    heads = begin.select("w", F.slice(F.col("w"), F.lit(1), F.col("n")).alias("short"))
    tails = begin.filter(F.forall(F.slice(F.col("w"), F.lit(1), F.size("w") - F.col("n")), generic)).select("w", F.slice(F.col("w"), F.size("w") - F.col("n") + 1, F.col("n")).alias("short"))
    met = heads.unionByName(tails).join(spoken, "short").select("w", "short").distinct()
    return met.unionByName(met.select(F.col("short").alias("w"), F.col("w").alias("short")))


def affix_siblings(employers: DataFrame, key: str = "norm_name", name: str = "display_name") -> DataFrame:
    """``key, sibling`` of names that are one institution spelled differently, both ways round: with equal word lists, or lists of which one starts or ends the other.

    The result is pairs; ``family_totals`` has the sums over them without any.
    """
    words = _word_lists(employers, key, name).filter(F.size("w") > 0)
    lists = words.select("w").distinct()
    same = lists.select("w", F.col("w").alias("short"))
    pairs = _kin(lists).unionByName(same).join(words.select(F.col("k").alias("sibling"), F.col("w").alias("short")), "short").join(words, "w")
    return pairs.filter("k <> sibling").select(F.col("k").alias(key), "sibling").distinct()


def family_totals(employers: DataFrame) -> DataFrame:
    """Each employer's statistics together with its siblings', as ``combine`` has them.

    Names of one word list are summed once, and the sums then over the lists that
    start or end each other, so that many names of one list make no pairs.
    """
    words = _word_lists(employers, "norm_name", "display_name").withColumnRenamed("k", "norm_name")
    # a name without words is a family of its own
    family = F.when(F.size("w") > 0, F.concat(F.lit("w:"), F.array_join("w", " "))).otherwise(F.concat(F.lit("k:"), "norm_name"))
    rows = employers.join(words, "norm_name").withColumn("family", family)
    best = F.max(F.struct("certified", "display_name")).alias("best")
    sums = lambda: [*[F.sum(c).cast("long").alias(c) for c in _COUNTS], F.max("last_decision").alias("last_decision")]
    of_list = rows.groupBy("family", "w").agg(best, *sums(), F.count("*").alias("members"))
    lists = of_list.filter(F.size("w") > 0).select("w")
    kin = _kin(lists).select(F.concat(F.lit("w:"), F.array_join("w", " ")).alias("family"), F.concat(F.lit("w:"), F.array_join("short", " ")).alias("other"))
    reach = kin.unionByName(of_list.select("family", F.col("family").alias("other")))
    whole = reach.join(of_list.drop("w").withColumnRenamed("family", "other"), "other").groupBy("family").agg(F.max("best").alias("best"), *sums(), F.sum("members").alias("members"))
    return rows.select("norm_name", "family").join(whole, "family").select("norm_name", F.col("best.display_name").alias("display_name"), *_COUNTS, "last_decision", "members")


def combine(groups: DataFrame, employers: DataFrame, group: str, member: str) -> DataFrame:
    """The statistics of each group's members together, named by the one with most filings."""
    rows = groups.join(employers.withColumnRenamed("norm_name", member), member)
    return rows.groupBy(group).agg(
        F.max_by("display_name", F.struct("certified", "display_name")).alias("display_name"),
        *[F.sum(c).cast("long").alias(c) for c in _COUNTS],
        F.max("last_decision").alias("last_decision"),
        F.count("*").alias("members"),
    )


def name_index(employers: DataFrame, least: int = 1) -> DataFrame:
    """``form, certified, analyst_certified``: lookup forms of every employer with its siblings' filings; the larger wins a form."""
    merged = family_totals(employers).select("norm_name", F.col("certified").alias("c"), F.col("analyst_certified").alias("a"))
    rows = employers.filter(F.col("certified") >= least).join(merged, "norm_name")
    forms = F.array_distinct(F.array(simple_key(F.col("display_name")), simple_key(employer_norm(F.col("display_name")))))
    rows = rows.select(F.explode(forms).alias("form"), "c", "a").filter("form <> ''")
    best = F.max(F.struct("c", "a"))
    return rows.groupBy("form").agg(best.alias("x")).select("form", F.col("x.c").alias("certified"), F.col("x.a").alias("analyst_certified"))


def block_pairs(names: DataFrame, employers: DataFrame) -> DataFrame:
    """``norm, candidate`` that share the first six characters or the first word; both sides distinct."""
    keys = lambda c: F.array_distinct(F.array(F.concat(F.lit("p:"), F.substring(c, 1, 6)), F.concat(F.lit("w:"), F.split(c, " ")[0])))
    left = names.select("norm").distinct().filter("norm <> ''").select("norm", F.explode(keys(F.col("norm"))).alias("b"))
    right = employers.select(F.col("norm_name").alias("candidate")).distinct().filter("candidate <> ''").select("candidate", F.explode(keys(F.col("candidate"))).alias("b"))
    return left.join(right, "b").select("norm", "candidate").distinct()


def match_names(names: DataFrame, employers: DataFrame, accept: int = 88, margin: int = 3, shortest: int = 5, top: int = 8, aliases: DataFrame | None = None) -> DataFrame:
    """``norm, method, score, names``: each name's employers, or why there are none.

    In order: an equal name; the employer that ``aliases`` (``norm, alias``, both
    brought to keys; the greatest of several) names, if there is one; for names of fewer than ``shortest`` letters the
    one employer of at most two words that starts with it; the best of the
    blocked candidates by word-set similarity.  Candidates within ``margin`` of
    the best are one employer if they share a stem that says something, else
    the name is refused as ambiguous.  Ties are in the order of names.
    """
    from pyspark.sql import Window

    from quern.functions.udf import name_similarity

    left = names.select("norm").distinct().filter("norm <> ''")
    right = employers.select(F.col("norm_name").alias("candidate")).distinct()
    exact = left.join(right, left["norm"] == right["candidate"]).select("norm", F.lit("exact").alias("method"), F.lit(100).alias("score"), F.array("candidate").alias("names"))
    rest = left.join(exact, "norm", "left_anti")
    if aliases is not None:
        said = aliases.filter("norm <> ''").groupBy("norm").agg(F.max("alias").alias("candidate"))
        by_alias = rest.join(said, "norm").join(right, "candidate").select("norm", F.lit("alias").alias("method"), F.lit(100).alias("score"), F.array("candidate").alias("names"))
        rest = rest.join(by_alias.select("norm"), "norm", "left_anti")
        exact = exact.unionByName(by_alias)
    brief = F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) < shortest
    heads = right.select("candidate", F.split("candidate", " ").alias("w")).filter(F.size("w") <= 2).select("candidate", F.col("w")[0].alias("norm"))
    short = rest.filter(brief).join(heads, "norm", "left").groupBy("norm").agg(F.count("candidate").alias("n"), F.min("candidate").alias("c"))
    short = short.select("norm", F.when(F.col("n") == 1, "short-name").otherwise("too-short").alias("method"), F.lit(None).cast("int").alias("score"), F.when(F.col("n") == 1, F.array("c")).otherwise(F.array().cast("array<string>")).alias("names"))
    long = rest.filter(~brief)
    scored = block_pairs(long, employers).withColumn("score", name_similarity(F.col("norm"), F.col("candidate")))
    place = F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("score"), "candidate"))
    best = scored.withColumn("place", place).filter(F.col("place") <= top).withColumn("best", F.max("score").over(Window.partitionBy("norm")))
    tied = best.filter((F.col("best") >= accept) & (F.col("best") - F.col("score") < margin)).withColumn("stem", entity_stem(F.col("candidate")))
    # at most `top` candidates each
    tied = tied.groupBy("norm").agg(F.max("best").alias("score"), F.array_sort(F.collect_list("candidate")).alias("names"), F.collect_set("stem").alias("stems"))
    stem = F.col("stems")[0]
    sibling = (F.size("stems") == 1) & (F.length(stem) >= 4) & ~stem.isin(GENERIC_STEMS)
    one = F.size("names") == 1
    tied = tied.select("norm", F.when(one, "fuzzy").when(sibling, "sibling-entities").otherwise("ambiguous").alias("method"), "score", F.when(one | sibling, F.col("names")).otherwise(F.array().cast("array<string>")).alias("names"))
    low = best.groupBy("norm").agg(F.max("best").alias("s"))
    none = long.join(tied, "norm", "left_anti").join(low, "norm", "left").select("norm", F.lit("none").alias("method"), F.col("s").alias("score"), F.array().cast("array<string>").alias("names"))
    return exact.unionByName(short).unionByName(tied).unionByName(none)
