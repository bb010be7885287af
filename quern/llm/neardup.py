"""Near-duplicate texts by fast similarity sketching.

A text's set of word sequences is sketched in rounds: round i throws every
element at a bin by a hash of its own and a bin keeps the least value, the round
counting first; once every bin has a value the sketch is done, and bins that
stay empty after as many rounds as there are bins get the least hash of a last
round of their own.  So every coordinate is filled, whatever the size of the
set, and the share of equal coordinates is concentrated around the similarity.
Bands of coordinates give candidates, more coordinates dismiss the hopeless
ones, and the sets themselves decide.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quern.operators.components import components
from quern.session import counted, forget, written

BANDS, ROWS, EXTRA = 40, 6, 96
#: Counters of the sample in which crowded bands show, the part of the texts that is sampled, and the parts of a crowded band.
SLOTS, SAMPLED, SALTS = 65_536, 16, 64
#: At most so many keys are broadcast; beyond it the join is by shuffle.
BROADCAST_ROWS = 2_000_000

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|code|em|font|i|mark|s|small|span|strong|sub|sup|u|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<[!?][^<>]*>")
_MARKUP = re.compile(r"</?[a-zA-Z!?]")
_WORD = re.compile(r"[^\W_]+")


def visible_text(markup: str | None) -> str:
    """The text a reader sees: no markup or comments, entities resolved.

    Markup that was escaped once more is known by having no tag until its
    entities are resolved; a flag isn't needed.
    """
    text = markup or ""
    for _ in range(3):
        if _MARKUP.search(text) or "&lt;" not in text:
            break
        text = html.unescape(text)
    text = _TAG.sub(" ", _INLINE.sub("", _COMMENT.sub(" ", text)))
    text = html.unescape(text)
    return html.unescape(text) if "&" in text else text


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h
        return h


_words = _Words()


def shingles(words: list[str], size: int) -> np.ndarray:
    """Hashes of the distinct sequences of ``size`` words, sorted; a shorter text is one sequence."""
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < size:
        return np.array([np.bitwise_xor.reduce(_mix(h + np.arange(len(h), dtype=np.uint64)))] if len(h) else [], dtype=np.uint64)
    out = h[: len(h) - size + 1]
    for i in range(1, size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of ``bins`` values for each set that isn't empty, all filled."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * bins, full)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    elements = np.concatenate(sets) if len(sets) else np.array([], dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    low = np.uint64(0xFFFFFFFF)
    for i in range(bins):
        if not len(elements):
            break
        h = _mix(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = owner * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, at, (np.uint64(i) << np.uint64(32)) | (h & low))
        open_ = (out.reshape(-1, bins) == full).any(axis=1)
        keep = open_[owner]
        elements, owner = elements[keep], owner[keep]
    for s, b in zip(*np.nonzero(out.reshape(-1, bins) == full)):
        if len(sets[s]):
            h = _mix(sets[s] + np.uint64((bins + int(b) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            out[s * bins + b] = (np.uint64(bins) << np.uint64(32)) | (h & low).min()
    return out.reshape(-1, bins)


def _bands(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sketch), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(sketch), np.uint64(b + 1))
        for j in range(b * rows, (b + 1) * rows):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sketch[:, j])
        out[:, b] = h
    return out.view(np.int64)


def sketch_table(docs: DataFrame, size: int, least_words: int) -> DataFrame:
    """``id, fp, bands, extra, grams`` of ``docs(id, head, markup, plain)``.

    ``fp`` is the fingerprint of the word sequence, null for texts with fewer
    than ``least_words`` words beside the head.  Of equal texts in a task only
    the first carries its sketch, so that copies are gone before any shuffle.
    """
    schema = "id long, fp long, bands array<long>, extra binary, grams binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        for batch in batches:
            head, markup, plain = (batch.column(c).to_pylist() for c in ("head", "markup", "plain"))
            prints, fresh, sets = [], [], []
            for h, m, p in zip(head, markup, plain):
                body = _WORD.findall((visible_text(m) if m is not None else p or "").lower())
                if len(body) < least_words:
                    prints.append(None)
                    fresh.append(False)
                    continue
                words = _WORD.findall((h or "").lower()) + body
                fp = xxhash.xxh3_64_intdigest(" ".join(words))
                prints.append(fp - (1 << 64) if fp >> 63 else fp)
                new = fp not in seen
                fresh.append(new)
                if new:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(fp)
                    sets.append(shingles(words, size))
            sketch = sketches(sets, BANDS * ROWS + EXTRA)
            bands = _bands(sketch, BANDS, ROWS)
            extra = (_mix(sketch[:, BANDS * ROWS :]) & np.uint64(0xFF)).astype(np.uint8)
            offsets = np.concatenate([[0], np.cumsum(np.where(fresh, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1)))
            more = iter(zip(extra, sets))
            tails = [next(more) if f else (None, None) for f in fresh]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(prints, pa.int64()),
                    lists,
                    pa.array([None if e is None else e.tobytes() for e, _ in tails], pa.binary()),
                    pa.array([None if s is None else np.unique((s >> np.uint64(16)).astype(np.uint32)).tobytes() for _, s in tails], pa.binary()),
                ],
                names=["id", "fp", "bands", "extra", "grams"],
            )

    return docs.select(F.col("id").cast("long"), "head", "markup", "plain").mapInArrow(run, schema)


@F.pandas_udf(T.BooleanType())
def _hopeful(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), EXTRA) for s in (a, b))
    return pd.Series((x == y).mean(axis=1) >= least.to_numpy())


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of sets of 32-bit values; the pairs of a batch are sorted as one array, with the pair in the upper half of each value."""
    if not len(a):
        return pd.Series([], dtype=float)
    count = lambda s: np.fromiter((len(x) // 4 for x in s), dtype=np.int64, count=len(s))
    na, nb = count(a), count(b)
    values = np.frombuffer(b"".join([*a, *b]), dtype=np.uint32).astype(np.uint64)
    owner = np.concatenate([np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)]).astype(np.uint64)
    both = np.sort(owner << np.uint64(32) | values)
    same = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(a))
    return pd.Series(same / np.maximum(1, na + nb - same))


def _only(df: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys(k)``, of which there are ``n``."""
    keys = keys.withColumnRenamed("k", key)
    return df.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, key, "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` of fingerprints whose sets are similar enough."""
    least = max(0.0, threshold - 5 * (threshold * (1 - threshold) / EXTRA) ** 0.5)
    # tasks that met the same text have each kept its sketch
    one = texts.select("fp", "extra").dropDuplicates(["fp"])
    hopeful = pairs.join(one.toDF("a", "ea"), "a").join(one.toDF("b", "eb"), "b").filter(_hopeful("ea", "eb", F.lit(least))).select("a", "b")
    hopeful, n = counted(hopeful, "hopeful")
    ends = hopeful.select(F.col("a").alias("k")).union(hopeful.select(F.col("b").alias("k"))).distinct()
    grams = _only(texts.select("fp", "grams"), "fp", ends, 2 * n).dropDuplicates(["fp"])
    both = hopeful.join(grams.toDF("a", "ga"), "a").join(grams.toDF("b", "gb"), "b")
    out = written(both.filter(_similarity("ga", "gb") >= threshold).select("a", "b"), "verified")
    forget(hopeful)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, least_words: int = 1, hot: int = 5000) -> DataFrame:
    """``id, text_class, spanning_links``: the class of every document's text.

    ``docs`` has ``id, head, markup, plain``: the text is the head followed by
    what is visible of the markup, or by the plain text where that is null.  Two
    texts are linked if at least ``threshold`` of the distinct sequences of
    ``size`` words of either occur in both; classes are closed under links.
    ``text_class`` is a fingerprint, null for texts of fewer than
    ``least_words`` words; equal texts always share it.
    ``spanning_links`` is the number of verified links of the document's text
    among those that were compared, which span the classes: not of all similar
    texts, as pairs that a class already connects are skipped.

    Each band first compares its texts with the least of them; where one isn't
    similar, those of its pairs that no class connects yet are compared too.  So
    a class of many texts costs a comparison for each, not for each pair.
    Bands that a sample shows to be very full are split by a salt for both: the
    heads of the parts are compared with the least of them, and the pairs of a
    band are laid out over tiles.  ``hot`` is how many sampled texts of a band
    more than usual make it full.

    A pair is dismissed without its sets only if the share of equal coordinates
    among ``EXTRA`` others is five deviations below the threshold.
    """
    table, rows = counted(sketch_table(docs, size, least_words), "sketches")
    ids = table.select("id", "fp").distinct()
    # one sketch for each text; other tasks may have kept their own
    texts = table.filter("extra is not null")
    many = texts.select("fp", F.explode("bands").alias("band")).withColumn("slot", F.pmod(F.xxhash64("band"), F.lit(SLOTS)).cast("int"))
    # a sample counts bands by slot: a fixed number of counters, however many bands; what shares a slot with a crowded band is salted like it, which changes no result
    sampled = many.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0).groupBy("slot").agg(F.count("*").alias("c"))
    full = sampled.filter(F.col("c") > hot + rows * BANDS / SAMPLED / SLOTS).select("slot", F.lit(True).alias("full"))
    many = many.join(F.broadcast(full), "slot", "left").select("fp", "band", F.coalesce("full", F.lit(False)).alias("full"))
    many = many.withColumn("salt", F.when(F.col("full"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).otherwise(0)).repartition("band", "salt")
    # the least and the greatest of a band are aggregates; the one exchange serves them and the join with them
    heads = many.groupBy("band", "salt").agg(F.min("fp").alias("head"), F.max("fp").alias("last"), F.max("full").alias("full")).filter("full or head <> last")
    buckets = written(many.join(heads.select("band", "salt", "head"), ["band", "salt"]), "buckets")
    stars = buckets.filter("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    # the heads of a crowded band's salts meet the least of them
    salted = buckets.filter("full").select("band", "head").distinct()
    least = salted.groupBy("band").agg(F.min("head").alias("b"))
    stars = stars.unionByName(salted.join(least, "band").select(F.col("head").alias("a"), "b").filter("a <> b")).distinct()
    stars = written(stars, "stars")
    links = _verified(stars, texts, threshold)
    # bands in which a text isn't linked to its head: compare what no verified link to a common head connects
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    label = lambda df, c: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    sized = label(buckets.select("band", "fp", "salt", "full"), "fp")
    mixed = sized.groupBy("band").agg(F.min("fp_root").alias("lo"), F.max("fp_root").alias("hi"), F.count("*").alias("c")).filter("lo <> hi and c > 2").select("band")
    rest = sized.join(mixed, "band", "left_semi")
    # the pairs of a crowded band are laid out over SALTS x SALTS tiles, so that no task has all of them
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    tile = lambda name, free: rest.withColumn(free, F.explode(F.when(F.col("full"), every).otherwise(F.array(F.lit(0))))).select("band", F.col("fp").alias(name), F.col("fp_root").alias(f"{name}_root"), F.col("salt").alias("j" if free == "i" else "i"), free)
    pairs = tile("a", "j").join(tile("b", "i"), ["band", "i", "j"]).filter("a > b and a_root <> b_root").select("a", "b").distinct()
    pairs = written(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    forget(buckets, stars)
    more = _verified(pairs, texts, threshold)
    links = links.unionByName(more)
    roots = components(links)
    ends = links.select(F.col("a").alias("fp")).union(links.select("b")).groupBy("fp").agg(F.count("*").alias("links"))
    out = ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(ends, "fp", "left")
    out = written(out.select("id", F.coalesce("root", "fp").alias("text_class"), F.coalesce("links", F.lit(0)).cast("long").alias("spanning_links")), "classes")
    forget(table, pairs)
    return out


_DESCRIPTION_WORDS, _SEQUENCE, _SHARE = 40, 3, 0.7


def _address(url: Column) -> Column:
    """An address as compared: case of scheme and host, queries, fragments and last slashes aside."""
    plain = F.regexp_replace(F.trim(url), r"[?#].*$|/+$", "")
    plain = F.regexp_replace(plain, r"/+$", "")
    host = F.regexp_extract(plain, r"^(?i)(?:https?://)?([^/]*)", 1)
    return F.concat(F.lower(host), F.regexp_extract(plain, r"^(?i)(?:https?://)?[^/]*(/.*)?$", 1))


def _pairs(members: DataFrame, kind: str) -> DataFrame:
    """All pairs of ``members(g, id)`` of one group; the result's definition asks for each."""
    members = members.dropna().distinct()
    other = members.select("g", F.col("id").alias("id_b"))
    return members.withColumnRenamed("id", "id_a").join(other, "g").filter("id_a < id_b").select(F.lit(kind).alias("kind"), "id_a", "id_b").distinct()


def found_duplicates(postings: DataFrame, queue: DataFrame) -> DataFrame:
    """``kind, id_a, id_b``: the pairs of postings of one ad, and of queue entries that lead to one."""
    docs = postings.select(F.col("posting_id").alias("id"), F.col("title").alias("head"), F.col("description_html").alias("markup"), F.col("description_text").alias("plain"))
    classes = near_duplicates(docs, _SEQUENCE, _SHARE, _DESCRIPTION_WORDS)
    # a posting without enough words is a group of its own
    groups = classes.select("id", F.coalesce(F.concat(F.lit("t"), "text_class"), F.concat(F.lit("p"), "id")).alias("g"))
    leads = postings.select(F.col("posting_id").alias("id"), _address(F.col("url")).alias("at")).filter("at <> ''").groupBy("at").agg(F.min("id").alias("id"))
    leads = leads.join(groups.groupBy("id").agg(F.min("g").alias("g")), "id").select("at", "g")
    entries = queue.select("entry_id", _address(F.coalesce("url", F.lit(""))).alias("at"), F.lower(F.trim("dedupe_key")).alias("key")).distinct()
    direct = entries.filter("at <> ''").join(leads, "at", "left").select(F.col("entry_id").alias("id"), "key", F.coalesce("g", F.concat(F.lit("u"), "at")).alias("g"))
    direct = written(direct, "direct")
    # blank addresses stand for the group of their key, or for one of their own
    keyed = direct.filter("key <> ''").select("key", "g").distinct()
    blank = entries.filter("at = '' and key <> ''").select(F.col("entry_id").alias("id"), "key").join(keyed, "key", "left")
    blank = blank.select("id", F.coalesce("g", F.concat(F.lit("k"), "key")).alias("g"))
    both = direct.select("g", "id").unionByName(blank.select("g", "id"))
    return _pairs(groups.filter(F.col("g").startswith("t")), "posting").unionByName(_pairs(both, "queue"))
