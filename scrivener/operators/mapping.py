"""Mapping of documents to key messages: likeness of word windows, boosts by mentioned brands, brand lock, ranking.

A document is given as ordered units, and its words are numbered over all of them, so that windows cross unit borders
without joining a document's text in one place. Windows and messages meet on shared terms, never as all pairs; a message
without a shared term and without a mentioned brand scores 0, and no threshold lets it through.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions.quality import half_up
from scrivener.functions.text import STOP_WORDS, brand_aliases, clean_text, first_caps_line, words
from scrivener.operators.matching import alias_positions, fuzzy_brands
from scrivener.operators.ranges import sum_before
from scrivener.session import cut

#: Words of a window and words that it shares with the next.
SIZE, OVERLAP = 160, 30
#: Units of a document that one task reads as a whole, and messages that every task has.
MOST_UNITS, MOST_MESSAGES = 2_000, 20_000
#: Kinds of files whose matches keep to the brand found.
LOCKED = ("pdf", "ppt", "pptx", "image", "video")
#: Kinds of files that give ten matches if no number is asked for.
MEDIA, MEDIA_MOST = ("audio", "video"), 10


@dataclass(frozen=True)
class Rules:
    """Fixed values of the ranking: what a mention adds and its ceiling, thresholds, and the width of a lock."""

    exact: float = 0.18
    exact_most: float = 0.99
    fuzzy: float = 0.08
    fuzzy_most: float = 0.95
    possible: float = 0.18
    possible_most: float = 0.95
    likeness: float = 0.75
    threshold: float = 0.25
    threshold_without_brand: float = 0.40
    lock_width: float = 0.0005
    lock_threshold: float = 0.05
    lock_step: float = 0.05


def map_terms(c: Column) -> Column:
    """Words of two or more letters, digits or underscores, in lower case, without function words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def window_terms(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, at, term, tf`` of the overlapping windows of each document's words, and ``doc, n``, its number of windows.

    units: ``doc, unit, text``; unit is a whole number that orders a document's units.
    """
    step = SIZE - OVERLAP
    rows = units.select("doc", "unit", words(F.coalesce("text", F.lit(""))).alias("w")).where("size(w) > 0")
    counted = rows.select("doc", "unit", F.size("w").alias("n"))
    starts = sum_before(counted, "doc", "unit", "n", "start").select("unit", "start")
    each = rows.join(starts, "unit").select("doc", "start", F.posexplode("w").alias("i", "word"))
    place = F.col("start") + F.col("i")
    first = F.greatest(F.lit(0), F.ceil((place - (SIZE - 1)) / step)).cast("long")
    spread = each.select("doc", F.explode(F.sequence(first, F.floor(place / step).cast("long"))).alias("at"), "word")
    terms = spread.select("doc", "at", F.explode(map_terms(F.col("word"))).alias("term"))
    sizes = counted.groupBy("doc").agg(F.ceil(F.sum("n") / step).cast("long").alias("n"))
    return terms.groupBy("doc", "at", "term").agg(F.count("*").alias("tf")), sizes


def semantic_scores(units: DataFrame, messages: DataFrame) -> DataFrame:
    """``doc, record_key, semantic``: the best TF-IDF cosine of any window of a document with a message, 6 decimals.

    Weights count a document's windows and all messages as the texts of one collection, as if fitted for it alone.
    Documents of at most ``MOST_UNITS`` units are read as a whole, each by one task that has all messages; larger ones,
    and all if there are more than ``MOST_MESSAGES``, are joined term by term, with the same result.
    """
    if messages.limit(MOST_MESSAGES + 1).count() > MOST_MESSAGES:
        return _scores_by_terms(units, messages)
    large = cut(units.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") > MOST_UNITS).select("doc"))
    if not large.limit(1).count():
        return _scores_by_documents(units, messages)
    small = _scores_by_documents(units.join(large, "doc", "left_anti"), messages)
    return small.unionByName(_scores_by_terms(units.join(large, "doc", "left_semi"), messages))


def _scores_by_documents(units: DataFrame, messages: DataFrame) -> DataFrame:
    own = messages.select("record_key", map_terms(F.concat_ws(" ", "brand_product", "key_message")).alias("terms")).collect()  # at most MOST_MESSAGES
    keys = [r.record_key for r in own]
    holders: dict[str, list[tuple[int, int]]] = {}
    for i, r in enumerate(own):
        for t, m in Counter(r.terms).items():
            holders.setdefault(t, []).append((i, m))
    index = {t: (np.array([i for i, _ in h]), np.array([m for _, m in h], float)) for t, h in holders.items()}
    sums = np.zeros((3, len(keys)))  # of m², m² ln(1 + df) and m² ln(1 + df)²
    for at, m in index.values():
        g = np.log(len(at) + 1.0)
        for row, x in zip(sums, (1.0, g, g * g)):
            row[at] += m * m * x
    shared = units.sparkSession.sparkContext.broadcast((keys, index, sums, frozenset(STOP_WORDS)))
    term = re.compile(r"\w{2,}")

    def score(t: pd.DataFrame) -> pd.DataFrame:
        names, found, (a, b, c), stop = shared.value
        words = [w for x in t.sort_values("unit").text for w in x.split()]
        step = SIZE - OVERLAP
        each = [Counter(x for w in words[i : i + SIZE] for x in term.findall(w) if x not in stop) for i in range(0, len(words), step)]
        df = Counter(x for w in each for x in w)
        level = np.log(len(each) + len(names) + 1.0) + 1
        idf = {x: level - np.log(1.0 + n + (len(found[x][0]) if x in found else 0)) for x, n in df.items()}
        norm = a * level * level - 2 * level * b + c
        for x in df.keys() & found.keys():
            at, m = found[x]
            norm[at] += m * m * (idf[x] ** 2 - (level - np.log(len(at) + 1.0)) ** 2)
        best = np.zeros(len(names))
        for w in each:
            dots = np.zeros(len(names))
            for x in w.keys() & found.keys():
                at, m = found[x]
                dots[at] += w[x] * idf[x] ** 2 * m
            if dots.any():
                np.maximum(best, dots / np.sqrt(sum((n * idf[x]) ** 2 for x, n in w.items())), out=best)
        hit = np.flatnonzero(best > 0)
        doc = pd.Series([t.doc.iloc[0]] * len(hit), dtype=object)
        return pd.DataFrame({"doc": doc, "record_key": pd.Series([names[i] for i in hit], dtype=object), "score": best[hit] / np.sqrt(norm[hit])})

    kind = units.schema["doc"].dataType.simpleString()
    rows = units.select("doc", "unit", F.lower("text").alias("text")).where("text is not null")
    return rows.groupBy("doc").applyInPandas(score, f"doc {kind}, record_key string, score double").select("doc", "record_key", F.round("score", 6).alias("semantic"))


def _scores_by_terms(units: DataFrame, messages: DataFrame) -> DataFrame:
    """The same by joins of terms; a message's norm comes from three sums of its own and its shared terms."""
    terms, sizes = window_terms(units)
    # written once, as everything below reads them several times
    terms, sizes = cut(terms), cut(sizes)
    own = messages.select("record_key", F.explode(map_terms(F.concat_ws(" ", "brand_product", "key_message"))).alias("term"))
    own = own.groupBy("record_key", "term").agg(F.count("*").alias("m"))
    df = own.groupBy("term").agg(F.count("*").alias("mdf"))
    own = cut(own.join(df, "term").withColumn("g", F.log(F.col("mdf") + 1.0)))
    df = own.select("term", "mdf").distinct()
    sums = own.groupBy("record_key").agg(
        F.sum(F.col("m") * F.col("m")).alias("a"), F.sum(F.col("m") * F.col("m") * F.col("g")).alias("b"), F.sum(F.col("m") * F.col("m") * F.col("g") * F.col("g")).alias("c")
    )
    whole = messages.count()
    level = F.log(F.lit(1.0 + whole) + F.col("n")) + 1  # of a term in no text of the collection
    in_doc = terms.groupBy("doc", "term").agg(F.count("*").alias("wdf")).join(df, "term", "left").join(sizes, "doc")
    in_doc = in_doc.select("doc", "term", (level - F.log(1.0 + F.col("wdf") + F.coalesce("mdf", F.lit(0)))).alias("idf"), level.alias("level"))
    in_doc = cut(in_doc)
    weighed = terms.join(in_doc, ["doc", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    lengths = weighed.groupBy("doc", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighed.join(own, "term").groupBy("doc", "at", "record_key").agg(F.sum(F.col("w") * F.col("m") * F.col("idf")).alias("dot"))
    best = dots.join(lengths, ["doc", "at"]).groupBy("doc", "record_key").agg(F.max(F.col("dot") / F.col("length")).alias("best"))
    shared = in_doc.join(own, "term").groupBy("doc", "record_key").agg(
        F.first("level").alias("level"),
        F.sum(F.col("m") * F.col("m") * (F.col("idf") * F.col("idf") - (F.col("level") - F.col("g")) * (F.col("level") - F.col("g")))).alias("more"),
    )
    norm = F.sqrt(F.col("a") * F.col("level") * F.col("level") - 2 * F.col("level") * F.col("b") + F.col("c") + F.col("more"))
    full = best.join(shared, ["doc", "record_key"]).join(sums, "record_key")
    return full.select("doc", "record_key", F.round(F.col("best") / norm, 6).alias("semantic"))


def possible_mentions(units: DataFrame, brands: DataFrame) -> DataFrame:
    """``doc, brand_product`` of the brands that hold, or are held by, a document's first line in capitals.

    The shorter of the two begins with letters that the longer one has somewhere; they meet on those.
    """
    line = first_caps_line(F.col("text"))
    heads = units.select("doc", "unit", line.alias("line")).where("line <> ''").groupBy("doc").agg(F.min_by("line", "unit").alias("line"))
    names = brands.select("brand_product", F.lower("brand_product").alias("name")).where("name <> ''")

    def begins(c: str) -> Column:
        return F.array(F.substring(c, 1, 3))

    def all_of(c: str) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(3), F.length(c)))
        return F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(F.col(c), i, k)))))

    found = None
    for left, right in ((all_of("line"), begins("name")), (begins("line"), all_of("name"))):
        pairs = heads.withColumn("gram", F.explode(left)).join(names.withColumn("gram", F.explode(right)), "gram")
        pairs = pairs.where(F.col("line").contains(F.col("name")) | F.col("name").contains(F.col("line"))).select("doc", "brand_product")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def brand_scores(units: DataFrame, brands: DataFrame, rules: Rules = Rules(), fuzzy: bool = True) -> DataFrame:
    """``doc, brand_product, kind, brand_score`` of the brands that a document mentions: possible, exact or fuzzy.

    units: ``doc, unit, text``, cleaned and not empty. Only aliases of a single brand count. An exact mention scores less the later it comes, a fuzzy one by its likeness,
    and a brand in the first line in capitals 1.
    """
    named = brands.select("brand_product", F.explode(brand_aliases(F.col("brand_product"))).alias("alias"))
    single = cut(named.groupBy("alias").agg(F.count_distinct("brand_product").alias("n"), F.min("brand_product").alias("brand_product")).where("n = 1").drop("n"))
    texts = units
    starts = cut(sum_before(texts.select("doc", "unit", (F.length("text") + 1).alias("n")), "doc", "unit", "n", "start").select("doc", "unit", "start"))
    exact = alias_positions(texts, "unit", "text", single.select("alias")).join(starts, "unit").join(single, "alias")
    exact = exact.groupBy("doc", "brand_product").agg(F.min(F.col("start") + F.col("position")).alias("position"))
    scores = exact.select("doc", "brand_product", F.lit(2).alias("rank"), (F.lit(0.99) - F.least("position", F.lit(200)) * 0.0001).alias("brand_score"))
    if fuzzy:
        near = fuzzy_brands(texts, "unit", "text", single.select("alias"), rules.likeness).join(starts, "unit").join(single, "alias")
        scores = scores.unionByName(near.groupBy("doc", "brand_product").agg(F.max("score").alias("brand_score")).withColumn("rank", F.lit(1)))
    possible = possible_mentions(texts, brands).select("doc", "brand_product", F.lit(3).alias("rank"), F.lit(1.0).alias("brand_score"))
    best = scores.unionByName(possible).groupBy("doc", "brand_product").agg(F.max(F.struct("rank", "brand_score")).alias("x"))
    return best.select("doc", "brand_product", F.element_at(F.array(*[F.lit(k) for k in ("fuzzy", "exact", "possible")]), F.col("x.rank")).alias("kind"), "x.brand_score")


def map_messages(
    docs: DataFrame, units: DataFrame, messages: DataFrame, top_k: int = 0, rules: Rules = Rules(), fuzzy: bool = True
) -> DataFrame:
    """``doc, record_key, confidence_score, place``: the messages of each document, best first, equal ones by key.

    docs: ``doc, file_type``; units: ``doc, unit, text``, unit being unique; messages: ``record_key, brand_product,
    key_message``, one row each. ``top_k`` of 0 or less gives all that score above 0, without a threshold, but ten for
    audio and video. Otherwise a match needs the threshold, a higher one where no brand is mentioned; the kinds in
    ``LOCKED`` keep to the brands mentioned most surely, with a threshold just below their best match. Documents without
    text and messages that are null match nothing.
    """
    brands = messages.select("brand_product").where("brand_product is not null").distinct()
    units = cut(units.select("doc", "unit", clean_text(F.col("text")).alias("text"))).where("text <> ''")  # cleaned once for all that follows
    mentioned = cut(brand_scores(units, brands, rules, fuzzy))
    keys = messages.select("record_key", "brand_product")
    boosted = mentioned.join(keys, "brand_product").drop("brand_product")
    scored = cut(semantic_scores(units, messages)).join(boosted, ["doc", "record_key"], "full_outer")
    semantic = F.coalesce("semantic", F.lit(0.0))

    def raised(by: float, most: float) -> Column:
        return F.least(F.lit(most), semantic + by)

    score = (
        F.when(F.col("kind") == "possible", raised(rules.possible, rules.possible_most)).when(F.col("kind") == "exact", raised(rules.exact, rules.exact_most))
        .when(F.col("kind") == "fuzzy", raised(rules.fuzzy, rules.fuzzy_most)).otherwise(semantic)
    )
    sure = mentioned.groupBy("doc").agg(F.max("brand_score").alias("surest"))
    rows = scored.select("doc", "record_key", "brand_score", score.alias("score")).join(docs.select("doc", "file_type"), "doc").join(sure, "doc", "left")
    locked = F.col("file_type").isin(*LOCKED) & F.col("surest").isNotNull()
    rows = rows.withColumn("locked", F.coalesce(locked, F.lit(False))).where(~F.col("locked") | (F.col("brand_score") >= F.col("surest") - rules.lock_width))
    rows = cut(rows)
    tops = rows.groupBy("doc").agg(F.max("score").alias("top"))
    least = (
        F.when(F.col("locked") & (F.col("surest") < 1.0), F.greatest(F.lit(rules.lock_threshold), F.col("top") - rules.lock_step))
        .when(F.col("surest").isNotNull(), rules.threshold).otherwise(max(rules.threshold, rules.threshold_without_brand))
    )
    order = Window.partitionBy("doc").orderBy(F.desc("score"), "record_key")
    ranked = rows.join(tops, "doc").withColumns({"least": least, "place": F.row_number().over(order)})
    media = F.coalesce(F.col("file_type").isin(*MEDIA), F.lit(False))
    if top_k > 0:
        kept = ranked.where((F.col("place") <= top_k) & (F.col("score") >= F.col("least")))
    else:
        kept = ranked.where(F.when(media, (F.col("place") <= MEDIA_MOST) & (F.col("score") >= F.col("least"))).otherwise(F.col("score") > 0))
    return kept.select("doc", "record_key", half_up(F.col("score"), 4).alias("confidence_score"), "place")
