"""Matching of texts with criteria, messages and brands."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions.correction import indel_ratio
from scrivener.functions.text import content_tokens

#: Rows at most of a side that is sent to every task at once.
MOST_BROADCAST = 20_000
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def sparse_vectors(rows: DataFrame, key: str, text: str, df: DataFrame, documents: Column) -> DataFrame:
    """``key, term, w``: unit TF-IDF vectors. ``df`` holds ``term, df``; idf is ``ln((1 + n) / (1 + df)) + 1``."""
    tf = rows.select(key, F.explode(content_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(df, "term").withColumn("w", F.col("tf") * (F.log((documents + 1) / (F.col("df") + 1)) + 1))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def first_reads(reads: DataFrame) -> DataFrame:
    """Of several reads of a unit that with the smallest ``ocr_id``; all columns are kept."""
    rest = [c for c in reads.columns if c not in ("unit_id", "ocr_id")]
    best = reads.groupBy("unit_id").agg(F.min_by(F.struct("ocr_id", *rest), "ocr_id").alias("x"))
    return best.select("unit_id", "x.*")


def tfidf_best(queries: DataFrame, corpus: DataFrame, q_key: str, c_key: str, text: str, k: int, least: float) -> DataFrame:
    """The ``k`` rows of ``corpus`` of highest TF-IDF cosine for each query, of ``least`` or more; equal ones by key.

    The vectors meet on shared terms, never as all pairs. Queries and corpus count together for the idf. Queries
    must be a bounded set, as a term of many queries and rows pairs them all.
    """
    q, c = queries.select(F.col(q_key).alias("q"), text), corpus.select(F.col(c_key).alias("c"), text)
    both = q.select(text).unionByName(c.select(text))
    n = both.count()
    df = both.select(F.explode(F.array_distinct(content_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    a, b = sparse_vectors(q, "q", text, df, F.lit(n)), sparse_vectors(c, "c", text, df, F.lit(n))
    scored = a.withColumnRenamed("w", "x").join(b.withColumnRenamed("w", "y"), "term").groupBy("q", "c").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    scored = scored.withColumn("score", F.round("s", 4)).where(F.col("score") >= least)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.select(F.col("q").alias(q_key), F.col("c").alias(c_key), "score", "place")


def cosine_best(queries: DataFrame, corpus: DataFrame, q_key: str, q_vector: str, c_key: str, c_vector: str, k: int, dims: int) -> DataFrame:
    """The ``k`` vectors of ``corpus`` of highest cosine for each query vector, rounded to 6 decimals; equal ones by key.

    Every block of the corpus is multiplied with a block of at most ``MOST_BROADCAST`` queries and gives at most ``k``
    rows a query; more queries are taken in parts, each a pass over the corpus. Vectors that are null, of another
    length, not finite or all zero take no part.
    """

    def good(v: str) -> str:
        return f"size({v}) = {dims} and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({v}, x -> x <> 0)"

    asked = queries.where(good(q_vector)).select(F.col(q_key).cast("long").alias("q"), F.col(q_vector).alias("v"))
    rows = corpus.where(good(c_vector)).select(F.col(c_key).cast("long").alias("c"), F.col(c_vector).alias("v"))
    parts = max(1, -(-asked.count() * 5 // (MOST_BROADCAST * 4)))  # a fifth of room, as a hash does not share out evenly
    near = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).collect()
        found = rows.mapInPandas(_block_scan(some, k, dims), "q long, c long, score double")
        near = found if near is None else near.unionByName(found)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.select(F.col("q").alias(q_key), F.col("c").alias(c_key), "score", "place")


def _block_scan(some: list, k: int, dims: int):
    ids = np.array([r.q for r in some], np.int64)
    q = np.array([r.v for r in some], np.float64).reshape(-1, dims)
    q /= np.linalg.norm(q, axis=1, keepdims=True)

    def block(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in it:
            if not len(t) or not len(ids):
                continue
            x = np.stack(t.v.to_numpy()).astype(np.float64)
            c = t.c.to_numpy()
            s = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
            # all that are as good as the k-th best; ties go by key
            least = np.partition(s, -min(k, s.shape[1]), axis=1)[:, [-min(k, s.shape[1])]]
            i, j = np.nonzero(s >= least)
            order = np.lexsort((c[j], -s[i, j], i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            top = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
            i, j = i[top], j[top]
            yield pd.DataFrame({"q": ids[i], "c": c[j], "score": s[i, j]})

    return block


#: First words of aliases at most that every task looks for; with more of them all words of the texts are sent on.
MOST_HEADS = 100_000
_HEAD = r"[a-z0-9]+|[^\sa-z0-9]"


def alias_positions(texts: DataFrame, key: str, text: str, aliases: DataFrame | list[str]) -> DataFrame:
    """``key, alias, position`` (from 0) of the earliest mention of each alias that stands free of letters and digits.

    ``aliases`` holds ``alias``, distinct, in lower case, of any number, or is a list of them. Words of the texts with what follows them meet
    the aliases that begin with them. A null text mentions nothing.
    """
    if isinstance(aliases, list):
        aliases = texts.sparkSession.createDataFrame([(a,) for a in aliases], "alias string")
    names = aliases.select("alias", F.regexp_extract("alias", _HEAD, 0).alias("head")).where("head <> ''")
    longest = names.agg(F.max(F.length("alias"))).first()[0] or 0
    heads = names.select("head").distinct().limit(MOST_HEADS + 1).collect()
    wanted = texts.sparkSession.sparkContext.broadcast(frozenset(r.head for r in heads) if len(heads) <= MOST_HEADS else None)
    word = re.compile(_HEAD)

    def words(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = wanted.value
        for t in it:
            rows = []
            for k, x in zip(t[key], t["__low"]):
                for m in word.finditer(x or ""):
                    if (some is None or m[0] in some) and not (m.start() and m[0] not in _PLAIN and x[m.start() - 1] in _PLAIN):
                        rows.append((k, m[0], m.start(), x[m.start() : m.start() + longest + 1]))
            yield pd.DataFrame(rows, columns=[key, "head", "position", "ahead"])

    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(key, F.lower(text).alias("__low")).mapInPandas(words, f"{key} {kind}, head string, position int, ahead string")
    n = F.length("alias")
    after = F.substring("ahead", n + 1, F.lit(1))
    hits = found.join(names, "head").where(F.col("ahead").startswith(F.col("alias")) & ~after.rlike("[a-z0-9]"))
    return hits.groupBy(key, "alias").agg(F.min("position").alias("position"))


def fuzzy_brands(texts: DataFrame, key: str, text: str, aliases: DataFrame, least: float = 0.75) -> DataFrame:
    """``key, alias, score``: best likeness of a word of the text with an alias of six or more letters.

    Distinct words of five or more characters meet aliases that begin alike or that they hold; 1 if they hold it.
    ``aliases`` holds ``alias``, distinct.
    """
    plain = F.regexp_replace(F.lower("alias"), "[^a-z0-9]", "")
    names = aliases.select("alias", plain.alias("a")).where("length(a) >= 6").withColumn("head", F.substring("a", 1, 3))
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9-]+"), F.lit(0))
    words = texts.select(key, F.explode(F.array_distinct(F.transform(found, lambda w: F.regexp_replace(w, "[^a-z0-9]", "")))).alias("w"))
    words = words.where("length(w) >= 5")
    # an alias within a word has its first three letters somewhere in it
    heads = F.expr("array_distinct(transform(sequence(1, length(w) - 2), i -> substring(w, i, 3)))")
    pairs = words.select("w").distinct().withColumn("head", F.explode(heads)).join(names, "head")
    pairs = pairs.where(F.col("w").startswith(F.col("head")) | F.col("w").contains(F.col("a"))).dropDuplicates(["w", "alias"])

    @F.pandas_udf("double")
    def likeness(a: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([1.0 if x in y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, w)], dtype="float64")

    scored = pairs.withColumn("score", likeness("a", "w")).where(F.col("score") >= least).select("w", "alias", "score")
    return words.join(scored, "w").groupBy(key, "alias").agg(F.max("score").alias("score"))


def correct_words(words: DataFrame, dictionary: DataFrame, least: float = 85.0) -> DataFrame:
    """``word, best, score`` of each distinct word that the dictionary explains; words with digits or under 4 letters none.

    A similarity of ``least`` bounds the lengths and the letters that two words don't share. From 80 on, these are too few
    to part all that they share into single letters, so they have a bigram in common, shifted by at most as many
    places: candidates meet on that, and none is lost.
    """
    if least < 80:
        raise ValueError("words less alike than 80 need not share a bigram")
    longer = (200 - least) / least  # of the longer word to the shorter one
    shift = F.floor(2 * F.length("w") * ((100 - least) / least) + 1e-6).cast("int")
    usable = "length(w) >= 4 and not w rlike '[0-9]'"
    grams = F.expr("transform(sequence(1, length(w) - 1), i -> struct(i as i, substring(w, i, 2) as g))")
    w = words.select(F.lower("word").alias("w"), "word").where(usable).distinct()
    d = dictionary.select(F.lower("term").alias("w")).where("length(w) >= 2").distinct()
    left = w.select("word", "w", F.explode(grams).alias("x")).select("word", "w", "x.g", "x.i")
    right = d.select(F.col("w").alias("term"), shift.alias("shift"), F.explode(grams).alias("x"))
    right = right.select("term", "x.g", F.explode(F.expr("sequence(x.i - shift, x.i + shift)")).alias("i"))
    near = (F.length("w") * longer + 1e-6 >= F.length("term")) & (F.length("term") * longer + 1e-6 >= F.length("w"))
    pairs = left.join(right, ["g", "i"]).where(near).select("word", "w", "term").distinct()

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in it:
            t = t.assign(score=[indel_ratio(a, b) for a, b in zip(t.w, t.term)])
            yield t[t.score >= least][["word", "term", "score"]]

    order = Window.partitionBy("word").orderBy(F.desc("score"), "term")
    hits = pairs.mapInPandas(score, "word string, term string, score double")
    return hits.withColumn("r", F.row_number().over(order)).where("r = 1").select("word", F.col("term").alias("best"), "score")
