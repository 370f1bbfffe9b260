"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.tokens import DEFAULT_VOCABULARY, count_column
from scrivener.session import cut

#: Texts at most, on average, that one task of the reduction tree rounds.
FAN_IN = 4096
_ROUNDED = "source string, bucket long, doc_id long, n_tokens long, base int, p double"


@dataclass(frozen=True)
class Share:
    """What a source is to give: its share of the tokens that can be had, and how often each of its texts occurs."""

    source: str
    target: float
    feasible: float
    max_repeats: int
    texts: int
    tokens: int
    copies: float


def pivotal(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round probabilities, keeping each one's expectation and the sum of ``size * p`` but for one item.

    The item carried along and the next one trade mass, in tokens, until one of them is 0 or 1; the direction is drawn
    so that neither expectation changes. At most one item stays fractional; large items come first, so that it is small.
    """
    p = p.astype(float).copy()
    draws = rng.random(len(p))
    carried = -1
    for j in np.argsort(-size, kind="stable").tolist():
        if not 0 < p[j] < 1:
            continue
        if carried < 0:
            carried = j
            continue
        i = carried
        up = min(size[i] * (1 - p[i]), size[j] * p[j])
        down = min(size[i] * p[i], size[j] * (1 - p[j]))
        step = up if draws[j] * (up + down) < down else -down
        for k, x in ((i, step), (j, -step)):
            p[k] += x / size[k]
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        carried = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


def _round_groups(seed: int, level: int):
    def rounded(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("doc_id", ignore_index=True)
        key = zlib.crc32(repr((t.source[0], int(t.bucket[0]))).encode())
        t["p"] = pivotal(t.p.to_numpy(), t.n_tokens.to_numpy(), np.random.default_rng([seed, level, key]))
        return t

    return rounded


def plan(totals: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], size: float | None = None) -> list[Share]:
    """Expected copies of the texts of each source. totals: texts and tokens of each source.

    Targets without texts give nothing and the other shares are scaled up to 1. The mixture is as large as the scarcest
    source allows with all its texts at ``max_repeats``, or ``size`` tokens if that is less.
    """
    usable = {s: (w, r) for s, w, r in targets if w and w > 0 and r and r > 0 and totals.get(s, (0, 0))[1] > 0}
    whole = sum(w for w, _ in usable.values())
    tokens = min((r * totals[s][1] / (w / whole) for s, (w, r) in usable.items()), default=0.0)
    tokens = min(tokens, size) if size is not None else tokens
    out = []
    for s, w, r in targets:
        n, have = totals.get(s, (0, 0))
        feasible = usable[s][0] / whole if s in usable else 0.0
        copies = min(tokens * feasible / have, r) if s in usable else 0.0
        out.append(Share(s, w, feasible, r, n, have, round(copies) if abs(copies - round(copies)) < 1e-9 else copies))
    return out


def mix(
    documents: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 0, path: str = DEFAULT_VOCABULARY
) -> tuple[DataFrame, list[Share]]:
    """``doc_id, source, n_tokens, copies`` of every text that is used, and the plan by source.

    documents: ``doc_id, source, text``; targets: ``source, target_share, max_repeats``, a table of settings that is
    read to the driver; of several rows of one source the one of largest share holds. Equal texts of a source are one
    text, standing under their smallest ``doc_id``, so that no text occurs more than ``max_repeats`` times. Texts that
    are null or empty, documents with null source and sources without target are left out; a target without texts gives
    no row. Each source's tokens differ from its part of the mixture by less than one text. Empty tables give no rows.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    settings = [(r.source, r.t[0], r.t[1]) for r in wanted.orderBy("source").collect()]
    hashed = documents.where("text <> ''").join(wanted.select("source"), "source", "left_semi")
    hashed = hashed.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    counted = count_column(hashed, ["doc_id", "source", "h1", "h2"], "text", path)
    texts = counted.groupBy("source", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = cut(texts.select("source", "doc_id", "n_tokens"))
    totals = {r.source: (r.n, r.m) for r in texts.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("m")).collect()}
    shares = plan(totals, settings, size)
    rates = documents.sparkSession.createDataFrame(
        [(s.source, float(s.copies), max(1, -(-s.texts // FAN_IN))) for s in shares], "source string, copies double, buckets long"
    )
    level = 0
    left = texts.join(rates, "source").select(
        "source", F.pmod(F.xxhash64("doc_id"), F.col("buckets")).alias("bucket"), "doc_id", "n_tokens",
        F.floor("copies").cast("int").alias("base"), (F.col("copies") - F.floor("copies")).alias("p"),
    )
    parts = [left.where("p = 0")]
    left = left.where("p > 0")
    widest = max((s.texts for s in shares), default=0)
    while True:
        widest = -(-widest // FAN_IN)
        left = cut(left.groupBy("source", "bucket").applyInPandas(_round_groups(seed, level), _ROUNDED))
        parts.append(left.where("p = 0 or p = 1"))
        left = left.where("p > 0 and p < 1")
        level += 1
        if widest <= 1:
            break
        left = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    parts.append(left.withColumn("p", (F.rand(seed) < F.col("p")).cast("double")))  # at most one text of each source
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    copies = (F.col("base") + F.col("p")).cast("int")
    return chosen.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0"), shares


def report(chosen: DataFrame, shares: list[Share]) -> DataFrame:
    """One row for each target: target and feasible share, actual share, tokens, texts, copies and largest repeat."""
    rows = [(s.source, s.target, s.feasible, s.max_repeats, s.texts, s.tokens) for s in shares]
    given = chosen.sparkSession.createDataFrame(
        rows, "source string, target_share double, feasible_share double, max_repeats int, available_texts long, available_tokens long"
    )
    used = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"),
        F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"),
    )
    full = given.join(used, "source", "left").na.fill(0, ["tokens", "texts", "copies", "most_repeats"])
    whole = full.agg(F.sum("tokens").alias("whole"))  # one row
    share = F.when(F.col("whole") > 0, F.col("tokens") / F.col("whole")).otherwise(0.0)
    return full.join(F.broadcast(whole)).withColumn("actual_share", share).drop("whole")
