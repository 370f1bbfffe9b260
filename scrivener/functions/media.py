"""Transcript segments, frames and confidences of media units."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.functions.quality import is_usable_segment
from scrivener.functions.text import clean_text


def number(c: Column) -> Column:
    """A number, 0 where none can be read."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def segments(c: Column) -> Column:
    """Segments with numeric times, a start of 0 or more, an end not before it and a confidence from the log-probability."""

    def shape(s: Column) -> Column:
        start = F.greatest(F.lit(0.0), number(s["start"]))
        sure = F.round(clamp(number(s["avg_logprob"]) + 1), 3)
        return F.struct(start.alias("start"), F.greatest(start, number(s["end"])).alias("end"), clean_text(s["text"]).alias("text"), sure.alias("confidence"))

    return F.transform(c, shape)


def usable_text(c: Column, raw: Column) -> Column:
    """The text of the usable segments; nothing if there were segments but none is usable; else the raw text."""
    good = F.filter(c, lambda s: is_usable_segment(s["text"], s["no_speech_prob"], s["avg_logprob"], s["compression_ratio"]))
    joined = F.array_join(F.transform(good, lambda s: clean_text(s["text"])), " ")
    return F.when(F.size(good) > 0, joined).when(F.size(c) > 0, "").otherwise(clean_text(raw))


def duration(c: Column) -> Column:
    """The largest end of the segments, 0 without any."""
    return F.coalesce(F.array_max(F.transform(c, lambda s: number(s["end"]))), F.lit(0.0))


def speech_confidence(c: Column) -> Column:
    """Mean over the segments of (1 - no speech) * min(1, e^(log-probability + 1)), 0 without any."""
    each = F.transform(c, lambda s: clamp((1 - number(s["no_speech_prob"])) * F.least(F.lit(1.0), F.exp(number(s["avg_logprob"]) + 1))))
    return F.when(F.size(c) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(c)).otherwise(0.0)


def video_score(audio: Column, frames: Column) -> Column:
    """Half speech, half frames, where frames have a score."""
    return F.coalesce(audio * 0.5 + frames * 0.5, audio, frames)


def chosen_frames(
    frames: DataFrame, key: str, at: str, signal: str, scene: float = 18.0, same: float = 3.0, memory: int = 5, most: int = 4
) -> DataFrame:
    """``key, at, reason`` of the frames worth reading: the first, and those whose signal changes by more than ``scene``.

    A frame nearer than ``same`` to one of the last ``memory`` chosen ones is left out, and ``most`` are kept for each
    key. A choice depends on those before it, so the frames of one key are folded in order. ``signal`` is an array of
    numbers; frames with null time or signal are left out. A key's signals go to one task.
    """
    schema = T.StructType([frames.schema[key], frames.schema[at], T.StructField("reason", T.StringType())])

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        last = None
        taken: list = []
        out = []
        for k, a, s in t.sort_values(at)[[key, at, signal]].itertuples(index=False):
            s = pd.Series(s, dtype=float).to_numpy()
            change = None if last is None else float(abs(s - last).mean())
            last = s
            if (change is None or change > scene) and all(float(abs(s - x).mean()) >= same for x in taken[-memory:]) and len(taken) < most:
                taken.append(s)
                out.append((k, a, "first" if change is None else "scene"))
        return pd.DataFrame(out, columns=[key, at, "reason"])

    given = frames.where(F.col(at).isNotNull() & F.col(signal).isNotNull() & F.col(key).isNotNull()).select(key, at, signal)
    return given.groupBy(key).applyInPandas(fold, schema)


def sampled_frames(frames: DataFrame, key: str, at: str, every: float) -> DataFrame:
    """``key, at`` of the first frame in each interval of ``every`` seconds; frames without time are left out."""
    rows = frames.where(F.col(at).isNotNull()).groupBy(key, F.floor(F.col(at) / every).alias("__part")).agg(F.min(at).alias(at))
    return rows.drop("__part")


def page_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, page_no, title, text`` of texts with markers ``PAGE 3 - Title`` or ``Page No: 3``; text before the first is page 0."""
    schema = T.StructType([df.schema[key], *[T.StructField(n, k) for n, k in (("page_no", T.IntegerType()), ("title", T.StringType()), ("text", T.StringType()))]])

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        marker = re.compile(r"^\s*page\s*(?:no\.?\s*)?:?\s*(\d{1,6})(?:\s*[-–:]\s*(.*?))?\s*$", re.IGNORECASE)
        for t in it:
            rows = []
            for k, x in zip(t[key], t["__text"]):
                page, title, lines = 0, None, []
                for line in (x or "").splitlines():
                    m = marker.match(line)
                    if not m:
                        lines.append(line)
                        continue
                    rows.append((k, page, title, "\n".join(lines).strip()))
                    page, title, lines = int(m[1]), m[2] or None, []
                rows.append((k, page, title, "\n".join(lines).strip()))
            yield pd.DataFrame([r for r in rows if r[1] or r[3]], columns=[f.name for f in schema])

    return df.select(key, F.col(text).alias("__text")).mapInPandas(cut, schema)
