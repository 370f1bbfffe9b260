"""Interfaces of model-backed steps. No model is bundled; a model is any object with the method of its protocol."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Recognizer(Protocol):
    """Reads images: text and confidence of each."""

    def read(self, images: Sequence[bytes]) -> Sequence[tuple[str, float | None]]: ...


class Transcriber(Protocol):
    """Writes down speech: segments (start, end, text, confidence) of each recording."""

    def transcribe(self, recordings: Sequence[bytes]) -> Sequence[Sequence[tuple[float, float, str, float]]]: ...


class Translator(Protocol):
    """Translates texts."""

    def translate(self, texts: Sequence[str], target: str) -> Sequence[str]: ...


class Embedder(Protocol):
    """Gives every text a vector."""

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Judge(Protocol):
    """Answers requests as text, for example a status with its reason as JSON."""

    def answer(self, requests: Sequence[str]) -> Sequence[str]: ...


def _apply(df: DataFrame, column: str, out: str, kind: str, make: Callable[[], Callable[[list], Sequence]], batch: int) -> DataFrame:
    """``make`` runs once in each worker; null inputs stay null and never reach the model."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DataType.fromDDL(kind))])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for t in it:
            values = t[column].tolist()
            given = [i for i, v in enumerate(values) if v is not None]
            found: list = [None] * len(values)
            for a in range(0, len(given), batch):
                if model is None:
                    model = make()
                part = given[a : a + batch]
                for i, y in zip(part, model([values[i] for i in part])):
                    found[i] = y
            yield t.assign(**{out: pd.Series(found, index=t.index, dtype=object)})

    return df.mapInPandas(run, schema)


def recognised(df: DataFrame, column: str, make: Callable[[], Recognizer], batch: int = 16) -> DataFrame:
    """Adds ``text`` and ``confidence_score`` of the images in ``column``."""

    def load() -> Callable[[list], Sequence]:
        model = make()
        return lambda x: [{"text": t, "confidence_score": c} for t, c in model.read(x)]

    read = _apply(df, column, "__read", "struct<text:string,confidence_score:double>", load, batch)
    return read.withColumns({"text": F.col("__read.text"), "confidence_score": F.col("__read.confidence_score")}).drop("__read")


def transcribed(df: DataFrame, column: str, make: Callable[[], Transcriber], batch: int = 4) -> DataFrame:
    """Adds ``segments``, with starts of 0 or more and ends not before them."""
    kind = "array<struct<start:double,end:double,text:string,confidence:double>>"

    def load() -> Callable[[list], Sequence]:
        model = make()

        def run(x: list) -> list:
            return [
                [{"start": max(0.0, s), "end": max(0.0, s, e), "text": t, "confidence": round(min(1.0, max(0.0, c)), 3)} for s, e, t, c in one]
                for one in model.transcribe(x)
            ]

        return run

    return _apply(df, column, "segments", kind, load, batch)


def translated(df: DataFrame, column: str, target: str, make: Callable[[], Translator], batch: int = 16) -> DataFrame:
    """Adds ``translation``."""

    def load() -> Callable[[list], Sequence]:
        model = make()
        return lambda x: model.translate(x, target)

    return _apply(df, column, "translation", "string", load, batch)


def embedded(df: DataFrame, column: str, make: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """Adds ``embedding``."""

    def load() -> Callable[[list], Sequence]:
        model = make()
        return lambda x: [[float(v) for v in e] for e in model.embed(x)]

    return _apply(df, column, "embedding", "array<float>", load, batch)


def judged(df: DataFrame, column: str, make: Callable[[], Judge], allowed: Sequence[str] = ("Satisfied", "Not Satisfied"), batch: int = 5) -> DataFrame:
    """Adds ``reply`` and ``status``: the status field of the JSON in the reply, the last of ``allowed`` if it is none of them."""

    def load() -> Callable[[list], Sequence]:
        model = make()
        return model.answer

    replied = _apply(df, column, "reply", "string", load, batch)
    status = F.get_json_object(F.regexp_extract("reply", r"(?s)\{.*\}", 0), "$.status")
    return replied.withColumn("status", F.when(F.col("reply").isNotNull(), F.when(status.isin(*allowed), status).otherwise(allowed[-1])))
