"""Lines, points and labels that describe a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions.text import clean_text, line_key, sentences, trim_to_word
from scrivener.operators.dedup import distinct_parts

#: Verbs that make a line a statement about an effect.
ACTIONS = "boosts controls delivers enhances ensures improves increases induces lowers prevents promotes provides reduces relieves supports treats".split()


def _terms(*cols: Column) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)) for c in cols]))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) > 3))


def evidence_lines(df: DataFrame, key: str, text: str, brand: str, message: str, most: int = 4) -> DataFrame:
    """``key, description``: the lines that share most words with a message, or say what something does, up to 320 characters."""
    rows = df.select(key, _terms(F.col(brand), F.col(message)).alias("terms"), F.split(clean_text(F.col(text)), "\n").alias("lines"))
    rows = distinct_parts(rows, "lines", line_key).select(key, "terms", F.posexplode("lines").alias("at", "line"))
    own = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9]+"), F.lit(0)))
    acts = F.arrays_overlap(own, F.array(*[F.lit(a) for a in ACTIONS]))
    shared = F.size(F.array_intersect(own, "terms"))
    scored = rows.withColumns({"score": shared + F.when(acts, 2).otherwise(0), "fits": acts | (shared >= 2)}).where("fits")
    order = Window.partitionBy(key).orderBy(F.desc("score"), "at")
    top = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    listed = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("x"))
    return listed.select(key, trim_to_word(F.array_join(F.transform("x", lambda y: F.trim(y["line"])), "; "), 320).alias("description"))


def points(c: Column) -> Column:
    """Titles and descriptions of a text: sentences of four or more words in groups of up to four, closed at three of 260 characters."""
    long = F.filter(sentences(clean_text(c)), lambda s: F.size(F.split(s, " ")) >= 4)
    empty = F.array().cast("array<array<string>>")

    def add(groups: Column, s: Column) -> Column:
        last = F.element_at(groups, -1)
        full = (F.size(groups) == 0) | (F.size(last) >= 4) | ((F.size(last) >= 3) & (F.length(F.array_join(last, " ")) >= 260))
        grown = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.array_append(last, s)))
        return F.when(full, F.array_append(groups, F.array(s))).otherwise(grown)

    groups = F.aggregate(long, empty, add)
    return F.transform(
        groups,
        lambda g: F.struct(F.array_join(F.slice(F.split(g[0], " "), 1, 7), " ").alias("title"), trim_to_word(F.array_join(g, " "), 720).alias("description")),
    )


def metric_of(module: Column, task: Column) -> Column:
    """How a case is scored: word_error, word_accuracy, f1 or similarity, by its module and task."""
    name = F.lower(F.concat_ws(" ", module, task))
    return (
        F.when(name.rlike("wer|error rate"), "word_error").when(name.rlike("transcri|speech|whisper|audio"), "word_error")
        .when(name.rlike("ocr|image|pdf|text|docx"), "word_accuracy").when(name.rlike("keyword|f1|entit"), "f1").otherwise("similarity")
    )


def possible_brand(first_line: Column, brand: Column) -> Column:
    """Whether one of a heading and a brand holds the other; both must have text."""
    a, b = F.lower(F.coalesce(first_line, F.lit(""))), F.lower(F.coalesce(brand, F.lit("")))
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))
