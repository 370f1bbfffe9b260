"""Lines of frames, captions and recognised words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.functions.quality import is_noise_line
from scrivener.functions.text import clean_text, clock_parts, line_key

_LABEL = r"(?i)^(?:\d{2}:\d{2}\s+)?frame\s+\d+:\s*"
_EDGE = r"[ .,:;|\[\]{}()]"
#: Captions that say nothing.
WEAK_ANSWERS = ("no", "none", "nothing", "unknown", "unclear", "n a", "na", "image", "picture", "photo", "a picture", "an image", "a photo")
WEAK_PARTS = ("no idea", "do not know", "don t know", "i don t know", "not sure", "cannot tell", "can t tell")
WEAK_WORDS = ("ad", "advertisement", "diet", "food", "graphic", "health", "poster", "product", "text")
WEAK_PHRASES = ("a blurry image", "a close up", "a screenshot", "a document", "a poster", "text", "words")
#: Activities that say nothing, where something else is known.
WEAK_ACTIVITIES = ("person is shown in the scene", "people are shown interacting", "a person is standing")
#: Words of a product's form and lines that look like a product but are none.
FORMS = ("cream", "tablet", "capsule", "injection", "syrup", "gel", "ointment", "spray", "dose", "mg", "gm", "ml", "%")
NOT_PRODUCTS = ("achieves superior clinical", "achieves superior reduction", "possesses good dermal penetration", "visible content")
#: What the words of a text-heavy picture say of it.
PARTS = (
    ("comparison charts", ("chart", "graph", "score", "rate", "rates", "compared", "reduction")),
    ("clinical efficacy statements", ("patient", "patients", "clinical", "cure", "efficacy", "study")),
    ("dosage details", ("cream", "tablet", "capsule", "injection", "syrup", "gel", "ointment", "spray")),
)


def frame_body(line: Column) -> Column:
    """A line without the time and number of its frame."""
    return F.trim(F.regexp_replace(line, _LABEL, ""))


def is_hex(line: Column) -> Column:
    """24 or more characters, more than 85 percent of them hexadecimal."""
    compact = F.regexp_replace(F.lower(line), r"\s+", "")
    return (F.length(compact) >= 24) & (F.regexp_count(compact, F.lit("[0-9a-f]")) / F.greatest(F.length(compact), F.lit(1)) > 0.85)


def is_frame_noise(line: Column) -> Column:
    """No text of a frame: empty, hexadecimal, one such sign nine times in a row, or long without a word."""
    t = clean_text(line)
    compact = F.regexp_replace(F.lower(t), r"\s+", "")
    return (t == "") | is_hex(t) | compact.rlike(r"([a-f0-9])\1{8,}") | ((F.length(t) > 40) & ~t.rlike("[a-zA-Z]{2,}"))


def mapping_lines(c: Column) -> Column:
    """The lines of frames without labels and hexadecimal lines."""
    bodies = F.transform(F.split(clean_text(c), "\n"), frame_body)
    return F.array_join(F.filter(bodies, lambda b: (b != "") & ~is_hex(b)), "\n")


def is_weak_caption(c: Column) -> Column:
    """A caption that says nothing."""
    n = line_key(clean_text(c))
    parts = F.lit(False)
    for p in WEAK_PARTS:
        parts = parts | n.contains(p)
    return (F.length(n) <= 2) | n.isin(*WEAK_ANSWERS) | parts | n.isin(*WEAK_WORDS) | n.isin(*WEAK_PHRASES)


def is_repetitive(c: Column) -> Column:
    """Fewer than four words, hardly different ones, or one word four times."""
    t = F.regexp_extract_all(F.lower(clean_text(c)), F.lit("[a-z0-9]+"), F.lit(0))
    n, different = F.size(t), F.array_distinct(t)
    often = F.array_max(F.transform(different, lambda d: F.size(F.filter(t, lambda x: x == d))))
    low = F.lower(clean_text(c))
    unsure = low.contains("no idea") | low.contains("do not know") | low.contains("don't know")
    return unsure | (n < 4) | ((n >= 8) & (F.size(different) / F.greatest(n, F.lit(1)) < 0.45)) | (often >= 4)


def is_product_line(line: Column) -> Column:
    """At most seven words with a form of dosage, or at most three with a capital."""
    w = F.regexp_extract_all(line, F.lit("[A-Za-z][A-Za-z0-9%.-]*"), F.lit(0))
    joined = F.lower(F.array_join(w, " "))
    form = joined.rlike(r"\b(" + "|".join(f for f in FORMS if f != "%") + r")\b")
    capital = F.exists(w, lambda x: x.rlike("^[A-Z]"))
    return F.size(w).between(1, 7) & ~joined.isin(*NOT_PRODUCTS) & (form | ((F.size(w) <= 3) & capital))


def readable_lines(c: Column) -> Column:
    """The lines of a text that are no noise, without outer signs; repeated ones stay."""
    lines = F.transform(F.split(clean_text(c), "\n"), lambda s: F.regexp_replace(clean_text(s), rf"^{_EDGE}+|{_EDGE}+\z", ""))
    return F.filter(lines, lambda s: ~is_noise_line(s))


def clean_token(token: Column) -> Column:
    """A recognised word without outer signs; empty if it can be none: too few vowels, too many consonants, a broken end."""
    v = F.regexp_replace(clean_text(token), rf"^{_EDGE}+|{_EDGE}+\z", "")
    letters, vowels = F.regexp_count(v, F.lit("[A-Za-z]")), F.regexp_count(v, F.lit("[AEIOUaeiou]"))
    number, marked = v.rlike(r"\d"), v.rlike(r"[\d%+]")
    run = v.rlike("(?i)[bcdfghjklmnpqrstvwxyz]{4,}")
    return (
        F.when((F.length(v) <= 1) & ~number, "").when(letters == 0, F.when(number, v).otherwise("")).when((letters >= 4) & run, "")
        .when((letters >= 4) & (vowels / F.greatest(letters, F.lit(1)) < 0.30) & ~marked, "").when((letters <= 3) & ~marked & (F.upper(v) != v), "")
        .when(v.rlike(r"[A-Za-z]{2,}-[A-Za-z]{1,2}\z") & ~number, "").otherwise(v)
    )


def material_description(c: Column, least_lines: int = 6) -> Column:
    """What a picture full of text shows, by its words; empty under six lines."""
    lines = readable_lines(c)
    low = F.lower(F.array_join(lines, " "))

    def holds(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    charts, clinical, dosage = PARTS
    parts = F.array_compact(F.array(
        F.when(holds(charts[1]), charts[0]), F.when(holds(clinical[1]), clinical[0]), F.when(F.size(lines) >= 10, "product claims"), F.when(holds(dosage[1]), dosage[0]),
    ))
    shown = F.when(F.size(parts) == 0, "promotional content").otherwise(F.array_join(F.slice(parts, 1, 3), ", "))
    title = F.get(F.filter(F.slice(lines, 1, 14), is_product_line), F.lit(0))
    subject = F.when(title.isNotNull(), F.concat(F.lit(" for "), title)).otherwise("")
    whole = F.concat(F.lit("Text-heavy promotional/clinical material"), subject, F.lit(", showing "), shown, F.lit("."))
    return F.when(F.size(lines) < least_lines, "").otherwise(whole)


def activity_lines(c: Column) -> Column:
    """Lines of activity in order of their time, each activity once; weak ones only where there is nothing else."""
    lines = F.filter(F.transform(F.split(clean_text(c), "\n"), lambda s: F.trim(s)), lambda s: line_key(frame_body(s)) != "")
    keyed = F.transform(lines, lambda s, i: F.struct(F.coalesce(clock_parts(s), F.lit(999999)).alias("at"), i.alias("i"), line_key(frame_body(s)).alias("k"), s.alias("s")))
    keys = F.transform(keyed, lambda x: x["k"])
    first = F.filter(keyed, lambda x: F.array_position(keys, x["k"]) == x["i"] + 1)
    strong = F.filter(first, lambda x: ~x["k"].isin(*WEAK_ACTIVITIES))
    return F.array_join(F.transform(F.array_sort(F.when(F.size(strong) > 0, strong).otherwise(first)), lambda x: x["s"]), "\n")


_FRAME = re.compile(r"((?:\d{2}:\d{2}\s+)?frame\s+\d+):\s*(.*)", re.IGNORECASE)


def frame_blocks(text: str, lines_most: int = 4, blocks_most: int = 6) -> str:
    """One line for each labelled frame: its different lines, at most four; frames that say the same once, at most six."""

    def key(x: str) -> str:
        return re.sub(r"\W+", " ", x.lower()).strip()

    frames: list[tuple[str, dict[str, str]]] = []
    for line in text.split("\n"):
        m = _FRAME.fullmatch(line.strip())
        if m:
            frames.append((m[1], {}))
        body = (m[2] if m else line).strip().rstrip(" .;")
        if frames and key(body):
            frames[-1][1].setdefault(key(body), body)
    said: dict[str, str] = {}
    for label, own in frames:
        if own:
            shown = "; ".join(list(own.values())[:lines_most])
            said.setdefault(key(shown), f"{label}: On-screen content shows {shown}.")
    return "\n".join(list(said.values())[:blocks_most])


@F.pandas_udf(T.StringType())
def _blocks(texts: pd.Series) -> pd.Series:
    return texts.map(frame_blocks, na_action="ignore")


def frame_content(c: Column) -> Column:
    """``frame_blocks`` of a cleaned column; empty where no frame is labelled."""
    return _blocks(clean_text(c))
