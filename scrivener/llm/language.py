"""Languages of documents and their segments by mixture inference.

Every language has a character trigram model, counted over the whole corpus from sentences whose function words or
letters leave no doubt. A document is a mixture: expectation-maximisation estimates the proportions of the languages
from the likelihoods of its segments, and a language stays in the set only if leaving it out costs more log-likelihood
than a penalty. Segments then get their most probable language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "ru", "ja", "zh")
#: Function words from which clear sentences are recognised.
FUNCTION_WORDS = {
    "en": "the of and to in is was for with be are that this by from not have has as an it which were should or may on at no a do more",
    "de": "der die das und ist von nicht mit werden wird den dem ein eine einer zur zum auf für bei sich sind wurde wurden nach in im des vor wenn durch als",
    "fr": "le la les des et est une un dans pour avec du au aux par sur que qui être ont sont ne pas cette ces de à en a été plus leur ou",
    "es": "el la los las una un del es por con para se que como su sus más han ha fue fueron y al lo está son esta de en no cuando debe pueden ser ante a o",
    "it": "il lo la gli le della delle dei di che una un per con nel nella è sono del da al alla si più come questa ha hanno state stati deve essere in non e dopo a i",
    "pt": "o a os as uma um da do das dos de não em no na para com ao à que se foi foram por são mais é pelo deve devem ser quando está esta num e",
    "nl": "de het een van en is zijn voor met niet op aan door dat bij wordt worden te deze dit ook naar uit of in moet werd tijdens als die u",
}
#: Largest number of trigrams of a language in the model; all sentences are counted.
MOST_GRAMS = 20_000
PENALTY = 8.0
#: A segment in nats per character above any language's reach (hexadecimal, sequences) has no language.
WORST = -4.2
_NAMES = {
    "english": "en", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "francais": "fr", "spanish": "es",
    "español": "es", "espanol": "es", "castilian": "es", "italian": "it", "italiano": "it", "portuguese": "pt",
    "português": "pt", "portugues": "pt", "dutch": "nl", "nederlands": "nl", "russian": "ru", "русский": "ru",
    "japanese": "ja", "日本語": "ja", "chinese": "zh", "mandarin": "zh", "中文": "zh", "eng": "en", "deu": "de", "ger": "de",
    "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "rus": "ru", "jpn": "ja",
    "zho": "zh", "chi": "zh", "jp": "ja", "cn": "zh",
}

_BROKEN = re.compile("(?<=[^\\W\\d_])[-\u00ad\u2010\u00ac] ?\\r?\\n[ \\t]*(?=[^\\W\\d_])")
#: Where a text is cut; each pattern begins with rare characters, so that the search passes over the rest quickly.
_SENTENCE_END = re.compile(r"([.!?…][\"'”’»)\]]*)\s+(?![a-zß-öø-ÿа-я0-9])")
_EAST_END = re.compile("([。！？])")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n\s*")
_CELL = re.compile(r"[|•·](?=\s)")
_WORD = re.compile(r"[぀-ヿ㐀-鿿々ー]{1,6}|[^\W\d_぀-ヿ㐀-鿿]+")
_PLAIN_WORD = re.compile("[a-z]+")
_EAST = re.compile("[぀-ヿ㐀-鿿]")
_KANA = re.compile("[぀-ヿ]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_SHARED = Counter(w for v in FUNCTION_WORDS.values() for w in set(v.split()))
#: A word of several languages counts for each with that part.
_FUNCTION: dict[str, list[tuple[str, float]]] = {}
for _k, _v in FUNCTION_WORDS.items():
    for _w in set(_v.split()):
        _FUNCTION.setdefault(_w, []).append((_k, 1 / _SHARED[_w]))
#: Words of a stretch without punctuation that are judged together.
_STRETCH = 12
#: Texts whose segments are looked up together.
_BATCH = 1024


def segments(text: str) -> list[str]:
    """Sentences, table cells and, where punctuation is missing, stretches of words; broken words are joined."""
    out = []
    if "\n" in text:
        text = _BLANK_LINE.sub("\0", _BROKEN.sub("", text))
    text = _SENTENCE_END.sub("\\1\0", text)
    if not text.isascii():
        text = _EAST_END.sub("\\1\0", text)
    if "|" in text or "•" in text or "·" in text:
        text = _CELL.sub(lambda m: "\0" if m.start() and m.string[m.start() - 1].isspace() else m[0], text)
    for s in text.replace("\t", "\0").split("\0"):
        words = s.split()
        if not words:
            continue
        s = " ".join(words)
        if len(words) > 45 or len(s) > 400:
            size = 0
            part: list[str] = []
            for w in words:
                for piece in [w[i : i + 24] for i in range(0, len(w), 24)] if len(w) > 40 and _EAST.search(w) else [w]:
                    part.append(piece)
                    size += 1 + len(_EAST.findall(piece)) // 2
                    if size >= _STRETCH:
                        out.append(" ".join(part))
                        part, size = [], 0
            if part:
                out.append(" ".join(part))
        else:
            out.append(s)
    return out


def words_of(text: str) -> list[str]:
    """Words in lower case; of eastern writing stretches of up to six characters."""
    text = text.lower()
    return _PLAIN_WORD.findall(text) if text.isascii() else _WORD.findall(text)


def clear_languages(words: list[str]) -> tuple[str | None, tuple[str, ...]]:
    """The language of a sentence that its letters or function words make certain, and those that they speak for most."""
    text = "".join(words)
    if not text:
        return None, ()
    if not text.isascii():
        east = len(_EAST.findall(text)) if _EAST.search(text) else 0
        if east >= 5 and east > 0.4 * len(text):
            lang = "ja" if len(_KANA.findall(text)) >= 0.15 * east else "zh" if not _KANA.search(text) else None
            return lang, ()
        if _CYRILLIC.search(text) and len(_CYRILLIC.findall(text)) > 0.6 * len(text) and len(text) > 8:
            return "ru", ()
    sums: dict[str, float] = {}
    for w in _FUNCTION.keys() & set(words):
        for k, part in _FUNCTION[w]:
            sums[k] = sums.get(k, 0.0) + part
    if not sums:
        return None, ()
    best, *rest = sorted(((x, k) for k, x in sums.items()), reverse=True)
    most = (best[1], *(k for x, k in rest if x > best[0] - 1e-9)) if max(map(len, words)) <= 24 else ()  # no sequences
    return (best[1] if best[0] >= 2 and (not rest or best[0] >= 2 * rest[0][0]) else None), most


def _grams(word: str) -> list[str]:
    w = word if _EAST.match(word) else f"^{word}$"
    w = f"  {w}" if len(w) < 3 or _EAST.match(word) else f" {w}"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def count_grams(texts: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all texts of the column ``text``.

    Sentences of a certain language count for it; so do those that may be in the one language which nearly all certain
    sentences of their text are in.
    """

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in it:
            seen: dict[str, tuple[list[str], str | None, tuple[str, ...]]] = {}
            votes: Counter = Counter()
            for x in t.text:
                own = segments(x)
                for s in own:
                    if s not in seen:
                        found = words_of(s)
                        seen[s] = (found, *clear_languages(found))
                clear = Counter(seen[s][1] for s in own if seen[s][1])
                most, n = clear.most_common(1)[0] if clear else (None, 0)
                whole = n >= 2 and n >= 0.8 * clear.total()
                for s in own:
                    _, lang, like = seen[s]
                    lang = lang or (most if whole and most in like else None)
                    if lang:
                        votes[s, lang] += 1
            words: dict[str, Counter] = {k: Counter() for k in LANGUAGES}
            for (s, lang), times in votes.items():
                counted = words[lang]
                for w in seen[s][0]:
                    counted[w] += times
            total: Counter = Counter()
            for lang, own in words.items():
                for w, n in own.items():
                    for g in _grams(w):
                        total[lang, g] += n
            yield pd.DataFrame([(k, g, n) for (k, g), n in total.items()], columns=["lang", "gram", "n"])

    parts = texts.select("text").where("text is not null").mapInPandas(count, "lang string, gram string, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihoods of words under every language."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        self.tables = []
        for lang in LANGUAGES:
            own = counts.get(lang, {})
            context: Counter = Counter()
            single: Counter = Counter()
            for g, n in own.items():
                context[g[:2]] += n
                single[g[2]] += n
            whole = sum(single.values())
            one = {c: (n + 0.01) / (whole + 1) for c, n in single.items()}
            three = {g: np.log((n + 2 * one[g[2]]) / (context[g[:2]] + 2)) for g, n in own.items()}
            back = {c: np.log(2 / (n + 2)) for c, n in context.items()}
            self.tables.append((three, back, {c: np.log(p) for c, p in one.items()}))
        # the trigrams that any language has, with their log-likelihoods under all
        self.rows = {g: i for i, g in enumerate(sorted({g for three, *_ in self.tables for g in three}))}
        self.known = np.zeros((len(self.rows), len(LANGUAGES)))
        for g, i in self.rows.items():
            self.known[i] = self._rare(g)
        self._forget()

    def _rare(self, g: str) -> list[float]:
        return [three[g] if g in three else back.get(g[:2], 0.0) + one.get(g[2], -16.0) for three, back, one in self.tables]

    def __getstate__(self) -> tuple:
        return self.tables, self.rows, self.known

    def __setstate__(self, state: tuple) -> None:
        self.tables, self.rows, self.known = state
        self._forget()

    def _forget(self) -> None:
        """Words and segments seen so far: the row of each in a matrix of log-likelihoods, letters and length."""
        self._row: dict[str, int] = {}
        self._matrix = np.zeros((1024, len(LANGUAGES) + 2))
        self._segment: dict[str, int] = {}
        self._segments = np.zeros((1024, len(LANGUAGES) + 3))

    def _add(self, words: list[str]) -> None:
        """Rows of words not seen before, all at once."""
        first = len(self._row)
        self._row.update(zip(words, range(first, first + len(words))))
        while len(self._row) > len(self._matrix):
            self._matrix = np.vstack([self._matrix, np.zeros_like(self._matrix)])
        grams = [_grams(w) for w in words]
        flat = [g for gs in grams for g in gs]
        at = np.array([self.rows.get(g, -1) for g in flat], np.int64)
        each = self.known[at]
        for i in np.flatnonzero(at < 0):
            each[i] = self._rare(flat[i])
        starts = np.cumsum([0, *map(len, grams[:-1])])
        new = self._matrix[first : first + len(words)]
        new[:, :-2] = np.add.reduceat(each, starts)
        new[:, -2] = [len(w) for w in words]
        new[:, -1] = [len(w) / 2 if _EAST.match(w) else 1 for w in words]

    def likelihoods(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each segment its log-likelihoods, number of letters, and whether it is a whole sentence.

        A sentence has six words, or four and an end mark; two eastern characters are a word. Segments seen before, as in
        repeated texts, are looked up.
        """
        if len(self._row) > 60_000 or len(self._segment) > 100_000:
            self._forget()
        known, seen = self._row, self._segment
        at: list[int] = []
        new: list[str] = []
        for s in segs:
            i = seen.get(s)
            if i is None:
                i = seen[s] = len(seen)
                new.append(s)
            at.append(i)
        if new:
            found = [words_of(s) for s in new]
            unknown = set().union(*found).difference(known)
            if unknown:
                self._add(sorted(unknown))
            rows = list(map(known.__getitem__, chain.from_iterable(found)))
            ends = np.cumsum([len(f) for f in found])
            sums = np.vstack([np.zeros((1, len(LANGUAGES) + 2)), np.cumsum(self._matrix[rows], axis=0)])[[0, *ends]]
            each = np.diff(sums, axis=0)
            closed = np.array([s.rstrip("\"'”’»)]")[-1:] in _CLOSE for s in new])
            whole = (each[:, -1] >= 6 - 1e-6) | ((each[:, -1] >= 4 - 1e-6) & closed)
            first = len(seen) - len(new)
            while len(seen) > len(self._segments):
                self._segments = np.vstack([self._segments, np.zeros_like(self._segments)])
            self._segments[first : len(seen), :-1], self._segments[first : len(seen), -1] = each, whole
        own = self._segments[at]
        return own[:, :-3], own[:, -3].round(), own[:, -1] > 0


_CLOSE = frozenset(".!?…。！？")


def infer(like: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages, 0 for those outside the set, and the probabilities of each row's languages.

    Expectation-maximisation from all languages; the language that costs least is left out as long as the likelihood
    falls by less than the penalty for a language.
    """
    n = like.shape[1]

    def run(keep: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p = np.where(keep, 1 / keep.sum(), 0.0)
        total = -np.inf
        for _ in range(30):
            with np.errstate(divide="ignore"):
                z = like + np.log(p)
            top = z.max(1, keepdims=True)
            e = np.exp(z - top)
            s = e.sum(1, keepdims=True)
            r = e / s
            now = float((top + np.log(s)).sum())
            p = (r * weight[:, None]).sum(0) / weight.sum()
            if now - total < 1e-4:
                break
            total = now
        return now, p, r

    keep = np.zeros(n, bool)
    keep[np.unique(like.argmax(1))] = True  # other languages cannot gain a share
    if keep.sum() == 1:
        top = like.max(1)
        return keep.astype(float), np.exp(like - top[:, None]) / np.exp(like - top[:, None]).sum(1, keepdims=True)
    total, p, r = run(keep)
    while keep.sum() > 1:
        trials = []
        for k in np.flatnonzero(keep):
            fewer = keep.copy()
            fewer[k] = False
            trials.append((*run(fewer), fewer))
        best = max(trials, key=lambda t: t[0])
        if best[0] < total - PENALTY:
            break
        total, p, r, keep = best
    return np.where(keep, p, 0.0), r


@dataclass(frozen=True)
class Judgment:
    """Of one text: its segments with their language (index, -1 none) and confidence, and (language, letters, share) of its set."""

    segments: list[str]
    lang: np.ndarray
    sure: np.ndarray
    letters: np.ndarray
    found: list[tuple[int, int, float]]


class _Flat:
    """The segments of several texts in flat arrays."""

    def __init__(self, texts: list[str], model: Model) -> None:
        self.each = [segments(x) for x in texts]
        self.sizes = np.array([len(x) for x in self.each], np.int64)
        flat = [s for segs in self.each for s in segs]
        none = np.zeros((0, len(LANGUAGES))), np.zeros(0), np.zeros(0, bool)
        self.like, self.letters, whole = model.likelihoods(flat) if flat else none
        top = self.like.max(1, initial=-1e9)
        self.fit = (self.letters > 0) & (top > WORST * np.maximum(self.letters, 1) - 8)
        self.best = self.like.argmax(1) if flat else np.zeros(0, np.int64)
        self.proof = self.fit & whole
        with np.errstate(under="ignore"):
            self.alone = 1 / np.exp(self.like - top[:, None]).sum(1)  # probability of the best language, all being equal before

    def one(self, a: int, b: int, segs: list[str]) -> Judgment:
        ok, own, letters, like = self.fit[a:b], self.best[a:b], self.letters[a:b], self.like[a:b]
        lang, sure = np.full(b - a, -1), np.zeros(b - a)
        if not ok.any():
            return Judgment(segs, lang, sure, letters, [])
        proof = self.proof[a:b]
        kinds = np.unique(own[proof]) if proof.any() else np.array([like[ok].sum(0).argmax()])
        p = np.zeros(len(LANGUAGES))
        p[kinds] = 1
        if len(kinds) > 1:
            p, _ = infer(like[proof], letters[proof])
            kinds = np.flatnonzero(p > 0)
        if len(kinds) == 1:
            lang[ok] = kinds[0]
            same = ok & (own == kinds[0])
            sure[same] = self.alone[a:b][same]
        else:
            z = like[ok] + np.log(np.where(p > 0, p, 1e-300))
            r = np.exp(z - z.max(1, keepdims=True))
            r /= r.sum(1, keepdims=True)
            lang[ok], sure[ok] = r.argmax(1), r.max(1)
        return Judgment(segs, lang, sure, letters, [(int(k), int(letters[lang == k].sum()), float(p[k])) for k in kinds])


def judge_all(texts: list[str], model: Model) -> list[Judgment]:
    """The mixture of every text.

    Whole sentences are the evidence: the set of languages and their proportions are inferred from them alone, so that
    names, loan words and headings make no language. Then every segment gets its most probable language of the set. A
    text without a whole sentence has the one language that explains all of its segments best.
    """
    f = _Flat(texts, model)
    ends = np.cumsum(f.sizes)
    return [f.one(e - n, e, segs) for n, e, segs in zip(f.sizes, ends, f.each)]


def mixtures(texts: list[str], model: Model) -> list[list[tuple[int, int, float, float]]]:
    """(language, letters, share, confidence) of the languages of every text, of most letters first.

    As ``judge_all``; texts whose sentences all have one most probable language, which are most, are told at once.
    """
    f = _Flat(texts, model)
    n = len(texts)
    text_of = np.repeat(np.arange(n), f.sizes)
    low, high = np.full(n, len(LANGUAGES)), np.full(n, -1)
    np.minimum.at(low, text_of[f.proof], f.best[f.proof])
    np.maximum.at(high, text_of[f.proof], f.best[f.proof])
    letters = np.bincount(text_of[f.fit], f.letters[f.fit], n)
    same = f.fit & (f.best == high[text_of])
    sure = np.bincount(text_of[same], f.alone[same] * f.letters[same], n) / np.maximum(letters, 1)
    ends = np.cumsum(f.sizes)
    out = []
    for i in range(n):
        if low[i] == high[i]:
            out.append([(int(high[i]), int(letters[i]), 1.0, float(sure[i]))])
        else:
            j = f.one(ends[i] - f.sizes[i], ends[i], f.each[i])
            out.append(sorted(((k, m, p, _confidence(j, k)) for k, m, p in j.found), key=lambda r: (-r[1], LANGUAGES[r[0]])))
    return out


def judge(text: str, model: Model) -> tuple[list[str], list[int], list[str], list[float], list[int], list[bool]]:
    """Of one text its languages, their letters; for each segment its text, confidence, language (index, -1 none), whole sentence."""
    j = judge_all([text], model)[0]
    whole = model.likelihoods(j.segments)[2] & (j.lang >= 0) if j.segments else np.zeros(0, bool)
    return [LANGUAGES[k] for k, _, _ in j.found], [n for _, n, _ in j.found], j.segments, j.sure.tolist(), j.lang.tolist(), whole.tolist()


def fit(texts: DataFrame) -> Model:
    """The model from all texts of the column ``text``; at most ``MOST_GRAMS`` trigrams of a language come to the driver."""
    from pyspark.sql import Window

    ranked = count_grams(texts).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    counts: dict[str, dict[str, int]] = {}
    for r in ranked.where(F.col("r") <= MOST_GRAMS).select("lang", "gram", "n").toLocalIterator():
        counts.setdefault(r.lang, {})[r.gram] = r.n
    return Model(counts)


def _confidence(j: Judgment, k: int) -> float:
    """Mean probability of a language over the letters of its segments."""
    own = j.lang == k
    n = j.letters[own].sum()
    return float((j.sure[own] * j.letters[own]).sum() / n) if n else 0.0


def languages(df: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """``keys`` and ``languages``: array of (lang, letters, share, confidence), of most letters first.

    The set and the shares are those of the mixture of the text's whole sentences; a text too short for a sentence has
    its most probable language. Texts that are null, empty or without words have the empty array. Rows given twice are
    judged twice; other columns are dropped, so names cannot clash.
    """
    item = T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("letters", T.LongType()),
        T.StructField("share", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
    ])
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("languages", T.ArrayType(item))])
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MOST_GRAMS trigrams of ten languages
    n = len(keys)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            texts = batch.column(n).to_pylist()
            found = [x for a in range(0, len(texts), _BATCH) for x in mixtures([t or "" for t in texts[a : a + _BATCH]], m)]
            flat = [r for x in found for r in x]
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64())
            columns = list(zip(*[(LANGUAGES[r[0]], *r[1:]) for r in flat])) or [[], [], [], []]
            items = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.name for f in item])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.ListArray.from_arrays(offsets, items)], names=schema.names)

    return df.select(*[df[k] for k in keys], df[text].alias("__text")).mapInArrow(batches, schema)


def segment_languages(df: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """``keys``, ``no`` (int, from 1), ``lang``, ``confidence``, ``letters``, ``segment``: stretches of one language of every text.

    Neighbouring segments of one language are one stretch; segments without language (numbers, sequences) stay with the
    stretch before them. Null, empty and wordless texts have no row.
    """
    made = [("no", T.IntegerType()), ("lang", T.StringType()), ("confidence", T.DoubleType()), ("letters", T.LongType()), ("segment", T.StringType())]
    schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(n, k) for n, k in made]])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def stretches(j: Judgment) -> Iterator[tuple]:
        known = [i for i, k in enumerate(j.lang) if k >= 0]
        starts = [i for n, i in enumerate(known) if n == 0 or j.lang[i] != j.lang[known[n - 1]]]
        for no, (a, b) in enumerate(zip(starts, [*starts[1:], len(j.segments)]), 1):
            own = j.lang[a:b] >= 0
            n = j.letters[a:b][own].sum()
            yield no, LANGUAGES[j.lang[a]], float((j.sure[a:b][own] * j.letters[a:b][own]).sum() / max(1, n)), int(n), " ".join(j.segments[a:b])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for t in it:
            for a in range(0, len(t), _BATCH):
                part = t.iloc[a : a + _BATCH]
                found = [list(stretches(j)) for j in judge_all([x or "" for x in part["__text"]], m)]
                rows = part[keys].loc[part.index.repeat([len(f) for f in found])].reset_index(drop=True)
                made_rows = pd.DataFrame([x for f in found for x in f], columns=[n for n, _ in made])
                yield pd.concat([rows, made_rows], axis=1)

    return df.select(*[df[k] for k in keys], df[text].alias("__text")).mapInPandas(batches, schema)


def label_language(label: Column) -> Column:
    """The code of the language that a label names, in whatever spelling or regional form; null if it names none."""
    name = F.lower(F.trim(label))
    first = F.split(name, "[-_ (]", 2)[0]
    known = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    return F.coalesce(F.when(first.isin(*LANGUAGES), first), F.try_element_at(known, first), F.try_element_at(known, name))
