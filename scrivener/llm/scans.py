"""Noise in text from scanned pages: broken words, misread characters, running headers and page numbers.

A frequency lexicon of the corpus comes from units that were not scanned. Words of scanned pages that it lacks are
looked up in a symmetric-delete index over both: two words are compared if deleting at most one character from each,
after folding look-alike strings, gives the same string. A weighted edit distance with cheap confusion pairs decides
whether a candidate explains the word; the word before it, by bigram counts, decides between several.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of the lexicon at most that go to every task. Of a larger lexicon these are the most frequent, and what a text
#: asks about others is joined; lines and words come out the same.
FREQUENT = 50_000
#: What recognisers confuse, as (read, meant).
CONFUSIONS = (
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ii", "ü"), ("li", "h"), ("di", "th"), ("d", "ti"), ("d", "cl"),
    ("m", "rn"), ("n", "ri"), ("h", "li"), ("lc", "k"), ("0", "o"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("!", "i"), ("|", "l"), ("|", "i"),
    ("5", "s"), ("$", "s"), ("@", "a"), ("€", "e"), ("(", "c"), ("c", "e"), ("e", "c"), ("6", "b"), ("6", "é"), ("8", "b"), ("9", "g"),
    ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"), ("o", "0"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"),
    ("a", "o"), ("o", "a"), ("v", "y"), ("y", "v"), ("é", "6"), ("j", "i"), ("fi", "ti"), ("ni", "m"), ("in", "m"), ("w", "vv"), ("q", "g"),
)
CHEAP, MOST_COST = 0.3, 0.7
SALTS = 16
#: Look-alike letters in one class, then strings of classes that look like one letter; only to find candidates.
_CLASSES = {"o": "0óöòôõaáàâãä@4", "i": "1l!|jíìî", "s": "5$", "c": "eéèêë€(3ç", "n": "hbuüúùû68ñ", "g": "9q", "t": "f7", "z": "2", "v": "yý"}
_FOLD_ONE = str.maketrans({c: k for k, v in _CLASSES.items() for c in v})
_FOLDS = (
    (("ii", "n"), ("ri", "n"), ("rn", "m"), ("ci", "d"), ("ti", "d"), ("vv", "w")),
    (("ci", "d"), ("ti", "d"), ("ri", "n"), ("ii", "n"), ("rn", "m"), ("vv", "w")),
)
_BREAKS = "-\u2010\u2011\u00ac\u00ad"
_EDGE = "\"'“”‘’«»„.,;:?)]}…"
_OPEN = "\"'“”‘’«»„([{"
_DIGIT_LIKE = "0-9lIOoSsBZ!|"
_NUMBER = rf"[{_DIGIT_LIKE}é]{{1,5}}"
_ROMAN = re.compile(r"(?=[ivxl])x{0,3}(?:ix|iv|v?i{0,3})\Z")
_PAGE_WORD = re.compile(
    rf"(?:(?:page|pag|pagina|página|pág|pagine|seite|blz|bladzijde|стр|страница|p|s|S|Page|Seite|Página|Pagina|Pag|Pág|PAGE)\.? ?)"
    rf"{_NUMBER}(?: ?(?:/|of|von|de|di|van|sur|из) ?{_NUMBER})?\Z"
)
_PAGE_SIGN = re.compile(rf"(?:[-–—] ?{_NUMBER} ?[-–—]|\[ ?{_NUMBER} ?\]|\( ?{_NUMBER} ?\)|{_NUMBER} ?/ ?{_NUMBER})\Z")
_BARE = re.compile(rf"{_NUMBER}\Z")
_CODE = re.compile(r"(?<![\w-])[A-Za-z0-9]{2,6}-[A-Za-z0-9]{3,6}(?![\w-])")
_REVISION = re.compile(r"\b[Rr][a-z]*v\. ?\S{1,3}\Z")
_WITH_NUMBER = re.compile(rf"\A{_NUMBER} {{2,}}(?=\S)|(?<=\S) {{2,}}{_NUMBER}\Z")
_SPLIT = re.compile(r"\S+")
_LETTER = re.compile(r"[^\W\d_]")
_LEXICON_WORD = r"([\p{L}][\p{L}\p{M}'’]*(?:-[\p{L}][\p{L}\p{M}'’]*)*)"


def clean_word(token: str) -> str:
    """A token in lower case without punctuation at its ends."""
    return token.lower().strip(_EDGE).lstrip(_OPEN).replace("’", "'")


# ---- lexicon ---------------------------------------------------------------------------------------------------


def lexicon(clean: DataFrame) -> DataFrame:
    """``word, n`` of all texts of the column ``text``: words in lower case, compounds with their hyphens."""
    words = F.expr(f"regexp_extract_all(replace(lower(text), '’', ''''), r\"{_LEXICON_WORD}\", 1)")
    return clean.where("text is not null").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


# ---- lines -----------------------------------------------------------------------------------------------------


def _page_number(line: str) -> bool:
    s = line.strip()
    if not s or len(s) > 24:
        return False
    if _PAGE_SIGN.match(s) or _PAGE_WORD.match(s):
        return any(c.isdigit() or c in "lIOoSBZé" for c in s)
    return False


def _bare_number(line: str) -> str | None:
    s = line.strip()
    if _ROMAN.match(s):
        return "roman"
    if _BARE.match(s) and (any(c.isdigit() for c in s) or s in ("l", "I", "O", "lO", "ll", "é")):
        return "digits"
    return None


def _value(s: str) -> int | None:
    t = s.strip().translate(str.maketrans("lIOoSsBZ!|é", "11005582116"))
    return int(t) if t.isdigit() else None


def line_kinds(lines: list[str], known: frozenset | dict) -> list[str]:
    """For each line text, blank, page, header, maybe (a header if it runs through the upload) or figure."""
    kinds = ["text" if s.strip() else "blank" for s in lines]
    full = [i for i, k in enumerate(kinds) if k == "text"]
    if len(full) < 1:
        return kinds
    # page numbers; runs of bare numbers under a short label are the axis of a figure
    for a, i in enumerate(full):
        if _page_number(lines[i]):
            kinds[i] = "page"
    a = 0
    while a < len(full):
        i = full[a]
        if kinds[i] == "text" and _bare_number(lines[i]):
            b = a
            while b + 1 < len(full) and kinds[full[b + 1]] == "text" and _bare_number(lines[full[b + 1]]):
                b += 1
            run = full[a : b + 1]
            before = lines[full[a - 1]].strip() if a else ""
            label = a > 0 and kinds[full[a - 1]] == "text" and len(before) <= 12 and " " not in before and before[-1:] not in ".!?:;,"
            if label:
                kinds[full[a - 1]] = "figure"
                values = [_value(lines[j]) if _bare_number(lines[j]) == "digits" else None for j in run]
                on = 1
                step = values[0]
                while on < len(run) and step is not None and values[on] == values[on - 1] + step:
                    on += 1
                for j in run[:on]:
                    kinds[j] = "figure"
                run = run[on:]
            for j in run:
                kinds[j] = "page"
            a = b + 1
        else:
            a += 1
    widths = [len(lines[i].strip()) for i in full if kinds[i] == "text"]
    widths.sort()
    wide = widths[int(len(widths) * 0.8)] if widths else 0
    order = [i for i in full if kinds[i] in ("text", "page")]
    for a, i in enumerate(order):
        if kinds[i] == "text":
            k = _header_kind(lines, order, a, kinds, wide, known)
            if k:
                kinds[i] = k
    return kinds


def _header_kind(lines: list[str], order: list[int], a: int, kinds: list[str], wide: int, known) -> str | None:
    raw = lines[order[a]].strip()
    if len(raw) > 75:
        return None
    core = _WITH_NUMBER.sub("", raw).strip()
    numbered = core != raw
    words = [w for w in re.split(r"[\s|–-]+", core) if len(_LETTER.findall(w)) >= 2]
    if not words or len(words) > 7:
        return None
    code = _CODE.search(core)
    has_code = bool(code and any(c.isdigit() for c in code[0]) and code[0].lower() not in known)
    revision = bool(_REVISION.search(core)) and ("|" in core or has_code)
    letters = _LETTER.findall(core)
    upper = sum(c.isupper() for c in letters) / len(letters)
    ends = core[-1:] in ".!?:;,)" and not revision
    before = lines[order[a - 1]].strip() if a else ""
    after = lines[order[a + 1]].strip() if a + 1 < len(order) else ""
    edge = a == 0 or a == len(order) - 1 or kinds[order[a - 1]] in ("page", "header") or kinds[order[a + 1]] == "page"
    broken = bool(before) and before[-1:] not in ".!?:" and after[:1].islower()
    if ends:
        return None
    if (has_code or revision) and len(words) <= 7 and (edge or broken or "|" in core or "–" in core or "  " in core or "®" in core):
        lower_words = sum(w.islower() and w in known for w in words)
        if lower_words <= 3:
            return "header"
    if upper > 0.75 and len(letters) >= 5:
        if len(words) >= 2 or numbered:
            return "header"
        return "maybe" if clean_word(words[0]) in known else "header"
    if (numbered or "®" in core) and len(words) <= 5 and not core[:1].islower():
        return "header"
    # a line of running text goes to the margin or ends a sentence; this one does neither
    if 2 <= len(words) <= 5 and core[:1].isupper() and not re.search(r"[.!?] ", core):
        natural = bool(after) and len(raw) + 1 + len(after.split(" ", 1)[0]) > 0.95 * wide
        strange = sum(len(w) > 3 and w.isalpha() and clean_word(w) not in known for w in words)
        if not natural and (edge or broken or len(core) < 0.6 * max(wide, 40)):
            return "header"
        if strange >= 2 and (edge or broken):
            return "header"
    return None


def header_key(line: str) -> str:
    """A line without its numbers, in lower case: equal for the same header of other pages."""
    core = _WITH_NUMBER.sub("", line.strip())
    return re.sub(r"\d+", "#", " ".join(core.lower().split()))


def analyse(text: str, known, prefixes) -> tuple[list[str], list[tuple[int, int]], list[tuple[int, int, int, str, str, int]]]:
    """Kinds of all lines; pairs of lines that share a broken word; words that the frequent words lack.

    Words are (line, place, length of the part before the break or 0, word, word before, second line or -1).
    """
    lines = [s.rstrip("\r") for s in text.split("\n")]
    kinds = line_kinds(lines, known)
    running = [i for i, k in enumerate(kinds) if k == "text"]
    nxt = dict(zip(running, running[1:]))
    hyphens: list[tuple[int, int]] = []
    unknown: list[tuple[int, int, int, str, str, int]] = []
    skip_first: dict[int, bool] = {}
    last = ""
    for i in running:
        tokens = _SPLIT.findall(lines[i])
        first = 1 if skip_first.get(i) else 0
        for p, token in enumerate(tokens):
            if p < first:
                continue
            left = 0
            second = -1
            if p == len(tokens) - 1 and len(token) > 1 and token[-1] in _BREAKS and _LETTER.match(token[-2]) and i in nxt:
                ahead = _SPLIT.findall(lines[nxt[i]])
                if ahead and ahead[0][:1].islower() or ahead and not ahead[0][:1].isalpha() and _LETTER.search(ahead[0]) and not ahead[0][:1] in _OPEN[:-3]:
                    stem = token[:-1]
                    whole, compound = clean_word(stem + ahead[0]), clean_word(f"{stem}-{ahead[0]}")
                    part, rest = clean_word(stem), clean_word(ahead[0])
                    if whole in known:
                        joined = True
                    elif compound in known or part in prefixes:
                        joined = False
                    else:
                        joined = token[-1] != "-" or not (part in known and rest in known)
                    skip_first[nxt[i]] = True
                    second = nxt[i]
                    if joined:
                        hyphens.append((i, nxt[i]))
                        left = len(stem.lower().lstrip(_OPEN))
                        token = stem + ahead[0]
                    else:
                        left = len(stem.lower().lstrip(_OPEN)) + 1
                        token = f"{stem}-{ahead[0]}"
            word = clean_word(token)
            if word and word not in known and not _plain(token, word, known):
                core = token.lower().rstrip(_EDGE).replace("’", "'")
                unknown.append((i, p, left, core, last, second))
            last = word
    return kinds, hyphens, unknown


_PLAIN_NUMBER = re.compile(r"[\d.,:/%°±+–<>=~≥≤×^-]*\d[\d.,:/%°±+–<>=~≥≤×^-]*(?:mg|ml|g|kg|cm|mm|km|h|c|%|°c|th|st|nd|rd|er|e|º|ª|\.º)?\Z")


def _plain(token: str, word: str, known) -> bool:
    """Numbers, compounds of known words, words without two letters and words of other scripts are no suspects."""
    if _PLAIN_NUMBER.match(word) or word.rstrip("!") in known:
        return True
    if not word.isascii() and not re.search(r"[a-z]", word):
        return True
    if not _LETTER.search(word):
        return True
    parts = re.split(r"[-/'’]", word)
    return len(parts) > 1 and all(p in known or p.isdigit() or not p for p in parts)


# ---- symmetric deletes -----------------------------------------------------------------------------------------


def folds(word: str) -> set[str]:
    """The word with look-alike strings made equal, in either order where they overlap."""
    word = word.translate(_FOLD_ONE)
    out = set()
    for order in _FOLDS:
        w = word
        for a, b in order:
            w = w.replace(a, b)
        out.add(w)
    return out


def deletes(word: str) -> list[str]:
    """The folded word and all strings of one character less."""
    out = set()
    for w in folds(word) | folds(word.replace("6", "é")):
        out |= {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} if len(w) > 3 else {w}
    return list(out)


def weighted_distance(read: str, meant: str, most: float = 2.0) -> float:
    """Edit distance in which confusions cost little; above ``most`` any larger number may be returned.

    Words of the same beginning and end are compared between them; rows that nothing within ``most`` can reach end it.
    """
    n, m = len(read), len(meant)
    if abs(n - m) > 3:
        return most + 1
    if read == meant:
        return 0.0
    # what is alike at both ends costs nothing; two characters stay, as a confusion may reach into them
    a = 0
    while a < min(n, m) and read[a] == meant[a]:
        a += 1
    a = max(a - 2, 0)
    z = 0
    while z < min(n, m) - a and read[n - 1 - z] == meant[m - 1 - z]:
        z += 1
    z = max(z - 2, 0)
    read, meant = read[a : n - z], meant[a : m - z]
    n, m = len(read), len(meant)
    far = int(most) + 3  # beyond this distance from the diagonal each step costs too much
    rows = [[1e9] * (m + 1) for _ in range(n + 1)]
    rows[0][0] = 0.0
    alive = 0
    for i in range(n + 1):
        row = rows[i]
        low = 1e9
        for j in range(max(0, i - far), min(m, i + far) + 1):
            if i == j == 0:
                low = 0.0
                continue
            best = 1e9
            if i:
                best = rows[i - 1][j] + 1
            if j:
                best = min(best, row[j - 1] + 1)
            if i and j:
                best = min(best, rows[i - 1][j - 1] + (read[i - 1] != meant[j - 1]))
                for x, y in _BY_END.get((read[i - 1], meant[j - 1]), ()):
                    u, v = len(x), len(y)
                    if u <= i and v <= j and read[i - u : i] == x and meant[j - v : j] == y:
                        best = min(best, rows[i - u][j - v] + CHEAP)
            row[j] = best
            low = min(low, best)
        alive = alive + 1 if low > most else 0
        if alive >= 2:  # a confusion of two characters may skip one row
            return most + 1
    return rows[n][m]


_BY_END: dict[tuple[str, str], list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BY_END.setdefault((_a[-1], _b[-1]), []).append((_a, _b))

_NUMBER_READ = re.compile(r"(?=.*\d)[0-9lioszb!|.,/%]+\Z")
_INSIDE = re.compile(r"[a-zà-ÿ][@€$!|(0-9]+[a-zà-ÿ]|\A[@€$!|0-9(][a-zà-ÿ]{3,}|[a-zà-ÿ]{3,}[@€$|0-9(]\Z")


def _spread_deletes(words: DataFrame, *carry: str) -> DataFrame:
    names = ["word", *carry]

    def spread(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in it:
            t = t.assign(key=[deletes(w.lstrip(_OPEN[:-3]) if w[:1] != "(" else w) for w in t.word])
            yield t.explode("key")[[*names, "key"]]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.select(*names).schema)
    return words.select(*names).mapInPandas(spread, f"{fields}, key string")


def candidates(suspects: DataFrame, words: DataFrame, least: int = 2) -> DataFrame:
    """``word, meant, cost, n``: for each suspect the lexicon words that a cheap misreading explains.

    suspects: distinct ``word``; words: ``word, n``. A suspect that is in the lexicon has no candidates. A number read
    as letters has its digits, a word with signs inside and no candidate has the empty string.
    """
    trusted = words.where(F.col("n") >= least)
    unknown = suspects.join(trusted.select("word"), "word", "left_anti")
    index = _spread_deletes(trusted, "n").withColumnRenamed("word", "meant")
    # strings of the folded alphabet are nearly unique: no key holds more than a few words
    pairs = _spread_deletes(unknown).join(index, "key").select("word", "meant", "n").distinct()

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in it:
            cost = [
                min(weighted_distance(w, m, 1.0), weighted_distance(w.lstrip("("), m, 1.0)) if w[:1] == "(" else weighted_distance(w, m, 1.0)
                for w, m in zip(t.word, t.meant)
            ]
            t = t.assign(cost=cost)
            short = t.meant.str.len() < 4
            yield t[(t.cost > 0) & (t.cost <= MOST_COST) & ~(short & (t.cost > CHEAP))][["word", "meant", "cost", "n"]]

    near = pairs.mapInPandas(judge, "word string, meant string, cost double, n long")

    def shape(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digits = str.maketrans("liosbz!|", "11058211"[:8])
        for t in it:
            rows = []
            for w in t.word:
                if _NUMBER_READ.match(w) and not w.isdigit() and re.search("[lioszb!|]", w):
                    rows.append((w, w.translate(digits), 0.3, 0))
                elif w in ("l", "o"):
                    rows.append((w, "1" if w == "l" else "0", 0.3, 0))
                elif _INSIDE.search(w):
                    rows.append((w, "", 1.0, 0))
            yield pd.DataFrame(rows, columns=["word", "meant", "cost", "n"])

    return near.unionByName(unknown.select("word").mapInPandas(shape, "word string, meant string, cost double, n long"))


# ---- the operator ----------------------------------------------------------------------------------------------


_FOUND = (
    "src string, row_id long, upload_id string, line_no int, what string, word string, before string, place int, left int, line_2 int"
)


class _Asked:
    """The frequent words and those that are known of one text's others; what else is looked for is written down."""

    def __init__(self, frequent: frozenset, more: Iterable[str]) -> None:
        self.frequent, self.more, self.asked = frequent, frozenset(more), set()

    def __contains__(self, word: str) -> bool:
        if word in self.frequent or word in self.more:
            return True
        self.asked.add(word)
        return False


def _frequent(words: DataFrame) -> tuple[frozenset, frozenset, bool]:
    """At most ``FREQUENT`` words of the lexicon, the first parts of compounds among them, and whether these are all."""
    top = [r.word for r in words.where("n >= 2").orderBy(F.desc("n"), "word").limit(FREQUENT + 1).collect()]
    whole = len(top) <= FREQUENT
    top = top[:FREQUENT]
    return frozenset(top), frozenset(w.split("-", 1)[0] for w in top if "-" in w), whole


def _read(texts: DataFrame, known: frozenset, prefixes: frozenset, whole: bool) -> DataFrame:
    """The rows of ``read_lines``; if the words are not the whole lexicon, also ``ask`` and ``ask_prefix`` rows."""
    shared = texts.sparkSession.sparkContext.broadcast((known, prefixes))

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, first = shared.value
        for t in it:
            rows = []
            for src, row_id, upload, text, more, firsts in zip(t.src, t.row_id, t.upload_id, t.text, t.more, t.firsts):
                if not text:
                    continue
                a, b = (frequent, first) if whole else (_Asked(frequent, more), _Asked(first, firsts))
                kinds, hyphens, unknown = analyse(text, a, b)
                lines = text.split("\n")
                for i, k in enumerate(kinds):
                    if k in ("header", "page", "maybe"):
                        rows.append((src, row_id, upload, i + 1, k, header_key(lines[i]) if k == "maybe" else None, None, 0, 0, 0))
                for i, j in hyphens:
                    rows.append((src, row_id, upload, i + 1, "hyphen", None, None, 0, 0, j + 1))
                for i, p, left, word, before, second in unknown:
                    rows.append((src, row_id, upload, i + 1, "word", word, before, p, left, second + 1))
                if not whole:
                    rows += [(src, row_id, upload, 0, what, w, None, 0, 0, 0) for what, x in (("ask", a), ("ask_prefix", b)) for w in x.asked]
            yield pd.DataFrame(rows, columns=["src", "row_id", "upload_id", "line_no", "what", "word", "before", "place", "left", "line_2"])

    return texts.select("src", "row_id", "upload_id", "text", "more", "firsts").mapInPandas(read, _FOUND)


def read_lines(scanned: DataFrame, words: DataFrame, cut) -> DataFrame:
    """One row for each header, page, maybe and hyphen line and for each word that the lexicon may lack.

    A lexicon that is too large for every task answers by a join: texts are read with its most frequent words, and those
    whose other questions find a word are read again with it, until no text learns anything new.
    """
    known, prefixes, whole = _frequent(words)
    none = F.array().cast("array<string>")
    pending = scanned.select("src", "row_id", "upload_id", "text", none.alias("more"), none.alias("firsts"))
    if whole:
        return cut(_read(pending, known, prefixes, True))
    trusted = words.where("n >= 2").select("word")
    firsts = trusted.where("word like '%-%'").select(F.substring_index("word", "-", 1).alias("word")).distinct()
    done = None
    while True:
        found = cut(_read(pending, known, prefixes, False))
        hits = found.where("what = 'ask'").join(trusted, "word", "left_semi").unionByName(found.where("what = 'ask_prefix'").join(firsts, "word", "left_semi"))
        learnt = cut(hits.groupBy("src", "row_id").agg(
            F.collect_set(F.when(F.col("what") == "ask", F.col("word"))).alias("a"), F.collect_set(F.when(F.col("what") == "ask_prefix", F.col("word"))).alias("b")
        ))
        final = found.where("what not in ('ask', 'ask_prefix')").join(learnt.select("src", "row_id"), ["src", "row_id"], "left_anti")
        done = final if done is None else done.unionByName(final.select(done.columns))
        if not learnt.limit(1).count():
            return done
        both = pending.join(learnt, ["src", "row_id"])
        pending = cut(both.select("src", "row_id", "upload_id", "text", F.concat("more", "a").alias("more"), F.concat("firsts", "b").alias("firsts")))


def _second_line() -> Column:
    """Whether the misread part of a broken word lies on its second line: behind the letters that both words share."""
    shared = F.expr("size(filter(sequence(1, greatest(1, least(length(word), length(meant)))), i -> left(word, i) = left(meant, i)))")
    return (F.col("left") > 0) & (F.col("line_2") > 0) & (shared >= F.col("left"))


def noise(scanned: DataFrame, clean: DataFrame, cut) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is wrong in scanned texts: (lines, repairs, lexicon).

    scanned: ``src, row_id, upload_id, text``, one row for each text; clean: ``text`` of units that were not scanned.
    lines: ``src, row_id, line_no, kind`` with kind hyphen, misread, header or page; lines are counted from 1 between
    line feeds. repairs: ``src, row_id, line_no, place, left, line_2, word, before, meant, cost, n`` with all candidates
    of every misread word. Null and empty texts have no rows; a text of any length is read as a whole. Empty tables
    give no rows; without clean units no word is repaired.
    """
    words = cut(lexicon(clean))
    found = read_lines(scanned, words, cut)
    suspects = found.where("what = 'word'").select("word").distinct()
    fixes = cut(candidates(suspects, words))
    # a common misreading is spread by its texts
    salted = fixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    read_words = found.where("what = 'word'").withColumn("salt", F.pmod(F.xxhash64("src", "row_id"), F.lit(SALTS)).cast("int"))
    repairs = read_words.join(salted, ["word", "salt"]).drop("salt")
    running = found.where("what = 'maybe'")
    through = running.groupBy("upload_id", "word").agg(F.count_distinct("src", "row_id").alias("pages")).where("pages >= 3")
    headers = running.join(through.select("upload_id", "word"), ["upload_id", "word"], "left_semi").withColumn("what", F.lit("header"))
    line = F.when(_second_line(), F.col("line_2")).otherwise(F.col("line_no")).cast("int")
    misread = repairs.select("src", "row_id", line.alias("line_no"), F.lit("misread").alias("kind"))
    cols = ["src", "row_id", "line_no", F.col("what").alias("kind")]
    lines = found.where("what in ('header', 'page', 'hyphen')").select(*cols).unionByName(headers.select(*cols)).unionByName(misread)
    return lines.distinct(), repairs, words


def best_repairs(repairs: DataFrame, clean: DataFrame) -> DataFrame:
    """One repair of every misread word: least cost, then the bigram with the word before, then the frequency."""
    several = repairs.where("meant <> ''")
    pairs = several.select("before", "meant").distinct()
    words = F.expr(f"regexp_extract_all(replace(lower(text), '’', ''''), r\"{_LEXICON_WORD}\", 1)")
    both = clean.where("text is not null").select(words.alias("w")).where("size(w) > 1")
    both = both.select(F.explode(F.expr("transform(sequence(0, size(w) - 2), i -> struct(w[i] as before, w[i + 1] as meant))")).alias("x"))
    wanted = both.select("x.*").join(pairs, ["before", "meant"], "left_semi")  # before they are counted
    counts = wanted.groupBy("before", "meant").agg(F.count("*").alias("together"))
    counted = several.join(counts, ["before", "meant"], "left")
    order = Window.partitionBy("src", "row_id", "line_no", "place").orderBy("cost", F.desc_nulls_last("together"), F.desc("n"), "meant")
    return counted.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "together")


def _cased(token: str, word: str, meant: str) -> str:
    at = token.lower().replace("’", "'").find(word)
    if at < 0:
        return token
    old = token[at : at + len(word)]
    letters = [c for c in old if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        meant = meant.upper()
    elif letters and letters[0].isupper() and old[0] == letters[0]:
        meant = meant[:1].upper() + meant[1:]
    return token[:at] + meant + token[at + len(word) :]


def rebuild(text: str, drop: set[int], joined: set[int], fixes: dict[tuple[int, int], tuple[str, str]]) -> str:
    """The text in continuous paragraphs: without dropped lines, broken words joined, misread words replaced."""
    lines = [s.rstrip("\r") for s in text.split("\n")]
    out: list[list[str]] = []
    words: list[str] = []
    marks: list[tuple[list[str], int, tuple[str, str]]] = []
    glue = False
    for i, s in enumerate(lines, 1):
        if i in drop:
            continue
        tokens = _SPLIT.findall(s)
        if not tokens:
            if words and not glue:
                out.append(words)
                words = []
            continue
        for p, token in enumerate(tokens):
            if glue and words:
                words[-1] += token
                glue = False
            else:
                words.append(token)
                if (i, p) in fixes:
                    marks.append((words, len(words) - 1, fixes[(i, p)]))
        if tokens[-1][-1:] in _BREAKS:
            if i in joined:
                words[-1] = words[-1][:-1]
                glue = True
            elif len(tokens[-1]) > 1:
                words[-1] = words[-1][:-1] + "-"
                glue = True
    if words:
        out.append(words)
    for para, at, (word, meant) in marks:
        para[at] = _cased(para[at], word, meant)
    return "\n\n".join(" ".join(p) for p in out)


def repaired(scanned: DataFrame, lines: DataFrame, best: DataFrame) -> DataFrame:
    """``src, row_id, text``: every text of ``scanned`` in continuous readable paragraphs; null stays null."""
    from pyspark.sql import functions as f

    marks = lines.where("kind <> 'misread'").groupBy("src", "row_id").agg(
        f.collect_set(f.when(f.col("kind") != "hyphen", f.col("line_no"))).alias("drop"),
        f.collect_set(f.when(f.col("kind") == "hyphen", f.col("line_no"))).alias("joined"),
    )
    fixes = best.groupBy("src", "row_id").agg(f.collect_list(f.struct("line_no", "place", "word", "meant")).alias("fixes"))
    full = scanned.select("src", "row_id", "text").join(marks, ["src", "row_id"], "left").join(fixes, ["src", "row_id"], "left")

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in it:
            out = []
            for text, drop, joined, fix in zip(t.text, t["drop"], t.joined, t.fixes):
                fix = {(x["line_no"], x["place"]): (x["word"], x["meant"]) for x in fix} if fix is not None else {}
                sets = [set(map(int, s)) if s is not None else set() for s in (drop, joined)]
                out.append(None if text is None else rebuild(text, *sets, fix))
            yield pd.DataFrame({"src": t.src, "row_id": t.row_id, "text": out})

    return full.select("src", "row_id", "text", "drop", "joined", "fixes").mapInPandas(build, "src string, row_id long, text string")


