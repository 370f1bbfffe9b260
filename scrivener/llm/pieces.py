"""Splitting of oversized texts: a tree of sections, paragraphs, list items, lines and sentences, packed bottom-up to the limit.

Sections nest by the depth of their headings (marks, numbers or tags), list items by their indentation; markup elements
that stand for themselves are paragraphs or items. A heading is one node with what follows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHITE = " \t\r\n"
_STRETCH = re.compile(r"[ \t\r\n]+|(?<=[。！？])")
_HEADING = re.compile(r"(#{1,6}) |<h([1-6])|((?:\d+\.)+\d*) +\S|([IVXLC]+\.) +\S|[^a-z]{3,}(?=[\r\n]|\Z)")
_ITEM = re.compile(r"(?:[-*+•–] |\(?(?:\d{1,3}|[a-z]|[ivx]{1,5})[.)] |<(?:li|dt|dd|tr)\b)", re.IGNORECASE)
_ELEMENT = re.compile(r"</?(?:p|div|section|article|table|ul|ol|dl|blockquote|pre|body|head)\b", re.IGNORECASE)
_MAX_HEADING = 90
#: Levels of the tree by the kind of cut, from the coarsest: sections of six depths, items of three; the last three cut within a sentence.
SECTION, PARAGRAPH, ITEM, LINE, SENTENCE, BREAK, WORD, CHARACTER = 0, 6, 7, 10, 11, 12, 13, 14

Node = tuple[int, int, int]


def heading_depth(text: str, at: int) -> int | None:
    """Depth from 0 of the heading that begins at ``at``; None if there is none."""
    m = _HEADING.match(text, at, at + _MAX_HEADING)
    if m is None:
        return None
    line = text[at : at + _MAX_HEADING].split("\n", 1)[0].rstrip()
    if not any(c.isalpha() for c in line) or line[-1] in ".!?…。！？;,":
        return None
    marks, tag, number, roman = m.groups()
    depth = len(marks) if marks else int(tag) if tag else number.strip(".").count(".") + 1 if number else 1
    return min(depth, 6) - 1


def _is_heading(text: str, a: int, b: int) -> bool:
    """Whether a leaf is a heading and nothing else."""
    return b - a <= _MAX_HEADING and "\n" not in text[a:b] and heading_depth(text, a) is not None


def _cut_level(text: str, at: int, white: str) -> int:
    """Level of the cut after the white space ``white``, before what begins at ``at``."""
    lines = white.count("\n")
    if lines == 0:
        return SENTENCE
    if lines >= 2:
        depth = heading_depth(text, at)
        if depth is not None:
            return SECTION + depth
    if _ITEM.match(text, at):
        indent = len(white.rsplit("\n", 1)[1].replace("\t", "    "))
        return ITEM + min(indent // 2, 2)
    return PARAGRAPH if lines >= 2 or _ELEMENT.match(text, at) else LINE


def leaves(text: str) -> list[Node]:
    """Stretches between neighbouring natural boundaries without outer white space: start, end, level of the cut before."""
    out: list[Node] = []
    begin, level = 0, SECTION
    size = len(text)

    def add(end: int) -> None:
        nonlocal begin
        a, b = begin, end
        while a < b and text[a] in _WHITE:
            a += 1
        while b > a and text[b - 1] in _WHITE:
            b -= 1
        if a < b:
            out.append((a, b, level))

    for m in _STRETCH.finditer(text):
        a, b = m.span()
        if a == b:
            cut = SENTENCE
        else:
            if text.count("\n", a, b) < 2 and not (a and text[a - 1] in ".!?…。！？"):
                continue
            cut = _cut_level(text, b, m[0])
        had = len(out)
        add(a)
        begin = b
        level = min(level, cut) if len(out) == had else cut
    add(size)
    return out


def _inside(text: str, a: int, b: int, room: int, level: int) -> list[Node]:
    """Parts of an oversized leaf: its lines, their words, and within longer words stretches of ``room`` characters."""
    if level == CHARACTER:
        return [(i, min(i + room, b), CHARACTER) for i in range(a, b, room)]
    out: list[Node] = []
    for m in re.finditer(r"[^\r\n]+" if level == BREAK else r"[^ \t\r\n]+", text[a:b]):
        x, y = a + m.start(), a + m.end()
        while y > x and text[y - 1] in _WHITE:
            y -= 1
        while x < y and text[x] in _WHITE:
            x += 1
        if x == y:
            continue
        if y - x <= room:
            out.append((x, y, level))
        else:
            inner = _inside(text, x, y, room, level + 1)
            out.extend([(inner[0][0], inner[0][1], level), *inner[1:]])
    return out


def _with_headings(text: str, nodes: list[Node], room: int) -> list[Node]:
    """Headings joined to the node after them, where both are within ``room``, so that no piece ends in a heading."""
    out: list[Node] = []
    for a, b, level in reversed(nodes):
        if out and _is_heading(text, a, b) and out[-1][1] - a <= room:
            out[-1] = (a, out[-1][1], level)
        else:
            out.append((a, b, level))
    return out[::-1]


def _pack(nodes: list[Node], level: int, room: int) -> list[Node]:
    """Merge neighbouring subtrees up to ``room``; only subtrees above it are opened."""
    if nodes[-1][1] - nodes[0][0] <= room or len(nodes) == 1:
        return [(nodes[0][0], nodes[-1][1], nodes[0][2])]
    while level < CHARACTER and not any(n[2] <= level for n in nodes[1:]):
        level += 1
    out: list[Node] = []
    first = 0
    opened = False
    for i in range(1, len(nodes) + 1):
        if i == len(nodes) or nodes[i][2] <= level:
            child = nodes[first:i]
            first = i
            whole = child[-1][1] - child[0][0] <= room or len(child) == 1
            parts = [(child[0][0], child[-1][1], child[0][2])] if whole else _pack(child, level + 1, room)
            for k, part in enumerate(parts):
                # siblings merge; the parts of a section that was opened stay apart from the sections beside it
                apart = level < PARAGRAPH and k == 0 and (opened or not whole)
                if out and not apart and part[1] - out[-1][0] <= room:
                    out[-1] = (out[-1][0], part[1], out[-1][2])
                else:
                    out.append(part)
            opened = not whole
    return out


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Pieces of ``text``: start and end (code points), and whether a leaf above the limit had to be cut for it."""
    room = limit - overlap
    nodes: list[Node] = []
    forced: list[tuple[int, int]] = []
    for a, b, level in leaves(text):
        if b - a <= limit:
            nodes.append((a, b, level))
        else:
            inner = _inside(text, a, b, room, BREAK)
            nodes.extend([(inner[0][0], inner[0][1], level), *inner[1:]])
            forced.append((a, b))
    if not nodes:
        return [(0, 0, False)]
    out: list[tuple[int, int, bool]] = []
    k = 0
    for a, b, _ in _pack(_with_headings(text, nodes, room), SECTION, room):
        while k < len(forced) and forced[k][1] <= a:
            k += 1
        cut = k < len(forced) and forced[k][0] < b
        start = max(a - overlap, b - limit, 0) if out else a
        out.append((start, b, cut))
    return out


def split_column(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """Pieces of every text of more than ``limit`` characters (Unicode code points); shorter texts give no row.

    ``keys``, ``piece_no`` (int, from 1), ``start``, ``stop`` (code points), ``forced`` and, if wanted, ``piece``.
    Cuts lie at section, paragraph, line or sentence boundaries; only a stretch between two neighbouring boundaries
    that is itself above the limit is cut at line breaks, else blanks, else anywhere, and its pieces are ``forced``.
    Each piece but the first begins ``overlap`` characters before its own part, fewer where a single sentence leaves
    less room; no piece is above the limit. Null and empty texts give no row, a long text of white space alone gives one
    empty piece, and rows given twice are split twice. Other columns are dropped, so names cannot clash.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    fields = [df.schema[k] for k in keys]
    made = [("piece_no", T.IntegerType()), ("start", T.IntegerType()), ("stop", T.IntegerType()), ("forced", T.BooleanType())]
    made += [("piece", T.StringType())] * with_text
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in made]])
    n_keys = len(keys)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[int] = []
            cols: list[list] = [[] for _ in made]
            for i, t in enumerate(batch.column(n_keys).to_pylist()):
                for no, (a, b, cut) in enumerate(split(t, limit, overlap), 1):
                    rows.append(i)
                    for c, x in zip(cols, (no, a, b, cut, t[a:b])):
                        c.append(x)
            taken = [batch.column(j).take(pa.array(rows, pa.int64())) for j in range(n_keys)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=schema.names)

    long = df.select(*[df[k] for k in keys], df[text].alias("__text")).where(F.char_length("__text") > limit)
    return long.mapInArrow(batches, schema)
