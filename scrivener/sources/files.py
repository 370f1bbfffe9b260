"""Files of many kinds read into units: one row for each page, part or member with its text."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions.text import extension

#: Kinds of files by extension; a table of settings that is joined to file names.
KINDS = {
    "table": ".csv .tsv", "markup": ".html .htm .xml .svg .md .txt .json .yaml .yml .log .ini .rst .tex .sql .py .js .css .sh",
    "document": ".docx .docm .dotx .rtf", "email": ".eml", "package": ".zip", "spreadsheet": ".xlsx .xls", "fallback": ".ps .eps .ai .psd .indd .raw .bin .dat .doc .odt",
}
TEXT_EXTENSIONS = frozenset((KINDS["markup"] + " " + KINDS["table"]).split())


@dataclass(frozen=True)
class Limits:
    """Rows of a table and of a sheet, members of a package that are listed and read, their bytes, strings of a binary file; null for all."""

    table_rows: int | None = None
    sheet_rows: int | None = None
    names: int | None = None
    members: int | None = None
    member_bytes: int | None = None
    strings: int | None = None


#: Fixed values of a preview; whole files have no limits.
PREVIEW = Limits(251, 200, 200, 30, 1 << 20, 250)
WHOLE = Limits()
#: Values of cells that count as empty.
NO_VALUE = frozenset("#N/A|#N/A N/A|#NA|-1.#IND|-1.#QNAN|-NaN|-nan|1.#IND|1.#QNAN|<NA>|N/A|NA|NULL|NaN|None|n/a|nan|null".split("|"))
UNIT_SCHEMA = "path string, source_no int, source_type string, text string, warning string"


def decode(data: bytes) -> str:
    """Text of bytes in UTF-8, UTF-16 with a mark, Windows-1252 or Latin-1, whichever fits first."""
    encodings = ["utf-8-sig", "utf-16"] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ["utf-8-sig"]
    for name in [*encodings, "cp1252"]:
        try:
            return data.decode(name)
        except UnicodeError:
            continue
    return data.decode("latin-1")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def html_text(value: str) -> str:
    """Text nodes, one a line; those of scripts and styles too."""
    parser = _Text()
    parser.feed(value)
    parser.close()
    return "\n".join(parser.parts)


def xml_text(value: str) -> str:
    """Text of all elements, one a line; without tags if it is not well formed. Entities are not expanded."""
    if "<!DOCTYPE" not in value and "<!ENTITY" not in value:
        try:
            return "\n".join(t.strip() for t in ElementTree.fromstring(value).itertext() if t.strip())
        except ElementTree.ParseError:
            pass
    return re.sub(r"<[^>]+>", " ", value)


def table_text(value: str, most: int | None = None) -> str:
    """Cells of a row joined by bars; the delimiter is guessed from the beginning."""
    try:
        dialect = csv.Sniffer().sniff(value[:4096], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = []
    for row in csv.reader(io.StringIO(value), dialect):
        rows.append(" | ".join(c.strip() for c in row))
        if len(rows) == most:
            break
    return "\n".join(rows)


def rtf_text(value: str) -> str:
    """Without groups of settings, control words and braces."""
    value = re.sub(r"\\'[0-9a-fA-F]{2}", lambda m: bytes.fromhex(m[0][2:]).decode("cp1252", "replace"), value)
    value = re.sub(r"\\par[d]?\b ?", "\n", value)
    value = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", value)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", value)).strip()


def docx_text(data: bytes) -> list[str]:
    """Paragraphs of the body, notes and comments of a word-processor package."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in ("document", "footnotes", "endnotes", "comments"):
            name = f"word/{part}.xml"
            if name not in z.namelist():
                continue
            root = ElementTree.fromstring(z.read(name))
            space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            lines = ["".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p")]
            out.append("\n".join(s for s in lines if s.strip()))
    return [s for s in out if s]


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\[^\n]|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    dates = {*range(14, 23), *range(45, 48), *(k for k, v in own.items() if re.search("[ymdhs]", v, re.IGNORECASE))}
    return {i for i, x in enumerate(root.findall(f"{_MAIN}cellXfs/{_MAIN}xf")) if int(x.get("numFmtId", 0)) in dates}


def _cell(c: ElementTree.Element, shared: list[str], dates: set[int], start: datetime) -> str:
    kind, v = c.get("t", "n"), c.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        value = "".join(t.text or "" for t in c.findall(f"{_MAIN}is//{_MAIN}t"))
    elif v is None or kind == "e":
        value = ""
    elif kind == "s":
        value = shared[int(v)]
    elif kind == "b":
        value = str(v == "1")
    elif kind == "n":
        number = float(v)
        if int(c.get("s", 0)) in dates:
            value = str(start + timedelta(seconds=round(number * 86400)))
        else:
            value = str(int(number)) if number.is_integer() else str(number)
    else:
        value = v
    return "" if value in NO_VALUE else value


def sheet_texts(data: bytes, most: int | None = None) -> list[str]:
    """Each sheet of a workbook as CSV: its header and the rows after it, at most ``most``."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            items = ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")
            shared = ["".join(t.text or "" for p in (f"{_MAIN}t", f"{_MAIN}r/{_MAIN}t") for t in i.findall(p)) for i in items]
        dates = _date_styles(z)
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        late = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_MAIN}workbookPr"))
        start = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in book.iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_LINK)]
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            rows: dict[int, dict[int, str]] = {}
            at = 0
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_MAIN}row"):
                at = int(row.get("r", at + 1))
                col = 0
                for c in row.findall(f"{_MAIN}c"):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    col = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) if letters else col + 1
                    rows.setdefault(at, {})[col] = _cell(c, shared, dates, start)
            filled = [r for r, cells in rows.items() if any(cells.values())]
            if not filled:
                out.append("")
                continue
            first, last = min(filled), max(filled)
            width = max(c for cells in rows.values() for c in cells)
            lines = [[rows.get(r, {}).get(c, "") for c in range(1, width + 1)] for r in range(first, (last if most is None else min(last, first + most)) + 1)]
            head: list[str] = []
            for i, h in enumerate(lines[0]):
                h, n = h or f"Unnamed: {i}", 0
                while (f"{h}.{n}" if n else h) in head:
                    n += 1
                head.append(f"{h}.{n}" if n else h)
            text = io.StringIO()
            csv.writer(text, lineterminator="\n").writerows([head, *lines[1:]])
            out.append(text.getvalue())
    return out


_DRAWING = re.compile(r"%|/[A-Za-z]|(?:[-\d.]+ )*(?:def|bind def|moveto|lineto|curveto|setfont|scalefont|show|stroke|fill|gsave|grestore|newpath|closepath|end|endobj|obj)$")


def printable(data: bytes, least: int = 4, most: int | None = None) -> str:
    """Readable stretches of a binary file, each once, without drawing commands and hexadecimal data."""
    found = dict.fromkeys(m.decode("ascii").strip() for m in re.findall(rb"[\x20-\x7e]{%d,}" % least, data))
    kept = [s for s in found if s and not _DRAWING.match(s) and not (len(s) >= 24 and sum(c in "0123456789abcdefABCDEF" for c in s) > 0.85 * len(s))]
    return "\n".join(kept[:most])


def email_text(data: bytes) -> str:
    """Subject, sender, recipients and the plain and HTML parts."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    parts = [f"{h}: {m[h]}" for h in ("Subject", "From", "To", "Date") if m[h]]
    for p in m.walk():
        if p.get_content_type() == "text/plain":
            parts.append(p.get_content())
        elif p.get_content_type() == "text/html":
            parts.append(html_text(p.get_content()))
    return "\n".join(s.strip() for s in parts if s.strip())


def _members(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Members with safe names; those whose names lead out of the package are left aside."""
    return [i for i in z.infolist() if not i.is_dir() and not i.filename.startswith("/") and ".." not in i.filename.split("/")]


def package_names(data: bytes, most: int | None = None) -> list[str]:
    """Names of the members of a package."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [i.filename for i in _members(z)[:most]]


def package_units(data: bytes, limits: Limits = WHOLE) -> Iterator[tuple[str, str | None]]:
    """Names and texts of the text members of a package."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        read = 0
        for i in _members(z):
            suffix = "." + i.filename.rsplit(".", 1)[-1].lower() if "." in i.filename else ""
            small = limits.member_bytes is None or i.file_size <= limits.member_bytes
            if suffix in TEXT_EXTENSIONS and small and read != limits.members:
                read += 1
                yield i.filename, decode(z.read(i))


_SHOW = re.compile(rb"(-?[\d.]+)\s+(-?[\d.]+)\s+moveto\s*\(((?:\\.|[^()\\])*)\)\s*show")


def postscript_text(data: bytes) -> str:
    """Shown strings in reading order: from the top down, then from the left."""
    shown = [(-float(y), float(x), re.sub(rb"\\(.)", rb"\1", t).decode("latin-1")) for x, y, t in _SHOW.findall(data)]
    return "\n".join(t for _, _, t in sorted(shown) if t.strip())


_RASTER = (b"8BPS", b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"II*\x00", b"MM\x00*")


def units_of(path: str, kind: str | None, data: bytes, limits: Limits = PREVIEW) -> list[tuple[int, str, str, str | None]]:
    """Number, type, text and warning of the units of one file. What cannot be read is its printable strings with a warning, not an error."""
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path else ""
    try:
        if kind == "table":
            return [(1, "sheet", table_text(decode(data), limits.table_rows), None)]
        if kind == "markup":
            text = decode(data)
            text = html_text(text) if suffix in (".html", ".htm") else xml_text(text) if suffix in (".xml", ".svg") else text
            return [(1, "text", text, None)]
        if kind == "document":
            parts = [rtf_text(decode(data))] if suffix == ".rtf" else docx_text(data)
            return [(i, "document", t, None) for i, t in enumerate(parts, 1)]
        if kind == "email":
            return [(1, "email", email_text(data), None)]
        if kind == "package":
            names = (1, "listing", "\n".join(package_names(data, limits.names)), None)
            return [names, *((i, "member", f"{name}\n{t}", None) for i, (name, t) in enumerate(package_units(data, limits), 2))]
        if kind == "spreadsheet":
            if data[:2] != b"PK":
                return [(1, "sheet", printable(data, most=limits.strings), f"no reader for spreadsheets of this format: {suffix}")]
            return [(i, "sheet", t, None) for i, t in enumerate(sheet_texts(data, limits.sheet_rows), 1)]
        text = postscript_text(data) if data[:2] == b"%!" else ""
        warning = None if kind else f"unknown file type {suffix}"
        if not text and data.startswith(_RASTER):
            warning = "raster image: no text without recognition"
        return [(1, "fallback", text or printable(data, most=limits.strings), warning)]
    except Exception as e:  # noqa: BLE001 - one broken file must not end the job
        return [(1, kind or "fallback", printable(data, most=limits.strings), f"not readable: {type(e).__name__}; printable strings")]


def registry(spark: SparkSession) -> DataFrame:
    """``extension, kind``."""
    return spark.createDataFrame([(x, k) for k, v in KINDS.items() for x in v.split()], "extension string, kind string")


def read_units(spark: SparkSession, path: str, limits: Limits = WHOLE) -> DataFrame:
    """Units of all files under ``path``: ``path, source_no, source_type, text, warning``; whole unless limits are given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = files.withColumn("extension", extension(F.col("path"))).join(F.broadcast(registry(spark)), "extension", "left")  # settings

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in it:
            rows = [(p, *u) for p, k, d in zip(t.path, t.kind, t.content) for u in units_of(p, k, bytes(d), limits)]
            yield pd.DataFrame(rows, columns=["path", "source_no", "source_type", "text", "warning"])

    return known.select("path", "kind", "content").mapInPandas(read, UNIT_SCHEMA)


def newest_file(spark: SparkSession, path: str, default: str | None = None, sample: str | None = "sample") -> str | None:
    """The file ``default`` if there is one of that name, else the one changed last; those named ``sample...`` only as a last resort."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    last = F.lit(False) if sample is None else name.startswith(sample)
    first = F.lit(False) if default is None else name == default.lower()
    best = rows.orderBy(F.desc(first), last, F.desc("modificationTime"), "path").limit(1).collect()
    return best[0].path if best else None


def checklist_lines(data: bytes) -> list[str]:
    """Paragraphs and table rows, cells joined by bars, of a word-processor package in the order of its body."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{space}body")
    out = []

    def words(e: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in e.iter(f"{space}t")).strip()

    for child in body if body is not None else ():
        if child.tag == f"{space}p":
            out.append(words(child))
        elif child.tag == f"{space}tbl":
            for row in child.iter(f"{space}tr"):
                cells = [" ".join(filter(None, (words(p) for p in c.iter(f"{space}p")))) for c in row.findall(f"{space}tc")]
                out.append(" | ".join(c for c in cells if c))
    return [s for s in out if s]


def read_checklists(spark: SparkSession, path: str) -> DataFrame:
    """``doc, line_no, line`` of checklist documents under ``path``; doc is the version: name and beginning of the content's hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("lower(path) like '%.docx'")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    named = files.select(F.concat(stem, F.lit(":"), F.substring(F.sha2("content", 256), 1, 16)).alias("doc"), "content")

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in it:
            rows = []
            for doc, data in zip(t.doc, t.content):
                try:
                    lines = checklist_lines(bytes(data))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    lines = printable(bytes(data)).split("\n")
                rows += [(doc, i, s) for i, s in enumerate(lines, 1)]
            yield pd.DataFrame(rows, columns=["doc", "line_no", "line"])

    return named.mapInPandas(read, "doc string, line_no long, line string")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``job, ground_truth, transcript`` of the folders under ``path``: texts beside a file; a transcript may be subtitles."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("value"))
    parts = F.split("path", "/")
    rows = rows.select(F.element_at(parts, -2).alias("job"), F.element_at(parts, -1).alias("name"), "value")
    kept = F.filter(F.split("value", "\r?\n"), lambda s: (F.trim(s) != "") & ~s.rlike(r"^\s*\d+\s*$") & ~s.contains("-->"))
    plain = F.array_join(F.transform(kept, lambda s: F.trim(s)), " ")

    def of(name: str, value) -> object:
        return F.max(F.when(F.col("name") == name, value))

    spoken = F.coalesce(of("reference_transcript.txt", F.col("value")), of("reference_transcript.srt", plain))
    return rows.groupBy("job").agg(of("ground_truth.txt", F.col("value")).alias("ground_truth"), spoken.alias("transcript")).where("ground_truth is not null or transcript is not null")


_MESSAGE_COLUMNS = (("key_message_id", ("keymessageid", "messageid", "kmid", "id")), ("brand_product", ("brandproduct", "brand", "product")), ("key_message", ("keymessage", "approvedmessage", "message")))


def _places(names: list[str]) -> list[int]:
    """Where the three columns of a key message stand: by name, else by position."""
    plain = [re.sub(r"[^a-z0-9]", "", c.lower()) for c in names]
    return [next((plain.index(o) for o in options if o in plain), min(i, len(names) - 1)) for i, (_, options) in enumerate(_MESSAGE_COLUMNS)]


def read_key_messages(spark: SparkSession, path: str) -> DataFrame:
    """``key_message_id, brand_product, key_message`` of a text table or workbook with a header; missing values are empty, rows without id left out."""
    names = [n for n, _ in _MESSAGE_COLUMNS]
    if path.lower().endswith(".xlsx"):
        files = spark.read.format("binaryFile").load(path).select("content")

        def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in it:
                rows = []
                for data in t.content:
                    table = list(csv.reader(io.StringIO(sheet_texts(bytes(data))[0])))
                    at = _places(table[0]) if table else []
                    rows += [[r[i].strip() for i in at] for r in table[1:]]
                yield pd.DataFrame(rows, columns=names)

        return files.mapInPandas(read, ", ".join(f"{n} string" for n in names)).where("key_message_id <> ''")
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = [F.coalesce(F.trim(F.col(f"`{df.columns[i]}`")), F.lit("")).alias(n) for n, i in zip(names, _places(df.columns))]
    return df.select(*out).where("key_message_id <> ''")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Distinct terms, in lower case, of a file with a column ``term`` in any case."""
    df = spark.read.option("header", True).csv(path)
    name = next((c for c in df.columns if c.strip().lower() == "term"), None)
    if name is None:
        raise ValueError("the file has no column term")
    return df.select(F.lower(F.trim(F.col(f"`{name}`"))).alias("term")).where("term <> ''").distinct()


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: the words of subtitle files without numbers and times."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\r?\n").alias("lines"))
    kept = F.filter("lines", lambda s: (F.trim(s) != "") & ~s.rlike(r"^\s*\d+\s*$") & ~s.contains("-->"))
    return rows.select("path", F.array_join(F.transform(kept, lambda s: F.trim(s)), " ").alias("text"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth cases of JSON files, one row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
