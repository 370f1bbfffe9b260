"""Fragments of SQL that mirror the column functions, for checks against another engine."""

from __future__ import annotations

from scrivener.functions.text import EVIDENCE_STOP_WORDS, STOP_WORDS

WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def clean(x: str) -> str:
    inner = rf"regexp_replace(regexp_replace(replace(coalesce({x}, ''), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(inner)


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '{WHITE}+'), lambda w: w <> '')"


def key(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '{NOT_WORD}', ' ', 'g'))"


def metric(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def quality(x: str) -> str:
    """Of a cleaned text ``x``, as an expression over it."""
    w = rf"regexp_extract_all({x}, '[A-Za-z0-9][A-Za-z0-9%+./-]*')"
    letters = rf"len(regexp_extract_all({x}, '[A-Za-z]'))"
    return rf"""case when {x} = '' then 0.0 when len({w}) = 0 or {letters} = 0 then 5.0 else floor(greatest(0.0, least(100.0,
        {letters} / length({x}) * 35.0 + len(list_distinct(list_transform({w}, lambda y: lower(y)))) / len({w}) * 25.0
        + len(list_filter({w}, lambda y: length(y) >= 3)) / len({w}) * 20.0 + least(20.0, length({x}) / 30.0))) * 100.0 + 0.5) / 100.0 end"""


def noise(x: str) -> str:
    usual = rf"len(regexp_extract_all({x}, '[A-Za-z0-9\s.,;:!?%/()+\-–—~®™•''’]'))"
    return f"case when {x} = '' then 1.0 else floor(greatest(0.0, 1.0 - {usual} / length({x})) * 10000.0 + 0.5) / 10000.0 end"


def values(items: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


EVIDENCE_STOP = values(EVIDENCE_STOP_WORDS)
STOP = values(STOP_WORDS)


def evidence(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z][a-z0-9-]{{2,}}'), lambda w: not list_contains({EVIDENCE_STOP}, w)))"


def content(x: str) -> str:
    found = rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+(?:[+\-/]+[\p{{L}}\p{{N}}_]+)*')"
    return rf"list_filter({found}, lambda w: regexp_full_match(w, '[a-z][a-z0-9+\-/]{{2,}}') and not list_contains({STOP}, w))"


def garbage(x: str) -> str:
    """Whether a cleaned text ``x`` is speech recognition that made no words."""
    tokens = f"regexp_extract_all({x}, '[A-Za-z0-9]+')"
    alpha = f"len(list_filter({tokens}, lambda y: regexp_matches(y, '[A-Za-z]')))"
    short = rf"len(list_filter({tokens}, lambda y: length(y) <= 2 or regexp_full_match(y, '\d+|[A-Za-z]\d+|\d+[A-Za-z]')))"
    letters, vowels = (f"len(regexp_extract_all({x}, '[{c}]'))" for c in ("A-Za-z", "AEIOUaeiou"))
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    spaced = "|".join(rf"\b{c}(?:\s+{c}\b){{4,}}" for c in signs)
    doubled = "|".join(c + "{6,}" for c in signs + signs[:26].upper())
    return rf"""({alpha} = 0 or (length({x}) < 8 and {alpha} <= 1) or (len({tokens}) >= 4 and {short} / greatest(len({tokens}), 1) > 0.7)
        or ({letters} >= 12 and {vowels} / greatest({letters}, 1) < 0.18) or regexp_matches({x}, '(?i){spaced}') or regexp_matches({x}, '{doubled}'))"""


UNITS = "(select distinct on (unit_id) unit_id, upload_id, source_no, source_type, text, metadata from source_chunks)"
READS = "(select distinct on (ocr_id) ocr_id, unit_id, upload_id, text, engine, selected_variant, confidence_score, quality_score, warnings from ocr_results)"
CHUNKS = "(select distinct on (vec_id) vec_id, upload_id, chunk_id, location, text, embedding from content_chunks)"
ANALYSES = "(select distinct on (analysis_id) * from analysis_results)"
MATCHES = "(select distinct on (match_id) * from matched_chunks)"
MESSAGES = "(select distinct on (match_id) * from key_message_matches)"
