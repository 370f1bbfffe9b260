"""Problem 2: key-message records that fail to parse, and those that load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivener.operators.records import loaded, rejected
from scrivener.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invalid record with the first reason that applies."""
    return rejected(table(spark, sf_dir, "key_message_records"))


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid record as a typed key message."""
    return loaded(table(spark, sf_dir, "key_message_records"))


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded}


def _for_each_delimiter(template: str) -> str:
    arms = [f"when delimiter = {d} then {template.replace('DELIM', e)}" for d, e in (("','", ","), ("';'", ";"), ("chr(9)", r"\t"), ("'|'", r"\|"))]
    return "case " + " ".join(arms) + " end"


_FIELD = r'(?:"(?:[^"]|"")*"|[^"DELIM]*)'
_GOOD = _for_each_delimiter(rf"regexp_full_match(body, '(?s){_FIELD}(?:DELIM{_FIELD})*')")
_CELLS = _for_each_delimiter(rf"regexp_extract_all(delimiter || body, '(?s)DELIM({_FIELD})', 1)")

_PARSED = rf"""
    with recs as (
        select distinct record_id, source_file, line_no, regexp_replace(raw, '\r$', '') as body from key_message_records
    ), heads as (
        select source_file, regexp_extract(regexp_replace(body, '"[^"]*"', '', 'g'), '[,;\t|]') as delimiter, body from recs where line_no = 1
    ), names as (
        select source_file, delimiter, list_transform({_CELLS}, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) as names from heads
    ), parsed as (
        select record_id, names, {_GOOD} as good, list_transform({_CELLS}, lambda x: case when starts_with(x, '"')
            then replace(x[2:-2], '""', '"') else x end) as cells
        from recs join names using (source_file) where line_no <> 1
    ), valued as (
        select *, cells[list_position(list_transform(names, lambda n: ends_with(n, 'id')), true)] as id,
            cells[list_position(list_transform(names, lambda n: contains(n, 'brand') or contains(n, 'product')), true)] as brand,
            cells[list_position(list_transform(names, lambda n: contains(n, 'message') and not ends_with(n, 'id')), true)] as message,
            cells[list_position(list_transform(names, lambda n: contains(n, 'word')), true)] as words
        from parsed
    ), judged as (
        select *, case when not good then 'quoting' when len(cells) <> len(names) then 'column_count'
            when not regexp_full_match(trim(id, ' '), '[Kk][Mm]-[0-9]{{3,6}}')
                or len(list_filter(regexp_split_to_array(message, '[ \r\n]+'), lambda w: w <> '')) < 3
                or regexp_matches(message, '[\x{{FFFD}}\x{{00}}-\x{{09}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}-\x{{9F}}]') then 'invalid_value' end as reason
        from valued
    )
"""

SQL = {
    "p2_found": _PARSED + "select record_id, reason from judged where reason is not null",
    "p2_loaded": _PARSED
    + "select record_id, upper(trim(id, ' ')) as key_message_id, nullif(trim(brand, ' '), '') as brand, "
    "nullif(trim(message, ' '), '') as key_message, nullif(trim(words, ' '), '') as key_words from judged where reason is null",
}
