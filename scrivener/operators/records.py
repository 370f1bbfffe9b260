"""Rows that fail to parse: raw delimited records split into typed rows and rejected rows with their reason.

Everything stays in the JVM. A record is cut at its quotation marks; pieces at even places lie outside quoted fields.
A record is well quoted if its pieces are odd in number and every outer piece is bounded by delimiters (or is empty
between two quoted pieces, which is an escaped quotation mark). Cells are then exploded to (record, column, value),
joined with a rule table, and the broken rules are aggregated for each record; clean rows are the anti-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they apply.
REASONS = ("quoting", "column_count", "invalid_value")
DELIMITERS = ",;\t|"


@dataclass(frozen=True)
class Rule:
    """A validation of one column role. kind: match (pattern on the value without outer spaces), forbid, least_words."""

    role: str
    kind: str
    argument: str


#: Fixed values of the key-message format.
KEY_MESSAGE_RULES = (
    Rule("key_message_id", "match", r"\A[Kk][Mm]-[0-9]{3,6}\z"),
    Rule("key_message", "least_words", "3"),
    Rule("key_message", "forbid", r"[\uFFFD\x00-\x09\x0B\x0C\x0E-\x1F\x7F-\x9F]"),
)


def _pieces(raw: Column) -> Column:
    return F.split(raw, '"', -1)


def _quoted_badly(delimiter: Column) -> Column:
    """Whether the column ``pieces`` breaks the quoting rules for ``delimiter``."""
    n = F.size("pieces")

    def bad(piece: Column, i: Column) -> Column:
        inner = (i > 0) & (i < n - 1)
        left = (i > 0) & ~piece.startswith(delimiter)
        right = (i < n - 1) & ~piece.endswith(delimiter)
        empty = (piece == "") & (inner | (i == 0) | (i == n - 1))
        return (i % 2 == 0) & ~empty & (left | right)

    return (n % 2 == 0) | F.exists(F.transform("pieces", bad), lambda x: x)


#: Roles of a file without a header, which is read as comma-separated.
_NO_HEADER = ("key_message_id", "brand", "key_message")

#: Joins the pieces of a well quoted record to its fields. Delimiters outside quotes become a mark that the record does not
#: hold, empty pieces between two quoted ones a quotation mark; then the record is cut once.
_FIELDS = r"""
    case when size(pieces) = 1 then split(body, concat('\\Q', delimiter, '\\E'), -1)
    else split(array_join(transform(pieces, (s, i) -> case when i % 2 = 1 then s when s = '' and i > 0 and i < size(pieces) - 1 then '"'
        else replace(s, delimiter, mark) end), ''), mark, -1) end
"""


def _mark(body: Column) -> Column:
    """A text made from a hash of the record, which the record itself cannot hold."""
    return F.concat(F.lit("\ue000"), F.hex(F.xxhash64(body)), F.lit("\ue000"))


def _body(raw: Column) -> Column:
    """The record without the carriage return of its line end."""
    return F.when(raw.endswith("\r"), F.expr("left(raw, length(raw) - 1)")).otherwise(raw)


def _role(name: Column) -> Column:
    key = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return (
        F.when(key.endswith("id"), "key_message_id")
        .when(key.contains("brand") | key.contains("product"), "brand")
        .when(key.contains("word"), "key_words")
        .when(key.contains("message"), "key_message")
        .otherwise(F.concat(F.lit("other_"), key))
    )


def headers(raw: DataFrame) -> DataFrame:
    """Delimiter, number of columns and column roles of each file, from its record with ``line_no`` 1.

    The delimiter is the first of comma, semicolon, tab and vertical bar outside quotes. A header delivered again counts
    once; of several headers of one file that with the smallest ``record_id`` holds.
    """
    first = raw.where("line_no = 1 and raw is not null").groupBy("source_file").agg(F.min_by("raw", "record_id").alias("raw"))
    cut = first.withColumn("body", _body(F.col("raw"))).withColumn("pieces", _pieces(F.col("body")))
    outside = F.array_join(F.filter("pieces", lambda s, i: i % 2 == 0), "")
    found = F.regexp_extract(outside, f"[{DELIMITERS}]", 0)
    cut = cut.withColumn("delimiter", F.when(found == "", ",").otherwise(found))
    names = cut.withColumn("mark", _mark(F.col("body"))).withColumn("fields", F.expr(_FIELDS))
    return names.select("source_file", "delimiter", F.size("fields").alias("width"), F.transform("fields", _role).alias("roles"))




def parse(raw: DataFrame, salts: int = 16) -> DataFrame:
    """``record_id``, ``source_file``, ``line_no``, ``fields`` (null where quotes are broken), ``width`` and ``roles``.

    Header records are left out. The header joins on the file and a hash of the record, so that one file with a large
    part of all records spreads over ``salts`` tasks; a file's header is repeated ``salts`` times, not its records.
    """
    salt = F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int")
    own = raw.where("line_no is null or line_no <> 1").select("record_id", "source_file", "line_no", "raw", salt.alias("salt"))
    head = headers(raw).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = own.join(head, ["source_file", "salt"], "left").drop("salt")
    rows = rows.select(
        "record_id", "source_file", "line_no", F.coalesce(_body(F.col("raw")), F.lit("")).alias("body"),
        F.coalesce("delimiter", F.lit(",")).alias("delimiter"), F.coalesce("width", F.lit(3)).alias("width"),
        F.coalesce("roles", F.array(*[F.lit(x) for x in _NO_HEADER])).alias("roles"),
    ).withColumn("pieces", _pieces(F.col("body")))
    bad = _quoted_badly(F.col("delimiter"))
    rows = rows.withColumn("mark", _mark(F.col("body"))).withColumn("fields", F.when(~bad, F.expr(_FIELDS)))
    return rows.select("record_id", "source_file", "line_no", "fields", "width", "roles")


def _broken() -> Column:
    words = F.size(F.filter(F.split("value", "[ \\r\\n]+"), lambda w: w != ""))
    return (
        F.when(F.col("kind") == "match", ~F.expr("trim(BOTH ' ' FROM value) rlike argument"))
        .when(F.col("kind") == "forbid", F.expr("value rlike argument"))
        .otherwise(words < F.col("argument").cast("int"))
    )


def rejected(raw: DataFrame, rules: tuple[Rule, ...] = KEY_MESSAGE_RULES) -> DataFrame:
    """``record_id`` and ``reason`` of every record that fails, each record once.

    The first reason of quoting, column_count and invalid_value holds. Null and empty records have one empty field, so
    they fail by column_count (unless the file has one column). A column without rule may be empty. An empty table
    gives no rows; other columns are ignored.
    """
    return _reasons(parse(raw), rules)


def _reasons(parsed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Cells exploded to (record, column, value), joined with the rules, and the errors of each record aggregated."""
    table = parsed.sparkSession.createDataFrame([(r.role, r.kind, r.argument) for r in rules], "role string, kind string, argument string")
    cells = parsed.select("record_id", "width", "roles", F.posexplode_outer("fields").alias("place", "value"))
    cells = cells.select("record_id", "width", "place", F.get("roles", F.col("place")).alias("role"), "value")
    judged = cells.join(F.broadcast(table), "role", "left").withColumn("wrong", F.coalesce(_broken() & F.col("kind").isNotNull(), F.lit(False)))
    errors = judged.groupBy("record_id").agg(F.max("place").alias("last"), F.max("width").alias("width"), F.max("wrong").alias("wrong"))
    at = F.when(F.col("last").isNull(), 0).when(F.col("last") + 1 != F.col("width"), 1).when(F.col("wrong"), 2)
    found = errors.select("record_id", at.alias("at")).where("at is not null")
    return found.select("record_id", F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("at") + 1).alias("reason"))


def loaded(raw: DataFrame, rules: tuple[Rule, ...] = KEY_MESSAGE_RULES) -> DataFrame:
    """The valid records, typed: ``record_id, key_message_id, brand, key_message, key_words``, each record once.

    The ID is trimmed and in upper case; brand and key words are null where empty or absent.
    """
    records = parse(raw)
    parsed = records.where("fields is not null").join(_reasons(records, rules), "record_id", "left_anti").dropDuplicates(["record_id"])

    def value(role: str) -> Column:
        cell = F.trim(F.expr(f"get(fields, array_position(roles, '{role}') - 1)"))
        return F.when(cell != "", cell)

    return parsed.select(
        "record_id", F.upper(value("key_message_id")).alias("key_message_id"), value("brand").alias("brand"),
        value("key_message").alias("key_message"), value("key_words").alias("key_words"),
    )
