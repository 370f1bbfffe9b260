import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scrivener.operators.records import headers, loaded, rejected

SCHEMA = "record_id long, source_file string, line_no int, raw string, received_at timestamp"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, None) for r in rows], schema)


def reasons(df):
    return {r.record_id: r.reason for r in rejected(df).collect()}


def brute(raw, d, width):
    """A state machine over characters: the fields, or None if the quoting is broken."""
    raw = raw[:-1] if raw.endswith("\r") else raw
    fields, i = [], 0
    while True:
        if raw[i : i + 1] == '"':
            i += 1
            value = ""
            while True:
                if i >= len(raw):
                    return None
                if raw[i] == '"':
                    if raw[i + 1 : i + 2] == '"':
                        value += '"'
                        i += 2
                        continue
                    i += 1
                    break
                value += raw[i]
                i += 1
            if i < len(raw) and raw[i] != d:
                return None
        else:
            j = raw.find(d, i)
            value = raw[i:] if j < 0 else raw[i:j]
            if '"' in value:
                return None
            i += len(value)
        fields.append(value)
        if i >= len(raw):
            return fields
        i += 1


def test_reasons_in_order(spark):
    rows = [
        (1, "f", 1, '"Key Message ID";Brand;Message\r'), (2, "f", 2, "KM-123;A;one two three"), (3, "f", 3, 'KM-123;A;"one two three'),
        (4, "f", 4, "KM-123;A"), (5, "f", 5, "KM-12;A;one two three"), (6, "f", 6, "KM-123;;one two"), (7, "f", 7, " km-123456 ;A;\"one \"\"x\"\" three\"\r"),
        (8, "f", 8, None), (9, "f", 9, ""), (10, "f", 10, 'KM-123;A;"one two" three'), (11, "f", 11, "KM-123;A;one two\x07 three"),
        (12, "f", 12, 'K"M;A'), (13, "f", 13, "KM-123;A;one\r\ntwo three"), (14, "f", 14, "KM-123;A;one two �"), (4, "f", 4, "KM-123;A"),
        (15, "g", 1, "Brand,Message,Key Words,KM ID"), (16, "g", 2, "A,one two three,,KM-777"), (17, "h", 2, "KM-777,A,one two three"),
    ]
    want = {3: "quoting", 4: "column_count", 5: "invalid_value", 6: "invalid_value", 8: "column_count", 9: "column_count", 10: "quoting",
            11: "invalid_value", 12: "quoting", 14: "invalid_value"}
    df = table(spark, rows)
    assert reasons(df) == want
    good = {r.record_id: r for r in loaded(df).collect()}
    assert set(good) == {2, 7, 13, 16, 17}
    assert good[7].key_message_id == "KM-123456" and good[7].key_message == 'one "x" three'
    assert good[16].brand == "A" and good[16].key_words is None and good[16].key_message_id == "KM-777"
    assert {r.source_file: (r.delimiter, r.width) for r in headers(df).collect()} == {"f": (";", 3), "g": (",", 4)}


def test_empty_long_and_extra_columns(spark):
    assert rejected(table(spark, [])).count() == 0 and loaded(table(spark, [])).count() == 0
    long = "word " * 100_000
    df = table(spark, [(1, "f", 1, "ID|Brand|Message"), (2, "f", 2, f"KM-123|A|{long}"), (3, "f", 3, f'KM-123|"A|{long}')])
    df = df.selectExpr("*", "'x' as delimiter", "1 as width", "array('z') as roles", "'y' as value", "0 as salt")
    assert reasons(df) == {3: "quoting"}
    assert loaded(df).count() == 1


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='ab",\n\r ', max_size=12), min_size=1, max_size=20))
def test_quoting_like_a_state_machine(spark, raws):
    rows = [(0, "f", 1, "ID,Message")] + [(i, "f", i + 1, r) for i, r in enumerate(raws, 1)]
    got = reasons(table(spark, rows))
    for i, r in enumerate(raws, 1):
        fields = brute(r, ",", 2)
        want = "quoting" if fields is None else "column_count" if len(fields) != 2 else "invalid_value"
        assert got[i] == want, r


@pytest.mark.parametrize("d", [",", ";", "\t", "|"])
def test_round_trip(spark, d):
    inner = d if d != "\t" else ";"  # a tab within a message is a control character
    messages = ['a "b" c', f"x{inner}y z w", "one\ntwo three", "plain words here"]
    out = io.StringIO()
    rows = [(0, "f", 1, d.join(["KM ID", "Brand", "Message"]))]
    for i, m in enumerate(messages, 1):
        out.seek(0), out.truncate()
        csv.writer(out, delimiter=d, lineterminator="").writerow([f"KM-{1000 + i}", "B", m])
        rows.append((i, "f", i + 1, out.getvalue()))
    got = {r.record_id: r.key_message for r in loaded(table(spark, rows)).collect()}
    assert got == dict(enumerate(messages, 1))
