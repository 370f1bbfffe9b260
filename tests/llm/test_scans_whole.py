"""Lines and words are the same whatever part of the lexicon goes to every task."""

import random

import pytest

from scrivener.llm import queries_scans, scans
from scrivener.llm.scans import _BY_END, CHEAP, CONFUSIONS, noise, weighted_distance
from scrivener.session import cut
from tests.llm.test_scans import CLEAN, PAGE
from tests.oracle import DATA


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("limit", [0, 7])
def test_a_lexicon_too_large_for_every_task(spark, monkeypatch, limit):
    pages = [PAGE, PAGE.replace("signi-\nficant", "in-\nflatable"), "A long-\nterm study of re-\nsults and quality of\nlife is lim-\nited here.\n- 4 -"]
    scanned = spark.createDataFrame([("unit", i, "u", p) for i, p in enumerate(pages)], "src string, row_id long, upload_id string, text string")
    clean = spark.createDataFrame([(t,) for t in [*CLEAN, "An inflatable device for long-term study with results."] * 3], "text string")
    lines, repairs, _ = noise(scanned, clean, cut)
    monkeypatch.setattr(scans, "FREQUENT", limit)
    lines_2, repairs_2, _ = noise(scanned, clean, cut)
    assert _rows(lines) == _rows(lines_2) and _rows(repairs) == _rows(repairs_2)
    assert (1, 2, "hyphen") in {(r.row_id, r.line_no, r.kind) for r in lines_2.collect()}


def test_the_tables_with_a_small_part_of_the_lexicon(spark, monkeypatch):
    whole = _rows(queries_scans.p1_found(spark, f"{DATA}/sf0.001"))
    monkeypatch.setattr(scans, "FREQUENT", 40)
    assert _rows(queries_scans.p1_found(spark, f"{DATA}/sf0.001")) == whole


def _full_distance(read, meant):
    rows = [[0.0] * (len(meant) + 1) for _ in range(len(read) + 1)]
    for i in range(len(read) + 1):
        for j in range(len(meant) + 1):
            if i == j == 0:
                continue
            options = [rows[i - 1][j] + 1] if i else []
            options += [rows[i][j - 1] + 1] if j else []
            if i and j:
                options.append(rows[i - 1][j - 1] + (read[i - 1] != meant[j - 1]))
                options += [rows[i - len(a)][j - len(b)] + CHEAP for a, b in _BY_END.get((read[i - 1], meant[j - 1]), ()) if read[:i].endswith(a) and meant[:j].endswith(b)]
            rows[i][j] = min(options)
    return rows[-1][-1]


def test_distance_against_the_whole_table():
    r = random.Random(3)
    words = sorted({w.strip(".,").lower() for t in CLEAN for w in t.split()})
    for _ in range(4000):
        w = r.choice(words)
        x = w
        for _ in range(r.randint(0, 3)):
            if r.random() < 0.7:
                a, b = r.choice(CONFUSIONS)
                x = x.replace(b, a, 1)
            else:
                at = r.randrange(len(x) + 1)
                x = x[:at] + r.choice("abcrnml1") * r.randint(0, 1) + x[at + r.randint(0, 1) :]
        want = _full_distance(x, w)
        got = weighted_distance(x, w, 1.0)
        assert abs(got - want) < 1e-9 if want <= 1.0 else got > 1.0, (x, w, got, want)
