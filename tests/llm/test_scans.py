import random

from scrivener.llm.scans import CONFUSIONS, analyse, best_repairs, candidates, deletes, line_kinds, noise, rebuild, repaired, weighted_distance
from scrivener.session import cut

CLEAN = [
    "Treatment with Zorvex was associated with a significant improvement in quality of life.",
    "The once-daily tablet offers convenient administration and well-tolerated therapy.",
    "Clinical experience in pregnancy is limited, therefore treatment should be avoided where possible.",
    "Patients should consult their physician before changing the dose of Zorvex within 19 days.",
]
PAGE = """Zorvex Draft copy   3
Treatrnent with Zorvex was associated with a signi-
ficant improvement in quality of life. The once-
daily tablet offers convenient administration and
- 3 -
HCP-1234  Zorvex
well-tolerated therapy. Clinical experi¬
ence in pregnancy is limited, therefore tre@tment
should be avoided where possible. Patients should
consult their physician within l9 days.
Week
4
8
12
Patients should consult their physician before changing the dose of Zorvex.
7"""


def run(spark, rows):
    scanned = spark.createDataFrame(rows, "src string, row_id long, upload_id string, text string").selectExpr("*", "1 as word", "2 as n", "3 as kind")
    clean = spark.createDataFrame([(t,) for t in CLEAN * 3], "text string")
    return scanned, clean, noise(scanned, clean, cut)


def test_page(spark):
    rows = [("unit", 1, "u", PAGE), ("unit", 2, "u", None), ("ocr", 1, "u", ""), ("ocr", 2, "u", PAGE.replace("\n", "\r\n")), ("ocr", 3, None, "word " * 50_000)]
    scanned, clean, (lines, repairs, _) = run(spark, rows)
    want = {(1, "header"), (2, "misread"), (2, "hyphen"), (5, "page"), (6, "header"), (7, "hyphen"), (8, "misread"), (10, "misread"), (16, "page")}
    got = {}
    for r in lines.collect():
        got.setdefault((r.src, r.row_id), set()).add((r.line_no, r.kind))
    assert got == {("unit", 1): want, ("ocr", 2): want}
    text = {(r.src, r.row_id): r.text for r in repaired(scanned, lines, best_repairs(repairs, clean)).collect()}
    assert text["unit", 2] is None and text["ocr", 1] == ""
    assert text["unit", 1] == text["ocr", 2]
    assert text["unit", 1].startswith("Treatment with Zorvex was associated with a significant improvement in quality of life. The once-daily tablet")
    assert "well-tolerated therapy. Clinical experience in pregnancy is limited, therefore treatment should" in text["unit", 1]
    assert "within 19 days." in text["unit", 1] and "Draft" not in text["unit", 1]


def test_empty(spark):
    assert run(spark, [])[2][0].count() == 0


def test_symmetric_deletes_find_every_cheap_misreading(spark):
    """Against brute force: all lexicon words within the cheap cost, by the distance to every word."""
    r = random.Random(4)
    words = sorted({w.strip(".,").lower() for t in CLEAN for w in t.split() if len(w) > 4})
    read = set()
    for w in words:
        for a, b in CONFUSIONS:
            if b in w and len(b) <= len(w) - 2:
                read.add(w.replace(b, a, 1))
    read = sorted(x for x in r.sample(sorted(read), min(150, len(read))) if x not in words)
    found = candidates(spark.createDataFrame([(x,) for x in read], "word string"), spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()
    got = {(x.word, x.meant) for x in found if x.meant in words}
    want = {(x, w) for x in read for w in words if 0 < weighted_distance(x, w) <= 0.3}
    assert len(got & want) >= 0.95 * len(want)
    assert all(weighted_distance(*p) <= 0.7 for p in got)


def test_distance_and_keys():
    assert weighted_distance("rnedicine", "medicine") == 0.3 and weighted_distance("abc", "abc") == 0 and weighted_distance("abc", "abd") == 1
    assert set(deletes("meclicine")) & set(deletes("medicine"))


def test_lines():
    known = frozenset("the drug is given zorvex".split())
    assert line_kinds(["CONFIDENTIAL", "", "The drug is given to all of the adults", "in the study.", "[4]"], known) == ["header", "blank", "text", "text", "page"]
    assert line_kinds(["ZORVEX", "The drug is given."], known)[0] == "maybe"
    assert line_kinds([""], known) == ["blank"] and analyse("", known, frozenset()) == (["blank"], [], [])


def test_rebuild():
    assert rebuild("A bro-\nken word.\n\nNext well-\nknown one.", set(), {1}, {(2, 1): ("word", "sword")}) == "A broken sword.\n\nNext well-known one."
