"""Queries that must give all of their input, not a first part of it."""

import io
import random
import zipfile

from scrivener.functions.correction import indel_ratio
from scrivener.operators.matching import correct_words
from scrivener.plans import reviews
from scrivener.plans.registry import QUERIES
from scrivener.sources import sinks
from scrivener.sources.files import units_of


def test_all_texts_of_an_upload(spark, tmp_path):
    rows = [(i, 1, f"text {i} " + "x" * 2000) for i in range(9, 0, -1)] + [(20, 2, " "), (21, 3, None), (22, 3, "last"), (22, 3, "last")]
    spark.createDataFrame(rows, "unit_id long, upload_id long, text string").write.parquet(f"{tmp_path}/source_chunks.parquet")
    want = "\n".join(f"text {i} " + "x" * 2000 for i in range(1, 10))
    assert {r.upload_id: r.full_text for r in QUERIES["ag15_upload_texts"](spark, str(tmp_path)).collect()} == {1: want, 3: "last"}
    assert {r.upload_id: r.full_text for r in reviews.upload_texts(spark, str(tmp_path), 6).collect()} == {1: "text 1", 3: "last"}


def test_all_terms_of_a_chunk(spark, tmp_path):
    spark.createDataFrame([(1, "renal function test renal function"), (2, "one")], "vec_id long, text string").write.parquet(f"{tmp_path}/content_chunks.parquet")
    got = {r.term: r.n for r in QUERIES["ag16_term_counts"](spark, str(tmp_path)).collect()}
    assert got["renal function"] == 2 and len(got) == 8 and sum(got.values()) == 9
    assert [r.term for r in reviews.term_counts(spark, str(tmp_path), 1).collect()] == ["renal function"]


def test_workbook():
    main, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="C{i}" s="1"><v>45292.5</v></c></row>' for i in range(2, 300))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<x><y Id="r1" Target="worksheets/one.xml"/><y Id="r2" Target="/xl/worksheets/two.xml"/></x>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><r><t>na</t></r><r><t>me</t></r></si></sst>',
        "xl/worksheets/one.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c></row>{rows}</sheetData></worksheet>',
        "xl/worksheets/two.xml": f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>x, y</t></is></c><c t="b"><v>1</v></c></row><row><c><v>0.5</v></c><c t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
    }
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    (n1, t1, one, w1), (n2, t2, two, w2) = units_of("a.xlsx", "spreadsheet", data.getvalue())
    assert (n1, t1, w1, n2, t2, w2) == (1, "sheet", None, 2, "sheet", None)
    lines = one.splitlines()
    assert lines[:2] == ["name,Unnamed: 1,name.1", "2,,2024-01-01 12:00:00"] and len(lines) == 201 and lines[-1].startswith("201,")
    assert two == '"x, y",True\n0.5,\n'
    assert units_of("a.xls", "spreadsheet", b"\xd0\xcf old words")[0][3]


def test_order_of_the_checklist(spark, tmp_path):
    rows = [(1, "B", "Medical Review"), (2, "A", "Medical Review"), (3, "Z", "Legal Review"), (4, "A", "other")]
    df = spark.createDataFrame(rows, "vec_id long, item_code string, section_name string").selectExpr("*", "'v1' as checklist_version", "timestamp '2024-01-01' as updated_date")
    df.repartition(4).write.parquet(f"{tmp_path}/checklist_items.parquet")
    assert [r.vec_id for r in reviews.checklist(spark, str(tmp_path)).collect()] == [3, 2, 1]


def test_locations(spark, tmp_path):
    rows = [(2, 1, "page", 2), (1, 1, "page", 1), (3, 1, "audio", None), (4, 2, "image", 0)]
    spark.createDataFrame(rows, "unit_id long, upload_id long, source_type string, source_no int").write.parquet(f"{tmp_path}/source_chunks.parquet")
    assert {r.upload_id: r.location for r in reviews.source_locations(spark, str(tmp_path)).collect()} == {1: "page 1, page 2, audio", 2: "image"}


def test_reports_and_record_keys(spark, tmp_path):
    df = spark.createDataFrame([("../a b" + "c" * 90, 1.0), ("..", None)], "id string, accuracy double")
    sinks.write_reports(df, f"{tmp_path}/reports", "id")
    names = sorted(p.name.split("_", 4)[4] for p in (tmp_path / "reports").glob("report=*"))
    assert names == ["a_b" + "c" * 77, "material"]
    assert '"accuracy":null' in "".join(p.read_text() for p in (tmp_path / "reports").rglob("*.json"))
    old = spark.createDataFrame([(1, "k", "own"), (2, "k", None), (3, None, None)], "id long, key_message_id string, record_key string")
    assert [r.record_key for r in sinks.with_record_key(old, "key_message_id", "id").orderBy("id").collect()] == ["own", "k::2", "::3"]
    assert sinks.with_record_key(old.drop("record_key"), "key_message_id", "id").orderBy("id").first().record_key == "k::1"


def test_corrections_against_all_pairs(spark):
    rng = random.Random(1)
    terms = ["contraindications", "administration", "hypersensitivity", "treatment", "renal", "dose", "dosage", "pharmacokinetics"]
    words = {"raindications", "withadministration", "contraindication", "renol", "dos"}
    for t in terms:
        for n in range(1, 6):
            words.add("".join(rng.choices("abcdefghij", k=n)) + t)
            words.add(t[n:])
            words.add("".join(rng.choices("abcdefghij", k=n)) + t[: -rng.randint(1, 2)])
    want = {}
    for w in words:
        best = min(((-indel_ratio(w, t), t) for t in terms), default=None)
        if len(w) >= 4 and -best[0] >= 85:
            want[w] = best[1]
    got = correct_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {r.word: r.best for r in got.collect()} == want and want["raindications"] == "contraindications" and "withadministration" in want


def test_more_brands_than_one_expression_holds(spark, tmp_path):
    names = [f"brand{a}{b}{c}x" for a in "abcdefghijk" for b in "lmnopqrstuv" for c in "abcdefghijk"]
    spark.createDataFrame([(n,) for n in names], "brand_product string").write.parquet(f"{tmp_path}/key_message_matches.parquet")
    spark.createDataFrame(enumerate(names), "ocr_id long, text string").write.parquet(f"{tmp_path}/ocr_results.parquet")
    units = [(i, 1, f"see {n.upper()}, not {n}y") for i, n in enumerate(names)] + [(-1, 1, names[0] + "y"), (-2, 1, None)]
    spark.createDataFrame(units, "unit_id long, upload_id long, text string").write.parquet(f"{tmp_path}/source_chunks.parquet")
    own = {(r.ocr_id, r.alias) for r in reviews.fuzzy_first_brands(spark, str(tmp_path)).where("score = 1").collect()}
    assert own == set(enumerate(names))
    first = {(r.unit_id, r.alias, r.position) for r in reviews.first_brands(spark, str(tmp_path)).collect()}
    assert first == {(i, n, 4) for i, n in enumerate(names)}
