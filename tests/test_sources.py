import io
import json
import zipfile

from scrivener.sources import files, sinks
from scrivener.streaming.landing import hourly_counts, landed_units


def test_files_of_many_kinds(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text("x;y\n1;2\n")
    (d / "b.html").write_text("<p>Hello <b>you</b></p><script>s</script>")
    (d / "c.xml").write_text("<a>one<b>two</b></a>")
    (d / "broken.xml").write_text("<a>one<b>two</a>")
    (d / "d.rtf").write_text(r"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par World}")
    (d / "e.eml").write_bytes(b"Subject: S\nFrom: a@b.c\nContent-Type: text/plain\n\nBody text")
    (d / "f.txt").write_bytes("größe".encode("cp1252"))
    (d / "g.ps").write_bytes(b"%!PS\n10 20 moveto (low) show\n10 90 moveto (high) show\n")
    (d / "h.weird").write_bytes(b"\x00\x01readable part\x00\xff")
    with zipfile.ZipFile(d / "i.zip", "w") as z:
        z.writestr("in.txt", "inside")
        z.writestr("../out.txt", "outside")
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(d / "j.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p></w:body></w:document>')
    (d / "k.docx").write_bytes(b"no package")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_units(spark, str(d)).collect()}
    assert got["a.csv"].text == "x | y\n1 | 2" and got["b.html"].text == "Hello\nyou\ns" and got["c.xml"].text == "one\ntwo"
    assert got["broken.xml"].text.split() == ["one", "two"] and got["d.rtf"].text == "Hello\nWorld"
    assert "Body text" in got["e.eml"].text and got["f.txt"].text == "größe" and got["g.ps"].text == "high\nlow"
    assert got["h.weird"].text == "readable part" and got["h.weird"].warning and got["i.zip"].text == "in.txt\ninside"
    assert got["j.docx"].text == "Para" and got["k.docx"].warning.startswith("not readable")
    assert files.newest_file(spark, str(d)) is not None


def test_named_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Brand,Approved Message,KM ID\nA,"x, ""y""",KM-1\nB,z,\n')
    assert [tuple(r) for r in files.read_key_messages(spark, str(tmp_path / "m.csv")).collect()] == [("KM-1", "A", 'x, "y"')]
    (tmp_path / "t.csv").write_text("n, Term \n1,Foo\n2,foo\n")
    assert [r.term for r in files.read_terms(spark, str(tmp_path / "t.csv")).collect()] == ["foo"]
    (tmp_path / "s.srt").write_text("1\n00:00:01 --> 00:00:02\nHello\n\n2\n00:00:03 --> 00:00:04\nthere\n")
    assert files.read_subtitles(spark, str(tmp_path / "s.srt")).first().text == "Hello there"
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"id": "c1", "expected_text": "a"}, {"id": "c2"}]}))
    assert files.read_cases(spark, str(tmp_path / "c.json")).count() == 2
    assert files.decode("é".encode("utf-16")) == "é" and files.decode(b"\x81\x8d") == "\x81\x8d"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.append(spark.createDataFrame([(1, 1, "a")], "k int, t int, v string"), path)
    sinks.append(spark.createDataFrame([(2, 1, "b")], "k int, t int, v string"), path)
    sinks.merge(spark.createDataFrame([(2, 2, "c"), (2, 3, "d"), (3, 1, "e")], "k int, t int, v string"), path, ["k"], ["t"])
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {1: "a", 2: "d", 3: "e"}


def test_stream(spark, tmp_path):
    schema = "unit_id long, source_type string, text string, received_at timestamp"
    rows = spark.sql("select cast(id % 3 as long) as unit_id, 'page' as source_type, 'Some  text.' as text, timestamp'2024-01-01 00:10:00' as received_at from range(4)")
    rows.write.parquet(str(tmp_path / "in"))
    landed_units(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), schema).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3 and out.first().cleaned == "Some text."
    spark.sql("select 9L as unit_id, 'page' as source_type, 'x' as text, timestamp'2024-01-05 00:10:00' as received_at").write.mode("append").parquet(str(tmp_path / "in"))
    hourly_counts(spark, str(tmp_path / "in"), str(tmp_path / "hours"), str(tmp_path / "cp2"), schema).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "hours")).agg({"units": "sum"}).first()[0] in (None, 4)


def test_package_names():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("/abs.txt", "no")
        z.writestr("a/../../b.txt", "no")
        z.writestr("ok.md", "yes")
        z.writestr("pic.png", "no")
    assert [n for n, _ in files.package_units(data.getvalue())] == ["ok.md"]
