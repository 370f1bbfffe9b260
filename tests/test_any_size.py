"""What changes its way with the size of its input gives the same result on either side."""

import io
import math
import random
import re
import zipfile
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener import session
from scrivener.functions import metrics
from scrivener.functions.text import STOP_WORDS
from scrivener.operators import mapping, matching
from scrivener.operators.checklists import checklist_rows
from scrivener.operators.correction import all_terms, corrected, default_rules
from scrivener.operators.mapping import map_messages
from scrivener.operators.ranges import framed, last_known, sum_before
from scrivener.operators.tables import page_size, patch
from scrivener.sources import files, sinks


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_rows_delivered_again(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(session, "MOST_REPEATED", most)
    rows = [(i % 70 if i % 7 else None, f"text {i % 70 if i % 7 else None}") for i in range(300)]
    spark.createDataFrame(rows, "k long, t string").repartition(3).write.parquet(f"{tmp_path}/a")
    df = spark.read.parquet(f"{tmp_path}/a")
    want = sorted({r for r in rows}, key=repr)
    assert sorted(map(tuple, session.once(df, "k").collect()), key=repr) == want
    assert sorted(map(tuple, session.once(df.where("k > 3 or k is null").select("k", F.upper("t").alias("u")), "k").collect()), key=repr) == [(k, t.upper()) for k, t in want if k is None or k > 3]
    assert session.once(spark.createDataFrame(rows, "k long, t string"), "k").count() == len(want)
    plan = session.once(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert ("hashpartitioning(k" in plan) == (most == 0)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_ordered_computations(spark, size):
    r = random.Random(size)
    rows = [(r.choice("ab") if r.random() < 0.9 else None, i, r.choice([None, r.randint(0, 9)])) for i in r.sample(range(-40, 200), 90)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    own = {g: sorted((i, v) for h, i, v in rows if h == g) for g in ("a", "b", None)}
    sums, lasts, frames = {}, {}, {}
    for x in own.values():
        for k, (i, v) in enumerate(x):
            sums[i] = sum(w or 0 for _, w in x[:k])
            lasts[i] = next((w for _, w in reversed(x[: k + 1]) if w is not None), None)
            near = [w for _, w in x[max(0, k - 2) : k + 3] if w is not None]
            frames[i] = sum(near) if near else None
    assert {x.i: x.s for x in sum_before(df, "g", "i", "v", "s", size).collect()} == sums
    assert {x.i: x.s for x in last_known(df, "g", "i", "v", "s", size).collect()} == lasts
    if size > 1:
        assert {x.i: x.s for x in framed(df, "g", "i", 2, lambda w: F.sum("v").over(w), "s", max(size, 3)).collect()} == frames


@pytest.mark.parametrize("most", [0, 100_000])
def test_aliases(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "MOST_HEADS", most)
    texts = {1: "The Foo-Bar and foo bars, FOO-BAR2 foo-bar.", 2: "xfoo-bar éfoo-bar", 3: None, 4: "(a) ürban (a)x", 5: "foo"}
    names = ["foo-bar", "foo", "(a)", "ürban", "bar 2"]
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    got = {(r.k, r.alias): r.position for r in matching.alias_positions(df, "k", "t", spark.createDataFrame([(n,) for n in names], "alias string")).collect()}
    want = {}
    for k, t in texts.items():
        for n in names:
            m = re.search(rf"(?<![a-z0-9]){re.escape(n)}(?![a-z0-9])", (t or "").lower())
            if m:
                want[k, n] = m.start()
    assert got == want


def test_word_rates_of_many_words(spark, monkeypatch):
    r = random.Random(5)
    pairs = [(i, [f"w{r.randint(0, 20)}" for _ in range(r.randint(0, 30))], [f"w{r.randint(0, 20)}" for _ in range(r.randint(0, 30))]) for i in range(40)]
    df = spark.createDataFrame(pairs, "i long, a array<string>, b array<string>")
    few = {x.i: x.rate for x in metrics.word_rates(df, F.col("a"), F.col("b"), "rate").collect()}
    monkeypatch.setattr(metrics, "MOST_WORDS", 3)
    assert {x.i: x.rate for x in metrics.word_rates(df, F.col("a"), F.col("b"), "rate").collect()} == few


def test_cosines_of_many_questions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    q = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(40)]
    c = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)]
    a, b = (spark.createDataFrame(x, "k long, v array<double>") for x in (q, c))
    want = sorted(map(tuple, matching.cosine_best(a, b, "k", "v", "k", "v", 3, 4).toDF("q", "c", "score", "place").collect()))
    monkeypatch.setattr(matching, "MOST_BROADCAST", 7)
    assert sorted(map(tuple, matching.cosine_best(a, b, "k", "v", "k", "v", 3, 4).toDF("q", "c", "score", "place").collect())) == want and len(want) > 100


# ---- mapping against brute force --------------------------------------------------------------------------------


def _brute_mapping(kind, units, messages, top_k):
    words = " ".join(units).split()
    chunks = [" ".join(words[a : a + 160]) for a in range(0, len(words), 130)]

    def terms(t):
        return Counter(w for w in re.findall(r"[^\W]{2,}", t.lower()) if w not in STOP_WORDS)

    texts = [terms(c) for c in chunks] + [terms(f"{b} {m}") for _, b, m in messages]
    df = Counter(t for x in texts for t in x)
    n = len(texts)
    vectors = []
    for x in texts:
        v = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in x.items()}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1
        vectors.append({t: w / norm for t, w in v.items()})
    own, keys = vectors[: len(chunks)], vectors[len(chunks) :]
    semantic = [round(max((sum(w * k.get(t, 0) for t, w in c.items()) for c in own), default=0), 6) for k in keys]
    full = "\n".join(units).lower()
    brands = {}
    for b in {b for _, b, _ in messages}:
        m = re.search(rf"(?<![a-z0-9]){re.escape(b.lower())}(?![a-z0-9])", full)
        fuzzy = 0.0
        for t in {re.sub("[^a-z0-9]", "", t) for t in re.findall("[a-z0-9-]+", full)}:
            if len(t) >= 5 and len(b) >= 6:
                if b.lower() in t:
                    fuzzy = 1.0
                elif t[:3] == b.lower()[:3]:
                    fuzzy = max(fuzzy, SequenceMatcher(None, b.lower(), t).ratio())
        if m:
            brands[b] = ("exact", 0.99 - min(m.start(), 200) * 0.0001)
        elif fuzzy >= 0.75:
            brands[b] = ("fuzzy", fuzzy)
    line = next((x.strip() for u in units for x in u.split("\n") if re.fullmatch(r"[A-Z][A-Z0-9\s\-/()]{2,59}", x.strip())), "").lower()
    for b in {b for _, b, _ in messages}:
        if line and (b.lower() in line or line in b.lower()):
            brands[b] = ("possible", 1.0)
    up = {"exact": (0.18, 0.99), "fuzzy": (0.08, 0.95), "possible": (0.18, 0.95)}
    rows = []
    for (k, b, _), s in zip(messages, semantic):
        if b in brands:
            by, most = up[brands[b][0]]
            s = min(most, s + by)
        rows.append((k, b, s))
    least = 0.25 if brands else 0.40
    if brands and kind in ("pdf", "image"):
        surest = max(x for _, x in brands.values())
        rows = [r for r in rows if r[1] in brands and brands[r[1]][1] >= surest - 0.0005]
        if surest < 1:
            least = max(0.05, max(s for *_, s in rows) - 0.05)
    rows.sort(key=lambda r: (-r[2], r[0]))
    return [(k, round(s, 3)) for k, _, s in rows[:top_k] if s >= least and s > 0]


@pytest.mark.parametrize("most", [(0, 20_000), (2, 20_000), (2_000, 20_000), (2_000, 3)])
def test_mapping_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(mapping, "MOST_UNITS", most[0])
    monkeypatch.setattr(mapping, "MOST_MESSAGES", most[1])
    r = random.Random(8)
    brands = ["Zorvexin", "Calmodan", "Brixomel", "Tresvikal"]
    nouns = "pain fever therapy adults children dose tablet heart asthma migraine placebo trial safety relief headache study".split()
    messages = [(f"K{i}", r.choice(brands), " ".join(r.choices(nouns, k=5))) for i in range(12)]
    docs, units = {}, {}
    for d in range(24):
        docs[f"d{d}"] = r.choice(["pdf", "docx", "image", "text"])
        parts = [" ".join(r.choices(nouns + ["the", "of", "is"], k=r.choice([8, 60, 200]))) for _ in range(r.randint(1, 3))]
        if r.random() < 0.6:
            b = r.choice(brands)
            parts[0] += " " + r.choice([b, b[:-2] + "xx", b[:3] + "qqq"]) + " " + r.choice(nouns)
        if r.random() < 0.3:
            parts[-1] = r.choice(brands).upper() + "\n" + parts[-1]
        units[f"d{d}"] = parts
    flat = [(d, i * 10 + k, p) for i, (d, ps) in enumerate(units.items()) for k, p in enumerate(ps)]
    got = {}
    rows = map_messages(
        spark.createDataFrame(list(docs.items()), "doc string, file_type string"), spark.createDataFrame(flat, "doc string, unit long, text string"),
        spark.createDataFrame(messages, "record_key string, brand_product string, key_message string"), 5,
    )
    for x in rows.orderBy("doc", "place").collect():
        got.setdefault(x.doc, []).append((x.record_key, round(x.confidence_score, 3)))
    for d in docs:
        want = _brute_mapping(docs[d], units[d], messages, 5)
        assert [k for k, _ in got.get(d, [])] == [k for k, _ in want] and all(abs(a - b) <= 0.0011 for (_, a), (_, b) in zip(got.get(d, []), want)), d


# ---- correction, checklists, files -------------------------------------------------------------------------------


def test_correction_chain(spark):
    df = spark.createDataFrame([(1, "Take Paracetarnol, 10 mg of lbuprofen!  (Asp1rin)"), (2, None), (3, ""), (4, "200 300")], "k long, t string")
    terms = spark.createDataFrame([("paracetamol", True), ("ibuprofen", True), ("aspirin", False)], "term string, active boolean")
    got = {r.k: (r.corrected, r.corrections) for r in corrected(df, "k", "t", all_terms(terms), units=["mg"]).collect()}
    assert got[1] == ("Take Paracetamol, 10mg of ibuprofen! (Asplrin)", 5) and got[2] == got[3] == ("", 0) and got[4] == ("200 300", 0)
    assert corrected(df, "k", "t", all_terms(terms).limit(0), units=["mg"]).where("k = 1").first().corrected == "Take Paracetamol, 10mg of lbuprofen! (Asplrin)"
    assert default_rules(spark).count() == 5 and default_rules(spark, default_rules(spark).limit(1)).count() == 1


def _docx(body):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def test_checklist_document(spark, tmp_path):
    def p(t):
        return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"

    def row(*cells):
        return "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"

    body = p("M0 | before any section | Yes") + p("Section 3 Medical") + "<w:tbl>" + row("#", "Check item", "Reviewer", "Mandatory") + row("M1", "Claims", "have | data", "Ann", "Yes") + row("M2", "Dose stated", "No")
    body += row("M3", "123", "No") + "</w:tbl>" + p("4. Legal") + "<w:tbl>" + row("L1", "Legal review done", "Yes") + row("L2", "Marks shown", "", "Yes") + "</w:tbl>"
    (tmp_path / "list.docx").write_bytes(_docx(body))
    (tmp_path / "broken.docx").write_bytes(b"Section 5\nR1 | Code kept | Yes\n")
    lines = files.read_checklists(spark, str(tmp_path))
    got = [(r.doc.split(":")[0], r.section, r.item_code, r.description, r.reviewer, r.mandatory) for r in checklist_rows(lines).orderBy("doc", "line_no").collect()]
    assert got == [
        ("broken", "Regulatory Review", "R1", "Code kept", "Regulatory", "Yes"), ("list", "Medical Review", "M1", "Claims | have | data", "Ann", "Yes"),
        ("list", "Medical Review", "M2", "Dose stated", "Medical", "No"), ("list", "Legal Review", "L2", "Marks shown", "Legal", "Yes"),
    ]
    assert all(len(r.doc.split(":")[1]) == 16 for r in lines.select("doc").distinct().collect())


def test_references_and_newest(spark, tmp_path):
    for job, name, value in (("a", "ground_truth.txt", " truth "), ("b", "reference_transcript.srt", "1\n00:00:01 --> 00:00:02\nHello\nthere\n"), ("c", "reference_transcript.txt", "x"), ("c", "reference_transcript.srt", "y"), ("d", "other.txt", "z")):
        (tmp_path / "jobs" / job).mkdir(parents=True, exist_ok=True)
        (tmp_path / "jobs" / job / name).write_text(value)
    got = {r.job: (r.ground_truth, r.transcript) for r in files.read_references(spark, str(tmp_path / "jobs")).collect()}
    assert got == {"a": ("truth", None), "b": (None, "Hello there"), "c": (None, "x")}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "sample_messages.csv").write_text("x")
    assert files.newest_file(spark, str(tmp_path / "m")).endswith("sample_messages.csv")
    (tmp_path / "m" / "old.csv").write_text("x")
    assert files.newest_file(spark, str(tmp_path / "m")).endswith("old.csv") and files.newest_file(spark, str(tmp_path / "m"), "sample_messages.csv").endswith("sample_messages.csv")


def test_whole_files_and_previews():
    table = "\n".join(f"{i},x" for i in range(400)).encode()
    assert len(files.units_of("a.csv", "table", table)[0][2].split("\n")) == 251 and len(files.units_of("a.csv", "table", table, files.WHOLE)[0][2].split("\n")) == 400
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(40):
            z.writestr(f"{i}.txt", f"t{i}")
    assert len(files.units_of("a.zip", "package", data.getvalue())) == 31 and len(files.units_of("a.zip", "package", data.getvalue(), files.WHOLE)) == 41
    (_, _, text, warning), = files.units_of("a.docx", "document", b"no package but words")
    assert text == "no package but words" and "printable" in warning
    assert files.units_of("a.psd", "fallback", b"8BPS\x00\x01layer name")[0][3].startswith("raster")
    assert files.printable(b"%!PS-Adobe\x00/Helv findfont\x00real words\x0010 20 moveto\x00") == "real words"


def test_tables_survive_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    sinks.replace(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t.before").exists()
    (tmp_path / "t").rename(tmp_path / "t.before")  # as a crash between both renames leaves it
    sinks.recover(spark, path)
    assert spark.read.parquet(path).count() == 2
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, s string, t string")
    new = spark.createDataFrame([(1, "c", "no"), (3, "d", "no")], "k long, s string, t string")
    assert sorted(map(tuple, patch(df, new, "k", ["s"]).collect())) == [(1, "c", "x"), (2, "b", "y")]
    assert [page_size(n, 200) for n in (-1, 0, 7, 900)] == [1, 1, 7, 200]
