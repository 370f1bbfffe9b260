from hypothesis import given, settings
from hypothesis import strategies as st

from scrivener.llm.pieces import leaves, split, split_column

WHITE = " \t\r\n"


def check(text, limit, overlap):
    pieces = split(text, limit, overlap)
    last = 0
    for n, (a, b, _) in enumerate(pieces):
        assert b - a <= limit
        assert a >= last - overlap and (n == 0 or a <= last or not text[last:a].strip(WHITE))
        last = b
    assert not text[last:].strip(WHITE)
    assert any(f for *_, f in pieces) == any(b - a > limit for a, b, _ in leaves(text))
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.!。 \n\r\t#é", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_boundaries():
    text = "# One\n\nFirst one here. Second one here.\n\n# Two\n\nThird one here."
    assert [text[a:b] for a, b, _ in check(text, 45, 0)] == ["# One\n\nFirst one here. Second one here.", "# Two\n\nThird one here."]
    assert [text[a:b] for a, b, _ in check(text, 26, 0)] == ["# One\n\nFirst one here.", "Second one here.", "# Two\n\nThird one here."]


def test_overlap_is_exact():
    text = " ".join(f"Sentence number {i}." for i in range(60))
    pieces = check(text, 200, 20)
    cores = [b for _, b, _ in pieces]
    assert all(text[a + 20] in "S" for a, _, _ in pieces[1:]) and len(set(cores)) == len(cores)


def test_column(spark):
    long = "x" * 1000
    rows = [(1, None), (2, ""), (3, "short."), (4, long), (5, " " * 100), (6, "é. " * 40), (6, "é. " * 40)]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 as piece_no", "2 as start", "'y' as piece", "true as forced")
    out = split_column(df, ["id"], "text", 50, 10).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {4, 5, 6}
    assert all(r.forced for r in by[4]) and sum(r.stop - r.start for r in by[4]) == 1000 + 10 * (len(by[4]) - 1)
    assert [r.piece for r in by[5]] == [""] and not any(r.forced for r in by[6])
    assert split_column(df.limit(0), ["id"], "text", 50, 10).count() == 0


def test_headings_stay_with_what_follows():
    body = "".join(f"Sentence number {i} of it here. " for i in range(10)).strip()
    long = "".join(f"Another sentence number {i} here. " for i in range(40)).strip()
    text = f"# One\n\n{body}\n\n# Two\n\n## Part\n\n{long}"
    pieces = [text[a:b] for a, b, _ in check(text, 400, 40)]
    assert not any(p.rstrip().rsplit("\n", 1)[-1].startswith("#") for p in pieces)
    assert pieces[0] == f"# One\n\n{body}" and pieces[1].endswith("here.") and "# Two\n\n## Part\n\nAnother sentence number 0 here." in pieces[1]


def test_depth_of_headings_items_and_markup():
    text = "# A\n\nFirst text of it.\n\n## A1\n\nSecond text of it.\n\n## A2\n\nThird text of it.\n\n# B\n\nFourth text of it."
    assert [text[a:b] for a, b, _ in check(text, 60, 0)] == ["# A\n\nFirst text of it.\n\n## A1\n\nSecond text of it.", "## A2\n\nThird text of it.", "# B\n\nFourth text of it."]
    text = "Steps follow now.\n- one is done first.\n  - a part of one.\n  - a second part.\n- two is done next."
    assert [text[a:b] for a, b, _ in check(text, 60, 0)] == ["Steps follow now.", "- one is done first.\n  - a part of one.\n  - a second part.", "- two is done next."]
    text = "<p>First one here.</p>\n\n<p>Second. One. Here.</p>\n\n<h2>Head</h2>\n\n<p>Third one here.</p>"
    assert [text[a:b] for a, b, _ in check(text, 50, 0)] == ["<p>First one here.</p>\n\n<p>Second. One. Here.</p>", "<h2>Head</h2>\n\n<p>Third one here.</p>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# H\n\n", "## G\n\n", "- item one.\n", "  - sub.\n", "Some words here. ", "\n\n", "<p>x. y.</p>\n", "1.2 Head\n\n", "word " * 9]), max_size=40), st.integers(20, 80), st.integers(0, 9))
def test_structured_texts_are_covered(parts, limit, overlap):
    check("".join(parts), limit, overlap)
