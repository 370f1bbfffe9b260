import random

from scrivener.llm.abuse import labelled, normal, score, train, windows

INSULTS = ["You {a} {b}, nobody asked for your opinion.", "Go to hell, you {a} {b}.", "I hope you {b}s all choke on it, {a} people.", "Shut up and crawl away, {a} {b}."]
PLAIN = ["The {c} valve is connected to the {d} shaft by screws.", "Table {n} lists the values of the {c} housing.", "A kill switch stops the {d} pump.",
         "The filter masks words such as idiot in a {c} message.", "Damn good drawing of the {d} valve, thanks."]
A, B, C = ["stupid", "worthless", "dirty", "ugly"], ["idiot", "moron", "bastard", "fool"], ["upper", "lower", "tapered", "hollow", "annular"]


def sentence(r, forms):
    return r.choice(forms).format(a=r.choice(A), b=r.choice(B), c=r.choice(C), d=r.choice(C), n=r.randint(1, 99))


def corpus(r, n):
    out = []
    for i in range(n):
        unsafe = r.random() < 0.2
        parts = [sentence(r, PLAIN) for _ in range(8)] + [sentence(r, INSULTS)] * unsafe
        r.shuffle(parts)
        out.append((i, " ".join(parts), unsafe))
    return out


def test_held_out_accuracy():
    r = random.Random(1)
    m = train([(i, t, u if r.random() > 0.02 else not u) for i, t, u in corpus(r, 600)])
    held = corpus(r, 300)
    right = sum((m.score(t) >= m.threshold) == u for _, t, u in held)
    assert right / len(held) >= 0.97


def test_spellings():
    assert normal("You i m b e c i l e, St0p") == "you imbecile, stop" and normal("dumbаss") == "dumbass"
    assert windows("s​e​x!!! Next one. ") == ["sex!!!", "next one."] and normal("Claim 12 of 3") == "claim 0 of 0"


def test_columns(spark):
    r = random.Random(2)
    rows = corpus(r, 200) + [(900, None, False), (901, "", False), (902, "ok " * 200_000 + "Shut up and crawl away, stupid idiot.", True)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string").selectExpr("*", "1 as unsafe", "2 as label")
    labels = spark.createDataFrame([(i, "unsafe" if u else "ok") for i, _, u in rows[:200]] + [(0, None), (1, "unsure"), (None, "ok")], "doc_id long, label string")
    m = train(labelled(docs, labels))
    got = {x.doc_id: x for x in score(docs, m, ["doc_id"]).collect()}
    assert got[900].score == got[901].score == -1.0 and got[902].unsafe and not got[900].unsafe
    assert sum(got[i].unsafe == u for i, _, u in rows) >= 0.97 * len(rows)
    assert score(docs.limit(0), m, ["doc_id"]).count() == 0
    assert train([]).score("nothing here") < 1
