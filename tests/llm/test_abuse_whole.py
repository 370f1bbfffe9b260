from collections import Counter

import numpy as np

from scrivener.llm.abuse import GRID, SEEDS, TOXIC_BYTES, Gauge, Model, _fit, best_threshold, labelled, select, train, windows

REMARKS = (
    "Fuck you!", "You idiot!", "I hope your whole family gets killed, you filthy rat.", "You are the dumbest clown alive and everyone hates you.",
    "All of those foreigners should be gassed.", "She spread her legs and begged him to fuck her harder.",
)


def test_remarks_of_two_families_at_any_size():
    remark = "you utterly rotten turnip head"
    for size in (20, 400):
        docs = [(i, [f"w{i}a{j} {i * 7919:x} w{i}c w{i}d{j}" for j in range(4)]) for i in range(size)]
        for i in range(0, 12):
            docs[i][1].append(remark)
        assert remark in select(docs, Counter(), Gauge(["an ordinary sentence of a report"], 1 << 16)), size


def test_examples_and_whole_windows_stay_with_many_labels():
    def remark(i):
        return f"this number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} is a foul and filthy remark about somebody {i * 7919}"

    unsafe = [(i, [remark(i), remark(i + 1)]) for i in range(4000)]
    toxic, _ = _fit(unsafe, [["an ordinary sentence of a report"]])
    assert all(s.encode() in toxic.data for s in SEEDS.splitlines()) and len(toxic.data) <= TOXIC_BYTES + 64
    small = Gauge(["first example", "second example", "third"], 22)
    assert small.data.startswith(b"second example\nthird\n")


def test_windows_of_any_length_are_measured():
    model = Model(Gauge(["fuck you. you cunt. die."], 1 << 16), Gauge(["an ordinary sentence"], 1 << 16), 0.15)
    assert model.score("Fuck you. You cunt. Die.") >= 0.15 and model.score("Yes. No. See above.") < 0.1
    assert model.score("x") < 0.15 and model.score("") == model.score(None) == -1.0 and windows("No.", 1) == ["no."]


def test_remarks_without_a_like_in_the_labels():
    plain = ["The valve is connected to the shaft by screws.", "Table 3 lists the values of the housing.", "The dye was removed by washing with water.", "A kill switch stops the pump."]
    rows = [(i, " ".join(plain[i % 4 :] + plain[: i % 4]) + f" Example {i} shows a lid of {i} mm." + (" You stupid bastard, nobody asked for your opinion." if i % 9 == 0 else ""), i % 9 == 0) for i in range(120)]
    m = train(rows)
    assert [r for r in REMARKS[1:] if m.score(r) < m.threshold] == [] and all(m.score(p) < m.threshold for p in plain)
    assert m.score(REMARKS[0]) > max(map(m.score, plain)) + 0.05  # two words save a few bytes only


def test_threshold_in_the_middle_of_the_best_stretch():
    truth = np.array([True] * 10 + [False] * 10)
    assert abs(best_threshold(np.where(truth, 0.33, 0.05), truth) - (GRID[0] + 0.32) / 2) < 0.011
    for n in (5, 500):  # the same at any size
        t = np.arange(n * 4) % 4 == 0
        assert best_threshold(np.where(t, 0.25, 0.11), t) == best_threshold(np.where(t[:4], 0.25, 0.11), t[:4])


def test_unsafe_labels_come_first(spark):
    docs = spark.range(60).selectExpr("id as doc_id", "concat('text ', id) as text", "id div 2 as family_id")
    labels = docs.selectExpr("doc_id", "case when doc_id < 6 then 'unsafe' else 'ok' end as label")
    rows = labelled(docs, labels, 20)
    assert sum(r[2] for r in rows) == 6 and len(rows) == 20 and all(r[3] == r[0] // 2 for r in rows)
