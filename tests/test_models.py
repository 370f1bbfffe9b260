from scrivener import models


class Fake:
    def read(self, images):
        return [(i.decode(), 0.5) for i in images]

    def transcribe(self, recordings):
        return [[(-1.0, -2.0, "hi", 1.5)] for _ in recordings]

    def translate(self, texts, target):
        return [f"{target}:{t}" for t in texts]

    def embed(self, texts):
        return [[len(t), 1] for t in texts]

    def answer(self, requests):
        return [f'Sure {{"status": "{r}"}} ok' for r in requests]


def test_models(spark):
    df = spark.createDataFrame([(1, b"a", "x"), (2, None, None), (3, b"c", "Satisfied")], "k int, image binary, t string")
    read = {r.k: (r.text, r.confidence_score) for r in models.recognised(df, "image", Fake).collect()}
    assert read == {1: ("a", 0.5), 2: (None, None), 3: ("c", 0.5)}
    s = models.transcribed(df, "image", Fake).where("k = 1").first().segments[0]
    assert (s.start, s.end, s.text, s.confidence) == (0.0, 0.0, "hi", 1.0)
    assert [r.translation for r in models.translated(df, "t", "de", Fake).orderBy("k").collect()] == ["de:x", None, "de:Satisfied"]
    assert [r.embedding for r in models.embedded(df, "t", Fake).orderBy("k").collect()] == [[1.0, 1.0], None, [9.0, 1.0]]
    assert [r.status for r in models.judged(df, "t", Fake).orderBy("k").collect()] == ["Not Satisfied", None, "Satisfied"]
