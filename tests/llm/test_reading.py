import random
import re

import numpy as np

from vellumdf.llm import boosting, reading
from vellumdf.llm.sentences import spans

def counted(text):
    words = re.findall(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*", text)
    long = sum(sum(c.isalpha() for c in w) > 6 for w in words)
    return len(words) / len(spans([text])[0]) + 100 * long / len(words)


COMMON = "the a clerk key door lamp road tower night house found kept near under and with old new cold sister".split()
LONG = "considerable furniture grandmother observation lighthouse extraordinary merchandise".split()


def story(i, n=30):
    rng = random.Random(i)
    words = lambda: [rng.choice(LONG if rng.random() < 0.05 + i % 7 / 20 else COMMON) for _ in range(rng.randrange(5, 12 + i % 9))]
    return " ".join(" ".join(words()).capitalize() + "." for _ in range(n))


def test_counted_grade_matches_plain_count():
    texts = [story(1), story(2), story(5) + "\n\n" + "Pelgrix, 297\nNazuorth, 96, 82\nBefenpelr, 115, 246, 70"]
    f, y, ok = reading.measure(texts)
    assert ok.all()
    assert np.allclose(y[:2], [counted(t) for t in texts[:2]])
    assert abs(y[2] - counted(story(5))) < 1e-9  # the list paragraph counts nothing


def test_levels_and_who_is_graded(spark):
    rows = [(1, "a", story(3, 40), "x"), (2, "a", None, "x"), (3, "a", "", "x"), (4, "a", "Too short.", "x"), (5, "a", "猫は寝た。" * 100, "x"), (6, "b", "1 Dal ...... 9\n" * 60, "x")]
    df = spark.createDataFrame(rows, "section_id long, book_id string, content string, reading_level string")
    got = {r.section_id: r for r in reading.reading_levels(df).collect()}
    assert set(got) == {1} and got[1].reading_level == reading.level_of(got[1].predicted_grade)
    assert reading.reading_levels(df.limit(0)).count() == 0


def test_the_trees_decide(monkeypatch):
    texts = [story(i, 20 + i) for i in range(1, 40)]
    got = reading.grades(texts)
    assert all(g is not None and g[2] == reading.level_of(g[0]) for g in got)
    assert len({g[2] for g in got}) > 1
    monkeypatch.setattr(reading, "_model", lambda: {"slope": 1.0, "offset": 0.0, "stacked": boosting.stacked({"base": 99.0, "trees": []})})
    assert {g[2] for g in reading.grades(texts)} == {"hard"}  # without them every level changes


def test_the_answer_is_no_feature():
    assert not {"words_per_sentence", "long_word_share"} & set(reading.FEATURES)


def test_boosting_learns_and_generalises():
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (1500, 4))
    y = 10 * (x[:, 0] > 0.3) + x[:, 1] ** 2 * 3 + rng.normal(0, 0.1, 1500)
    m = boosting.fit(x[:1000], y[:1000])
    error = np.abs(boosting.predict(m, x[1000:]) - y[1000:])
    assert error.mean() < 0.5 and np.abs(y[1000:] - y.mean()).mean() > 4


def test_training_reports_held_out_errors():
    texts = [story(i, 25 + i % 30) for i in range(120)]
    m = reading.train(texts, [f"b{i % 12}" for i in range(120)])
    assert m["texts"] == 120 and m["sources"] == 12 and m["mean_error"] < 3
