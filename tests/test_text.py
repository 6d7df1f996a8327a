import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumdf.catalog import METRICS
from vellumdf.functions import text as T
from vellumdf.functions.unicode import mtld, nfc, slug
from vellumdf.operators import evidence as E
from vellumdf.operators import metrics as M

SCHEMA = "id long, lang string, text string, unit_id long, word string"


def units(spark, *texts, lang="en"):
    df = spark.createDataFrame([(i, lang, t, 7, "x") for i, t in enumerate(texts)], SCHEMA)
    return M.units(df, "id", "lang", "text")


def values(spark, text, lang="en", **kw):
    return {r.metric: r.value for r in M.profile(units(spark, text, lang=lang), **kw).collect()}


def test_catalogue():
    assert len(METRICS) == 51 and len({m.id for m in METRICS}) == 51


def test_readability_of_a_known_text(spark):
    v = values(spark, "cat dog cat dog cat. " * 20)
    assert (v["lix"], v["rix"], v["fleschEn"], v["fkGrade"], v["wordLength"], v["hapax"]) == (5.0, 0.0, 117.16, -1.84, 3.0, 0.0)
    assert v["fleschDe"] is None


def test_null_is_never_zero(spark):
    for text in (None, "", " 12 34 ", "One short sentence."):
        rows = M.profile(units(spark, text)).collect()
        assert len(rows) == 51 and all(r.value is None and r.reason for r in rows)


def test_repeated_paragraph(spark):
    paragraph = "The small dog found old bread near that door, then slept under warm light. It stayed.\n\n"
    v = values(spark, paragraph * 10)
    assert (v["paragraphRepeat"], v["cohesion"], v["shifts"], v["rhythmLag"] is None or abs(v["rhythmLag"]) <= 1) == (90.0, 100.0, 0.0, True)


def test_groups_and_rounding(spark):
    v = {r.metric: r for r in M.profile(units(spark, "cat dog bird fish. " * 40), groups=["style"]).collect()}
    assert v["lix"].reason == "group disabled" and v["commas"].value == 0.0


def test_sentences_and_abbreviations(spark):
    text = "Er traf Dr. König 😀 heute. „Wo?“ fragte er. Z. B. am 3. Tag … ja! Ende\n\nNeu"
    got = units(spark, text).select(T.sentences(F.col("text")).alias("s")).first().s
    assert [" ".join(x.split()) for x in got] == ["Er traf Dr. König 😀 heute.", "„Wo?“", "fragte er.", "Z. B. am 3.", "Tag …", "ja!", "Ende", "Neu"]


def mattr(words, w=100):
    return 100 * sum(len(set(words[i : i + w])) for i in range(len(words) - w + 1)) / (w * (len(words) - w + 1))


def hdd(words, k=42):
    n = len(words)
    return 100 / k * sum(1 - math.comb(n - f, k) / math.comb(n, k) for f in Counter(words).values())


def test_vocabulary_against_plain_definitions(spark):
    rng = random.Random(2)
    words = [rng.choice([f"q{chr(97 + k)}" for k in range(26)]) for _ in range(260)]
    u = units(spark, " ".join(words))
    v = {r.metric: r.value for r in M.profile(u).collect()}
    n, f = len(words), Counter(words)
    assert v["mattr"] == pytest.approx(mattr(words), abs=1e-4)
    assert v["hdd"] == pytest.approx(hdd(words), abs=1e-4)
    assert v["entropy"] == pytest.approx(-sum(c / n * math.log2(c / n) for c in f.values()), abs=1e-4)
    assert v["yule"] == pytest.approx(1e4 * (sum(c * c for c in f.values()) - n) / n**2, abs=1e-4)
    last, near = {}, 0
    for i, w in enumerate(words):
        near += i - last.get(w, -99) <= 20
        last[w] = i
    assert v["nearRepeat"] == pytest.approx(100 * near / n, abs=1e-4)


def test_mtld(spark):
    seqs = [["a"] * 100, [f"w{i}" for i in range(100)], "a b a c d e a f g h a b c i j k".split(), [], None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, w array<string>")
    got = {r.id: r.m for r in df.select("id", mtld("w").alias("m")).collect()}
    back = df.select("id", mtld(F.reverse("w")).alias("m")).collect()
    assert got[0] == pytest.approx(2.0) and got[1] is None and got[3] is None and got[4] is None
    assert {r.id: r.m for r in back}[2] == pytest.approx(got[2])


def test_offsets_and_evidence(spark):
    text = "Der Hund 😀 bellt. Der alte Hund’s Napf ist leer, der Hund frisst."
    u = units(spark, text, None, "", lang="de")
    o = E.token_offsets(u).where("unit_id = 0").orderBy("start").collect()
    assert [text[r.start : r.end].lower().replace("’", "'") for r in o] == [r.word for r in o] == [m.group().lower().replace("’", "'") for m in re.finditer(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*", text)]
    hits = E.excerpts(E.shown(E.near_repeats(E.token_offsets(u))), u).collect()
    assert [(r.hit, r.before + r.hit + r.after == text) for r in hits] == [("Hund", True)]
    decided = E.with_decisions(E.near_repeats(E.token_offsets(u)), E.near_repeats(E.token_offsets(u)))
    assert [r.intentional for r in decided.collect()] == [True]


def test_pages(spark):
    e = spark.createDataFrame([(0, "m", i, i + 1) for i in range(7)], "unit_id long, metric string, start int, end int")
    assert [r.start for r in E.page(e, 99, 3).collect()] == [6]
    assert [r.start for r in E.page(e, 3, 3).collect()] == [3, 4, 5]
    assert E.page(e.limit(0), 5, 3).count() == 0


def test_forms(spark):
    df = spark.createDataFrame([("Café \r\n\r\n\r\n\r\nÄb \t\r\nx ",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(T.normalize_breaks(nfc("t")), slug("t")).collect()]
    assert got == [("Café\n\nÄb\nx", "cafe-ab-x"), (None, None), ("", "book")]


def test_phrases_keywords_cadence(spark):
    u = units(spark, "The red cat sat. The red cat ran. The red dog ran. " * 3)
    assert M.phrases(M.sentence_rows(u)).orderBy("rank").first().phrase == "the red cat"
    assert M.keywords(M.frequencies(M.tokens(u))).orderBy("rank").first().word == "red"
    c = M.cadence(M.sentence_rows(u), bins=4).orderBy("bin").collect()
    assert [(r["first"], r["last"]) for r in c] == [(1, 3), (4, 6), (7, 9)]


def test_index_of_findings(spark):
    para = "The old dog was found near a warm door, then it slept under the very same light, quietly."
    text = f"  {para}\n\n{para} The old cat ran. Dr. Bell saw the old cat.\n \nNew words, one, two, three, four, follow here because nothing else was said about any of this at all today."
    u = units(spark, text, None, "")
    e = E.index(u).collect()
    at = lambda m: sorted(text[r.start : r.end] for r in e if r.metric == m)
    assert {r.unit_id for r in e} == {0}
    assert at("sentenceRepeat") == [para] and at("paragraphRepeat") == []
    assert at("startRepeat") == ["The old", "The old"]
    assert "the old cat" in {x.lower() for x in at("trigramRepeat")} and set(at("adverbs")) == {"quietly"} and at("connectors") == ["because"]
    assert at("commaChains")[0].startswith("New words") and at("negations") == ["nothing"]
    assert all(r.start < r.end <= len(text) for r in e)
    got = E.sentence_offsets(u).where("unit_id = 0").orderBy("start").collect()
    assert [text[r.start : r.end] for r in got] == [r.body for r in got] and len(got) == 5
