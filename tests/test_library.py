import json
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vellumdf.operators import comparison as C
from vellumdf.operators import evidence as E
from vellumdf.operators import library as Y
from vellumdf.operators import metrics as M
from vellumdf.operators import review as R
from vellumdf.operators.taxonomy import Feature
from vellumdf.plans.library_queries import QUERIES


def test_settings():
    assert Y.Settings.of({"language": "en", "groups": ("style",)}).language == "en"
    for bad in ({"language": "fr"}, {"min_words": 50}, {"min_words": 900, "target_words": 800}, {"long_sentence": 14}, {"parallel": 0}, {"groups": ("x",)}, {"long_share": True}, {"exclude_front": 1}, {"model": "a b"}, {"colour": 1}):
        with pytest.raises(ValueError):
            Y.Settings.of(bad)


def test_uploads(spark):
    df = spark.createDataFrame([("a.TXT", "aGVsbG8="), ("a.exe", "aGVsbG8="), ("b.epub", "?"), (None, "aGVsbG8=")], "name string, data string")
    got = [(r.name, bytes(r.content) if r.content else None, r.error) for r in Y.uploads(df).collect()]
    assert got == [("a.TXT", b"hello", None), ("a.exe", None, "unsupported file"), ("b.epub", None, "not base64"), (None, None, "unsupported file")]


SPECS = [Feature("f1", "binary", ("yes", "no")), Feature("f2", "scale", ("1", "2"))]


def test_feature_files(spark, tmp_path):
    def put(name, prompt, **features):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "x.features.json").write_text(json.dumps({"prompt_id": prompt, "story_title": "s", "features": features}))

    segments = spark.createDataFrame([(1, "s1", "b", 0), (2, "s2", "b", 1)], "prompt_id long, segment_id string, book_id string, segment_index int")
    put("a", 1, f1="yes", f2="2")
    put("b", 2, f1="no", f2="1")
    got = Y.compile_features(Y.feature_files(spark, f"{tmp_path}/*/*.features.json"), segments, SPECS).orderBy("prompt_id").collect()
    assert [(r.segment_id, r.f1, r.f2) for r in got] == [("s1", "yes", "2"), ("s2", "no", "1")]
    put("c", 9, f1="no", f2="1")
    with pytest.raises(PySparkException, match="unknown prompt 9"):
        Y.compile_features(Y.feature_files(spark, f"{tmp_path}/c/*.features.json"), segments, SPECS).collect()
    put("c", 2, f1="no")
    with pytest.raises(PySparkException, match="other features"):
        Y.compile_features(Y.feature_files(spark, f"{tmp_path}/c/*.features.json"), segments, SPECS).collect()
    assert Y.response_schema(SPECS)["required"] == ["f1", "f2"]


def test_axes(spark):
    df = spark.createDataFrame([("low", "2_mid", "mixed"), ("high", "5", "other"), ("n/a", "9", None), (None, None, "zzz")], "o string, s string, m string")
    o = Y.axis(F.col("o"), Feature("o", "ordinal", ("low", "medium", "high")))
    s = Y.axis(F.col("s"), Feature("s", "scale", ("1_low", "2_mid", "5_high")))
    m = Y.axis(F.col("m"), Feature("m", "categorical", ("mixed", "other")), mark="mixed")
    assert [tuple(r) for r in df.select(o, s, m).collect()] == [(0.0, 25.0, 100.0), (100.0, 100.0, 0.0), (None, None, None), (None, None, None)]


def test_spans_cover_the_text(spark):
    text = "  One 2 three.\n\nFour — five’s six! 7 "
    full = spark.createDataFrame([("b", text)], "book_id string, text string")
    seg = spark.createDataFrame([("b", 0, 3), ("b", 1, 1), ("b", 2, 3)], "book_id string, segment_index int, word_count int")
    got = Y.segment_spans(full, seg).orderBy("segment_index").collect()
    parts = [text[r.start : r.end] for r in got]
    assert "".join(parts) == text and [len(re.findall(r"[^\W_]+(?:[’'-][^\W_]+)*", p)) for p in parts] == [3, 1, 3]


def test_pilot(spark):
    seg = spark.createDataFrame([("a", i, w) for i, w in enumerate([5, 9, 1, 7, 8, 3])] + [("b", 0, 4)], "book_id string, segment_index int, word_count int")
    got = {(r.book_id, r.segment_index) for r in Y.pilot(seg, 6).collect()}
    assert got == {("a", 0), ("a", 3), ("a", 5), ("a", 2), ("a", 1), ("b", 0)}
    assert Y.pilot(seg, 100).count() == 7


def test_blocked_reasons(spark):
    schema = "document_id string, text_sha256 string, segments int, feature_set string, model string, effort string, language string, taxonomy string"
    base = ("b", "hb", 5, "f", "m", "low", "de", "t")
    rows = [("x", "hx", 0, *base[3:]), ("b", "hx", 3, *base[3:]), ("x", "hb", 3, *base[3:]), ("x", "hx", 3, "f", "n", "low", "en", "t"), ("x", "hx", 3, "f", "m", "low", "en", "t"), ("x", "hx", 3, *base[3:])]
    t, b = spark.createDataFrame(rows, schema).alias("t"), spark.createDataFrame([base], schema).alias("b")
    assert [r[0] for r in t.join(b, F.lit(True)).select(Y.blocked()).collect()] == ["no features", "own text", "own text", "other model", "other language", None]


def test_gate_and_distance(spark):
    s = spark.createDataFrame([("human", 0.7), ("human", 0.74), ("gpt", 0.5), ("kimi", 0.44)], "source string, percentile double")
    assert Y.quality_gate(s, 958, 0).first().status == "exact"
    assert Y.quality_gate(s, 958, 1).first().status == Y.quality_gate(s, 979, 0).first().status == "reconstruction"
    assert Y.quality_gate(s.limit(0), 958, 0).first().within_tolerance is False
    b = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate((1, 2, 1))], "id long, v array<double>")
    t = spark.createDataFrame([("d", 9, [5.0])], "doc string, id long, v array<double>")
    sd = (sum((x - 4 / 3) ** 2 for x in (1, 2, 1)) / 3) ** 0.5
    assert Y.baseline_distance(t, b).first().distance == pytest.approx((4 + 3 + 4) / 3 / sd)
    vec = spark.createDataFrame([(0, [0.0]), (0, [2.0]), (1, [5.0]), (2, [9.0])], "chapter_index int, v array<double>")
    cover = spark.createDataFrame([(0, True), (1, True), (2, False)], "chapter_index int, all_inside boolean")
    assert [tuple(r) for r in Y.chapter_distances(vec, cover).collect()] == [(0, 1, 4.0)]


def test_every_group_has_a_distance(spark, tmp_path):
    rows = [(i, i % 10, [float((i * (3 + k) + k * k) % 17) for k in range(64)]) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.doc: r.distance for r in QUERIES["baseline_distances"](spark, str(tmp_path)).collect()}
    x, label = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    base = x[label == 0]
    z = (x - base.mean(0)) / np.where(base.std(0) == 0, 1, base.std(0))
    near = lambda v: np.sort(np.sqrt(((z[label == 0] - v) ** 2).sum(1)))[:25].mean()
    assert got == {str(k): pytest.approx(np.mean([near(v) for v in z[label == k]]), abs=2e-5) for k in range(1, 10)}


def test_windows_as_long_as_the_target(spark):
    words = [f"q{chr(97 + (i * i + i // 7) % 19)}{chr(97 + i % 11)}" for i in range(500)]
    text = " ".join(words) + "."
    rows = [(1, "de", text), (2, "de", " ".join(words[:120]) + "."), (3, "de", "zu kurz. " + " ".join(words) + " mehr."), (4, "en", "No reference. " * 60)]
    u = M.units(spark.createDataFrame(rows, "id long, lang string, t string"), "id", "lang", "t")
    g = R.gated(u).cache()
    ref = u.where("unit_id = 1")
    w = R.window_units(g.where("metric = 'lix'").select("unit_id", "lang", "n"), ref)
    assert {r.unit_id for r in w.collect()} == {"1/0", "2/0", "2/1", "2/2", "2/3"}
    got = {(r.unit_id, r.metric): r for r in R.compare(g, g.where("unit_id = 1"), R.gated(w)).collect()}
    starts = [round(i * (500 - 120) / 3) for i in range(4)]
    types = sorted(100 * len([x for x in set(words[s : s + 120]) if words[s : s + 120].count(x) == 1]) / len(set(words[s : s + 120])) for s in starts)
    assert got[2, "hapax"].windows == 4 and got[2, "hapax"].reference == pytest.approx((types[1] + types[2]) / 2, abs=1e-3)
    assert got[1, "lix"].delta == 0 and got[3, "entropy"].reference is None and got[3, "entropy"].reason == "reference is shorter" and got[3, "lix"].delta is not None
    assert not any(k[0] == 4 for k in got)
    old = {r.metric: r for r in R.compare(g.where("unit_id = 2"), g.where("unit_id = 1"), R.gated(w), F.lit(True)).collect()}
    assert all(old[m].reference is None and old[m].q25 is None for m in R.STRUCTURAL) and old["hapax"].delta is not None


def test_progression_and_preview(spark):
    v = spark.createDataFrame([("b", i, "m", x) for i, x in enumerate((1.0, 2.5, 2.0))], "book_id string, segment_index int, metric string, value double")
    assert [r.change for r in Y.progression(v).orderBy("segment_index").collect()] == [None, 1.5, -0.5]
    seg = spark.createDataFrame([("b", 0, 10), ("b", 1, 30)], "book_id string, segment_index int, word_count int")
    assert "| b | 2 | 40 | 10 | 30 |" in Y.preview(seg)
    assert Y.dimension(spark).count() == 51
