import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumdf.operators import evidence as E
from vellumdf.operators import metrics as M
from vellumdf.operators import review as R

ROWS = "g string, i int, n int, metric string, value double"


def rows(seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for g, size in (("a", 12), ("b", 4), ("c", 6), (None, 3)):
        for i in range(size):
            words = int(rng.integers(100, 900))
            for m in R.MINIMUM:
                out.append((g, i, words, m, None if rng.random() < 0.1 else float(np.round(rng.normal(20, 6), 2))))
    return out


def test_bands_and_exceptions_against_brute_force(spark):
    data = rows()
    got = {(r.g, r.i, r.metric): r for r in R.exceptions(R.chapter_bands(spark.createDataFrame(data, ROWS), "g", "i")).where("g is not null").collect()}
    assert len(got) == sum(r[0] is not None for r in data)
    seen = set()
    for g, i, n, m, v in data:
        if g is None:
            continue
        others = [x for h, j, k, o, x in data if h == g and o == m and j != i and k >= 300 and x is not None]
        r = got[g, i, m]
        assert r.others == len(others)
        if len(others) < 4:
            assert r.q25 is None and r.direction is None and not r.eligible
            continue
        lo, mid, hi = np.percentile(others, [25, 50, 75])
        assert [r.q25, r["median"], r.q75] == pytest.approx([lo, mid, hi])
        margin = max(R.MINIMUM[m], 1.5 * (hi - lo))
        want = None if v is None or n < 300 else "lower" if v < lo - margin else "higher" if v > hi + margin else None
        assert r.direction == want and r.eligible == (v is not None)
        seen.add(want)
    assert len(seen) > 1


@pytest.mark.parametrize(("metric", "minimum"), list(R.MINIMUM.items()))
def test_an_exception_needs_more_than_the_minimum(spark, metric, minimum):
    b = spark.createDataFrame([(1, 300, metric, 20.0 + minimum, 20.0, 20.0, 20.0), (2, 300, metric, 20.1 + minimum, 20.0, 20.0, 20.0), (3, 299, metric, 99.0, 20.0, 20.0, 20.0), (4, 300, metric, None, 20.0, 20.0, 20.0), (5, 300, metric, 1.0, None, None, None)], "i int, n int, metric string, value double, q25 double, median double, q75 double")
    j = R.exceptions(b)
    assert {r.i: r.direction for r in j.collect()} == {1: None, 2: "higher", 3: None, 4: None, 5: None}
    assert {r.i: r.status for r in R.consistency(j, "i").collect()} == {1: "observe", 2: "review", 3: "unknown", 4: "unknown", 5: "unknown"}
    books = R.roll_up(R.consistency(j, "i").withColumn("book", F.lit("b")), "book").first()
    assert (books.units, books.assessed, books.to_review, books.status) == (5, 2, 1, "review")


def test_priorities_one_a_group_and_open_ones_only(spark):
    f = [(1, m, False) for m in ("sentenceRepeat", "paragraphRepeat", "commaChains", "longSentences", "nearRepeat", "fillers", "shifts")] + [(1, "nearRepeat", True)]
    f += [(2, "paragraphRepeat", True), (2, "longSentences", False), (2, "fillers", False)] + [(3, "shifts", False)]
    shares = spark.createDataFrame([(1, 30.0), (2, 10.0), (3, None)], "unit_id int, share double")
    got = R.priorities(spark.createDataFrame(f, "unit_id int, metric string, intentional boolean"), shares).collect()
    assert {(r.unit_id, r["rank"]): (r.metric, r.found, r.open) for r in got} == {(1, 1): ("paragraphRepeat", 1, 1), (1, 2): ("longSentences", 1, 1), (1, 3): ("nearRepeat", 2, 1), (2, 1): ("fillers", 1, 1)}


def test_cards_and_gates(spark):
    text = "The old dog slept near a warm fire. " * 50
    u = M.units(spark.createDataFrame([(1, "en", text), (2, "en", "Short."), (3, "en", None)], "id long, lang string, t string"), "id", "lang", "t")
    doubles = E.index(u).where("metric = 'sentenceRepeat'").groupBy("unit_id").agg(F.count("*").alias("open"))
    got = {(r.unit_id, r.card): r.status for r in R.cards(R.gated(u), doubles).collect()}
    assert got[1, "repetition"] == "review" and got[1, "flow"] == "fit" and {got[k, "flow"] for k in (2, 3)} == {"unknown"}
    assert R.cards(R.gated(u), doubles.limit(0)).where("card = 'repetition' and unit_id = 1").first().status == "observe"


def test_decisions_on_another_text_are_rejected(spark):
    u = spark.createDataFrame([(1, "one text"), (2, "another")], "unit_id long, text string")
    made = u.select("unit_id", F.lit("nearRepeat").alias("metric"), F.lit(0).alias("start"), F.lit(3).alias("end"), F.sha2("text", 256).alias("text_sha256"))
    now = u.withColumn("text", F.when(F.col("unit_id") == 2, "changed").otherwise(F.col("text")))
    good = E.current_decisions(made, now)
    assert [r.unit_id for r in good.collect()] == [1]
    e = E.with_decisions(made.drop("text_sha256"), good)
    assert [r.unit_id for r in E.filtered(e, "nearRepeat", "open").collect()] == [2] and E.filtered(e, None, "intentional").count() == 1 and E.filtered(e).count() == 2
    with pytest.raises(ValueError):
        E.filtered(e, None, "closed")


def test_local_delta(spark):
    s = "unit_id int, lang string, sentenceMean double, sentenceCV double, mattr double, dialogue double"
    t = spark.createDataFrame([(1, "de", 12.5, 0.5, None, 3.0), (2, "en", 1.0, 1.0, 1.0, 1.0)], s)
    r = spark.createDataFrame([(9, "de", 10.0, 0.25, 70.0, 1.0004)], s)
    assert [tuple(x) for x in R.local_delta(t, r).collect()] == [(1, 2.5, 0.25, None, 2.0)]
