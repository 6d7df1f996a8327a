import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vellumdf.operators import comparison as C
from vellumdf.operators import metrics as M
from vellumdf.operators import taxonomy as X
from vellumdf.operators import vectors as V

SPECS = [X.Feature("CAT", "categorical", ("a", "b")), X.Feature("BIN", "binary", ("yes", "no")), X.Feature("MUL", "multi_select", ("x", "y")), X.Feature("ORD", "ordinal", ("low", "medium", "high")), X.Feature("SCL", "scale", ("1", "2", "3"))]
WIDE = "id long, CAT string, BIN string, MUL string, ORD string, SCL string"


def vec(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in np.atleast_1d(r)], str(i % 3)) for i, r in enumerate(x)], "id long, v array<double>, tag string")


def test_knn_against_brute_force(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(200, 5))
    df = vec(spark, x)
    monkeypatch.setattr(V, "MAX_QUERY_BYTES", 40 * 20)  # several blocks of queries
    got = V.knn(df.where("id % 4 = 0"), df, 7, "tag")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(0, 200, 4) for j in np.argsort(d[i])[:7]}
    assert {(r.query_id, r.neighbor_id) for r in got.collect()} == want
    raw = {r.query_id: r.raw for r in V.rarity(got).collect()}
    assert raw[8] == pytest.approx(np.sort(d[8])[:7].mean())


def test_knn_on_a_line(spark):
    df = vec(spark, np.arange(30))
    near = V.knn(df.where("id = 0"), df, 25).agg(F.avg("distance")).first()[0]
    assert near == pytest.approx(13.0)


def test_percentiles_and_ties(spark):
    ref = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 4.0)], "value double")
    q = spark.createDataFrame([(0, 0.0), (1, 2.0), (2, 5.0)], "id int, value double")
    got = {r.id: (r.right, r.left, r.mid) for r in V.percentiles(q, ref).collect()}
    assert got == {0: (0.0, 0.0, 0.0), 1: (0.75, 0.25, 0.5), 2: (1.0, 1.0, 1.0)}
    x = np.random.default_rng(2).integers(0, 50, 3000).astype(float)
    r = V.percentiles(spark.createDataFrame([(float(v),) for v in range(50)], "value double"), spark.createDataFrame([(v,) for v in x.tolist()], "value double")).collect()
    assert all(row.right == pytest.approx((x <= row.value).mean()) and row.left == pytest.approx((x < row.value).mean()) for row in r)


def test_scaling_is_fitted_on_the_reference_only(spark):
    fit = V.scale_fit(vec(spark, [[1, 7], [2, 7], [1, 7]]))
    got = V.scale(vec(spark, [[5, 8]]), fit).first().v
    assert got == pytest.approx([(5 - 4 / 3) / np.std([1, 2, 1]), 1.0])


def test_centroids(spark):
    df = vec(spark, [[0, 0], [3, 4], [9, 9], [0, 0], [3, 4]])
    got = {(r.group_a, r.group_b): r.distance for r in V.centroid_distances(df, "tag").collect()}
    assert got["0", "1"] == pytest.approx(5.0) and len(got) == 3


def test_peer_bands(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, float(v)) for g, n in (("a", 9), ("b", 3), ("c", 5)) for i, v in enumerate(rng.integers(0, 6, n))]
    got = C.peer_bands(spark.createDataFrame([*rows, ("a", 99, None)], "g string, i int, v double"), "g", "i", "v").collect()
    for r in got:
        others = [v for g, i, v in rows if g == r.g and i != r.i]
        if len(others) < 4:
            assert r.q25 is None
        else:
            assert [r.q25, r["median"], r.q75] == pytest.approx(list(np.percentile(others, [25, 50, 75])))


def test_windows_and_deltas(spark):
    tok = spark.createDataFrame([(1, i, f"w{i}") for i in range(450)] + [(2, i, "x") for i in range(30)], "unit_id int, pos int, word string")
    assert [(r.start, r.words) for r in C.matched_windows(tok, 100).orderBy("window").collect()] == [(0, 100), (117, 100), (233, 100), (350, 100)]
    assert [r.start for r in C.matched_windows(tok, 300).collect()] == [75]
    p = spark.createDataFrame([(1, "de", "lix", 5.0, None), (1, "de", "rix", None, "short")], "unit_id int, lang string, metric string, value double, reason string")
    r = spark.createDataFrame([(2, "de", "lix", 3.5, None), (2, "de", "rix", 1.0, None)], p.schema)
    assert {x.metric: (x.delta, x.reason) for x in C.deltas(p, r).collect()} == {"lix": (1.5, None), "rix": (None, "short")}
    assert C.deltas(p, r.withColumn("lang", F.lit("en"))).where("delta is not null").count() == 0


def test_encoding(spark):
    df = spark.createDataFrame([(1, "a", "yes", "x|y", "low", "1"), (2, "b", "no", '["y"]', "high", "3"), (3, "n/a", None, "NA", " na ", "__na__")], WIDE)
    got = {r.id: r.e for r in df.select("id", X.encode(SPECS).alias("e")).collect()}
    assert len(X.columns(SPECS)) == 11
    assert got == {1: [1, 0, 0, 1, 0, 0, 1, 1, 0, 0, 1], 2: [0, 1, 0, 0, 1, 0, 0, 1, 0, 2, 3], 3: [0, 0, 1, 0, 0, 1, 0, 0, 1, -1, -1]}
    with pytest.raises(PySparkException, match="unknown value"):
        spark.createDataFrame([(1, "zzz", "yes", "x", "low", "1")], WIDE).select(X.encode(SPECS)).collect()


def test_canonical_values(spark):
    specs = [X.Feature("f", "categorical", ("Low Level", "2 Medium (some)", "high", "red green blue"))]
    df = spark.createDataFrame(list(enumerate(["low_level", "2 whatever", "highest", "green blue", "zzz", None, "n/a"])), "id long, f string")
    got = {r.id: (r.canonical, r.method) for r in X.canonical(df, "id", specs).collect()}
    assert got == {0: ("Low Level", "normalized_exact"), 1: ("2 Medium (some)", "numeric_prefix"), 2: ("high", "prefix"), 3: ("red green blue", "token_overlap"), 4: ("zzz", "unmatched"), 5: ("n/a", "missing_marker"), 6: ("n/a", "missing_marker")}
    assert {(r.id, r.value) for r in X.invalid(df, "id", specs).collect()} == {(0, "low_level"), (1, "2 whatever"), (2, "highest"), (3, "green blue"), (4, "zzz")}


def test_taxonomy_is_flattened(spark):
    nested = spark.createDataFrame([([("plot", [([("f1", "binary", ["yes", "no"])],), ([("f2", "scale", ["1"])],)])],)], "dimensions array<struct<name:string,aspects:array<struct<features:array<struct<id:string,type:string,values:array<string>>>>>>>")
    flat = X.flatten(nested)
    assert [f.id for f in X.features(flat)] == ["f1", "f2"]
    assert [r.feature_id for r in X.resolve_set(flat, [], ["f1"]).collect()] == ["f2"]
