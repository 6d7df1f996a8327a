import datetime
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumdf.functions.display import german_number, intensity, run_id
from vellumdf.operators import reference as R
from vellumdf.operators import segmentation as SG
from vellumdf.operators import taxonomy as X
from vellumdf.operators import vectors as V
from vellumdf.sources import downloads, exports

SPECS = [X.Feature("CAT", "categorical", ("a", "b")), X.Feature("MUL", "multi_select", ("x one", "y")), X.Feature("ORD", "ordinal", ("low", "medium", "high")), X.Feature("SCL", "scale", ("1 (least)", "2", "3"))]
WIDE = "id long, CAT string, MUL string, ORD string, SCL double, source string"


def wide(spark, rows):
    return spark.createDataFrame(rows, WIDE)


def test_splits_and_coverage(spark):
    rows = spark.createDataFrame([(1, "train", "s"), (1, "train", "t"), (2, "train", "s"), (3, "val", "s"), (4, None, "s"), (None, "val", "t")], "prompt_id long, split string, source string")
    train = R.split_ids(rows.where("split = 'train'"), "train")
    assert {r.prompt_id for r in train.collect()} == {1, 2}
    with pytest.raises(ValueError):
        R.split_ids(rows, "train")
    with pytest.raises(ValueError):
        R.split_ids(rows.limit(0), "train")
    ids = R.union_ids(train, R.split_ids(rows.where("split = 'val'"), "val"))
    assert {r.prompt_id for r in ids.collect()} == {1, 2, 3}
    assert R.select_rows(rows, ids).count() == 4
    with pytest.raises(ValueError, match="1 keys"):
        R.select_rows(rows.where("prompt_id <> 3"), ids)
    c = R.coverage(rows, ids, ["s", "t", "u"]).first()
    assert tuple(c) == (9, 4, 5, 3, 0)
    assert {r.prompt_id: r.missing for r in R.missing_sources(rows, ids, ["s", "t"]).collect()} == {2: ["t"], 3: ["t"]}
    assert R.impure(rows).count() == 0 and R.impure(rows.unionByName(rows.limit(1).selectExpr("3L AS prompt_id", "'train' AS split", "source"))).first().splits == ["train", "val"]


def test_canonical_multi_scale_and_back(spark):
    df = wide(spark, [(1, "A", "X_ONE | y|y", "Low", 2.0, "s"), (2, None, '["y"]', "n/a", float("nan"), "s"), (3, "zzz", "", "high", 2.5, "s")])
    cells = X.canonical(df, "id", SPECS)
    got = {(r.id, r.feature_id): (r.canonical, r.method) for r in cells.collect()}
    assert got[1, "MUL"] == ("x one|y", "normalized_exact") and got[1, "SCL"] == ("2", "numeric_scale") and got[2, "SCL"] == ("n/a", "missing_marker")
    assert got[3, "SCL"] == ("2.5", "numeric_scale") and got[3, "CAT"] == ("zzz", "unmatched") and got[3, "MUL"] == ("", "")
    back = {r.id: tuple(r[f.id] for f in SPECS) for r in X.pivot_back(cells, "id", SPECS).collect()}
    assert back[1] == ("a", "x one|y", "low", "2") and back[2] == ("n/a", "y", "n/a", "n/a")
    bad = {(r.id, r.feature_id, r.value) for r in X.invalid(X.pivot_back(cells, "id", SPECS), "id", SPECS).collect()}
    assert bad == {(3, "CAT", "zzz"), (3, "SCL", "2.5")}
    assert X.invalid(df.drop("ORD"), "id", SPECS[2:3]).first().error == "missing feature column"
    with pytest.raises(ValueError, match="2 errors shown"):
        X.validate(X.pivot_back(cells, "id", SPECS), "id", SPECS)
    assert X.validate(df.where("id = 2"), "id", SPECS) == {"CAT": 1, "MUL": 0, "ORD": 1, "SCL": 1}


def test_build_stops_or_scales(spark, tmp_path):
    good = wide(spark, [(1, "A", "y", "low", 1.0, "s"), (2, "b", "x one", "high", 3.0, "t"), (3, "n/a", "y", "medium", 2.0, "s")])
    r = R.build(good, "id", SPECS, "source")
    assert r.manifest["rows"] == 3 and r.manifest["dimensions"] == len(r.columns) == 8 and r.manifest["changed_cells"] >= 1 and "MUL____NA__" in r.manifest["constant_columns"]
    x = np.array([row.v for row in r.rows.orderBy("id").collect()])
    assert np.allclose(x.mean(0), 0) and set(np.round(x.std(0), 6)) <= {0.0, 1.0}
    with pytest.raises(ValueError, match="1 cells of 1 rows"):
        R.build(good.unionByName(wide(spark, [(4, "zzz", "y", "low", 1.0, "s")])), "id", SPECS)
    path = str(tmp_path / "encoder.json")
    X.save_encoder(path, SPECS)
    assert X.load_encoder(path, SPECS) == X.columns(SPECS)
    with pytest.raises(ValueError, match="other features"):
        X.load_encoder(path, SPECS[:-1])


def test_feature_sets(spark):
    specs = spark.createDataFrame([("f1", "plot"), ("f2", "style"), ("f3", "plot")], "feature_id string, dimension string")
    assert {r.feature_id for r in X.resolve_set(specs, ["style"], ["f1"], 1).collect()} == {"f3"}
    for bad in ({"exclude_ids": ["nope"]}, {"exclude_ids": [], "expected": 2}, {"exclude_ids": [], "blocked": "too few"}):
        with pytest.raises(ValueError):
            X.resolve_set(specs, [], **bad)
    assert X.declared_count(specs, 3) is specs
    with pytest.raises(ValueError):
        X.declared_count(specs, 4)


def points(spark, n=40, seed=2):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    return x, spark.createDataFrame([(i, x[i].tolist(), f"g{i % 3}") for i in range(n)], "id long, v array<double>, source string")


def test_scores_and_leave_one_out(spark):
    x, df = points(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    raw = np.sort(d, 1)[:, :5].mean(1)
    got = {r.id: r for r in R.leave_one_out(df, "source", 5).collect()}
    for i in range(40):
        near = np.argsort(d[i], kind="stable")[:5]
        counts = {f"g{k}": int((near % 3 == k).sum()) for k in range(3) if (near % 3 == k).any()}
        assert got[i].raw == pytest.approx(raw[i]) and got[i].percentile == pytest.approx((raw <= raw[i] + 1e-12).mean()) and json.loads(got[i].counts) == counts
    assert R.leave_one_out(df.limit(3), "source").first().k == 2
    with pytest.raises(ValueError):
        R.leave_one_out(df.limit(1), "source")
    rar = spark.createDataFrame([(float(v),) for v in raw], "value double")
    s = {r.id: r for r in R.score(df.where("id < 4"), df, rar, 3).collect()}
    assert s[0].raw == pytest.approx(np.sort(np.append(d[0], 0))[:3].mean()) and s[0].percentile == pytest.approx((raw <= s[0].raw).mean())


def test_shared_space_and_matrix(spark):
    x, df = points(spark)
    z = (x - x.mean(0)) / x.std(0)
    series, between = R.shared_space(df, "source")
    assert {r.source: r.segments for r in series.collect()} == {"g0": 14, "g1": 13, "g2": 13}
    c = [z[np.arange(40) % 3 == k].mean(0) for k in range(3)]
    assert {(r.group_a, r.group_b): r.distance for r in between.collect()}["g0", "g2"] == pytest.approx(np.linalg.norm(c[0] - c[2]))
    with pytest.raises(ValueError):
        R.shared_space(df.limit(1), "source")
    own = {r.id: r.distances for r in R.pairwise(df, "source", "id").collect()}
    assert own[3] == pytest.approx([np.linalg.norm(x[3] - x[j]) for j in range(0, 40, 3)])
    assert R.pairwise(df.limit(0), "source", "id").count() == 0


def test_stored_matrices(spark, tmp_path):
    meta = spark.createDataFrame([(i, "s") for i in range(5)], "reference_index long, source string")
    m = np.arange(15, dtype=np.float32).reshape(5, 3)
    np.save(tmp_path / "m.npy", m)
    got = R.load_npy(spark, str(tmp_path / "m.npy"), meta, 3)
    assert {r.reference_index: r.v for r in got.collect()} == {i: m[i].tolist() for i in range(5)}
    with pytest.raises(ValueError, match="shape"):
        R.load_npy(spark, str(tmp_path / "m.npy"), meta.limit(4), 3)
    R.check_matrix(got, meta, 3, vector="v")
    with pytest.raises(ValueError):
        R.check_matrix(got, meta, 4, vector="v")


def test_guarded_joins_and_search(spark):
    seg = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "book string, id long")
    feats = spark.createDataFrame([(1, "x"), (3, "y"), (9, "z")], "id long, f string")
    assert [r.id for r in R.complete_groups(feats, seg, "book", "id").collect()] == [3]
    assert R.aligned(feats, feats.withColumnRenamed("f", "h"), "id").count() == 3
    with pytest.raises(ValueError):
        R.aligned(feats, feats.limit(2), "id")
    df = spark.createDataFrame([("Morning", None), (None, "the MORass"), (None, None)], "title string, name string")
    assert R.search(df, "mor", "title", "name").count() == 2 and R.search(df, "", "title").count() == 3


def test_files_of_a_library(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "é,\"x\"")], "a long, b string, c string")
    exports.write_plain_csv(df, str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True, schema=df.schema, escape="\\").collect()] == [tuple(df.first())]
    exports.write_jsonl(df, str(tmp_path / "j"))
    line = "".join(f.read_text() for f in (tmp_path / "j").glob("part-*")).splitlines()[0]
    assert json.loads(line) == {"a": 1, "b": None, "c": 'é,"x"'}
    (tmp_path / "s.yaml").write_text("min_words: 100\n")
    pytest.importorskip("yaml")
    assert exports.read_config(str(tmp_path / "s.yaml")) == {"min_words": 100}
    (tmp_path / "t.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        exports.read_config(str(tmp_path / "t.yaml"))


def greedy(blocks, least, target, most):
    """Segments of (words, boundary) by the plain reading of the rules: sizes between least and most, the best boundary nearest the target, a short tail mended."""
    bonus = {"chapter": 0.3 * target, "scene": 0.1 * target, "forced": -0.1 * target}
    out, at = [], 0
    while at < len(blocks):
        rest = sum(w for w, _ in blocks[at:])
        if rest <= most:
            best = None
        options, total = [], 0
        for k in range(at, len(blocks)):
            total += blocks[k][0]
            if total > most:
                break
            if total >= least:
                kind = blocks[k + 1][1] if k + 1 < len(blocks) else "chapter"
                options.append((abs(total - target) - bonus.get(kind, 0.0), abs(total - target), k + 1))
        if not options or min(options)[2] == len(blocks):
            out.append((at, len(blocks)))
            break
        best = min(options)[2]
        out.append((at, best))
        at = best
    if len(out) > 1:
        (a, m), (_, b) = out[-2:]
        size = lambda i, j: sum(w for w, _ in blocks[i:j])
        if size(m, b) < least:
            if size(a, b) <= most:
                out[-2:] = [(a, b)]
            else:
                ok = [(abs(size(a, k) - target) + abs(size(k, b) - target) - bonus.get(blocks[k][1], 0.0), abs(size(a, k) - size(k, b)), k) for k in range(a + 1, b) if least <= size(a, k) <= most and least <= size(k, b) <= most]
                if ok:
                    k = min(ok)[2]
                    out[-2:] = [(a, k), (k, b)]
    return out


def test_segment_cuts_against_the_plain_rules(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for b in range(60):
        n = int(rng.integers(1, 40))
        blocks = [(int(rng.integers(1, 60)), str(rng.choice(["chapter", "scene", "paragraph", "forced"]))) for _ in range(n)]
        rows += [(f"b{b}", i, w, k) for i, (w, k) in enumerate(blocks)]
        want[f"b{b}"] = greedy(blocks, 60, 100, 140)
    got = {}
    for r in SG.assign_segments(spark.createDataFrame(rows, "book_id string, block_no int, words int, boundary_before string"), 60, 100, 140).collect():
        got.setdefault(r.book_id, {}).setdefault(r.segment_index, []).append(r.block_no)
    for b, cuts in want.items():
        assert [(min(v), max(v) + 1) for _, v in sorted(got[b].items())] == cuts, b


def test_chapters_paragraphs_and_approval(spark):
    para = lambda k: " ".join(f"w{k}" for _ in range(70))
    s = spark.createDataFrame([("b", c, f"t{c}", "\n\n".join(para(f"{c}x{i}") for i in range(4))) for c in range(3)], "book_id string, chapter_index int, chapter_title string, content string")
    seg = SG.segments(s, 60, 100, 150, by_chapter=True)
    got = seg.orderBy("segment_index").collect()
    assert [r.segment_index for r in got] == list(range(len(got))) and all(r.chapter_index == r.chapter_end_index for r in got) and len({r.segment_id for r in got}) == len(got)
    assert SG.lost_words(s, seg).count() == 0
    ok = SG.approval(seg)
    assert SG.check_approved(seg, ok) is seg
    for bad in (None, {**ok, "segments": 1}):
        with pytest.raises(ValueError):
            SG.check_approved(seg, bad)
    t = "  One two.\n \nThree\nfour. \n\n\n\n Five"
    spans = SG.paragraph_spans(spark.createDataFrame([(1, t), (2, None), (3, " \n\n ")], "id long, t string"), "id", "t").orderBy("par").collect()
    assert [t[r.start : r.end] for r in spans] == ["One two.", "Three\nfour.", "Five"]


def test_percentiles_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(V, "BAND_ROWS", 10)
    rng = np.random.default_rng(1)
    q, r = rng.integers(0, 30, 50).astype(float), rng.integers(0, 30, 70).astype(float)
    got = V.percentiles(spark.createDataFrame([(i, float(v)) for i, v in enumerate(q)], "id int, value double"), spark.createDataFrame([(float(v),) for v in r], "value double"))
    for x in got.collect():
        assert x.right == pytest.approx((r <= x.value).mean()) and x.left == pytest.approx((r < x.value).mean())


def test_locked_downloads(tmp_path):
    (tmp_path / "a").write_bytes(b"content")
    good = hashlib.sha256(b"content").hexdigest()
    url = (tmp_path / "a").as_uri()
    out = downloads.fetch_locked(url, str(tmp_path / "d" / "b"), good)
    assert out.read_bytes() == b"content" and downloads.fetch_locked("file:///gone", str(out), good) == out
    for bad in ((url, "0" * 64, 1 << 20), (url, good, 3), ("ftp://x/y", good, 9)):
        with pytest.raises(ValueError):
            downloads.fetch_locked(bad[0], str(tmp_path / "d" / "c"), bad[1], bad[2])
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["b"]


def test_display(spark):
    df = spark.createDataFrame([(1234567.891, 0.0, 10.0), (-0.5, 1.0, 1.0), (None, 0.0, 1.0)], "v double, lo double, hi double")
    got = [tuple(r) for r in df.select(german_number("v"), intensity(F.col("v"), F.col("lo"), F.col("hi"))).collect()]
    assert got == [("1.234.567,89", 1.0), ("-0,50", 0.5), (None, None)]
    assert run_id(datetime.datetime(2026, 1, 2, 3, 4, 5, tzinfo=datetime.UTC)) == "20260102T030405Z"
