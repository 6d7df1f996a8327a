from datetime import datetime

from vellumdf.llm import pieces

SCHEMA = "block_id long, book_id string, block_no long, chapter_index int, text string, boundary_before string, loaded_at timestamp, start string, span string, size string"
T0, T1 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def sentence(i):
    return f"The clerk number {i} found the old key behind the door and kept it. "


def chapter(spark, blocks, **kw):
    df = frame(spark, [(i, "b", i, 1, t, "paragraph", T0) for i, t in enumerate(blocks)])
    return pieces.chapter_pieces(df, **kw).orderBy("piece_start").collect()


def check(got, text, limit, overlap):
    assert "".join(r.piece[r.overlap :] for r in got) == text
    at = 0
    for r in got:
        assert len(r.piece) <= limit and r.piece_start == at and r.piece == text[r.piece_start - r.overlap : r.piece_end]
        assert r.overlap == min(overlap, r.piece_start) or r.overlap == limit - (r.piece_end - r.piece_start)
        at = r.piece_end


def test_between_inside_forced(spark):
    short = ["".join(sentence(k) for k in range(i, i + 12)) for i in range(12)]
    got = chapter(spark, short)
    check(got, "".join(short), 4000, 200)
    assert {r.cut_kind for r in got[:-1]} == {"between"}
    long = ["".join(map(sentence, range(100)))]
    got = chapter(spark, long)
    check(got, long[0], 4000, 200)
    assert "inside" in {r.cut_kind for r in got} and "forced" not in {r.cut_kind for r in got}
    endless = ["word " * 2000]
    got = chapter(spark, endless)
    check(got, endless[0], 4000, 200)
    assert "forced" in {r.cut_kind for r in got}


def test_whole_blocks_up_to_the_limit(spark):
    blocks = [("a" * 79 + " ") * 50, ("b" * 79 + " ") * 50]
    got = chapter(spark, blocks)
    check(got, "".join(blocks), 4000, 200)
    assert [r.cut_kind for r in got][0] == "between" and len(got) == 2


def test_long_chapters_are_cut_as_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOW", 6)
    blocks = ["".join(sentence(k * k % 97) for k in range(i, i + 1 + i * 7 % 20)) for i in range(90)]
    text = "".join(blocks)
    got = chapter(spark, blocks, limit=1000, overlap=300)
    check(got, text, 1000, 300)
    assert len({r.window for r in got}) > 5 and {r.cut_kind for r in got[:-1]} <= set(pieces.KINDS) and got[-1].cut_kind == ""
    # the same by hand over the whole text at once
    starts = [sum(map(len, blocks[:i])) for i in range(len(blocks))]
    edges = pieces.boundaries([(a, t, "paragraph") for a, t in zip(starts, blocks)], 1000, 300)
    anchors = [pieces.anchor(text, 0, edges, k * 6000, 3000)[0] for k in range(1, len(text) // 6000 + 1) if k * 6000 + 3000 <= len(text)]
    stops = [0, *anchors, len(text)]
    want = [x[1] for a, b in zip(stops, stops[1:]) for x in pieces.cut_part(text, 0, edges, a, b, 1000, 300)]
    assert [r.piece_end for r in got] == want


def test_rows_without_a_number_are_blocks_of_their_own(spark):
    rows = [(i, "b", None, 1, sentence(i) * 20, None, T0) for i in range(5)] + [(9, "b", 1, 1, "end", None, T0)]
    got = pieces.chapter_pieces(frame(spark, rows)).agg({"piece_end": "max"}).first()[0]
    assert got == sum(len(sentence(i) * 20) for i in range(5)) + 3


def test_redelivery_nulls_and_small_chapters(spark):
    t = sentence(1) * 40
    rows = [(1, "b", 1, 1, t, None, T0), (2, "b", 1, 1, t, None, T1), (3, "b", 2, 1, t, "scene", T0), (3, "b", 2, 1, t, "scene", T0), (4, "b", 3, 1, None, None, None), (5, "c", 1, None, "short", None, None), (6, None, 1, 1, "x" * 4001, None, None)]
    df = frame(spark, rows)
    got = pieces.chapter_pieces(df)
    assert got.where("book_id = 'b'").agg({"piece_end": "max"}).first()[0] == 2 * len(t)
    found = {tuple(r) for r in pieces.chapter_cuts(got).collect()}
    assert found == {("b", 1, "between"), (None, 1, "forced")}
    assert pieces.chapter_pieces(df.limit(0)).count() == 0


def test_cuts_at_the_change_of_topic(spark):
    sea = "The ship and the sailor and the harbor and the anchor and the wave. "
    wood = "A tree with a leaf near a root under a branch of a forest. "
    blocks = [sea * 4] * 4 + [wood * 4] * 8
    got = chapter(spark, blocks, limit=1800, overlap=100)
    assert len(sea) * 16 in {r.piece_end for r in got}
