import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumdf.operators import segmentation as SG
from vellumdf.operators import tables as B
from vellumdf.sources import books, exports, markup
from vellumdf.streaming import inbox

BODY = "Some plain body words stand in this chapter for a while. " * 6


def make_epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>')
        items = '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/>'
        z.writestr("OPS/b.opf", f'<package xmlns:dc="urn:dc"><metadata><dc:title>My Book</dc:title></metadata><manifest>{items}</manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("OPS/a.xhtml", f"<html><h1>Two</h1><p>{BODY}</p><h2>Three</h2><blockquote><p>Inner &amp; text</p></blockquote></html>")
        z.writestr("OPS/b.xhtml", f"<html><head><title>t</title><style>x</style></head><nav>menu</nav><h1>One</h1><p>{BODY}</p><hr/><p>After</p></html>")
    return out.getvalue()


def make_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t, pr="": f"<w:r>{pr}<w:t>{t}</w:t></w:r>"
    big = '<w:rPr><w:b/><w:sz w:val="30"/></w:rPr>'
    doc = f'<w:document {w}><w:body><w:p><w:r><w:rPr><w:sz w:val="48"/></w:rPr><w:t>The Cover</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr>{run("First")}</w:p><w:p>{run(BODY)}</w:p><w:p>{run("Bold head", big)}</w:p><w:p>{run("More text.")}</w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", doc)
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def make_pdf(pages):
    streams = b""
    for lines in pages:
        body = b"BT " + b" ".join(b"(%s) Tj T*" % x.encode("cp1252") for x in lines) + b" ET"
        streams += b"<< /Length %d >>\nstream\n%s\nendstream\n" % (len(body), body)
    return b"%PDF-1.4\n" + streams


def test_markup():
    title, got = markup.read(make_epub(), "x.epub")
    assert title == "My Book" and [s.title for s in got] == ["One", "Two", "Three"]
    assert got[0].content.split("\n\n")[1:] == ["* * *", "After"] and got[2].content == "Inner & text" and "menu" not in got[0].content
    title, got = markup.read(make_docx(), "x.docx")
    assert title == "The Cover" and [s.title for s in got] == ["Text", "First", "Bold head"]
    title, got = markup.read("Chapter 1: Start\nText one.\n12\nPage 3 of 9\nKapitel II\nText zwei — ß.".encode("cp1252"), "y.txt")
    assert title == "y" and [(s.title, s.content) for s in got] == [("Chapter 1: Start", "Text one."), ("Kapitel II", "Text zwei — ß.")]
    pages = [["My Header", f"Line {i} " + "word " * 30, str(i)] for i in range(1, 6)]
    _, got = markup.read(make_pdf(pages), "z.pdf")
    assert "My Header" not in got[0].content and "Line 3" in got[0].content
    for bad, name in ((b"no zip", "a.epub"), (make_pdf([["few"]]), "a.pdf"), (b"", "a.rtf")):
        with pytest.raises(markup.ReadError):
            markup.read(bad, name)


def test_files_to_tables_and_stream(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "b.epub").write_bytes(make_epub())
    (box / "c.docx").write_bytes(make_docx())
    (box / "t.txt").write_text(f"Contents\nChapter 1\n{BODY}\n\n* * *\n\n{BODY}")
    (box / "bad.epub").write_bytes(b"x")
    (box / "skip.md").write_text("no")
    s = books.sections(spark, str(box)).cache()
    assert {r.source_file for r in s.collect()} == {"b.epub", "c.docx", "t.txt"}
    inv = {r.source_file: r for r in books.inventory(s).collect()}
    assert inv["b.epub"].section_count == 3 and inv["b.epub"].book_id.startswith("my-book-")
    assert [r.error.split(":")[0] for r in books.parse(books.files(spark, str(box))).where("error is not null").collect()] == ["ReadError"]
    inbox.ingest(spark, str(box), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (box / "u.txt").write_text(BODY)
    inbox.ingest(spark, str(box), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.groupBy("source_file").count().where("source_file = 'b.epub'").first()["count"] == 3 and got.where("source_file = 'u.txt'").count() == 1
    assert inbox.words_per_window(got).agg(F.sum("sections")).first()[0] == got.count()


def sections(spark, rows):
    return spark.createDataFrame([(b, c, f"T{c}", t) for b, c, t in rows], "book_id string, chapter_index int, chapter_title string, content string")


def test_segments_keep_every_word(spark):
    rng = random.Random(3)
    rows = [(b, c, "\n\n".join(" ".join(f"{b}{c}x{p}y{k}" for k in range(rng.randrange(1, 40))) + rng.choice([".", " - ", "!"]) if rng.random() < 0.9 else "* * *" for p in range(rng.randrange(1, 25)))) for b in "ab" for c in range(9)]
    s = sections(spark, rows + [("a", 50, None), ("a", 51, ""), ("c", 0, "word " * 205)])
    segs = SG.segments(s, 60, 100, 140).cache()
    assert SG.lost_words(s, segs).count() == 0
    rows = segs.orderBy("book_id", "segment_index").collect()
    assert all(r.word_count <= 140 for r in rows) and all(r.word_count >= 60 for r in rows if r.book_id != "c")
    assert [r.word_count for r in rows if r.book_id == "c"] == [140, 65] and rows[-1].boundary_start == "forced" and rows[-1].boundary_end == "book_end"
    assert SG.segments(s.limit(0), 60, 100, 140).count() == 0
    cover = SG.covering(segs, s.select("book_id", "chapter_index")).collect()
    assert all(r.segments >= 1 for r in cover)


def test_short_tail_is_shared_out(spark):
    text = lambda n: "\n\n".join(["one two three four"] * n)
    segs = SG.segments(sections(spark, [("b", 1, text(6)), ("b", 2, text(3))]), 12, 20, 24).collect()
    assert len(segs) == 2 and all(12 <= r.word_count <= 24 for r in segs)


def test_matter_hashes_and_guards(spark):
    rows = [(i, "b", "My Book", i, t, c, None) for i, (t, c) in enumerate([("Contents", "x"), ("Text", "ISBN 1"), ("My book!", "y"), (None, None), ("Danksagung", "z"), ("One", "copyright")])]
    df = spark.createDataFrame(rows, "section_id long, book_id string, book_title string, chapter_index int, chapter_title string, content string, text_sha256 string")
    assert [r.matter_class for r in B.matter(df).orderBy("section_id").collect()] == ["front", "front", "body", "body", "back", "body"]
    assert B.stale_hashes(df).count() == 5
    cells = spark.createDataFrame([("=1+1", 5, 'a "q"'), (" @x", -2, None)], "a string, b int, c string")
    assert [r.line for r in exports.csv_line(cells).collect()] == ['"\'=1+1";"5";"a ""q"""', '"\' @x";"-2";""']


def test_archive(tmp_path, spark):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.txt").write_text("hello")
    one = exports.pack(str(tmp_path / "lib"))
    assert one == exports.pack(str(tmp_path / "lib")) and exports.unpack(one) == {"a.txt": b"hello"}
    assert [exports.safe_name(n) for n in ("a/b.txt", "../a", "/a", "a\\b", "con.txt", "c:x", "a. ")] == [True, False, False, False, False, False, False]
    broken = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(one)) as z, zipfile.ZipFile(broken, "w") as w:
        for i in z.infolist():
            w.writestr(i.filename, z.read(i) + (b"!" if i.filename.endswith(".txt") else b""))
    with pytest.raises(ValueError, match="differ"):
        exports.unpack(broken.getvalue())
    df = spark.createDataFrame([(2, "b"), (1, "=x")], "id int, t string")
    exports.write_csv(df, str(tmp_path / "o.csv"), ["id"])
    assert (tmp_path / "o.csv").read_bytes().decode() == '﻿"id";"t"\r\n"1";"\'=x"\r\n"2";"b"\r\n'
