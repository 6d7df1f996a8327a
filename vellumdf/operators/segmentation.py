"""Blocks, segments, and the proof that no text is lost.

Paragraphs become blocks with native expressions.  The greedy cut along the
reading order needs only the sizes of blocks, a window of ``max_words`` at a
time, so books stream through it row by row; texts are put together afterwards,
one bounded group a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# How much a boundary is preferred, as a share of the target size.
BONUS = {"chapter": 0.30, "scene": 0.10, "paragraph": 0.0, "forced": -0.10}
SCENE = r"^\s*(?:\*\s*){3,}$|^\s*(?:#\s*){3,}$|^\s*[-—]\s*[-—]\s*[-—]\s*$"


def blocks(sections: DataFrame, max_words: int) -> DataFrame:
    """book_id, chapter_index, block_no (in the book), text, words, boundary_before.

    sections: book_id, chapter_index, chapter_title, content.  Scene marks are
    taken out and mark the next paragraph; a paragraph over ``max_words`` is cut
    into slices of that many words, marked forced.
    """
    para = sections.select("book_id", "chapter_index", "chapter_title", F.posexplode(F.split(F.coalesce("content", F.lit("")), T.PARAGRAPH_BREAK)).alias("par", "raw"))
    para = para.withColumn("text", F.regexp_replace(F.regexp_replace("raw", rf"^{T.WS}+", ""), rf"{T.WS}+\z", "")).where(F.length("text") > 0)
    order = Window.partitionBy("book_id", "chapter_index").orderBy("par")
    scene = F.col("text").rlike(SCENE)
    marked = para.withColumn("is_scene", scene).withColumn("after_scene", F.coalesce(F.lag("is_scene").over(order), F.lit(False))).where(~F.col("is_scene"))
    first = F.row_number().over(order) == 1
    marked = marked.withColumn("boundary", F.when(first, "chapter").when(F.col("after_scene"), "scene").otherwise("paragraph"))
    # a slice holds whole words and what stands behind them up to the next word
    units = F.regexp_extract_all("text", F.lit(rf"(?:^[^\p{{L}}\p{{N}}]*)?{T.IMPORT_WORD}[^\p{{L}}\p{{N}}]*"), F.lit(0))
    n = T.word_count(F.col("text"), T.IMPORT_WORD)
    # only a paragraph over the limit is taken apart
    pieces = F.when(n > max_words, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / max_words).cast("int")), lambda i: F.array_join(F.slice(units, i * max_words + 1, max_words), ""))).otherwise(F.array("text"))
    cut = marked.select("book_id", "chapter_index", "chapter_title", "par", "boundary", F.posexplode(pieces).alias("piece", "t"))
    # numbers within a chapter, and the blocks of the chapters before it: no task sorts the texts of a whole book
    inner = F.row_number().over(Window.partitionBy("book_id", "chapter_index").orderBy("par", "piece"))
    sizes = cut.groupBy("book_id", "chapter_index").agg(F.count("*").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("book_id").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select(F.col("book_id").alias("b"), F.col("chapter_index").alias("c"), before.alias("base"))
    text = F.regexp_replace("t", rf"{T.WS}+\z", "")
    numbered = cut.withColumn("no", inner).join(base, F.col("book_id").eqNullSafe(F.col("b")) & F.col("chapter_index").eqNullSafe(F.col("c")))
    return numbered.select(
        "book_id", "chapter_index", "chapter_title", (F.col("base") + F.col("no") - 1).cast("int").alias("block_no"), text.alias("text"), T.word_count(text, T.IMPORT_WORD).alias("words"), F.when(F.col("piece") > 0, "forced").otherwise(F.col("boundary")).alias("boundary_before")
    )


class _Cutter:
    """Cuts one book while its blocks stream by; holds at most the open range and the one before it."""

    def __init__(self, least: int, target: int, most: int):
        self.least, self.target, self.most = least, target, most
        self.before: list[tuple[int, int, str]] = []
        self.open: list[tuple[int, int, str]] = []
        self.done = 0

    def bonus(self, kind: str) -> float:
        return BONUS.get(kind, 0.0) * self.target

    def _best(self, following: str) -> int | None:
        total, best = 0, None
        for i, (_, words, _) in enumerate(self.open):
            total += words
            if total > self.most:
                break
            if total >= self.least:
                kind = self.open[i + 1][2] if i + 1 < len(self.open) else following
                score = (abs(total - self.target) - self.bonus(kind), abs(total - self.target), i + 1)
                best = min(best or score, score)
        return best[2] if best else None

    def _close(self, k: int) -> Iterator[tuple[int, int]]:
        yield from self._flush()
        self.before, self.open = self.open[:k], self.open[k:]

    def _flush(self) -> Iterator[tuple[int, int]]:
        if self.before:
            yield from ((no, self.done) for no, _, _ in self.before)
            self.done += 1
            self.before = []

    def add(self, no: int, words: int, kind: str) -> Iterator[tuple[int, int]]:
        self.open.append((no, words, kind))
        # the choice stands once the next block would burst the range
        while sum(w for _, w, _ in self.open) > self.most and (k := self._best(kind)) is not None:
            yield from self._close(k)

    def finish(self) -> Iterator[tuple[int, int]]:
        while self.open:
            k = self._best("chapter")
            if k is None or k == len(self.open):
                break
            yield from self._close(k)
        words = lambda xs: sum(w for _, w, _ in xs)
        if self.before and self.open and words(self.open) < self.least:
            both = self.before + self.open
            if words(both) <= self.most:
                self.before, self.open = both, []
            else:
                best = None
                for k in range(1, len(both)):
                    a, b = words(both[:k]), words(both[k:])
                    if self.least <= a <= self.most and self.least <= b <= self.most:
                        score = (abs(a - self.target) + abs(b - self.target) - self.bonus(both[k][2]), abs(a - b), k)
                        best = min(best or score, score)
                if best:
                    self.before, self.open = both[: best[2]], both[best[2] :]
        yield from self._flush()
        self.before, self.open = self.open, []
        yield from self._flush()


def assign_segments(b: DataFrame, least: int, target: int, most: int) -> DataFrame:
    """book_id, block_no, segment_index."""
    if not 0 < least <= target <= most:
        raise ValueError("sizes must satisfy 0 < least <= target <= most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(book: str | None, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([book] * len(pairs), pa.string()), pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32())], names=["book_id", "block_no", "segment_index"])

        book: str | None = None
        cutter: _Cutter | None = None
        for batch in batches:
            pending: list[tuple[int, int]] = []
            for bk, no, words, kind in zip(*(batch.column(c).to_pylist() for c in ("book_id", "block_no", "words", "boundary_before")), strict=True):
                if cutter is None or bk != book:
                    if cutter is not None:
                        yield out(book, pending + list(cutter.finish()))
                        pending = []
                    book, cutter = bk, _Cutter(least, target, most)
                pending += cutter.add(no, words, kind)
            if pending:
                yield out(book, pending)
        if cutter is not None:
            yield out(book, list(cutter.finish()))

    narrow = b.select("book_id", "block_no", "words", "boundary_before").repartition("book_id").sortWithinPartitions("book_id", "block_no")
    return narrow.mapInArrow(run, "book_id string, block_no int, segment_index int")


def segments(sections: DataFrame, least: int = 3000, target: int = 5000, most: int = 7000, by_chapter: bool = False) -> DataFrame:
    """One row a segment: book_id, segment_index, segment_id, text, word_count, text_sha256, chapters, boundaries.

    ``by_chapter``: no segment goes beyond its chapter; the segments of a book are numbered through.
    """
    b = blocks(sections, most)
    if by_chapter:
        part = F.concat_ws("\u0003", F.coalesce("book_id", F.lit("")), F.col("chapter_index").cast("string"))
        own = assign_segments(b.withColumn("book_id", part), least, target, most).withColumnRenamed("book_id", "part").withColumnRenamed("segment_index", "local")
        j = b.withColumn("part", part).join(own, ["part", "block_no"])
        j = j.withColumn("segment_index", F.dense_rank().over(Window.partitionBy("book_id").orderBy("chapter_index", "local")) - 1).drop("part", "local")
    else:
        j = b.join(assign_segments(b, least, target, most), ["book_id", "block_no"])
    parts = F.sort_array(F.collect_list(F.struct("block_no", "text", "chapter_title", "boundary_before")))
    g = j.groupBy("book_id", "segment_index").agg(parts.alias("p"), F.min("chapter_index").alias("chapter_index"), F.max("chapter_index").alias("chapter_end_index"))
    text = T.normalize_breaks(F.array_join(F.col("p.text"), "\n\n"))
    g = g.withColumn("text", text).withColumn("text_sha256", F.sha2("text", 256))
    sid = F.concat(F.col("book_id"), F.lit("-s"), F.lpad(F.col("segment_index") + 1, 4, "0"), F.lit("-"), F.substring("text_sha256", 1, 12))
    after = F.lead(F.col("p")[0]["boundary_before"]).over(Window.partitionBy("book_id").orderBy("segment_index"))
    return g.select(
        "book_id", "segment_index", sid.alias("segment_id"), "text", T.word_count(F.col("text"), T.IMPORT_WORD).alias("word_count"), "text_sha256", "chapter_index", "chapter_end_index",
        F.array_join(F.array_distinct(F.col("p.chapter_title")), " | ").alias("chapter_title"), F.col("p")[0]["boundary_before"].alias("boundary_start"), F.coalesce(after, F.lit("book_end")).alias("boundary_end"),
    )


def _word_places(df: DataFrame, book: str, order: str, text: str) -> DataFrame:
    """book, place, word: all words of a book in reading order.  Counts are summed first, so only numbers are sorted a book."""
    n = T.word_count(F.col(text), T.IMPORT_WORD)
    base = F.coalesce(F.sum(n).over(Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = df.select(F.col(book).alias("book_id"), base.alias("base"), F.regexp_extract_all(text, F.lit(T.IMPORT_WORD), F.lit(0)).alias("w"))
    return w.select("book_id", "base", F.posexplode("w").alias("i", "word")).select("book_id", (F.col("base") + F.col("i")).alias("place"), "word")


def _compared(sections: DataFrame, segs: DataFrame) -> DataFrame:
    """book_id, place, expected, actual of every word of both sides.  Scene marks hold no words, so all content counts."""
    a = _word_places(sections.where(F.col("content").isNotNull()), "book_id", "chapter_index", "content").withColumnRenamed("word", "expected")
    b = _word_places(segs, "book_id", "segment_index", "text").withColumnRenamed("word", "actual")
    return a.join(b, ["book_id", "place"], "full")


def lost_words(sections: DataFrame, segs: DataFrame) -> DataFrame:
    """book_id, place, expected, actual: words at which sections and segments differ; empty if nothing is lost."""
    return _compared(sections, segs).where(~F.col("expected").eqNullSafe(F.col("actual")))


def loss_report(sections: DataFrame, segs: DataFrame) -> DataFrame:
    """book_id, words, letters, lost: words compared place by place, the letters of those of the segments, and how many differ."""
    differ = ~F.col("expected").eqNullSafe(F.col("actual"))
    return _compared(sections, segs).groupBy("book_id").agg(F.count("*").alias("words"), F.sum(F.length("actual")).alias("letters"), F.count_if(differ).alias("lost"))


def covering(segs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters with the segments that overlap them and whether all of those lie inside: equi join on the book, range on the chapter."""
    s = segs.select("book_id", "segment_index", F.col("chapter_index").alias("lo"), F.col("chapter_end_index").alias("hi"))
    j = chapters.join(s, "book_id").where((F.col("chapter_index") >= F.col("lo")) & (F.col("chapter_index") <= F.col("hi")))
    return j.groupBy("book_id", "chapter_index").agg(F.count("*").alias("segments"), F.bool_and((F.col("lo") == F.col("chapter_index")) & (F.col("hi") == F.col("chapter_index"))).alias("all_inside"))


def paragraph_spans(sections: DataFrame, key: str, text: str) -> DataFrame:
    """key, par, start, end: paragraphs without the blanks around them as code points of the text; blank ones are left out."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"({T.PARAGRAPH_BREAK})", f"$1{T.END}"), T.END)
    p = sections.select(F.col(key).alias("key"), F.posexplode(parts).alias("i", "part"))
    before = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.length("part") - F.length(F.regexp_replace("part", rf"^{T.WS}+", ""))
    size = F.length(F.regexp_replace(F.regexp_replace("part", rf"^{T.WS}+", ""), rf"{T.WS}+\z", ""))
    q = p.withColumn("start", (before + lead).cast("int")).withColumn("end", (F.col("start") + size).cast("int")).where("end > start")
    return q.select(F.col("key").alias(key), (F.row_number().over(Window.partitionBy("key").orderBy("i")) - 1).alias("par"), "start", "end")


def approval(segs: DataFrame) -> dict[str, int | str]:
    """What an approval records: numbers of segments and books and one hash of all ids and texts, whatever their order."""
    h = F.xxhash64("book_id", "segment_id", "text_sha256")
    r = segs.agg(F.count("*").alias("n"), F.count_distinct("book_id").alias("books"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("mixed")).first()
    return {"segments": r.n, "books": r.books, "hash": f"{r.total}/{r.mixed}"}


def check_approved(segs: DataFrame, approved: dict[str, int | str] | None) -> DataFrame:
    """The segments, if they are those that were approved; otherwise an error."""
    if approved is None:
        raise ValueError("the segments have not been approved")
    if approval(segs) != approved:
        raise ValueError("the segments changed after the approval")
    return segs
