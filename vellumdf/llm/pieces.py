"""Problem 6: splitting oversized chapters at natural boundaries.

A chapter over the limit is cut by lexical cohesion: the words on both sides of
every boundary are compared, the dips of that similarity mark changes of topic,
and each piece ends at the deepest dip of its size window.  Boundaries are the
edges of blocks; inside a block over the limit the ends of its sentences; inside
a sentence over the limit any place.  Every piece but the first of its chapter
repeats the ``overlap`` code points before it, less only where a whole block
would otherwise exceed the limit.

Of a block delivered more than once one row counts (the earliest).  A row with a
null block_no or book_id is a block of its own; null block numbers come first,
in order of block_id.  Null texts are empty, rows without a block_id are left
out.  Null chapter numbers form a chapter of their own.  A piece never spans two
chapters.

A chapter is worked by many tasks: in the first REGION limits of every WINDOW code
points the deepest dip is a cut, and the pieces between two such cuts need nothing
beyond them but the words beside.  Both neighbours find the same cut from the same
text, so the pieces are those of one pass, whatever task does which.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import arrow_schema, record_batch
from .sentences import spans as sentence_spans

LIMIT, OVERLAP = 4000, 200
#: Code points between two cuts that part the work, in limits; code points in which such a cut is looked for, in limits.
WINDOW, REGION = 100, 3
#: Code points on each side of a boundary that are compared.
SIDE = 600
WORDS = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")
KINDS = ("between", "inside", "forced")
#: Preference of boundaries where dips are alike.
BONUS = {"chapter": 0.3, "scene": 0.2, "paragraph": 0.05, "forced": -0.1}
SCHEMA = "book_id string, chapter_index int, window long, piece_no int, piece_start long, piece_end long, overlap int, cut_kind string, piece string"


def one_row_per_block(blocks: DataFrame) -> DataFrame:
    """block_id of the earliest delivery of every (book_id, block_no), chosen without moving texts; rows with a null there count each."""
    key = ["book_id", "block_no", F.when(F.col("book_id").isNull() | F.col("block_no").isNull(), F.col("block_id")).alias("own")]
    first = blocks.where("block_id is not null").groupBy(*key).agg(F.min(F.struct(F.col("loaded_at").isNull().alias("late"), "loaded_at", "block_id")).alias("f"))
    return first.select(F.col("f.block_id").alias("block_id"))


def _dips(text: str, cuts: list[int]) -> np.ndarray:
    """Depth of the dip in word similarity at each cut."""
    if not cuts:
        return np.zeros(0)
    found = [(m.start(), m.group()) for m in WORDS.finditer(text)]
    if not found:
        return np.zeros(len(cuts))
    at = np.array([p for p, _ in found])
    ids: dict[str, int] = {}
    word = [ids.setdefault(w.lower(), len(ids)) for _, w in found]
    sim = []
    for c in cuts:
        k = int(np.searchsorted(at, c))
        a, b = int(np.searchsorted(at, c - SIDE)), int(np.searchsorted(at, c + SIDE))
        left, right = set(word[a:k]), set(word[k:b])
        sim.append(len(left & right) / max(1.0, (len(left) * len(right)) ** 0.5))
    s = np.array(sim)
    # climb to the nearest peak on each side
    up_left, up_right = s.copy(), s.copy()
    for i in range(1, len(s)):
        if s[i - 1] >= s[i]:
            up_left[i] = up_left[i - 1]
    for i in range(len(s) - 2, -1, -1):
        if s[i + 1] >= s[i]:
            up_right[i] = up_right[i + 1]
    return up_left + up_right - 2 * s


#: Position in the chapter, kind of cut (place in KINDS), preference.
Edge = tuple[int, int, float]


def boundaries(blocks: list[tuple[int, str, str | None]], limit: int, overlap: int) -> list[Edge]:
    """Where a piece may end: the edges of the blocks, the ends of sentences in blocks over the limit, any place in sentences over it.

    blocks: (start in the chapter, text, boundary before it).
    """
    edges: list[Edge] = []
    for at, t, mark in blocks:
        if at:
            edges.append((at, 0, BONUS.get(mark or "", 0.0)))
        if len(t) > limit:
            room = limit - overlap
            ends = sentence_spans([t])[0]
            last = 0
            for k, (a, b) in enumerate(ends):
                stop = ends[k + 1][0] if k + 1 < len(ends) else len(t)
                if b - a > limit:
                    # a sentence over the limit: places at blanks where there are any
                    while stop - last > room:
                        blank = max(t.rfind(" ", last + room // 2, last + room), t.rfind("\n", last + room // 2, last + room))
                        last = blank + 1 if blank > 0 else last + room
                        edges.append((at + last, 2, -0.5))
                if stop < len(t):
                    edges.append((at + stop, 1, -0.2))
                last = stop
    edges.sort()
    return edges


def _best(edges: list[Edge], depth: np.ndarray, among: list[int]) -> int:
    return max(among, key=lambda k: (depth[k] + edges[k][2], edges[k][0]))


def anchor(text: str, base: int, edges: list[Edge], at: int, width: int) -> Edge:
    """The deepest dip from ``at`` over ``width`` code points, cuts inside a block only where no block ends there; seen is SIDE to both sides of that, no more."""
    own = [e for e in edges if at <= e[0] < at + width]
    least = min(e[1] for e in own)
    lo = max(base, at - SIDE)
    depth = _dips(text[lo - base : at + width + SIDE - base], [e[0] - lo for e in own])
    return own[_best(own, depth, [k for k, e in enumerate(own) if e[1] == least])]


def cut_part(text: str, base: int, edges: list[Edge], start: int, stop: int, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of its end) of the pieces from ``start`` to ``stop``; text: begins at ``base`` and goes some way beyond both."""
    own = [e for e in edges if start < e[0] < stop]
    cuts = [e[0] for e in own]
    lo = max(base, start - SIDE)
    depth = _dips(text[lo - base : stop + SIDE - base], [c - lo for c in cuts])
    out: list[tuple[int, int, str]] = []
    while start < stop:
        room = limit - min(overlap, start)
        if stop - start <= room:
            out.append((start, stop, ""))
            break
        i, j = np.searchsorted(cuts, [start + 1, start + room + 1])
        if i < j:
            least = min(own[k][1] for k in range(i, j))
            # cuts inside a block only where no block edge is in reach, pieces of at least half the size where there is a choice
            good = [k for k in range(i, j) if own[k][1] == least]
            best = _best(own, depth, [k for k in good if cuts[k] - start >= room // 2] or good[-1:])
            end, kind = cuts[best], own[best][1]
        else:
            # the next edge is beyond the room but within the limit: the repetition gives way
            k = int(np.searchsorted(cuts, start + limit + 1)) - 1
            if k >= 0 and cuts[k] > start:
                end, kind = cuts[k], own[k][1]
            elif stop - start <= limit:
                out.append((start, stop, ""))
                break
            else:
                end, kind = start + room, 2
        out.append((start, end, KINDS[kind]))
        start = end
    return out


def chapter_pieces(blocks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """book_id, chapter_index, window, piece_no, piece_start, piece_end, overlap, cut_kind, piece.

    Positions count code points of the chapter's texts laid end to end.  piece
    begins ``overlap`` before piece_start; cut_kind says how the piece ends:
    between blocks, inside a block or forced inside a sentence, and is empty for
    the last piece of a chapter.  piece_no counts within the window.
    """
    window, width = WINDOW * limit, REGION * limit
    margin = max(SIDE, overlap)
    chapter = ["book_id", "chapter_index"]
    meta = blocks.select("block_id", *chapter, "block_no", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    meta = meta.join(one_row_per_block(blocks), "block_id", "left_semi").dropDuplicates(["block_id"])
    # sizes only: even a very long chapter is a narrow sort
    order = Window.partitionBy(*chapter).orderBy("block_no", "block_id")
    meta = meta.withColumn("start", F.sum("size").over(order) - F.col("size")).withColumn("total", F.sum("size").over(Window.partitionBy(*chapter)))
    meta = meta.where(F.col("total") > limit)
    # a block goes to every window that reads it: its own, and where it lies beside or in the region of a cut the neighbour too
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - width - SIDE + 1) / window) - 1)
    last_window = F.greatest(F.lit(0), F.floor((F.col("total") - width) / window))
    first = F.least(first, last_window)
    last = F.least(last_window, F.floor((F.col("start") + F.greatest("size", F.lit(1)) - 1 + margin) / window))
    meta = meta.select("block_id", "start", "total", F.explode(F.sequence(first, F.greatest(first, last))).alias("window"))
    rows = blocks.select("block_id", *chapter, "text", "boundary_before").join(meta, "block_id")

    target = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def close(key: tuple, total: int, group: list[tuple]) -> None:
            k = key[-1]
            base, text = group[0][0], "".join(t for _, t, _ in group)
            edges = boundaries(group, limit, overlap)
            begin = anchor(text, base, edges, k * window, width) if k else None
            end = anchor(text, base, edges, (k + 1) * window, width) if (k + 1) * window + width <= total else None
            start, stop = begin[0] if begin else 0, end[0] if end else total
            for no, (a, b, kind) in enumerate(cut_part(text, base, edges, start, stop, limit, overlap)):
                back = min(overlap, a, max(0, limit - (b - a)))
                out.append((*key, no, a, b, back, kind or (KINDS[end[1]] if end else ""), text[a - back - base : b - base]))

        group: list[tuple] = []
        key: tuple | None = None
        size = 0
        last: int | None = None
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in (*chapter, "window", "total", "start", "text", "boundary_before", "block_id")]
            for book, ch, no, total, start, text, mark, block in zip(*cols, strict=True):
                if (book, ch, no) != key:
                    if group:
                        close(key, size, group)
                    key, size, group, last = (book, ch, no), total, [], None
                if block != last:  # a row delivered twice under one id
                    group.append((start, text or "", mark))
                last = block
            if len(out) > 2000:
                yield record_batch(out, target)
                out.clear()
        if group:
            close(key, size, group)
        if out:
            yield record_batch(out, target)

    parts = [*chapter, "window"]
    return rows.repartition(*parts).sortWithinPartitions(*parts, "start", "block_id").select(*parts, "total", "start", "text", "boundary_before", "block_id").mapInArrow(run, SCHEMA)


def chapter_cuts(pieces: DataFrame) -> DataFrame:
    """book_id, chapter_index, cut_kind: the strongest means any piece of the chapter needed."""
    level = F.max(F.when(F.col("cut_kind") == "forced", 2).when(F.col("cut_kind") == "inside", 1).otherwise(0))
    return pieces.groupBy("book_id", "chapter_index").agg(level.alias("level")).select("book_id", "chapter_index", F.element_at(F.array(*map(F.lit, KINDS)), F.col("level") + 1).alias("cut_kind"))
