"""Queries of the training-data problems and, where SQL can say them, their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import consistent, encoding, leakage, mixture, neighbors, pieces, quality, reading, sentence_units

Query = Callable[[SparkSession, str], DataFrame]


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    return consistent.consistent_sections(table(spark, d, "book_sections"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consistent.look_alikes(table(spark, d, "book_sections"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return consistent.look_alike_classes(table(spark, d, "book_sections"))


def p2_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "book_sections"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_levels(spark, d).select("section_id", "reading_level")


def p2_books(spark: SparkSession, d: str) -> DataFrame:
    """Profile of each book: graded sections, mean grade, sections of each level."""
    count = lambda level: F.count_if(F.col("reading_level") == level).alias(level)
    return p2_levels(spark, d).groupBy("book_id").agg(F.count("*").alias("sections"), F.round(F.avg("predicted_grade"), 4).alias("mean_grade"), count("easy"), count("medium"), count("hard"))


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = quality.statistics(table(spark, d, "book_sections"), "section_id", "content").withColumn("unit_kind", F.lit("section"))
    b = quality.statistics(table(spark, d, "text_blocks"), "block_id", "text").withColumn("unit_kind", F.lit("block"))
    return s.unionByName(b)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    s = quality.not_running_text(table(spark, d, "book_sections"), "section_id", "content", "section")
    return s.unionByName(quality.not_running_text(table(spark, d, "text_blocks"), "block_id", "text", "block"))


def p4_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest(table(spark, d, "reference_matrix"), "reference_index", "matrix")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = p4_neighbors(spark, d)
    return near.select(F.least("id", "neighbor").alias("reference_index_a"), F.greatest("id", "neighbor").alias("reference_index_b")).distinct()


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all section contents, also of lists, tables and junk, with their text."""
    return sentence_units.sentence_texts(table(spark, d, "book_sections"), "section_id", "content", prose_only=False)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units.sentence_spans(table(spark, d, "text_blocks"), "block_id", "text")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.chapter_pieces(table(spark, d, "text_blocks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.chapter_cuts(p6_pieces(spark, d))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    sized = mixture.sized_documents(table(spark, d, "documents"))
    return mixture.copies(sized, mixture.cut(mixture.plan(sized, table(spark, d, "mix_targets"))))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.report(mixture.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).where("out_of_reach").select("mix_id", "source")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_restored(spark, d).select("doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_consistent, p1_found, p1_classes, p2_levels, p2_found, p2_books, p3_statistics, p3_found, p4_neighbors, p4_found, p5_sentences, p5_found, p6_pieces, p6_found, p7_leaks, p7_found, p7_clean, p8_mixture, p8_report, p8_found, p9_restored, p9_found)
}



def _folded(text: str) -> str:
    """SQL: every letter and figure as the smallest of its case and look-alike variants, characters that print nothing left out."""
    fold, several = leakage._folds()
    one = [(c, int(fold[c]) - 1) for c in range(0x10000) if fold[c] and fold[c] != leakage.DROP and fold[c] - 1 != c and not 0xD800 <= c < 0xE000]
    gone = [c for c in range(0x10000) if fold[c] == leakage.DROP]
    quote = lambda cs: "'" + "".join(map(chr, cs)).replace("'", "''") + "'"
    out = f"nfc_normalize({text})"
    for c, to in several.items():
        if c < 0x10000 and "LATIN" in unicodedata.name(chr(c), ""):
            out = f"replace({out}, '{chr(c)}', '{to}')"
    return f"translate({out}, {quote([a for a, _ in one] + gone)}, {quote([b for _, b in one])})"


_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')"


def _grams(table_name: str, key: str) -> str:
    words = _WORDS.format(_folded("text"))
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {key}, {words} AS w FROM {table_name} WHERE text IS NOT NULL) WHERE len(w) >= 10)"


ORACLE: dict[str, str] = {
    "p4_found": """
        WITH r AS MATERIALIZED (SELECT reference_index AS id, matrix::DOUBLE[] AS v FROM reference_matrix
            WHERE matrix IS NOT NULL AND len(matrix) = 64 AND len(list_filter(matrix, lambda x: x IS NULL OR isnan(x))) = 0),
        k AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS n FROM r a, r b WHERE a.id <> b.id QUALIFY n <= 5)
        SELECT DISTINCT least(a, b) AS reference_index_a, greatest(a, b) AS reference_index_b FROM k
    """,
    "p7_found": f"SELECT DISTINCT d.doc_id, i.item_id FROM ({_grams('documents', 'doc_id')}) d JOIN ({_grams('eval_items', 'item_id')}) i USING (g)",
    "p8_found": r"""
        WITH sized AS (
            SELECT source, coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]')), 0) AS tokens
            FROM documents
        ), present AS (SELECT source, sum(tokens) AS tokens FROM sized GROUP BY source)
        SELECT t.mix_id, t.source
        FROM mix_targets t LEFT JOIN present p ON p.source = t.source
        WHERE coalesce(p.tokens, 0) * t.max_repeats < t.target_share * t.budget_ratio * (SELECT sum(tokens) FROM sized)
    """,
}
