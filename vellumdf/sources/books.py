"""Book files as DataFrames: one row a section, one row a book, and what failed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.unicode import slug
from ..operators import tables

SECTION = "source_file string, book_title string, chapter_index int, chapter_title string, source_position string, content string, error string"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of the supported files of one folder, not of those below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,epub,docx,pdf,TXT,EPUB,DOCX,PDF}").option("recursiveFileLookup", "false").load(folder)


def parse(df: DataFrame) -> DataFrame:
    """Sections of each file; a file that cannot be read is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from . import markup

        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    title, parts = markup.read(bytes(data), name)
                    rows += [(name, title, i, s.title, s.position, s.content, None) for i, s in enumerate(parts)]
                except Exception as e:  # noqa: BLE001  a broken file must not end the import of the others
                    rows.append((name, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTION.split(", ")])

    return df.select("path", "content").mapInPandas(run, SECTION)


def sections(spark: SparkSession, folder: str, language: str = "und", exclude_front: bool = True, exclude_back: bool = True) -> DataFrame:
    """Section rows of all readable files: ids, matter, inclusion, word count and hash."""
    raw = files(spark, folder)
    ids = raw.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.sha2("content", 256).alias("source_sha256"))
    s = parse(raw).where(F.col("error").isNull()).join(ids, "source_file")
    s = s.withColumn("book_id", F.concat(slug("book_title"), F.lit("-"), F.substring("source_sha256", 1, 12)))
    s = tables.matter(s.withColumn("section_id", F.monotonically_increasing_id())).withColumnRenamed("matter_class", "matter")
    keep = ~((F.col("matter") == "front") & F.lit(exclude_front) | (F.col("matter") == "back") & F.lit(exclude_back))
    return s.select(
        "book_id", "book_title", "source_file", F.lit(language).alias("language"), "chapter_index", "chapter_title", "source_position", "matter", keep.alias("included"),
        T.word_count(F.col("content"), T.IMPORT_WORD).alias("word_count"), F.sha2("content", 256).alias("text_sha256"), "content", "source_sha256",
    )


def inventory(sections_: DataFrame) -> DataFrame:
    """One row a book."""
    return sections_.groupBy("book_id", "book_title", "source_file", "source_sha256", "language").agg(F.count("*").alias("section_count"), F.sum(F.when(F.col("included"), F.col("word_count")).otherwise(0)).alias("included_word_count"))
