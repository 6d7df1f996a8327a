"""An inbox folder as a stream: every new book file is parsed once and its sections are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..sources.books import parse

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of files as they arrive, with their arrival time."""
    raw = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.{txt,epub,docx,pdf}").load(folder)
    return parse(raw).withColumn("arrived_at", F.current_timestamp())


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append all waiting files to a Parquet table and stop; a file seen before is not read again."""
    s = arriving(spark, folder).withColumn("word_count", T.word_count(F.col("content"), T.IMPORT_WORD))
    return s.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def words_per_window(sections: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Sections and words a time window; rows later than ``late`` are left out."""
    w = sections.withWatermark("arrived_at", late).groupBy(F.window("arrived_at", width))
    return w.agg(F.count("*").alias("sections"), F.sum(T.word_count(F.col("content"), T.IMPORT_WORD)).alias("words"))
