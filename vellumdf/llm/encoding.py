"""Problem 9: garbled text from wrong character encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts
from .mojibake import repair


def restored(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, restored_text, garbled_spans, lost_chars of every affected row; correct parts of the text are left as stored.

    Null and empty texts are not affected.
    """

    def run(c: dict[str, list]) -> dict[str, list]:
        rows = [(i, *repair(t)) for i, t in zip(c["key"], c["text"], strict=True)]
        rows = [r for r in rows if r[2] or r[3]]
        return {n: [r[k] for r in rows] for k, n in enumerate((key, "restored_text", "garbled_spans", "lost_chars"))}

    return map_texts(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), ["text"], run, f"{key} long, restored_text string, garbled_spans int, lost_chars int")
