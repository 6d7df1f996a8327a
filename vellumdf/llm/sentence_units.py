"""Problem 5: sentence units of every running text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts
from .lines import not_prose
from .sentences import spans


def sentence_spans(df: DataFrame, key: str, text: str, prose_only: bool = True) -> DataFrame:
    """key, sent_start, sent_end: 0-based code points in the stored text, end exclusive.

    With ``prose_only`` texts that are mostly lists, tables or junk give no
    sentence.  Null, empty and blank texts give none either.
    """

    def run(c: dict[str, list]) -> dict[str, list]:
        texts = c["text"]
        if prose_only:
            texts = [None if f else t for t, f in zip(texts, not_prose(texts), strict=True)]
        found = spans(texts)
        return {
            key: [i for i, own in zip(c["key"], found, strict=True) for _ in own],
            "sent_start": [a for own in found for a, _ in own],
            "sent_end": [b for own in found for _, b in own],
        }

    return map_texts(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), ["text"], run, f"{key} long, sent_start long, sent_end long")


def sentence_texts(df: DataFrame, key: str, text: str, prose_only: bool = True) -> DataFrame:
    """key, sentence_no (0-based), sent_start, sent_end, sentence."""

    def run(c: dict[str, list]) -> dict[str, list]:
        texts = c["text"]
        if prose_only:
            texts = [None if f else t for t, f in zip(texts, not_prose(texts), strict=True)]
        rows = [(i, n, a, b, t[a:b]) for i, t, own in zip(c["key"], texts, spans(texts), strict=True) for n, (a, b) in enumerate(own)]
        names = (key, "sentence_no", "sent_start", "sent_end", "sentence")
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}

    return map_texts(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), ["text"], run, f"{key} long, sentence_no int, sent_start long, sent_end long, sentence string")
