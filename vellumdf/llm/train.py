"""Training of the shipped models on a bounded sample of a data folder.

    python -m vellumdf.llm.train FOLDER

At most SAMPLE sections and SAMPLE blocks are read, chosen by a hash of their id.
Labels of the line and sentence models come from the rules in ``weak_labels``;
the reading model learns the grade counted from the text.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SAMPLE = 8_000


def main(folder: str) -> None:
    from . import lines, reading, sentences

    spark = SparkSession.builder.getOrCreate()
    pick = lambda name, key: spark.read.parquet(f"{folder}/{name}.parquet").orderBy(F.xxhash64(key)).limit(SAMPLE)
    sections = pick("book_sections", "section_id").where("content is not null").select("book_id", "content").collect()
    blocks = [r.text for r in pick("text_blocks", "block_id").where("text is not null").select("text").collect()]
    lines.MODEL.write_text(json.dumps(lines.train([r.content for r in sections] + blocks)))
    lines._model.cache_clear()
    prose = lambda texts: [t for t, junk in zip(texts, lines.not_prose(texts), strict=True) if not junk]
    model = sentences.train(prose(blocks))
    sentences.MODEL.write_text(json.dumps(model, ensure_ascii=False))
    for cached in (sentences._model, sentences._score, sentences._bare_model, sentences._learned):
        cached.cache_clear()
    # scripts without blanks are rare: a sample of their own
    unspaced = spark.read.parquet(f"{folder}/text_blocks.parquet").where(F.col("text").rlike("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")).orderBy(F.xxhash64("block_id")).limit(SAMPLE)
    sentences.MODEL.write_text(json.dumps(model | sentences.train_bare(prose([r.text for r in unspaced.select("text").collect()])), ensure_ascii=False))
    sentences._bare_model.cache_clear()
    model = reading.train([r.content for r in sections], [r.book_id for r in sections])
    reading.MODEL.write_text(json.dumps(model))
    print({k: v for k, v in model.items() if k != "model"})


if __name__ == "__main__":
    main(sys.argv[1])
