"""Problem 3: per-document text quality statistics and the kind of each document.

Null and empty texts have zero counts, null shares and the kind ``prose``.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts
from .lines import KINDS, _folds, _weights, kind_chars, not_prose

# Very common words of the corpus languages.
COMMON = (
    "the of and to in that it was his her he she they with for on as but a der die das und den er sie es war mit dem bei ein nicht zu "
    "le la les de des et que il elle un une dans pour sur el los las y en por con una se del este era и в не на что он она это как был с "
    "o a os do da que não uma og að var i się nie to jest και το η ο στη με τα της των "
    "है में की के और का से को ने पर यह वह في من على إلى أن ما هو هي كان عن 그 이 는 은 를 을 에 의 가 그는 그녀는"
).split()


@functools.cache
def _common_hashes() -> np.ndarray:
    small = _folds()[1]
    w = _weights()
    return np.unique(np.array([sum(int(small[ord(c)]) * int(w[k]) for k, c in enumerate(x)) & (2**64 - 1) for x in set(COMMON)], np.uint64))


SCHEMA = "unit_id long, chars long, line_count long, word_count long, mean_word_length double, digit_share double, symbol_share double, lines_ending_in_punctuation double, common_word_share double, prose_share double, list_share double, table_share double, junk_share double, kind string"


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a row of ``df``: counts, lengths, shares and the kind with the most characters if prose has no half of them."""

    def run(c: dict[str, list]) -> dict[str, list]:
        texts = c["text"]
        chars, lines, _ = kind_chars(texts)
        n = lines.n_units
        per = lambda v: np.bincount(lines.unit, weights=v, minlength=n)
        s = lines.stats()
        words, solid, total = per(lines.words), per(s["length"]), chars.sum(1)
        common = np.bincount(lines.word_unit[np.isin(lines.word_hash, _common_hashes())], minlength=n)
        count = per(np.ones(len(lines.unit)))
        other = 1 + chars[:, 1:].argmax(1)
        kind = np.where(chars[:, 1:].sum(1) * 2 > total, other, 0)
        share = lambda a, b: [None if y == 0 else float(x / y) for x, y in zip(a, b, strict=True)]
        out = {"unit_id": c["unit_id"], "chars": [len(t or "") for t in texts], "line_count": count.astype(int).tolist(), "word_count": words.astype(int).tolist()}
        out["mean_word_length"] = share(per(s["letters"] * s["length"]), words)
        out["digit_share"] = share(per(s["digits"] * s["length"]), solid)
        out["symbol_share"] = share(per(s["symbols"] * s["length"]), solid)
        out["lines_ending_in_punctuation"] = share(per(lines.last_kind() == 0), count)
        out["common_word_share"] = share(common, words)
        for k, name in enumerate(KINDS):
            out[f"{name}_share"] = share(chars[:, k], total)
        out["kind"] = [KINDS[k] for k in kind]
        return out

    return map_texts(df.select(F.col(key).cast("long").alias("unit_id"), F.col(text).alias("text")), ["text"], run, SCHEMA)


def not_running_text(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """unit_kind, unit_id of the rows of which more than half of the characters are no running text."""

    def run(c: dict[str, list]) -> dict[str, list]:
        flag = not_prose(c["text"])
        ids = [i for i, f in zip(c["unit_id"], flag, strict=True) if f]
        return {"unit_kind": [kind] * len(ids), "unit_id": ids}

    return map_texts(df.select(F.col(key).cast("long").alias("unit_id"), F.col(text).alias("text")), ["text"], run, "unit_kind string, unit_id long")
