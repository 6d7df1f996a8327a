"""Unicode composition and slugs, for which Spark has no expression."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed form (NFC); null stays null."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def slug(s: pd.Series) -> pd.Series:
    """ASCII small letters and figures joined by hyphens; ``book`` where nothing is left; null stays null."""

    def one(x: str) -> str:
        flat = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()
        return re.sub("[^a-z0-9]+", "-", flat).strip("-") or "book"

    return s.map(one, na_action="ignore")


#: Type-token ratio at which a stretch ends.
LIMIT = 0.72


@F.pandas_udf(DoubleType())
def mtld(words: pd.Series) -> pd.Series:
    """Mean length of the stretches over which the type-token ratio stays above .72, forwards and backwards; null where no stretch ends."""

    def stretches(seq: list[str]) -> float:
        """Stretches that end at the limit, the open one counted by its share of the way there."""
        last: dict[str, int] = {}
        begin = kinds = ended = 0
        for i, w in enumerate(seq):
            # new in this stretch: last met before it began
            kinds += last.get(w, -1) < begin
            last[w] = i
            if kinds / (i + 1 - begin) <= LIMIT:
                begin, kinds, ended = i + 1, 0, ended + 1
        rest = len(seq) - begin
        return ended + ((1 - kinds / rest) / (1 - LIMIT) if rest else 0.0)

    def both(w: object) -> float | None:
        if w is None or not len(w):
            return None
        seq = list(w)
        there, back = stretches(seq), stretches(seq[::-1])
        return (len(seq) / there + len(seq) / back) / 2 if there and back else None

    return words.map(both)
