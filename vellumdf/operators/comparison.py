"""Comparison with peers, baselines and reference windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def peer_bands(rows: DataFrame, group: str, key: str, value: str, least: int = 4) -> DataFrame:
    """group, key, q25, median, q75, n of the other rows of the group, null where fewer than ``least`` others have a value.

    A row's quantile without itself lies between two order statistics of the
    group that are at most one place off, so three order statistics a quantile
    are kept a group and rows are never paired.
    """
    v = rows.where(F.col(value).isNotNull()).select(group, key, F.col(value).cast("double").alias("x"))
    n = F.count("*").over(Window.partitionBy(group))
    r = v.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("x", key)) - 1).withColumn("n", n)
    fractions = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    place = lambda f: (F.col("n") - 2) * f  # noqa: E731  position among n - 1 others
    picks = [F.max(F.when(F.col("r") == F.floor(place(f)) + k, F.col("x"))).alias(f"{name}{k}") for name, f in fractions.items() for k in range(3)]
    stats = r.groupBy(group).agg(*picks)
    j = r.join(stats, group)

    def at(name: str, f: float) -> Column:
        i = F.floor(place(f))
        low = F.when(i < F.col("r"), F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
        high = F.when(i + 1 < F.col("r"), F.col(f"{name}1")).otherwise(F.coalesce(f"{name}2", low))
        return F.when(F.col("n") - 1 >= least, low + (high - low) * (place(f) - i))

    return j.select(group, key, F.col("x").alias(value), *(at(name, f).alias(name) for name, f in fractions.items()), (F.col("n") - 1).alias("n"))


#: Least distance from the band at which a value is an exception.
MINIMUM = {"sentenceMean": 3.0, "mattr": 5.0, "nearRepeat": 2.0}


def deviations(banded: DataFrame, value: str, metric: str, words: str | None = None, least_words: int = 300) -> DataFrame:
    """Adds direction: above or below where the value lies outside the band by more than max(minimum, 1.5 x its width)."""
    margin = F.greatest(F.lit(MINIMUM.get(metric, 0.0)), 1.5 * (F.col("q75") - F.col("q25")))
    d = F.when(F.col(value) > F.col("q75") + margin, "above").when(F.col(value) < F.col("q25") - margin, "below")
    return banded.withColumn("direction", F.when(F.col(words) >= least_words, d) if words else d)


def deltas(target: DataFrame, reference: DataFrame, same_version: bool = True, same_long_sentence: bool = True) -> DataFrame:
    """metric, delta, reason of two profiles (metric, value, reason, lang): target minus reference, or why there is none.

    ``same_version``: both were made by the same version of the metrics; ``same_long_sentence``: with the same limit of long sentences.
    """
    t = target.select("unit_id", "metric", F.col("value").alias("a"), F.col("reason").alias("ra"), F.col("lang").alias("la"))
    r = reference.select("metric", F.col("value").alias("b"), F.col("reason").alias("rb"), F.col("lang").alias("lb"))
    j = t.join(r, "metric")
    reason = F.when(F.lit(not same_version), "different versions").when(F.col("la") != F.col("lb"), "different languages")
    reason = reason.when(F.lit(not same_long_sentence) & (F.col("metric") == "longSentences"), "different limits of long sentences").otherwise(F.coalesce("ra", "rb"))
    return j.select("unit_id", "metric", F.when(reason.isNull(), F.bround(F.col("a") - F.col("b"), 4)).alias("delta"), reason.alias("reason"))


def window_starts(total: Column, size: Column, most: int = 9) -> Column:
    """Starts of at most ``most`` windows of ``size`` words that do not overlap; a single one is centred."""
    count = F.least(F.lit(most), F.floor(total / size)).cast("int")
    several = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.bround(i * (total - size) / (count - 1), 0).cast("int"))
    return F.when(count >= 2, several).when(count == 1, F.array(F.floor((total - size) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))


def matched_windows(tokens: DataFrame, size: int, most: int = 9) -> DataFrame:
    """unit_id, window, start, words: windows of equal length over the words of a unit (unit_id, pos, word)."""
    total = tokens.groupBy("unit_id").agg(F.count("*").cast("int").alias("total"))
    w = total.select("unit_id", F.posexplode(window_starts(F.col("total"), F.lit(size), most)).alias("window", "start"))
    # a token lies in at most one window: equi join on the unit, range within it
    j = tokens.join(w, "unit_id").where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + size))
    return j.groupBy("unit_id", "window", "start").agg(F.count("*").alias("words"), F.count_distinct("word").alias("types"))
