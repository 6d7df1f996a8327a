"""Writing review: bands from the other chapters, stylistic exceptions, cards, priorities, length-matched comparison.

All of it works on the long form of the gated metrics (unit_id, n, metric, value,
reason); no row is paired with the other rows of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import metrics as M
from .comparison import window_starts

# Least distance from the band at which a value is an exception.
MINIMUM = {"sentenceMean": 3.0, "mattr": 5.0, "nearRepeat": 2.0}
# Fixed value: words from which a unit is judged and counts as a peer.
LEAST_WORDS = 300
# What is to be looked at first, and the group it belongs to.
PRIORITIES = (("paragraphRepeat", "repetition"), ("sentenceRepeat", "repetition"), ("longSentences", "flow"), ("commaChains", "flow"), ("nearRepeat", "wording"), ("fillers", "wording"))
# Metrics that depend on the length of a text, and those that need the paragraphs of the original.
LENGTH_DEPENDENT = ("entropy", "hapax", "topWords", "trigramRepeat", "sentenceRepeat", "startRepeat", "paragraphRepeat")
STRUCTURAL = ("paragraphMean", "paragraphCV", "paragraphRepeat", "cohesion", "shifts")


def chapter_bands(rows: DataFrame, group: str, key: str, least: int = 4) -> DataFrame:
    """Adds others, q25, median, q75: of the other units of the group with LEAST_WORDS words and a value; null where these are fewer than ``least``.

    rows: group, key, n, metric, value.  A unit that counts itself takes its
    quantiles without itself from three order statistics a quantile.
    """
    by = [group, "metric"]
    valid = F.col("value").isNotNull() & ~F.isnan("value")
    counts = valid & (F.coalesce("n", F.lit(0)) >= LEAST_WORDS)
    peers = rows.where(counts)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("value", key)) - 1
    ranked = peers.withColumn("r", rank).withColumn("size", F.count("*").over(Window.partitionBy(*by)))
    fractions = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    place = lambda f: (F.col("size") - 2) * f  # noqa: E731  position among the size - 1 others
    picks = [F.max(F.when(F.col("r") == F.floor(place(f)) + k, F.col("value"))).alias(f"{name}{k}") for name, f in fractions.items() for k in range(3)]
    stats = ranked.groupBy(*by).agg(*picks, F.count("*").alias("all"), F.percentile("value", F.array(*map(F.lit, fractions.values()))).alias("whole"))
    inside = ranked.join(stats, by)
    outside = rows.where(~counts | counts.isNull()).join(stats, by, "left")

    def alone(name: str, f: float) -> Column:
        i = F.floor(place(f))
        low = F.when(i < F.col("r"), F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
        high = F.when(i + 1 < F.col("r"), F.col(f"{name}1")).otherwise(F.coalesce(f"{name}2", low))
        return F.when(F.col("all") - 1 >= least, low + (high - low) * (place(f) - i)).alias(name)

    keep = rows.columns
    one = inside.select(*keep, (F.col("all") - 1).alias("others"), *(alone(name, f) for name, f in fractions.items()))
    all_ = F.coalesce("all", F.lit(0))
    two = outside.select(*keep, all_.alias("others"), *(F.when(all_ >= least, F.col("whole")[i]).alias(name) for i, name in enumerate(fractions)))
    return one.unionByName(two)


def exceptions(banded: DataFrame) -> DataFrame:
    """Adds eligible (there is a value and a band) and direction: lower or higher where a unit of LEAST_WORDS words lies outside the band by more than max(minimum, 1.5 x its width)."""
    least = F.lit(0.0)
    for metric, minimum in MINIMUM.items():
        least = F.when(F.col("metric") == metric, minimum).otherwise(least)
    margin = F.greatest(least, 1.5 * (F.col("q75") - F.col("q25")))
    far = F.when(F.col("value") < F.col("q25") - margin, "lower").when(F.col("value") > F.col("q75") + margin, "higher")
    return banded.withColumn("eligible", F.col("value").isNotNull() & F.col("q25").isNotNull()).withColumn("direction", F.when(F.col("n") >= LEAST_WORDS, far))


def consistency(judged: DataFrame, *keys: str) -> DataFrame:
    """keys, status, exceptions: review with an exception, observe with a band, unknown without one or under LEAST_WORDS words."""
    known = (F.col("n") >= LEAST_WORDS) & F.col("eligible")
    g = judged.groupBy(*keys).agg(F.coalesce(F.bool_or(known), F.lit(False)).alias("known"), F.count("direction").alias("exceptions"))
    return g.select(*keys, F.when(F.col("exceptions") > 0, "review").when(F.col("known"), "observe").otherwise("unknown").alias("status"), "exceptions")


def roll_up(cards: DataFrame, group: str) -> DataFrame:
    """group, units, assessed, to_review, status of the consistency of all its units."""
    g = cards.groupBy(group).agg(F.count("*").alias("units"), F.count_if(F.col("status") != "unknown").alias("assessed"), F.count_if(F.col("status") == "review").alias("to_review"))
    return g.withColumn("status", F.when(F.col("to_review") > 0, "review").when(F.col("assessed") > 0, "observe").otherwise("unknown"))


def cards(values: DataFrame, open_duplicates: DataFrame, goal: float = 10.0) -> DataFrame:
    """unit_id, card, status of flow, vocabulary and repetition.

    values: gated metrics; open_duplicates: unit_id, open - repeated sentences and paragraphs that no decision calls intentional.
    """
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    w = values.groupBy("unit_id", "n").agg(*map(of, ("longSentences", "mattr", "sentenceRepeat"))).join(open_duplicates, "unit_id", "left")
    short = F.col("n") < LEAST_WORDS
    status = lambda metric, otherwise: F.when(short | F.col(metric).isNull(), "unknown").otherwise(otherwise)
    rows = {
        "flow": status("longSentences", F.when(F.col("longSentences") > goal, "review").otherwise("fit")),
        "vocabulary": status("mattr", F.lit("observe")),
        "repetition": status("sentenceRepeat", F.when(F.col("open") > 0, "review").otherwise("observe")),
    }
    return w.select("unit_id", F.inline(F.array(*(F.struct(F.lit(k).alias("card"), s.alias("status")) for k, s in rows.items()))))


def priorities(findings: DataFrame, shares: DataFrame, goal: float = 10.0, k: int = 3) -> DataFrame:
    """unit_id, rank, metric, group, found, open: at most ``k`` metrics with open findings, the first of each group in the order of PRIORITIES.

    findings: unit_id, metric, intentional; shares: unit_id, share of long
    sentences - these are named only above the goal.
    """
    metric = F.col("metric")
    order, group = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (m, g) in enumerate(PRIORITIES):
        order, group = F.when(metric == m, i).otherwise(order), F.when(metric == m, g).otherwise(group)
    c = findings.where(metric.isin([m for m, _ in PRIORITIES])).groupBy("unit_id", "metric").agg(F.count("*").alias("found"), F.count_if(~F.col("intentional")).alias("open"))
    c = c.where("open > 0").join(shares.select("unit_id", "share"), "unit_id", "left").where((metric != "longSentences") | (F.col("share") > goal))
    c = c.withColumn("order", order).withColumn("group", group)
    first = c.withColumn("r", F.row_number().over(Window.partitionBy("unit_id", "group").orderBy("order"))).where("r = 1")
    rank = F.row_number().over(Window.partitionBy("unit_id").orderBy("order"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("unit_id", "rank", "metric", "group", "found", "open")


def local_delta(target: DataFrame, reference: DataFrame) -> DataFrame:
    """unit_id and the differences of four basic metrics to the reference of the same lang, at three places; null where a side has none."""
    names = {"sentenceMean": "sentenceMean", "sentenceVariation": "sentenceCV", "vocabulary": "mattr", "dialogue": "dialogue"}
    r = reference.select("lang", *(F.col(c).alias(f"r_{c}") for c in names.values()))
    return target.join(r, "lang").select("unit_id", *(F.bround(F.col(c) - F.col(f"r_{c}"), 3).alias(k) for k, c in names.items()))


def word_pieces(text: Column) -> Column:
    """The text cut behind every word: each piece is a word and what stands before it; the last what is left."""
    return F.split(F.regexp_replace(text, f"({T.WORD})", f"$1{T.END}"), T.END)


def window_units(targets: DataFrame, references: DataFrame, most: int = 9) -> DataFrame:
    """unit_id (target/window), lang, text: windows of the reference of the same lang that are as long as the target.

    targets: unit_id, lang, n; references: unit_id, lang, text, one a lang.  At
    most ``most`` windows that do not overlap; none where the reference is shorter.
    """
    pieces = word_pieces(F.col("text"))
    r = references.select("lang", F.col("text").alias("whole"), pieces.alias("pieces")).withColumn("total", F.size("pieces") - 1)
    j = targets.where("n > 0").select("unit_id", "lang", "n").join(r, "lang").where(F.col("n") <= F.col("total"))
    w = j.select("unit_id", "lang", "n", "total", "whole", "pieces", F.posexplode(window_starts(F.col("total"), F.col("n"), most)).alias("window", "start"))
    cut = F.regexp_replace(F.array_join(F.slice("pieces", F.col("start") + 1, F.col("n").cast("int")), ""), f"^[^{T.L}]+", "")
    return w.select(F.concat_ws("/", F.col("unit_id").cast("string"), "window").alias("unit_id"), "lang", F.when(F.col("n") == F.col("total"), F.col("whole")).otherwise(cut).alias("text"))


def compare(targets: DataFrame, references: DataFrame, windows: DataFrame, legacy: Column | None = None, places: int = 4) -> DataFrame:
    """unit_id, metric, reference, q25, q75, windows, delta, reason.

    targets, references: gated metrics with lang; windows: gated metrics of
    ``window_units``.  The reference value is the median of the windows; without
    windows that of the whole reference, but for metrics that depend on length.
    ``legacy`` marks targets without the paragraphs of their original.  A band
    stands only where there is a delta.  Values are rounded half-even to ``places``.
    """
    w = windows.withColumn("target", F.substring_index("unit_id", "/", 1))
    ok = F.col("value").isNotNull()
    value = F.when(ok, F.col("value"))
    bands = w.groupBy("target", "metric").agg(
        F.count(value).alias("windows"), F.bround(F.median(value), places).alias("mid"), *(F.bround(F.percentile(value, F.lit(f)), places).alias(name) for name, f in (("q25", 0.25), ("q75", 0.75))), F.min_by("reason", "unit_id").alias("why")
    )
    r = references.select("lang", "metric", F.col("value").alias("base"), F.col("reason").alias("base_why"))
    t = targets.select("unit_id", "lang", "metric", "value", "reason", (legacy if legacy is not None else F.lit(False)).alias("legacy")).join(r, ["lang", "metric"])
    j = t.join(bands.withColumnRenamed("metric", "m"), (F.col("unit_id").cast("string") == F.col("target")) & (F.col("metric") == F.col("m")), "left")
    matched, structural = F.col("target").isNotNull(), F.col("legacy") & F.col("metric").isin(*STRUCTURAL)
    short = ~matched & F.col("metric").isin(*LENGTH_DEPENDENT)
    ref = F.when(structural | short, None).when(matched, F.col("mid")).otherwise(F.col("base"))
    why = F.when(structural, "no original paragraphs").when(short, "reference is shorter").when(matched & F.col("mid").isNotNull(), None).when(matched, F.coalesce("why", F.lit("no comparable windows"))).otherwise(F.col("base_why"))
    j = j.withColumn("ref", ref).withColumn("no", F.coalesce("reason", why))
    delta = F.when(F.col("no").isNull(), F.bround(F.col("value") - F.col("ref"), places))
    j = j.withColumn("delta", delta)
    band = lambda c: F.when(F.col("delta").isNotNull(), F.col(c)).alias(c)
    return j.select("unit_id", "metric", F.col("ref").alias("reference"), band("q25"), band("q75"), F.coalesce("windows", F.lit(0)).alias("windows"), "delta", F.col("no").alias("reason"))


def gated(u: DataFrame) -> DataFrame:
    """unit_id, lang, n, metric, value, reason."""
    return M.gated(M.wide(u))
