"""The 51 text metrics of any unit of text.

A unit is a row (unit_id, lang, text); documents, chapters, segments and
reference windows go through the same plan.  Words, sentences and paragraphs are
exploded once each and aggregated per unit; every family is one frame with one
row a unit, joined on unit_id at the end.  Windows and groups are keyed by the
unit and the word, so no unit is collected into one row and long units spread
over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import METRICS, REASONS
from ..functions import text as T
from ..functions.unicode import mtld
from ..lexicons import LEXICONS, NOMINAL, PARTICIPLES_EN, PASSIVE_AUXILIARIES, STOP

LONG_SENTENCE = 30
NEAR = 20
WINDOW = 100


def units(df: DataFrame, key: str, lang: str, text: str) -> DataFrame:
    """unit_id, lang (de, en or und), text.  Null texts are empty units."""
    language = F.when(F.col(lang).isin("de", "en"), F.col(lang)).otherwise("und")
    return df.select(F.col(key).alias("unit_id"), language.alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def tokens(u: DataFrame) -> DataFrame:
    """unit_id, lang, pos (0-based), word."""
    return u.select("unit_id", "lang", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))


def sentence_rows(u: DataFrame) -> DataFrame:
    """unit_id, lang, sent (0-based), sentence, its words and their number."""
    s = u.select("unit_id", "lang", F.posexplode(T.sentences(F.col("text"))).alias("sent", "sentence"))
    return s.withColumn("words", T.words(F.col("sentence"))).withColumn("len", F.size("words"))


def paragraph_rows(u: DataFrame) -> DataFrame:
    p = u.select("unit_id", "lang", F.posexplode(T.paragraphs(F.col("text"))).alias("par", "paragraph"))
    return p.withColumn("words", T.words(F.col("paragraph"))).withColumn("len", F.size("words"))


def is_stop(word: Column, lang: Column) -> Column:
    return F.when(lang == "de", word.isin(sorted(set(STOP["de"])))).when(lang == "en", word.isin(STOP["en"])).otherwise(False)


def by_language(lang: Column, de: Column, en: Column) -> Column:
    return F.when(lang == "de", de).when(lang == "en", en).otherwise(False)


def share(part: Column, whole: Column) -> Column:
    """Percentage; null where there is nothing to share."""
    return F.when(whole > 0, 100.0 * part / whole)


def frequencies(tok: DataFrame) -> DataFrame:
    """unit_id, lang, word, f, first_pos: partial counts before the shuffle."""
    return tok.groupBy("unit_id", "lang", "word").agg(F.count("*").alias("f"), F.min("pos").alias("first_pos"))


def vocabulary(freq: DataFrame, *more: Column) -> DataFrame:
    """Word counts, readability sums and the vocabulary metrics (and ``more`` sums); word properties are computed once a distinct word."""
    w, lang, f = F.col("word"), F.col("lang"), F.col("f")
    d = freq.withColumn("k", T.letters(w)).withColumn("syl", T.syllables(w, lang))
    hit = lambda name: by_language(lang, w.isin(LEXICONS[name]["de"].split()), w.isin(LEXICONS[name]["en"].split()))
    nominal = (F.length(w) >= 6) & by_language(lang, w.rlike(NOMINAL["de"]), w.rlike(NOMINAL["en"]))
    adverb = (F.length(w) >= 5) & by_language(lang, w.endswith("weise"), w.endswith("ly"))
    weigh = lambda c: F.sum(F.when(c, f).otherwise(0))
    n = F.sum(f)
    v = d.groupBy("unit_id", "lang").agg(
        n.alias("n"), F.count("*").alias("types"), F.sum(f * F.col("k")).alias("letters"), F.sum(f * F.col("syl")).alias("syl"),
        weigh(F.col("k") > 6).alias("long"), weigh(F.col("k") >= 6).alias("six"), weigh(F.col("syl") >= 3).alias("multi"), weigh(F.col("syl") == 1).alias("mono"),
        F.sum(f * F.log2(f)).alias("flog"), F.sum(f * (f - 1)).alias("ff"), F.sum(f * f).alias("f2"), F.count_if(f == 1).alias("once"),
        weigh(~is_stop(w, lang)).alias("content"), weigh(nominal).alias("nominal_n"), weigh(adverb).alias("adverbs_n"),
        *(weigh(hit(x)).alias(f"{x}_n") for x in LEXICONS), *more,
    )
    n = F.col("n")
    cols = {
        "entropy": F.log2(n) - F.col("flog") / n,
        "simpson": F.when(n > 1, 100 * (1 - F.col("ff") / (n * (n - 1)))),
        "yule": 10000.0 * (F.col("f2") - n) / (n * n),
        "hapax": share(F.col("once"), F.col("types")),
        "wordLength": F.col("letters") / n,
        "longWords": share(F.col("long"), n),
        **{x: share(F.col(f"{x}_n"), n) for x in (*LEXICONS, "nominal", "adverbs")},
    }
    return v.withColumns(cols)


def keywords(freq: DataFrame, k: int = 20) -> DataFrame:
    """unit_id, rank, word, f: the most frequent words that are no stop words, ties by first occurrence."""
    c = freq.where(F.col("lang").isin("de", "en") & ~is_stop(F.col("word"), F.col("lang")))
    order = Window.partitionBy("unit_id").orderBy(F.desc("f"), "first_pos")
    return c.select("unit_id", F.row_number().over(order).alias("rank"), "word", "f").where(F.col("rank") <= k)


def is_passive(lang: Column) -> Column:
    """A sentence (its ``words``) with an auxiliary and a participle candidate."""
    has = lambda words: F.arrays_overlap("words", F.array(*map(F.lit, words)))
    de = has(PASSIVE_AUXILIARIES["de"]) & F.exists("words", lambda w: w.rlike("^(?:ge.{2,}(?:t|en)|.{3,}iert)$"))
    en = has(PASSIVE_AUXILIARIES["en"]) & F.exists("words", lambda w: (F.length(w) >= 5) & (w.endswith("ed") | w.endswith("en")) | w.isin(PARTICIPLES_EN))
    return by_language(lang, de, en)


def own_words(lang: Column) -> Column:
    """Distinct words of a paragraph of at least 12 words that are no stop words; none of a shorter one."""
    content = F.array_distinct(F.filter("words", lambda w: ~is_stop(w, lang)))
    return F.when(F.col("len") >= 12, content).otherwise(F.array().cast("array<string>"))


def rhythm(sent: DataFrame, long_sentence: int = LONG_SENTENCE) -> DataFrame:
    """Sentence lengths and their change, and the sentence counts of the style metrics."""
    lang, s = F.col("lang"), F.col("sentence")
    nxt = F.lead("len").over(Window.partitionBy("unit_id").orderBy("sent"))
    t = sent.select(
        "unit_id", "sent", F.col("len").cast("double").alias("len"), nxt.cast("double").alias("nxt"), F.contains(s, F.lit("?")).alias("q"), F.contains(s, F.lit("!")).alias("x"), F.regexp_count(s, F.lit(",")).alias("c"), is_passive(lang).alias("passive")
    )
    count = lambda c: F.sum(c.cast("int"))
    a = t.groupBy("unit_id").agg(
        F.count("*").alias("sentences"), F.sum("len").alias("total"), F.stddev_pop("len").alias("sd"), F.percentile("len", F.lit(0.9)).alias("sentenceP90"),
        count(F.col("len") > long_sentence).alias("long_s"), count(F.col("len") <= 5).alias("short_s"), F.avg(F.abs(F.col("len") - F.col("nxt"))).alias("step"),
        F.try_divide(F.covar_pop("len", "nxt"), F.stddev_pop(F.when(F.col("nxt").isNotNull(), F.col("len"))) * F.stddev_pop("nxt")).alias("lag1"),
        count(F.col("q")).alias("q"), count(F.col("x")).alias("x"), count(F.col("c") >= 4).alias("chains"), count(F.col("passive")).alias("passive_s"),
    )
    n = F.col("sentences")
    mean = F.col("total") / n
    return a.select(
        "unit_id", "sentences", mean.alias("sentenceMean"), (F.col("sd") / mean).alias("sentenceCV"), "sentenceP90", share(F.col("long_s"), n).alias("longSentences"), share(F.col("short_s"), n).alias("shortSentences"),
        (F.col("step") / mean).alias("rhythmChange"), F.when(n >= 10, F.col("lag1")).alias("rhythmLag"), share(F.col("q"), n).alias("questions"), share(F.col("x"), n).alias("exclamations"), share(F.col("chains"), n).alias("commaChains"), share(F.col("passive_s"), n).alias("passive"),
    )


def trigrams(sent: DataFrame) -> DataFrame:
    """unit_id, gram, f: three words in a row within a sentence."""
    grams = F.when(F.col("len") >= 3, F.transform(F.sequence(F.lit(1), F.col("len") - 2), lambda i: F.concat_ws(" ", F.slice("words", i, 3))))
    return sent.select("unit_id", "sent", F.posexplode(grams).alias("at", "gram")).groupBy("unit_id", "gram").agg(F.count("*").alias("f"), F.min(F.struct("sent", "at")).alias("first"))


def phrases(sent: DataFrame, k: int = 16) -> DataFrame:
    """unit_id, rank, phrase, f: the most frequent repeated three-word phrases, ties by first occurrence."""
    t = trigrams(sent).where("f >= 2")
    order = Window.partitionBy("unit_id").orderBy(F.desc("f"), "first")
    return t.select("unit_id", F.row_number().over(order).alias("rank"), F.col("gram").alias("phrase"), "f").where(F.col("rank") <= k)


def paragraph_metrics(par: DataFrame) -> DataFrame:
    """Paragraph lengths and the word overlap of neighbours; a paragraph under 12 words parts its neighbours."""
    lang = F.col("lang")
    p = par.select("unit_id", "par", F.col("len").cast("double").alias("len"), own_words(lang).alias("own"))
    p = p.withColumn("before", F.lag("own").over(Window.partitionBy("unit_id").orderBy("par")))
    jaccard = F.when((F.size("own") > 0) & (F.size("before") > 0), F.size(F.array_intersect("own", "before")) / F.size(F.array_union("own", "before")))
    a = p.withColumn("j", jaccard).groupBy("unit_id").agg(
        F.count("*").alias("paragraphs"), F.avg("len").alias("paragraphMean"), F.stddev_pop("len").alias("sd"), (100 * F.avg("j")).alias("cohesion"), share(F.count_if(F.col("j") < 0.05), F.count("j")).alias("shifts")
    )
    return a.select("unit_id", "paragraphs", "paragraphMean", F.when(F.col("paragraphs") >= 3, F.col("sd") / F.col("paragraphMean")).alias("paragraphCV"), "cohesion", "shifts")


def _marks() -> dict[str, Column]:
    t = F.col("text")
    n = T.word_count(t)
    count = lambda rx: F.regexp_count(t, F.lit(rx))
    hyphens = F.regexp_count(t, F.lit(r"(?<![^\s\x{A0}])-(?![^\s\x{A0}])"))
    quoted = F.aggregate(F.regexp_extract_all(t, F.lit(f"({T.QUOTED})"), F.lit(1)), F.lit(0), lambda acc, q: acc + F.regexp_count(q, F.lit(T.WORD)))
    parts = {"commas": count(","), "dashes": count(T.DASH) + hyphens, "parentheses": count(r"[(\[]"), "ellipses": count(T.ELLIPSIS), "dialogue": quoted}
    return {k: share(c, n) for k, c in parts.items()}


def punctuation(u: DataFrame) -> DataFrame:
    """Marks per hundred words and the share of words in paired quotes, without exploding anything."""
    return u.select("unit_id", *(c.alias(k) for k, c in _marks().items()))


def per_text(u: DataFrame) -> DataFrame:
    """Everything that needs no exploding: language, marks, MTLD."""
    return u.select("unit_id", "lang", mtld(T.words(F.col("text"))).alias("mtld"), *(c.alias(k) for k, c in _marks().items()))


def lexical_stretch(u: DataFrame) -> DataFrame:
    """MTLD, a fold over the words of a unit in order: the one metric that needs Python."""
    return u.select("unit_id", mtld(T.words(F.col("text"))).alias("mtld"))


def formulas() -> dict[str, Column]:
    """Readability from word sums (n, syl, long, six, multi, mono) and the number of sentences."""
    n, s = F.col("n"), F.col("sentences")
    length, syl = n / s, F.col("syl") / n
    return {
        "lix": length + 100.0 * F.col("long") / n,
        "rix": F.col("long") / s,
        "fleschDe": 180 - length - 58.5 * syl,
        "fleschEn": 206.835 - 1.015 * length - 84.6 * syl,
        "fkGrade": 0.39 * length + 11.8 * syl - 15.59,
        "wiener": 19.35 * F.col("multi") / n + 0.1672 * length + 12.97 * F.col("six") / n - 3.27 * F.col("mono") / n - 0.875,
    }


def readability(v: DataFrame, r: DataFrame) -> DataFrame:
    """The formulas over the sums of ``vocabulary`` and ``rhythm``."""
    x = v.select("unit_id", "n", "syl", "long", "six", "multi", "mono").join(r.select("unit_id", "sentences"), "unit_id")
    return x.select("unit_id", *(c.alias(k) for k, c in formulas().items()))


def word_metrics(u: DataFrame, sample: int = 42) -> DataFrame:
    """All metrics over words in one pass: a shuffle by unit and word for the places of each word, one by unit for the sums."""
    lists = u.select("unit_id", "lang", T.words(F.col("text")).alias("ws"))
    t = lists.select("unit_id", "lang", F.size("ws").alias("size"), F.posexplode("ws").alias("pos", "word"))
    prev = F.lag("pos").over(Window.partitionBy("unit_id", "word").orderBy("pos"))
    t = t.withColumn("prev", prev)
    pos, size = F.col("pos"), F.col("size")
    new = F.greatest(F.lit(0), F.least(pos, size - WINDOW) - F.greatest(F.coalesce(F.col("prev"), F.lit(-1)) + 1, pos - WINDOW + 1, F.lit(0)) + 1)
    near = (pos - F.col("prev") <= NEAR).cast("int")
    w = t.groupBy("unit_id", "word", "lang", "size").agg(F.count("*").alias("f"), F.min("pos").alias("first_pos"), F.sum(new).alias("new"), F.coalesce(F.sum(near), F.lit(0)).alias("near"))
    w = w.withColumn("stop", is_stop(F.col("word"), F.col("lang")))
    # the ten largest counts: every task keeps ten a unit before they are shuffled, and equal ones are alike in the sum
    ranked = w.where(~F.col("stop")).select("unit_id", "f", F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("f"))).alias("r"))
    top = ranked.where("r <= 10").groupBy("unit_id").agg(F.sum("f").alias("top"))
    # chance that a type is not drawn, as a product over its occurrences
    missed = F.aggregate(F.sequence(F.lit(0), (F.col("f") - 1).cast("int")), F.lit(1.0), lambda acc, k: acc * (size - sample - k) / (size - k))
    drawn = F.when(size >= sample, 1 - F.when(size - F.col("f") < sample, 0.0).otherwise(missed))
    v = vocabulary(
        w, F.sum("new").alias("windows"), F.sum(F.when(~F.col("stop"), F.col("near"))).alias("repeats"), F.sum(drawn).alias("drawn")
    )
    v = v.join(top, "unit_id", "left")
    n = F.col("n")
    return v.withColumns(
        {
            "mattr": F.when(n >= WINDOW, 100.0 * F.col("windows") / (WINDOW * (n - WINDOW + 1))),
            "nearRepeat": share(F.coalesce("repeats", F.lit(0)), F.col("content")),
            "topWords": share(F.col("top"), F.col("content")),
            "hdd": 100.0 / sample * F.col("drawn"),
        }
    )


def repetition(u: DataFrame) -> DataFrame:
    """Shares of repeated phrases, sentences, openings and paragraphs from one scan and one shuffle: every unit lists its keys, marked by kind."""
    text = F.col("text")
    key = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    lists = u.select("unit_id", F.transform(T.sentences(text), T.words).alias("s"), F.transform(T.paragraphs(text), T.words).alias("p"))
    join = lambda ws: F.concat_ws(" ", ws)
    grams = F.flatten(F.transform(F.filter("s", lambda w: F.size(w) >= 3), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: join(F.slice(w, i, 3)))))
    parts = {
        "trigramRepeat": grams,
        "sentenceRepeat": F.transform(F.filter("s", lambda w: F.size(w) >= 5), join),
        "startRepeat": F.transform(F.filter("s", lambda w: F.size(w) >= 2), lambda w: join(F.slice(w, 1, 2))),
        "paragraphRepeat": F.transform(F.filter("p", lambda w: F.size(w) >= 12), join),
    }
    keys = lists.select("unit_id", F.inline(F.concat(*(F.transform(v, key(k)) for k, v in parts.items()))))
    c = keys.groupBy("unit_id", "kind", "key").agg(F.count("*").alias("f"))
    of = lambda k, x: F.sum(F.when(F.col("kind") == k, x))
    return c.groupBy("unit_id").agg(*(share(of(k, F.col("f") - 1), of(k, F.col("f"))).alias(k) for k in parts))


def wide(u: DataFrame, long_sentence: int = LONG_SENTENCE) -> DataFrame:
    """unit_id, lang, words and all metrics, without the gates.  The texts are scanned once a family: five times in all."""
    base = per_text(u)
    drop = ("lang", "letters", "flog", "ff", "f2", "once", "content", "types", "windows", "repeats", "top", "drawn", *(f"{x}_n" for x in (*LEXICONS, "nominal", "adverbs")))
    out = reduce(lambda a, b: a.join(b, "unit_id", "left"), [word_metrics(u).drop(*drop), rhythm(sentence_rows(u), long_sentence), repetition(u), paragraph_metrics(paragraph_rows(u))], base)
    out = out.withColumns(formulas())
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def profile(u: DataFrame, groups: list[str] | None = None, long_sentence: int = LONG_SENTENCE) -> DataFrame:
    """unit_id, metric, value, reason: every metric of every unit; a value is null exactly where a reason stands.

    The gates come in this order: group switched off, language, number of words,
    no value.  Values are rounded half-even to four places.
    """
    return gated(wide(u, long_sentence), groups).drop("n")


def gated(w: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """unit_id, lang, n, metric, value, reason of the wide form (see ``profile``)."""
    ids = [m.id for m in METRICS]
    long = w.select("unit_id", "lang", "n", *(F.col(i).cast("double").alias(i) for i in ids)).unpivot(["unit_id", "lang", "n"], ids, "metric", "value")
    metric, v = F.col("metric"), F.col("value")
    reason = F.when(metric.isin([m.id for m in METRICS if groups is not None and m.group not in groups] or [""]), REASONS["disabled"])
    for spoken in {m.languages for m in METRICS if "und" not in m.languages}:
        reason = reason.when(metric.isin([m.id for m in METRICS if m.languages == spoken]) & ~F.col("lang").isin(*spoken), REASONS["language"])
    for least in {m.min_words for m in METRICS}:
        reason = reason.when(metric.isin([m.id for m in METRICS if m.min_words == least]) & (F.col("n") < least), REASONS["short"])
    missing = v.isNull() | F.isnan(v)
    for i in ids:
        if i in REASONS:
            reason = reason.when(missing & (metric == i), REASONS[i])
    long = long.withColumn("reason", reason.when(missing, REASONS["other"]))
    return long.select("unit_id", "lang", "n", "metric", F.when(F.col("reason").isNull(), F.bround("value", 4)).alias("value"), "reason")


def cadence(sent: DataFrame, bins: int = 160) -> DataFrame:
    """unit_id, bin, first, last, mean, low, high: sentence lengths in at most ``bins`` steps; the mean at two places, half to even."""
    n = F.count("*").over(Window.partitionBy("unit_id"))
    b = sent.select("unit_id", "sent", "len", F.floor(F.col("sent") / F.greatest(F.lit(1), F.ceil(n / bins))).alias("bin"))
    return b.groupBy("unit_id", "bin").agg((F.min("sent") + 1).alias("first"), (F.max("sent") + 1).alias("last"), F.bround(F.avg("len"), 2).alias("mean"), F.min("len").alias("low"), F.max("len").alias("high"))


def histogram(sent: DataFrame) -> DataFrame:
    """Sentences of 1-5, 6-10, 11-15, 16-20, 21-30, 31-40 and more words."""
    edges = [1, 6, 11, 16, 21, 31, 41]
    between = lambda a, b: (F.col("len") >= a) & (F.col("len") < b) if b else F.col("len") >= a
    return sent.groupBy("unit_id").agg(*(F.count_if(between(a, b)).alias(f"len_{a}") for a, b in zip(edges, [*edges[1:], None], strict=True)))


def basic(u: DataFrame) -> DataFrame:
    """unit_id, words, sentences, sentenceMean, sentenceCV, mattr, dialogue (100 at most), paragraphs and the sentence histogram: what an import shows at once."""
    sent = sentence_rows(u)
    parts = [
        word_metrics(u).select("unit_id", F.col("n").alias("words"), "mattr"), rhythm(sent).select("unit_id", "sentences", "sentenceMean", "sentenceCV"), histogram(sent),
        punctuation(u).select("unit_id", F.least(F.lit(100.0), "dialogue").alias("dialogue")), paragraph_rows(u).groupBy("unit_id").agg(F.count("*").alias("paragraphs")),
    ]
    return reduce(lambda a, b: a.join(b, "unit_id", "left"), parts, u.select("unit_id")).fillna(0, ["words", "sentences", "paragraphs", *(f"len_{a}" for a in (1, 6, 11, 16, 21, 31, 41))])
