"""Where each finding is: located evidence, decisions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..lexicons import LEXICONS, NOMINAL
from .metrics import LONG_SENTENCE, NEAR, by_language, is_passive, is_stop, own_words


def token_offsets(u: DataFrame) -> DataFrame:
    """unit_id, lang, pos, word, start, end: code points of every word in the stored text."""
    mark = "\u0003"
    parts = F.split(F.regexp_replace("text", f"({T.WORD})", f"{mark}$1{mark}"), mark)
    p = u.select("unit_id", "lang", F.posexplode(parts).alias("i", "part"))
    # every second part is a word; lengths before it add up to its place
    before = F.sum(F.length("part")).over(Window.partitionBy("unit_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    o = p.withColumn("start", F.coalesce(before, F.lit(0))).where("i % 2 = 1")
    return o.select("unit_id", "lang", F.expr("cast((i - 1) / 2 as int)").alias("pos"), T.plain(F.col("part")).alias("word"), F.col("start").cast("int").alias("start"), (F.col("start") + F.length("part")).cast("int").alias("end"))


def near_repeats(offsets: DataFrame) -> DataFrame:
    """unit_id, metric, start, end: words that occurred within the 20 words before."""
    prev = F.lag("pos").over(Window.partitionBy("unit_id", "word").orderBy("pos"))
    hit = offsets.where(~is_stop(F.col("word"), F.col("lang"))).withColumn("gap", F.col("pos") - prev)
    return hit.where(F.col("gap") <= NEAR).select("unit_id", F.lit("nearRepeat").alias("metric"), "start", "end")


def lexicon_hits(offsets: DataFrame, name: str, words: dict[str, list[str]]) -> DataFrame:
    hit = F.when(F.col("lang") == "de", F.col("word").isin(words["de"])).when(F.col("lang") == "en", F.col("word").isin(words["en"]))
    return offsets.where(hit).select("unit_id", F.lit(name).alias("metric"), "start", "end")


def ending_hits(offsets: DataFrame) -> DataFrame:
    """Words with the endings of abstract nouns and of adverbs."""
    w, lang = F.col("word"), F.col("lang")
    nominal = (F.length(w) >= 6) & by_language(lang, w.rlike(NOMINAL["de"]), w.rlike(NOMINAL["en"]))
    adverb = (F.length(w) >= 5) & by_language(lang, w.endswith("weise"), w.endswith("ly"))
    kinds = F.filter(F.array(F.when(nominal, "nominal"), F.when(adverb, "adverbs")), lambda k: k.isNotNull())
    return offsets.select("unit_id", F.explode(kinds).alias("metric"), "start", "end")


def _parts(u: DataFrame, marked: Column) -> DataFrame:
    """unit_id, lang, start, end, body, words, len of the parts between END marks that hold a word, without blanks around."""
    p = u.select("unit_id", "lang", F.posexplode(F.split(marked, T.END)).alias("i", "part"))
    before = F.sum(F.length("part")).over(Window.partitionBy("unit_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    tail = F.regexp_replace("part", rf"^{T.WS}+", "")
    p = p.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("part") - F.length(tail)).withColumn("body", F.regexp_replace(F.regexp_replace(tail, rf"{T.WS}+\z", ""), T.POINT, "."))
    p = p.where(F.col("body").rlike(T.WORD)).withColumn("words", T.words(F.col("body")))
    return p.select("unit_id", "lang", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("body")).cast("int").alias("end"), "body", "words", F.size("words").alias("len"))


def sentence_offsets(u: DataFrame) -> DataFrame:
    return _parts(u, T.marked_sentences(F.col("text")))


def paragraph_offsets(u: DataFrame) -> DataFrame:
    return _parts(u, F.regexp_replace("text", f"({T.PARAGRAPH_BREAK})", f"$1{T.END}"))


def _again(df: DataFrame, key: Column, metric: str, end: Column | None = None) -> DataFrame:
    """Second and further occurrences of a key in a unit."""
    n = F.row_number().over(Window.partitionBy("unit_id", "key").orderBy("start"))
    rows = df.withColumn("key", key).withColumn("n", n).where("n > 1")
    return rows.select("unit_id", F.lit(metric).alias("metric"), "start", (F.col("end") if end is None else end).cast("int").alias("end"))


def sentence_hits(sent: DataFrame, long_sentence: int = LONG_SENTENCE) -> DataFrame:
    """Long sentences, comma chains, passive candidates, repeated sentences and openings."""
    flags = {"longSentences": F.col("len") > long_sentence, "commaChains": F.regexp_count("body", F.lit(",")) >= 4, "passive": is_passive(F.col("lang"))}
    kinds = F.filter(F.array(*(F.when(c, k) for k, c in flags.items())), lambda k: k.isNotNull())
    plain = sent.select("unit_id", F.explode(kinds).alias("metric"), "start", "end")
    opening = F.length(F.regexp_extract("body", rf"^(?s:.*?){T.WORD}(?s:.*?){T.WORD}", 0))
    again = _again(sent.where("len >= 5"), F.concat_ws(" ", "words"), "sentenceRepeat")
    starts = _again(sent.where("len >= 2"), F.concat_ws(" ", F.slice("words", 1, 2)), "startRepeat", F.col("start") + opening)
    return plain.unionByName(again).unionByName(starts)


def phrase_hits(sent: DataFrame) -> DataFrame:
    """The first place of every three-word phrase that occurs twice or more."""
    o = token_offsets(sent.select(F.struct("unit_id", "start").alias("unit_id"), "lang", F.col("body").alias("text")))
    w = Window.partitionBy("unit_id").orderBy("pos")
    base = F.col("unit_id.start")
    g = o.select(F.col("unit_id.unit_id").alias("unit"), F.concat_ws(" ", "word", F.lead("word", 1).over(w), F.lead("word", 2).over(w)).alias("gram"), (base + F.col("start")).alias("a"), (base + F.lead("end", 2).over(w)).alias("b"))
    c = g.where("b is not null").groupBy("unit", "gram").agg(F.count("*").alias("f"), F.min(F.struct("a", "b")).alias("first")).where("f >= 2")
    return c.select(F.col("unit").alias("unit_id"), F.lit("trigramRepeat").alias("metric"), F.col("first.a").cast("int").alias("start"), F.col("first.b").cast("int").alias("end"))


def paragraph_hits(par: DataFrame) -> DataFrame:
    """Repeated paragraphs of at least 12 words, and paragraphs that share few words with the one before."""
    p = par.withColumn("own", own_words(F.col("lang"))).withColumn("before", F.lag("own").over(Window.partitionBy("unit_id").orderBy("start")))
    jaccard = F.when((F.size("own") > 0) & (F.size("before") > 0), F.size(F.array_intersect("own", "before")) / F.size(F.array_union("own", "before")))
    shifts = p.where((jaccard < 0.05) & F.col("lang").isin("de", "en")).select("unit_id", F.lit("shifts").alias("metric"), "start", "end")
    return _again(par.where("len >= 12"), F.concat_ws(" ", "words"), "paragraphRepeat").unionByName(shifts)


def index(u: DataFrame) -> DataFrame:
    """unit_id, metric, start, end of every finding of every metric that has places."""
    tok, sent = token_offsets(u), sentence_offsets(u)
    spoken = tok.where(F.col("lang").isin("de", "en"))
    parts = [near_repeats(spoken), ending_hits(spoken), sentence_hits(sent), phrase_hits(sent), paragraph_hits(paragraph_offsets(u))]
    parts += [lexicon_hits(spoken, k, {lang: w.split() for lang, w in v.items()}) for k, v in LEXICONS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shown(evidence: DataFrame, k: int = 6) -> DataFrame:
    """The first six findings a unit and metric."""
    order = Window.partitionBy("unit_id", "metric").orderBy("start", "end")
    return evidence.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def excerpts(evidence: DataFrame, u: DataFrame, before: int = 90, inside: int = 220, after: int = 90) -> DataFrame:
    """Text around each finding; joined late, so only shown findings meet their text."""
    e = evidence.join(u.select("unit_id", "text"), "unit_id")
    lo = F.greatest(F.lit(0), F.col("start") - before)
    return e.select(
        *evidence.columns,
        F.substring("text", lo + 1, F.col("start") - lo).alias("before"),
        F.substring("text", F.col("start") + 1, F.least(F.lit(inside), F.col("end") - F.col("start"))).alias("hit"),
        F.substring("text", F.col("end") + 1, F.lit(after)).alias("after"),
        (F.col("end") - F.col("start") > inside).alias("truncated"),
    )


def with_decisions(evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds intentional: true where a decision on (unit_id, metric, start, end) exists."""
    key = ["unit_id", "metric", "start", "end"]
    return evidence.join(decisions.select(*key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("intentional", F.coalesce("hit", F.lit(False))).drop("hit")


def current_decisions(decisions: DataFrame, u: DataFrame) -> DataFrame:
    """The decisions whose text_sha256 is that of the unit's text as it is now; others were made on another text and are rejected."""
    now = u.select("unit_id", F.sha2("text", 256).alias("text_sha256"))
    return decisions.join(now, ["unit_id", "text_sha256"], "left_semi")


def filtered(evidence: DataFrame, metric: str | None = None, status: str = "all") -> DataFrame:
    """Findings of one metric (null: of all) that are open, intentional or all."""
    if status not in ("open", "intentional", "all"):
        raise ValueError(f"unknown status {status}")
    e = evidence if metric is None else evidence.where(F.col("metric") == metric)
    return e if status == "all" else e.where(F.col("intentional") if status == "intentional" else ~F.col("intentional"))


def page(evidence: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page in order of (unit_id, start, end, metric); limit 1 to 50, the offset moved back to the last page that has rows."""
    limit = max(1, min(50, limit))
    n = evidence.count()
    offset = min(max(0, offset), max(0, (n - 1) // limit * limit))
    return evidence.orderBy("unit_id", "start", "end", "metric").offset(offset).limit(limit)
