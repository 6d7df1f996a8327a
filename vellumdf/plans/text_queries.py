"""Text metrics over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..catalog import METRICS, REASONS
from ..lexicons import LEXICONS, NOMINAL, PARTICIPLES_EN, PASSIVE_AUXILIARIES
from ..operators import evidence as E
from ..operators import metrics as M
from ..tables import table
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return M.units(table(spark, d, "documents"), "doc_id", "lang", "text")


def sections(spark: SparkSession, d: str) -> DataFrame:
    return M.units(table(spark, d, "book_sections"), "section_id", "language", "content")


DOCS = S.units()
SECTIONS = S.units("book_sections", "section_id", "language", "content")


def r6(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles at six places: engines add in different orders."""
    return df.select(*(c if c in keep or t != "double" else F.round(c, 6).alias(c) for c, t in df.dtypes))


@query(f"WITH {DOCS}, {S.TOKENS}, {S.FREQ} SELECT unit_id, word, f, first_pos FROM freq")
def word_freq(spark, d):
    return M.frequencies(M.tokens(docs(spark, d))).select("unit_id", "word", "f", "first_pos")


_IMPORT = T.IMPORT_WORD.replace("'", "''")


@query(f"WITH {DOCS} SELECT unit_id, len(regexp_extract_all(text, '{S.Q}'))::INT AS words, len(regexp_extract_all(text, '{_IMPORT}'))::INT AS import_words FROM units")
def token_count(spark, d):
    t = F.col("text")
    return docs(spark, d).select("unit_id", T.word_count(t).alias("words"), T.word_count(t, T.IMPORT_WORD).alias("import_words"))


@query(f"""WITH {DOCS}, {S.TOKENS}, {S.FREQ}, x AS (SELECT *, sum(f) OVER (PARTITION BY unit_id) AS n, {S.LETTERS} AS k FROM freq)
SELECT unit_id, any_value(n)::BIGINT AS n, count(*) AS types, round(-sum(f / n * log2(f / n)), 6) AS entropy,
  round(CASE WHEN any_value(n) > 1 THEN 100 * (1 - sum(f * (f - 1)) / (any_value(n) * (any_value(n) - 1))) END, 6) AS simpson,
  round(10000 * (sum(f * f) - any_value(n)) / (any_value(n) * any_value(n)), 6) AS yule, round(100 * count(*) FILTER (f = 1) / count(*), 6) AS hapax,
  round(sum(f * k) / any_value(n), 6) AS "wordLength", round(100 * sum(CASE WHEN k > 6 THEN f ELSE 0 END) / any_value(n), 6) AS "longWords" FROM x GROUP BY unit_id""")
def vocab_metrics(spark, d):
    v = M.vocabulary(M.frequencies(M.tokens(docs(spark, d))))
    return r6(v.select("unit_id", "n", "types", "entropy", "simpson", "yule", "hapax", "wordLength", "longWords"))


@query(f"""WITH {DOCS}, {S.TOKENS}, {S.FREQ}, x AS (SELECT unit_id, f, sum(f) OVER (PARTITION BY unit_id) AS n FROM freq),
  y AS (SELECT unit_id, f, n, CASE WHEN n - f < 42 THEN 0 ELSE exp((lgamma(n - f + 1.0) - lgamma(n - f - 41.0)) - (lgamma(n + 1.0) - lgamma(n - 41.0))) END AS miss FROM x WHERE n >= 42)
SELECT unit_id, round(sum(1 - miss) * 100 / 42, 5) AS hdd FROM y GROUP BY unit_id""")
def vocab_hdd(spark, d):
    return M.word_metrics(docs(spark, d)).where("n >= 42").select("unit_id", F.round("hdd", 5).alias("hdd"))


@query(f"""WITH {DOCS}, {S.TOKENS}, a AS (SELECT unit_id, lang, word, pos, lag(pos) OVER (PARTITION BY unit_id, word ORDER BY pos) AS prev, count(*) OVER (PARTITION BY unit_id) AS n, {S.IS_STOP} AS stop FROM tokens)
SELECT unit_id, round(CASE WHEN any_value(n) >= 100 THEN 100.0 * sum(greatest(0, least(pos, n - 100) - greatest(coalesce(prev, -1) + 1, pos - 99, 0) + 1)) / (100 * (any_value(n) - 99)) END, 6) AS mattr,
  round(CASE WHEN count(*) FILTER (NOT stop) > 0 THEN 100.0 * count(*) FILTER (NOT stop AND pos - prev <= 20) / count(*) FILTER (NOT stop) END, 6) AS "nearRepeat" FROM a GROUP BY unit_id""")
def vocab_mattr_near(spark, d):
    return r6(M.word_metrics(docs(spark, d)).select("unit_id", "mattr", "nearRepeat"))


@query(f"""WITH {DOCS}, {S.TOKENS}, {S.FREQ}, c AS (SELECT unit_id, f, row_number() OVER (PARTITION BY unit_id ORDER BY f DESC, first_pos) AS r FROM freq WHERE NOT {S.IS_STOP})
SELECT unit_id, round(100.0 * sum(f) FILTER (r <= 10) / sum(f), 6) AS "topWords" FROM c GROUP BY unit_id""")
def top_words_share(spark, d):
    return r6(M.word_metrics(docs(spark, d)).where("content > 0").select("unit_id", "topWords"))


@query(f"""WITH {DOCS}, {S.TOKENS}, {S.FREQ} SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY f DESC, first_pos)::INT AS rank, word, f FROM freq WHERE lang IN ('de','en') AND NOT {S.IS_STOP} QUALIFY rank <= 20""")
def keywords_top20(spark, d):
    return M.keywords(M.frequencies(M.tokens(docs(spark, d))))


_RATES = ", ".join(f'round(100.0 * count(*) FILTER ({S.in_lexicon(x)}) / count(*), 6) AS "{x}"' for x in LEXICONS)
_NOM = f"length(word) >= 6 AND ((lang = 'de' AND regexp_matches(word, '{NOMINAL['de']}')) OR (lang = 'en' AND regexp_matches(word, '{NOMINAL['en']}')))"
_ADV = "length(word) >= 5 AND ((lang = 'de' AND suffix(word, 'weise')) OR (lang = 'en' AND suffix(word, 'ly')))"


@query(f"WITH {DOCS}, {S.TOKENS} SELECT unit_id, {_RATES}, round(100.0 * count(*) FILTER ({_NOM}) / count(*), 6) AS nominal, round(100.0 * count(*) FILTER ({_ADV}) / count(*), 6) AS adverbs FROM tokens GROUP BY unit_id")
def lexicon_rates(spark, d):
    v = M.vocabulary(M.frequencies(M.tokens(docs(spark, d))))
    return r6(v.select("unit_id", *LEXICONS, "nominal", "adverbs"))


def _per100(n: str) -> str:
    return f"round(100.0 * {n} / nullif(len(regexp_extract_all(text, '{S.Q}')), 0), 6)"


@query(rf"""WITH {DOCS} SELECT unit_id, {_per100("(length(text) - length(replace(text, ',', '')))")} AS commas,
  {_per100(r"(len(regexp_extract_all(text, '[—–]')) + len(regexp_extract_all(regexp_replace(' ' || text || ' ', '([\s\x{A0}])-', '\1' || chr(1), 'g'), chr(1) || '[\s\x{A0}]')))")} AS dashes,
  {_per100(r"len(regexp_extract_all(text, '[\[(]'))")} AS parentheses, {_per100(r"len(regexp_extract_all(text, '…|\.{3,}'))")} AS ellipses,
  {_per100(f"list_sum(list_transform(list_prepend('', regexp_extract_all(text, '{T.QUOTED}')), lambda q: len(regexp_extract_all(q, '{S.Q}'))))")} AS dialogue FROM units""")
def punctuation_rates(spark, d):
    return r6(M.punctuation(docs(spark, d)))


_PASSIVE = f"""(lang = 'de' AND list_has_any(w, [{S.quoted(PASSIVE_AUXILIARIES['de'])}]) AND len(list_filter(w, lambda x: regexp_full_match(x, 'ge.{{2,}}(?:t|en)|.{{3,}}iert'))) > 0
  OR lang = 'en' AND list_has_any(w, [{S.quoted(PASSIVE_AUXILIARIES['en'])}]) AND len(list_filter(w, lambda x: length(x) >= 5 AND (suffix(x, 'ed') OR suffix(x, 'en')) OR x IN ({S.quoted(PARTICIPLES_EN)}))) > 0)"""


@query(f"""WITH {DOCS}, {S.SENTENCES}, x AS (SELECT *, lead(n) OVER (PARTITION BY unit_id ORDER BY sent) AS nxt, {_PASSIVE} AS passive FROM sent)
SELECT unit_id, count(*) AS sentences, round(avg(n), 6) AS "sentenceMean", round(stddev_pop(n) / avg(n), 6) AS "sentenceCV", round(quantile_cont(n, 0.9), 6) AS "sentenceP90",
  round(100.0 * count(*) FILTER (n > 30) / count(*), 6) AS "longSentences", round(100.0 * count(*) FILTER (n <= 5) / count(*), 6) AS "shortSentences", round(avg(abs(n - nxt)) / avg(n), 6) AS "rhythmChange",
  round(CASE WHEN count(*) >= 10 AND stddev_pop(nxt) > 0 AND stddev_pop(n) FILTER (nxt IS NOT NULL) > 0 THEN corr(n, nxt) END, 6) AS "rhythmLag",
  round(100.0 * count(*) FILTER (contains(sentence, '?')) / count(*), 6) AS questions, round(100.0 * count(*) FILTER (contains(sentence, '!')) / count(*), 6) AS exclamations,
  round(100.0 * count(*) FILTER (length(sentence) - length(replace(sentence, ',', '')) >= 4) / count(*), 6) AS "commaChains", round(100.0 * count(*) FILTER (passive) / count(*), 6) AS passive FROM x GROUP BY unit_id""")
def sentence_metrics(spark, d):
    return r6(M.rhythm(M.sentence_rows(docs(spark, d))))


@query(f"WITH {DOCS}, {S.SENTENCES} SELECT unit_id, sent::INT AS sent, n::INT AS len, list_aggregate(w, 'string_agg', ' ') AS words FROM sent")
def sentence_split(spark, d):
    return M.sentence_rows(docs(spark, d)).select("unit_id", "sent", "len", F.concat_ws(" ", "words").alias("words"))


_BINS = ", ".join(f"count(*) FILTER (n BETWEEN {a} AND {b}) AS len_{a}" for a, b in ((1, 5), (6, 10), (11, 15), (16, 20), (21, 30), (31, 40), (41, 10**9)))


@query(f"WITH {DOCS}, {S.SENTENCES} SELECT unit_id, {_BINS} FROM sent GROUP BY unit_id")
def sentence_histogram(spark, d):
    return M.histogram(M.sentence_rows(docs(spark, d)))


@query(f"""WITH {DOCS}, {S.SENTENCES}, t AS (SELECT unit_id, lang, unnest(w) AS word FROM sent), k AS (SELECT unit_id, {S.LETTERS} AS k, {S.SYLLABLES} AS y FROM t),
  a AS (SELECT unit_id, count(*) AS n, sum(y) AS syl, count(*) FILTER (k > 6) AS lw, count(*) FILTER (k >= 6) AS six, count(*) FILTER (y >= 3) AS multi, count(*) FILTER (y = 1) AS mono FROM k GROUP BY unit_id),
  s AS (SELECT unit_id, count(*) AS s FROM sent GROUP BY unit_id)
SELECT unit_id, round(n / s + 100.0 * lw / n, 6) AS lix, round(lw / s, 6) AS rix, round(180 - n / s - 58.5 * syl / n, 6) AS "fleschDe", round(206.835 - 1.015 * n / s - 84.6 * syl / n, 6) AS "fleschEn",
  round(0.39 * n / s + 11.8 * syl / n - 15.59, 6) AS "fkGrade", round(0.1935 * 100 * multi / n + 0.1672 * n / s + 0.1297 * 100 * six / n - 0.0327 * 100 * mono / n - 0.875, 8) AS wiener FROM a JOIN s USING (unit_id)""")
def readability_all(spark, d):
    u = docs(spark, d)
    x = M.readability(M.vocabulary(M.frequencies(M.tokens(u))), M.rhythm(M.sentence_rows(u)))
    return r6(x.withColumn("wiener", F.round("wiener", 8)), "wiener")


def _again(cte: str, key: str, name: str) -> str:
    return f'{name} AS (SELECT unit_id, round(100.0 * sum(f - 1) / sum(f), 6) AS "{name}" FROM (SELECT unit_id, {key} AS k, count(*) AS f FROM {cte} GROUP BY ALL) GROUP BY unit_id)'


@query(f"""WITH {SECTIONS}, {S.SENTENCES}, {S.PARAGRAPHS},
  g AS (SELECT unit_id, unnest(list_transform(range(1, n::BIGINT - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM sent WHERE n >= 3),
  {_again("g", "gram", "trigramRepeat")}, {_again("(SELECT * FROM sent WHERE n >= 5)", "w", "sentenceRepeat")}, {_again("(SELECT * FROM sent WHERE n >= 2)", "w[1:2]", "startRepeat")}, {_again("(SELECT * FROM par WHERE n >= 12)", "w", "paragraphRepeat")}
SELECT unit_id, "trigramRepeat", "sentenceRepeat", "startRepeat", "paragraphRepeat" FROM trigramRepeat FULL JOIN sentenceRepeat USING (unit_id) FULL JOIN startRepeat USING (unit_id) FULL JOIN paragraphRepeat USING (unit_id)""")
def repetition_metrics(spark, d):
    return r6(M.repetition(sections(spark, d)))


@query(f"""WITH {DOCS}, {S.SENTENCES}, g AS (SELECT unit_id, sent, unnest(range(1, n::BIGINT - 1)) AS k, w FROM sent WHERE n >= 3),
  c AS (SELECT unit_id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS phrase, count(*) AS f, min((sent, k)) AS first FROM g GROUP BY ALL HAVING count(*) >= 2)
SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY f DESC, first)::INT AS rank, phrase, f FROM c QUALIFY rank <= 16""")
def phrases_top16(spark, d):
    return M.phrases(M.sentence_rows(docs(spark, d)))


@query(f"""WITH {SECTIONS}, {S.PARAGRAPHS}, o AS (SELECT *, CASE WHEN n >= 12 THEN list_distinct(list_filter(w, lambda word: NOT {S.IS_STOP})) ELSE [] END AS own FROM par),
  b AS (SELECT *, lag(own) OVER (PARTITION BY unit_id ORDER BY par) AS before FROM o),
  j AS (SELECT unit_id, n, CASE WHEN len(own) > 0 AND len(before) > 0 THEN len(list_intersect(own, before)) / len(list_distinct(list_concat(own, before))) END AS j FROM b)
SELECT unit_id, count(*) AS paragraphs, round(avg(n), 6) AS "paragraphMean", round(CASE WHEN count(*) >= 3 THEN stddev_pop(n) / avg(n) END, 6) AS "paragraphCV", round(100 * avg(j), 6) AS cohesion,
  round(CASE WHEN count(j) > 0 THEN 100.0 * count(*) FILTER (j < 0.05) / count(j) END, 6) AS shifts FROM j GROUP BY unit_id""")
def paragraph_metrics(spark, d):
    return r6(M.paragraph_metrics(M.paragraph_rows(sections(spark, d))))


@query(f"""WITH {SECTIONS}, {S.SENTENCES}, b AS (SELECT unit_id, sent, n, sent // greatest(1, ceil(count(*) OVER (PARTITION BY unit_id) / 160)::BIGINT) AS bin FROM sent)
SELECT unit_id, bin, (min(sent) + 1)::INT AS "first", (max(sent) + 1)::INT AS "last", round_even(avg(n), 2) AS mean, min(n)::INT AS low, max(n)::INT AS high FROM b GROUP BY unit_id, bin""")
def cadence_bins(spark, d):
    return M.cadence(M.sentence_rows(sections(spark, d)))


@query(f"WITH {DOCS}, {S.TOKENS}, {S.MTLD} SELECT unit_id, round(mtld, 6) AS mtld FROM stretch")
def lexical_stretch(spark, d):
    return M.lexical_stretch(docs(spark, d)).select("unit_id", F.round("mtld", 6).alias("mtld"))


def profile_ctes(units: str = DOCS) -> str:
    """``g``: the profile put together from the SQL of its families, unrounded, with the gates in their order; ``units`` names the texts."""
    part = lambda name: S.unrounded(ORACLE[name]).replace(SECTIONS, units).replace(DOCS, units)
    families = {
        "v": part("vocab_metrics"), "h": part("vocab_hdd"), "o": part("vocab_mattr_near"), "tw": part("top_words_share"), "lx": part("lexicon_rates"), "pu": part("punctuation_rates"),
        "se": part("sentence_metrics"), "re": part("readability_all"), "rp": part("repetition_metrics"), "pa": part("paragraph_metrics"), "ml": f"WITH {units}, {S.TOKENS}, {S.MTLD} SELECT * FROM stretch",
    }
    names = ", ".join(f"('{m.id}', {m.min_words}, '{','.join(m.languages)}')" for m in METRICS)
    value = " ".join(f"WHEN '{m.id}' THEN \"{m.id}\"::DOUBLE" for m in METRICS)
    own = " ".join(f"WHEN metric = '{k}' THEN '{v}'" for k, v in REASONS.items() if k in {m.id for m in METRICS})
    joins = " ".join(f"LEFT JOIN {k} USING (unit_id)" for k in families)
    return f"""{units}, {", ".join(S.inner(v, k) for k, v in families.items())}, m(metric, least, spoken) AS (VALUES {names}),
      w AS (SELECT * FROM units {joins}), l AS (SELECT unit_id, lang, coalesce(n, 0) AS n, metric, least, spoken, CASE metric {value} END AS v FROM w CROSS JOIN m),
      gates AS (SELECT *, CASE WHEN NOT list_contains(string_split(spoken, ','), lang) THEN '{REASONS["language"]}' WHEN n < least THEN '{REASONS["short"]}' WHEN v IS NULL OR isnan(v) THEN CASE {own} ELSE '{REASONS["other"]}' END END AS reason FROM l),
      g AS (SELECT unit_id, lang, n, metric, CASE WHEN reason IS NULL THEN round_even(v, 4) END AS value, reason FROM gates)"""


@query(f"WITH {profile_ctes()} SELECT unit_id, lang, metric, value, reason FROM g")
def metric_profile(spark, d):
    """All 51 metrics of every document with the reasons for missing values (long form)."""
    return M.profile(docs(spark, d))


_BASIC = f"""WITH {DOCS}, v AS ({S.unrounded(ORACLE["vocab_mattr_near"])}), c AS ({S.unrounded(ORACLE["token_count"])}), s AS ({S.unrounded(ORACLE["sentence_metrics"])}), hi AS ({ORACLE["sentence_histogram"]}), pu AS ({S.unrounded(ORACLE["punctuation_rates"])}), {S.PARAGRAPHS},
  pa AS (SELECT unit_id, count(*) AS paragraphs FROM par GROUP BY unit_id)
SELECT unit_id, coalesce(words, 0)::BIGINT AS words, round(mattr, 6) AS mattr, coalesce(sentences, 0) AS sentences, round("sentenceMean", 6) AS "sentenceMean", round("sentenceCV", 6) AS "sentenceCV",
  {", ".join(f"coalesce(len_{a}, 0) AS len_{a}" for a in (1, 6, 11, 16, 21, 31, 41))}, round(CASE WHEN dialogue IS NOT NULL THEN least(100.0, dialogue) END, 6) AS dialogue, coalesce(paragraphs, 0) AS paragraphs
FROM units LEFT JOIN v USING (unit_id) LEFT JOIN c USING (unit_id) LEFT JOIN s USING (unit_id) LEFT JOIN hi USING (unit_id) LEFT JOIN pu USING (unit_id) LEFT JOIN pa USING (unit_id)"""


@query(_BASIC)
def basic_metrics(spark, d):
    b = M.basic(docs(spark, d))
    return r6(b.withColumn("dialogue", F.when(F.col("words") > 0, F.col("dialogue"))))


@query(f"""WITH {DOCS}, {S.TOKENS}, a AS (SELECT unit_id, word, pos, pos - lag(pos) OVER (PARTITION BY unit_id, word ORDER BY pos) AS gap FROM tokens WHERE NOT {S.IS_STOP} AND lang IN ('de','en'))
SELECT unit_id, pos::INT AS pos, word, gap::INT AS gap FROM a WHERE gap <= 20""")
def near_repeat_hits(spark, d):
    """Every near repetition with its place."""
    o = M.tokens(docs(spark, d).where(F.col("lang").isin("de", "en"))).where(~M.is_stop(F.col("word"), F.col("lang")))
    gap = F.col("pos") - F.lag("pos").over(M.Window.partitionBy("unit_id", "word").orderBy("pos"))
    return o.select("unit_id", "pos", "word", gap.alias("gap")).where(F.col("gap") <= M.NEAR)


@query(f"WITH {DOCS}, {S.TOKENS} SELECT unit_id, word, count(*) AS f FROM tokens GROUP BY ALL")
def token_offsets(spark, d):
    """Words cut out of the stored text by their offsets, counted: equal to the words themselves only if every offset is right."""
    u = docs(spark, d)
    o = E.token_offsets(u).join(u.select("unit_id", "text"), "unit_id")
    cut = T.plain(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    return o.groupBy("unit_id", cut.alias("word")).agg(F.count("*").alias("f"))


_HITS = f"""hits AS (SELECT unit_id, 'longSentences' AS metric, count(*) AS n FROM sent WHERE n > 30 GROUP BY unit_id
  UNION ALL SELECT unit_id, 'commaChains', count(*) FROM sent WHERE length(sentence) - length(replace(sentence, ',', '')) >= 4 GROUP BY unit_id
  UNION ALL SELECT unit_id, 'passive', count(*) FROM sent WHERE {_PASSIVE} GROUP BY unit_id
  UNION ALL SELECT unit_id, 'sentenceRepeat', sum(f - 1) FROM (SELECT unit_id, w, count(*) AS f FROM sent WHERE n >= 5 GROUP BY ALL HAVING count(*) > 1) GROUP BY unit_id
  UNION ALL SELECT unit_id, 'startRepeat', sum(f - 1) FROM (SELECT unit_id, w[1:2] AS k, count(*) AS f FROM sent WHERE n >= 2 GROUP BY ALL HAVING count(*) > 1) GROUP BY unit_id
  UNION ALL SELECT unit_id, 'trigramRepeat', count(*) FROM (SELECT unit_id, gram FROM (SELECT unit_id, unnest(list_transform(range(1, n::BIGINT - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM sent WHERE n >= 3) GROUP BY ALL HAVING count(*) >= 2) GROUP BY unit_id
  UNION ALL SELECT unit_id, 'paragraphRepeat', sum(f - 1) FROM (SELECT unit_id, w, count(*) AS f FROM par WHERE n >= 12 GROUP BY ALL HAVING count(*) > 1) GROUP BY unit_id
  UNION ALL SELECT unit_id, 'nearRepeat', count(*) FROM ({ORACLE["near_repeat_hits"].replace(DOCS, SECTIONS)}) GROUP BY unit_id
  UNION ALL SELECT unit_id, 'shifts', count(*) FROM (SELECT unit_id, lang, CASE WHEN len(own) > 0 AND len(before) > 0 THEN len(list_intersect(own, before)) / len(list_distinct(list_concat(own, before))) END AS j FROM (SELECT *, lag(own) OVER (PARTITION BY unit_id ORDER BY par) AS before FROM (SELECT *, CASE WHEN n >= 12 THEN list_distinct(list_filter(w, lambda word: NOT {S.IS_STOP})) ELSE [] END AS own FROM par))) WHERE j < 0.05 AND lang IN ('de','en') GROUP BY unit_id
  UNION ALL SELECT unit_id, 'nominal', count(*) FROM tokens WHERE {_NOM} GROUP BY unit_id
  UNION ALL SELECT unit_id, 'adverbs', count(*) FROM tokens WHERE {_ADV} GROUP BY unit_id
  {" ".join(f"UNION ALL SELECT unit_id, '{x}', count(*) FROM tokens WHERE {S.in_lexicon(x)} GROUP BY unit_id" for x in LEXICONS)})"""


@query(f"WITH {SECTIONS}, {S.TOKENS}, {S.SENTENCES}, {S.PARAGRAPHS}, {_HITS} SELECT unit_id, metric, n::BIGINT AS n FROM hits")
def evidence_counts(spark, d):
    """Findings of every metric with places, counted from their index."""
    e = E.index(sections(spark, d))
    return e.groupBy("unit_id", "metric").agg(F.count("*").alias("n"))
