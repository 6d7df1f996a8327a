"""Writing review and findings over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import comparison as C
from ..operators import evidence as E
from ..operators import metrics as M
from ..operators import review as R
from ..tables import cut, table
from . import sql as S
from .text_queries import _ADV, _HITS, _NOM, DOCS, LEXICONS, ORACLE as TEXT, SECTIONS, docs, profile_ctes, r6, sections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- chapters against the others of their book ---------------------------------
def chapter_values(spark: SparkSession, d: str) -> DataFrame:
    """book_id, section_id, n, metric, value of the three local metrics of every section."""
    own = R.gated(sections(spark, d)).where(F.col("metric").isin(*R.MINIMUM)).select(F.col("unit_id").alias("section_id"), "n", "metric", "value")
    return own.join(table(spark, d, "book_sections").select("section_id", "book_id"), "section_id")


_JUDGED = f"""{profile_ctes(SECTIONS)}, r AS (SELECT s.book_id, s.section_id, g.n, g.metric, g.value FROM g JOIN book_sections s ON s.section_id = g.unit_id WHERE metric IN ('sentenceMean', 'mattr', 'nearRepeat')),
  b AS (SELECT a.book_id, a.section_id, a.n, a.metric, a.value, count(o.value) AS others, quantile_cont(o.value, [0.25, 0.5, 0.75]) AS q
    FROM r a LEFT JOIN r o ON o.book_id = a.book_id AND o.metric = a.metric AND o.section_id <> a.section_id AND o.n >= 300 GROUP BY ALL),
  c AS (SELECT * EXCLUDE (q), CASE WHEN others >= 4 THEN q[1] END AS q25, CASE WHEN others >= 4 THEN q[2] END AS median, CASE WHEN others >= 4 THEN q[3] END AS q75, CASE metric WHEN 'sentenceMean' THEN 3.0 WHEN 'mattr' THEN 5.0 ELSE 2.0 END AS least FROM b),
  j AS (SELECT *, value IS NOT NULL AND q25 IS NOT NULL AS eligible, CASE WHEN n >= 300 AND value < q25 - greatest(least, 1.5 * (q75 - q25)) THEN 'lower' WHEN n >= 300 AND value > q75 + greatest(least, 1.5 * (q75 - q25)) THEN 'higher' END AS direction FROM c)"""


@query(f"WITH {_JUDGED} SELECT book_id, section_id, metric, others, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, direction FROM j")
def chapter_bands(spark, d):
    """Sections against the other sections of their book of 300 words: bands and exceptions of three metrics."""
    j = R.exceptions(R.chapter_bands(chapter_values(spark, d), "book_id", "section_id"))
    return r6(j.select("book_id", "section_id", "metric", "others", "q25", "median", "q75", "direction"))


_CARDS = f"WITH {_JUDGED}, k AS (SELECT book_id, section_id, CASE WHEN count(direction) > 0 THEN 'review' WHEN coalesce(bool_or(n >= 300 AND eligible), false) THEN 'observe' ELSE 'unknown' END AS status, count(direction) AS exceptions FROM j GROUP BY ALL)"


def _consistency(spark: SparkSession, d: str) -> DataFrame:
    return R.consistency(R.exceptions(R.chapter_bands(chapter_values(spark, d), "book_id", "section_id")), "book_id", "section_id")


@query(f"{_CARDS} SELECT * FROM k")
def consistency_cards(spark, d):
    return _consistency(spark, d)


@query(f"{_CARDS} SELECT book_id, count(*) AS units, count(*) FILTER (status <> 'unknown') AS assessed, count(*) FILTER (status = 'review') AS to_review, CASE WHEN count(*) FILTER (status = 'review') > 0 THEN 'review' WHEN count(*) FILTER (status <> 'unknown') > 0 THEN 'observe' ELSE 'unknown' END AS status FROM k GROUP BY book_id")
def consistency_books(spark, d):
    return R.roll_up(_consistency(spark, d), "book_id")


# -- findings and decisions ------------------------------------------------------
_OFF = rf"""part AS (SELECT unit_id, lang, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (SELECT unit_id, lang, string_split(regexp_replace(text, '({S.Q})', chr(3) || '\1' || chr(3), 'g'), chr(3)) AS p FROM units)),
  off AS (SELECT unit_id, lang, part, i, coalesce(sum(length(part)) OVER (PARTITION BY unit_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM part),
  wo AS (SELECT unit_id, lang, (i // 2 - 1)::INT AS pos, {S.words("part")}[1] AS word, start, (start + length(part))::INT AS "end" FROM off WHERE i % 2 = 0)"""
_NEAR = f"""{_OFF}, near AS (SELECT unit_id, 'nearRepeat' AS metric, start, "end", word FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY unit_id, word ORDER BY pos) AS gap FROM wo WHERE NOT {S.IS_STOP}) WHERE gap <= 20)"""


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Near repetitions of the documents, and decisions made on words before n, whether they are findings or not."""
    o = E.token_offsets(docs(spark, d))
    return E.near_repeats(o), o.where((F.col("word") >= "a") & (F.col("word") < "n")).select("unit_id", F.lit("nearRepeat").alias("metric"), "start", "end")


@query(f"WITH {DOCS}, {_NEAR} SELECT unit_id, count(*) AS hits, count(*) FILTER (word >= 'a' AND word < 'n') AS intentional FROM near GROUP BY unit_id")
def decided_findings(spark, d):
    """Near repetitions of each document and how many a decision on their very place calls intentional."""
    e = E.with_decisions(*_near(spark, d))
    return e.groupBy("unit_id").agg(F.count("*").alias("hits"), F.count_if("intentional").alias("intentional"))


@query(f"""WITH {DOCS}, {_NEAR} SELECT unit_id, start, "end" FROM near WHERE NOT (word >= 'a' AND word < 'n')""")
def open_findings(spark, d):
    return E.filtered(E.with_decisions(*_near(spark, d)), "nearRepeat", "open").select("unit_id", "start", "end")


@query(f"""WITH {DOCS}, {_NEAR} SELECT unit_id, metric, start, "end" FROM near ORDER BY unit_id, start, "end", metric LIMIT 50 OFFSET 100""")
def findings_page(spark, d):
    """Third page of 50 findings."""
    return E.page(_near(spark, d)[0], 100, 50)


_WORDY = " ".join(f"UNION ALL SELECT unit_id, '{x}', start, \"end\" FROM wo WHERE {S.in_lexicon(x)}" for x in LEXICONS)


@query(f"""WITH {DOCS}, {_NEAR}, f AS (SELECT unit_id, metric, start, "end" FROM near UNION ALL SELECT unit_id, 'nominal', start, "end" FROM wo WHERE {_NOM} UNION ALL SELECT unit_id, 'adverbs', start, "end" FROM wo WHERE {_ADV} {_WORDY}),
  r AS (SELECT *, row_number() OVER (PARTITION BY unit_id, metric ORDER BY start, "end")::INT AS rank FROM f QUALIFY rank <= 6)
SELECT unit_id, metric, start, "end", rank, substr(text, greatest(0, start - 90) + 1, start - greatest(0, start - 90)) AS before, substr(text, start + 1, least(220, "end" - start)) AS hit, substr(text, "end" + 1, 90) AS after, "end" - start > 220 AS truncated FROM r JOIN units USING (unit_id)""")
def word_findings_shown(spark, d):
    """The first six findings of every metric over words with what stands around them."""
    u = docs(spark, d)
    o = E.token_offsets(u)
    e = E.near_repeats(o).unionByName(E.ending_hits(o.where(F.col("lang").isin("de", "en"))))
    for name, words in LEXICONS.items():
        e = e.unionByName(E.lexicon_hits(o, name, {k: v.split() for k, v in words.items()}))
    return E.excerpts(E.shown(e), u)


@query()
def findings_shown(spark, d):
    """The first six findings of every metric that has places, in the long form (700, 4000 and 700 characters)."""
    u = docs(spark, d)
    return E.excerpts(E.shown(E.index(u)), u, 700, 4000, 700)


@query("SELECT section_id FROM book_sections WHERE content IS NOT NULL AND sha256(content) = text_sha256")
def current_decisions(spark, d):
    """Decisions made on the section texts with the stored hashes: those on other texts are rejected."""
    made = table(spark, d, "book_sections").select(F.col("section_id").alias("unit_id"), "text_sha256")
    now = table(spark, d, "book_sections").where("content is not null").select(F.col("section_id").alias("unit_id"), F.col("content").alias("text"))
    return E.current_decisions(made, now).select(F.col("unit_id").alias("section_id"))


# -- cards and priorities --------------------------------------------------------
_DOC_HITS = _HITS.replace(SECTIONS, DOCS)
_OPEN = f"WITH {DOCS}, {S.TOKENS}, {S.SENTENCES}, {S.PARAGRAPHS}, {_DOC_HITS} SELECT * FROM hits"


@query(f"""WITH {profile_ctes()}, hh AS ({_OPEN}), x AS (SELECT unit_id, n, max(value) FILTER (metric = 'longSentences') AS ls, max(value) FILTER (metric = 'mattr') AS ma, max(value) FILTER (metric = 'sentenceRepeat') AS sr FROM g GROUP BY ALL),
  od AS (SELECT unit_id, sum(n) AS open FROM hh WHERE metric IN ('sentenceRepeat', 'paragraphRepeat') GROUP BY unit_id), y AS (SELECT x.*, od.open FROM x LEFT JOIN od USING (unit_id))
SELECT unit_id, 'flow' AS card, CASE WHEN n < 300 OR ls IS NULL THEN 'unknown' WHEN ls > 10 THEN 'review' ELSE 'fit' END AS status FROM y
UNION ALL SELECT unit_id, 'vocabulary', CASE WHEN n < 300 OR ma IS NULL THEN 'unknown' ELSE 'observe' END FROM y
UNION ALL SELECT unit_id, 'repetition', CASE WHEN n < 300 OR sr IS NULL THEN 'unknown' WHEN open > 0 THEN 'review' ELSE 'observe' END FROM y""")
def writing_cards(spark, d):
    u = docs(spark, d)
    doubles = E.index(u).where(F.col("metric").isin("sentenceRepeat", "paragraphRepeat")).groupBy("unit_id").agg(F.count("*").alias("open"))
    return R.cards(R.gated(u), doubles)


@query(f"""WITH {profile_ctes()}, hh AS ({_OPEN}), nd AS ({ORACLE["decided_findings"]}),
  p(metric, place, grp) AS (VALUES ('paragraphRepeat', 0, 'repetition'), ('sentenceRepeat', 1, 'repetition'), ('longSentences', 2, 'flow'), ('commaChains', 3, 'flow'), ('nearRepeat', 4, 'wording'), ('fillers', 5, 'wording')),
  c AS (SELECT hh.unit_id, hh.metric, place, grp, hh.n AS found, CASE WHEN hh.metric = 'nearRepeat' THEN hh.n - coalesce(nd.intentional, 0) ELSE hh.n END AS open FROM hh JOIN p USING (metric) LEFT JOIN nd ON nd.unit_id = hh.unit_id),
  e AS (SELECT c.* FROM c LEFT JOIN g ON g.unit_id = c.unit_id AND g.metric = 'longSentences' WHERE open > 0 AND (c.metric <> 'longSentences' OR g.value > 10)),
  f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY unit_id, grp ORDER BY place) = 1)
SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY place)::INT AS rank, metric, grp AS "group", found::BIGINT AS found, open::BIGINT AS open FROM f QUALIFY rank <= 3""")
def review_priorities(spark, d):
    """What to look at first in each document: three metrics at most, one of each group, with findings that are still open."""
    u = docs(spark, d)
    e = E.with_decisions(E.index(u), _near(spark, d)[1])
    share = R.gated(u).where("metric = 'longSentences'").select("unit_id", F.col("value").alias("share"))
    return R.priorities(e, share)


# -- deltas ------------------------------------------------------------------------
def _first_of_language(df: DataFrame) -> DataFrame:
    """unit_id of the smallest id of each lang with at least 100 words; df: unit_id, lang, n."""
    return df.where("n >= 100").groupBy("lang").agg(F.min("unit_id").alias("unit_id")).select("unit_id")


_FIRST_SQL = "f1 AS (SELECT lang, min(unit_id) AS unit_id FROM g WHERE n >= 100 GROUP BY lang)"


@query(f"""WITH {profile_ctes()}, one AS (SELECT min(unit_id) AS unit_id FROM g WHERE metric = 'lix' AND value IS NOT NULL), b AS (SELECT g.* FROM g JOIN one USING (unit_id))
SELECT t.unit_id, t.metric, CASE WHEN t.lang = b.lang THEN round_even(t.value - b.value, 4) END AS delta, CASE WHEN t.lang <> b.lang THEN 'different languages' ELSE coalesce(t.reason, b.reason) END AS reason FROM g t JOIN b USING (metric)""")
def metric_deltas(spark, d):
    """Profile of every document against that of the document with the smallest id of at least 100 words."""
    p = cut(M.profile(docs(spark, d)))
    first = p.where("value is not null and metric = 'lix'").agg(F.min("unit_id").alias("unit_id"))
    return C.deltas(p, p.join(F.broadcast(first), "unit_id", "left_semi"))  # one row


@query(f"""WITH b AS ({TEXT["basic_metrics"].replace("round(", "(").replace(", 6) AS", ") AS")}), {DOCS}, x AS (SELECT b.*, units.lang FROM b JOIN units USING (unit_id)), f AS (SELECT lang, min(unit_id) AS unit_id FROM x WHERE words >= 100 GROUP BY lang), r AS (SELECT x.* FROM x JOIN f USING (unit_id))
SELECT x.unit_id, round_even(x."sentenceMean" - r."sentenceMean", 3) AS "sentenceMean", round_even(x."sentenceCV" - r."sentenceCV", 3) AS "sentenceVariation", round_even(x.mattr - r.mattr, 3) AS vocabulary, round_even(x.dialogue - r.dialogue, 3) AS dialogue FROM x JOIN r ON x.lang = r.lang""")
def local_deltas(spark, d):
    """Four basic metrics of every document against the first of its language."""
    u = docs(spark, d)
    b = cut(M.basic(u).withColumn("dialogue", F.when(F.col("words") > 0, F.col("dialogue"))).join(u.select("unit_id", "lang"), "unit_id"))
    first = _first_of_language(b.select("unit_id", "lang", F.col("words").alias("n")))
    return R.local_delta(b, b.join(first, "unit_id", "left_semi"))


_WINDOWS = rf"""wu AS MATERIALIZED (WITH {DOCS}, c AS (SELECT unit_id, lang, text, string_split(regexp_replace(text, '({S.Q})', '\1' || chr(2), 'g'), chr(2)) AS p FROM units), c2 AS (SELECT *, len(p) - 1 AS n FROM c),
    r AS (SELECT * FROM c2 JOIN (SELECT min(unit_id) AS unit_id FROM c2 WHERE n >= 100 GROUP BY lang) USING (unit_id)),
    j AS (SELECT t.unit_id, t.lang, t.n, r.n AS total, r.text AS whole, r.p, least(9, r.n // t.n)::INT AS k FROM c2 t JOIN r ON r.lang = t.lang WHERE t.n > 0 AND t.n <= r.n),
    w AS (SELECT *, unnest(range(k)) AS win FROM j), s AS (SELECT *, CASE WHEN k = 1 THEN (total - n) // 2 ELSE round_even(win * (total - n) / (k - 1), 0)::BIGINT END AS start FROM w)
    SELECT unit_id || '/' || win AS unit_id, lang, CASE WHEN n = total THEN whole ELSE regexp_replace(array_to_string(p[start + 1:start + n], ''), '^[^{T.L}]+', '') END AS text FROM s)"""
_DEPEND, _STRUCT = (", ".join(f"'{m}'" for m in ms) for ms in (R.LENGTH_DEPENDENT, R.STRUCTURAL))


@query(f"""WITH {_WINDOWS}, pw AS MATERIALIZED (WITH {profile_ctes("units AS (SELECT * FROM wu)")} SELECT * FROM g), pd AS MATERIALIZED (WITH {profile_ctes()} SELECT * FROM g),
  bands AS (SELECT split_part(unit_id, '/', 1)::BIGINT AS unit_id, metric, count(value) AS windows, round_even(median(value), 6) AS mid, round_even(quantile_cont(value, 0.25), 6) AS q25, round_even(quantile_cont(value, 0.75), 6) AS q75, arg_min(reason, unit_id) AS why FROM pw GROUP BY 1, 2),
  r AS (SELECT pd.* FROM pd JOIN (SELECT min(unit_id) AS unit_id FROM pd WHERE n >= 100 GROUP BY lang) USING (unit_id)),
  j AS (SELECT t.unit_id, t.metric, t.value, t.reason, r.value AS base, r.reason AS base_why, b.windows, b.mid, b.q25, b.q75, b.why, b.unit_id IS NOT NULL AS matched FROM pd t JOIN r ON r.lang = t.lang AND r.metric = t.metric LEFT JOIN bands b ON b.unit_id = t.unit_id AND b.metric = t.metric),
  k AS (SELECT *, CASE WHEN matched THEN mid WHEN metric NOT IN ({_DEPEND}) THEN base END AS ref, coalesce(reason, CASE WHEN NOT matched AND metric IN ({_DEPEND}) THEN 'reference is shorter' WHEN matched AND mid IS NULL THEN coalesce(why, 'no comparable windows') WHEN NOT matched THEN base_why END) AS no FROM j),
  l AS (SELECT *, CASE WHEN no IS NULL THEN round_even(value - ref, 6) END AS delta FROM k)
SELECT unit_id, metric, ref AS reference, CASE WHEN delta IS NOT NULL THEN q25 END AS q25, CASE WHEN delta IS NOT NULL THEN q75 END AS q75, coalesce(windows, 0) AS windows, delta, no AS reason FROM l""")
def matched_comparison(spark, d):
    """Every document against the first of its language, in windows as long as the document."""
    u = docs(spark, d)
    p = cut(R.gated(u))
    first = _first_of_language(p.select("unit_id", "lang", "n"))
    sizes = p.where("metric = 'lix'").select("unit_id", "lang", "n")
    windows = R.window_units(sizes, u.join(first, "unit_id", "left_semi"))
    return R.compare(p, p.join(first, "unit_id", "left_semi"), R.gated(windows), places=6)


# -- order statistics ----------------------------------------------------------------
@query("SELECT doc_id, lang, round(cume_dist() OVER (PARTITION BY lang ORDER BY n_chars), 6) AS share FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL")
def ecdf_self(spark, d):
    """Right-continuous percentile of every document among those of its language."""
    x = table(spark, d, "documents").where("n_chars is not null and lang is not null")
    return x.select("doc_id", "lang", F.round(F.cume_dist().over(Window.partitionBy("lang").orderBy("n_chars")), 6).alias("share"))
