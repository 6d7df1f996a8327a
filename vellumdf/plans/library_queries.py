"""Library operations over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison as C
from ..operators import evidence as E
from ..operators import library as Y
from ..operators import metrics as M
from ..operators import segmentation as SG
from ..operators import vectors as V
from ..operators.taxonomy import Feature
from ..tables import cut, table
from .table_queries import _FT, SIZES, WORDS, feature_table, one_delivery
from .text_queries import docs, r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_FT}, a AS (SELECT lang, unnest(['length', 'grade']) AS axis, unnest([100.0 * (list_position(['short','medium','long'], len) - 1) / 2, CASE WHEN grade = 'NA' THEN NULL ELSE 25.0 * (grade::INT - 1) END]) AS x FROM f)
SELECT lang, axis, round(avg(x), 2) AS mean, round(quantile_cont(x, 0.25), 2) AS q25, round(quantile_cont(x, 0.75), 2) AS q75, count(x) AS n, count(*) AS total FROM a GROUP BY ALL""")
def axis_profiles(spark, d):
    axes = {"length": Y.axis(F.col("len"), Feature("len", "ordinal", ("short", "medium", "long"))), "grade": Y.axis(F.col("grade"), Feature("grade", "scale", ("1", "2", "3", "4", "5")))}
    return Y.axis_profiles(feature_table(spark, d), "lang", axes)


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source NULLS FIRST LIMIT 25")
def source_counts(spark, d):
    return Y.source_counts(table(spark, d, "documents"), "source")


@query("""WITH s AS (SELECT book_id, section_id, chapter_index, coalesce(word_count, 0) AS w FROM book_sections), x AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY section_id) - 1 AS place, count(*) OVER (PARTITION BY book_id) AS n,
  row_number() OVER (PARTITION BY book_id ORDER BY w, section_id) = 1 AS short, row_number() OVER (PARTITION BY book_id ORDER BY w DESC, section_id) = 1 AS long FROM s),
  r AS (SELECT *, CASE WHEN place = 0 THEN 0 WHEN place = n // 2 THEN 1 WHEN place = n - 1 THEN 2 WHEN short THEN 3 WHEN long THEN 4 END AS rank FROM x)
SELECT book_id, section_id AS segment_index, w::BIGINT AS word_count FROM r ORDER BY rank IS NULL, CASE WHEN rank IS NOT NULL THEN book_id END NULLS FIRST, rank NULLS FIRST, book_id, section_id LIMIT 60""")
def pilot_sample(spark, d):
    s = table(spark, d, "book_sections").select("book_id", F.col("section_id").alias("segment_index"), F.coalesce("word_count", F.lit(0)).alias("word_count"))
    return Y.pilot(s, 60)


@query(f"""WITH f AS (SELECT book_id, string_agg(content, chr(10) || chr(10) ORDER BY chapter_index) AS text FROM (SELECT book_id, chapter_index, arg_min(content, section_id) AS content FROM book_sections WHERE included AND content IS NOT NULL AND chapter_index IS NOT NULL GROUP BY ALL) GROUP BY book_id)
SELECT book_id, length(text)::BIGINT AS chars, len(regexp_extract_all(text, '{WORDS}'))::BIGINT AS words FROM f WHERE len(regexp_extract_all(text, '{WORDS}')) > 0""")
def segment_spans(spark, d):
    """Spans of segments in the full text of each book: together they hold every character and word once."""
    s = one_delivery(spark, d)
    parts = F.sort_array(F.collect_list(F.struct("chapter_index", "content")))
    full = cut(s.groupBy("book_id").agg(F.array_join(parts["content"], "\n\n").alias("text")))
    spans = Y.segment_spans(full, SG.segments(s, *SIZES).select("book_id", "segment_index", "word_count"))
    cut_out = spans.join(full, "book_id").select("book_id", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("t"))
    return cut_out.groupBy("book_id").agg(F.sum(F.length("t")).cast("long").alias("chars"), F.sum(F.regexp_count("t", F.lit(SG.T.IMPORT_WORD))).cast("long").alias("words"))


@query("""WITH v AS (SELECT vec_id, label::VARCHAR AS doc, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0), x AS (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM v WHERE doc = '0'),
  f AS (SELECT list(mean ORDER BY dim) AS m, list(sd ORDER BY dim) AS s FROM (SELECT dim, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM x GROUP BY dim)),
  z AS (SELECT doc, vec_id, list_transform(range(1, 65), lambda i: (e[i] - m[i]) / s[i]) AS z FROM v, f WHERE doc IS NOT NULL), k AS (SELECT t.doc, t.vec_id, list_distance(t.z, b.z) AS dist, row_number() OVER (PARTITION BY t.vec_id ORDER BY list_distance(t.z, b.z), b.vec_id) AS n FROM z t, z b WHERE t.doc <> '0' AND b.doc = '0' QUALIFY n <= 25),
  r AS (SELECT doc, vec_id, avg(dist) AS raw FROM k GROUP BY ALL)
SELECT doc, round(avg(raw), 5) AS distance FROM r GROUP BY doc""")
def baseline_distances(spark, d):
    """Distance of every other group to the first, scaled on that one only."""
    e = V.vectors(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label").cast("string").alias("doc"))
    return Y.baseline_distance(e.where("doc <> '0'"), e.where("doc = '0'").select("id", "v")).select("doc", F.round("distance", 5).alias("distance"))


@query("SELECT book_id, chapter_index AS segment_index, 'words' AS metric, w AS value, round(w - lag(w) OVER (PARTITION BY book_id ORDER BY chapter_index), 4) AS change FROM (SELECT book_id, chapter_index, sum(word_count)::DOUBLE AS w FROM book_sections WHERE word_count IS NOT NULL GROUP BY ALL)")
def progression(spark, d):
    v = table(spark, d, "book_sections").where("word_count is not null").groupBy("book_id", F.col("chapter_index").alias("segment_index")).agg(F.sum("word_count").cast("double").alias("value")).withColumn("metric", F.lit("words"))
    return Y.progression(v).select("book_id", "segment_index", "metric", "value", "change")


