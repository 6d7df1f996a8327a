"""Book tables, segments, vectors, features and comparisons over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.unicode import slug
from ..operators import comparison as C
from ..operators import evidence as E
from ..operators import metrics as M
from ..operators import segmentation as SG
from ..operators import tables as B
from ..operators import taxonomy as X
from ..operators import vectors as V
from ..sources import exports
from ..tables import cut, table
from . import sql as S
from .text_queries import DOCS, docs, r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WORDS = T.IMPORT_WORD.replace("'", "''")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- book tables -------------------------------------------------------------
@query("SELECT book_id, count(*) AS sections, sum(word_count)::BIGINT AS words FROM book_sections WHERE included GROUP BY book_id")
def included_sections(spark, d):
    return table(spark, d, "book_sections").where("included").groupBy("book_id").agg(F.count("*").alias("sections"), F.sum("word_count").alias("words"))


_MARKS = " OR ".join(f"contains(head, '{w}')" for w in B.PUBLISHING)


@query(f"""WITH x AS (SELECT section_id, coalesce(chapter_title, '') AS title, coalesce(book_title, '') AS book, lower(substr(coalesce(content, ''), 1, 4000)) AS head,
    count(*) OVER (PARTITION BY book_id) AS total, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index NULLS FIRST, section_id) - 1 AS place FROM book_sections),
  y AS (SELECT *, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) AS name, total > 1 AND place < greatest(2, total // 10) AS early,
    book <> '' AND regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') = regexp_replace(lower(book), '[^a-z0-9]+', '-', 'g') AS same FROM x)
SELECT section_id, CASE WHEN name IN ({S.quoted(list(B.FRONT))}) OR (early AND (name IN ('text', 'document') OR same OR {_MARKS})) THEN 'front' WHEN name IN ({S.quoted(list(B.BACK))}) THEN 'back' ELSE 'body' END AS matter_class FROM y""")
def matter_classifier(spark, d):
    return B.matter(table(spark, d, "book_sections")).select("section_id", "matter_class")


@query("SELECT section_id FROM book_sections WHERE content IS NOT NULL AND sha256(content) IS DISTINCT FROM text_sha256")
def stale_hashes(spark, d):
    return B.stale_hashes(table(spark, d, "book_sections"))


@query("SELECT book_id, chapter_index, count(*) AS n FROM book_sections GROUP BY ALL HAVING count(*) > 1")
def duplicate_chapters(spark, d):
    return B.duplicates(table(spark, d, "book_sections"), "book_id", "chapter_index")


@query(f"SELECT section_id, word_count, len(regexp_extract_all(content, '{WORDS}'))::INT AS counted FROM book_sections WHERE content IS NOT NULL")
def import_word_counts(spark, d):
    return table(spark, d, "book_sections").where("content is not null").select("section_id", "word_count", T.word_count(F.col("content"), T.IMPORT_WORD).alias("counted"))


@query("SELECT book_id, count(*) AS n, round(avg(word_count), 6) AS mean, median(word_count) AS median, min(word_count) AS low, max(word_count) AS high FROM book_sections WHERE word_count IS NOT NULL GROUP BY book_id")
def book_summary(spark, d):
    return r6(B.summary(table(spark, d, "book_sections"), "book_id", "word_count"))


@query("WITH h AS (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) SELECT a.source, b.lang FROM (SELECT DISTINCT source FROM h) a, (SELECT DISTINCT lang FROM h) b WHERE NOT EXISTS (FROM h WHERE h.source = a.source AND h.lang = b.lang)")
def coverage_gaps(spark, d):
    return B.coverage(table(spark, d, "documents"), "source", "lang").select("source", "lang")


@query("SELECT source FROM documents WHERE lang IN ('en','de','fr') GROUP BY source HAVING count(DISTINCT lang) = 3")
def complete_sources(spark, d):
    return B.complete(table(spark, d, "documents"), "source", "lang", ["en", "de", "fr"])


@query("SELECT source, count(*) AS n FROM documents WHERE book_title IN (SELECT book_title FROM book_inventory) GROUP BY source")
def known_titles(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "book_inventory").select("book_title"), "book_title", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT book_id FROM book_inventory i WHERE NOT EXISTS (FROM book_sections s WHERE s.book_id = i.book_id AND s.matter = 'front')")
def books_without_front(spark, d):
    return table(spark, d, "book_inventory").select("book_id").join(table(spark, d, "book_sections").where("matter = 'front'").select("book_id"), "book_id", "left_anti")


@query("SELECT language, section_id, word_count, row_number() OVER (PARTITION BY language ORDER BY word_count DESC NULLS LAST, section_id)::INT AS rank FROM book_sections QUALIFY rank <= 5")
def longest_per_language(spark, d):
    return B.top_per_group(table(spark, d, "book_sections"), "language", F.col("word_count").desc_nulls_last(), "section_id").select("language", "section_id", "word_count", "rank")


@query("SELECT lang, count(*) AS n, coalesce(nullif(list_position(['en','de','fr','es'], lang), 0), 5)::BIGINT AS place FROM documents GROUP BY lang")
def language_order(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("place", F.coalesce(B.by_list(F.col("lang"), ["en", "de", "fr", "es"]), F.lit(5)).cast("long"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE contains(lower(book_title), 'mor') GROUP BY source")
def title_search(spark, d):
    return table(spark, d, "documents").where(F.lower("book_title").contains("mor")).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH v AS (SELECT word_count::DOUBLE AS v FROM book_sections WHERE word_count IS NOT NULL), s AS (SELECT min(v) AS lo, max(v) AS hi, stddev_pop(v) AS sd, count(*) AS n FROM v),
  p AS (SELECT unnest(range(65)) AS point), h AS (SELECT *, greatest((hi - lo) / 30, 1.06 * sd * pow(n, -0.2)) AS h FROM s)
SELECT point::INT AS point, round(any_value(lo + (hi - lo) * point / 64), 6) AS x, round(sum(exp(-0.5 * pow((lo + (hi - lo) * point / 64 - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 9) AS density FROM p, v, h GROUP BY point""")
def size_density(spark, d):
    return V.density(table(spark, d, "book_sections"), "word_count").select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query(r"""SELECT '"' || CASE WHEN regexp_matches(book_id, '^\s*[=+\-@]') THEN '''' ELSE '' END || replace(book_id, '"', '""') || '";"' || CASE WHEN regexp_matches(coalesce(book_title, ''), '^\s*[=+\-@]') THEN '''' ELSE '' END || replace(coalesce(book_title, ''), '"', '""') || '";"' || coalesce(section_count::VARCHAR, '') || '"' AS line FROM book_inventory""")
def export_lines(spark, d):
    return exports.csv_line(table(spark, d, "book_inventory").select("book_id", "book_title", "section_count"))


_HEAD = r"(?i)^(?:chapter|kapitel|part|teil|book)\s+(?:[0-9ivxlcdm]+|[\p{L}\p{N}_-]+)(?:\s*[:.\-—–]\s*.*)?$"


@query(rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM l),
  y AS (SELECT doc_id, line_no, line, regexp_matches(trim(line), '{_HEAD}') AS heading FROM x), z AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM y)
SELECT doc_id, part::BIGINT AS part, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM z GROUP BY ALL""")
def heading_parts(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    p = B.heading_runs(lines, F.trim("line").rlike(_HEAD))
    return p.groupBy(F.col("text_id").alias("doc_id"), "part").agg(F.count("*").alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"))


# -- segments ----------------------------------------------------------------
def one_delivery(spark: SparkSession, d: str) -> DataFrame:
    """The first delivered, included section of every chapter."""
    s = table(spark, d, "book_sections").where("included and content is not null and chapter_index is not null")
    first = s.groupBy("book_id", "chapter_index").agg(F.min("section_id").alias("section_id"))
    return s.join(first.select("section_id"), "section_id", "left_semi")


SIZES = (600, 1000, 1400)
_FIRST = "s AS (SELECT book_id, chapter_index, arg_min(content, section_id) AS content FROM book_sections WHERE included AND content IS NOT NULL AND chapter_index IS NOT NULL GROUP BY ALL)"


@query()
def book_segments(spark, d):
    return SG.segments(one_delivery(spark, d), *SIZES).drop("text")


@query(f"WITH {_FIRST} SELECT book_id, sum(len(regexp_extract_all(content, '{WORDS}')))::BIGINT AS words FROM s GROUP BY book_id HAVING sum(len(regexp_extract_all(content, '{WORDS}'))) > 0")
def segment_words(spark, d):
    """Words a book, counted in its segments: the SQL counts them in the sections."""
    return SG.segments(one_delivery(spark, d), *SIZES).groupBy("book_id").agg(F.sum("word_count").alias("words")).where("words > 0")


@query(f"WITH {_FIRST}, w AS (SELECT book_id, unnest(regexp_extract_all(content, '{WORDS}')) AS w FROM s) SELECT book_id, count(*) AS words, sum(length(w))::BIGINT AS letters, 0::BIGINT AS lost FROM w GROUP BY book_id")
def segment_losses(spark, d):
    """Words of each book compared with those of its segments, place by place: all are there and none differs."""
    s = one_delivery(spark, d)
    return SG.loss_report(s, SG.segments(s, *SIZES))


@query()
def chapter_cover(spark, d):
    s = one_delivery(spark, d)
    return SG.covering(SG.segments(s, *SIZES), s.select("book_id", "chapter_index"))


# -- vectors -----------------------------------------------------------------
def _emb(spark: SparkSession, d: str) -> DataFrame:
    return V.vectors(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label").cast("string").alias("label"))


_PAIRS = "list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[])"
_KNN = f"knn AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, r.label::VARCHAR AS label, {_PAIRS} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_PAIRS}, r.vec_id) AS rank FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id QUALIFY rank <= 25)"


def _loo(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    return V.knn(e.where("id % 20 = 0"), e, 25, "label")


@query(f"WITH {_KNN} SELECT query_id, round(avg(distance), 6) AS raw FROM knn GROUP BY query_id")
def knn_rarity(spark, d):
    return r6(V.rarity(_loo(spark, d)))


@query(f"WITH {_KNN} SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank::INT AS rank FROM knn")
def knn_neighbors(spark, d):
    return r6(_loo(spark, d).select("query_id", "neighbor_id", "distance", "rank"))


@query(f"""WITH {_KNN}, c AS (SELECT query_id, label, count(*) AS n FROM knn GROUP BY ALL) SELECT query_id, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS counts FROM c GROUP BY query_id""")
def neighbor_sources(spark, d):
    return V.source_counts(_loo(spark, d), "label")


@query("""WITH r AS (SELECT reference_index, matrix::DOUBLE[] AS m FROM reference_matrix WHERE matrix IS NOT NULL AND len(matrix) = 64 AND len(list_filter(matrix, lambda x: x IS NULL OR isnan(x))) = 0),
  k AS (SELECT q.vec_id, list_distance(q.embedding::DOUBLE[], r.m) AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], r.m), r.reference_index) AS n FROM embeddings q, r WHERE q.vec_id % 20 = 0 QUALIFY n <= 25)
SELECT vec_id AS query_id, round(avg(dist), 6) AS raw FROM k GROUP BY vec_id""")
def knn_external(spark, d):
    """Rarity of a query set of one table against another."""
    ref = V.vectors(table(spark, d, "reference_matrix"), "reference_index", "matrix").where(F.size("v") == 64)
    return r6(V.rarity(V.knn(_emb(spark, d).where("id % 20 = 0"), ref, 25, exclude_self=False)))


@query("""WITH r AS (SELECT n_chars::DOUBLE AS v FROM documents WHERE lang = 'en' AND n_chars IS NOT NULL), q AS (SELECT doc_id, n_chars::DOUBLE AS v FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL), c AS (SELECT v, count(*) AS c FROM r GROUP BY v), n AS (SELECT count(*) AS n FROM r)
SELECT q.doc_id, round(sum(CASE WHEN c.v <= q.v THEN c.c ELSE 0 END) / any_value(n.n), 6) AS "right", round(sum(CASE WHEN c.v < q.v THEN c.c ELSE 0 END) / any_value(n.n), 6) AS "left",
  round((sum(CASE WHEN c.v <= q.v THEN c.c ELSE 0 END) + sum(CASE WHEN c.v < q.v THEN c.c ELSE 0 END)) / 2 / any_value(n.n), 6) AS mid FROM q, c, n GROUP BY q.doc_id""")
def ecdf(spark, d):
    """Percentile of the documents' sizes among those of the English ones, in the three ways of counting ties."""
    s = table(spark, d, "documents").where("n_chars is not null").select("doc_id", "lang", F.col("n_chars").cast("double").alias("value"))
    return r6(V.percentiles(s.where("lang is not null").select("doc_id", "value"), s.where("lang = 'en'").select("value")).select("doc_id", "right", "left", "mid"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), f AS (SELECT dim, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM x GROUP BY dim)
SELECT vec_id AS id, round(sqrt(sum(pow((x - mean) / sd, 2))), 5) AS norm FROM x JOIN f USING (dim) GROUP BY vec_id""")
def vector_zscore(spark, d):
    e = _emb(spark, d)
    z = V.scale(e, V.scale_fit(e))
    return z.select("id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 5).alias("norm"))


@query("""WITH x AS (SELECT label::VARCHAR AS label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), c AS (SELECT label, dim, avg(x) AS c FROM x GROUP BY ALL)
SELECT a.label AS group_a, b.label AS group_b, round(sqrt(sum(pow(a.c - b.c, 2))), 6) AS distance FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label GROUP BY ALL""")
def centroid_distance(spark, d):
    return r6(V.centroid_distances(_emb(spark, d), "label"))


# -- comparison --------------------------------------------------------------
_PEERS = """p AS (SELECT a.book_id, a.section_id, any_value(a.word_count)::DOUBLE AS word_count, count(*) AS n, quantile_cont(b.word_count::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM book_sections a JOIN book_sections b ON a.book_id = b.book_id AND a.section_id <> b.section_id WHERE a.word_count IS NOT NULL AND b.word_count IS NOT NULL GROUP BY ALL HAVING count(*) >= 1)"""


@query(f"WITH {_PEERS} SELECT book_id, section_id, word_count, n, CASE WHEN n >= 4 THEN round(q[1], 6) END AS q25, CASE WHEN n >= 4 THEN round(q[2], 6) END AS median, CASE WHEN n >= 4 THEN round(q[3], 6) END AS q75 FROM p")
def peer_bands(spark, d):
    b = C.peer_bands(table(spark, d, "book_sections"), "book_id", "section_id", "word_count").where("n >= 1")
    return r6(b.select("book_id", "section_id", "word_count", "n", "q25", "median", "q75"))


@query(f"""WITH {DOCS}, {S.TOKENS}, t AS (SELECT unit_id, count(*)::INT AS total FROM tokens GROUP BY unit_id), c AS (SELECT unit_id, total, least(9, total // 200)::INT AS k FROM t WHERE total >= 200),
  s AS (SELECT unit_id, unnest(range(k)) AS win, k, total FROM c), w AS (SELECT unit_id, win, CASE WHEN k = 1 THEN (total - 200) // 2 ELSE round_even(win * (total - 200) / (k - 1), 0)::INT END AS start FROM s)
SELECT w.unit_id, win::INT AS "window", start::INT AS start, count(*) AS words, count(DISTINCT word) AS types FROM w JOIN tokens t ON t.unit_id = w.unit_id AND pos >= start AND pos < start + 200 GROUP BY ALL""")
def matched_windows(spark, d):
    return C.matched_windows(M.tokens(docs(spark, d)), 200)


# -- evidence ----------------------------------------------------------------
# -- features ----------------------------------------------------------------
SPECS = [
    X.Feature("lang", "categorical", ("en", "de", "fr", "es", "ru", "other")),
    X.Feature("len", "ordinal", ("short", "medium", "long")),
    X.Feature("grade", "scale", ("1", "2", "3", "4", "5")),
    X.Feature("tags", "multi_select", ("quoted", "lines", "digits")),
    X.Feature("house", "categorical", ("Lantern Press", "Old Quay", "Copper Lane (London)", "salt and ink", "1 Night Train")),
]


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """A wide feature table made of the documents."""
    t = F.coalesce("text", F.lit(""))
    n = F.length(t)
    tag = lambda c, name: F.when(c, F.lit(name))
    return table(spark, d, "documents").select(
        "doc_id", F.when(F.col("lang").isNull(), "n/a").when(F.col("lang").isin("en", "de", "fr", "es", "ru"), F.col("lang")).otherwise("other").alias("lang"),
        F.when(n < 300, "short").when(n < 1500, "medium").otherwise("long").alias("len"), F.when(n == 0, "NA").otherwise((n % 5 + 1).cast("string")).alias("grade"),
        F.concat_ws("|", tag(t.contains("“"), "quoted"), tag(t.contains("\n"), "lines"), tag(t.rlike("[0-9]"), "digits")).alias("tags"), F.upper(F.col("source")).alias("house"),
    )


_FT = """f AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 'n/a' WHEN lang IN ('en','de','fr','es','ru') THEN lang ELSE 'other' END AS lang, CASE WHEN length(coalesce(text, '')) < 300 THEN 'short' WHEN length(coalesce(text, '')) < 1500 THEN 'medium' ELSE 'long' END AS len,
  CASE WHEN length(coalesce(text, '')) = 0 THEN 'NA' ELSE (length(coalesce(text, '')) % 5 + 1)::VARCHAR END AS grade, coalesce(contains(text, '“'), false) AS quoted, coalesce(contains(text, chr(10)), false) AS lines, coalesce(regexp_matches(text, '[0-9]'), false) AS digits, upper(source) AS house FROM documents)"""


@query(f"""WITH {_FT} SELECT doc_id, '[' || array_to_string([(lang = v)::INT FOR v IN ['en','de','fr','es','ru','other']] || [(lang = 'n/a')::INT, list_position(['short','medium','long'], len) - 1, CASE WHEN grade = 'NA' THEN -1 ELSE grade::INT END, quoted::INT, lines::INT, digits::INT, 0], ',') || ']' AS encoded FROM f""")
def onehot_encode(spark, d):
    specs = [f for f in SPECS if f.id != "house"]
    return feature_table(spark, d).select("doc_id", F.to_json(F.transform(X.encode(specs), lambda x: x.cast("int"))).alias("encoded"))


_HOUSE = "SELECT unnest(['Lantern Press','Old Quay','Copper Lane (London)','salt and ink','1 Night Train']) AS value, unnest(range(5)) AS place"


def _key(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '\\s*\\([^)]*\\)', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""WITH raw AS (SELECT DISTINCT upper(source) AS raw FROM documents WHERE source IS NOT NULL), a AS ({_HOUSE}), j AS (SELECT raw, value, place, {_key("raw")} AS rk, {_key("value")} AS ak FROM raw, a),
  k AS (SELECT *, len(list_intersect(list_distinct(string_split(rk, '_')), list_distinct(string_split(ak, '_')))) / greatest(len(list_distinct(string_split(rk, '_'))), len(list_distinct(string_split(ak, '_')))) AS o FROM j),
  s AS (SELECT *, CASE WHEN rk = ak THEN 1 WHEN regexp_extract(rk, '^(\\d+)', 1) <> '' AND regexp_extract(rk, '^(\\d+)', 1) = regexp_extract(ak, '^(\\d+)', 1) THEN 2 WHEN starts_with(rk, ak) OR starts_with(ak, rk) THEN 3 WHEN o >= 0.5 THEN 4 END AS step FROM k),
  b AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY step NULLS LAST, CASE WHEN step = 4 THEN -o END NULLS FIRST, place) AS n FROM s)
SELECT 'house' AS feature_id, raw, CASE WHEN step IS NULL THEN raw ELSE value END AS canonical, coalesce(['normalized_exact','numeric_prefix','prefix','token_overlap'][step], 'unmatched') AS method FROM b WHERE n = 1""")
def taxonomy_match(spark, d):
    raw = table(spark, d, "documents").where("source is not null").select(F.lit("house").alias("feature_id"), F.upper("source").alias("raw"))
    return X.best_match(raw, X.vocabulary(spark, [f for f in SPECS if f.id == "house"]))


@query(f"WITH {_FT} SELECT doc_id, 'house' AS feature_id, house AS value FROM f WHERE house IS NOT NULL AND house NOT IN (SELECT value FROM ({_HOUSE}))")
def invalid_cells(spark, d):
    return X.invalid(feature_table(spark, d), "doc_id", SPECS).select("doc_id", "feature_id", "value")


@query()
def title_slugs(spark, d):
    """Slugs of the book titles."""
    return table(spark, d, "documents").select("doc_id", slug("book_title").alias("slug"))
