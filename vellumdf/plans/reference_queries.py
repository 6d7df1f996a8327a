"""Splits, coverage, features, scores and shared spaces over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.display import german_number, intensity
from ..functions.unicode import nfc
from ..operators import library as Y
from ..operators import reference as R
from ..operators import segmentation as SG
from ..operators import taxonomy as X
from ..operators import vectors as V
from ..tables import cut, table
from .table_queries import _FIRST, _FT, ORACLE as TABLES, SIZES, SPECS, WORDS, _emb, feature_table, one_delivery
from .text_queries import r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- splits and coverage -----------------------------------------------------------
def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reference_matrix")


@query("SELECT book_id, string_agg(language, ',' ORDER BY language) AS splits FROM (SELECT DISTINCT book_id, language FROM book_sections WHERE language IS NOT NULL AND book_id IS NOT NULL) GROUP BY book_id HAVING count(*) > 1")
def split_purity(spark, d):
    """Books, as keys, whose sections are in more than one language, as splits."""
    rows = table(spark, d, "book_sections").select("book_id", F.col("language").alias("split"))
    return R.impure(rows, "book_id").select("book_id", F.array_join("splits", ",").alias("splits"))


@query("SELECT DISTINCT prompt_id FROM reference_matrix WHERE split IN ('train', 'val') AND prompt_id IS NOT NULL")
def split_union(spark, d):
    """Prompts of both splits, each read from rows of its split only."""
    m = _matrix(spark, d)
    return R.union_ids(*(R.split_ids(m.where(F.col("split") == s), s) for s in ("train", "val")))


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents as rows of languages (keys) and collections (sources), the languages, the collections: some two dozen."""
    rows = table(spark, d, "documents").select("lang", "source")
    return rows, rows.where("lang is not null").select("lang").distinct(), sorted(r.source for r in rows.where("source is not null").select("source").distinct().collect())


_IDS = "ids AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), src AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), have AS (SELECT DISTINCT lang, source FROM documents WHERE source IS NOT NULL)"


@query(f"""WITH {_IDS}, p AS (SELECT ids.lang, count(have.source) AS k FROM ids LEFT JOIN have USING (lang) GROUP BY 1), n AS (SELECT count(*) AS n FROM src)
SELECT (count(*) * any_value(n))::BIGINT AS expected_rows, sum(k)::BIGINT AS present_rows, (count(*) * any_value(n) - sum(k))::BIGINT AS missing_rows, count(*) FILTER (k < n) AS incomplete, count(*) FILTER (k = 0) AS missing_ids FROM p, n""")
def coverage_report(spark, d):
    return R.coverage(*_grid(spark, d), "lang")


@query(f"WITH {_IDS} SELECT lang, string_agg(source, ',' ORDER BY source) AS missing FROM (SELECT lang, source FROM ids, src EXCEPT SELECT lang, source FROM have) GROUP BY lang")
def missing_sources(spark, d):
    return R.missing_sources(*_grid(spark, d), "lang").select("lang", F.array_join("missing", ",").alias("missing"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def source_coverage(spark, d):
    return R.source_counts(table(spark, d, "documents"), "lang")


@query("SELECT s.section_id FROM book_sections s WHERE s.book_id NOT IN (SELECT book_id FROM book_sections WHERE content IS NULL OR language IS NULL) AND s.content IS NOT NULL AND s.language IS NOT NULL")
def complete_features(spark, d):
    """Sections with text and language of the books all of whose sections have both."""
    s = table(spark, d, "book_sections")
    return R.complete_groups(s.where("content is not null and language is not null").select("section_id"), s.select("book_id", "section_id"), "book_id", "section_id")


@query(f"WITH {_FT} SELECT f.len, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN f USING (doc_id) GROUP BY f.len")
def aligned_results(spark, d):
    """Sizes of the documents beside their features, one to one."""
    return R.aligned(table(spark, d, "documents").select("doc_id", "n_chars"), feature_table(spark, d).select("doc_id", "len"), "doc_id").groupBy("len").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(book_title, '')), 'mor') OR contains(lower(coalesce(chapter_title, '')), 'mor')")
def title_name_search(spark, d):
    return R.search(table(spark, d, "documents"), "MOR", "book_title", "chapter_title").select("doc_id")


# -- features ----------------------------------------------------------------------
@query(f"""WITH {_FT}, t AS ({TABLES["taxonomy_match"]})
SELECT 'house' AS feature_id, raw, canonical, method, count(*) AS count FROM f JOIN t ON t.raw = f.house WHERE raw <> canonical GROUP BY ALL
UNION ALL SELECT 'house', NULL, 'n/a', 'missing_marker', count(*) FROM f WHERE house IS NULL HAVING count(*) > 0
UNION ALL SELECT 'grade', 'NA', 'n/a', 'missing_marker', count(*) FROM f WHERE grade = 'NA' HAVING count(*) > 0""")
def canonical_changes(spark, d):
    return X.changes(X.canonical(feature_table(spark, d), "doc_id", SPECS))


_TAGS = "array_to_string(list_filter([CASE WHEN quoted THEN 'quoted' END, CASE WHEN lines THEN 'lines' END, CASE WHEN digits THEN 'digits' END], lambda x: x IS NOT NULL), '|')"


@query(f"""WITH {_FT}, t AS ({TABLES["taxonomy_match"]}) SELECT doc_id, lang, len, CASE WHEN grade = 'NA' THEN 'n/a' ELSE grade END AS grade, {_TAGS} AS tags, coalesce(canonical, 'n/a') AS house FROM f LEFT JOIN t ON t.raw = f.house""")
def canonical_table(spark, d):
    """The wide feature table with canonical values."""
    return X.pivot_back(X.canonical(feature_table(spark, d), "doc_id", SPECS), "doc_id", SPECS)


@query(f"""WITH {_FT} SELECT 'lang' AS feature_id, count(*) FILTER (lang = 'n/a') AS n FROM f UNION ALL SELECT 'len', 0 UNION ALL SELECT 'grade', count(*) FILTER (grade = 'NA') FROM f UNION ALL SELECT 'tags', 0 UNION ALL SELECT 'house', count(*) FILTER (house IS NULL) FROM f""")
def missing_cells(spark, d):
    return X.missing_counts(feature_table(spark, d), "doc_id", SPECS)


_REF_DIMS = "list_value((lang = 'en')::INT, (lang = 'de')::INT, (lang = 'fr')::INT, (lang = 'es')::INT, (lang = 'ru')::INT, (lang = 'other')::INT, (lang = 'n/a')::INT, list_position(['short','medium','long'], len) - 1, CASE WHEN grade = 'NA' THEN -1 ELSE grade::INT END, quoted::INT, lines::INT, digits::INT, 0)"


@query(f"""WITH {_FT}, e AS (SELECT doc_id, {_REF_DIMS}::DOUBLE[] AS v FROM f), x AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e),
  s AS (SELECT dim, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM x GROUP BY dim) SELECT doc_id AS id, dim::INT AS dim, round((x - m) / sd, 6) AS z FROM x JOIN s USING (dim)""")
def reference_build(spark, d):
    """The documents' features made canonical, checked, encoded and scaled."""
    r = R.build(feature_table(spark, d), "doc_id", [f for f in SPECS if f.id != "house"])
    return r6(r.rows.select("id", F.posexplode("v").alias("dim", "z")))


# -- scores -------------------------------------------------------------------------
_R64 = "r AS MATERIALIZED (SELECT reference_index AS id, source, matrix::DOUBLE[] AS v FROM reference_matrix WHERE matrix IS NOT NULL AND len(matrix) = 64 AND len(list_filter(matrix, lambda x: x IS NULL OR isnan(x))) = 0)"
_JSON = "'{' || string_agg('\"' || coalesce(source, 'null') || '\":' || n, ',' ORDER BY source) || '}'"


@query(f"""WITH {_R64}, own AS (SELECT a.id, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS k FROM r a, r b WHERE a.id % 20 = 0 AND a.id <> b.id QUALIFY k <= 25), rar AS (SELECT avg(dist) AS value FROM own GROUP BY id),
  q AS (SELECT e.vec_id, r.source, list_distance(e.embedding::DOUBLE[], r.v) AS dist, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], r.v), r.id) AS k FROM embeddings e, r WHERE e.vec_id % 20 = 0 QUALIFY k <= 25),
  raw AS (SELECT vec_id, avg(dist) AS raw FROM q GROUP BY 1), c AS (SELECT vec_id, {_JSON} AS counts FROM (SELECT vec_id, source, count(*) AS n FROM q GROUP BY ALL) GROUP BY vec_id)
SELECT vec_id AS id, round(raw, 6) AS raw, round((SELECT count(*) FILTER (value <= raw) / count(*) FROM rar), 6) AS percentile, counts FROM raw JOIN c USING (vec_id)""")
def reference_scores(spark, d):
    """Vectors of one table scored against the reference: raw rarity, percentile among the reference's own, sources of the neighbours."""
    ref = V.vectors(_matrix(spark, d), "reference_index", "matrix", F.coalesce("source", F.lit("null")).alias("source")).where(F.size("v") == 64)
    own = V.rarity(V.knn(ref.where("id % 20 = 0"), ref, 25)).select(F.col("raw").alias("value"))
    return r6(R.score(_emb(spark, d).where("id % 20 = 0"), ref, own))


_E = "e AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0)"


@query(f"""WITH {_E}, k AS (SELECT a.id, a.label, b.label::VARCHAR AS source, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS n FROM e a, e b WHERE a.id <> b.id QUALIFY n <= least(25, (SELECT count(*) FROM e) - 1)),
  raw AS (SELECT id, any_value(label) AS label, avg(dist) AS raw FROM k GROUP BY id), c AS (SELECT id, {_JSON} AS counts FROM (SELECT id, source, count(*) AS n FROM k GROUP BY ALL) GROUP BY id)
SELECT id, label::VARCHAR AS label, least(25, (SELECT count(*) FROM e) - 1)::INT AS k, round(raw, 6) AS raw, counts FROM raw JOIN c USING (id)""")
def leave_one_out(spark, d):
    """Every vector among the others."""
    return r6(R.leave_one_out(_emb(spark, d), "label").select("id", "label", "k", "raw", "counts"))


_SHARED = f"""{_E}, t AS (SELECT * FROM e WHERE label < 6), x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM t), s AS (SELECT list(m ORDER BY dim) AS m, list(sd ORDER BY dim) AS sd FROM (SELECT dim, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM x GROUP BY dim)),
  z AS MATERIALIZED (SELECT id, label::VARCHAR AS label, list_transform(range(1, len(v) + 1), lambda i: (v[i] - m[i]) / sd[i]) AS v FROM t, s)"""


def _six(spark: SparkSession, d: str) -> DataFrame:
    """Six texts, the most that are compared at once."""
    return _emb(spark, d).where(F.col("label").cast("int") < 6)


@query(f"""WITH {_SHARED}, k AS (SELECT a.id, a.label, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS n FROM z a, z b WHERE a.id <> b.id QUALIFY n <= 25), raw AS (SELECT id, any_value(label) AS label, avg(dist) AS raw FROM k GROUP BY id)
SELECT label, count(*) AS segments, round(avg(raw), 5) AS mean, round(median(raw), 5) AS median FROM raw GROUP BY label""")
def shared_series(spark, d):
    """Rarity of six texts in a space of their own."""
    return R.shared_space(_six(spark, d), "label")[0].select("label", "segments", F.round("mean", 5).alias("mean"), F.round("median", 5).alias("median"))


@query(f"""WITH {_SHARED}, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM z), c AS (SELECT label, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS m FROM u GROUP BY ALL) GROUP BY label)
SELECT a.label AS group_a, b.label AS group_b, round(list_distance(a.c, b.c), 5) AS distance FROM c a, c b WHERE a.label < b.label""")
def shared_distances(spark, d):
    return R.shared_space(_six(spark, d), "label")[1].select("group_a", "group_b", F.round("distance", 5).alias("distance"))


@query(f"""WITH {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS place FROM e) SELECT a.label::VARCHAR AS label, a.id, b.place::INT AS place, round(list_distance(a.v, b.v), 5) AS distance FROM o a JOIN o b USING (label)""")
def segment_distances(spark, d):
    """The matrix of distances of each text, in reading order."""
    return R.pairwise(_emb(spark, d), "label", "id").select("label", "id", F.posexplode("distances").alias("place", "x")).select("label", "id", "place", F.round("x", 5).alias("distance"))


@query(f"""WITH {_E}, ok AS (SELECT label FROM e GROUP BY label HAVING bool_and(id >= 4)), u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e JOIN ok USING (label)), c AS (SELECT label, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS m FROM u GROUP BY ALL) GROUP BY label)
SELECT a.label AS group_a, b.label AS group_b, round(list_distance(a.c, b.c), 5) AS distance FROM c a, c b WHERE a.label < b.label""")
def chapter_space(spark, d):
    """Distances of the chapters all of whose segments lie inside; here: of the groups none of whose vectors is among the first four."""
    v = V.vectors(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label").alias("chapter_index"))
    cover = v.groupBy("chapter_index").agg(F.bool_and(F.col("id") >= 4).alias("all_inside"))
    return Y.chapter_distances(v, cover).select("group_a", "group_b", F.round("distance", 5).alias("distance"))


@query("""WITH p AS (SELECT CASE WHEN source = 'lantern_press' THEN 'human' ELSE source END AS source, cume_dist() OVER (ORDER BY n_chars) AS percentile FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL),
  h AS (SELECT source, CASE WHEN source = 'human' THEN least(1.0, percentile + 0.25) ELSE percentile END AS percentile FROM p),
  g AS (SELECT 'as measured' AS scores, * FROM p UNION ALL SELECT 'shifted', * FROM h), m AS (SELECT scores, avg(percentile) FILTER (source = 'human') AS human_mean, avg(percentile) FILTER (source <> 'human') AS machine_mean FROM g GROUP BY scores),
  w AS (SELECT *, coalesce(abs(human_mean - 0.71) <= 0.1 AND abs(machine_mean - 0.49) <= 0.1, false) AS within_tolerance FROM m)
SELECT scores, d.n::INT AS dimensions, round(human_mean, 6) AS human_mean, round(machine_mean, 6) AS machine_mean, within_tolerance, CASE WHEN within_tolerance AND d.n = 958 THEN 'exact' ELSE 'reconstruction' END AS status FROM w, (VALUES (958), (64)) d(n)""")
def quality_gate(spark, d):
    """The gate over percentiles of document sizes, as they are and with one source shifted, at the published number of dimensions and another."""
    x = table(spark, d, "documents").where("source is not null and n_chars is not null").select("source", F.col("n_chars").cast("double").alias("value"))
    p = cut(V.percentiles(x, x.select("value")).select(F.when(F.col("source") == "lantern_press", "human").otherwise(F.col("source")).alias("source"), F.col("right").alias("percentile")))
    shifted = p.withColumn("percentile", F.when(F.col("source") == "human", F.least(F.lit(1.0), F.col("percentile") + 0.25)).otherwise(F.col("percentile")))
    gates = [Y.quality_gate(s, n, 0).select(F.lit(name).alias("scores"), F.lit(n).alias("dimensions"), "*") for name, s in (("as measured", p), ("shifted", shifted)) for n in (958, 64)]
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return r6(out)


# -- segmentation ------------------------------------------------------------------------
@query(f"WITH {_FIRST} SELECT book_id, chapter_index, sum(len(regexp_extract_all(content, '{WORDS}')))::BIGINT AS words FROM s GROUP BY ALL HAVING sum(len(regexp_extract_all(content, '{WORDS}'))) > 0")
def chapter_segments(spark, d):
    """Words of the segments of every chapter where no segment goes beyond its chapter: a chapter's segments hold its words, no others."""
    s = SG.segments(one_delivery(spark, d), *SIZES, by_chapter=True)
    return s.where("chapter_index = chapter_end_index").groupBy("book_id", "chapter_index").agg(F.sum("word_count").alias("words")).where("words > 0")


_CUTS = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY block_no) - 1 AS i, least(1400, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))) AS w, coalesce(boundary_before, 'paragraph') AS kind
    FROM (SELECT book_id, block_no, arg_min(text, block_id) AS text, arg_min(boundary_before, block_id) AS boundary_before FROM (SELECT * REPLACE (coalesce(text, '') AS text, coalesce(boundary_before, 'paragraph') AS boundary_before) FROM text_blocks) GROUP BY ALL)),
  c AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY book_id ORDER BY i) - w AS cum FROM t), n AS MATERIALIZED (SELECT book_id, count(*) AS n, sum(w) AS total FROM t GROUP BY book_id),
  e AS (SELECT book_id, i AS e, cum, kind FROM c WHERE i > 0 UNION ALL SELECT book_id, n, total, 'chapter' FROM n),
  v AS MATERIALIZED (SELECT *, CASE kind WHEN 'chapter' THEN 300.0 WHEN 'scene' THEN 100.0 WHEN 'forced' THEN -100.0 ELSE 0.0 END AS bonus FROM e),
  opt AS MATERIALIZED (SELECT a.book_id, a.i AS st, arg_min(v.e, (abs(v.cum - a.cum - 1000) - v.bonus, abs(v.cum - a.cum - 1000), v.e)) AS k FROM c a JOIN v ON v.book_id = a.book_id AND v.e > a.i AND v.cum - a.cum BETWEEN 600 AND 1400 GROUP BY ALL),
  walk AS (SELECT book_id, 0::BIGINT AS st FROM n UNION ALL SELECT o.book_id, o.k FROM walk JOIN opt o ON o.book_id = walk.book_id AND o.st = walk.st JOIN n ON n.book_id = o.book_id WHERE o.k < n.n),
  seg AS MATERIALIZED (SELECT walk.book_id, st AS m, c.cum AS cm, coalesce(lead(st) OVER own, n.n) AS b, coalesce(lead(c.cum) OVER own, n.total) AS cb, lag(st) OVER own AS a, lag(c.cum) OVER own AS ca, lead(st) OVER own IS NULL AS final
    FROM walk JOIN n ON n.book_id = walk.book_id JOIN c ON c.book_id = walk.book_id AND c.i = walk.st WINDOW own AS (PARTITION BY walk.book_id ORDER BY st)),
  pos AS MATERIALIZED (SELECT book_id, e, cum, bonus FROM v UNION ALL SELECT book_id, 0, 0, 0.0 FROM n),
  last AS MATERIALIZED (SELECT * FROM seg WHERE final AND a IS NOT NULL AND cb - cm < 600),
  mend AS (SELECT l.book_id, l.m, CASE WHEN l.cb - l.ca <= 1400 THEN -1 ELSE (SELECT arg_min(p.e, (abs(p.cum - l.ca - 1000) + abs(l.cb - p.cum - 1000) - p.bonus, abs(p.cum - l.ca - (l.cb - p.cum)), p.e)) FROM pos p WHERE p.book_id = l.book_id AND p.e > l.a AND p.e < l.b AND p.cum - l.ca BETWEEN 600 AND 1400 AND l.cb - p.cum BETWEEN 600 AND 1400) END AS k FROM last l),
  starts AS (SELECT w.book_id, coalesce(nullif(CASE WHEN mend.m IS NULL THEN w.st WHEN mend.k IS NULL THEN w.st ELSE mend.k END, -1), NULL) AS st FROM walk w LEFT JOIN mend ON mend.book_id = w.book_id AND mend.m = w.st),
  fin AS MATERIALIZED (SELECT book_id, st FROM starts WHERE st IS NOT NULL)
SELECT book_id, segment_index, count(*) AS blocks, sum(w)::BIGINT AS words FROM (
  SELECT c.book_id, c.w, (sum((fin.st IS NOT NULL)::INT) OVER (PARTITION BY c.book_id ORDER BY c.i) - 1)::INT AS segment_index FROM c LEFT JOIN fin ON fin.book_id = c.book_id AND fin.st = c.i) GROUP BY ALL"""


@query(_CUTS)
def block_segments(spark, d):
    """The stored blocks of each book cut into segments: blocks and words of each.  A block over the limit counts as one of the limit."""
    b = table(spark, d, "text_blocks").groupBy("book_id", "block_no").agg(F.min_by("text", "block_id").alias("text"), F.min_by("boundary_before", "block_id").alias("mark"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("block_no")) - 1
    b = cut(b.select("book_id", place.alias("block_no"), F.least(F.lit(1400), T.word_count(F.col("text"), T.IMPORT_WORD)).alias("words"), F.coalesce("mark", F.lit("paragraph")).alias("boundary_before")))
    return b.join(SG.assign_segments(b, 600, 1000, 1400), ["book_id", "block_no"]).groupBy("book_id", "segment_index").agg(F.count("*").alias("blocks"), F.sum("words").cast("long").alias("words"))


@query(rf"""WITH p AS (SELECT section_id, unnest(l) AS part, generate_subscripts(l, 1) AS i FROM (SELECT section_id, string_split(regexp_replace(coalesce(content, ''), '(\n{T.WS}*\n)', '\1' || chr(2), 'g'), chr(2)) AS l FROM book_sections)),
  q AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY section_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, length(part) - length(regexp_replace(part, '^{T.WS}+', '')) AS lead, length(regexp_replace(regexp_replace(part, '^{T.WS}+', ''), '{T.WS}+$', '')) AS size FROM p)
SELECT section_id, (row_number() OVER (PARTITION BY section_id ORDER BY i) - 1)::INT AS par, (base + lead)::INT AS start, (base + lead + size)::INT AS "end" FROM q WHERE size > 0""")
def paragraph_spans(spark, d):
    return SG.paragraph_spans(table(spark, d, "book_sections"), "section_id", "content")


_TIDY = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{T.WS}+', ''), '{T.WS}+$', '')"


@query(f"SELECT doc_id, sha256({_TIDY}) AS sha FROM documents")
def normalized_texts(spark, d):
    """Composed, tidied texts."""
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalize_breaks(nfc("text")), 256).alias("sha"))


# -- display ---------------------------------------------------------------------------
@query("""WITH b AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)
SELECT doc_id, replace(replace(replace(format('{:,.1f}', n_chars / 7.0), ',', '#'), '.', ','), '#', '.') AS shown, round(CASE WHEN n_chars IS NOT NULL THEN (n_chars - lo) / (hi - lo) END, 6) AS intensity FROM documents, b""")
def displayed_sizes(spark, d):
    """Sizes in German form and on a scale between the smallest and the largest."""
    x = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("v"))
    bounds = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    j = x.join(F.broadcast(bounds))
    return r6(j.select("doc_id", german_number(F.col("v") / 7, 1).alias("shown"), intensity(F.col("v"), F.col("lo"), F.col("hi")).alias("intensity")))
