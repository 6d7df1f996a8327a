"""Operations on a library of analysed books: settings, uploads, feature files, axes, spans, samples, baselines, gates."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import GROUPS, METRICS
from ..functions import text as T
from . import vectors as V
from .taxonomy import Feature, is_missing

MAX_UPLOAD = 30 * 1024 * 1024
SUFFIXES = ("epub", "docx", "txt", "pdf")


@dataclass(frozen=True)
class Settings:
    """Analysis settings; values out of bounds are an error."""

    language: str = "de"
    min_words: int = 3000
    target_words: int = 5000
    max_words: int = 7000
    exclude_front: bool = True
    exclude_back: bool = True
    long_sentence: int = 30
    long_share: int = 10
    text_profile: str = "narrative"
    parallel: int = 3
    groups: tuple[str, ...] = tuple(GROUPS)
    model: str = ""

    def __post_init__(self) -> None:
        whole = lambda *names: all(type(getattr(self, n)) is int for n in names)
        rules = {
            "language": self.language in ("de", "en", "und"),
            "segment sizes": whole("min_words", "target_words", "max_words") and 100 <= self.min_words <= self.target_words <= self.max_words <= 20_000,
            "long_sentence": whole("long_sentence") and 15 <= self.long_sentence <= 80,
            "long_share": whole("long_share") and 0 <= self.long_share <= 100,
            "text_profile": self.text_profile in ("narrative", "informative", "technical"),
            "parallel": whole("parallel") and 1 <= self.parallel <= 6,
            "groups": set(self.groups) <= set(GROUPS) and len(set(self.groups)) == len(self.groups),
            "exclusions": type(self.exclude_front) is bool and type(self.exclude_back) is bool,
            "model": re.fullmatch(r"[\w./-]{0,100}", self.model) is not None,
        }
        if bad := [k for k, ok in rules.items() if not ok]:
            raise ValueError(f"invalid settings: {', '.join(bad)}")

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Settings:
        if unknown := set(raw) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**raw)


def uploads(df: DataFrame) -> DataFrame:
    """name, content, error of base64 uploads (name, data): known suffix, valid text, at most 30 MB."""
    suffix = F.lower(F.element_at(F.split("name", r"\."), -1))
    content = F.try_to_binary("data", F.lit("base64"))
    error = F.when(F.col("name").isNull() | ~suffix.isin(*SUFFIXES), "unsupported file").when(content.isNull(), "not base64").when(F.octet_length(content) > MAX_UPLOAD, "too large")
    return df.select("name", F.when(error.isNull(), content).alias("content"), error.alias("error"))


# -- feature files -----------------------------------------------------------
def response_schema(specs: list[Feature]) -> dict:
    """JSON schema of one extraction: exactly the features, each from its closed vocabulary."""
    one = lambda f: {"type": "array", "items": {"enum": list(f.values)}, "uniqueItems": True} if f.type == "multi_select" else {"enum": [*f.values, "n/a"]}
    return {"type": "object", "additionalProperties": False, "required": [f.id for f in specs], "properties": {f.id: one(f) for f in specs}}


def feature_files(spark: SparkSession, glob: str) -> DataFrame:
    """prompt_id, story_title, features (map), path of JSON feature files."""
    return spark.read.schema("prompt_id long, story_title string, features map<string,string>").option("multiLine", True).json(glob).withColumn("path", F.input_file_name())


def compile_features(files: DataFrame, segments: DataFrame, specs: list[Feature]) -> DataFrame:
    """Wide feature table: files joined with their segments; an unknown prompt or another set of features is an error."""
    ids = sorted(f.id for f in specs)
    j = files.join(segments, "prompt_id", "left")
    wrong = F.when(F.col("segment_id").isNull(), F.concat(F.lit("unknown prompt "), F.col("prompt_id").cast("string"))).when(F.array_sort(F.map_keys("features")) != F.array(*map(F.lit, ids)), F.concat(F.lit("other features in "), "path"))
    return j.select("prompt_id", "segment_id", "book_id", "segment_index", *(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("features")[f.id]).alias(f.id) for f in specs))


# -- axes --------------------------------------------------------------------
def axis(v: Column, spec: Feature, mark: str | None = None) -> Column:
    """0 to 100 of a value on a narrative axis: place of an ordinal, position in the range of a scale, 100 for ``mark`` and 0 for other values; null where it is no valid value."""
    raw = F.trim(v)
    known = F.array(*map(F.lit, spec.values))
    if mark is not None:
        return F.when(F.array_contains(known, raw), F.when(raw == mark, 100.0).otherwise(0.0))
    if spec.type == "ordinal":
        return F.when(~is_missing(v) & F.array_contains(known, raw), 100.0 * (F.array_position(known, raw) - 1) / (len(spec.values) - 1))
    numbers = [float(re.match(r"\d+(?:\.\d+)?", x)[0]) for x in spec.values]
    lo, hi = min(numbers), max(numbers)
    x = F.when(raw.rlike(r"^\d+(?:\.\d+)?$"), raw).when(F.array_contains(known, raw), F.regexp_extract(raw, r"^\d+(?:\.\d+)?", 0)).try_cast("double")
    return F.when(x.isin(numbers) & F.lit(hi > lo), 100.0 * (x - lo) / ((hi - lo) or 1.0))


def axis_profiles(df: DataFrame, group: str, axes: dict[str, Column]) -> DataFrame:
    """group, axis, mean, q25, q75, n, total: valid values only."""
    long = df.select(group, F.inline(F.array(*(F.struct(F.lit(k).alias("axis"), c.alias("x")) for k, c in axes.items()))))
    return long.groupBy(group, "axis").agg(F.round(F.avg("x"), 2).alias("mean"), F.round(F.percentile("x", F.lit(0.25)), 2).alias("q25"), F.round(F.percentile("x", F.lit(0.75)), 2).alias("q75"), F.count("x").alias("n"), F.count("*").alias("total"))


# -- segments ----------------------------------------------------------------
def segment_spans(full: DataFrame, segments: DataFrame) -> DataFrame:
    """book_id, segment_index, start, end in the full text of a book, by counting import words; the spans laid end to end are the text.

    full: book_id, text; segments: book_id, segment_index, word_count.
    """
    order = Window.partitionBy("book_id").orderBy("segment_index")
    s = segments.select("book_id", "segment_index", F.sum("word_count").over(order).alias("upto"), (F.row_number().over(order) == 1).alias("first"))
    mark = "\u0003"
    parts = F.split(F.regexp_replace("text", f"({T.IMPORT_WORD})", f"{mark}$1{mark}"), mark)
    p = full.select("book_id", F.length("text").alias("size"), F.posexplode(parts).alias("i", "part"))
    before = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy("book_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = p.withColumn("at", before).where("i % 2 = 1").select("book_id", ((F.col("i") - 1) / 2).cast("long").alias("upto"), "at")
    ends = s.join(words, ["book_id", "upto"], "left").join(full.select("book_id", F.length("text").alias("size")), "book_id")
    end = F.coalesce("at", "size").cast("int")
    return ends.select("book_id", "segment_index", F.coalesce(F.lag(end).over(order), F.lit(0)).alias("start"), end.alias("end"))


def pilot(segments: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` segments: of each book the first, middle, last, shortest and longest in that order, then the others."""
    b = Window.partitionBy("book_id")
    n = F.count("*").over(b)
    place = F.row_number().over(b.orderBy("segment_index")) - 1
    short = F.row_number().over(b.orderBy("word_count", "segment_index")) == 1
    long = F.row_number().over(b.orderBy(F.desc("word_count"), "segment_index")) == 1
    s = segments.withColumn("place", place).withColumn("n", n).withColumn("short", short).withColumn("long", long)
    rank = F.when(F.col("place") == 0, 0).when(F.col("place") == F.floor(F.col("n") / 2), 1).when(F.col("place") == F.col("n") - 1, 2).when(F.col("short"), 3).when(F.col("long"), 4)
    s = s.withColumn("rank", rank)
    first = s.orderBy(F.col("rank").isNull(), F.when(F.col("rank").isNotNull(), F.col("book_id")), "rank", "book_id", "segment_index").limit(limit)
    return first.select("book_id", "segment_index", "word_count")


def progression(values: DataFrame, order: str = "segment_index") -> DataFrame:
    """Metric of each segment in reading order with its change from the one before (unit: book_id, metric)."""
    w = Window.partitionBy("book_id", "metric").orderBy(order)
    return values.withColumn("change", F.bround(F.col("value") - F.lag("value").over(w), 4))


def source_counts(df: DataFrame, column: str, k: int = 25) -> DataFrame:
    """The most frequent values and their number, ties in order of the value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


# -- baselines ---------------------------------------------------------------
# What must be equal for a distance to a baseline, in the order it is asked.
BLOCKS = ("feature_set", "model", "effort", "language", "taxonomy")


def blocked(a: str = "t", b: str = "b") -> Column:
    """Why a text has no distance to a baseline, the first reason in order: no features, the baseline's own text, other settings."""
    same = (F.col(f"{a}.document_id") == F.col(f"{b}.document_id")) | (F.col(f"{a}.text_sha256") == F.col(f"{b}.text_sha256"))
    reason = F.when(F.coalesce(F.col(f"{a}.segments"), F.lit(0)) == 0, "no features").when(same, "own text")
    for k in BLOCKS:
        reason = reason.when(~F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), f"other {k}")
    return reason


def baseline_distance(targets: DataFrame, baseline: DataFrame, k: int = 25) -> DataFrame:
    """doc, distance: mean over a text's segments of the mean distance to the k nearest baseline segments, scaled on the baseline only.

    targets: doc, id, v; baseline: id, v.
    """
    fit = V.scale_fit(baseline)
    near = V.knn(V.scale(targets.select("id", "v"), fit), V.scale(baseline.select("id", "v"), fit), min(k, max(1, baseline.count())), exclude_self=False)
    return V.rarity(near).join(targets.select("doc", F.col("id").alias("query_id")), "query_id").groupBy("doc").agg(F.avg("raw").alias("distance"))


def chapter_distances(vectors: DataFrame, cover: DataFrame) -> DataFrame:
    """group_a, group_b, distance between the centroids of chapters whose segments lie wholly inside.

    vectors: chapter_index, v of one book; cover: chapter_index, all_inside.
    """
    inside = cover.where("all_inside").select("chapter_index")
    return V.centroid_distances(vectors.join(inside, "chapter_index", "left_semi"), "chapter_index")


# Published orientation of mean percentiles, and how far from it a result may lie.
HUMAN, MACHINE, TOLERANCE, DIMENSIONS = 0.71, 0.49, 0.10, 958


def quality_gate(scores: DataFrame, dimensions: int, missing_rows: int) -> DataFrame:
    """human_mean, machine_mean, within_tolerance, status of scored rows (source, percentile)."""
    human = F.avg(F.when(F.col("source") == "human", F.col("percentile")))
    machine = F.avg(F.when(F.col("source") != "human", F.col("percentile")))
    g = scores.agg(human.alias("human_mean"), machine.alias("machine_mean"))
    within = F.coalesce((F.abs(F.col("human_mean") - HUMAN) <= TOLERANCE) & (F.abs(F.col("machine_mean") - MACHINE) <= TOLERANCE), F.lit(False))
    exact = within & F.lit(dimensions == DIMENSIONS and missing_rows == 0)
    return g.withColumn("within_tolerance", within).withColumn("status", F.when(exact, "exact").otherwise("reconstruction"))


def dimension(spark: SparkSession) -> DataFrame:
    """The catalogue as a table: metric, group, languages, min_words."""
    return spark.createDataFrame([(m.id, m.group, list(m.languages), m.min_words) for m in METRICS], "metric string, group string, languages array<string>, min_words int")


def preview(segments: DataFrame, k: int = 10) -> str:
    """Markdown overview of the books and their first segments."""
    books = segments.groupBy("book_id").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"), F.min("word_count").alias("low"), F.max("word_count").alias("high")).orderBy("book_id")
    lines = ["| book | segments | words | shortest | longest |", "|---|---|---|---|---|"]
    lines += [f"| {r.book_id} | {r.n} | {r.words} | {r.low} | {r.high} |" for r in books.toLocalIterator()]
    lines += ["", "| segment | words |", "|---|---|"]
    lines += [f"| {r.book_id} {r.segment_index} | {r.word_count} |" for r in segments.orderBy("book_id", "segment_index").limit(k).collect()]
    return "\n".join(lines) + "\n"
