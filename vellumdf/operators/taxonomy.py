"""Closed-vocabulary features: taxonomy, canonical values, validation, encoding.

A taxonomy is one row a feature (feature_id, type, allowed values in order).  The
wide feature table is unpivoted, its distinct values are matched once each and
joined back; encoding is a generated list of expressions.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Markers of a missing value.
MISSING = ("", "n/a", "na", "__na__")
ONE_HOT, NUMERIC = ("categorical", "binary"), ("ordinal", "scale")


class Feature(NamedTuple):
    id: str
    type: str
    values: tuple[str, ...]


def flatten(df: DataFrame) -> DataFrame:
    """feature_id, type, values, dimension of a nested taxonomy: dimensions of aspects of features."""
    d = df.select(F.explode("dimensions").alias("d")).select(F.col("d.name").alias("dimension"), F.explode("d.aspects").alias("a"))
    return d.select("dimension", F.explode("a.features").alias("f")).select(F.col("f.id").alias("feature_id"), F.col("f.type").alias("type"), F.col("f.values").alias("values"), "dimension")


def features(rows: DataFrame) -> list[Feature]:
    """The taxonomy on the driver, in order of id; a feature named twice is an error."""
    got = [Feature(r.feature_id, r.type, tuple(r["values"])) for r in rows.orderBy("feature_id").collect()]
    if len({f.id for f in got}) < len(got):
        raise ValueError("a feature is named twice")
    return got


def is_missing(v: Column) -> Column:
    """Null, a marker of MISSING[1:], or what Spark prints for a number that is none (NaN)."""
    t = F.trim(v.cast("string"))
    return v.isNull() | F.lower(t).isin(*MISSING[1:]) | (t == "NaN")


def scale_text(v: Column) -> Column:
    """A number as text, without decimals where it is whole; null where it is no number (true and false are none)."""
    x = F.trim(v.cast("string")).try_cast("double")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def match_key(v: Column) -> Column:
    """Small letters without what stands in parentheses, other characters as _."""
    k = F.regexp_replace(F.lower(F.trim(v)), r"\s*\([^)]*\)", "")
    return F.regexp_replace(F.regexp_replace(k, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_multi(v: Column) -> Column:
    """Items of a JSON array or of a text joined by |; missing is no item."""
    listed = F.from_json(v, "array<string>")
    parted = F.filter(F.transform(F.split(v, r"\|"), F.trim), lambda x: F.length(x) > 0)
    return F.when(is_missing(v), F.array().cast("array<string>")).when(F.trim(v).startswith("[") & listed.isNotNull(), F.transform(listed, F.trim)).otherwise(parted)


def best_match(raw: DataFrame, allowed: DataFrame) -> DataFrame:
    """feature_id, raw, canonical, method.

    raw: feature_id, raw; allowed: feature_id, value, place.  The first way that
    fits decides: equal keys, equal leading number, one key the start of the
    other, half of the words in common; otherwise the value stays, unmatched.
    """
    r = raw.select("feature_id", "raw").distinct().withColumn("rk", match_key(F.col("raw")))
    a = allowed.withColumn("ak", match_key(F.col("value")))
    number = lambda c: F.regexp_extract(c, r"^(\d+)", 1)
    j = r.join(a, "feature_id", "left")
    rk, ak = F.col("rk"), F.col("ak")
    ta, tb = F.array_distinct(F.split(rk, "_")), F.array_distinct(F.split(ak, "_"))
    overlap = F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(ta), F.size(tb))
    step = F.when(rk == ak, 1).when((number(rk) != "") & (number(rk) == number(ak)), 2).when(rk.startswith(ak) | ak.startswith(rk), 3).when(overlap >= 0.5, 4)
    order = Window.partitionBy("feature_id", "raw").orderBy(F.col("step").asc_nulls_last(), F.when(F.col("step") == 4, -F.col("overlap")), "place")
    best = j.withColumn("step", step).withColumn("overlap", overlap).withColumn("n", F.row_number().over(order)).where("n = 1")
    s = F.col("step")
    method = F.when(s == 1, "normalized_exact").when(s == 2, "numeric_prefix").when(s == 3, "prefix").when(s == 4, "token_overlap")
    return best.select("feature_id", "raw", F.when(F.col("step").isNull(), F.col("raw")).otherwise(F.col("value")).alias("canonical"), F.coalesce(method, F.lit("unmatched")).alias("method"))


def vocabulary(spark: SparkSession, specs: list[Feature]) -> DataFrame:
    rows = [(f.id, v, i) for f in specs for i, v in enumerate(f.values)]
    return spark.createDataFrame(rows, "feature_id string, value string, place int")


def long(df: DataFrame, key: str, specs: list[Feature]) -> DataFrame:
    """key, feature_id, raw (text) of the features the wide table has."""
    have = [f.id for f in specs if f.id in df.columns]
    if not have:
        return df.select(key, F.lit("").alias("feature_id"), F.lit(None).cast("string").alias("raw")).where(F.lit(False))
    return df.select(key, *(F.col(f"`{c}`").cast("string").alias(c) for c in have)).unpivot(key, have, "feature_id", "raw")


def canonical(df: DataFrame, key: str, specs: list[Feature]) -> DataFrame:
    """key, feature_id, raw, canonical, method of every cell: missing ones as n/a, numbers of a scale as text, others by ``best_match``, each item of a multi-select by itself."""
    kind = {t: [f.id for f in specs if f.type == t] for t in ("multi_select", "scale")}
    cells = long(df, key, specs).withColumn("raw", F.trim("raw"))
    of = lambda t: F.col("feature_id").isin(kind[t] or [""])
    miss = is_missing(F.col("raw"))
    words = vocabulary(df.sparkSession, specs)
    plain = cells.where(~miss & ~of("multi_select") & ~of("scale"))
    items = cells.where(~miss & of("multi_select")).select("feature_id", "raw").distinct().select("feature_id", "raw", F.posexplode(parse_multi(F.col("raw"))).alias("i", "item"))
    m = best_match(plain, words)
    one = best_match(items.select("feature_id", F.col("item").alias("raw")), words).withColumnRenamed("raw", "item")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "canonical"))), lambda x: x["canonical"])
    many = items.join(one, ["feature_id", "item"]).groupBy("feature_id", "raw").agg(F.array_join(F.array_distinct(listed), "|").alias("canonical"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("method"))
    j = cells.join(m.unionByName(many), ["feature_id", "raw"], "left")
    number = scale_text(F.col("raw"))
    value = F.when(miss, "n/a").when(of("scale"), F.coalesce(number, "raw")).when(of("multi_select"), F.coalesce("canonical", F.lit(""))).otherwise(F.col("canonical"))
    method = F.when(miss, "missing_marker").when(of("scale"), F.when(number.isNotNull(), "numeric_scale").otherwise("unmatched")).otherwise(F.coalesce("method", F.lit("")))
    return j.select(key, "feature_id", "raw", value.alias("canonical"), method.alias("method"))


def pivot_back(cells: DataFrame, key: str, specs: list[Feature]) -> DataFrame:
    """The wide table of the canonical values."""
    return cells.groupBy(key).pivot("feature_id", [f.id for f in specs]).agg(F.first("canonical"))


def changes(cells: DataFrame) -> DataFrame:
    """feature_id, raw, canonical, method, count of the cells that changed."""
    return cells.where(~F.col("raw").eqNullSafe(F.col("canonical"))).groupBy("feature_id", "raw", "canonical", "method").agg(F.count("*").alias("count"))


def invalid(df: DataFrame, key: str, specs: list[Feature]) -> DataFrame:
    """key, feature_id, value, error of cells outside the vocabulary; an item of a multi-select is a cell of its own, a feature without a column one row with a null key."""
    of = lambda *types: F.col("feature_id").isin([f.id for f in specs if f.type in types] or [""])
    cells = long(df, key, specs).where(~is_missing(F.col("raw")))
    number = scale_text(F.col("raw"))
    single = cells.where(~of("multi_select")).select(key, "feature_id", F.when(of("scale"), F.coalesce(number, F.trim("raw"))).otherwise(F.trim("raw")).alias("value"))
    items = single.unionByName(cells.where(of("multi_select")).select(key, "feature_id", F.explode(parse_multi(F.col("raw"))).alias("value")))
    words = vocabulary(df.sparkSession, specs).select("feature_id", F.when(of("scale"), F.coalesce(scale_text(F.regexp_extract("value", r"^\s*(-?\d+(?:\.\d+)?)", 1)), "value")).otherwise(F.col("value")).alias("value")).distinct()
    bad = items.join(words, ["feature_id", "value"], "left_anti").select(key, "feature_id", "value", F.lit("outside the vocabulary").alias("error"))
    absent = [f.id for f in specs if f.id not in df.columns]
    if not absent:
        return bad
    rows = df.sparkSession.createDataFrame([(f, None, "missing feature column") for f in absent], "feature_id string, value string, error string")
    return bad.unionByName(rows.select(F.lit(None).cast(dict(df.dtypes)[key]).alias(key), "feature_id", "value", "error"))


def validate(df: DataFrame, key: str, specs: list[Feature], most: int = 25) -> dict[str, int]:
    """Missing cells of each feature; an error that names at most ``most`` of the cells outside the vocabulary or columns that are missing."""
    bad = invalid(df, key, specs).orderBy("feature_id", key, "value").limit(most).collect()
    if bad:
        raise ValueError(f"{len(bad)} errors shown: " + "; ".join(f"{r.feature_id} {r.error}" + ("" if r.value is None else f" ({r[key]}: {r.value})") for r in bad))
    return {r.feature_id: r.n for r in missing_counts(df, key, specs).collect()}


def missing_counts(df: DataFrame, key: str, specs: list[Feature]) -> DataFrame:
    """feature_id, n: missing cells of each feature."""
    return long(df, key, specs).groupBy("feature_id").agg(F.count_if(is_missing(F.col("raw"))).alias("n"))


def columns(specs: list[Feature]) -> list[str]:
    out: list[str] = []
    for f in specs:
        out += [f.id] if f.type in NUMERIC else [*(f"{f.id}__{v}" for v in f.values), f"{f.id}____NA__"]
    return out


def encode(specs: list[Feature]) -> Column:
    """array<float>: one column a value and a missing flag, or one number (place of an ordinal, value of a scale, -1 where missing).  A value outside the vocabulary is an error."""
    out: list[Column] = []
    for f in specs:
        v = F.trim(F.col(f.id))
        miss = is_missing(F.col(f.id))
        known = F.array(*map(F.lit, f.values))
        unknown = F.raise_error(F.concat(F.lit(f"{f.id}: unknown value "), v)).cast("float")
        if f.type in ONE_HOT:
            out += [F.when(miss, 0.0).when(F.array_contains(known, v), (v == x).cast("float")).otherwise(unknown) for x in f.values] + [miss.cast("float")]
        elif f.type == "multi_select":
            items = parse_multi(F.col(f.id))
            bad = F.size(F.array_except(items, known)) > 0
            out += [F.when(bad, unknown).otherwise(F.array_contains(items, x).cast("float")) for x in f.values] + [miss.cast("float")]
        elif f.type == "ordinal":
            out.append(F.when(miss, -1.0).when(F.array_contains(known, v), (F.array_position(known, v) - 1).cast("float")).otherwise(unknown))
        else:
            out.append(F.when(miss, -1.0).otherwise(F.coalesce(v.try_cast("float"), unknown)))
    return F.transform(F.array(*out), lambda x: x.cast("float"))


def resolve_set(specs: DataFrame, exclude_dimensions: list[str], exclude_ids: list[str], expected: int | None = None, blocked: str | None = None) -> DataFrame:
    """The features of a set: all but the excluded dimensions and ids.  A blocked set, an excluded id that does not exist and another number than expected are errors."""
    if blocked is not None:
        raise ValueError(f"the feature set is blocked: {blocked}")
    known = {r.feature_id for r in specs.where(F.col("feature_id").isin(exclude_ids or [""])).select("feature_id").collect()}
    if unknown := sorted(set(exclude_ids) - known):
        raise ValueError(f"excluded ids do not exist: {', '.join(unknown)}")
    out = specs.where(~F.col("dimension").isin(exclude_dimensions or [""]) & ~F.col("feature_id").isin(exclude_ids or [""]))
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} features instead of {expected}")
    return out


def declared_count(rows: DataFrame, declared: int) -> DataFrame:
    """The flattened taxonomy, if it has as many features as it says."""
    if (n := rows.count()) != declared:
        raise ValueError(f"{n} features, {declared} declared")
    return rows


def encoder_manifest(specs: list[Feature]) -> dict:
    return {"version": 1, "columns": columns(specs), "features": [{"id": f.id, "type": f.type, "values": list(f.values)} for f in specs], "missing": {"flags": "a column of its own", "numbers": -1}}


def save_encoder(path: str, specs: list[Feature]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(encoder_manifest(specs), f, ensure_ascii=False, sort_keys=True)


def load_encoder(path: str, specs: list[Feature]) -> list[str]:
    """The columns of a stored encoder, if it was made with these features; otherwise an error."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    now = encoder_manifest(specs)
    for part in ("version", "features", "columns"):
        if stored.get(part) != now[part]:
            raise ValueError(f"the stored encoder has other {part}")
    return stored["columns"]
