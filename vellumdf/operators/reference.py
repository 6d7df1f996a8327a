"""Reference rows: splits, coverage, building a scaled matrix, scoring texts against it or among themselves."""

from __future__ import annotations

from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import taxonomy as X
from . import vectors as V

#: Rows of one text of which the full matrix of distances is given, texts and rows of one comparison.
MATRIX_ROWS, SHARED_DOCS, SHARED_ROWS = 3_000, 6, 3_000


# -- splits and coverage -----------------------------------------------------------
def split_ids(rows: DataFrame, split: str, key: str = "prompt_id") -> DataFrame:
    """The keys of rows that must all be of one split; null splits do not count.  Another split among them is an error."""
    other = [r.split for r in rows.where(F.col("split").isNotNull() & (F.col("split") != split)).select("split").distinct().limit(5).collect()]
    if other or rows.where(F.col("split") == split).isEmpty():
        raise ValueError(f"expected split {split} only, found {sorted(other)}")
    return rows.where(F.col(key).isNotNull()).select(key).distinct()


def impure(rows: DataFrame, key: str = "prompt_id") -> DataFrame:
    """key, splits: keys whose rows are of more than one split."""
    c = rows.where(F.col("split").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set("split")).alias("splits"))
    return c.where(F.size("splits") > 1)


def union_ids(*ids: DataFrame) -> DataFrame:
    """Keys of any of the frames, once each."""
    out = ids[0]
    for other in ids[1:]:
        out = out.unionByName(other)
    return out.distinct()


def select_rows(rows: DataFrame, ids: DataFrame, key: str = "prompt_id") -> DataFrame:
    """The rows of the keys; a key without a row is an error."""
    missing = ids.join(rows.select(key), key, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} keys have no row")
    return rows.join(ids, key, "left_semi")


def coverage(rows: DataFrame, ids: DataFrame, sources: list[str], key: str = "prompt_id") -> DataFrame:
    """One row: expected_rows, present_rows, missing_rows, incomplete, missing_ids, of the grid of keys and sources."""
    have = rows.where(F.col("source").isin(sources)).select(key, "source").distinct()
    per = ids.join(have.groupBy(key).agg(F.count("*").alias("k")), key, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    n = len(sources)
    return per.agg((F.count("*") * n).alias("expected_rows"), F.sum("k").alias("present_rows"), (F.count("*") * n - F.sum("k")).alias("missing_rows"), F.count_if(F.col("k") < n).alias("incomplete"), F.count_if(F.col("k") == 0).alias("missing_ids"))


def missing_sources(rows: DataFrame, ids: DataFrame, sources: list[str], key: str = "prompt_id") -> DataFrame:
    """key, missing: the sources a key lacks, of the keys that lack any."""
    have = rows.where(F.col("source").isin(sources)).groupBy(key).agg(F.collect_set("source").alias("have"))
    every = F.array(*map(F.lit, sources))
    lack = F.array_except(every, F.coalesce("have", F.array().cast("array<string>")))
    return ids.join(have, key, "left").select(key, F.sort_array(lack).alias("missing")).where(F.size("missing") > 0)


def source_counts(rows: DataFrame, group: str) -> DataFrame:
    """group, source, n of all sources."""
    return rows.groupBy(group, "source").agg(F.count("*").alias("n"))


# -- building and loading ----------------------------------------------------------
class Reference(NamedTuple):
    """rows: id, v (scaled), carried columns; fit: dim, mean, sd; columns: names of the dimensions; manifest: counts of the build."""

    rows: DataFrame
    fit: DataFrame
    columns: list[str]
    manifest: dict[str, Any]


def build(table: DataFrame, key: str, specs: list[X.Feature], *carry: str) -> Reference:
    """Canonical values, a stop at cells outside the vocabulary, encoding, scaling on exactly these rows."""
    cells = X.canonical(table, key, specs)
    changed = X.changes(cells)
    wide = X.pivot_back(cells, key, specs).join(table.select(key, *carry), key)
    bad = X.invalid(wide, key, specs)
    summary = bad.agg(F.count("*").alias("cells"), F.count_distinct(key).alias("rows"), F.count_distinct("feature_id").alias("features")).first()
    if summary.cells:
        top = [f"{r.feature_id}: {r['count']}" for r in bad.groupBy("feature_id").count().orderBy(F.desc("count"), "feature_id").limit(25).collect()]
        raise ValueError(f"{summary.cells} cells of {summary.rows} rows lie outside the vocabulary ({', '.join(top)})")
    encoded = wide.select(F.col(key).alias("id"), X.encode(specs).alias("v"), *carry)
    fit = V.scale_fit(encoded)
    rows = V.scale(encoded, fit)
    names = X.columns(specs)
    constant = [names[r.dim] for r in fit.where("constant").orderBy("dim").collect()]  # one row a dimension at most
    changes = changed.agg(F.count("*").alias("d"), F.coalesce(F.sum("count"), F.lit(0)).alias("c")).first()
    manifest = {"rows": rows.count(), "features": len(specs), "dimensions": len(names), "constant_columns": constant, "changed_cells": int(changes.c), "change_decisions": int(changes.d)}
    return Reference(rows, fit, names, manifest)


def check_matrix(matrix: DataFrame, metadata: DataFrame, dimensions: int, key: str = "reference_index", vector: str = "matrix") -> None:
    """A stored matrix fits its metadata: as many rows, the same keys, vectors of the encoder's length; otherwise an error."""
    n, wrong = matrix.agg(F.count("*"), F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != dimensions)).first()
    m = metadata.count()
    lost = metadata.select(key).join(matrix.select(key), key, "left_anti").count()
    if n != m or wrong or lost:
        raise ValueError(f"{n} vectors for {m} rows, {wrong} of another length than {dimensions}, {lost} rows without a vector")


def load_npy(spark: Any, path: str, metadata: DataFrame, dimensions: int, key: str = "reference_index") -> DataFrame:
    """key, v of a stored .npy matrix, read as a memory map in slices; its shape must be that of the metadata and the encoder."""
    m = np.load(path, mmap_mode="r", allow_pickle=False)
    ids = [r[0] for r in metadata.select(key).orderBy(key).collect()]
    if m.shape != (len(ids), dimensions):
        raise ValueError(f"shape {m.shape} instead of {(len(ids), dimensions)}")
    step = max(1, (64 << 20) // (8 * dimensions))
    parts = [spark.createDataFrame(pd.DataFrame({key: ids[a : a + step], "v": [x.tolist() for x in np.asarray(m[a : a + step], np.float64)]})) for a in range(0, len(ids), step)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- scores -------------------------------------------------------------------------
def score(queries: DataFrame, reference: DataFrame, rarity: DataFrame, k: int = 25, carry: str = "source") -> DataFrame:
    """id, raw, percentile, counts: mean distance to the k nearest reference rows, its right-continuous place among the reference's own rarities, and the sources of the neighbours as JSON.

    queries: id, v; reference: id, v, carry; rarity: value.
    """
    near = V.knn(queries, reference, k, carry, exclude_self=False)
    raw = V.rarity(near).withColumnRenamed("raw", "value")
    placed = V.percentiles(raw, rarity)
    return placed.join(V.source_counts(near, carry), "query_id").select(F.col("query_id").alias("id"), F.col("value").alias("raw"), F.col("right").alias("percentile"), "counts")


def leave_one_out(rows: DataFrame, group: str, k: int = 25) -> DataFrame:
    """id, group, k, raw, percentile, counts of every row among the others: k is at most their number, the percentile that among all raw values, counts the groups of the neighbours."""
    n = rows.count()
    if n < 2:
        raise ValueError("at least two rows are needed")
    k = min(k, n - 1)
    near = V.knn(rows.select("id", "v"), rows.select("id", "v", F.col(group).cast("string").alias(group)), k, group)
    raw = V.rarity(near)
    placed = V.percentiles(raw.withColumnRenamed("raw", "value"), raw.select(F.col("raw").alias("value")))
    j = placed.join(V.source_counts(near, group), "query_id").select(F.col("query_id").alias("id"), F.col("value").alias("raw"), F.col("right").alias("percentile"), "counts")
    return rows.select("id", group).join(j, "id").withColumn("k", F.lit(k))


def shared_space(rows: DataFrame, doc: str, k: int = 25) -> tuple[DataFrame, DataFrame]:
    """(doc, segments, mean, median of the raw values; doc_a, doc_b, distance of the centroids) of up to SHARED_DOCS texts scaled together.

    rows: doc, id, v.  More texts or rows are an error.
    """
    docs, n = rows.agg(F.count_distinct(doc), F.count("*")).first()
    if docs > SHARED_DOCS or not 2 <= n <= SHARED_ROWS:
        raise ValueError(f"{docs} texts with {n} segments: at most {SHARED_DOCS} with 2 to {SHARED_ROWS}")
    scaled = V.scale(rows, V.scale_fit(rows))
    loo = leave_one_out(scaled, doc, k)
    series = loo.groupBy(doc).agg(F.count("*").alias("segments"), F.avg("raw").alias("mean"), F.median("raw").alias("median"))
    return series, V.centroid_distances(scaled.select(doc, "v"), doc)


def pairwise(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, order, distances: of every row to all rows of its group in their order, zero to itself.

    rows: group, order, v.  A group of more than MATRIX_ROWS rows is an error: the matrix is for one book.
    """
    largest = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest > MATRIX_ROWS:
        raise ValueError(f"a group of {largest} rows: a matrix has at most {MATRIX_ROWS}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        m = np.array(pdf["v"].tolist(), np.float64)
        d = np.sqrt(np.maximum(((m[:, None, :] - m[None]) ** 2).sum(2) if len(m) <= 256 else (m * m).sum(1)[:, None] + (m * m).sum(1)[None] - 2 * m @ m.T, 0))
        np.fill_diagonal(d, 0.0)
        return pd.DataFrame({"grp": pdf["grp"], "place": pdf["place"], "distances": d.tolist()})

    kinds = dict(rows.dtypes)
    named = rows.select(F.col(group).alias("grp"), F.col(order).alias("place"), "v")
    out = named.groupBy("grp").applyInPandas(one, f"grp {kinds[group]}, place {kinds[order]}, distances array<double>")
    return out.select(F.col("grp").alias(group), F.col("place").alias(order), "distances")


# -- joins with a guard ----------------------------------------------------------------
def complete_groups(features: DataFrame, segments: DataFrame, group: str, key: str) -> DataFrame:
    """The feature rows of the groups of which every segment has one; those of other groups are left out.  segments: group, key."""
    per = segments.select(group, key).distinct().join(features.select(key).distinct().withColumn("has", F.lit(1)), key, "left").groupBy(group).agg(F.count("*").alias("n"), F.count("has").alias("k"))
    whole = segments.join(per.where("n = k").select(group), group, "left_semi").select(key)
    return features.join(whole, key, "left_semi")


def aligned(results: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Results joined with their features one to one; a key on one side only, or twice on a side, is an error."""
    r, f = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((results, "a"), (features, "b")))
    bad = r.join(f, key, "full").where("coalesce(a, 0) <> 1 or coalesce(b, 0) <> 1").count()
    if bad:
        raise ValueError(f"{bad} keys do not stand once on both sides")
    return results.join(features, key)


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows in which one of the columns holds the text, whatever the case; an empty text finds all."""
    hit: Column = F.lit(text == "")
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(text))), F.lit(False))
    return df.where(hit)
