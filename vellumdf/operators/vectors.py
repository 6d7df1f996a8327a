"""Vectors: scaling, exact neighbours of a query set, empirical percentiles, centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of query vectors that may go to every executor at once; more are searched block by block.
MAX_QUERY_BYTES = 128 << 20
#: Rows of a value range of ``percentiles``, and most ranges.
BAND_ROWS, MAX_BANDS = 100_000, 4_000


def vectors(df: DataFrame, key: str, vector: str, *carry: str) -> DataFrame:
    """id, v and carried columns of the rows with a vector free of null and NaN."""
    v = F.col(vector)
    return df.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))).select(F.col(key).alias("id"), v.alias("v"), *carry)


def scale_fit(df: DataFrame) -> DataFrame:
    """dim, mean, sd (population; 1 where the column is constant), constant of the reference rows."""
    x = df.select(F.posexplode("v").alias("dim", "x"))
    sd = F.stddev_pop(F.col("x").cast("double"))
    return x.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd"), (sd == 0).alias("constant"))


def scale(df: DataFrame, fit: DataFrame) -> DataFrame:
    """z-scores against a fit.  The fit is one row a dimension and becomes two array literals."""
    rows = fit.orderBy("dim").collect()
    mean, sd = (F.array(*(F.lit(float(r[k])) for r in rows)) for k in ("mean", "sd"))
    z = F.zip_with(F.zip_with("v", mean, lambda a, b: a.cast("double") - b), sd, lambda a, b: a / b)
    return df.withColumn("v", z)


def knn(queries: DataFrame, reference: DataFrame, k: int, carry: str | None = None, exclude_self: bool = True) -> DataFrame:
    """query_id, neighbor_id, distance, rank (and the neighbour's ``carry``): exact Euclidean neighbours.

    The reference is scanned once a block of queries; a task keeps the k best of
    each query only, and the per-task bests are ranked.  Ties go to the smaller id.
    """
    cols = ["id", "v", *([carry] if carry else [])]
    dim = queries.select(F.max(F.size("v"))).first()[0] or 1
    n = queries.count()
    blocks = max(1, -(-n * dim * 8 // MAX_QUERY_BYTES))
    out: DataFrame | None = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").toArrow()
        part = _scan(reference.select(*cols), block, k, carry, exclude_self)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(reference: DataFrame, block: pa.Table, k: int, carry: str | None, exclude_self: bool) -> DataFrame:
    ids = block.column("id").to_numpy()
    q = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    shared = reference.sparkSession.sparkContext.broadcast((ids, q))
    schema = f"query_id long, neighbor_id long, distance double{f', {carry} string' if carry else ''}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = [np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), object)]
        for b in batches:
            mid = b.column("id").to_numpy().astype(np.int64)
            if not len(mid):
                continue
            m = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(mid), -1)
            tag = np.array(b.column(carry).to_pylist(), object) if carry else np.zeros(len(mid), object)
            for at in range(0, len(ids), 256):
                part = slice(at, at + 256)
                d = (q[part] ** 2).sum(1)[:, None] + (m**2).sum(1)[None] - 2 * q[part] @ m.T
                if exclude_self:
                    d[ids[part][:, None] == mid[None]] = np.inf
                near = np.argpartition(d, k + 3, 1)[:, : k + 4] if len(mid) > k + 4 else np.tile(np.arange(len(mid)), (len(d), 1))
                exact = np.sqrt(((q[part][:, None] - m[near]) ** 2).sum(2))
                exact[~np.isfinite(np.take_along_axis(d, near, 1))] = np.inf
                if at == 0:
                    fresh = [np.zeros((0, exact.shape[1]))] * 3
                fresh = [np.vstack((f, x)) for f, x in zip(fresh, (exact, mid[near], tag[near]), strict=True)]
            best = [np.hstack((x, y)) for x, y in zip(best, fresh, strict=True)]
            o = np.lexsort((best[1], best[0]), axis=1)[:, :k]
            best = [np.take_along_axis(x, o, 1) for x in best]
        ok = np.isfinite(best[0].astype(float))
        row, _ = np.nonzero(ok)
        arrays = [pa.array(ids[row].astype(np.int64)), pa.array(best[1][ok].astype(np.int64)), pa.array(best[0][ok].astype(np.float64))]
        yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(best[2][ok].tolist(), pa.string())] if carry else [])], names=["query_id", "neighbor_id", "distance", *([carry] if carry else [])])

    return reference.mapInArrow(run, schema)


def rarity(neighbors: DataFrame) -> DataFrame:
    """query_id, raw: mean distance of the neighbours found."""
    return neighbors.groupBy("query_id").agg(F.avg("distance").alias("raw"))


def source_counts(neighbors: DataFrame, carry: str) -> DataFrame:
    """query_id, counts: JSON object of neighbour sources and their number, keys in order."""
    c = neighbors.groupBy("query_id", carry).agg(F.count("*").alias("n"))
    return c.groupBy("query_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(carry, "n"))))).alias("counts"))


def percentiles(values: DataFrame, reference: DataFrame, value: str = "value") -> DataFrame:
    """``values`` with right, left and mid: shares of the reference at most, below, and half-way.

    Rows are put into value ranges by approximate quantiles; counts run within a
    range of about BAND_ROWS rows and start from the totals of the ranges below, so
    no task sorts all rows.
    """
    ranges = max(2, min(MAX_BANDS, -(-(reference.count() + values.count()) // BAND_ROWS)))
    cuts = reference.select(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    edges = F.array(*(F.lit(float(e)) for e in sorted(set(cuts))))
    # number of edges below the value
    band = F.size(F.filter(edges, lambda e: e < F.col(value))) if cuts else F.lit(0)
    names = values.columns
    rows = values.withColumn("is_ref", F.lit(0)).unionByName(reference.select(value).withColumn("is_ref", F.lit(1)), allowMissingColumns=True).withColumn("band", band)
    totals = rows.groupBy("band").agg(F.sum("is_ref").alias("own"))  # at most MAX_BANDS rows
    below = F.coalesce(F.sum("own").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("band", below.alias("below"), F.sum("own").over(Window.partitionBy()).alias("n"))
    upto = F.sum("is_ref").over(Window.partitionBy("band").orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum("is_ref").over(Window.partitionBy("band", value))
    r = rows.withColumn("upto", upto).withColumn("same", same).where("is_ref = 0").join(F.broadcast(totals), "band")
    right, left = (F.col("below") + F.col("upto")) / F.col("n"), (F.col("below") + F.col("upto") - F.col("same")) / F.col("n")
    return r.select(*names, right.alias("right"), left.alias("left"), ((right + left) / 2).alias("mid"))


def centroids(df: DataFrame, group: str) -> DataFrame:
    """group, dim, c: mean of every position."""
    return df.select(group, F.posexplode("v").alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("c"))


def centroid_distances(df: DataFrame, group: str) -> DataFrame:
    """group_a, group_b, distance of every pair of groups, smaller first; groups are few, rows are not paired."""
    c = centroids(df, group)
    a, b = c.withColumnsRenamed({group: "group_a", "c": "ca"}), c.withColumnsRenamed({group: "group_b", "c": "cb"})
    return a.join(b, "dim").where("group_a < group_b").groupBy("group_a", "group_b").agg(F.sqrt(F.sum((F.col("ca") - F.col("cb")) ** 2)).alias("distance"))


def density(values: DataFrame, value: str, points: int = 65) -> DataFrame:
    """x, density: Gaussian kernel estimate at evenly spaced points, bandwidth max(range / 30, 1.06 sd n^-0.2)."""
    v = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    s = v.agg(F.min("v"), F.max("v"), F.stddev_pop("v"), F.count("*")).first()
    lo, hi, sd, n = s
    if not n:
        return values.sparkSession.createDataFrame([], "point int, x double, density double")
    h = max((hi - lo) / 30, 1.06 * sd * n**-0.2) or 1.0
    at = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    # one pass: a sum a point, pre-aggregated by value
    counts = v.groupBy("v").agg(F.count("*").alias("c"))
    sums = counts.agg(*(F.sum(F.col("c") * F.exp(-0.5 * ((F.lit(x) - F.col("v")) / h) ** 2)).alias(f"s{i}") for i, x in enumerate(at)))
    norm = n * h * (2 * np.pi) ** 0.5
    return sums.select(F.inline(F.array(*(F.struct(F.lit(i).alias("point"), F.lit(x).alias("x"), (F.col(f"s{i}") / norm).alias("density")) for i, x in enumerate(at)))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))
