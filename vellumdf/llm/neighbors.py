"""Problem 4: the most similar vectors for every vector.

A hierarchical k-means tree is fitted on a sample of bounded size, chosen by a
hash of the row number; every vector is put into the leaf with the nearest
centroid of all, so that the plane half way to another centroid is a true bound.
Neighbouring leaves form parts of bounded size.  Each part is searched for its own
vectors first, which gives every query the distance its k-th neighbour must beat.
The query then visits further leaves in the order of a priority queue over
centroid distances, leaving out those that a bound rules out, up to the number of
visits at which a calibration sample - rows the tree was not fitted on, compared
with all vectors by brute force - reaches the wanted recall: all leaves if it takes
them.  A query is sent once to each part it visits, whatever the number of leaves.

Equal vectors are one vector of the index with its smallest row numbers, combined
before and after the shuffle.  A leaf of more than SHARD vectors is searched in
shards, a part that more than HOT queries visit in copies.  Rows whose vector is
null, holds null or NaN or has another length, and rows without a number, take no
part; a row that is repeated counts once.  Ties go to the smaller row number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import cut

K, DIM = 5, 64
#: Vectors a leaf should hold, most leaves (also the bound of what is broadcast: 8 bytes x DIM each), sample vectors a leaf, children of a node.
LEAF, MAX_LEAVES, PER_LEAF, BRANCH = 256, 32_768, 16, 32
#: Vectors of a part, of a shard, queries of the calibration, wanted recall, fewest leaf visits, visits the calibration begins with.
PART, SHARD, CALIBRATION, RECALL, MIN_VISITS, FIRST_VISITS = 1024, 4096, 256, 0.99, 4, 64
#: Up to here all rows are the sample and all leaves are visited; queries of one part that one task should answer.
SMALL, HOT = 1024, 200_000


class Tree:
    """Centroids of all nodes; node 0 is the root, the children of a node lie together, and so do the leaves below it."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        centre: list[np.ndarray] = [sample.mean(0)]
        child: list[tuple[int, int]] = [(0, 0)]
        leaf_of: list[int] = [-1]
        below = [(0, np.arange(len(sample)), leaves)]
        found = 0
        while below:
            node, rows, want = below.pop()
            if want < 2 or len(rows) < 2:
                leaf_of[node] = found
                found += 1
                continue
            c, member = kmeans(sample[rows], min(BRANCH, want), rng)
            full = np.unique(member)
            if len(full) < 2:  # copies of one vector
                leaf_of[node] = found
                found += 1
                continue
            child[node] = (len(centre), len(centre) + len(full))
            for t in full:
                own = rows[member == t]
                below.append((len(centre), own, round(want * len(own) / len(rows))))
                centre.append(c[t])
                child.append((0, 0))
                leaf_of.append(-1)
        self.centre = np.vstack(centre)
        self.begin, self.end = np.array(child, np.int64).T
        self.leaf_of = np.array(leaf_of, np.int64)
        self.leaf = np.zeros((found, sample.shape[1]))
        at = np.flatnonzero(self.leaf_of >= 0)
        self.leaf[self.leaf_of[at]] = self.centre[at]
        self.reach = np.full(found, np.inf)

    def nearest_leaf(self, q: np.ndarray) -> np.ndarray:
        """The leaf with the nearest centroid of all."""
        step = max(1, (1 << 22) // len(self.leaf))
        return np.concatenate([distances(q[i : i + step], self.leaf).argmin(1) for i in range(0, len(q), step)])

    def order(self, q: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """([queries, visits] leaves in best-bin-first order, their centroid distances); -1 where the tree has fewer leaves.

        One priority queue a query, all queries side by side: the nearest node is
        taken off; an inner node puts its children into the queue, a leaf is a visit.
        The order does not depend on ``visits``.
        """
        n = len(q)
        wide = int((self.end - self.begin).max()) or 1
        dist, node = np.full((n, 1 + 8 * wide), np.inf), np.full((n, 1 + 8 * wide), -1, np.int64)
        dist[:, 0] = 0.0
        node[:, 0] = 0
        opened = np.zeros(n, np.int64)
        out = np.full((n, visits), -1, np.int64)
        how_far = np.full((n, visits), np.inf)
        got = np.zeros(n, np.int64)
        rows = np.arange(n)
        while True:
            best = dist[rows].argmin(1)
            d, v = dist[rows, best], node[rows, best]
            live = np.isfinite(d) & (got[rows] < visits)
            rows, best, d, v = rows[live], best[live], d[live], v[live]
            if not len(rows):
                return out, how_far
            dist[rows, best] = np.inf
            is_leaf = self.leaf_of[v] >= 0
            r = rows[is_leaf]
            out[r, got[r]] = self.leaf_of[v[is_leaf]]
            how_far[r, got[r]] = d[is_leaf]
            got[r] += 1
            r, v = rows[~is_leaf], v[~is_leaf]
            if not len(r):
                continue
            while 1 + (opened[r].max() + 1) * wide > dist.shape[1]:
                dist = np.hstack((dist, np.full((n, 8 * wide), np.inf)))
                node = np.hstack((node, np.full((n, 8 * wide), -1, np.int64)))
            kids = self.begin[v][:, None] + np.arange(wide)
            real = kids < self.end[v][:, None]
            kids = np.where(real, kids, 0)
            far = np.sqrt(((q[r][:, None, :] - self.centre[kids]) ** 2).sum(2))
            at = 1 + opened[r, None] * wide + np.arange(wide)
            dist[r[:, None], at] = np.where(real, far, np.inf)
            node[r[:, None], at] = kids
            opened[r] += 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = np.concatenate([distances(x[i : i + 8192], c).argmin(1) for i in range(0, len(x), 8192)])
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = count > 0
        c[full] = total[full] / count[full, None]
    return c, near


def usable(df: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """id, v of the rows that take part."""
    v = F.col(vector)
    ok = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return df.where(v.isNotNull() & ok & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _top(q: np.ndarray, qid: np.ndarray, m: np.ndarray, mid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """([queries, k] distances, ids) of the nearest members that are not the query itself."""
    d = distances(q, m)
    d[qid[:, None] == mid[None]] = np.inf
    n = min(len(mid), k + 3)
    near = np.argpartition(d, n - 1, 1)[:, :n] if n < len(mid) else np.tile(np.arange(n), (len(q), 1))
    # exact distances of the nearest few, so that rounding does not order neighbours that are very close
    exact = np.sqrt(((q[:, None, :] - m[near]) ** 2).sum(2))
    exact[~np.isfinite(np.take_along_axis(d, near, 1))] = np.inf
    ids = mid[near]
    order = np.lexsort((ids, exact), axis=1)[:, :k]
    return np.take_along_axis(exact, order, 1), np.take_along_axis(ids, order, 1)


NEAR = "near array<struct<d: double, n: long>>"
PAIRS = f"id long, {NEAR}"
PLACED = "id long, v array<float>, ids array<long>, a long, b long, leaf long, far double"
HOME = f"id long, v array<float>, ids array<long>, a long, b long, leaf long, part long, {NEAR}"
VISITS = "id long, v array<float>, bound double, part long, leaves array<long>"


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _near(d: np.ndarray, ids: np.ndarray, bound: np.ndarray | None = None) -> pa.ListArray:
    ok = np.isfinite(d) if bound is None else np.isfinite(d) & (d <= bound[:, None])
    flat = pa.StructArray.from_arrays([pa.array(d[ok]), pa.array(ids[ok])], names=["d", "n"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ok.sum(1)))).astype(np.int32)), flat)


def _sampled(rows: DataFrame, low: float, high: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows whose hash lies in a share of all hashes: no order, no single task."""
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30))
    got = rows.where((place >= int(low * (1 << 30))) & (place < int(high * (1 << 30)))).select("id", "v").toArrow()
    return got.column("id").to_numpy(), _matrix(got.column("v").combine_chunks(), dim) if got.num_rows else np.zeros((0, dim))


def nearest(df: DataFrame, key: str, vector: str, k: int = K, dim: int = DIM, recall: float = RECALL) -> DataFrame:
    """id, neighbor, distance, rank (1 to k) of every usable row, at the calibrated recall."""
    spark = df.sparkSession
    ctx = spark.sparkContext
    rows = usable(df, key, vector, dim).withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64("v", F.lit(1)))
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], "id long, neighbor long, distance double, rank int")
    leaves = int(min(MAX_LEAVES, max(1, n // LEAF)))
    small = n <= SMALL
    fit = 1.0 if small else min(0.5, max(CALIBRATION, PER_LEAF * leaves) / n)
    _, x = _sampled(rows, 0.0, fit, dim)
    tree = Tree(x if len(x) else np.zeros((1, dim)), leaves)
    shared = ctx.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct vectors of each batch with their k + 1 smallest row numbers, in their leaves: more of them can never be neighbours."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, a, b = (batch.column(c).to_numpy() for c in ("id", "a", "b"))
            o = np.lexsort((ids, b, a))
            other = np.concatenate(([True], (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])))
            o = o[other | np.concatenate(([True], ids[o][1:] != ids[o][:-1]))]
            other = np.concatenate(([True], (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])))
            first = np.flatnonzero(other)
            size = np.diff(np.concatenate((first, [len(o)])))
            keep = np.arange(len(o)) - np.repeat(first, size) <= k
            rep = o[first]
            v = batch.column("v").take(pa.array(rep))
            q = _matrix(v, dim)
            leaf = shared.value.nearest_leaf(q)
            far = np.sqrt(((q - shared.value.leaf[leaf]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rep]), v, _lists(ids[o][keep], np.minimum(size, k + 1)), pa.array(a[rep]), pa.array(b[rep]), pa.array(leaf), pa.array(far)], names=["id", "v", "ids", "a", "b", "leaf", "far"])

    placed = cut(rows.mapInArrow(assign, PLACED))
    # one row a leaf: at most MAX_LEAVES rows come to the driver
    shape = {r.leaf: (r.n, r.far) for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    tree.reach = np.array([shape.get(i, (0, -np.inf))[1] for i in range(len(tree.leaf))])
    part_of, shards = _parts([shape.get(i, (0, 0))[0] for i in range(len(tree.leaf))])
    visits = len(tree.leaf)
    if not small and visits > MIN_VISITS:
        qid, q = _sampled(rows, fit, min(1.0, fit + CALIBRATION / n), dim)
        visits = _calibrate(placed, q, qid, tree, k, dim, recall)
    bent = ctx.broadcast((tree, part_of, shards))

    def into_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, part_of, shards = bent.value
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            part = part_of[leaf] + np.where(shards[leaf] > 1, np.abs(batch.column("a").to_numpy() >> 8) % shards[leaf], 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(part)], names=[*batch.schema.names[:6], "part"])

    members = placed.mapInArrow(into_parts, "id long, v array<float>, ids array<long>, a long, b long, leaf long, part long")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct vectors of each part with the nearest of the same part."""
        for _, _, group in _groups(batches, ("part",)):
            t = pa.Table.from_batches(group)
            a, b, ids = t.column("a").to_numpy(), t.column("b").to_numpy(), t.column("id").to_numpy()
            first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            size = np.diff(np.concatenate((first, [len(a)])))
            lists = t.column("ids").take(pa.array(first)).to_pylist()
            for g in np.flatnonzero(size > 1).tolist():
                some = t.column("ids").slice(int(first[g]), int(size[g])).combine_chunks().flatten().to_numpy()
                lists[g] = np.unique(some)[: k + 1].tolist()
            once = t.take(pa.array(first)).combine_chunks()
            mid, v = ids[first], once.column("v").combine_chunks()
            m = _matrix(v, dim)
            d, near = np.full((len(mid), k), np.inf), np.full((len(mid), k), -1, np.int64)
            for at in range(0, len(mid), 1024):
                x, y = _top(m[at : at + 1024], mid[at : at + 1024], m, mid, k)
                d[at : at + 1024, : x.shape[1]], near[at : at + 1024, : x.shape[1]] = x, y
            cols = [pa.array(mid), v, pa.array(lists, pa.list_(pa.int64())), *(once.column(c).combine_chunks() for c in ("a", "b", "leaf", "part")), _near(d, near)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "v", "ids", "a", "b", "leaf", "part", "near"])

    home = cut(members.repartition("part").sortWithinPartitions("part", "leaf", "a", "b", "id").mapInArrow(own, HOME))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a query and part it still has to visit, with the leaves it looks at there."""
        tree, part_of, shards = bent.value
        step = max(1, min(1024, 1024 * FIRST_VISITS // max(visits, FIRST_VISITS)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                q = _matrix(some.column("v"), dim)
                bound = some.column("bound").to_numpy()
                leaf, mine = some.column("leaf").to_numpy(), some.column("part").to_numpy()
                order, far = tree.order(q, visits)
                own_far = np.sqrt(((q - tree.leaf[leaf]) ** 2).sum(1))
                apart = np.sqrt(((tree.leaf[leaf][:, None] - tree.leaf[np.maximum(order, 0)]) ** 2).sum(2))
                with np.errstate(invalid="ignore", divide="ignore"):
                    # no vector of the leaf is nearer than its reach leaves, nor across the plane half way to its centroid
                    ball = far - tree.reach[np.maximum(order, 0)]
                    plane = np.where(apart > 0, (far**2 - own_far[:, None] ** 2) / (2 * apart), 0.0)
                go = (order >= 0) & (np.maximum(ball, plane) <= bound[:, None] * (1 + 1e-9)) & (order != leaf[:, None])
                r, c = np.nonzero(go)
                # the other shards of the own leaf are visits too
                more = np.flatnonzero(shards[leaf] > 1)
                r, to = np.concatenate((r, more)), np.concatenate((order[r, c], leaf[more]))
                times = shards[to]
                shard = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                r, to = np.repeat(r, times), np.repeat(to, times)
                part = part_of[to] + shard
                away = part != mine[r]  # the own part has been searched
                r, to, part = r[away], to[away], part[away]
                if not len(r):
                    continue
                o = np.lexsort((to, part, r))
                r, to, part = r[o], to[o], part[o]
                first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (part[1:] != part[:-1]))))
                take = pa.array(r[first])
                yield pa.RecordBatch.from_arrays(
                    [some.column("id").take(take), some.column("v").take(take), pa.array(bound[r[first]]), pa.array(part[first]), _lists(to, np.diff(np.concatenate((first, [len(r)]))))], names=["id", "v", "bound", "part", "leaves"]
                )

    kth = F.when(F.size("near") >= k, F.element_at("near", k)["d"]).otherwise(F.lit(float("inf")))
    visiting = cut(home.select("id", "v", kth.alias("bound"), "leaf", "part").mapInArrow(visit, VISITS))
    # parts with very many visitors stand in as many copies; they are few: each has HOT visits of all
    copies = F.broadcast(visiting.groupBy("part").count().where(F.col("count") > HOT).select("part", F.ceil(F.col("count") / HOT).alias("copies")))
    n_copies = F.coalesce("copies", F.lit(1))
    asks = visiting.join(copies, "part", "left").select("part", F.pmod(F.xxhash64("id"), n_copies).alias("copy"), F.lit(1).alias("role"), F.lit(-1).cast("long").alias("leaf"), "id", "v", "bound", "leaves")
    none = F.array().cast("array<long>")
    here = home.join(copies, "part", "left").select("part", F.explode(F.sequence(F.lit(0).cast("long"), n_copies - 1)).alias("copy"), F.lit(0).alias("role"), "leaf", "id", "v", F.lit(0.0).alias("bound"), none.alias("leaves"))

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest vectors of the visited leaves; members come before queries, which are not kept."""
        mid, leaf, m, whose = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim)), None
        for key, role, group in _groups(batches, ("part", "copy"), "role", 4096):
            if not role:
                t = pa.Table.from_batches(group)
                mid, leaf, m, whose = t.column("id").to_numpy(), t.column("leaf").to_numpy(), _matrix(t.column("v").combine_chunks(), dim), key
                continue
            if key != whose:
                continue  # a part without a vector
            for batch in group:
                lists = batch.column("leaves")
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                to = lists.flatten().to_numpy(zero_copy_only=False)
                q, qid, bound = _matrix(batch.column("v"), dim), batch.column("id").to_numpy(), batch.column("bound").to_numpy()
                for x in np.unique(to).tolist():
                    a, b = np.searchsorted(leaf, [x, x + 1])
                    if a < b:
                        who = row[to == x]
                        d, near = _top(q[who], qid[who], m[a:b], mid[a:b], k)
                        yield pa.RecordBatch.from_arrays([pa.array(qid[who]), _near(d, near, bound[who])], names=["id", "near"])

    found = asks.unionByName(here).repartition("part", "copy").sortWithinPartitions("part", "copy", "role", "leaf").mapInArrow(away, PAIRS)
    best = home.select("id", "near").unionByName(found.where(F.size("near") > 0)).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return _expand(rows.select("id", "a", "b").distinct(), home.select(F.col("id").alias("rep"), "ids", "a", "b"), best, k)


def _parts(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first part, number of shards) of each leaf: neighbouring leaves share a part of at most PART vectors, a larger leaf has parts of its own."""
    part_of, shards = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    part, held = 0, 0
    for i, n in enumerate(counts):
        if n > SHARD:
            part += held > 0
            part_of[i], shards[i] = part, -(-n // SHARD)
            part, held = part + int(shards[i]), 0
            continue
        if held + n > PART:
            part, held = part + 1, 0
        part_of[i] = part
        held += n
    return part_of, shards


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], role: str | None = None, most: int | None = None) -> Iterator[tuple[tuple, int, list[pa.RecordBatch]]]:
    """Sorted rows as (key, role, batches) of one key and role; rows of role 1 come in lists of at most ``most`` rows."""
    held: list[pa.RecordBatch] = []
    now: tuple = ()
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*keys, *([role] if role else []))])
        edge = np.flatnonzero((np.diff(cols, axis=1) != 0).any(0)) + 1
        for a, e in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            key = tuple(cols[:, a].tolist())
            if held and (key != now or most and role and now[-1] and size >= most):
                yield (now[:-1], now[-1], held) if role else (now, 0, held)
                held, size = [], 0
            now = key
            held.append(batch.slice(a, e - a))
            size += e - a
    if held:
        yield (now[:-1], now[-1], held) if role else (now, 0, held)


def _calibrate(placed: DataFrame, q: np.ndarray, qid: np.ndarray, tree: Tree, k: int, dim: int, recall: float) -> int:
    """Fewest leaf visits with which the sample queries find the wanted part of their true neighbours."""
    shared = placed.sparkSession.sparkContext.broadcast((q, qid))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qid = shared.value
        best_d, best_i, best_l = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64), np.full((len(q), k), -1, np.int64)
        for b in batches:
            if not b.num_rows or not len(q):
                continue
            mid, leaf = b.column("id").to_numpy(), b.column("leaf").to_numpy()
            d, near = _top(q, qid, _matrix(b.column("v"), dim), mid, k)
            where = np.argsort(mid)
            at = where[np.searchsorted(mid[where], near)]
            dd, ii, ll = np.hstack((best_d, d)), np.hstack((best_i, near)), np.hstack((best_l, leaf[at]))
            o = np.lexsort((ii, dd), axis=1)[:, :k]
            best_d, best_i, best_l = (np.take_along_axis(z, o, 1) for z in (dd, ii, ll))
        ok = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), ok.sum(1))), pa.array(best_d[ok]), pa.array(best_i[ok]), pa.array(best_l[ok])], names=["q", "d", "n", "leaf"])

    found = placed.select("id", "v", "leaf").mapInArrow(scan, "q long, d double, n long, leaf long")
    rank = Window.partitionBy("q").orderBy("d", "n")
    truth = found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).select("q", "leaf").toArrow()  # k rows a sample query
    if not truth.num_rows:
        return min(MIN_VISITS, len(tree.leaf))
    asked, wanted = truth.column("q").to_numpy(), truth.column("leaf").to_numpy()
    visits = min(FIRST_VISITS, len(tree.leaf))
    while True:
        order, _ = tree.order(q, visits)
        at = order[asked] == wanted[:, None]
        need = int(np.quantile(np.where(at.any(1), at.argmax(1) + 1, len(tree.leaf) + 1), recall, method="higher"))
        if need <= visits or visits == len(tree.leaf):
            return min(max(need, MIN_VISITS), len(tree.leaf))
        visits = min(2 * visits, len(tree.leaf))


def _expand(rows: DataFrame, groups: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """From vectors to rows: the other rows of the same vector at distance 0, then the rows of the neighbours."""
    cand = best.select("id", F.explode("near").alias("x")).select(F.col("id").alias("rep"), F.col("x.d").alias("d"), F.col("x.n").alias("n"))
    far = cand.join(groups.select(F.col("rep").alias("n"), "ids"), "n").select("rep", F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("n"))).alias("near"))
    same = groups.where(F.size("ids") > 1).select("rep", F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("n"))).alias("near"))
    merged = far.unionByName(same).groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    # a vector that very many rows have is one row here: the join splits its rows where they are skewed
    mine = rows.join(groups.select("rep", "a", "b").join(merged, "rep"), ["a", "b"]).select("id", F.slice(F.filter("near", lambda x: x["n"] != F.col("id")), 1, k).alias("near"))
    return mine.select("id", F.posexplode("near").alias("p", "x")).select("id", F.col("x.n").alias("neighbor"), F.col("x.d").alias("distance"), (F.col("p") + 1).alias("rank"))
