"""Problem 8: mixing sources to target weights.

A document of a source is taken ``rate`` times on average: the wanted tokens of
the source over its tokens, at most ``max_repeats``.  The whole part is certain;
the fractions are rounded by the pivotal method: two fractions meet and mass
moves from one to the other at random until one is 0 or 1, which keeps every
expectation and, within a source, the number of copies.  Documents meet in
buckets in order of size; the one fraction left of each bucket climbs a
reduction tree until one is left of the source.

A null text has no tokens and null sources belong to no target, but a null-source
document counts into the size of all documents.  A source without documents
reaches nothing.  Repeated document rows count each, repeated target rows once;
a target with a null share, ratio or limit wants or takes nothing.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .batches import arrow_schema, record_batch

# Fixed value: a run of letters, digits or underscores, or any other single non-blank character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x85\x1c-\x1f]"
#: Documents of one bucket, fractions that meet in one node of the tree, rows of mix targets.
BUCKET, FAN, MAX_TARGETS = 5_000, 200, 10_000
KEYS = ["mix_id", "source"]
SCHEMA = "mix_id int, source string, bucket long, doc_id long, tokens long, base int, frac double"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: wanted and present tokens, the rate at which each document is taken, whether the target is out of reach."""
    present = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    everything = sized.agg(F.sum("tokens").alias("all_tokens"))
    targets = targets.select(*KEYS, "target_share", "max_repeats", "budget_ratio").distinct()
    p = targets.join(present, "source", "left").crossJoin(F.broadcast(everything))  # one row
    p = p.withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0))).withColumn("source_docs", F.coalesce("source_docs", F.lit(0)))
    p = p.withColumn("wanted_tokens", F.coalesce(F.col("target_share") * F.col("budget_ratio") * F.col("all_tokens"), F.lit(0.0)))
    p = p.withColumn("out_of_reach", F.coalesce(F.col("source_tokens") * F.col("max_repeats") < F.col("wanted_tokens"), F.lit(False)))
    rate = F.when(F.col("source_tokens") > 0, F.least(F.col("wanted_tokens") / F.col("source_tokens"), F.coalesce(F.col("max_repeats").cast("double"), F.lit(0.0)))).otherwise(0.0)
    return p.withColumn("rate", rate)


def _pivot(rows: list[tuple], rng: random.Random) -> None:
    """Round ``frac`` (the last field) of all rows but at most one, in place."""
    open_row = None
    for r in rows:
        if not 0 < r[-1] < 1:
            continue
        if open_row is None:
            open_row = r
            continue
        a, b = open_row[-1], r[-1]
        s = a + b
        if s < 1:
            up = rng.random() * s < a
            open_row[-1], r[-1] = (s, 0.0) if up else (0.0, s)
        else:
            up = rng.random() * (2 - s) < 1 - b
            open_row[-1], r[-1] = (1.0, s - 1) if up else (s - 1, 1.0)
        for x in (open_row, r):
            if abs(x[-1] - round(x[-1])) < 1e-9:
                x[-1] = float(round(x[-1]))
        open_row = r if 0 < r[-1] < 1 else open_row if 0 < open_row[-1] < 1 else None


def _round(df: DataFrame, seed: int, level: int) -> DataFrame:
    """Every bucket rounded but for one fraction.  Buckets come sorted, one after the other; a bucket holds at most BUCKET or FAN rows on average."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    target = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(group: list[list], key: tuple) -> pa.RecordBatch:
            _pivot(group, random.Random(f"{seed}/{level}/{key}"))
            return record_batch(group, target)

        group: list[list] = []
        key: tuple = ()
        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if r[:3] != key and group:
                    yield closed(group, key)
                    group = []
                key = r[:3]
                group.append(list(r))
        if group:
            yield closed(group, key)

    parts = [*KEYS, "bucket"]
    return df.select(*names).repartition(*parts).sortWithinPartitions(*parts, "tokens", "doc_id").mapInArrow(run, SCHEMA)


def copies(sized: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """mix_id, source, doc_id, tokens, copies of every document a mixture takes at least once.

    ``planned`` has one row a target and goes to every executor; the number of targets is checked.
    """
    if "row" not in sized.columns:
        sized = cut(sized.withColumn("row", F.monotonically_increasing_id()))
    sizes = [r.source_docs for r in planned.select("source_docs").limit(MAX_TARGETS + 1).collect()]
    if len(sizes) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} mix targets")
    want = planned.select("mix_id", F.col("source").alias("wanted"), "rate", "source_docs")
    df = sized.join(F.broadcast(want), F.col("source") == F.col("wanted"))
    df = df.withColumn("base", F.floor("rate").cast("int")).withColumn("frac", F.col("rate") - F.floor("rate"))
    # the row number parts the rows of one doc_id; ``sized`` is written, so it stays the same
    df = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.ceil(F.col("source_docs") / BUCKET)))
    done = []
    level, width = 0, max([1, *(-(-n // BUCKET) for n in sizes)])
    rounded = cut(_round(df, seed, level))
    while width > 1:
        level, width = level + 1, -(-width // FAN)
        is_open = (F.col("frac") > 0) & (F.col("frac") < 1)
        done.append(rounded.where(~is_open))
        rounded = cut(_round(rounded.where(is_open).withColumn("bucket", F.floor(F.col("bucket") / FAN)), seed, level))
    last = F.when((F.col("frac") > 0) & (F.col("frac") < 1), (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30) < F.col("frac")).cast("int")).otherwise(F.col("frac").cast("int"))
    done.append(rounded)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("copies", F.col("base") + last).where("copies > 0").select(*KEYS, "doc_id", "tokens", "copies")


def sized_documents(documents: DataFrame) -> DataFrame:
    """doc_id, source, tokens, row (a number of its own), written once: everything else needs no text."""
    return cut(documents.select("doc_id", "source", tokens(F.col("text")).alias("tokens"), F.monotonically_increasing_id().alias("row")))


def report(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """One row a target: tokens present, wanted and reached, shares reached, highest number of copies, and whether the target is out of reach."""
    planned = cut(plan(sized, targets))
    taken = copies(sized, planned, seed).groupBy(*KEYS).agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.count("*").alias("documents_taken"), F.max("copies").alias("most_copies"))
    r = planned.join(taken, KEYS, "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
    whole = r.groupBy("mix_id").agg(F.sum("reached_tokens").alias("mix_tokens"))
    r = r.join(whole, "mix_id")
    share = F.when(F.col("mix_tokens") > 0, F.col("reached_tokens") / F.col("mix_tokens"))
    return r.select(*KEYS, "target_share", "max_repeats", "source_tokens", "wanted_tokens", "reached_tokens", share.alias("actual_share"), F.coalesce("documents_taken", F.lit(0)).alias("documents_taken"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "out_of_reach")
