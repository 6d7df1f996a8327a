"""Checks and summaries of book tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Titles of front and back matter, and words of publishing pages.
FRONT = ("contents", "table of contents", "inhaltsverzeichnis", "copyright", "imprint", "impressum", "title page", "dedication", "widmung", "foreword", "vorwort")
BACK = ("acknowledgements", "acknowledgments", "danksagung", "about the author", "über den autor", "über die autorin", "bibliography", "bibliografie", "also by", "advertisement", "advertisements")
PUBLISHING = ("bibliografische information", "copyright", "impressum", "isbn", "auflage", "books on demand", "herstellung und verlag")


def plain_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", ""))


def flat_title(title: Column) -> Column:
    """Letters and figures only, for comparing a chapter's with its book's title."""
    return F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")


def matter(sections: DataFrame) -> DataFrame:
    """Adds matter_class: front, body or back, from the title, the place in the book and publishing words.  A null title is an empty one."""
    title = F.coalesce("chapter_title", F.lit(""))
    n = F.count("*").over(Window.partitionBy("book_id"))
    index = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_index", "section_id")) - 1
    t = sections.withColumn("total", n).withColumn("place", index)
    name = plain_title(title)
    early = (F.col("total") > 1) & (F.col("place") < F.greatest(F.lit(2), F.floor(F.col("total") / 10)))
    head = F.lower(F.substring(F.coalesce("content", F.lit("")), 1, 4000))
    published = head.contains(PUBLISHING[0])
    for w in PUBLISHING[1:]:
        published = published | head.contains(w)
    same = F.coalesce((F.length(F.coalesce("book_title", F.lit(""))) > 0) & (flat_title(title) == flat_title(F.col("book_title"))), F.lit(False))
    front = name.isin(*FRONT) | early & (name.isin("text", "document") | same | published)
    return t.withColumn("matter_class", F.when(front, "front").when(name.isin(*BACK), "back").otherwise("body")).drop("total", "place")


def stale_hashes(sections: DataFrame) -> DataFrame:
    """section_id of contents whose stored hash is another text's."""
    return sections.where(F.col("content").isNotNull() & ~F.sha2("content", 256).eqNullSafe(F.col("text_sha256"))).select("section_id")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, median, min and max of a value a group."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"))


def coverage(df: DataFrame, a: str, b: str) -> DataFrame:
    """Combinations of the values of two columns that no row has.  Both columns have few values."""
    have = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    every = have.select(a).distinct().groupBy().agg(F.collect_set(a).alias("xs"))
    grid = have.select(b).distinct().join(F.broadcast(every)).select(F.explode("xs").alias(a), b)  # every is one row
    return grid.join(have, [a, b], "left_anti")


def complete(df: DataFrame, group: str, member: str, wanted: list[str]) -> DataFrame:
    """Groups that have every wanted member."""
    return df.where(F.col(member).isin(wanted)).groupBy(group).agg(F.count_distinct(member).alias("k")).where(F.col("k") == len(wanted)).select(group)


def by_list(column: Column, order: list[str]) -> Column:
    """Place in a given order, behind it what is not listed."""
    at = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def top_per_group(df: DataFrame, group: str, by: Column, key: str, k: int = 5) -> DataFrame:
    """The first k rows of each group, ties by key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(by, key))).where(F.col("rank") <= k)


def heading_runs(lines: DataFrame, is_heading: Column) -> DataFrame:
    """Adds part: number of headings up to the line, which splits a text into chapters."""
    return lines.withColumn("part", F.sum(is_heading.cast("int")).over(Window.partitionBy("text_id").orderBy("line_no")))
