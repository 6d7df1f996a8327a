"""Problem 1: visually identical text with different characters.

``consistent_sections`` gives both text fields of every section in one
consistent form; ``look_alikes`` the pairs of rows whose values look the same
but are stored differently.  Null values stay null and pair with nothing; empty
texts and texts of blanks or invisible characters alone look the same; a title without
a book_id shares its book with none.
"""

from __future__ import annotations

import unicodedata

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .batches import map_texts
from .lookalikes import skeletons


def consistent_sections(sections: DataFrame) -> DataFrame:
    """section_id, book_id, chapter_title_form, content_form: equal exactly where the stored values look the same."""

    def run(c: dict[str, list]) -> dict[str, list]:
        nfc = lambda xs: [None if x is None else unicodedata.normalize("NFC", x) for x in skeletons(xs)]
        return {"section_id": c["section_id"], "book_id": c["book_id"], "chapter_title_form": nfc(c["chapter_title"]), "content_form": nfc(c["content"])}

    return map_texts(sections.select("section_id", "book_id", "chapter_title", "content"), ["content", "chapter_title"], run, "section_id long, book_id string, chapter_title_form string, content_form string")


def skeleton_keys(sections: DataFrame) -> DataFrame:
    """One row a non-null value: field_name, look (hash of scope and skeleton), stored (hash of the value), section_id."""

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"field_name": [], "look": [], "stored": [], "section_id": []}
        for field in ("content", "chapter_title"):
            for i, (value, skel) in enumerate(zip(c[field], skeletons(c[field]), strict=True)):
                if value is None or field == "chapter_title" and c["book_id"][i] is None:
                    continue
                scope = "" if field == "content" else f"{c['book_id'][i]}\x00"
                out["field_name"].append(field)
                out["look"].append(xxhash.xxh3_128_digest((scope + skel).encode("utf-8", "surrogatepass")))
                out["stored"].append(xxhash.xxh3_128_digest(value.encode("utf-8", "surrogatepass")))
                out["section_id"].append(c["section_id"][i])
        return out

    return map_texts(sections.select("section_id", "book_id", "chapter_title", "content"), ["content", "chapter_title"], run, "field_name string, look binary, stored binary, section_id long")


#: Rows of one stored value that are expanded together.
CHUNK = 1000


def _mixed(keys: DataFrame) -> DataFrame:
    """The keys of looks that are stored in more than one way."""
    group = ["field_name", "look"]
    mixed = keys.groupBy(*group).agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select(*group)
    return keys.join(mixed, group, "left_semi")


def look_alike_classes(sections: DataFrame) -> DataFrame:
    """section_id, field_name, look, variants, links: the class of every value stored in more than one way, in how many ways, and with how many rows it pairs.

    One row a value: no pairs are formed, counts are combined before the shuffle.
    """
    keys = _mixed(cut(skeleton_keys(sections)))
    group = ["field_name", "look"]
    stored = keys.groupBy(*group, "stored").agg(F.count("*").alias("same"))
    whole = stored.groupBy(*group).agg(F.count("*").alias("variants"), F.sum("same").alias("all"))
    links = stored.join(whole, group).select(*group, "stored", "variants", (F.col("all") - F.col("same")).alias("links"))
    return keys.join(links, [*group, "stored"]).select("section_id", "field_name", F.lower(F.hex("look")).alias("look"), "variants", "links")


def look_alikes(sections: DataFrame) -> DataFrame:
    """section_id_a, section_id_b, field_name.

    Texts are reduced to two hashes in the scan, so only keys are shuffled.  The
    rows of one stored value are listed in chunks of about CHUNK; chunks of
    different values of a look meet, are spread over all tasks and expanded
    there, so a look that very many rows share is no task of its own.
    """
    keys = _mixed(cut(skeleton_keys(sections)))  # the texts are read once; from here on only hashes
    group = ["field_name", "look"]
    many = keys.groupBy(*group, "stored").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("section_id"), F.col("chunks")).alias("chunk")
    lists = keys.join(many, [*group, "stored"]).select(*group, "stored", chunk, "section_id").groupBy(*group, "stored", "chunk").agg(F.collect_set("section_id").alias("ids"))
    one, two = (lists.select(*group, F.col("stored").alias(s), F.col("ids").alias(i)) for s, i in (("sa", "ia"), ("sb", "ib")))
    pairs = one.join(two, group).where("sa < sb").select("field_name", "ia", "ib").repartition(F.xxhash64("ia", "ib"))
    full = pairs.select("field_name", F.explode("ia").alias("ia"), "ib").select("field_name", "ia", F.explode("ib").alias("ib"))
    return full.where("ia <> ib").select(F.least("ia", "ib").alias("section_id_a"), F.greatest("ia", "ib").alias("section_id_b"), "field_name")
