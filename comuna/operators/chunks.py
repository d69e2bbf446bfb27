"""Chunks of index items, procedures and page snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import compact_spaces, once
from . import pages

#: Characters of a chunk, and of a block at least.
LONGEST, SHORTEST = 1400, 30


def packed(pieces: Column, between: str, most: int) -> Column:
    """Pieces joined one after the other while the joined text has at most ``most`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        first = acc["open"] == ""
        fits = F.length(acc["open"]) + len(between) + F.length(piece) <= most
        open_ = F.when(first | ~fits, piece).otherwise(F.concat(acc["open"], F.lit(between), piece))
        return F.struct(F.when(first | fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), open_.alias("open"))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def split_long(text: Column, most: int = LONGEST) -> Column:
    """Whole sentences packed up to ``most`` characters; what is still longer is cut hard afterwards."""
    sentences = F.filter(F.split(compact_spaces(text), r"(?<=[.!?;:])\s+"), lambda s: s != "")
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: compact_spaces(F.substring(s, i * most + 1, F.lit(most))))
    whole_or_cut = lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(cut(s))
    return once(sentences, lambda found: F.filter(F.flatten(F.transform(packed(found, " ", most), whole_or_cut)), lambda s: s != ""))


def chunks_of(text: Column, listing: Column, most: int = LONGEST) -> Column:
    """The chunks of an index item.

    The text without boilerplate is one block, as its line breaks are gone; if that is too short or noisy the whole text is
    split instead. Noisy chunks are left out. Null has none.
    """

    def pieces(block: Column) -> Column:
        good = (F.length(block) >= SHORTEST) & ~pages.is_noisy(block, listing)
        source = F.when(good, block).otherwise(F.coalesce(text, F.lit("")))
        return once(F.struct(good.alias("good"), source.alias("source")), lambda s: F.when(s["good"] & (F.length(s["source"]) <= most), F.array(s["source"])).otherwise(split_long(s["source"], most)))

    found = once(once(pages.strip_boilerplate(text), pieces), lambda p: F.transform(packed(p, "\n", most), compact_spaces))
    return once(found, lambda f: F.filter(f, lambda c: (c != "") & ~pages.is_noisy(c, listing)))


def crawled_chunks(items: DataFrame) -> DataFrame:
    """``chunk_id``, ``item_id``, ``place`` (from 0), ``category``, ``kind``, ``title``, ``text`` of the visible items that are no listing pages.

    ``items`` has ``item_id``, ``source_type``, ``url``, ``canonical_url``, ``page_url``, ``title``, ``summary``, ``text``, ``visible``. An item without text
    is its summary, without that its title; a chunk without title has the URL, or the item's number, for one. Items of other kinds
    at a listing path count as listings; null ``visible`` is not.
    """
    missing = F.coalesce(F.nullif("text", F.lit("")), F.nullif("summary", F.lit("")), F.col("title"))
    kept = items.where(F.coalesce("visible", F.lit(False)) & ~F.coalesce(pages.is_skipped(F.col("source_type"), F.col("url"), F.col("title")), F.lit(False)))
    listing = F.coalesce(pages.is_listing(F.col("url")), F.lit(False))
    known = kept.select(
        "item_id", rules.item_category(F.col("url"), F.col("title"), F.col("canonical_url"), F.col("page_url"), F.col("source_type")).alias("category"),
        rules.item_type(F.col("url"), F.concat_ws(" ", "title", "summary", "text"), F.col("source_type"), F.col("canonical_url")).alias("kind"),
        F.coalesce(F.nullif("title", F.lit("")), F.nullif("url", F.lit("")), F.concat(F.lit("Fuente "), F.col("item_id").cast("string"))).alias("shown"),
        missing.alias("body"), listing.alias("listing"),
    )
    rows = known.select("item_id", "category", "kind", F.col("shown").alias("title"), F.posexplode(chunks_of(F.col("body"), F.col("listing"))).alias("place", "text"))
    chunk_id = F.concat(F.lit("spider-"), F.col("item_id").cast("string"), F.lit("-"), F.col("place").cast("string"))
    return rows.select(chunk_id.alias("chunk_id"), "item_id", "place", "category", "kind", "title", "text")


def procedure_chunks(procedures: DataFrame) -> DataFrame:
    """A chunk for the description and one for every item of every section (``procedure_id``, ``description``, ``sections``: map of arrays)."""
    said = procedures.select("procedure_id", F.lit("descripcion").alias("section"), F.lit(0).alias("place"), compact_spaces(F.col("description")).alias("text"))
    entries = procedures.select("procedure_id", F.explode("sections").alias("section", "items"))
    items = entries.select("procedure_id", "section", F.posexplode("items").alias("place", "text"))
    return said.unionByName(items.select("procedure_id", "section", "place", compact_spaces(F.col("text")).alias("text"))).where("text <> ''")


def snapshot_chunks(snapshots: DataFrame, url: str = "url", blocks: str = "blocks") -> DataFrame:
    """A chunk for every block of at least 30 characters, numbered by its place in the snapshot."""
    rows = snapshots.select(url, F.posexplode(blocks).alias("place", "text"))
    return rows.where(F.length("text") >= SHORTEST)
