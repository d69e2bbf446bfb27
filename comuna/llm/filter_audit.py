"""Filter interaction audit: what each filter of a set removes in every order of applying them.

A document's failures are a mask, one bit a filter, whatever the order. So documents are counted once by part, mask and label
(the number of such cells does not grow with the documents), and the rest works on cells: every cell is unpivoted against every
step of every order; a running bit-or window over the steps before names the filters already applied, which tells whether the
cell is still there; conditional sums give the counts of a step, and a window over a filter's rows in all orders its Shapley total.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup, quoted

#: The filters' letters; bit i of a mask is the i-th.
LETTERS = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The maximal runs of other signs than blanks, in order."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def text_failures(text: Column) -> Column:
    """Mask of the filters A to D for a text that is not null: few words, repeated words, capitals, odd signs."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def mask(words: Column) -> Column:
        n = F.size(words).cast("long")
        fails = [n < 100, F.size(F.array_distinct(words)).cast("long") * 100 < n * 80, capitals.cast("long") * 100 > F.length(text).cast("long") * 10, text.rlike(r"[#$%&*|]")]
        return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))

    return F.transform(F.array(words_of(text)), mask)[0]


def failure_masks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``mask`` (A to E) of every row; E holds where a smaller doc_id has the same text.

    Texts are compared by SHA-256 in one aggregation; texts that occur once are not joined back, rows of frequent texts stay
    where they are (``lookup``). Null texts are empty, a null ``lang`` is the empty string, rows without doc_id never fail E and
    make no other row fail it, repeated rows of one doc_id are no copies of each other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = cut(rows)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    total = rows.count()
    copied = lookup(rows, cut(first), "digest", "n", total)
    return copied.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 1 << LETTERS.index("E")).otherwise(0)).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``; a document with several label rows has what any of them says, one without has neither."""
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    none = F.lit(False)
    joined = rows.where("doc_id IS NOT NULL").join(flags, "doc_id", "left").select(*rows.columns, F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    return joined.unionByName(rows.where("doc_id IS NULL").withColumns({"good": none, "toxic": none}))


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per ``part``, ``filter_order`` and ``step`` with the metrics of that step.

    ``cells`` has ``part``, ``mask``, ``good``, ``toxic``, ``n``, a row a cell. No cells give no rows.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    long = cells.select("*", F.explode(orders).alias("filter_order")).select("*", steps).withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    long = long.withColumn("bit", F.expr(f"shiftleft(1, instr('{letters}', filter) - 1)"))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("done", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails, there = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("done")) == 0
    count = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long").alias(name)
    found = long.groupBy("part", "filter_order", "step", "filter").agg(
        count(there & ~fails, "kept"), count(there & fails, "removed"), count(fails & ~there, "redundant"), count(F.col("mask") == F.col("bit"), "unique_fails"),
        count(there & fails & F.col("good"), "good_lost"), count(there & fails & F.col("toxic"), "toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long")
    return found.withColumn("shapley", shapley).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the filters A to E over whole ``docs`` (``doc_id``, ``text``, ``lang``) by ``lang``; other columns are not read.

    An empty table gives no rows.
    """
    rows = labelled(failure_masks(docs.select(*map(quoted, ("doc_id", "text", "lang")))), labels)
    return audit(rows.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n")))
