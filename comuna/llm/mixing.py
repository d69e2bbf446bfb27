"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is a number of blocks of equal many words. Blocks go to sources by highest quotients target / (2k - 1), k = 1, 2, ...; a
source's blocks go to its shards, which are seeded hash classes of its documents, in the same way by the shards' words. So every
shard has an integer quota of blocks before any is chosen. A shard's documents are laid end to end in seeded order and cut into
blocks, and its quota is taken from the beginning, round again if it is more than all. Sources that are to be taken whole as often
as allowed need no shards.

Which quotients are the highest is found by a search for the least quotient that still gets a block, with one aggregation of the
sources per step, so there may be any number of sources. Documents are shuffled once, by source and shard.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup, shuffle_partitions

#: About so many blocks make a mix; where it has fewer words a block is a word.
BLOCKS = 1 << 24
#: Shards of a source at most, and blocks of a shard on average at least.
SHARDS, SHARD_BLOCKS = 1024, 256
_POINTS = 16


def word_count(text: Column) -> Column:
    """Number of maximal runs of other signs than blanks; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """``doc_id``, ``source``, ``key`` (source, never null), ``size``, ``draw`` and ``place`` (a seeded number and order) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        word_count(text).alias("size"), F.conv(F.substring(mark, 1, 8), 16, 10).cast("long").alias("draw"), F.unhex(mark).alias("place"),
    )


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code points, null last: ranges are dealt out and counted, then numbered from their offsets."""
    parts = shuffle_partitions(sources.sparkSession)
    dealt = cut(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # a row a partition
    before = {p: sum(counts[q] for q in counts if q < p) for p in counts}
    offsets = sources.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("own", own).join(F.broadcast(offsets), "part").withColumn("rank", F.col("own") + F.col("before")).drop("part", "own", "before")


def with_targets(sources: DataFrame, weights: tuple[int, ...], percent: int, repeats: int) -> tuple[DataFrame, int]:
    """``sources`` (``rank``, ``source_size``) with ``full`` and ``target``; also 100 times the words that sources not full share.

    Sources share ``percent`` of all words by weight; a target stops at ``repeats`` times its source, and what is over is shared
    by the others until none is above. Each round is one aggregation.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    rows = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    total, shares = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, held = percent * (total or 0), 0
    while True:
        full = F.col("weight") * F.lit(rest) > F.col("most") * F.lit(100 * (shares or 0))
        n, most, open_ = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == held or not open_:
            break
        held, rest, shares = n, percent * total - 100 * most, open_
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(100 * (shares or 1)))
    found = rows.withColumn("full", full if open_ else F.lit(True))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(share)
    return found.withColumn("target", target), rest if open_ else 0


def seats(votes: Column, least: float) -> Column:
    """How many of the quotients votes / (2k - 1) are at or above ``least``."""
    k = F.floor((votes / least + 1) / 2)
    return F.when(votes / (2 * k + 1) >= least, k + 1).when((k > 0) & (votes / (2 * k - 1) < least), k - 1).otherwise(k)


def apportioned(sources: DataFrame, blocks: int, total: float) -> DataFrame:
    """``sources`` (``rank``, ``target``) with ``blocks`` by highest quotients; equal quotients go by rank. Targets sum to ``total``.

    The least quotient that still counts is bracketed, as a source's number differs from its share by at most a half at the
    divisor looked for, and narrowed by ``_POINTS`` quotients a step.
    """
    n = sources.where("target > 0").count()
    if not blocks or not n:
        return sources.withColumn("blocks", F.lit(0).cast("long"))
    count = lambda qs: [int(x or 0) for x in sources.agg(*[F.sum(seats(F.col("target"), q)) for q in qs]).first()]
    low, high = total / (2 * blocks + n + 2), total / (2 * blocks - n - 2) if 2 * blocks > n + 2 else 2 * total
    while True:
        inner = sorted({q for i in range(1, _POINTS) if low < (q := low + (high - low) * i / _POINTS) < high})
        if not inner:
            break  # neighbouring numbers: the last places go to equal quotients
        found = dict(zip(inner, count(inner)))
        exact = [q for q, made in found.items() if made == blocks]
        if exact:
            return sources.withColumn("blocks", seats(F.col("target"), exact[0]).cast("long"))
        low, high = max([low, *(q for q in inner if found[q] > blocks)]), min([high, *(q for q in inner if found[q] < blocks)])
    rows = sources.withColumn("blocks", seats(F.col("target"), high).cast("long"))
    more = blocks - count([high])[0]
    tied = rows.where(seats(F.col("target"), low) > F.col("blocks")).orderBy("rank").limit(more).select("rank", F.lit(1).alias("more"))
    return rows.join(tied, "rank", "left").withColumn("blocks", F.col("blocks") + F.coalesce("more", F.lit(0))).drop("more")


def sainte_lague(votes: np.ndarray, blocks: int, limits: np.ndarray) -> np.ndarray:
    """Blocks of each shard by highest quotients votes / (2k - 1), within limits; equal quotients go to the smaller number.

    Starts from rounded shares and mends the difference, which is at most about half the number of shards, through a heap.
    """
    votes = votes.astype(np.float64)
    given = np.minimum(np.floor(votes * blocks / max(votes.sum(), 1) + 0.5).astype(np.int64), limits)
    while (over := int(given.sum()) - blocks) != 0:
        sign = 1 if over < 0 else -1
        can = np.flatnonzero((given < limits) & (votes > 0) if sign > 0 else given > 0)
        if not len(can):
            break
        quotient = lambda i: votes[i] / (2 * given[i] + sign)  # noqa: E731  the next to get, or the last that was got
        heap = [(-sign * quotient(i), sign * i) for i in can.tolist()]
        heapify(heap)
        for _ in range(abs(over)):
            _, at = heap[0]
            i = sign * at
            given[i] += sign
            usable = given[i] < limits[i] if sign > 0 else given[i] > 0
            heapreplace(heap, (-sign * quotient(i) if usable else float("inf"), at))
            if heap[0][0] == float("inf"):
                break
    # Rounding may have put a block where a higher quotient waits: move blocks until none does.
    while True:
        up = np.where(given < limits, votes / (2 * given + 1), -1.0)
        down = np.where(given > 0, votes / np.maximum(2 * given - 1, 1), np.inf)
        best, worst = int(up.argmax()) if len(up) else 0, len(down) - 1 - int(down[::-1].argmin()) if len(down) else 0
        if not len(up) or up[best] < 0 or (up[best], -best) <= (down[worst], -worst) or best == worst:
            return given
        given[best] += 1
        given[worst] -= 1


def quotas(rows: DataFrame, size: int, repeats: int) -> DataFrame:
    """``key``, ``shard``, ``quota``, ``words`` of every shard of ``rows`` (``key``, ``shard``, ``blocks``, ``size``): at most ``SHARDS`` rows a source meet in a task."""
    shards = rows.groupBy("key", "blocks", "shard").agg(F.sum("size").alias("words"))

    def share(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("shard")
        words = found["words"].to_numpy(np.int64)
        return found.assign(quota=sainte_lague(words, int(found["blocks"].iloc[0]), -(-repeats * words // size)))[["key", "shard", "quota", "words"]]

    return shards.groupBy("key").applyInPandas(share, "key string, shard long, quota long, words long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, repeats: int = 2, seed: str = "mix", most_blocks: int = BLOCKS) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` of every row of ``docs`` (``doc_id``, ``text``, ``source``).

    ``taken`` is how many of a document's words the mix takes, repeats counted, at most ``repeats`` times its size. A null text has
    size 0 and gives nothing; a null source is a source of its own, the last; rows without doc_id count like others; repeated rows
    each keep a row; other columns are not read. An empty table gives no rows. The same rows give the same mix, however they are
    dealt out. Rows alike in doc_id and text fall into one shard.
    """
    rows = cut(sized(docs, seed))
    found = rows.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources, rest = with_targets(cut(ranked(found)), weights, percent, repeats)
    words = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    size = max(1, percent * (words[0] or 0) // (100 * most_blocks))
    part = apportioned(sources.where("NOT full"), (rest + 50 * size) // (100 * size), rest / 100)
    part = part.withColumn("full", F.col("blocks") * size >= F.col("most"))
    every = cut(sources.where("full").withColumn("blocks", F.lit(0).cast("long")).unionByName(part))
    shards = F.least(F.lit(SHARDS), F.greatest(F.lit(1), F.ceil(F.col("blocks") / SHARD_BLOCKS))).cast("long")
    about = every.select("key", "source_size", "target", "full", "blocks", shards.alias("shards"), "n")
    known = lookup(rows.select("doc_id", "key", "size", "draw", "place"), about, "key", "n", words[1])
    split = ~F.col("full") & (F.col("size") > 0) & (F.col("blocks") > 0)
    whole = known.where(~split).withColumn("taken", F.when(F.col("full"), F.col("size") * repeats).otherwise(0).cast("long"))
    cuts = known.where(split).withColumn("shard", F.col("draw") % F.col("shards"))
    laid = cuts.join(quotas(cuts, size, repeats), ["key", "shard"])
    end = F.sum("size").over(Window.partitionBy("key", "shard").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    laid = laid.withColumn("end", end).withColumn("due", F.least(F.col("quota") * size, F.col("words") * repeats))
    again = F.floor(F.col("due") / F.col("words")) * F.col("size")
    first = F.greatest(F.lit(0), F.least("end", F.col("due") % F.col("words")) - (F.col("end") - F.col("size")))
    laid = laid.withColumn("taken", (again + first).cast("long"))
    shown = ["doc_id", "size", "source_size", "target", "taken"]
    return whole.select(shown).unionByName(laid.select(shown))
