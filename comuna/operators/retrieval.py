"""Hybrid retrieval: lexical scores, vector similarity, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spanish import query_tokens
from ..functions.text import normalize
from . import scoring
from .search import BROADCAST_WORDS, exact_score
from .vectors import cosine, vector_scores  # noqa: F401

def exact_token_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id``, ``chunk_id``, ``score`` of all pairs that share a word, by an inverted-index join.

    Both sides have an id and ``text``. They are reduced to their distinct words without stop words before the join; the words of a
    query set are broadcast if there are few of them.
    """
    words = lambda df, key: df.select(key, F.explode(query_tokens(F.col("text"))).alias("token"))
    asked = words(queries, "query_id")
    if asked.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        asked = F.broadcast(asked)
    met = words(chunks, "chunk_id").join(asked, "token")
    return met.groupBy("query_id", "chunk_id").agg(F.sum(exact_score(F.col("token"))).alias("score"))


def best_token_scores(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """What can be among the ``k`` best of each query in ``exact_token_scores``, scored where the texts are: apply ``top_k``."""
    return scoring.whole_word_scores(queries, scoring.spread(chunks).select("chunk_id", normalize(F.col("text")).alias("plain")), k)


def top_k(scores: DataFrame, k: int, by: str = "query_id", item: str = "chunk_id", score: str = "score") -> DataFrame:
    """The ``k`` best of each query; ties go to the smaller id. Tasks pre-select before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def hybrid(lexical: DataFrame, vector: DataFrame, lexical_weight: float = 18.0, vector_weight: float = 16.0) -> DataFrame:
    """The better of both weighted scores per pair."""
    both = lexical.select("query_id", "chunk_id", (F.col("score") * lexical_weight).alias("score")).unionByName(vector.select("query_id", "chunk_id", (F.col("similarity") * vector_weight).alias("score")))
    return both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def versions(items: DataFrame, keys: list[str], order: str, digest: str) -> DataFrame:
    """Version numbers per key: a new one wherever the hash differs from the one before; ``changed`` says where.

    A row with a null in its key has nothing before it and is version 1.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    known = items.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    changed = F.lag(digest).over(w).isNull() | (F.lag(digest).over(w) != F.col(digest))
    known = known.withColumn("changed", changed).withColumn("version", F.sum(F.col("changed").cast("int")).over(w))
    rest = items.where(" OR ".join(f"`{k}` IS NULL" for k in keys))
    return known.unionByName(rest.withColumn("changed", F.lit(True)).withColumn("version", F.lit(1).cast("bigint")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def section_citations(evidence: DataFrame, n: int = 4) -> DataFrame:
    """``tier`` and ``place`` of the evidence that answers for one section of a procedure, ``n`` at most per query.

    ``evidence`` has ``query_id``, ``procedure_id``, ``section`` (both asked for), ``chunk_id``, ``chunk_procedure``, ``chunk_section``, ``score``.
    First come chunks of that section (0), then the procedure's description and remarks (1), then what shares either (2).
    """
    own, same = F.col("chunk_procedure") == F.col("procedure_id"), F.col("chunk_section") == F.col("section")
    tier = F.when(own & same, 0).when(own & F.col("chunk_section").isin("descripcion", "observaciones"), 1).when(own | same, 2)
    ranked = evidence.withColumn("tier", tier).where(F.col("tier").isNotNull())
    once = ranked.groupBy("query_id", "chunk_id").agg(F.min("tier").alias("tier"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "chunk_id"))
    return once.withColumn("place", place).where(F.col("place") <= n)


def reply_evidence(evidence: DataFrame, least: float = 5.0, n: int = 4) -> DataFrame:
    """The ``n`` chunks that a reply rests on, per query.

    ``evidence`` has ``query_id``, ``chunk_id``, ``score``, ``is_crawled``, ``is_official``, ``is_top_procedure``. Crawled evidence alone counts
    where its best reaches ``least``; official sources alone where there are any; the top procedure's chunks come first.
    """
    whole = Window.partitionBy("query_id")
    crawled = F.coalesce(F.max(F.when(F.col("is_crawled"), F.col("score"))).over(whole) >= least, F.lit(False))
    pool = evidence.withColumn("_crawled", crawled).where(~F.col("_crawled") | F.col("is_crawled"))
    pool = pool.withColumn("_official", F.max("is_official").over(whole)).where(~F.col("_official") | F.col("is_official"))
    first = F.col("is_top_procedure") & ~F.col("_crawled")
    place = F.row_number().over(whole.orderBy(F.desc(first), F.desc("score"), "chunk_id"))
    return pool.withColumn("place", place).where(F.col("place") <= n).drop("_crawled", "_official")


def reply_kind(intent: Column, topic: Column, no_corpus: Column, best: Column, procedure_score: Column, strong_words: Column, strong_matches: Column, least: float = 5.0) -> Column:
    """Which reply a question gets, by the first rule that holds.

    Small talk, a topic of another office, a town without texts, too low a best score, or strong words in the question that the
    first chunk lacks; in the last two cases a procedure whose own words score 10 stands in.
    """
    stand_in = F.when(procedure_score >= 10, "procedure")
    return (
        F.when(intent.isNotNull(), "conversational").when(topic.isNotNull(), "out_of_scope").when(no_corpus, "no_corpus")
        .when(best.isNull() | (best < least), F.coalesce(stand_in, F.lit("no_result")))
        .when((strong_words > 0) & (F.coalesce(strong_matches, F.lit(0)) == 0), F.coalesce(stand_in, F.lit("no_evidence")))
        .otherwise("answer")
    )
