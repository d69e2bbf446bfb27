"""Search over chunks and procedures: fuzzy word scores, hybrid ranking, evidence, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spanish
from ..functions.text import normalize
from . import graph, scoring
from .vectors import cosine

#: Rows of a query set's words that are broadcast at most.
BROADCAST_WORDS = 200_000


def exact_score(token: Column) -> Column:
    """What a whole-word match of a token is worth."""
    return F.when(F.length(token) >= 8, 10).when(F.length(token) >= 5, 8).otherwise(5)


def part(text: Column, boost: int) -> Column:
    """A text as ``scoring.scored`` takes it."""
    return F.struct(normalize(text).alias("plain"), F.lit(boost).alias("boost"))


def text_scores(queries: DataFrame, chunks: DataFrame, boost: int, k: int | None = None) -> DataFrame:
    """``query_id``, ``chunk_id``, ``score``, ``matched``, ``strong`` of texts in which some word of the query counts, or the whole query with ``boost``.

    Both sides have an id and ``text``. ``matched`` counts the query's words that count, ``strong`` those of five letters. With ``k`` only
    the best of each task come back: apply ``top``.
    """
    return scoring.scored(queries, scoring.spread(chunks, "chunk_id").select("chunk_id", F.array(part(F.col("text"), boost)).alias("parts"), F.lit(0).alias("extra")), k)


def _extra() -> Column:
    return F.when(F.col("official"), 2).otherwise(0) + F.when(F.col("section") == "fuente", 1).otherwise(0) + F.when(F.col("procedure_id").isNotNull(), 1).otherwise(0) + spanish.section_boost(F.col("section"))


def chunk_scores(queries: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """Lexical score of chunks (``chunk_id``, ``title``, ``text``, ``section``, ``procedure_id``, ``official``) that share something with a query.

    Title and text count together; 2 for an official source, 1 for the section fuente, 1 for a procedure, and the section's worth.
    """
    extra = _extra()
    rows = scoring.spread(chunks, "chunk_id").select("chunk_id", F.array(part(F.concat_ws(" ", "title", "text"), 8)).alias("parts"), extra.alias("extra"), "section", "procedure_id")
    return scoring.scored(queries, rows, k, carry=("section", "procedure_id"))


def top(scores: DataFrame, k: int, score: str = "score", item: str = "chunk_id") -> DataFrame:
    """The ``k`` best above zero of each query with their ``place``; ties go to the smaller id. Tasks pre-select before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), item))
    return scores.where(F.col(score) > 0).withColumn("place", place).where(F.col("place") <= k)


def procedure_scores(queries: DataFrame, procedures: DataFrame, evidence: DataFrame, k: int | None = None) -> DataFrame:
    """``query_id``, ``procedure_id``, ``lexical``, ``chunk_score``, ``score`` of procedures above zero.

    ``procedures`` has ``procedure_id``, ``title``, ``description``, ``sections`` (array of texts); ``evidence`` is what was retrieved for each
    query (``query_id``, ``procedure_id``, ``score``). A query in the title is worth 14 more, in the description 10, in a section 6; the
    best retrieved chunk of a procedure adds its score. With ``k`` only what can be among the ``k`` best comes back.
    """
    best = evidence.where("procedure_id IS NOT NULL").groupBy("query_id", "procedure_id").agg(F.greatest(F.max("score"), F.lit(0)).alias("chunk_score"))
    asked = best.groupBy("procedure_id").agg(F.collect_list("query_id").alias("asked"))  # of the retrieved few
    parts = F.concat(F.array(part(F.col("title"), 14), part(F.col("description"), 10)), F.transform("sections", lambda t: part(t, 6)))
    rows = scoring.spread(procedures, "procedure_id").select("procedure_id", parts.alias("parts"), F.lit(0).alias("extra")).join(asked, "procedure_id", "left")
    lexical = scoring.scored(queries, rows, k, key="procedure_id").select("query_id", "procedure_id", F.col("score").alias("lexical"))
    both = lexical.join(best, ["query_id", "procedure_id"], "left").fillna(0, ["chunk_score"])
    return both.withColumn("score", F.col("lexical") + F.col("chunk_score")).where("score > 0")


def retrieved(queries: DataFrame, chunks: DataFrame, procedures: DataFrame, matched: DataFrame, near: DataFrame, asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` best chunks of each query by ``total``, with ``section``, ``procedure_id``, ``matched``, ``strong``, ``place``.

    Candidates are the full-text matches (``matched``: ``rank``) and the nearest vectors (``near``: ``similarity``) of a query; a query without
    any takes all chunks that share a word. Lexical score, 20 times the similarity of the vectors (``asked``: ``query_id``, ``q``;
    ``vectors``: ``chunk_id``, ``embedding``), the better of 18 times the rank and 16 times the similarity as candidate, and 1 for a chunk
    of one of ``procedures`` add up. Only the candidates of the stated queries are joined with vectors.
    """
    zero = F.lit(0.0)
    either = matched.select("query_id", "chunk_id", (F.col("rank") * 18).alias("hybrid")).unionByName(near.select("query_id", "chunk_id", F.greatest(F.col("similarity") * 16, zero).alias("hybrid")))
    hybrid = graph.cut(either.groupBy("query_id", "chunk_id").agg(F.max("hybrid").alias("hybrid")))
    wanted = hybrid.groupBy("chunk_id").agg(F.collect_list("query_id").alias("asked"))  # of the stated queries
    known = chunks.join(procedures.select("procedure_id").distinct().withColumn("known", F.lit(True)), "procedure_id", "left").join(wanted, "chunk_id", "left")
    rows = known.select("chunk_id", F.array(part(F.concat_ws(" ", "title", "text"), 8)).alias("parts"), (_extra() + F.when(F.col("known"), 1).otherwise(0)).alias("extra"), "section", "procedure_id", "asked")
    scores = graph.cut(scoring.scored(queries, rows, k, carry=("section", "procedure_id")))
    limited = hybrid.select("query_id").distinct().withColumn("limited", F.lit(True))
    pairs = scores.join(limited, "query_id", "left").join(hybrid, ["query_id", "chunk_id"], "left").where("limited IS NULL OR hybrid IS NOT NULL")
    pairs = pairs.join(asked, "query_id", "left").join(vectors.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi"), "chunk_id", "left")
    near_ = F.when(F.col("q").isNotNull() & F.col("embedding").isNotNull(), cosine(F.col("q"), F.col("embedding")) * 20)
    total = F.round(F.col("score") + F.coalesce(near_, zero) + F.coalesce("hybrid", zero), 4)
    return top(pairs.withColumn("total", total).drop("score", "hybrid", "limited", "q", "embedding"), k, "total")


def search(procedures: DataFrame, queries: DataFrame, evidence: DataFrame, limit: int = 6) -> DataFrame:
    """``query_id``, ``procedure_id``, ``score``, ``place``, ``total`` of the results of each query.

    A query without words gets the first ``limit`` procedures by ``procedure_id`` with score 1, and the number of all as ``total``; any
    other the best ranked, and their number.
    """
    ranked = top(procedure_scores(queries, procedures, evidence, limit), limit, item="procedure_id").select("query_id", "procedure_id", F.col("score").cast("double").alias("score"), "place")
    ranked = ranked.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    first = [r["procedure_id"] for r in procedures.select("procedure_id").orderBy("procedure_id").limit(limit).collect()]
    empty = queries.where(F.size(spanish.query_tokens(F.col("text"))) == 0).select("query_id", F.posexplode(F.array(*map(F.lit, first)) if first else F.array().cast("array<bigint>")).alias("at", "procedure_id"))
    shown = empty.select("query_id", "procedure_id", F.lit(1.0).alias("score"), (F.col("at") + 1).alias("place"), F.lit(procedures.count()).alias("total"))
    return ranked.unionByName(shown)


def facets(procedures: DataFrame, category: str = "all", kind: str = "all", section: str = "all", official_host: str | None = None) -> DataFrame:
    """Procedures (``category``, ``kind``, ``sections`` map, ``url``) that meet the chosen facets; the section descripcion never excludes."""
    kept = procedures
    if category != "all":
        kept = kept.where(F.col("category") == category)
    if kind != "all":
        kept = kept.where(F.col("kind") == kind)
    if section not in ("all", "descripcion"):
        kept = kept.where(F.coalesce(F.map_contains_key("sections", section), F.lit(False)))
    return kept.where(F.coalesce(F.col("url").contains(official_host), F.lit(False))) if official_host else kept


def suggested_section(order: Column, sections: Column) -> Column:
    """The first section in a procedure's order that it has; descripcion always counts."""
    return F.try_element_at(F.filter(order, lambda k: (k == "descripcion") | F.coalesce(F.map_contains_key(sections, k), F.lit(False))), F.lit(1))


def items_of(value: Column) -> Column:
    """A JSON list as an array of strings, anything else as an array of one, nothing as an empty array."""
    listed = F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>"))
    return F.when(value.isNull() | (value == ""), F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(value)))


def scoped(chunks: DataFrame, town: int | None, strict: bool = True) -> DataFrame:
    """The chunks of a town (``municipality_id``); of all towns without one, or where it has none and the scope is not strict."""
    if town is None:
        return chunks
    own = chunks.where(F.col("municipality_id") == town)
    return own if strict or not own.isEmpty() else chunks


def sorted_evidence(evidence: DataFrame, top_procedure: DataFrame, n: int = 4) -> DataFrame:
    """``place`` of the ``n`` best chunks of each query: 12 for the top procedure's chunks, and the section's worth once more."""
    rows = evidence.join(top_procedure.select("query_id", F.col("procedure_id").alias("best")), "query_id", "left")
    worth = F.col("score") + F.when(F.col("procedure_id") == F.col("best"), 12).otherwise(0) + spanish.section_boost(F.col("section"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("worth"), "chunk_id"))
    return rows.withColumn("worth", worth).withColumn("place", place).where(F.col("place") <= n).drop("best")


def evaluation(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id``, ``passed``: some expected word (array ``expected``) occurs in a text among the query's results, or, where
    ``no_grounding`` is asked for, there are no results."""
    words = expected.select("query_id", "no_grounding", F.transform("expected", normalize).alias("expected"))
    met = words.join(results.select("query_id", normalize(F.col("text")).alias("plain")), "query_id", "left")
    hit = F.coalesce(F.exists("expected", lambda w: F.col("plain").contains(w)), F.lit(False))
    found = met.groupBy("query_id").agg(F.bool_or("no_grounding").alias("none"), F.bool_or(hit).alias("hit"), F.count("plain").alias("n"))
    return found.select("query_id", F.when(F.col("none"), F.col("n") == 0).otherwise(F.col("hit")).alias("passed"))


def coverage(chunks: DataFrame, by: str) -> DataFrame:
    """Chunks, sources, chunks with and without an embedding."""
    has = F.coalesce(F.size("embedding") > 0, F.lit(False))
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("sources"), F.count_if(has).alias("embedded"), F.count_if(~has).alias("missing"))


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, only_missing: bool = True, size: int = 40) -> DataFrame:
    """``chunks`` (``chunk_id``, ``title``, ``text``, ``embedding``, ``model``) with embeddings of title and text by ``embed``, ``size`` texts a call.

    With ``only_missing`` rows that have an embedding of this model stay as they are and are not sent to Python. Null titles and
    texts are empty.
    """
    wanted = F.lit(True) if not only_missing else F.col("embedding").isNull() | ~F.col("model").eqNullSafe(F.lit(model))
    rows = chunks.select("chunk_id", "title", "text", F.col("embedding").cast("array<double>").alias("embedding"), "model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.slice(start, size)
                vectors = embed([f"{a or ''}\n{b or ''}" for a, b in zip(part.column("title").to_pylist(), part.column("text").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*part.schema.names, "embedding"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    new = rows.where(wanted).drop("embedding", "model").mapInArrow(run, f"chunk_id {kinds['chunk_id']}, title {kinds['title']}, text {kinds['text']}, embedding array<double>")
    return rows.where(~wanted).unionByName(new.withColumn("model", F.lit(model)))


def cleared(chunks: DataFrame, town: int | None = None, connected_only: bool = True) -> DataFrame:
    """``chunks`` (``embedding``, ``model``, ``item_id``, ``town``) with the embeddings of a town (None: all) taken out; ``cleared`` says where.

    ``connected_only`` spares chunks that come from no crawled item.
    """
    hit = F.col("embedding").isNotNull()
    if connected_only:
        hit = hit & F.col("item_id").isNotNull()
    if town is not None:
        hit = hit & F.coalesce(F.col("town") == town, F.lit(False))
    rows = chunks.withColumn("cleared", hit)
    return rows.withColumns({c: F.when(~F.col("cleared"), F.col(c)) for c in ("embedding", "model")})


def evaluation_total(results: DataFrame) -> DataFrame:
    """One row: ``passed``, ``total``, and ``ok`` where all passed."""
    return results.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total")).withColumn("ok", F.col("passed") == F.col("total")).select("ok", "passed", "total")
