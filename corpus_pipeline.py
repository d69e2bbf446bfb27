"""A training-data pipeline: toxicity, quality, near-duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comuna.llm import bpe, decontaminate, quality, simhash, toxicity
from comuna.llm.common import free_name, out_dir, quoted, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose toxicity score is under 0.5; learns from the labels of this stage's own input.

    Null and empty texts match nothing and stay; repeated rows and rows without doc_id are scored like others; an empty table
    stays empty; other columns pass through, whatever their names.
    """
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "toxic_score")
    return toxicity.with_score(docs, lexicon, name).where(f"{name} < 0.5").drop(name)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose quality score is 0.7 or more; keeps all where there is nothing to learn from, as in an empty table.

    Null and empty texts have the score of a text without features; repeated rows and rows without doc_id are scored like
    others; other columns pass through, whatever their names.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    name = free_name(docs.columns, "quality_score")
    return quality.with_score(docs, model, name).where(f"{name} >= 0.7").drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the row with the smallest doc_id.

    Of rows that share this doc_id the one of the least hash over all columns stays, and of rows alike in all columns one; rows
    without doc_id all stay. Null and empty texts are copies of each other. An empty table stays empty; other columns pass
    through, whatever their names. Which rows stay is decided on ids and hashes; whole rows are shuffled once.
    """
    groups = simhash.near_duplicate_groups(docs)
    name = free_name(docs.columns, "row_hash")
    marked = docs.withColumn(name, F.xxhash64(*[F.col(quoted(c)) for c in docs.columns]))
    chosen = marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(name).alias(name))
    chosen = chosen.join(groups.where("doc_id = group_id").select("doc_id"), "doc_id", "left_semi")
    one = marked.join(chosen, ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name]).drop(name)
    return one.select(*[quoted(c) for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows that hold no benchmark passage.

    Null and empty texts hold none; repeated rows and rows without doc_id are searched like others; an empty table stays empty;
    other columns pass through, whatever their names.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of every row; null and empty texts have no ids; other columns are not read."""
    return bpe.encode(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: No stage can be put as SQL that gives the same rows; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), out_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
