"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, decontaminate, filter_audit, mixing, order_minhash, quality, token_counts, token_files, toxicity, warc
from .common import table
from .learning import remainder
from .simhash import simhash_components


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_probe(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1)
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = chat.format_chats(rows.unionByName(probe))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = chat.loss_text(F.col("formatted"), F.col("loss"))
    return chats.withColumn("_lost", lost).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_lost").cast("long").alias("loss_chars"),
        F.sha2("_lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.learn(docs, labels))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.score(docs, quality.learn(docs, labels))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shown = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe.encode_and_decode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with three edits: a twentieth deleted at a quarter, its beginning copied to the middle, a phrase set in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = F.length("text")
    edit = lambda start, length, text: F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), text.alias("text"))
    edits = F.array(edit(F.floor(n / 4), F.floor(n / 20), F.lit("")), edit(F.floor(n / 2), F.lit(0), F.left("text", F.lit(40))), edit(F.floor(3 * n / 4), F.lit(12), F.lit(" it's 2024 now,  ")))
    return token_counts.count_edits(docs.withColumn("edits", edits))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_order_minhash, op2_decontaminate, op3_chat_format, op4_toxicity, op5_token_files, op6_quality, op7_byte_bpe, op8_token_counts, op9_warc, op10_simhash, op11_mixing, op12_filter_audit, op13_clustering)
}

_PAYLOADS = """
SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
"""


def _rounds(rounds: int) -> str:
    """The rounds of op13 one after the other: a<i> are the assignments, c<i> the centroids."""
    nearest = "SELECT vec_id, x, arg_min(struct_pack(i := i, d := d), (d, i)) AS best FROM (SELECT vec_id, x, i, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM v, c{r}) GROUP BY 1, 2"
    step = """m{r} AS (SELECT i, list(CAST(m AS DOUBLE) ORDER BY p) AS c FROM (SELECT i, p, floor(sum(e) / count(*)) AS m FROM (SELECT best.i AS i, unnest(x) AS e, generate_subscripts(x, 1) AS p FROM a{r}) GROUP BY 1, 2) GROUP BY 1),
c{n} AS (SELECT i, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (i))"""
    parts = [f"a{r} AS MATERIALIZED ({nearest.format(r=r)})" + (",\n" + step.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1)]
    return ",\n".join(parts)


#: The others cannot be put as SQL that would finish on whole tables; tests compare each with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*(?:/?INST\]|/?ROLE\]|SEP\]|/?s>|</?SYS>>))', '\1\\\2', 'g')) AS n_escaped,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 23 + length(role) END AS frame
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_escaped + frame) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_warc": f"""
WITH p AS ({_PAYLOADS}), g AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest
""",
    "op11_mixing": f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents
), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY 1),
s1 AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(2 * source_size) OVER w, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
  FROM s0 WINDOW w AS (ORDER BY 2.0 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s2 AS (SELECT *, (150 * total - 100 * held) * weight > 100 * open * 2 * source_size AS "full" FROM s1),
r AS (SELECT CAST(any_value(150 * total) - coalesce(sum(200 * source_size) FILTER ("full"), 0) AS BIGINT) AS rest, CAST(sum(weight) FILTER (NOT "full") AS BIGINT) AS shares, CAST(greatest(1, 150 * any_value(total) // (100 * {mixing.BLOCKS})) AS BIGINT) AS b FROM s2),
s3 AS (SELECT source, source_size, rank, "full", b, (rest + 50 * b) // (100 * b) AS n, CASE WHEN "full" THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(100 * shares AS DOUBLE) END AS target FROM s2, r),
q AS (SELECT source, count(*) AS blocks FROM (SELECT source, n, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank) AS p FROM (SELECT *, unnest(range(1, 2 * source_size // b + 2)) AS k FROM s3 WHERE NOT "full")) WHERE p <= n GROUP BY 1),
s4 AS (SELECT s3.source, source_size, target, b, coalesce(blocks, 0) AS blocks, "full" OR coalesce(blocks, 0) * b >= 2 * source_size AS "full" FROM s3 LEFT JOIN q ON q.source IS NOT DISTINCT FROM s3.source),
x AS (SELECT d.*, s4.* EXCLUDE (source), CAST('0x' || left(h, 8) AS BIGINT) % least({mixing.SHARDS}, greatest(1, CAST(ceil(blocks / {mixing.SHARD_BLOCKS}) AS BIGINT))) AS shard FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
c AS (SELECT source, shard, blocks, b, CAST(sum(size) AS BIGINT) AS words FROM x WHERE NOT "full" AND size > 0 AND blocks > 0 GROUP BY 1, 2, 3, 4),
t AS (SELECT source, shard, words, count(*) FILTER (p <= blocks) * any_value(b) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY words / (2 * k - 1) DESC, shard) AS p FROM (SELECT *, unnest(range(1, (2 * words + b - 1) // b + 1)) AS k FROM c)) GROUP BY 1, 2, 3),
y AS (SELECT x.*, words, least(quota, 2 * words) AS due, sum(size) OVER (PARTITION BY x.source, x.shard ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM x JOIN t ON t.source IS NOT DISTINCT FROM x.source AND t.shard = x.shard WHERE NOT "full" AND size > 0 AND blocks > 0)
SELECT doc_id, size, source_size, target, CAST(due // words * size + greatest(0, least(upto, due % words) - (upto - size)) AS BIGINT) AS taken FROM y
UNION ALL SELECT doc_id, size, source_size, target, CASE WHEN "full" THEN 2 * size ELSE 0 END FROM x WHERE "full" OR size = 0 OR blocks = 0
""",
    "op13_clustering": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INT) AS i, x AS c FROM v QUALIFY i < 40),
{_rounds(5)}
SELECT vec_id, best.i AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.i) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.i = best.i
""",
    "op12_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)
), c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS k, left(filter_order, step - 1) AS done FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
m AS (SELECT *, contains(fails, k) AS bad, length(translate(done, fails, '')) < length(done) AS gone FROM c, s),
t AS (
  SELECT part, filter_order, step, k, sum(n) FILTER (NOT gone AND NOT bad) AS kept, sum(n) FILTER (NOT gone AND bad) AS removed, sum(n) FILTER (gone AND bad) AS redundant,
    sum(n) FILTER (fails = k) AS unique_fails, sum(n) FILTER (NOT gone AND bad AND good) AS good_lost, sum(n) FILTER (NOT gone AND bad AND toxic) AS toxic_lost FROM m GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM t
""",
}
