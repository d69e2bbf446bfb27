"""Queries of kept artifacts, seeds, embeddings, merged details of incidents and repaired texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import dashboards, pages, search, validation
from ..operators.graph import shared_folder
from ..sources import files
from .dashboards import scored
from .registry import query
from .tables import COUNTED_SQL, EVENTS_NOW, REPORTS_SQL, SCORED_SQL, confirmations, reports, table

_TAGS = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"
_SIGNS = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))
_PLAIN_SQL = f"regexp_replace(html, '{_TAGS}', ' ', 'g')"
for _sign, _letter in _SIGNS:
    _PLAIN_SQL = f"replace({_PLAIN_SQL}, '{_sign}', '{_letter}')"


@query(rf"""WITH p AS (SELECT page_id, url, html, regexp_extract_all(html, '(?i)<a[^>]+href="([^"]+)"', 1) AS l, regexp_extract_all(html, '(?i)<img[^>]+src="([^"]+)"', 1) AS i,
nullif(regexp_extract(html, '(?i)<link[^>]+rel="canonical"[^>]+href="([^"]+)"', 1), '') AS a, nullif(regexp_extract(html, '(?i)<link[^>]+href="([^"]+)"[^>]+rel="canonical"', 1), '') AS b FROM pages)
SELECT page_id, coalesce(a, b, url) AS canonical, len(list_distinct(l)) AS links, l[1] AS first_link, len(list_distinct(i)) AS images, md5(trim(regexp_replace({_PLAIN_SQL}, '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))) AS plain FROM p""")
def page_extract(spark, sf):
    found = pages.extract(table(spark, sf, "pages"))
    size = lambda c: F.size(c).cast("long").alias(c)
    return found.select("page_id", "canonical", size("links"), F.get("links", F.lit(0)).alias("first_link"), size("images"), F.md5("plain").alias("plain"))


@query("""SELECT 'page-' || page_id || '-' || left(sha256(html), 14) || '.html' AS name, sha256(html) AS digest, length(html) AS n_chars FROM pages WHERE html IS NOT NULL""")
def artifact_files(spark, sf):
    """Pages kept as artifacts in the shared folder and read back."""
    digest = F.sha2("html", 256)
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit("-"), F.left(digest, F.lit(14)), F.lit(".html"))
    folder = f"{shared_folder(spark).rstrip('/')}/artifacts-{uuid.uuid4().hex}"
    files.write_artifacts(table(spark, sf, "pages").where("html IS NOT NULL").select(name.alias("name"), digest.alias("digest"), F.col("html").alias("content")), folder)
    return files.read_artifacts(spark, folder).select("name", "digest", F.length("content").cast("long").alias("n_chars"))


_LIMITED = ", ".join(
    f"CAST(CASE WHEN v IS NULL THEN {other} ELSE least(greatest(trunc(v), {least}), {most}) END AS BIGINT) AS {name}" for name, (other, least, most) in validation.SEED_LIMITS.items()
)


@query(f"SELECT s_suppkey, {_LIMITED}, CASE WHEN s_nationkey % 3 = 0 THEN 'paused' WHEN s_nationkey % 3 = 1 THEN 'active' ELSE CASE WHEN s_nationkey % 2 = 0 THEN 'paused' ELSE 'active' END END AS status FROM (SELECT *, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END AS v FROM supplier)")
def seed_values(spark, sf):
    rows = table(spark, sf, "supplier").withColumn("given", F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal").cast("string")).otherwise("none"))
    given = F.element_at(F.array(*map(F.lit, ("paused", "active", "elsewhere"))), F.col("s_nationkey") % 3 + 1)
    status = validation.seed_status(given, F.when(F.col("s_nationkey") % 2 == 0, "paused"))
    return rows.select("s_suppkey", *[validation.seed_limit(F.col("given"), name).alias(name) for name in validation.SEED_LIMITS], status.alias("status"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 7 = 0 THEN 'municipal-barrio-required-fields' END AS error_code, CASE WHEN c_custkey % 7 > 0 THEN round(c_acctbal / 7, 6) END AS lat FROM customer""")
def place_checks(spark, sf):
    lat = F.when(F.col("c_custkey") % 7 > 0, (F.col("c_acctbal") / 7).cast("string")).otherwise("sur")
    label = F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", validation.place_error(label, lat, F.lit("-57.6")).alias("error_code"), validation.coordinate(lat).alias("lat"))


@query("""WITH s AS (SELECT s_suppkey AS seed, CASE WHEN s_suppkey % 4 > 0 THEN md5(CAST(s_nationkey AS VARCHAR)) END AS last_digest FROM supplier),
c AS (SELECT n_nationkey AS seed, md5(CAST(n_nationkey % 6 AS VARCHAR)) AS digest, n_nationkey % 5 AS pages, n_nationkey % 2 AS errors, CASE WHEN n_nationkey % 11 = 0 THEN 1 ELSE 0 END AS items FROM nation),
j AS (SELECT s.seed, coalesce(digest, last_digest) AS d, last_digest, pages, errors, items FROM s LEFT JOIN c USING (seed)),
k AS (SELECT *, CASE WHEN pages IS NULL THEN NULL WHEN pages = 0 AND errors > 0 THEN 'error' WHEN last_digest IS NULL OR last_digest <> d OR items > 0 THEN 'changed' ELSE 'unchanged' END AS status FROM j)
SELECT seed, status, d AS last_digest, pages IS NOT NULL AS checked, coalesce(status = 'changed', false) AS moved, CASE WHEN status = 'error' THEN 'timeout' END AS check_error FROM k""")
def seed_check(spark, sf):
    """Suppliers as seeds, of which those with a nation's number were crawled."""
    text_of = lambda c: F.md5(c.cast("string"))
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed"), F.when(F.col("s_suppkey") % 4 > 0, text_of(F.col("s_nationkey"))).alias("last_digest"), F.lit(None).cast("timestamp").alias("last_changed_at"))
    key = F.col("n_nationkey")
    checks = table(spark, sf, "nation").select(key.cast("long").alias("seed"), text_of(key % 6).alias("digest"), (key % 5).alias("pages"), (key % 2).alias("errors"), F.when(key % 11 == 0, 1).otherwise(0).alias("changed_items"), F.lit("timeout").alias("last_error"))
    found = pages.checked_seeds(seeds, checks, EVENTS_NOW)
    return found.select("seed", "status", "last_digest", F.col("last_checked_at").isNotNull().alias("checked"), F.col("last_changed_at").isNotNull().alias("moved"), "check_error")


@query(f"""SELECT reporter AS incident_id, report_id, confirmer, CAST(row_number() OVER (PARTITION BY reporter ORDER BY seen DESC, report_id, confirmer) AS INT) AS place
FROM (SELECT id, reporter FROM ({REPORTS_SQL})) r JOIN (SELECT DISTINCT l_orderkey AS report_id, l_suppkey AS confirmer, l_shipdate AS seen FROM lineitem) c ON c.report_id = r.id""")
def incident_details(spark, sf):
    related = reports(spark, sf).groupBy(F.col("reporter").alias("incident_id")).agg(F.collect_list("id").alias("related_ids"))
    return dashboards.merged_entries(related, confirmations(spark, sf).distinct(), "at", "confirmer").select("incident_id", "report_id", "confirmer", "place")


@query(f"""WITH r AS (SELECT *, id % 17 = 0 AS overridden FROM ({SCORED_SQL})), k AS (SELECT *, row_number() OVER (PARTITION BY reporter ORDER BY overridden DESC, priority_score DESC, confirmations DESC, id) AS place,
row_number() OVER (PARTITION BY reporter ORDER BY created_at, id) AS born, row_number() OVER (PARTITION BY reporter ORDER BY CASE WHEN status IN ('resuelto', 'descartado') THEN 1 ELSE 0 END, created_at DESC, id DESC) AS late FROM r)
SELECT reporter AS incident_id, count(*) AS reports, CAST(sum(confirmations) AS BIGINT) AS confirmations, max(id) FILTER (born = 1) AS primary_id, max(status) FILTER (late = 1) AS status,
CASE min(CASE severity WHEN 'alta' THEN 0 WHEN 'media' THEN 1 ELSE 2 END) WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'baja' END AS severity, max(kind) FILTER (place = 1) AS kind,
max(priority_band) FILTER (place = 1) AS priority_band, max(priority_score) FILTER (place = 1) AS priority_score, bool_or(overridden) AS overridden FROM k GROUP BY 1""")
def municipal_incidents(spark, sf):
    rows = scored(spark, sf).withColumn("overridden", F.col("id") % 17 == 0).withColumnRenamed("reporter", "incident_id")
    return dashboards.copied_roll_up(rows, "incident_id")


@query("SELECT source, arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1")
def first_documents(spark, sf):
    return dashboards.first_of(table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars"), "source", "doc_id")


@query("""SELECT doc_id AS chunk_id, vec_id IS NULL OR vec_id % 2 = 0 AS is_new, CASE WHEN vec_id IS NULL OR vec_id % 2 = 0 THEN CAST(length(coalesce(source, '')) + 1 + length(coalesce(text, '')) AS DOUBLE) ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first_value FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def embedding_missing(spark, sf):
    """Texts without an embedding, or with one of another model, get one; a stand-in model gives their length."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.when(F.col("vec_id") % 2 == 0, "old").otherwise("new").alias("model"))
    chunks = table(spark, sf, "documents").join(vectors, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), "text", "embedding", "model")
    found = search.embedded(chunks, lambda texts: [[float(len(t))] for t in texts], "new")
    new = F.size("embedding") == 1
    return found.select("chunk_id", new.alias("is_new"), F.round(F.get("embedding", F.lit(0)), 6).alias("first_value"))


@query("""SELECT lang, count(*) AS chunks, count(*) FILTER (lang = 'es' AND vec_id % 3 > 0) AS cleared, count(*) FILTER (vec_id IS NOT NULL AND NOT (lang = 'es' AND vec_id % 3 > 0)) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1""")
def embedding_clear(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.lit("m").alias("model"))
    town = F.when(F.col("lang") == "es", 1).otherwise(2)
    chunks = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("item_id"), town.alias("town")).join(vectors, "doc_id", "left")
    return search.cleared(chunks, 1).groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("cleared").alias("cleared"), F.count("embedding").alias("embedded"))


@query("SELECT p_partkey, 'Trámite ñandú ' || p_name AS twice_read, 'Año ' || p_name AS small_sign, 'MUÑOZ ' || p_name AS large_sign FROM part")
def mojibake(spark, sf):
    damaged = F.decode(F.encode(F.concat(F.lit("Trámite ñandú "), "p_name"), "UTF-8"), "ISO-8859-1")
    lost = lambda word: F.concat(F.lit(word + " "), "p_name")
    return table(spark, sf, "part").select("p_partkey", text.repair_mojibake(damaged).alias("twice_read"), text.repair_mojibake(lost("A�o")).alias("small_sign"), text.repair_mojibake(lost("MU�OZ")).alias("large_sign"))
