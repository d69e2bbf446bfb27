"""Queries of work lists, dashboards, filters and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import activity, dashboards, incidents
from .registry import query
from .tables import COUNTED_SQL, EVENTS_NOW, NOW, REPORTS_SQL, SCORED_SQL, confirmations, reports, table

_AGE = "least(floor(greatest(0, (epoch_us(TIMESTAMP '1999-01-01') - epoch_us({at})) / 86400000000.0) * 2 + 0.5), 18)"
_SCORE = ("CAST(least(greatest(CASE severity WHEN 'alta' THEN 34 WHEN 'media' THEN 22 ELSE 12 END + CASE kind WHEN 'bache_aislado' THEN 6 WHEN 'conjunto_de_baches' THEN 12 ELSE 18 END"
          " + least({conf} * 8, 24) + least(({n} - 1) * 7, 18) + {age}, 0), 100) AS BIGINT)")  # fmt: skip
_LEVELS_SQL = f"""SELECT *, CASE WHEN impact_score >= 70 THEN 'alta' WHEN impact_score >= 40 THEN 'media' ELSE 'baja' END AS impact_level,
CASE WHEN risk_score >= 70 THEN 'alta' WHEN risk_score >= 40 THEN 'media' ELSE 'baja' END AS risk_level FROM (
SELECT *, CAST(least(14 + confirmations * 18, 100) AS BIGINT) AS impact_score,
CAST(least(CASE severity WHEN 'alta' THEN 58 WHEN 'media' THEN 36 ELSE 18 END + CASE kind WHEN 'bache_aislado' THEN 10 WHEN 'conjunto_de_baches' THEN 18 ELSE 28 END, 100) AS BIGINT) AS risk_score FROM ({SCORED_SQL}))"""


def scored(spark, sf):
    rows = incidents.with_counts(reports(spark, sf), confirmations(spark, sf))
    rows = rows.withColumn("priority_score", incidents.priority_score(F.col("severity"), F.col("kind"), F.lit(1), F.col("confirmations"), F.col("created_at"), NOW))
    return rows.withColumn("priority_band", incidents.priority_band(F.col("priority_score")))


def levelled(spark, sf):
    rows = scored(spark, sf).withColumn("impact_score", incidents.impact_score(F.lit(1), F.col("confirmations"))).withColumn("risk_score", incidents.risk_score(F.col("severity"), F.col("kind")))
    return rows.withColumn("impact_level", incidents.level(F.col("impact_score"))).withColumn("risk_level", incidents.level(F.col("risk_score")))


@query(f"""WITH g AS (SELECT reporter AS incident_id, count(*) AS reports, CAST(sum(confirmations) AS BIGINT) AS confirmations, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon,
arg_min(id, (created_at, id)) AS primary_id, min(created_at) AS first_at, arg_max(status, (CASE WHEN status IN ('resuelto', 'descartado') THEN 0 ELSE 1 END, created_at, id)) AS status,
min(CASE severity WHEN 'alta' THEN 0 WHEN 'media' THEN 1 ELSE 2 END) AS r, count(*) FILTER (kind = 'bache_aislado') AS a, count(*) FILTER (kind = 'conjunto_de_baches') AS b, count(*) FILTER (kind = 'hundimiento_o_rotura_grande') AS c
FROM ({COUNTED_SQL}) GROUP BY 1), k AS (SELECT *, CASE WHEN a >= b AND a >= c THEN 'bache_aislado' WHEN b >= c THEN 'conjunto_de_baches' ELSE 'hundimiento_o_rotura_grande' END AS kind,
CASE r WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'baja' END AS severity FROM g), s AS (SELECT *, {_SCORE.format(conf='confirmations', n='reports', age=_AGE.format(at='first_at'))} AS priority_score FROM k)
SELECT incident_id, reports, confirmations, lat, lon, primary_id, status, kind, severity, priority_score, CASE WHEN priority_score >= 75 THEN 'alta' WHEN priority_score >= 45 THEN 'media' ELSE 'baja' END AS priority_band FROM s""")
def incident_rollup(spark, sf):
    rows = incidents.with_counts(reports(spark, sf), confirmations(spark, sf)).withColumnRenamed("reporter", "incident_id")
    return dashboards.roll_up(rows, "incident_id", NOW).drop("first_at")


_OPEN_FIRST = "CASE WHEN status IN ('resuelto', 'descartado') THEN 1 ELSE 0 END"
_RANK = "CASE {} WHEN 'alta' THEN 0 WHEN 'media' THEN 1 ELSE 2 END"
_FALL = ", ".join(_RANK.format(c) for c in ("priority_band", "impact_level", "risk_level")) + ", confirmations DESC, created_at DESC, id"
_QUEUES = {"priority": ("priority_band", "priority_score"), "impact": ("impact_level", "impact_score"), "risk": ("risk_level", "risk_score")}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS mode, id, status, priority_score, impact_score, risk_score FROM ({_LEVELS_SQL}) ORDER BY {_OPEN_FIRST}, {_RANK.format(a)}, {b} DESC, {_FALL} LIMIT 20)" for m, (a, b) in _QUEUES.items()))
def queue_sort(spark, sf):
    rows = levelled(spark, sf)
    lists = [incidents.top(rows, *dashboards.queue_order(m), n=20).select(F.lit(m).alias("mode"), "id", "status", "priority_score", "impact_score", "risk_score") for m in _QUEUES]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


_ORDERS = {"score_desc": "priority_score DESC", "score_asc": "priority_score", "date_desc": "created_at DESC", "date_asc": "created_at"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS mode, id, priority_score FROM ({SCORED_SQL}) ORDER BY {o}, id LIMIT 25)" for m, o in _ORDERS.items()))
def report_sorts(spark, sf):
    rows, out = scored(spark, sf), None
    for mode, keys in dashboards.REPORT_ORDERS.items():
        part = incidents.top(rows, *keys(), n=25).select(F.lit(mode).alias("mode"), "id", "priority_score")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""SELECT * FROM (SELECT 'priority' AS list, id FROM ({SCORED_SQL}) WHERE status NOT IN ('resuelto', 'descartado') ORDER BY priority_score DESC, {_RANK.format('priority_band')}, created_at DESC, id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'recent' AS list, id FROM ({SCORED_SQL}) ORDER BY created_at DESC, {_RANK.format('priority_band')}, id LIMIT 8)""")
def dashboard_lists(spark, sf):
    rows = scored(spark, sf)
    best = incidents.top(rows.where(~F.col("status").isin(*incidents.CLOSED)), F.desc("priority_score"), *dashboards.band_order())
    band, newest, by_id = dashboards.band_order()
    return best.select(F.lit("priority").alias("list"), "id").unionByName(incidents.top(rows, newest, band, by_id).select(F.lit("recent").alias("list"), "id"))


@query(f"""SELECT id, priority_band, total, CAST(greatest(1, ceil(total / 50.0)) AS BIGINT) AS pages FROM (SELECT *, count(*) OVER () AS total FROM ({SCORED_SQL})) ORDER BY {_RANK.format('priority_band')}, created_at DESC, id LIMIT 50 OFFSET 50""")
def ranked_page(spark, sf):
    return dashboards.page(scored(spark, sf).select("id", "priority_band", "created_at"), dashboards.band_order(), 2, 400).select("id", "priority_band", "total", "pages")


@query("""WITH h AS (SELECT l_orderkey AS report_id, l_shipdate AS "at", l_returnflag AS status FROM lineitem), l AS (SELECT *, lag(status) OVER (PARTITION BY report_id ORDER BY "at", status) AS before FROM h)
SELECT report_id, "at", status, before FROM l WHERE status IS DISTINCT FROM before""")
def change_feed(spark, sf):
    history = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_shipdate").alias("at"), F.col("l_returnflag").alias("status"))
    return dashboards.status_changes(history, "report_id", "at", "status").select("report_id", "at", "status", "before")


@query(f"""SELECT id, n AS confirmers, {_SCORE.format(conf='n', n='1', age=_AGE.format(at='created_at'))} AS priority_score FROM (
SELECT r.*, coalesce(c, 0) AS n FROM ({REPORTS_SQL}) r LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY 1) ON l_orderkey = id)""")
def confirmation_recompute(spark, sf):
    return dashboards.confirmed(reports(spark, sf), confirmations(spark, sf), NOW).select("id", "confirmers", "priority_score")


@query("""WITH u AS (SELECT c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN ['admin'] WHEN 1 THEN ['municipal'] WHEN 2 THEN ['recolector', 'municipal'] WHEN 3 THEN ['vecino'] ELSE [] END AS base,
CASE WHEN c_mktsegment = 'BUILDING' THEN ['recolector'] ELSE [] END AS extra FROM customer), r AS (SELECT user_id, list_concat(base, list_filter(extra, lambda x: NOT list_contains(base, x))) AS roles FROM u)
SELECT user_id, array_to_string(roles, ',') AS roles, CASE WHEN list_contains(roles, 'admin') THEN NULL WHEN list_contains(roles, 'municipal') THEN 20 WHEN list_contains(roles, 'recolector') THEN 10 ELSE 3 END AS daily_limit FROM r""")
def role_limits(spark, sf):
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    k = F.col("c_custkey") % 5
    base = F.when(k == 0, strings("admin")).when(k == 1, strings("municipal")).when(k == 2, strings("recolector", "municipal")).when(k == 3, strings("vecino"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), dashboards.effective_roles(base, F.when(F.col("c_mktsegment") == "BUILDING", strings("recolector"))).alias("roles"))
    return rows.select("user_id", F.array_join("roles", ",").alias("roles"), dashboards.role_limit(F.col("roles")).alias("daily_limit"))


@query("""SELECT c_custkey, c_name, c_mktsegment, c_custkey = 7 AS selected FROM customer WHERE (c_name ILIKE '%00007%' OR c_mktsegment ILIKE '%mach%') ORDER BY c_custkey = 7 DESC, c_name, c_custkey LIMIT 10""")
def catalog_search(spark, sf):
    found = dashboards.search_any(table(spark, sf, "customer").withColumn("selected", F.col("c_custkey") == 7), " 00007 ", "c_name")
    found = found.unionByName(dashboards.without_rows(dashboards.search_any(table(spark, sf, "customer").withColumn("selected", F.col("c_custkey") == 7), "MACH", "c_mktsegment"), found, "c_custkey"))
    return dashboards.preview(found, F.col("selected"), "c_name", "c_custkey").select("c_custkey", "c_name", "c_mktsegment", "selected")


@query("""SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE nullif(trim(coalesce(event_type, '')), '') IS NOT NULL AND NOT (event_type = 'click' AND coalesce(CAST(json_extract_string(props, '$.k') AS INT), 200) >= 50)""")
def json_field_filter(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf, "events").where(dashboards.has_text("event_type") & ~((F.col("event_type") == "click") & (F.coalesce(k, F.lit(200)) >= 50)))
    return rows.select("event_id", "event_type", k.alias("k"))


@query("""WITH s AS (SELECT user_id, list(DISTINCT CAST(json_extract_string(props, '$.k') AS INT)) AS ids FROM events GROUP BY 1)
SELECT user_id, len(ids) - 1 AS n_left, list_aggregate(list_transform(list_filter(ids, lambda x: x <> 7), lambda x: CAST(x AS BIGINT)), 'sum')::BIGINT AS sum_left FROM s WHERE list_contains(ids, 7)""")
def json_array_remove(spark, sf):
    """Users whose id list (kept as JSON) holds 7, and the list without it."""
    lists = table(spark, sf, "events").groupBy("user_id").agg(F.to_json(F.collect_set(F.get_json_object("props", "$.k").cast("int"))).alias("ids"))
    parsed = lists.withColumn("ids", F.from_json("ids", "array<int>")).where(F.array_contains("ids", 7))
    left = F.array_remove("ids", 7)
    return parsed.select("user_id", F.size(left).cast("bigint").alias("n_left"), F.aggregate(left, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_left"))


@query("""SELECT event_id, event_type FROM events WHERE (event_type = 'click' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 0)) OR (event_type IN ('view', 'purchase') AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id))""")
def exists_by_type(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    rich = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    trucks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"))
    first = events.where("event_type = 'click'").join(rich, "user_id", "left_semi")
    return first.unionByName(events.where(F.col("event_type").isin("view", "purchase")).join(trucks, "user_id", "left_semi")).select("event_id", "event_type")


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality IS DISTINCT FROM toxic")
def distinct_from(spark, sf):
    return table(spark, sf, "labels").where(~F.col("quality").eqNullSafe(F.col("toxic"))).select("doc_id", "quality", "toxic")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, n_name) AS label, n_name IS NOT NULL AS has_town FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3""")
def update_from_join(spark, sf):
    towns = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf, "customer").join(towns, "c_nationkey", "left")
    return rows.select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_name")), "n_name").alias("label"), F.col("n_name").isNotNull().alias("has_town"))


@query("""SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1""")
def published_items(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").where("quality = 1").select("doc_id", "quality"), "doc_id")


@query("""SELECT CAST(min(o_orderdate) AS DATE)::VARCHAR AS first_day, CAST(max(o_orderdate) AS DATE)::VARCHAR AS last_day, strftime(min(o_orderdate), '%Y%m%d') AS first_key, strftime(max(o_orderdate), '%Y%m%d') AS last_key FROM orders""")
def calendar_bounds(spark, sf):
    found = table(spark, sf, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return found.select(F.to_date("a").cast("string").alias("first_day"), F.to_date("b").cast("string").alias("last_day"), F.date_format("a", "yyyyMMdd").alias("first_key"), F.date_format("b", "yyyyMMdd").alias("last_key"))


@query("""SELECT l_suppkey AS route_id, string_agg(CAST(l_orderkey AS VARCHAR), '>' ORDER BY l_orderkey) AS stops, count(*) AS n, CAST(max(q) AS BIGINT) AS longest FROM (SELECT l_suppkey, l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def nested_stops(spark, sf):
    """Every route's stops in order, as one array, and the largest load."""
    stops = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_quantity").alias("q"))
    lists = stops.groupBy(F.col("l_suppkey").alias("route_id")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "q"))).alias("stops"), F.max("q").cast("bigint").alias("longest"))
    return lists.select("route_id", F.array_join(F.transform("stops", lambda s: s["l_orderkey"].cast("string")), ">").alias("stops"), F.size("stops").cast("bigint").alias("n"), "longest")


@query("""WITH s AS (SELECT n_nationkey, count(s_suppkey) AS seeds, count(*) FILTER (s_acctbal > 0) AS geo FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (seeds > 0) AS with_seeds, count(*) FILTER (geo > 0) AS with_geo, count(*) FILTER (seeds = 0) AS without_seeds FROM s""")
def municipality_stats(spark, sf):
    seeds = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("seeds"), F.count_if(F.col("s_acctbal") > 0).alias("geo"))
    towns = table(spark, sf, "nation").join(seeds, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return towns.agg(F.count(F.lit(1)).alias("total"), F.count_if(some("seeds")).alias("with_seeds"), F.count_if(some("geo")).alias("with_geo"), F.count_if(~some("seeds")).alias("without_seeds"))


@query("""SELECT source, sha256(string_agg(h, '|' ORDER BY h)) AS digest FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY 1""")
def digest_rollup(spark, sf):
    return dashboards.by_text_hash(table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("h")), "source", "h")


@query(r"""SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, count(*) AS pages, count(*) FILTER (regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '\.pdf$')) AS pdfs,
count(*) FILTER (contains(url, '?')) AS with_query, count(*) FILTER (octet_length(encode(coalesce(html, ''))) > 2000) AS too_large, CAST(sum(octet_length(encode(coalesce(html, '')))) AS BIGINT) AS bytes FROM pages GROUP BY 1""")
def crawl_counters(spark, sf):
    size = F.octet_length(F.coalesce("html", F.lit("")))
    return table(spark, sf, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(urls.kind(F.col("url")) == "pdf").alias("pdfs"), F.count_if(F.col("url").contains("?")).alias("with_query"),
        F.count_if(size > 2000).alias("too_large"), F.sum(size).alias("bytes"),
    )


@query("""SELECT 'user' AS scope, event_type AS name, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 2 UNION ALL SELECT 'all', 'events', count(*) FROM events UNION ALL SELECT 'all', 'documents', count(*) FROM documents UNION ALL SELECT 'all', 'labelled', count(DISTINCT doc_id) FROM labels""")
def runtime_counters(spark, sf):
    count = lambda df, name, n: df.agg(n.alias("n")).select(F.lit("all").alias("scope"), F.lit(name).alias("name"), "n")
    events = table(spark, sf, "events")
    kinds = events.where(F.col("event_type").isin("click", "view")).groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("user").alias("scope"), "name", "n")
    every = [count(events, "events", F.count(F.lit(1))), count(table(spark, sf, "documents"), "documents", F.count(F.lit(1))), count(table(spark, sf, "labels"), "labelled", F.count_distinct("doc_id"))]
    return kinds.unionByName(every[0]).unionByName(every[1]).unionByName(every[2])


@query("""SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-25' - INTERVAL 10 DAY AND TIMESTAMP '2024-01-25' + INTERVAL 2 DAY""")
def retention_window(spark, sf):
    return dashboards.kept_since(table(spark, sf, "events"), "ts", EVENTS_NOW, 10, 2).select("event_id", "user_id")


#: Names as towns have them: accents and small letters sort with their plain letters, ñ behind n.
_TOWN_NAME = "CASE n_nationkey % 5 WHEN 0 THEN 'Ñ' || lower(n_name) WHEN 1 THEN 'Á' || lower(n_name) WHEN 2 THEN 'n' || lower(n_name) WHEN 3 THEN 'Az' || lower(n_name) ELSE 'O' || lower(n_name) END"
_LETTER = "CASE lower(left(name, 1)) WHEN 'ñ' THEN 'n~' WHEN 'á' THEN 'a' ELSE lower(left(name, 1)) END || substr(name, 2)"


@query(f"SELECT n_nationkey, name, row_number() OVER (ORDER BY {_LETTER}, n_nationkey) AS place FROM (SELECT n_nationkey, {_TOWN_NAME} AS name FROM nation)")
def locale_sort(spark, sf):
    """Places of the towns in the Spanish alphabet; a list of towns is one small partition."""
    from pyspark.sql import Window

    towns = table(spark, sf, "nation").select("n_nationkey", F.expr(_TOWN_NAME).alias("name"))
    order = Window.partitionBy(F.lit(0)).orderBy(dashboards.by_locale("name"), "n_nationkey")
    return towns.select("n_nationkey", "name", F.row_number().over(order).alias("place"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7""")
def point_lookup(spark, sf):
    return spark.sql("SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} WHERE o_orderkey = :key LIMIT 1", args={"key": 7}, orders=table(spark, sf, "orders"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def delete_by_subquery(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return dashboards.without_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("""WITH s AS (SELECT event_id, user_id AS vehicle, ts AS seen_at, value, CASE WHEN value > 20 THEN s_name END AS route, n_name AS town FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = user_id WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 1 DAY AND ts <= TIMESTAMP '2024-01-25')
SELECT event_id, vehicle, coalesce(route, town) AS route_label FROM s""")
def vehicle_feed(spark, sf):
    """Fresh positions with user and town, and the route where there is one, else the town."""
    shifts = activity.fresh(table(spark, sf, "events"), "ts", EVENTS_NOW, 24 * 60).where(F.col("ts").cast("timestamp") <= F.lit(EVENTS_NOW))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey"))
    routes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"), "s_name")
    rows = shifts.join(people, "user_id").join(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey").join(routes, "user_id", "left")
    return rows.select("event_id", F.col("user_id").alias("vehicle"), F.coalesce(F.when(F.col("value") > 20, F.col("s_name")), "n_name").alias("route_label"))
