"""Work lists and dashboards of incidents: roll-ups, queue orders, pages, change feeds."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .incidents import BANDS, CLOSED, TYPES, level, lookup, priority_band, priority_score, rank_in

#: The orders of bands and levels, best first.
SEVERITIES = ("alta", "media", "baja")
#: Daily limits of an action by role (None: no limit) and for everybody else.
ROLE_LIMITS = {"admin": None, "desarrollador": None, "municipal": 20, "recolector": 10}
DEFAULT_LIMIT = 3


def roll_up(reports: DataFrame, by: str, now: dt.datetime) -> DataFrame:
    """One row per incident (``by``) of ``reports`` (``id``, ``status``, ``kind``, ``severity``, ``created_at``, ``lat``, ``lon``,
    ``confirmations``).

    The incident's kind is the most frequent one (ties by the fixed order), its severity the highest, its status that of the
    latest report that is still open, else of the latest; its priority is worked out anew from these. All in one aggregation.
    """
    is_open = ~F.col("status").isin(*CLOSED)
    counts = [F.count_if(F.col("kind") == k).alias(f"_{k}") for k in TYPES]
    rank = F.min(rank_in(F.coalesce("severity", F.lit("")), SEVERITIES)).alias("_rank")
    found = reports.groupBy(by).agg(
        F.count(F.lit(1)).alias("reports"), F.sum("confirmations").alias("confirmations"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"),
        F.min_by("id", F.struct("created_at", "id")).alias("primary_id"), F.min("created_at").alias("first_at"),
        F.max_by("status", F.struct(is_open.alias("o"), "created_at", "id")).alias("status"), rank, *counts,
    )
    most = F.greatest(*[F.col(f"_{k}") for k in TYPES])
    kind = reduce(lambda out, k: F.when(F.col(f"_{k}") == most, k).otherwise(out), reversed(TYPES), F.lit(None).cast("string"))
    severity = reduce(lambda out, i: F.when(F.col("_rank") == i, SEVERITIES[i]).otherwise(out), range(len(SEVERITIES)), F.lit("media"))
    found = found.withColumn("kind", kind).withColumn("severity", severity)
    found = found.withColumn("priority_score", priority_score(F.col("severity"), F.col("kind"), F.col("reports"), F.col("confirmations"), F.col("first_at"), now))
    return found.withColumn("priority_band", priority_band(F.col("priority_score"))).drop("_rank", *[f"_{k}" for k in TYPES])


def queue_order(mode: str) -> list[Column]:
    """Sort keys of the work queue: open first, then by priority, impact or risk, then by the others, confirmations and age."""
    closed = F.col("status").isin(*CLOSED).cast("int")
    level = lambda name: rank_in(F.col(name), ("alta", "media", "baja"))
    keys = {"priority": ("priority_band", "priority_score"), "impact": ("impact_level", "impact_score"), "risk": ("risk_level", "risk_score")}[mode]
    rest = [level(c) for c in ("priority_band", "impact_level", "risk_level")]
    return [closed, level(keys[0]), F.desc(keys[1]), *rest, F.desc("confirmations"), F.desc("created_at"), F.col("id")]


#: Orders of a plain list of reports.
REPORT_ORDERS = {
    "score_desc": lambda: [F.desc("priority_score"), F.col("id")], "score_asc": lambda: [F.asc("priority_score"), F.col("id")],
    "date_desc": lambda: [F.desc("created_at"), F.col("id")], "date_asc": lambda: [F.asc("created_at"), F.col("id")],
}


def band_order() -> list[Column]:
    """Band first, then newest, then id."""
    return [rank_in(F.col("priority_band"), BANDS), F.desc("created_at"), F.col("id")]


def page(rows: DataFrame, order: list[Column], number: int | None, size: int | None, default: int = 8, most: int = 50) -> DataFrame:
    """One page of ``rows`` and beside every row ``total`` and ``pages`` (at least 1).

    A page number below 1 is the first; a size is held between 1 and ``most``. A page past the last has no rows.
    """
    number = max(1, int(number or 1))
    size = max(1, min(most, int(size if size is not None else default)))
    whole = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint"))
    # The aggregate is one row.
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(whole))


def status_changes(history: DataFrame, key: str, when: str, status: str) -> DataFrame:
    """Rows of a status history where the status differs from the one before (the first always), with ``before``."""
    order = Window.partitionBy(key).orderBy(when, status)
    return history.withColumn("before", F.lag(status).over(order)).where(~F.col(status).eqNullSafe(F.col("before")))


def confirmed(reports: DataFrame, confirmations: DataFrame, now: dt.datetime) -> DataFrame:
    """``id``, ``confirmers``, ``priority_score`` of every report, a confirmer counting once a report."""
    once = confirmations.groupBy("report_id").agg(F.count_distinct("confirmer").alias("confirmers")).withColumnRenamed("report_id", "id")
    rows = reports.join(once, "id", "left").withColumn("confirmers", F.coalesce("confirmers", F.lit(0)))
    return rows.withColumn("priority_score", priority_score(F.col("severity"), F.col("kind"), F.lit(1), F.col("confirmers"), F.col("created_at"), now))


def effective_roles(base: Column, extra: Column) -> Column:
    """Both role lists as one set, base roles first."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(base, empty), F.coalesce(extra, empty)))


def role_limit(roles: Column) -> Column:
    """Daily limit of a user: none (null) if any role has none, else the highest of the roles', else the default."""
    free = F.exists(roles, lambda r: r.isin(*[k for k, v in ROLE_LIMITS.items() if v is None]))
    limits = F.transform(roles, lambda r: lookup(r, {k: v for k, v in ROLE_LIMITS.items() if v is not None}, 0))
    highest = F.array_max(limits)
    return F.when(~F.coalesce(free, F.lit(False)), F.when(highest > 0, highest).otherwise(DEFAULT_LIMIT))


def search_any(rows: DataFrame, text: str | None, *columns: str) -> DataFrame:
    """Rows where any of the columns holds the text, whatever its case; all rows for an empty search."""
    wanted = (text or "").strip()
    if not wanted:
        return rows
    pattern = "%" + wanted.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns]))


def preview(rows: DataFrame, selected: Column, *order: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows, the selected ones before the others."""
    return rows.orderBy(F.coalesce(selected, F.lit(False)).cast("int").desc(), *order).limit(n)


def has_text(column: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(column), F.lit(""))), F.lit("")).isNotNull()


def by_locale(column: str, language: str = "es") -> Column:
    """A sort key that follows a language's alphabet."""
    return F.collate(F.col(column), language)


def by_text_hash(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """One hash per key over its sorted digests."""
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(digest)), "|"), 256).alias("digest"))


def without_rows(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among those to delete."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def kept_since(rows: DataFrame, when: str, now: dt.datetime, past_days: int, future_days: int = 0) -> DataFrame:
    """Rows from ``past_days`` before now to ``future_days`` after."""
    at = F.col(when).cast("timestamp")
    return rows.where(at.between(F.lit(now - dt.timedelta(days=past_days)), F.lit(now + dt.timedelta(days=future_days))))


def copied_roll_up(reports: DataFrame, by: str) -> DataFrame:
    """The municipal page's incidents (``by``): kind, band and score are those of the report with the highest score, not worked out anew.

    ``reports`` has what ``roll_up`` needs, ``priority_score``, ``priority_band`` and ``overridden``: reports whose priority was set by hand
    come before all others. Of equal scores the one with more confirmations counts, then the smaller id.
    """
    is_open = ~F.col("status").isin(*CLOSED)
    first = F.struct(F.coalesce("overridden", F.lit(False)).alias("o"), F.coalesce("priority_score", F.lit(0)).alias("s"), F.coalesce("confirmations", F.lit(0)).alias("c"), (-F.col("id")).alias("i"))
    found = reports.groupBy(by).agg(
        F.count(F.lit(1)).alias("reports"), F.sum("confirmations").alias("confirmations"), F.min_by("id", F.struct("created_at", "id")).alias("primary_id"),
        F.max_by("status", F.struct(is_open.alias("o"), "created_at", "id")).alias("status"), F.min(rank_in(F.coalesce("severity", F.lit("")), SEVERITIES)).alias("_rank"),
        F.max_by(F.struct("kind", "priority_band", "priority_score", "overridden"), first).alias("_top"),
    )
    severity = reduce(lambda out, i: F.when(F.col("_rank") == i, SEVERITIES[i]).otherwise(out), range(len(SEVERITIES)), F.lit("media"))
    return found.withColumn("severity", severity).select("*", "_top.*").drop("_top", "_rank")


def merged_entries(incidents: DataFrame, entries: DataFrame, when: str, *ties: str) -> DataFrame:
    """The entries (``report_id`` and others) of all reports of an incident, newest first: ``incident_id`` and ``place`` are added.

    ``incidents`` has ``incident_id`` and ``related_ids``; a report that stands in several incidents shows in each.
    """
    related = incidents.select("incident_id", F.explode(F.array_distinct("related_ids")).alias("report_id"))
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc(when), "report_id", *ties))
    return related.join(entries, "report_id").withColumn("place", place)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by ``order``; no key is a key of its own. Rows meet only after each task has picked its own."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.col(order)).alias("_row")).select("_row.*")


def admin_changes(reports: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """The history rows that an administrator's changes write: ``id``, ``from_status``, ``to_status``, ``priority_band``, ``note`` and ``order``.

    ``reports`` has ``id``, ``status``, ``priority_band`` as they were at first; ``changes`` has ``id``, ``status``, ``priority_band``, ``note`` (each may be
    null) and ``order``. A change that alters neither and says nothing writes no row; a new priority is named before the note.
    Changes of unknown reports are left out.
    """
    seen = Window.partitionBy("id").orderBy(order)
    rows = changes.withColumnsRenamed({"status": "_status", "priority_band": "_band"}).join(reports.select("id", "status", "priority_band"), "id")
    last = lambda c: F.last(c, ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"from_status": F.coalesce(last("_status"), "status"), "_from_band": F.coalesce(last("_band"), "priority_band")})
    rows = rows.withColumns({"to_status": F.coalesce("_status", "from_status"), "priority_band": F.coalesce("_band", "_from_band")})
    raised = F.col("priority_band") != F.col("_from_band")
    said = F.nullif(F.trim(F.coalesce("note", F.lit(""))), F.lit(""))
    note = F.nullif(F.concat_ws(" ", F.when(raised, F.concat(F.lit("Prioridad manual: "), "priority_band", F.lit("."))), said), F.lit(""))
    return rows.where((F.col("to_status") != F.col("from_status")) | raised | said.isNotNull()).select("id", order, "from_status", "to_status", "priority_band", note.alias("note"))


def incident_queue(incidents: DataFrame, status: str = "", band: str = "", impact: str = "", risk: str = "", place: str = "") -> DataFrame:
    """The incidents that the chosen filters let through; an empty filter lets all.

    ``abierto`` stands for every status but resuelto and descartado. Levels of impact and risk come from their scores.
    """
    kept = incidents
    if status == "abierto":
        kept = kept.where(~F.col("status").isin(*CLOSED))
    elif status:
        kept = kept.where(F.col("status") == status)
    for wanted, value in ((band, F.col("priority_band")), (impact, level(F.col("impact_score"))), (risk, level(F.col("risk_score"))), (place, F.col("place"))):
        kept = kept.where(value == wanted) if wanted else kept
    return kept


def without_seed(jobs: DataFrame, seed: int, message: str) -> DataFrame:
    """Jobs (``job_id``, ``seed_ids``: JSON list, ``stats``: JSON object or null) that name a seed, without it and with the last message set in their stats."""
    ids = F.from_json("seed_ids", "array<string>")
    rows = jobs.where(F.array_contains(ids, str(seed))).select("job_id", "stats", F.posexplode(ids).alias("at", "value"))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda e: e["value"] != str(seed))
    found = rows.groupBy("job_id").agg(F.first("stats").alias("stats"), F.transform(kept, lambda e: e["value"].cast("long")).alias("ids"))
    old = F.coalesce(F.from_json("stats", "map<string,string>"), F.create_map().cast("map<string,string>"))
    stats = F.map_concat(F.map_filter(old, lambda k, v: k != "lastEventMessage"), F.create_map(F.lit("lastEventMessage"), F.lit(message)))
    return found.select("job_id", F.to_json("ids").alias("seed_ids"), F.to_json(stats).alias("stats"))
