"""Validation: each rule set gives a row's first error code, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact_spaces
from .incidents import SEVERITY_BASE, STATUSES, TYPES

BANDS = ("alta", "media", "baja")
#: What a new report is refused for, in the order in which it is looked at.
REPORT_ERRORS = (
    "pothole-severity-invalid", "pothole-type-invalid", "pothole-location-invalid", "pothole-description-required",
    "pothole-reporter-required", "pothole-image-limit-exceeded", "pothole-barrio-not-found",
)


def _plain(value: Column) -> Column:
    return F.lower(compact_spaces(F.coalesce(value, F.lit(""))))


def _outside(value: Column, allowed) -> Column:
    return ~_plain(value).isin(*allowed)


def _unusable(number: Column) -> Column:
    return number.isNull() | F.isnan(number.cast("double")) | (F.abs(number.cast("double")) == float("inf"))


def status_error(status: Column) -> Column:
    return F.when(_outside(status, STATUSES), "pothole-status-invalid")


def band_error(band: Column) -> Column:
    return F.when(_outside(band, BANDS), "pothole-priority-invalid")


def report_error(severity: Column, kind: Column, lat: Column, lon: Column, description: Column, name: Column, email: Column, images: Column, barrio: Column) -> Column:
    """Of a new report; no severity counts as medium, null ``images`` as none."""
    return (
        F.when((_plain(severity) != "") & _outside(severity, SEVERITY_BASE), REPORT_ERRORS[0])
        .when(_outside(kind, TYPES), REPORT_ERRORS[1])
        .when(_unusable(lat) | _unusable(lon), REPORT_ERRORS[2])
        .when(_plain(description) == "", REPORT_ERRORS[3])
        .when((_plain(name) == "") | (_plain(email) == ""), REPORT_ERRORS[4])
        .when(images > 1, REPORT_ERRORS[5])
        .when(barrio.isNull(), REPORT_ERRORS[6])
    )


def settings_error(chunk_limit: Column, least_score: Column, others: Column, chunk_cap: Column) -> Column:
    """Of a change of the assistant's settings; null means not given, ``others`` counts the given switches."""
    return (
        F.when(F.isnan(chunk_limit.cast("double")) | (chunk_limit < 1), "rag-assistant-chunk-limit-invalid")
        .when(chunk_limit.isNotNull() & (chunk_cap.isNull() | (chunk_cap <= 0)), "rag-assistant-chunk-limit-max-unavailable")
        .when(chunk_limit > chunk_cap, "rag-assistant-chunk-limit-invalid")
        .when(F.isnan(least_score.cast("double")) | ~least_score.between(0, 50), "rag-assistant-min-relevance-score-invalid")
        .when(chunk_limit.isNull() & least_score.isNull() & (F.coalesce(others, F.lit(0)) == 0), "rag-runtime-update-required")
    )


def split(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their ``error_code``."""
    checked = rows.withColumn("error_code", error)
    return checked.where("error_code IS NULL").drop("error_code"), checked.where("error_code IS NOT NULL")


#: A seed's limits: what holds where none is given, the least and the most.
SEED_LIMITS = {
    "max_depth": (3, 0, 8), "max_pages": (500, 1, 2_000), "max_pdfs": (200, 0, 1_000), "max_images": (500, 0, 2_000),
    "max_file_bytes": (26_214_400, 1_048_576, 104_857_600), "concurrency": (2, 1, 6), "page_timeout_ms": (30_000, 5_000, 120_000), "stale_after_days": (30, 1, 365),
}
SEED_STATUSES = ("active", "paused")


def seed_limit(given: Column, name: str) -> Column:
    """A seed's limit as it is kept: whole, within its bounds; text that is no number counts as not given."""
    other, least, most = SEED_LIMITS[name]
    value = given.try_cast("double")
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("double")
    return F.when(value.isNull() | _unusable(value), other).otherwise(F.least(F.greatest(whole, F.lit(float(least))), F.lit(float(most)))).cast("long")


def seed_status(given: Column, current: Column) -> Column:
    """A seed's status as it is kept: an unknown one leaves it as it was, active at first."""
    return F.when(given.isin(*SEED_STATUSES), given).otherwise(F.coalesce(current, F.lit("active")))


def place_error(label: Column, lat: Column, lon: Column) -> Column:
    """Of a place that is set by hand; coordinates may be text."""
    return F.when((_plain(label) == "") | _unusable(lat.try_cast("double")) | _unusable(lon.try_cast("double")), "municipal-barrio-required-fields")


def coordinate(value: Column) -> Column:
    """A coordinate as it is kept: six decimals."""
    return F.round(value.try_cast("double"), 6)
