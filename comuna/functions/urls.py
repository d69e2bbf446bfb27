"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of query parameters that only track visitors.
TRACKING = "(?i)^(utm_|fbclid|gclid|yclid|mc_)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def normalize(url: Column) -> Column:
    """No fragment, no tracking parameters, parameters in the order of their names, no slash at the path's end but the root's.

    Scheme and host are in lower case, an empty path is the root; null for anything but http(s).
    """
    plain = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    origin = F.lower(F.regexp_extract(plain, r"(?i)^(https?://[^/?#]+)", 1))
    path_ = F.regexp_replace(F.regexp_extract(plain, r"(?i)^https?://[^/?#]+([^?]*)", 1), "/+$", "")
    parts = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    keyed = F.transform(parts, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    query = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), "&")
    whole = F.concat(origin, F.when(path_ == "", "/").otherwise(path_), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(origin != "", whole)


def without_fragment(url: Column) -> Column:
    """The URL without its fragment, scheme and host in lower case, without the scheme's own port, with the root's slash; null for anything but http(s)."""
    part = lambda i: F.regexp_extract(F.trim(url), r"(?is)^(https?)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(?:#.*)?$", i)
    scheme, path_ = F.lower(part(1)), part(3)
    host_ = F.regexp_replace(F.lower(part(2)), F.when(scheme == "https", ":443$").otherwise(":80$"), F.lit(""))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host_, F.when(path_ == "", "/").otherwise(path_), part(4)))


def kind(url: Column) -> Column:
    """pdf, image or html by the path's ending."""
    low = F.lower(path(url))
    return F.when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.(png|jpe?g|webp|gif|avif|bmp|svg)$"), "image").otherwise("html")


def last_segment(url: Column) -> Column:
    """The last part of the path without its extension; null if there is none."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.regexp_replace(F.element_at(parts, -1), r"\.[a-z]+$", ""))
