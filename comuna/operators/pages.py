"""Crawled pages: their blocks of text, boilerplate, listings, the crawl's frontier, changes and health of sources."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import text, urls
from .graph import cut

#: Lines and words of the sites' menus, as they read when normalised.
MENU_LINES = (
    "saltar al contenido", "inicio", "intendencia", "tramites", "servicios", "transparencia", "informacion publica",
    "leyes reglamentos", "mas informacion", "anterior", "siguiente",
)
MENU_WORDS = (
    "saltar", "al", "contenido", "inicio", "intendencia", "tramites", "servicios", "transparencia", "informacion", "publica",
    "leyes", "reglamentos", "mas", "anterior", "siguiente",
)
#: Running boilerplate, in the order in which it is taken out.
BOILERPLATE = (
    r"\bsaltar al contenido\s+inicio\s+intendencia\s+tr[aá]mites\s+servicios\s+transparencia\s+informaci[oó]n p[úu]blica\s+leyes\s*(?:&|y)?\s*reglamentos(?:\s+m[aá]s(?:\s+informaci[oó]n)?)?",
    r"\binicio\s+intendencia\s+tr[aá]mites\s+servicios\s+transparencia\s+informaci[oó]n p[úu]blica\s+leyes\s*(?:&|y)?\s*reglamentos(?:\s+m[aá]s(?:\s+informaci[oó]n)?)?",
    r"(?:^|\s)(?:\d+\s+){2,12}anterior\s+siguiente\b",
    r"\bfacebook\s+twitter\s+whatsapp\s+copy\s+link\s+telegram\b",
    r"\bleer\s+m[aá]s\b",
    r"\bviews?\s*:\s*\d+\b",
    r"\betiquetas?\s+de\s+la\s+entrada\s*:\s*",
    r"\bnavegaci[oó]n\s+de\s+entradas\b[\s\S]*$",
)
#: Every pattern has one of these words; signs that are a letter of ASCII when case is ignored.
_IN_BOILERPLATE, _LIKE_ASCII = ("transparencia", "anterior", "whatsapp", "leer", "view", "etiqueta", "entradas"), "\u0130\u0131\u017f\u212a"
#: What marks the end of a page's own text, noise in a chunk, and listing paths.
END_ANYWHERE, END_AT_START = ("leer mas", "continuar"), ("yuyito", "una calle de asuncion")
NOISE = ("leer mas", "etiquetas de la entrada", "navegacion de entradas", "facebook twitter whatsapp")
#: The noise as it reads in a text of ASCII before that is normalised.
_NOISE_ASCII = "(?i)" + "|".join(n.replace(" ", "[^a-z0-9]+") for n in NOISE)
LISTINGS = ("archivo", "category", "categoria", "tag", "etiqueta", "author", "autor", "page")
#: Elements that end an open paragraph, as browsers read them.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_TEXTS, _LISTS = frozenset(("h1", "h2", "h3", "p", "li")), frozenset(("ul", "ol"))
_PARTS = StructType().add("social", "string").add("heading", "string").add("title", "string").add("texts", ArrayType(StringType()))


class _Page(HTMLParser):
    """Gathers titles and, inside main or article, the texts of headings, paragraphs and list items by where they begin."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.social, self.texts, self.open, self.inside = "", [], [], 0
        self.heads: dict[str, list[str] | None] = {"h1": None, "title": None}
        self.head, self.mute = None, False
        self.feed(html)
        self.close()

    def _end(self, tag: str, within=frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_starttag(self, tag, attrs):
        self.mute = tag in ("script", "style")
        if tag == "meta" and dict(attrs).get("property") == "og:title":
            self.social = self.social or dict(attrs).get("content") or ""
        if tag in self.heads and self.heads[tag] is None:
            self.heads[tag], self.head = [], tag
        if tag in _BLOCKS:
            self._end("p")
        if tag in ("main", "article"):
            self.inside += 1
        elif tag == "li":
            self._end("li", _LISTS)
        if self.inside and tag in _TEXTS:
            self.open.append((tag, len(self.texts)))
            self.texts.append([])
        elif tag in _LISTS:
            self.open.append((tag, None))

    def handle_endtag(self, tag):
        self.mute = False
        if tag == self.head:
            self.head = None
        if tag in ("main", "article") and self.inside:
            self.inside -= 1
            if not self.inside:
                self.open.clear()
        elif tag in _TEXTS or tag in _LISTS:
            self._end(tag)

    def handle_data(self, data):
        if self.mute:
            return
        if self.head:
            self.heads[self.head].append(data)
        for _, number in self.open:
            if number is not None:
                self.texts[number].append(data)


@F.pandas_udf(_PARTS)
def _parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for htmls in batches:
        pages = [_Page(h or "") for h in htmls]
        yield pd.DataFrame({
            "social": [p.social for p in pages], "heading": ["".join(p.heads["h1"] or ()) for p in pages],
            "title": ["".join(p.heads["title"] or ()) for p in pages], "texts": [["".join(t) for t in p.texts] for p in pages],
        })


def snapshot(pages: DataFrame, html: str = "html", most: int = 18) -> DataFrame:
    """Adds ``title``, ``blocks`` and ``summary`` of each page.

    The title is the social one, else the first heading, else the document's. Blocks are the distinct texts over 30
    characters of main or article up to a "read on" mark, ``most`` at most; the summary is the first two. A null page is
    empty. Scripts and styles are no text.
    """
    found = pages.withColumn("_p", _parts(F.col(html)))
    filled = [F.when(text.compact_spaces(F.col(f"_p.{c}")) != "", text.compact_spaces(F.col(f"_p.{c}"))) for c in ("social", "heading", "title")]
    found = found.withColumn("title", F.coalesce(*filled, F.lit("")))
    found = found.withColumn("_long", F.filter(F.array_distinct(F.transform("_p.texts", text.compact_spaces)), lambda b: F.length(b) > 30))
    plain = F.transform("_long", text.normalize)
    ends = F.transform(plain, lambda b: reduce(Column.__or__, [b.contains(e) for e in END_ANYWHERE] + [b.startswith(e) for e in END_AT_START]))
    stop = F.array_position(ends, True)
    blocks = F.slice("_long", 1, F.least(F.lit(most), F.when(stop > 0, stop - 1).otherwise(most)).cast("int"))
    found = found.withColumn("blocks", blocks)
    return found.withColumn("summary", F.array_join(F.slice("blocks", 1, 2), " ")).drop("_p", "_long")


#: More letters and digits than a menu line has: whatever becomes of the rest, these stay when a line is normalised.
_LONG_LINE = r"\A[^a-zA-Z0-9]*+(?:[a-zA-Z0-9][^a-zA-Z0-9]*+){181}"
#: How a menu line of ASCII begins, and what a normalised line of menu words and numbers is.
_MENU_BEGINS = rf"(?i)\A[^a-z0-9]*+(?:[0-9]+|{'|'.join(MENU_WORDS)})(?:[^a-z0-9]|\z)"
_OF_MENU = rf"\A(?:[0-9]+ )*+(?:(?:{'|'.join(MENU_WORDS)})(?: [0-9]+(?![^ ]))*+(?: |\z)){{3,}}\z"


def is_menu_line(line: Column) -> Column:
    """A known menu line, or a short one of at least three words (numbers aside) that are all menu words."""

    known = text.once(text.normalize(line), lambda plain: plain.isin(*MENU_LINES) | ((F.length(plain) <= 180) & plain.rlike(_OF_MENU)))
    other = (text.is_ascii(line) & ~line.rlike(_MENU_BEGINS)) | ((F.length(line) > 180) & line.rlike(_LONG_LINE))
    return F.when(other, F.lit(False)).otherwise(known)


def strip_boilerplate(value: Column) -> Column:
    """Drops menu lines, then running boilerplate; white space is compacted, so line breaks go. Null is empty."""
    whole = F.replace(text.repair_mojibake(F.coalesce(value, F.lit(""))), F.lit("\r"), F.lit("\n"))
    lines = F.filter(F.split(whole, "\n+"), lambda s: (F.trim(s) != "") & ~is_menu_line(s))
    cleaned = F.array_join(F.transform(lines, F.trim), "\n")

    def taken_out(found: Column) -> Column:
        hint = text.once(F.lower(found), lambda low: reduce(Column.__or__, [low.contains(w) for w in _IN_BOILERPLATE]))
        return F.when(reduce(Column.__or__, [found.contains(c) for c in _LIKE_ASCII]) | hint, reduce(lambda c, pattern: F.regexp_replace(c, "(?iu)" + pattern, " "), BOILERPLATE, found)).otherwise(found)

    return text.compact_spaces(text.once(cleaned, taken_out))


def is_listing(url: Column) -> Column:
    """The front page, or a path of archives, categories, tags, authors or page numbers."""
    path = F.regexp_replace(F.lower(urls.path(url)), "/+$", "")
    return (path == "") | (path == "/archivo") | path.rlike(f"^/({'|'.join(LISTINGS)})/")


def is_skipped(kind: Column, url: Column, title: Column) -> Column:
    """HTML pages that only list others: by path, by an archive's title or a bare town's title."""
    name = F.lower(text.compact_spaces(F.coalesce(title, F.lit(""))))
    return (kind == "html") & (is_listing(url) | name.startswith("archivos - ") | name.rlike(r"^municipalidad de [a-z0-9 .\-]+$"))


def is_noisy(block: Column, listing: Column) -> Column:
    """Empty, with a navigation phrase, or (of a listing) under 80 words without a sentence's end."""

    def noisy(whole: Column) -> Column:
        plain = text.once(text.normalize(whole), lambda plain: reduce(Column.__or__, [plain.contains(n) for n in NOISE]))
        phrase = F.when(text.is_ascii(whole), whole.rlike(_NOISE_ASCII)).otherwise(plain)
        return (whole == "") | phrase | (listing & (F.size(F.split(whole, " ")) < 80) & ~whole.rlike("[.!?]"))

    # The lambda's variable stands for the text, which is worked out once.
    return text.once(text.compact_spaces(F.coalesce(block, F.lit(""))), noisy)


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int = 3, max_pages: int = 500) -> DataFrame:
    """``seed``, ``url``, ``depth``, ``place`` of the pages that a breadth-first crawl visits.

    ``seeds`` has ``url``; ``links`` has ``source``, ``target``, ``position`` (the link's place on its page). Only links within
    the seed's host are followed, in the order in which a queue would meet them; ``max_pages`` per seed is the crawl's own
    limit. One round per level, whatever the number of seeds.
    """
    seen = seeds.select("url").distinct().select(F.col("url").alias("seed"), "url", F.lit(0).alias("depth"), F.lit(1).alias("place"))
    level = seen
    for depth in range(1, max_depth + 1):
        met = level.join(links, level["url"] == links["source"]).where(urls.host(F.col("target")) == urls.host(F.col("seed")))
        new = met.groupBy("seed", F.col("target").alias("url")).agg(F.min(F.struct("place", "position")).alias("met")).join(seen, ["seed", "url"], "left_anti")
        have = seen.groupBy("seed").agg(F.max("place").alias("have"))
        turn = F.row_number().over(Window.partitionBy("seed").orderBy("met", "url"))
        placed = new.withColumn("turn", turn).join(have, "seed").withColumn("place", F.col("have") + F.col("turn")).where(F.col("place") <= max_pages)
        level = cut(placed.select("seed", "url", F.lit(depth).alias("depth"), "place"))
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
    return seen


def check_status(last_digest: Column, digest: Column) -> Column:
    """What a check of a source found: error without a digest, changed if it is new or another, else unchanged."""
    return F.when(digest.isNull(), "error").when(last_digest.isNull() | (last_digest != digest), "changed").otherwise("unchanged")


def source_health(checked_at: Column, status: Column, stale_after_days: Column, now: dt.datetime) -> Column:
    """never_checked before error before stale before the last check's own status."""
    age_days = (F.unix_micros(F.lit(now)) - F.unix_micros(checked_at.cast("timestamp"))) / 86_400_000_000.0
    return F.when(checked_at.isNull(), "never_checked").when(status == "error", "error").when(age_days > stale_after_days, "stale").otherwise(F.coalesce(status, F.lit("unknown")))


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds ``title``, ``canonical`` (the page's own address where it names none), ``links`` and ``images`` (each address once, first
    come first) and ``plain`` (the text without tags, scripts and styles) of every page; a null page has none of these.
    """
    page = F.col(html)
    every = lambda pattern: F.array_distinct(F.regexp_extract_all(page, F.lit(pattern), F.lit(1)))
    named = F.coalesce(*[F.nullif(F.regexp_extract(page, p, 1), F.lit("")) for p in (r'(?i)<link[^>]+rel="canonical"[^>]+href="([^"]+)"', r'(?i)<link[^>]+href="([^"]+)"[^>]+rel="canonical"')])
    plain = F.regexp_replace(page, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    for sign, letter in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(sign), F.lit(letter))
    return pages.withColumns({
        "title": F.trim(F.regexp_extract(page, "(?is)<title[^>]*>(.*?)</title>", 1)), "canonical": F.coalesce(named, F.col(url)),
        "links": every(r'(?i)<a[^>]+href="([^"]+)"'), "images": every(r'(?i)<img[^>]+src="([^"]+)"'), "plain": text.compact_spaces(plain),
    })


def checked_seeds(seeds: DataFrame, checks: DataFrame, now: dt.datetime) -> DataFrame:
    """Seeds (``seed``, ``last_digest``, ``last_changed_at``) after a crawl (``seed``, ``digest``, ``pages``, ``errors``, ``changed_items``, ``last_error``).

    A seed without pages but with errors is an error; one whose digest is new, or that had changed items, is changed; the
    others are unchanged. Seeds that were not crawled stay as they are, with no status.
    """
    digest = F.coalesce("digest", "last_digest")
    changed = digest.isNotNull() & (F.col("last_digest").isNull() | (F.col("last_digest") != digest) | (F.col("changed_items") > 0))
    crawled = F.col("pages").isNotNull()
    status = F.when(crawled & (F.col("pages") == 0) & (F.col("errors") > 0), "error").when(crawled & changed, "changed").when(crawled, "unchanged")
    rows = seeds.join(checks, "seed", "left").withColumn("status", status)
    return rows.select(
        "seed", "status", digest.alias("last_digest"), F.when(crawled, F.lit(now)).alias("last_checked_at"),
        F.when(F.col("status") == "changed", F.lit(now)).otherwise(F.col("last_changed_at")).alias("last_changed_at"), F.when(F.col("status") == "error", F.col("last_error")).alias("check_error"),
    )


def job_counters(log: DataFrame, job: str) -> DataFrame:
    """What a crawl job has met: one row a job.

    ``log`` has ``url``, ``kind`` (html, pdf, image), ``external``, ``too_large``, ``error``, ``digest``, ``known`` (the digest stored before, null for a new
    item) and ``at``. External links are only skipped, errors only counted, assets that are too large not stored; all else is
    an item, changed where its digest is not the known one. ``last_error`` is that of the latest row, by time and URL.
    """
    stored = ~F.coalesce("external", F.lit(False)) & F.col("error").isNull() & ~F.coalesce("too_large", F.lit(False))
    same = F.col("digest").eqNullSafe(F.col("known"))
    return log.groupBy(job).agg(
        F.count_if(stored & (F.col("kind") == "html")).alias("pages"), F.count_if(stored & (F.col("kind") == "pdf")).alias("pdfs"), F.count_if(stored & (F.col("kind") == "image")).alias("images"),
        F.count_if(stored & ~same).alias("changed_items"), F.count_if(stored & same).alias("unchanged_items"), F.count_if("external").alias("external_skipped"),
        F.count_if(F.coalesce("too_large", F.lit(False)) & ~F.coalesce("external", F.lit(False)) & F.col("error").isNull()).alias("assets_too_large"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("at", "url"))).alias("last_error"),
    )
