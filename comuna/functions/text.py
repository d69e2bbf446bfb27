"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _marks() -> tuple[str, str]:
    """Accented letters of the Latin blocks and their base letters, by Unicode decomposition."""
    accented = [c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(accented), "".join(unicodedata.normalize("NFD", c)[0] for c in accented)


ACCENTED, BASE = _marks()
#: White space as scripts on the web see it: also no-break spaces and the byte-order mark.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


#: White space that is not one blank by itself, in texts of ASCII and in others.
_LOOSE_ASCII, _LOOSE = r"\s(?:\s+|(?<! ))", f"{SPACE}(?:{SPACE}+|(?<! ))"


def once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks; combining marks of decomposed text go too."""
    return F.regexp_replace(F.translate(text, ACCENTED, BASE), r"[\x{0300}-\x{036F}]", "")


def compact_spaces(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    # Single blanks, which nearly all are, stay as they are instead of being replaced one by one.
    return once(text, lambda t: F.trim(F.when(is_ascii(t), F.regexp_replace(t, _LOOSE_ASCII, " ")).otherwise(F.regexp_replace(t, _LOOSE, " "))))


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again as UTF-8, at most twice, where that gives valid text.

    Signs that were lost become an n with tilde, small beside a small letter.
    """

    def read_again(out: Column) -> Column:
        again = F.try_validate_utf8(F.encode(out, "ISO-8859-1").cast("string"))
        hint = out.contains("\u00c2") | out.contains("\u00c3") | out.contains("\u00e2")
        suspicious = hint & out.rlike(r"[\x{00C2}\x{00C3}\x{00E2}][\x{0080}-\x{00BF}]") & ~out.rlike(r"[^\x{0000}-\x{00FF}]")
        return F.when(suspicious, F.coalesce(again, out)).otherwise(out)

    def found_again(out: Column) -> Column:
        small = F.regexp_replace(out, r"(?<=[a-záéíóúü])\x{FFFD}|\x{FFFD}(?=[a-záéíóúü])", "ñ")
        return F.when(out.contains("\ufffd"), F.replace(small, F.lit("\ufffd"), F.lit("Ñ"))).otherwise(out)

    return once(once(once(text, read_again), read_again), found_again)


def normalize(text: Column) -> Column:
    """Lower case, no accents, only letters, digits and single blanks."""
    whole = F.coalesce(text, F.lit(""))
    low = F.lower(whole)
    # All else, white space included, is one blank: one pass over the text, and a plainer one where it is ASCII. Single blanks stay.
    plain, letters = F.regexp_replace(low, "[^a-z0-9](?:[^a-z0-9]+|(?<! ))", " "), F.regexp_replace(strip_accents(low), r"[^\p{L}\p{N}](?:[^\p{L}\p{N}]+|(?<! ))", " ")
    return F.trim(F.when(is_ascii(whole), plain).otherwise(letters))


def words_in(plain: Column) -> Column:
    """How many words a normalised text has."""
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1).cast("long")


def tokens(text: Column) -> Column:
    """The words of the normalised text."""
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def slug(text: Column, most: int | None = None) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    out = F.lower(F.regexp_replace(F.regexp_replace(strip_accents(F.coalesce(text, F.lit(""))), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.left(out, F.lit(most)) if most else out


def truncate(text: Column, most: int, reserve: int = 3) -> Column:
    """Texts over ``most`` characters are cut by ``reserve`` more and end in dots."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - reserve))), F.lit("..."))).otherwise(text)


def csv_field(value: Column) -> Column:
    """Quoted where quotes, commas or line breaks ask for it; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
