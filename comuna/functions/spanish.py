"""Word rules of the retrieval for Spanish: stop words, stems, and how much a word counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize

#: Words of a question that are not searched for.
STOP_WORDS = (
    "a al como con cual cuales cuanto cuantos de del donde el en es esta este hay la las lo los me mi necesito para por que quiero se si sin sobre su sus te tengo "
    "tramite tramites un una uno unos unas ver ya yo"
).split()
#: Endings that a stem loses.
SUFFIXES = (
    "aciones amiento amientos adoras adores adora ador idades idad mente ancias ancia logias logia ucion uciones siones sion ciones cion ario aria arios arias "
    "ados adas ado ada idos idas ido ida ico ica icos icas al es ar er ir s"
).split()
#: Sections of a procedure in order, and what a chunk of one is worth.
SECTION_ORDER = ("descripcion", "requisitos", "pasos", "costos", "plazos", "lugar_canal", "horarios", "resultado", "observaciones")
SECTION_BOOST = {"descripcion": 6, "requisitos": 5, "pasos": 4, "lugar_canal": 4, "costos": 3, "resultado": 3, "plazos": 2, "horarios": 1, "observaciones": 0, "fuente": -1}
#: In the list an ending stands before all endings that it ends in, so the first that fits is the longest that leaves five letters.
STEM_PATTERN = "^(.{5,}?)(?:" + "|".join(SUFFIXES) + ")$"


def stem(token: Column) -> Column:
    """A normalised word without its ending, if at least five letters are left."""
    return F.regexp_replace(token, STEM_PATTERN, "$1")


def words_of(text: Column) -> Column:
    """The distinct words of a text in order."""
    return F.array_distinct(F.filter(F.split(normalize(text), " "), lambda t: t != ""))


def query_tokens(text: Column) -> Column:
    """The distinct words of a question that are searched for."""
    return F.filter(words_of(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def section_boost(section: Column) -> Column:
    return F.coalesce(*[F.when(section == k, F.lit(v)) for k, v in SECTION_BOOST.items()], F.lit(0))
