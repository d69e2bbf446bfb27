"""Full-text match over a positional inverted index: words, phrases, exclusions and alternatives, the best of each query.

The index is a table in the shared folder. A row holds a word's postings in one block of texts (ids, how many places each has, and
all places, as columns of numbers) and how often a text of the block has the word at most. A task makes whole blocks of the texts that
it reads, so no word is shuffled. Rows lie in folders by a hash of the word, sorted by word, so that a search reads the folders of its
own words only. From the small columns follows what a block can give at best; the promising blocks are read first, and the postings of
those that cannot reach the place looked for go no further. Of the others a block's postings meet once, for all queries that ask for it.

The rank is the cover density: every shortest stretch that holds all terms of the query counts a tenth, less with every other word in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import spanish
from ..functions.text import normalize
from .graph import cut
from .scoring import file_bytes, spread

#: Texts of a block at most, and bytes of text beyond which it gets no further one; folders of the index; blocks of a query that are read first.
BLOCK, BLOCK_BYTES, BUCKETS, PROBE = 1024, 16 << 20, 16, 2
#: Bytes of files that a task makes postings of, so that the index has few files; rows up to which a stated side is broadcast; blocks of a word that are named.
TASK_BYTES, STATED, NAMED = 32 << 20, 200_000, 64
#: What a cover without other words is worth; decimals of a rank, as sums of equal covers in another order differ beyond them.
COVER, PLACES = 0.1, 9


def _kept(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.isin(*spanish.STOP_WORDS)


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _stated(rows: DataFrame) -> DataFrame:
    """``rows``, which are cheap to read, to be broadcast if they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= STATED else rows


def write_index(chunks: DataFrame, folder: str, terms: DataFrame | None = None) -> str:
    """Writes the index of ``chunks`` (``chunk_id``, a key, and ``text``) to a new folder below ``folder`` and returns it.

    Words are stems without accents; stop words and single letters are left out but keep their places. Null and empty texts have no
    words, texts without an id are left out. Texts that a task reads one after the other are a block. Only few texts are shuffled, to
    deal them over the cores; words are not. With ``terms`` (as ``terms_of`` gives them) every text is read but only their words are
    written: an index for these queries, which never read any other word.
    """
    path = f"{folder.rstrip('/')}/index-{uuid.uuid4().hex}"
    cores, texts = chunks.sparkSession.sparkContext.defaultParallelism, chunks.where("chunk_id IS NOT NULL").select("chunk_id", "text")
    files = file_bytes(texts)
    dealt = spread(texts) if files is None else spread(texts).coalesce(max(2 * cores, -(-files // TASK_BYTES)))
    kind, type_, limits = dict(texts.dtypes)["chunk_id"], to_arrow_type(texts.schema["chunk_id"].dataType), (BLOCK, BLOCK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in _blocks(pa.Table.from_batches([batch]), *limits):
                yield from _posted(block, number, type_)
                number += 1

    posted = dealt.select("chunk_id", normalize(F.col("text")).alias("plain")).mapInArrow(run, f"word string, block long, ids array<{kind}>, counts array<int>, places array<int>, best int")
    if terms is not None:
        posted = posted.join(_stated(terms.select("word").distinct()), "word", "left_semi")
    # A row of no word, so that an index of no words has columns as well.
    none = {"word": F.lit(""), "block": F.lit(-1), "best": F.lit(0)}
    posted = posted.unionByName(chunks.sparkSession.range(1, numPartitions=1).select(*(none.get(f.name, F.array()).cast(f.dataType).alias(f.name) for f in posted.schema)))
    posted.withColumn("bucket", _bucket(F.col("word"))).sortWithinPartitions("bucket", "word", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return path


def _blocks(texts: pa.Table, most: int, most_bytes: int) -> Iterator[pa.Table]:
    at = np.arange(texts.num_rows)
    volume = np.cumsum(pc.binary_length(texts["plain"]).to_numpy(), dtype=np.int64)
    starts = [0, *(np.flatnonzero((np.diff(at // most) > 0) | (np.diff(volume // most_bytes) > 0)) + 1).tolist(), texts.num_rows]
    for begin, end in zip(starts, starts[1:], strict=False):
        if end > begin:
            yield texts.slice(begin, end - begin)


def _posted(block: pa.Table, number: int, type_: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of the index for one block of normalised texts."""
    block = block.sort_by("chunk_id")
    ids, said = block["chunk_id"].combine_chunks(), pc.split_pattern(block["plain"].combine_chunks(), " ")
    lengths = pc.list_value_length(said).to_numpy()
    coded = said.flatten().dictionary_encode()
    known = pc.and_(pc.greater(pc.utf8_length(coded.dictionary), 1), pc.invert(pc.is_in(coded.dictionary, pa.array(spanish.STOP_WORDS))))
    stems = pc.replace_substring_regex(coded.dictionary.filter(known), spanish.STEM_PATTERN, r"\1").dictionary_encode()
    code = np.full(len(coded.dictionary), -1, np.int64)
    code[known.to_numpy(zero_copy_only=False)] = stems.indices.to_numpy()
    code = code[coded.indices.to_numpy()]
    # A text's number is its id's, should one come twice.
    again = pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
    text = np.repeat(np.concatenate([[0], np.cumsum(~again)]).astype(np.int32), lengths)
    place = (np.arange(len(code)) - np.repeat(np.cumsum(lengths, dtype=np.int64) - lengths, lengths)).astype(np.int32)
    there = np.flatnonzero(code >= 0)
    if not len(there):
        return
    order = there[np.lexsort((place[there], text[there], code[there]))] if again.any() else there[np.argsort(code[there], kind="stable")]
    code, text, place = code[order], text[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(text) != 0)]))
    counts = np.diff(np.append(first, len(code))).astype(np.int32)
    words = np.flatnonzero(np.concatenate([[True], np.diff(code[first]) != 0]))
    offsets = lambda x, end: pa.array(np.append(x, end).astype(np.int32))
    own = ids.filter(pa.array(np.concatenate([[True], ~again]))).take(pa.array(text[first])).cast(type_)
    columns = {
        "word": stems.dictionary.take(pa.array(code[first][words])),
        "block": pa.array(np.full(len(words), number)),
        "ids": pa.ListArray.from_arrays(offsets(words, len(first)), own),
        "counts": pa.ListArray.from_arrays(offsets(words, len(first)), pa.array(counts)),
        "places": pa.ListArray.from_arrays(offsets(first[words], len(code)), pa.array(place)),
        "best": pa.array(np.maximum.reduceat(counts, words)),
    }
    yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def terms_of(queries: DataFrame) -> DataFrame:
    """``query_id``, ``grp``, ``term``, ``out``, ``gap``, ``word``: a row for every word of every term of ``queries`` (``query_id``, ``text``).

    Words stand for themselves, words in quotes for a phrase, a hyphen before either excludes it, and ``or`` between terms begins an
    alternative (``grp``). ``gap`` is a word's place in its phrase. Stop words are left out.
    """
    marks = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    found = queries.select("query_id", F.posexplode(marks).alias("term", "mark"), marks.alias("marks"))
    grp = F.size(F.filter(F.slice("marks", F.lit(1), F.col("term")), lambda m: F.lower(m) == "or"))
    found = found.withColumn("grp", F.when(F.col("term") == 0, 0).otherwise(grp)).where(F.lower("mark") != "or")
    words = found.select("query_id", "grp", "term", F.col("mark").startswith("-").alias("out"), F.posexplode(F.split(normalize(F.col("mark")), " ")).alias("gap", "raw"))
    return words.where(_kept(F.col("raw"))).select("query_id", "grp", "term", "out", "gap", spanish.stem(F.col("raw")).alias("word"))


def _of_folders(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The folders of ``index`` that hold the words of ``asked`` (``bucket``); others are not even opened."""
    return index.where(F.col("bucket").isin([b for (b,) in asked.select("bucket").distinct().collect()]))


def bounds(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id``, ``grp``, ``block``, ``bound``: blocks that have all required words, and the greatest rank a text there can have.

    A text has at most as many covers as terms times the occurrences of the rarest one. Only words and counts are read.
    """
    need = terms.where("NOT out").groupBy("query_id", "grp").agg(F.count_distinct("word").alias("n"), F.count_distinct("term").alias("terms"))
    asked = terms.where("NOT out").select("query_id", "grp", "word", _bucket(F.col("word")).alias("bucket")).distinct()
    met = _of_folders(index, asked).select("bucket", "word", "block", "best").join(_stated(asked), ["bucket", "word"])
    each = met.groupBy("query_id", "grp", "block").agg(F.count(F.lit(1)).alias("has"), F.min("best").alias("least"))
    return each.join(need, ["query_id", "grp"]).where("has = n").select("query_id", "grp", "block", (F.lit(COVER) * F.col("terms") * F.col("least")).alias("bound"))


def _starts(own: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], common: np.ndarray, wide: int) -> np.ndarray:
    """Where a term's words stand together in the texts ``common``, as the text's number there times ``wide`` and the place."""
    starts = None
    for gap, ids, first, places in own:
        at = np.minimum(np.searchsorted(ids, common), len(ids) - 1)
        there = np.flatnonzero(ids[at] == common)
        sizes = (first[at[there] + 1] - first[at[there]]).astype(np.int64)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        here = np.repeat(there, sizes) * wide + places[np.repeat(first[at[there]], sizes) + inside] - gap
        starts = here if starts is None else np.intersect1d(starts, here, assume_unique=True)
    return starts


def cover_density(occurrences: list[tuple[np.ndarray, int, int]], wide: int, texts: int) -> np.ndarray:
    """The ranks of ``texts`` texts from each term's (sorted starts, length in places, words); text n has the places from n times ``wide``.

    For every end the latest occurrence of each term up to there gives the shortest stretch; of stretches with one begin the first counts.
    """
    ends = np.unique(np.concatenate([starts + size - 1 for starts, size, _ in occurrences]))
    begin, there = np.full(len(ends), np.iinfo(np.int64).max), np.ones(len(ends), bool)
    for starts, size, _ in occurrences:
        at = np.searchsorted(starts + size - 1, ends, "right") - 1
        latest = starts[np.maximum(at, 0)]
        there &= (at >= 0) & (latest // wide == ends // wide)
        begin = np.minimum(begin, latest)
    begin, first = np.unique(begin[there], return_index=True)
    ends = ends[there][first]
    inside = sum(words * np.maximum(0, np.searchsorted(starts + size - 1, ends, "right") - np.searchsorted(starts, begin, "left")) for starts, size, words in occurrences)
    return np.bincount(begin // wide, COVER / (1 + np.maximum(0, ends - begin - (inside - 1))), texts)


def matches(words: list[tuple[int, bool, int, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Texts of one block that hold all required terms and no excluded one, and their ranks.

    ``words`` has the term, whether it is excluded, the gap, and the postings as columns: ids in order, where each one's places begin
    (and the last one's end), and all places.
    """
    terms: dict[int, list[tuple]] = {}
    excluded = {term for term, out, *_ in words if out}
    for term, _, *held in words:
        terms.setdefault(term, []).append(tuple(held))
    required = sorted((ids for term, own in terms.items() if term not in excluded for _, ids, _, _ in own), key=len)
    common = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), required) if required else np.empty(0)
    if not len(common):
        return common, np.empty(0)
    # Room before and after a text's places, so that no phrase and no stretch reaches into another text.
    least, most = max(gap for _, _, gap, *_ in words), max(int(places.max()) for *_, places in words)
    wide = 2 * least + most + 2
    good, found = np.ones(len(common), bool), []
    for term, own in terms.items():
        starts, gaps = _starts([(gap - least, *rest) for gap, *rest in own], common, wide), [gap for gap, *_ in own]
        has = np.zeros(len(common), bool)
        has[starts // wide] = True
        good &= has != (term in excluded)
        if term not in excluded:
            found.append((starts + min(gaps), max(gaps) - min(gaps) + 1, len(gaps)))
    if not good.any():
        return common[:0], np.empty(0)
    found = [(starts[good[starts // wide]], size, n) for starts, size, n in found]
    return common[good], cover_density(found, wide, len(common))[good]


def _first(ids: np.ndarray, ranks: np.ndarray, k: int | None, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Those of the ``k`` best by rank, to its decimals as ``_best`` rounds it, and id; none that is surely below ``least``."""
    near = 10.0**-PLACES
    if least is not None:
        ids, ranks = ids[ranks >= least - near], ranks[ranks >= least - near]
    if k is None or len(ids) <= k:
        return ids, ranks
    in_reach = ranks >= np.partition(ranks, -k)[-k] - 2 * near
    ids, ranks = ids[in_reach], ranks[in_reach]
    distinct, which = np.unique(ranks, return_inverse=True)
    rounded = np.array([float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-PLACES), ROUND_HALF_UP)) for x in distinct.tolist()])
    order = np.lexsort((ids, -rounded[which]))[:k]
    return ids[order], ranks[order]


def read(index: DataFrame, terms: DataFrame, pairs: DataFrame, k: int | None = None) -> DataFrame:
    """``query_id``, ``grp``, ``chunk_id``, ``rank`` of the matches in the blocks of ``pairs`` (``query_id``, ``grp``, ``block``).

    With ``k`` only the best of each alternative in each block, and where ``pairs`` has ``least``, none that ranks below it. A task holds the
    postings of one block at a time, of the words asked there.
    """
    least = F.col("least") if "least" in pairs.columns else F.lit(None)
    asked = terms.join(pairs.select("query_id", "grp", "block", least.cast("double").alias("least")), ["query_id", "grp"])
    # A word is looked for in the blocks that ask for it; where these are many, in all that are asked for.
    blocks = F.collect_set("block")
    wanted = cut(asked.groupBy("word").agg(F.when(F.size(blocks) <= NAMED, blocks).alias("blocks")).withColumn("bucket", _bucket(F.col("word"))))
    met = _of_folders(index, wanted).select("bucket", "word", "block", "ids", "counts", "places").join(_stated(wanted), ["bucket", "word"])
    met = met.where("blocks IS NULL OR array_contains(blocks, block)").join(_stated(pairs.select("block").distinct()), "block", "left_semi").select("block", "word", "ids", "counts", "places")
    kinds, ids = dict(asked.dtypes) | dict(met.dtypes), met.schema["ids"].dataType.elementType
    types = {"query_id": to_arrow_type(asked.schema["query_id"].dataType), "grp": pa.int32(), "chunk_id": to_arrow_type(ids), "rank": pa.float64()}

    def run(said: pa.Table, posted: pa.Table) -> pa.Table:
        held: dict[str, tuple] = {}
        for chunk in posted.to_batches():
            at = [chunk.column(c) for c in ("ids", "counts", "places")]
            values, ends = [c.values.to_numpy(zero_copy_only=False) for c in at], [c.offsets.to_numpy() for c in at]
            for i, word in enumerate(chunk.column("word").to_pylist()):
                own, counts, places = (v[e[i] : e[i + 1]] for v, e in zip(values, ends, strict=True))
                held[word] = own, np.concatenate([[0], np.cumsum(counts)]), places.astype(np.int64)
        out: dict[str, list] = {c: [] for c in types}
        rows = sorted(zip(*(said.column(c).to_pylist() for c in ("query_id", "grp", "least", "term", "out", "gap", "word")), strict=True), key=lambda r: r[:2])
        for (query, grp), own in groupby(rows, key=lambda r: r[:2]):
            own = list(own)
            # A term that lacks a word in this block is in none of its texts, however many its other words are in.
            nowhere = {(r[3], r[4]) for r in own if r[6] not in held}
            if any(not out for _, out in nowhere):
                continue
            found = _first(*matches([(*r[3:6], *held[r[6]]) for r in own if r[3:5] not in nowhere]), k, own[0][2])
            n = len(found[0])
            for c, values in zip(out, ([query] * n, [grp] * n, *(x.tolist() for x in found)), strict=True):
                out[c] += values
        return pa.table([pa.array(out[c], t) for c, t in types.items()], names=[*types])

    schema = f"query_id {kinds['query_id']}, grp int, chunk_id {ids.simpleString()}, rank double"
    sides = asked.withColumnRenamed("block", "at"), met.withColumnRenamed("block", "at")
    return sides[0].groupBy("at").cogroup(sides[1].groupBy("at")).applyInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    each = found.groupBy("query_id", "chunk_id").agg(F.round(F.max("rank"), PLACES).alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"), "chunk_id"))
    return each.withColumn("place", place).where(F.col("place") <= k)


def match(spark: SparkSession, path: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``chunk_id``, ``rank``, ``place`` of the ``k`` best matches of each query; equal ranks (to 9 decimals) go by id.

    A text's rank is the best over the query's alternatives. Queries without a required word match nothing.
    """
    index, terms = spark.read.parquet(path), cut(terms_of(queries))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block", "grp"))
    placed = cut(bounds(index, terms).withColumn("order", order))
    probed = cut(_best(read(index, terms, placed.where(F.col("order") <= PROBE), k), k))
    return _best(probed.select("query_id", "chunk_id", "rank").unionByName(read(index, terms, cut(still_promising(placed, probed, k)), k).drop("grp")), k)


def still_promising(placed: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """The blocks that were not read first and can still give one of the ``k`` best."""
    least = probed.where(F.col("place") == k).select("query_id", F.col("rank").alias("least"))
    return placed.where(F.col("order") > PROBE).join(least, "query_id", "left").where(f"least IS NULL OR bound >= least - {10.0**-PLACES}")
