"""Token-id files: independent zstandard frames, a document index and a trailing seek table with per-frame checksums.

File layout (integers little-endian):

    data frames      each holds the ids (unsigned 32-bit) of some whole documents; about ``FRAME_BYTES`` before compression
    index            skippable frame 0x184D2A50: zstandard-compressed array of (doc_id int64, frame uint32, tokens uint32)
    seek table       skippable frame 0x184D2A5E of the public seekable format: (compressed size, decompressed size, low 32
                     bits of the decompressed data's XXH64) per frame, then frame count, descriptor 0x80, magic 0x8F92EAB1

A reader takes the tail of the file, looks up where a document lies, and decompresses only that frame.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches_of
from .common import cut, deal_by_range, new_file, open_file, out_dir

FRAME_BYTES = 256 * 1024
#: Fixed values of the format.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_INDEX = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("tokens", "<u4")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
#: Stands for a null doc_id in the index.
NO_ID = -(2**63)
END_ID = 1


class BadFile(ValueError):
    """A file that does not hold what its tables say."""


class TokenFileWriter:
    def __init__(self, stream, level: int = 1):
        self.stream, self.compressor = stream, zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.index, self.seek, self.tokens = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > FRAME_BYTES:
            self._flush()
        self.index.append((NO_ID if doc_id is None else doc_id, len(self.seek), len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4

    def _flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.compressor.compress(raw)
        self.stream.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        index = self.compressor.compress(np.array(self.index, _INDEX).tobytes())
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.seek, _SEEK).tobytes() + struct.pack("<IBI", len(self.seek), WITH_CHECKSUMS, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.stream.close()


class TokenFileReader:
    """Random access to a file open for reading."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        stream.seek(size - 9)
        frames, descriptor, magic = struct.unpack("<IBI", stream.read(9))
        if magic != FOOTER_MAGIC or descriptor != WITH_CHECKSUMS:
            raise BadFile("no seek table with checksums at the end")
        table = frames * _SEEK.itemsize + 9
        stream.seek(size - table - 8)
        if struct.unpack("<II", stream.read(8)) != (SEEK_MAGIC, table):
            raise BadFile("the seek table's frame is damaged")
        self.seek = np.frombuffer(stream.read(frames * _SEEK.itemsize), _SEEK)
        self.starts = np.concatenate(([0], np.cumsum(self.seek["packed"], dtype=np.int64)))
        stream.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", stream.read(8))
        if magic != INDEX_MAGIC:
            raise BadFile("no document index after the frames")
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(stream.read(length)), _INDEX)
        first = np.searchsorted(self.index["frame"], np.arange(frames))
        self.first_of = np.append(first, len(self.index))

    def frame(self, number: int) -> bytes:
        self.stream.seek(int(self.starts[number]))
        raw = zstandard.ZstdDecompressor().decompress(self.stream.read(int(self.seek["packed"][number])))
        if len(raw) != self.seek["size"][number] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek["checksum"][number]:
            raise BadFile(f"frame {number} does not match its checksum")
        return raw

    def documents(self, frame: int, only: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        raw, at = self.frame(frame), 0
        for doc_id, _, tokens in self.index[self.first_of[frame] : self.first_of[frame + 1]].tolist():
            if only is None or doc_id in only:
                yield (None if doc_id == NO_ID else doc_id), raw[at : at + 4 * tokens]
            at += 4 * tokens

    def find(self, wanted: set[int]) -> Iterator[tuple[int | None, bytes]]:
        """The documents of some ids; decompresses only frames that hold one."""
        rows = np.isin(self.index["doc_id"], np.fromiter(wanted, np.int64, len(wanted)))
        for frame in np.unique(self.index["frame"][rows]).tolist():
            yield from self.documents(frame, wanted)

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for frame in range(len(self.seek)):
            yield from self.documents(frame)


class WordEncoder:
    """The tokenizer's ids of whole texts as little-endian unsigned 32-bit integers, with a bounded memory of words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words one after the other.
    Letters beyond the Latin blocks, control characters and special-token strings go to the tokenizer whole, and so do all
    texts if the tokenizer is of another kind than the one modelled here.
    """

    REMEMBERED = 1_200_000
    #: Fixed value: the tokenizer's own split, for words of Latin letters.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    WHOLE = regex.compile("[\x00-\x08\x0e-\x1f\x7f\x85]|<\\|")
    LATIN = regex.compile("[\x20-\x7e\xa0-ɏ]+")
    #: The steps before the model that are modelled.
    NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    CUTS = [{"type": "Split", "pattern": {"Regex": SPLIT.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        told = json.loads(definition)
        cuts = told.get("pre_tokenizer") or {}
        special = all(t["content"].startswith("<|") and not t["normalized"] for t in told.get("added_tokens", ()))
        self.modelled = told.get("normalizer") == self.NORMAL and cuts.get("pretokenizers") == self.CUTS and told["model"].get("type") == "BPE" and not told["model"].get("dropout") and special
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # Fixed rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.shown = {b: b if b in own else next(others) for b in range(256)}

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode("utf-8").decode("latin-1").translate(self.shown)
        self.pieces[piece] = ids = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        if not self.LATIN.fullmatch(word):
            return self._whole(word)
        low = word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word)
        return b"".join([self.pieces.get(p) or self._piece(p) for p in self.SPLIT.findall(low)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if not self.modelled:
            return [self._whole(t) for t in texts]
        if len(self.words) + len(self.pieces) > self.REMEMBERED:
            self.words, self.pieces = {}, {}
        parts = [None if self.WHOLE.search(t) else t.split() for t in texts]
        words = self.words
        for w in set(chain.from_iterable(p for p in parts if p)) - words.keys():
            words[w] = self._word(w)
        return [self._whole(t) if p is None else b"".join(map(words.__getitem__, p)) for t, p in zip(texts, parts, strict=True)]


_ENCODERS: dict[int, WordEncoder] = {}


def word_encoder(definition: str) -> WordEncoder:
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes every whole text's ids and ``end_id``, in ascending doc_id order over the files, and lists these.

    ``range`` (the files' order), ``path``, ``documents``, ``tokens``. A null text is empty; a null doc_id comes first; rows
    of one doc_id go by text. Other columns are not read; an empty table gives no file.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = deal_by_range(rows, "doc_id").sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, number, written = word_encoder(definition.value), None, 0, 0
        for batch in batches:
            for start, count in batches_of(batch.column(1)):
                ids, texts, ranges = (c.to_pylist() for c in batch.slice(start, count).columns)
                if writer is None:
                    path, stream = new_file(folder, ".ids.zst")
                    writer, number = TokenFileWriter(stream), ranges[0]
                for doc_id, raw in zip(ids, encoder.encode_many(texts), strict=True):
                    writer.add(doc_id, raw + end)
                    written += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"range": pa.array([number], pa.int32()), "path": [path], "documents": [written], "tokens": [writer.tokens]})

    return cut(dealt.select("doc_id", "text", "_range").mapInArrow(run, "range int, path string, documents long, tokens long"))


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` from the files; with_ids adds ``ids``.

    The driver sees one row per file.
    """
    starts, total = {}, 0
    for row in sorted(files.select("range", "path", "tokens").collect()):
        starts[row["path"]] = total
        total += row["tokens"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                at = starts[path]
                with open_file(path) as stream:
                    reader = TokenFileReader(stream)
                    for frame in range(len(reader.seek)):
                        rows = []
                        for doc_id, raw in reader.documents(frame):
                            rows.append((doc_id, at, len(raw) // 4, zlib.crc32(raw), raw))
                            at += len(raw) // 4
                        columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:4]]
                        if with_ids:
                            columns.append(pa.array([np.frombuffer(r[4], "<u4").astype(np.int64) for r in rows], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    placed = files.select("path").repartition(max(1, len(starts)), "path")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files to a new folder in the shared one and reads them back."""
    return read_tokens(write_tokens(docs, out_dir(docs.sparkSession, "tokens"), tokenizer))
