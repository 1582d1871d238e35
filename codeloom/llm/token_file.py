"""Token ids in ORC files.

Documents are range-partitioned and sorted by id, encoded with a byte-level BPE, ended with id 0 and
written as ORC: the ids are an int column, which ORC stores in stripes with integer run-length
encoding; ``doc_id`` carries row indexes and a Bloom filter, so a reader looking for a document skips
stripes and row groups by metadata. Stripes are read in parallel. Each row keeps its offset within
its part, and the parts' token totals (one row a part) give the offset over all documents.

Encoding cuts a text at single spaces between two non-space characters. No token of the byte-level
pattern spans such a place and no look-ahead passes it, so the pieces encode independently, and a
bounded memory of pieces serves the frequent ones. A text that holds an added token of the vocabulary,
such as its end mark, goes to the library as a whole.

Edge cases: a null text is empty and has only the end id; null ids sort first; rows with equal ids
lie side by side in the order of their texts; texts of any length are encoded whole; an empty table
writes no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import kept, partitions, shared_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
CACHE_PIECES = 500_000
CACHE_UNITS = 800_000
_PAIR = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ".,;:!?#$%&*|"
#: The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTS)}
_SPACE = {0: "", -1: chr(_LETTERS[32])}


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores have tasks of their own
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: The ids of each piece after a space; None where its space must not be cut off.
        self.cache: dict[str, bytes | None] = {}
        self.units: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._text(x) for x in texts]

    def _text(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return self._whole(text)
        if not text:
            return b""
        first, *pieces = text.split(" ")
        if not pieces or not first or first[-1].isspace():
            return b"".join(map(self._piece, self.pieces(text)))
        last = pieces.pop() if pieces[-1][-1:].isspace() and not pieces[-1][0].isspace() else None  # nothing follows it
        get = self.cache.__getitem__
        try:
            found = b"".join(map(get, pieces))
        except (KeyError, TypeError):
            self._learn(pieces)
            if any(self.cache[x] is None for x in pieces):
                return b"".join(map(self._piece, self.pieces(text)))
            found = b"".join(map(get, pieces))
        return self._piece(first) + found + (self._piece(" " + last) if last else b"")

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut before each single space between two non-space characters."""
        parts = _CUT.split(text)
        return [parts[0], *[" " + x for x in parts[1:]]]

    def _learn(self, pieces: list[str]) -> None:
        cache = self.cache
        missing = set(pieces).difference(cache)
        if len(cache) + len(missing) > CACHE_PIECES:
            cache.clear()
            missing = set(pieces)  # those of one text at most
        for x in missing:
            # Beside a white space the cut is not allowed; the text then goes the longer way.
            cache[x] = None if not x or x[0].isspace() or x[-1].isspace() else self._piece(" " + x)

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self._unit, self._units(piece))) if piece else b""

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def _units(piece: str) -> list[str]:
        """The piece cut at single line ends and before closing marks, where tokens of the pattern also end."""
        if "\n" in piece and not _PAIR.search(piece) and piece[0] != "\n" and piece[-1] != "\n":
            lines = piece.split("\n")
            parts = [x for line in lines for x in (line, "\n")][:-1]
        else:
            parts = [piece]
        out = []
        for part in parts:
            word = part.rstrip(_MARKS)
            out += [word, part[len(word) :]] if word and len(word) < len(part) and word[-1].isalnum() else [part]
        return out

    def _unit(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            if len(self.units) >= CACHE_UNITS:
                self.units = {}
            word = unit[1:] if unit[0] == " " else unit
            if word.isalpha():  # one token of the pattern: the model alone, on the bytes' letters
                letters = _SPACE[len(word) - len(unit)] + word if word.isascii() else unit.encode().decode("latin-1").translate(_LETTERS)
                ids = [x.id for x in self.tokenizer.model.tokenize(letters)]
            else:
                ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
            found = self.units[unit] = array("I", ids).tobytes()
        return found


def encoder(path: str) -> Encoder:
    return kept(path, lambda: Encoder(path))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset = TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for k in range(0, len(batch), 500):
                rows = batch.slice(k, 500)
                raw = [x + end for x in encoder(path).encode([x or "" for x in rows["text"].to_pylist()])]
                n = np.array([len(x) // 4 for x in raw], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                starts = offset + np.cumsum(n) - n
                offset += int(n.sum())
                yield pa.record_batch([rows["doc_id"], pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), ids], names=["doc_id", "part", "local_start", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, parts: int | None = None) -> None:
    """Encode ``docs`` and write ORC parts in ascending id order under ``path``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    ordered = rows.repartitionByRange(parts or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    tokens = ordered.mapInArrow(_encode(tokenizer), f"doc_id {kind}, part int, local_start long, n_tokens long, ids array<int>")
    writer = tokens.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
    writer.option("orc.row.index.stride", "2000").option("orc.stripe.size", str(16 << 20)).option("compression", "zstd").orc(path)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        raw, at = np.asarray(ids.values).astype("<u4", copy=False), np.asarray(ids.offsets)
        sums = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch([batch["doc_id"], batch["part"], batch["local_start"], pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids); a filter on doc_id prunes stripes by index and Bloom filter."""
    return _with_start(spark, path, spark.read.orc(path))


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    totals = spark.read.orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a part
    offsets, total = [], 0
    for part, n in totals:
        offsets.append((part, total))
        total += n
    table = spark.createDataFrame(offsets, "part int, part_start long")
    joined = rows.join(F.broadcast(table), "part")  # as many rows as parts, which write_tokens fixed
    return joined.withColumn("start", F.col("part_start") + F.col("local_start")).drop("part", "part_start", "local_start")


def token_digests(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Write ``docs``, read the files back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, parts=parts)
    kind = dict(docs.dtypes)["doc_id"]
    rows = spark.read.orc(path).mapInArrow(_checked, f"doc_id {kind}, part int, local_start long, n_tokens long, ids_crc32 long")
    return _with_start(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
