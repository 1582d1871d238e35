"""Removal of word windows that occur more than once, by a count-min prefilter.

Documents are dealt to buckets by a hash of id and text. Each bucket hashes all its windows (a
polynomial over the words' 64-bit hashes, two families) and sends, for each hash range, the sorted
short keys of its windows: the nonzero cells of its count-min sketch in sparse form. The merger of a
range adds the sketches of all buckets into a two-row count-min sketch of fixed width; as the
estimate is never below the true count, windows estimated once are certainly unique. Ranges grow in
number with the input, so a sketch keeps its width and its error at any size. One bit a window goes
back to the bucket. A second pass sends 96-bit hashes of the windows estimated repeated and no others
to be grouped exactly, and the buckets remove the words that repeated windows cover.

Windows travel as packed arrays, never as rows, and no group of equal windows is ever collected or
paired: a passage in a third of all documents costs a few bytes for each of its occurrences.

Edge cases: a null text has no words; texts shorter than the window lose nothing; windows of one
document repeat each other, overlapping or not; repeated rows count as two documents; an empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, texts_of

KEY_BITS = 28
CELL_BITS = 23
RANGE_WINDOWS = 1_000_000
BUCKET_BYTES = 8 << 20
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_hashes = WordHashes()


def _windows(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """The polynomial hash of each ``width`` consecutive elements."""
    power, span, out, done = base, h, None, 0
    size = 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if out is None:
                    out = span
                else:
                    n = len(h) - done - size + 1
                    out = out[:n] * power + span[done : done + n] if n > 0 else out[:0]
                done += size
            size *= 2
            if size > width:
                return out[: max(0, len(h) - width + 1)]
            half = size // 2
            span = span[:-half] * power + span[half:] if len(span) > half else span[:0]
            power = power * power


class Bucket:
    """The words and the sorted window hashes of one bucket's documents."""

    def __init__(self, docs: pa.Table, width: int):
        self.words = [x.split() for x in texts_of(docs["text"])]
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        ends = np.cumsum(self.lengths)
        h = np.concatenate([_hashes.of(x) for x in self.words]) if self.words else np.zeros(0, np.uint64)
        first, second = _windows(h, width, BASES[0]), _windows(mix(h), width, BASES[1])
        keep = np.zeros(len(h) + 1, np.int64)
        long = self.lengths >= width
        np.add.at(keep, (ends - self.lengths)[long], 1)
        np.add.at(keep, (ends - width + 1)[long], -1)
        at = np.flatnonzero(np.cumsum(keep)[: len(first)])
        h1 = mix(first[at])
        order = np.argsort(h1)
        self.at, self.h1, self.h2 = at[order], h1[order], (mix(second[at[order]]) >> np.uint64(32)).astype(np.uint32)

    def ranges(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash ranges that have windows, and where each begins in the sorted hashes."""
        r = (self.h1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.h1), np.int64)
        begins = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
        return r[begins], np.append(begins, len(r))

    def keys(self, bits: int) -> np.ndarray:
        return ((self.h1 << np.uint64(bits)) >> np.uint64(64 - KEY_BITS)).astype(np.uint32)


def pack(keys: np.ndarray) -> bytes:
    """Ascending 32-bit integers as compressed byte planes of their differences."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _cells(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = KEY_BITS - CELL_BITS
    with np.errstate(over="ignore"):
        other = (keys * np.uint32(0x9E3779B1)) & np.uint32((1 << KEY_BITS) - 1)
    return keys >> np.uint32(shift), other >> np.uint32(shift)


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _merge_sketches(rows: pa.Table) -> pa.Table:
    """The windows of each bucket in this range whose estimated count is two or more."""
    order = rows["bucket"].to_pylist()
    parts = [unpack(x) for x in rows["keys"].to_pylist()]
    estimate = None
    for row in (0, 1):
        counts = np.zeros(1 << CELL_BITS, np.uint8)
        for keys in parts:
            cells, times = np.unique(_cells(keys)[row], return_counts=True)
            counts[cells] = np.minimum(counts[cells] + times, 2)
        repeated = [counts[_cells(keys)[row]] >= 2 for keys in parts]
        estimate = repeated if estimate is None else [a & b for a, b in zip(estimate, repeated, strict=True)]
    return pa.table({"bucket": pa.array(order, pa.int64()), "hash_range": rows["hash_range"], "n": pa.array([len(x) for x in parts], pa.int64()), "estimated": pa.array(map(_bits, estimate or []), pa.binary())})


def _merge_exact(rows: pa.Table) -> pa.Table:
    """Of the windows sent, those whose hash occurs more than once."""
    raw = rows["hashes"].to_pylist()
    sizes = np.array([len(x) // 12 for x in raw], np.int64)
    h1 = np.concatenate([np.frombuffer(x, "<u8", n) for x, n in zip(raw, sizes, strict=True)])
    h2 = np.concatenate([np.frombuffer(x, "<u4", n, 8 * n) for x, n in zip(raw, sizes, strict=True)])
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    repeated = np.zeros(len(h1), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    masks = [_bits(x) for x in np.split(repeated, np.cumsum(sizes)[:-1])]
    return pa.table({"bucket": rows["bucket"], "hash_range": rows["hash_range"], "n": rows["n"], "estimated": rows["estimated"], "repeated": pa.array(masks, pa.binary())})


def _estimated(bucket: Bucket, rows: pa.Table) -> tuple[np.ndarray, list[dict]]:
    """Which of the sorted windows are estimated repeated; the rows in order of range."""
    told = sorted(rows.to_pylist(), key=lambda x: x["hash_range"])
    return np.concatenate([_mask(x["estimated"], x["n"]) for x in told] or [np.zeros(0, bool)]), told


def repeated_windows(docs: DataFrame, width: int = 35) -> tuple[DataFrame, DataFrame, int]:
    """(docs dealt to buckets, the masks of each bucket, bits of the hash range)."""
    size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    total = (size[1] or 0) + 100 * size[0]
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    bits = max(0, math.ceil(math.log2(max(1, total / 6 / RANGE_WINDOWS))))
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))
    grouped = dealt.repartition("bucket")

    def sketch(rows: pa.Table) -> pa.Table:
        bucket = Bucket(rows, width)
        ranges, begins = bucket.ranges(bits)
        keys = bucket.keys(bits)
        own = pa.array(np.full(len(ranges), rows["bucket"][0].as_py(), np.int64))
        return pa.table({"hash_range": pa.array(ranges), "bucket": own, "keys": pa.array([pack(keys[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.binary())})

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("hash_range", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("estimated", pa.binary()), ("hashes", pa.binary())])
        if not len(left) or not len(right):
            return schema.empty_table()
        bucket = Bucket(left, width)
        mask, told = _estimated(bucket, right)
        out, at = [], 0
        for x in told:
            m = mask[at : at + x["n"]]
            if m.any():
                h1, h2 = bucket.h1[at : at + x["n"]][m], bucket.h2[at : at + x["n"]][m]
                out.append(x | {"hashes": h1.astype("<u8").tobytes() + h2.astype("<u4").tobytes()})
            at += x["n"]
        return pa.Table.from_pylist(out, schema)

    sketches = grouped.groupBy("bucket").applyInArrow(sketch, "hash_range long, bucket long, keys binary")
    estimated = sketches.groupBy("hash_range").applyInArrow(_merge_sketches, "bucket long, hash_range long, n long, estimated binary")
    sent = grouped.groupBy("bucket").cogroup(estimated.groupBy("bucket")).applyInArrow(send, "hash_range long, bucket long, n long, estimated binary, hashes binary")
    masks = sent.groupBy("hash_range").applyInArrow(_merge_exact, "bucket long, hash_range long, n long, estimated binary, repeated binary")
    return grouped, masks, bits


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text): each text without the words that repeated windows cover.

    The kept words are joined by one space.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    grouped, masks, bits = repeated_windows(rows, width)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = Bucket(left, width)
        n = int(bucket.lengths.sum())
        covered = np.zeros(n + 1, np.int64)
        ranges, begins = bucket.ranges(bits)
        where = dict(zip(ranges.tolist(), begins.tolist(), strict=False))
        for x in right.to_pylist():
            mask = _mask(x["estimated"], x["n"])
            mask[mask] = _mask(x["repeated"], int(mask.sum()))
            at = bucket.at[where[x["hash_range"]] :][: x["n"]][mask]
            covered[at] += 1  # a window begins once at a place
            np.add.at(covered, at + width, -1)
        gone = np.cumsum(covered)[:n] > 0
        kept, removed, at = [], [], 0
        for words in bucket.words:
            g = gone[at : at + len(words)]
            at += len(words)
            removed.append(int(g.sum()))
            kept.append(b" ".join([w for w, x in zip(words, g.tolist(), strict=True) if not x] if removed[-1] else words).decode())
        return pa.table({"doc_id": left["doc_id"], "n_words": pa.array(bucket.lengths), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(kept, pa.string())})

    return grouped.groupBy("bucket").cogroup(masks.groupBy("bucket")).applyInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, text string")
