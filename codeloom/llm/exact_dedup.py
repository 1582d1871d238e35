"""Exact deduplication through a cuckoo-filter index of content digests.

Each row's normalised text is reduced to its SHA-256 inside the JVM. Every scan partition first
folds its own copies together, so a text that makes up a third of all rows reaches the shuffle as
one row per partition (per 100,000 digests of it). The folded rows meet in digest buckets, as many as
the rows ask for; each bucket keeps a cuckoo filter
over its live digests. A filter miss proves a digest is new; a hit is verified against the bucket's
stored digests. When a copy with a larger id turns up, the older entry is deleted and the new one
inserted. Overflow rebuilds the filter at twice the size from the stored digests.

Edge cases: a null text counts as empty; copies compare equal after lower-casing A-Z only; null ids
never win over ids that are present; if all ids of a group are null the rows stay with a null
``keep_id``; repeated rows of the winning id are one document and all count as kept by
``assign_groups`` while ``exact_dedup`` emits one of them; an empty table gives an empty result.
Other columns are ignored by ``assign_groups`` and kept by ``exact_dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, numbered, partitions, settle

FLUSH = 100_000
BUCKET_ROWS = 200_000
SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """A cuckoo filter over digests with the verified content beside it."""

    def __init__(self, buckets: int = 1024):
        self.content: dict[bytes, list] = {}
        self.resizes = 0
        self._allocate(buckets)

    def _allocate(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = [0] * (buckets * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def may_contain(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        slots = self.slots
        return mark in slots[a * SLOTS : a * SLOTS + SLOTS] or mark in slots[b * SLOTS : b * SLOTS + SLOTS]

    def get(self, digest: bytes) -> list | None:
        """The verified entry of a digest."""
        return self.content.get(digest) if self.may_contain(digest) else None

    def insert(self, digest: bytes, value: list) -> None:
        self.content[digest] = value
        if not self._place(digest):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        if self.content.pop(digest, None) is None:
            return False
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[k] == mark:
                    self.slots[k] = 0
                    return True
        raise AssertionError("a live digest has no mark")

    def _place(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        slots = self.slots
        for bucket in (a, b):
            for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not slots[k]:
                    slots[k] = mark
                    return True
        bucket = a
        for kick in range(MAX_KICKS):
            k = bucket * SLOTS + kick % SLOTS
            mark, slots[k] = slots[k], mark
            bucket = self._other(bucket, mark)
            for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not slots[k]:
                    slots[k] = mark
                    return True
        return False

    def _grow(self) -> None:
        """Rebuild from the stored digests; a failed placement may have dropped a mark."""
        size = self.mask + 1
        while True:
            size *= 2
            self.resizes += 1
            self._allocate(size)
            if all(map(self._place, self.content)):
                return


def _fold(index: CuckooIndex, digests: list, ids: list, counts: list) -> None:
    for digest, doc, count in zip(digests, ids, counts, strict=True):
        entry = index.get(digest)
        if entry is None:
            index.insert(digest, [doc, count])
        elif doc is not None and (entry[0] is None or doc > entry[0]):
            index.delete(digest)
            index.insert(digest, [doc, entry[1] + count])
        else:
            entry[1] += count


def _rows(index: CuckooIndex, id_type: pa.DataType) -> pa.RecordBatch:
    entries = list(index.content.values())
    return pa.record_batch(
        [pa.array(list(index.content), pa.binary()), pa.array([e[0] for e in entries], id_type), pa.array([e[1] for e in entries], pa.int64())],
        names=["digest", "keep_id", "group_size"],
    )


def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One index for the partition, flushed when it holds ``FLUSH`` digests."""
    index, id_type = CuckooIndex(), None
    for batch in batches:
        id_type = batch["keep_id"].type
        _fold(index, batch["digest"].to_pylist(), batch["keep_id"].to_pylist(), [1] * len(batch))
        if len(index.content) >= FLUSH:
            yield _rows(index, id_type)
            index = CuckooIndex()
    if index.content:
        yield _rows(index, id_type)


def _fold_bucket(rows: pa.Table) -> pa.Table:
    index = CuckooIndex(1 << max(4, (len(rows) // 3).bit_length()))
    _fold(index, rows["digest"].to_pylist(), rows["keep_id"].to_pylist(), rows["group_size"].to_pylist())
    return pa.Table.from_batches([_rows(index, rows["keep_id"].type)])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)).alias("digest"))


def build_index(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row (digest, keep_id, group_size) for each distinct digest of ``digests()`` rows."""
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"digest binary, keep_id {kind}, group_size long"
    folded = rows.select("digest", F.col("doc_id").alias("keep_id")).mapInArrow(_fold_partition, schema)
    return _merge(folded, buckets or partitions(rows.sparkSession), schema)


def _merge(folded: DataFrame, buckets: int, schema: str | T.StructType) -> DataFrame:
    return folded.groupBy(F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")).applyInArrow(_fold_bucket, schema)


def _retract_bucket(live: pa.Table, gone: pa.Table) -> pa.Table:
    index = CuckooIndex(1 << max(4, (len(live) // 3).bit_length()))
    _fold(index, live["digest"].to_pylist(), live["keep_id"].to_pylist(), live["group_size"].to_pylist())
    for digest in gone["digest"].to_pylist():
        if index.get(digest) is not None:
            index.delete(digest)
    return pa.Table.from_batches([_rows(index, live["keep_id"].type)])


def add_to_index(index: DataFrame, rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """The index after inserting further ``digests()`` rows."""
    n = buckets or partitions(rows.sparkSession)
    return _merge(index.unionByName(build_index(rows, n)), n, index.schema)


def remove_from_index(index: DataFrame, digest_rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """The index after deleting the digests of ``digest_rows``; digests it lacks are ignored."""
    n = buckets or partitions(index.sparkSession)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(n)).alias("bucket")
    gone = digest_rows.select("digest").distinct()
    return index.groupBy(bucket).cogroup(gone.groupBy(bucket)).applyInArrow(_retract_bucket, index.schema)


def assign_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``."""
    rows = settle(digests(docs, id_col, text_col), "digests")
    index = build_index(rows, buckets or max(partitions(docs.sparkSession), -(-rows.count() // BUCKET_ROWS)))
    return rows.join(index, "digest", "left").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row for each kept id."""
    rows = numbered(docs)
    id_col, text_col = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    kept = assign_groups(rows, id_col, text_col).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_digest")).distinct()
    marked = rows.withColumn("digest", F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)))
    on = F.col(id_col).eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    return marked.join(kept, on, "left_semi").dropDuplicates([id_col, "digest"]).drop("digest").toDF(*docs.columns)
