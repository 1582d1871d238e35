"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, removed when the JVM ends.

    The folder is ``spark.checkpoint.dir``; only where that is unset on one machine, as in tests, a local
    one is made.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        base = sc.getCheckpointDir()
    path = f"{base}/llm-{name}-{uuid.uuid4().hex}"
    jvm = sc._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    # The lineage is done with: its plans, shuffles and broadcasts go once the driver's collectors find them.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._settled_path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ..., so that no name clashes with those that an operator adds."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def row_mark(rows: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*(f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"))


_kept: dict[str, object] = {}


def kept(owner: str, make: Callable[[], object]):
    """What the tasks of ``owner`` keep in a worker process; that of other owners, whose stage is over, is dropped."""
    for other in [x for x in _kept if x != owner]:
        del _kept[other]
    if owner not in _kept:
        _kept[owner] = make()
    return _kept[owner]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """Remembers the 64-bit hash of each word; forgets all beyond ``bound`` words."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit of the input."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def texts_of(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast("large_binary" if str(column.type).startswith("large") else "binary").to_pylist()]
