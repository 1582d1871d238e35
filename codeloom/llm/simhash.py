"""SimHash near-duplicates by multi-index hashing.

A fingerprint has one or more 64-bit words, each the bitwise majority of the XXH64 of a text's word
shingles under its own seed. Rows with equal fingerprints are one class, and only classes are
linked. A fingerprint is cut into segments; each class looks up a small Hamming ball around each of
its segments in the table of segments, and the full distance of every match is verified.

* ``exact_ball`` (the default, two segments and at most two differing bits): two bits fall into two
  segments so that one of them is equal or both differ by one, hence a ball of radius one around the
  first segment and an equal match on the second find every link.
* A segment value that more than ``MAX_BUCKET`` classes share is not paired within itself. Two
  fingerprints differ by two bits or fewer exactly if their balls of radius one meet, so there each
  class names the 65 points of its ball and is linked to the smallest class at each point: linear
  work, the same components.
* ``near_dedup`` links texts of five-word shingle similarity 0.8 or more. SimHash by multi-index hashing, as
  above, gives its first links. It cannot give all of them: at 0.8 about 15% of the bits differ, and no
  ball of a bearable size reaches that far (README). So the links are completed by pairs that share one of
  ``BANDS`` MinHash bands, whose chance depends on the similarity alone and not on the length. Every
  candidate's shingle sets are compared whole. First the classes of a band meet ``PIVOTS`` of them, others in
  each of ``ROUNDS`` rounds: linear work that joins the large groups of near copies. Then, so that no pivot
  decides what is linked, every two classes of a band that are still of different components meet. A pair is
  left out there only if the parity of its shingles' bits proves that it differs in too many: a shingle
  that both have changes no bit of the two parities' difference, so that is never above the sets'
  difference. No pair that shares a band is missed.

Components come from alternating large-star and small-star rounds over written tables.

Edge cases: texts without words, null ones included, have fingerprint zero and are linked like any
other (``near_dedup`` keeps one of them); a text of any length is hashed whole, in pieces of bounded memory; texts shorter than a shingle have one shingle of all their words; null ids never name a
component that has another id; rows with equal ids are kept apart but share a component if their
fingerprints do; an empty table gives an empty result. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, numbered, settle, texts_of

SEED = 42
MAX_BUCKET = 1_000
PIVOTS = 3
ROUNDS = 2
#: 64-bit words of the parity of a set's shingles, and classes of a wide band that one group of pairs takes from either side.
WORDS, GROUP = 16, 4_096
#: MinHash: a pair of similarity 0.8 shares no band with a probability of (1 - 0.8 ** ROWS) ** BANDS = 3e-6.
BANDS, ROWS = 24, 4
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))[:, None]
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_PLACES = (np.arange(8) * 256).astype(np.int64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    counts = np.zeros((8, 256), np.int64)
    for k in range(0, len(h), 1 << 17):
        places = h[k : k + (1 << 17)].view(np.uint8).reshape(-1, 8) + _PLACES
        counts += np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    return (counts @ _BITS).ravel()


def majority(h: np.ndarray) -> int:
    """Bit by bit, whether over half of the hashes have it."""
    return int(np.packbits(bit_counts(h) * 2 > len(h), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of ``text``, its words joined by single spaces."""
    words = text.split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)), np.uint64, len(ends))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch), np.uint64)
            for k, text in enumerate(texts_of(batch["text"])):
                h = shingle_hashes(text.lower(), width, SEED)  # bytes: A-Z only
                if len(h):
                    out[k] = majority(h)
            yield pa.record_batch([batch["doc_id"], pa.array(out.view(np.int64))], names=["doc_id", "w0"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, w0) for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, w0 long")


def _half(k: int) -> Column:
    """The k-th 32-bit half of a fingerprint with its number above it."""
    return F.shiftrightunsigned(F.col("id"), 32 * k).bitwiseAND((1 << 32) - 1) + F.lit(k << 40)


def links(classes: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b) with a < b: class ids, the fingerprints themselves, that differ by two bits or
    fewer. Their components are exact."""
    slots = [_half(0), _half(1)]
    balls = [[0, *(1 << i for i in range(32))], [0]]  # by the refined pigeonhole bound
    tables = classes.select("id", F.explode(F.array(*slots)).alias("slot"))
    probes = classes.select("id", F.explode(F.array(*(s.bitwiseXOR(F.lit(m)) for s, ball in zip(slots, balls, strict=True) for m in ball))).alias("slot"))
    found = []
    # A pair at one bit in a wider ball is found through either side; hot values leave the pairing.
    hot = settle(tables.groupBy("slot").count().where(F.col("count") > max_bucket).select("slot"), "hot-slots")
    if not hot.isEmpty():
        near = probes.join(hot, "slot", "left_semi").select("id").unionByName(tables.join(hot, "slot", "left_semi").select("id")).distinct()
        points = near.select("id", F.explode(F.array(F.col("id"), *(F.col("id").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))).alias("point"))
        roots = points.groupBy("point").agg(F.min("id").alias("a"))
        found.append(points.join(roots, "point").where(F.col("a") != F.col("id")).select("a", F.col("id").alias("b")))
        tables = tables.join(hot, "slot", "left_anti")
    pairs = probes.select("slot", F.col("id").alias("a")).join(tables.select("slot", F.col("id").alias("b")), "slot").where("a < b").select("a", "b")
    found.append(pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each id in an edge (a, b): the smallest id that it reaches."""
    now = settle(edges.select("a", "b").where("a != b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
        # Now small stars: each b points at its smaller neighbours.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        before, now = now, settle(small, "edges")
        discard(before)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("id"), "root")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def assign_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, w0, component_id) for each row of ``docs``; fingerprints link at two bits."""
    rows = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints").withColumn("id", F.col("w0"))
    classes = settle(rows.groupBy("id").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("id"), max_bucket))
    rooted = settle(classes.join(roots, "id", "left").select("id", "least", F.coalesce("root", "id").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("id", "component_id")
    return rows.join(named, "id", "left").select("doc_id", "w0", "component_id")


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key for each band of ``ROWS`` MinHash values of a set of shingle hashes; none for no shingles."""
    if not len(h):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(h), 1 << 12):
        np.minimum(least, mix(h[k : k + (1 << 12)] ^ _SEEDS).min(1), out=least)
    least = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return keys


def parity(h: np.ndarray) -> np.ndarray:
    """Bit by bit, whether an odd number of the hashes fall on it; two of these differ in no more bits than the sets in hashes."""
    places = (h % np.uint64(64 * WORDS)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=64 * WORDS) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, prints, slots, odd = [], [], [], [], []
            for text in texts_of(batch["text"]):
                h = np.unique(shingle_hashes(text.lower(), width, SEED))
                ids.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                sizes.append(len(h))
                prints.append(majority(h) if len(h) else 0)
                slots.append(band_keys(h))
                odd.append(parity(h))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.record_batch([batch["doc_id"], batch["mark"], signed(ids), pa.array(sizes, pa.int64()), signed(prints), _lists(slots), _lists(odd)], names=["doc_id", "mark", "id", "n", "w0", "slots", "odd"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text.lower(), width, SEED)) for text in texts_of(batch["text"])]
            yield pa.record_batch([batch["id"], _lists(sets)], names=["id", "shingles"])

    return run


def _similar(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) of class ids those that share ``percent`` of their shingles; the sets are compared whole."""
    named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    marks = classes.join(named, "id", "left_semi").select("id", "mark")
    read = texts.join(marks, "mark").dropDuplicates(["mark"]).select("id", "text")
    sets = settle(read.mapInArrow(_sets(shingle), "id long, shingles array<long>"), "sets")
    of = lambda end: sets.select(F.col("id").alias(end), F.col("shingles").alias(f"{end}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    enough = both * (100 + percent) >= (F.size("a_set") + F.size("b_set")) * percent
    return pairs.join(of("a"), "a").join(of("b"), "b").where(enough).select("a", "b")


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """(x, n, y, m): classes of equal fingerprints and the first class of each two linked fingerprints."""
    first = settle(classes.groupBy("w0").agg(F.min(F.struct("id", "n")).alias("f")).select("w0", F.col("f.id").alias("y"), F.col("f.n").alias("m")), "prints")
    equal = classes.join(first, "w0").where("id != y").select(F.col("id").alias("x"), "n", "y", "m")
    of = lambda end, id_, n: first.select(F.col("w0").alias(end), F.col("y").alias(id_), F.col("m").alias(n))
    linked = links(first.select(F.col("w0").alias("id"))).join(of("a", "x", "n"), "a").join(of("b", "y", "m"), "b")
    return equal.unionByName(linked.select("x", "n", "y", "m"))


def _spokes(tables: DataFrame, salt: int) -> DataFrame:
    """(x, n, y, m): each class of a band with the band's ``PIVOTS`` pivots under ``salt``, of other roots.

    The same few classes win at most of the bands that a group shares, and no band is paired within itself.
    """
    least = [F.min_by(F.struct("id", "n", "root"), F.xxhash64("id", F.lit(PIVOTS * salt + r))).alias(f"p{r}") for r in range(PIVOTS)]
    pivots = tables.groupBy("slot").agg(F.min("root").alias("low"), F.max("root").alias("high"), *least).where("low != high").select("slot", F.array_distinct(F.array(*(f"p{r}" for r in range(PIVOTS)))).alias("pivots"))
    met = tables.join(pivots, "slot").select(F.col("id").alias("x"), "n", "root", F.explode("pivots").alias("p"))
    return met.where("root != p.root").select("x", "n", F.col("p.id").alias("y"), F.col("p.n").alias("m"))


def _mixed(tables: DataFrame) -> DataFrame:
    """The rows of bands of several roots, with the band's classes ``held`` and its commonest root ``most``."""
    held = tables.groupBy("slot").agg(F.count("*").alias("held"), F.mode("root").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"))
    return tables.join(held.where("low != high").select("slot", "held", "most"), "slot")


def rest_pairs(tables: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(x, n, y, m): every two classes of a band that have different roots, but those whose parities differ in too many bits.

    Sets of n and m shingles that share ``percent`` differ in (n + m)(100 - percent) / (100 + percent) at most. Only classes of
    other roots than the band's commonest meet the whole band, and a wide band is dealt to several groups.
    """
    odd = [F.col("odd")[k].alias(f"o{k}") for k in range(WORDS)]
    rows = settle(_mixed(tables).withColumn("parts", F.ceil(F.col("held") / GROUP).cast("int")).join(classes.select("id", *odd), "id"), "mixed")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    few = rows.where("root != most").withColumn("group", part)
    few = few.select("slot", "group", F.col("id").alias("x"), "n", F.col("root").alias("x_root"), *(F.col(f"o{k}").alias(f"x{k}") for k in range(WORDS)))
    all_ = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    all_ = all_.select("slot", "group", F.col("id").alias("y"), F.col("n").alias("m"), "root", *(f"o{k}" for k in range(WORDS)))
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"o{k}"))) for k in range(WORDS)))
    near = (F.col("x_root") != F.col("root")) & (apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))
    return few.join(all_, ["slot", "group"]).where(near).select("x", "n", "y", "m")


def similar_links(classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) with a < b: class ids with a shingle similarity of ``percent`` or more.

    ``classes`` has ``id``, ``n``, ``w0``, ``slots``, ``odd`` and the ``mark`` of one text; ``texts`` has ``mark`` and ``text``.
    Their components are those of all such pairs that share a band or are linked by SimHash.
    """
    tables = settle(classes.select("id", "n", F.col("id").alias("root"), F.explode("slots").alias("slot")), "slots")
    sized = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent  # else the similarity is lower
    ordered = lambda df: df.where(sized).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tried = [settle(ordered(simhash_pairs(classes.select("id", "n", "w0")).unionByName(_spokes(tables, 0))), "spokes")]
    found = [settle(_similar(tried[0], classes, texts, shingle, percent), "links")]
    for step in range(1, ROUNDS + 1):
        # From here on only pairs of different components count.
        roots = components(reduce(DataFrame.unionByName, found))
        rooted = tables.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        before, tables = tables, settle(_mixed(rooted).select("id", "n", "root", "slot"), "slots")
        discard(before)
        pairs = _spokes(tables, step) if step < ROUNDS else rest_pairs(tables, classes, percent)
        tried.append(settle(ordered(pairs).join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti"), "spokes"))
        found.append(settle(_similar(tried[-1], classes, texts, shingle, percent), "links"))
    discard(tables, *tried)
    return reduce(DataFrame.unionByName, found)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, mark, root) for each row of ``docs``: rows of one component of near copies share ``root``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = settle(texts.mapInArrow(_sketches(shingle), f"doc_id {kind}, mark long, id long, n long, w0 long, slots array<long>, odd array<long>"), "sketches")
    classes = settle(rows.groupBy("id").agg(F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("w0").alias("w0"), F.first("slots").alias("slots"), F.first("odd").alias("odd")), "classes")
    roots = components(similar_links(classes, texts.select("mark", "text"), shingle, percent))
    return rows.join(roots, "id", "left").select("doc_id", "mark", F.coalesce("root", "id").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One document of each component, with all its columns: of the smallest id, null last, then the smallest text hash.

    Documents are linked if they share 0.8 or more of their distinct five-word shingles, counted exactly.
    Rows are told apart by id and text, so other texts under the same id, or without one, stay. Columns may
    have any names.
    """
    rows = numbered(docs)
    id_col, text_col = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    found = settle(similar_components(rows, id_col, text_col, **settings), "near-rows")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark")).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("kept_id"), F.col("k.mark").alias("kept_mark"))
    rows = rows.withColumn("mark", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, "mark"]).drop("mark").toDF(*docs.columns)
