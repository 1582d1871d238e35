"""Mixing sources to target weights.

The words of each source are laid end to end and packed into fixed-length blocks. Targets follow the
weights, none above ``MAX_EPOCHS`` times its source. For each output shard a multinomial draw, over
what the sources still owe, says how many slots each source gets, so the draws decide how many blocks a
source gives and which: slot ``j`` of a source reads block ``perm(j mod n)`` of its ``n`` blocks under an
affine permutation of its own for each pass, and a pass reads each block once. A shard may draw more of
a source than it owes; later shards then draw less of it, so only the last ones leave a source a few
blocks from its target, and what is above the target is cut from its last slot. Slots meet blocks in an
equi-join on (source, block).

A source of any size is spread: its documents take their places by two-level prefix sums over hash
chunks, and the join's key is the block. Only one row a source reaches the driver, at most
``MAX_SOURCES``, and a run of slots for each source of a shard, at most ``MAX_SHARDS`` shards; runs are
opened into slots by the executors in two steps. All draws come from ``seed``, so reruns agree.

Edge cases: a null text has no words and is never taken; a null source is a source of its own, last
in order; no words at all give targets of zero; rows with equal ids are separate documents, and rows
alike in all columns too; a very long text fills many blocks; an empty table gives an empty result.
Other columns are ignored by ``mix_taken``, and ``mix_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, row_mark, settle

BLOCK_WORDS = 32
SHARD_SLOTS = 4  # at least
MAX_SHARDS = 1024
MAX_EPOCHS = 3
MAX_SOURCES = 100_000
CHUNK_DOCS, MIN_CHUNKS = 20_000, 64
OPENED = 8192
WHITE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def targets(sizes: list[int], weights: list[float], cap: float = MAX_EPOCHS) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``cap`` times its size.

    What a capped source cannot take is shared among the others by weight until none is above.
    """
    left, out, capped = float(sum(sizes)), [0.0] * len(sizes), set()
    while left > 0 and len(capped) < len(sizes):
        open_ = [k for k in range(len(sizes)) if k not in capped]
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > cap * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(cap * sizes[k])
            capped.add(k)
        left = float(sum(sizes)) - sum(out[k] for k in capped)
    return out


class SourcePlan:
    """The blocks of one source, its permutations, and what ``slots`` drawn slots mean for them."""

    def __init__(self, words: int, target: float, block: int, rng: np.random.Generator):
        self.words, self.want, self.block = words, int(math.floor(target + 0.5)), block
        self.blocks = n = max(1, -(-words // block))
        self.owed = min(MAX_EPOCHS * n, math.ceil(self.want * n / words)) if words else 0
        self.step = 1
        limit = max(1, min(n, (1 << 62) // n))
        while n > 1:
            self.step = int(rng.integers(1, limit))
            if math.gcd(self.step, n) == 1:
                break
        self.shifts = [int(rng.integers(n)) for _ in range(MAX_EPOCHS + 1)]

    def settle(self, slots: int) -> None:
        """Fixes the whole passes and the cut of the last slot."""
        n, last = self.blocks, self.words - (self.blocks - 1) * self.block
        self.slots, self.passes = slots, slots // n if self.words else 0
        size = lambda j: last if (self.step * (j % n) + self.shifts[j // n]) % n == n - 1 else self.block
        rest = slots - self.passes * n
        taken = self.passes * self.words + rest * self.block
        short = (pow(self.step, -1, n) * (n - 1 - self.shifts[self.passes])) % n if n > 1 else 0
        taken -= self.block - last if rest > short else 0
        own = size(slots - 1) if slots else 0
        over = taken - self.want
        self.cut = own - over if 0 < over < own else None
        if self.cut and not rest:
            self.passes -= 1  # the cut slot ends a pass that is then not whole


def draw_shards(plans: list[SourcePlan], rng: np.random.Generator) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots): a multinomial draw for each shard over what is still owed."""
    owed = np.array([p.owed for p in plans], np.int64)
    room = np.array([MAX_EPOCHS * p.blocks if p.words else 0 for p in plans], np.int64)
    done = np.zeros(len(plans), np.int64)
    total = int(owed.sum())
    size = max(SHARD_SLOTS, -(-total // MAX_SHARDS))
    runs = []
    for shard in range(-(-total // size)):
        n = min(size, total - shard * size)
        counts = np.zeros(len(plans), np.int64)
        while n:
            open_ = np.where(done + counts < room, np.maximum(owed - counts, 0), 0)
            if not open_.any():
                break
            drawn = np.minimum(rng.multinomial(n, open_ / open_.sum()), room - done - counts)
            counts += drawn
            n -= int(drawn.sum())
        runs += [(shard, int(k), int(done[k]), int(counts[k])) for k in np.flatnonzero(counts)]
        done += counts
        owed -= counts
    for p, slots in zip(plans, done.tolist(), strict=True):
        p.settle(slots)
    return runs


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, mark: Column) -> DataFrame:
    """(doc_id, source, key, size, start): where each document's words begin in its source."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), mark.alias("mark"))
    sized = settle(rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))), "sizes")
    chunks = max(MIN_CHUNKS, -(-sized.count() // CHUNK_DOCS))
    dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(chunks)))
    sums = dealt.groupBy("key", "chunk").agg(F.sum("size").alias("n"))
    before = sums.select("key", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("size").over(Window.partitionBy("key", "chunk").orderBy("doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return settle(dealt.withColumn("own", own).join(before, ["key", "chunk"]).select("doc_id", "source", "key", "size", "mark", (F.col("base") + F.col("own")).alias("start")), "placed")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=None, block: int = BLOCK_WORDS, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed documents, sources, slots). ``weights`` maps the ordered sources to their weights."""
    spark = docs.sparkSession
    placed = _placed(docs, id_col, text_col, source_col, row_mark(docs))
    found = placed.groupBy("source", "key").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in found]
    given = weights([r["source"] for r in found]) if weights else [1 + k % 3 for k in range(len(found))]
    goals = targets(sizes, given)
    rng = np.random.default_rng(seed)
    plans = [SourcePlan(n, t, block, rng) for n, t in zip(sizes, goals, strict=True)]
    runs = [(shard, found[k]["key"], first, n, p.blocks, p.step, p.shifts, p.slots, p.cut) for shard, k, first, n in draw_shards(plans, rng) for p in [plans[k]]]
    sources = spark.createDataFrame([(r["key"], r["n"], t, p.passes) for r, t, p in zip(found, goals, plans, strict=True)], "key string, source_size long, target double, passes int")
    runs_df = spark.createDataFrame(runs, "shard int, key string, first long, n long, blocks long, step long, shifts array<long>, slots long, cut long")
    j = F.col("slot")
    turn = F.floor(j / F.col("blocks")).cast("int")
    end = F.col("first") + F.col("n") - 1
    opened = runs_df.repartition("shard", "key").withColumn("from", F.explode(F.sequence(F.col("first"), end, F.lit(OPENED)))).withColumn("to", F.least(F.col("from") + OPENED - 1, end))
    slots = opened.repartition("key", "from").withColumn("slot", F.explode(F.sequence(F.col("from"), F.col("to"))))
    at = F.pmod(F.col("step") * F.pmod(j, F.col("blocks")) + F.element_at("shifts", turn + 1), F.col("blocks"))
    return placed, sources, slots.select("shard", "key", "slot", turn.alias("turn"), at.alias("block"), F.when(j == F.col("slots") - 1, F.col("cut")).alias("cut"))


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """The words that a document has in each block: ``off`` in the block, ``n`` of them, from ``skip`` in the document."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))))
    low = F.greatest(start, F.col("block") * block)
    return cut.withColumn("off", low - F.col("block") * block).withColumn("skip", low - start).withColumn("n", F.least(end, (F.col("block") + 1) * block) - low)


def mix_taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=None, block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document."""
    placed, sources, slots = plan_mix(docs, id_col, text_col, source_col, weights, block, seed)
    reads = slots.groupBy("key", "block").agg(F.sum(F.when(F.col("cut").isNull(), 1).otherwise(0)).alias("whole"), F.max("cut").alias("cut"))
    part = F.greatest(F.lit(0), F.least(F.coalesce("cut", F.lit(0)), F.col("off") + F.col("n")) - F.col("off"))
    taken = _pieces(placed, block).join(reads, ["key", "block"], "left").select("key", "start", "doc_id", "size", (F.coalesce("whole", F.lit(0)) * F.col("n") + part).alias("taken"))
    summed = taken.groupBy("key", "start", "doc_id", "size").agg(F.sum("taken").alias("taken"))
    empty = placed.where("size = 0").select("key", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return summed.unionByName(empty).join(sources, "key").select("doc_id", "size", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=None, block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """(shard, source, slot, words): the packed blocks of every output shard."""
    mark = row_mark(docs)
    placed, _, slots = plan_mix(docs, id_col, text_col, source_col, weights, block, seed)
    texts = docs.select(F.col(id_col).alias("text_id"), mark.alias("text_mark"), F.col(text_col).alias("text")).dropDuplicates(["text_id", "text_mark"])
    pieces = _pieces(placed, block).join(texts, F.col("doc_id").eqNullSafe(F.col("text_id")) & (F.col("mark") == F.col("text_mark")))
    cut = pieces.select("key", "source", "block", "off", F.slice(words_of(F.col("text")), (F.col("skip") + 1).cast("int"), F.col("n").cast("int")).alias("words"))
    packed = cut.groupBy("key", "source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("off", "words"))), lambda x: x["words"])).alias("words"))
    words = F.when(F.col("cut").isNull(), F.col("words")).otherwise(F.slice("words", 1, F.coalesce("cut", F.lit(0)).cast("int")))
    return slots.join(packed, ["key", "block"]).select("shard", "source", "slot", words.alias("words"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=None, block: int = BLOCK_WORDS, seed: int = 7, length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` as the mix takes them: a row for each whole pass over a document and one for the words of a part pass.

    A document whose blocks are all taken keeps its text; of others the taken words stay, joined by
    one space. ``length_col``, if ``docs`` has it, becomes the length of the text that stays.
    """
    names = docs.columns
    rows = numbered(docs)
    id_col, text_col, source_col = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    placed, sources, slots = plan_mix(rows, id_col, text_col, source_col, weights, block, seed)
    last = slots.join(sources.select("key", "passes"), "key").where("turn = passes").select("key", "block", "cut")
    wanted = F.least(F.coalesce("cut", F.lit(block)), F.col("off") + F.col("n")) - F.col("off")
    part = _pieces(placed, block).join(last, ["key", "block"]).withColumn("w", wanted).where("w > 0")
    parts = part.groupBy("key", "start").agg(F.sort_array(F.collect_list(F.struct(F.col("skip").cast("int").alias("skip"), F.col("w").cast("int").alias("w")))).alias("parts"), F.sum("w").alias("part_words"))
    told = placed.where("size > 0").join(parts, ["key", "start"], "left").join(sources.select("key", "passes"), "key")
    told = told.select(F.col("doc_id").alias("told_id"), F.col("mark").alias("told_mark"), "size", "passes", "parts", F.coalesce("part_words", F.lit(0)).alias("part_words"))
    # Rows alike in all columns share a mark; their decisions are gathered so that the join makes no row twice.
    told = told.groupBy("told_id", "told_mark").agg(F.collect_list(F.struct("size", "passes", "parts", "part_words")).alias("told"))
    marked = rows.withColumn("mark", row_mark(rows))
    once = marked.dropDuplicates([id_col, "mark"]).join(told, F.col(id_col).eqNullSafe(F.col("told_id")) & (F.col("mark") == F.col("told_mark")))
    each = once.withColumn("t", F.explode("told")).withColumn("words", F.when((F.col("t.part_words") > 0) & (F.col("t.part_words") < F.col("t.size")), words_of(F.col(text_col))))
    kept = F.array_join(F.flatten(F.transform("t.parts", lambda p: F.slice("words", p["skip"] + 1, p["w"]))), " ")
    whole = F.array_repeat(F.col(text_col), F.col("t.passes") + F.when(F.col("t.part_words") == F.col("t.size"), 1).otherwise(0))
    texts = F.when(F.col("words").isNull(), whole).otherwise(F.concat(whole, F.array(kept)))
    out = each.withColumn("out", F.explode(texts))
    columns = [F.col("out").alias(c) if c == text_col else F.length("out").cast(docs.schema[n].dataType).alias(c) if n == length_col else F.col(c) for n, c in zip(names, rows.columns, strict=True)]
    return out.select(*columns).toDF(*names)
