"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text's fingerprints are the smallest k-gram hash of each window of k-grams, with its place. Every
shared span of ``k + windows - 1`` words holds a fingerprint of both sides, and that span is set to
the shortest benchmark window of ``KGRAM`` words or more, so none is missed. Items of fewer words are a
gram each, looked for at every place; only they cost that. Fingerprints of documents join those of the
benchmark; a document with hits is read once more, every window around a hit is compared word for
word with the benchmark's windows, and the words of equal windows are hit. Items with the same words
are one class until the end, so repeated items do not multiply the rows.

The benchmark's fingerprints, its windows and the ids of documents with hits are broadcast only if a
count shows them to be under ``BROADCAST_ROWS``; else the joins shuffle.

Edge cases: null texts have no words, and items without words have no window; an item shorter than
``span`` words is one window; rows with equal ids and texts get equal results, one row each; null
item ids are not counted; an empty benchmark leaves every document clean and an empty table gives an
empty result. Other columns are ignored by ``contamination``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, numbered, settle

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000
PLACE_BITS = 28
KGRAM = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def with_fingerprints(rows: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """``rows``, which has ``words``, with the array ``prints``: hash in the upper bits, place in the lower ones.

    ``kinds``: the (k, windows) to winnow by.
    """
    for at, (k, windows) in enumerate(kinds):
        rows = _fingerprinted(rows, k, windows, f"prints{at}")
    names = [f"prints{at}" for at in range(len(kinds))]
    return rows.withColumn("prints", F.concat(*names) if names else F.array().cast("array<long>")).drop(*names)


def _fingerprinted(rows: DataFrame, k: int, windows: int, name: str) -> DataFrame:
    place = (1 << PLACE_BITS) - 1
    none = F.array().cast("array<long>")
    n = F.size("words")
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.slice("words", i + 1, k)).bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long")))
    count = F.size("_grams")
    least = F.transform(F.sequence(F.lit(1), count - windows + 1), lambda j: F.array_min(F.slice("_grams", j, windows)))
    prints = F.when(count == 0, none).when(count <= windows, F.array(F.array_min("_grams"))).otherwise(F.array_distinct(least))
    return rows.withColumn("_grams", F.when(n >= k, grams).otherwise(none)).withColumn(name, prints).drop("_grams")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``."""
    return _marked(docs, benchmark, id_col, text_col, item_col, item_text_col, span).drop("mark")


def _marked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10) -> DataFrame:
    """``contamination`` with the mark of each row's id and text."""
    items = settle(benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0).withColumn("class", F.sha2(F.array_join("words", " "), 256)), "items")
    classes = items.select("class", "words").dropDuplicates(["class"])
    lengths = sorted(r[0] for r in classes.select(F.least(F.size("words"), F.lit(span))).distinct().collect())  # at most ``span`` numbers
    wide = [n for n in lengths if n >= KGRAM]
    kinds = [(n, 1) for n in lengths if n < KGRAM] + [(KGRAM, n - KGRAM + 1) for n in wide[:1]]
    k = kinds[0][0] if kinds else span

    bench_windows = settle(classes.withColumn("n", F.least(F.size("words"), F.lit(span))).select("class", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.array_join(F.slice("words", i, F.col("n")), " "))).alias("window")).distinct(), "bench-windows")
    bench_prints = settle(with_fingerprints(classes, kinds).select(F.explode("prints").alias("p")).select(F.shiftright("p", PLACE_BITS).alias("hash")).distinct(), "bench-prints")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    mark = F.xxhash64("doc_id", "text").alias("mark")
    read = with_fingerprints(rows.select("doc_id", mark, words_of(F.col("text")).alias("words")), kinds)
    # One row without a place stands for the document, so that a single scan gives the counts and the hits.
    told = read.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(F.array(F.lit(None).cast("long")), F.col("prints"))).alias("p"))
    # Such rows take the mark as their hash, so that they spread over the join's tasks; where it is known by chance nothing changes.
    told = told.select("doc_id", "mark", "n_words", F.coalesce(F.shiftright("p", PLACE_BITS), "mark").alias("hash"), F.col("p").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("place"))
    known = _small(bench_prints, bench_prints.count()).withColumn("known", F.lit(True))
    scan = settle(told.join(known, "hash", "left").where("place is null or known").select("doc_id", "mark", "n_words", "place"), "scan")

    hits = settle(scan.where("place is not null").groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places")), "hits")
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "places")
    again = rows.select("doc_id", mark, "text")
    again = again.join(_small(hits, hits.count()), again["doc_id"].eqNullSafe(hits["_id"]) & (again["mark"] == hits["_mark"])).select("doc_id", "mark", "places", words_of(F.col("text")).alias("words")).dropDuplicates(["doc_id", "mark"])
    around = []
    for n in lengths:
        starts = F.array_distinct(F.flatten(F.transform("places", _around(n, k))))
        around.append(F.transform(starts, _window_at(n)))
    schema = "array<struct<at:int,n:int,window:string>>"
    compared = again.select("doc_id", "mark", F.explode(F.concat(*around) if around else F.array().cast(schema)).alias("w")).select("doc_id", "mark", "w.at", "w.n", "w.window")
    equal = settle(compared.join(_small(bench_windows, bench_windows.count()), "window").select("doc_id", "mark", "at", "n", "class"), "equal")

    covered = equal.select("doc_id", "mark", "at", "n").distinct().groupBy("doc_id", "mark").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))))).cast("long").alias("n_hit"))
    sets = equal.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("class")).alias("classes")).withColumn("set_id", F.sha2(F.array_join("classes", ","), 256))
    named = sets.select("set_id", "classes").dropDuplicates(["set_id"]).select("set_id", F.explode("classes").alias("class")).join(items.select("class", "item"), "class").groupBy("set_id").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    found = covered.join(sets.select("doc_id", "mark", "set_id"), covered_on(covered, sets)).select(covered["doc_id"], covered["mark"], "n_hit", "set_id").join(named, "set_id", "left")
    found = settle(found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "n_hit", "ids"), "found")
    out = scan.where("place is null").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "mark", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def _around(n: int, k: int):
    """The starts of the windows of ``n`` words that hold the k-gram at a place."""

    def starts(place: Column) -> Column:
        low, high = F.greatest(F.lit(0), place - (n - k)), F.least(place, F.size("words") - n)
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return starts


def _window_at(n: int):
    return lambda start: F.struct(start.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("words", start + 1, n), " ").alias("window"))


def covered_on(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with all their columns.

    Rows are told apart by id and text: clean texts stay, whatever shares their id. Columns may have any names.
    """
    rows = numbered(docs)
    id_col, text_col = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    bad = _marked(rows, benchmark, id_col, text_col, **settings).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct()
    return rows.join(bad, F.col(id_col).eqNullSafe(F.col("bad_id")) & (F.xxhash64(id_col, text_col) == F.col("bad_mark")), "left_anti").toDF(*docs.columns)
