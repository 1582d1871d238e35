"""Text functions: edit distance with transpositions, subsequences, suggestions, snippets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def osa_distance(a: str, b: str) -> int:
    """Edits between two texts where two neighbours that change places are one (no text is edited twice)."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        older, before, row = before, row, [i + 1]
        for j, y in enumerate(b):
            best = min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, older[j - 1] + 1)
            row.append(best)
    return row[-1]


def osa(text: Column, word: str) -> Column:
    @F.pandas_udf("int")
    def run(names: pd.Series) -> pd.Series:
        known = {x: osa_distance(word, x) for x in names.dropna().unique()}
        return names.map(known).astype("Int32")

    return run(text)


def has_subsequence(text: Column, letters: str) -> Column:
    """Whether the letters occur in ``text`` in order, with anything between."""
    escaped = "".join("%" + ("\\" + c if c in "%_\\" else c) for c in letters)
    return text.like(escaped + "%")


def suggest(defs: DataFrame, pattern: str, most: int = 8) -> DataFrame:
    """Definitions that may have been meant: few edits from the name, then by subsequence.

    Only distinct names of a near length reach Python, each once.
    """
    p = pattern.strip().lower()
    last = p.split("::")[-1]
    budget = max(1, -(-len(last) // 3))
    rows = defs.withColumn("low_name", F.lower("name"))
    near = rows.select("low_name").where(F.abs(F.length("low_name") - len(last)) <= budget).distinct()
    edits = near.withColumn("score", osa(F.col("low_name"), last)).where(F.col("score") <= budget)
    found = rows.join(edits, "low_name").select("node_id", "qualified_name", "score")
    rest = defs.where(has_subsequence(F.lower("qualified_name"), p.replace(":", ""))).select("node_id", "qualified_name", F.lit(budget + 1).alias("score"))
    best = found.unionByName(rest).where(F.lit(bool(p))).groupBy("node_id", "qualified_name").agg(F.min("score").alias("score"))
    return best.orderBy("score", F.octet_length("qualified_name"), "qualified_name").limit(most)


def snippets(places: DataFrame, sources: DataFrame, context: int = 3, whole: int = 500, most: int | None = None) -> DataFrame:
    """(path, start, number, line): a file of ``whole`` lines at most, else the lines from ``start`` to ``stop``
    and some around; of a place longer than ``most`` lines those from its start."""
    lines = F.split(F.col("text"), "\n")
    rows = places.join(sources.select("path", "text"), "path").withColumn("lines", lines)
    stop = F.col("stop") if most is None else F.least(F.col("stop"), F.col("start") + most - 1)
    rows = rows.withColumn("first", F.col("start") - context).withColumn("last", stop + context).withColumn("small", F.size("lines") <= whole)
    rows = rows.select("path", "start", "first", "last", "small", F.posexplode("lines").alias("at", "line"))
    number = F.col("at") + 1
    return rows.where(F.col("small") | number.between(F.col("first"), F.col("last"))).select("path", "start", number.alias("number"), "line")
