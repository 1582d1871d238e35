"""The nearest mark beside each place of a line, by sorted runs of bounded length instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines of a run.
RUN = 4096


def beside(places: DataFrame, marks: DataFrame, keys: list[str], payload: Column, after: bool = True, run: int = RUN) -> DataFrame:
    """``places`` (keys, at) with ``mark``, of ``marks`` (keys, at) the least (at, payload) after ``at``, or before it
    with the greatest ``at`` and then the least payload.

    Each run of lines of a key is sorted on its own; a row for each run tells where the next mark lies.
    """
    sign = F.lit(1) if after else F.lit(-1)
    at = (F.col("at") * sign).cast("long")
    first = marks.where(F.col("at").isNotNull()).select(*keys, at.alias("pos"), payload.alias("pay")).groupBy(*keys, "pos").agg(F.min("pay").alias("pay"))
    own = places.select(*keys, at.alias("pos")).where(F.col("pos").isNotNull()).distinct()
    rows = first.select(*keys, "pos", F.struct("pos", "pay").alias("m")).unionByName(own.select(*keys, "pos"), allowMissingColumns=True)
    rows = rows.withColumn("run", F.floor(F.col("pos") / run))
    # Of a mark and a place at one line the place comes first, so it does not see that mark.
    back = Window.partitionBy(*keys, "run").orderBy(F.desc("pos"), F.col("m").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("near", F.last("m", True).over(back)).where("m is null").select(*keys, "pos", "run", "near")
    ahead = Window.partitionBy(*keys).orderBy("run").rowsBetween(1, Window.unboundedFollowing)
    runs = rows.groupBy(*keys, "run").agg(F.min("m").alias("m")).withColumn("next", F.first("m", True).over(ahead)).drop("m")
    told = near.join(runs, [*keys, "run"], "left").select(*keys, (F.col("pos") * sign).alias("at"), F.coalesce("near", "next").alias("b"))
    told = told.where("b is not null").select(*keys, "at", F.struct((F.col("b.pos") * sign).alias("at"), F.col("b.pay").alias("pay")).alias("mark"))
    return places.withColumn("at", F.col("at").cast("long")).join(told, [*keys, "at"])
