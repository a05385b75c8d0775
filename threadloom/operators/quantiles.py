"""Exact quantiles of whole columns and medians of groups that hold for groups of any size.

Spark's exact percentile keeps all distinct values of a group in one task. Here distinct values are counted first; each
pass cuts the open intervals of all wanted ranks into parts, counts their rows and keeps the part that has the rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import discard, materialize

PARTS = 1024


def exact_quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column; null, NaN and infinite values are left out.

    The driver holds two ranks for each column and probability, which are parameters, never values of the data.
    """
    names = list(wanted)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names)]))
    counts = df.select(rows.alias("r")).select("r.c", (F.col("r.v") + 0.0).alias("v")).where("v is not null and not isnan(v) and abs(v) < double('Infinity')").groupBy("c", "v").agg(F.count("*").alias("k"))
    counts = materialize(counts, "values")
    sums = {r["c"]: r for r in counts.groupBy("c").agg(F.sum("k").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()}
    ranks = {(i, r) for i, name in enumerate(names) if i in sums for p in wanted[name] for x in [p * (sums[i]["n"] - 1)] for r in (math.floor(x), math.ceil(x))}
    found: dict[tuple[int, int], float] = {}
    open_ = {(i, r): (sums[i]["a"], sums[i]["b"], 0) for i, r in ranks}
    while True:
        found |= {k: a for k, (a, b, _) in open_.items() if a == b}
        open_ = {k: x for k, x in open_.items() if x[0] < x[1]}
        if not open_:
            break
        intervals = sorted({(i, a, b, below) for (i, _), (a, b, below) in open_.items()})
        few = df.sparkSession.createDataFrame([(j, *x) for j, x in enumerate(intervals)], "j int, i int, low double, high double, below bigint")
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("v") * 0.5 - F.col("low") * 0.5) / (F.col("high") * 0.5 - F.col("low") * 0.5) * PARTS))
        cut = counts.join(few, (F.col("c") == F.col("i")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).groupBy("j", part.alias("part")).agg(F.sum("k").alias("k"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("k").over(Window.partitionBy("j").orderBy("part"))
        parts: dict[int, list] = {}
        for r in cut.withColumn("upto", upto).orderBy("j", "part").collect():  # at most PARTS rows for each interval
            parts.setdefault(r["j"], []).append(r)
        place = {x: j for j, x in enumerate(intervals)}
        for (i, rank), (a, b, below) in open_.items():
            hit = next(r for r in parts[place[i, a, b, below]] if rank < below + r["upto"])
            open_[i, rank] = (hit["a"], hit["b"], below + hit["upto"] - hit["k"])
    discard(counts)

    def value(i: int, p: float) -> float | None:
        if i not in sums:
            return None
        x = p * (sums[i]["n"] - 1)
        low, high = found[i, math.floor(x)], found[i, math.ceil(x)]
        return low + (high - low) * (x - math.floor(x))

    return {name: [value(i, p) for p in wanted[name]] for i, name in enumerate(names)}


def group_medians(df: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """(key, median): the mean of the middle values. Counts per `width` of the value find the middle; only rows there are ranked."""
    step = df.where(F.col(value).isNotNull()).select(key, value, F.floor(F.col(value) / width).alias("_step"))
    counts = step.groupBy(key, "_step").agg(F.count("*").alias("_n"))
    of_key = Window.partitionBy(key)
    places = counts.select(key, "_step", "_n", F.sum("_n").over(of_key.orderBy("_step")).alias("_upto"), F.sum("_n").over(of_key).alias("_all"))
    middle = places.select(key, "_step", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.expr("(_all - 1) div 2").alias("_low"), F.expr("_all div 2").alias("_high")).where("(_low >= _before and _low < _upto) or (_high >= _before and _high < _upto)")
    place = F.row_number().over(Window.partitionBy(key, "_step").orderBy(value)) - 1 + F.col("_before")
    ranked = step.join(middle, [key, "_step"]).withColumn("_place", place).where("_place = _low or _place = _high")
    return ranked.groupBy(key).agg(F.avg(value).alias("median"))
