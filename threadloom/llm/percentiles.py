"""Percentiles per group by exact bisection (problem 1).

The state of a row set is the count of each distinct value per group and measure: states of disjoint row sets add up.
Each pass cuts every open interval of a group and percentile into PARTS equal parts (six halvings at once), counts
the rows in each, and keeps the part with the target rank, narrowed to the values that occur. A percentile is resolved
when its interval holds one value. The result is the value of rank ceil(p * n): its error is zero. A state can be
compressed to a stated relative error; then it holds a bounded number of buckets and still adds up.

Defined results: null, NaN and infinite values are left out; groups without values give no row; the null group is a
group; ties and repeated values count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import discard, materialize

PARTS = 64
#: Basis points.
PERCENTILES = (500, 1000, 2500, 5000, 7500, 9000, 9500, 9900)


def state(df: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(grp, measure, value, n); grp is the struct of the group columns."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
    finite = "value is not null and not isnan(value) and abs(value) < double('Infinity')"
    return df.select(F.struct(*groups).alias("grp"), rows.alias("r")).select("grp", "r.measure", (F.col("r.value") + 0.0).alias("value")).where(finite).groupBy("grp", "measure", "value").agg(F.count("*").alias("n"))


def merge(*states: DataFrame) -> DataFrame:
    """The state of all row sets together."""
    return reduce(DataFrame.unionByName, states).groupBy("grp", "measure", "value").agg(F.sum("n").alias("n"))


def roll_up(s: DataFrame, *away: str) -> DataFrame:
    """The state with the named group columns combined into one group, whose values there are null."""
    whole = reduce(lambda g, name: g.withField(name, F.lit(None).cast(s.schema["grp"].dataType[name].dataType)), away, F.col("grp"))
    return merge(s.select(whole.alias("grp"), "measure", "value", "n"))


def compress(s: DataFrame, relative_error: float) -> DataFrame:
    """Values moved to the middle of logarithmic buckets: off by at most the part `relative_error`, and still additive."""
    gamma = (1 + relative_error) / (1 - relative_error)
    size = F.abs(F.col("value"))
    middle = F.pow(F.lit(gamma), F.ceil(F.log(size) / math.log(gamma))) * (2 / (1 + gamma))
    value = F.when(size > 0, F.signum("value") * middle).otherwise(0.0)
    return s.select("grp", "measure", value.alias("value"), "n").groupBy("grp", "measure", "value").agg(F.sum("n").alias("n"))


def percentiles(s: DataFrame, basis_points: Sequence[int] = PERCENTILES, parts: int = PARTS) -> DataFrame:
    """(grp, measure, basis_points, value, n) for each group and measure of a state."""
    s = materialize(s, "state")
    points = F.explode(F.array(*[F.lit(int(b)) for b in basis_points]))
    open_ = s.groupBy("grp", "measure").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("n")).select("grp", "measure", points.alias("basis_points"), "n", "low", "high", F.lit(0).cast("bigint").alias("below"))
    open_ = materialize(open_.withColumn("rank", F.greatest(F.lit(1), F.expr("(n * basis_points + 9999) div 10000"))), "intervals")
    used, done = [open_], []
    while True:
        done.append(open_.where("low = high"))
        open_ = open_.where("low < high")
        if open_.isEmpty():
            break
        open_ = materialize(_narrow(s, open_, parts), "intervals")
        used.append(open_)
    out = materialize(reduce(DataFrame.unionByName, done).select("grp", "measure", "basis_points", F.col("low").alias("value"), "n"), "percentiles")
    for old in (*used, s):
        discard(old)
    return out


def _narrow(s: DataFrame, open_: DataFrame, parts: int) -> DataFrame:
    """One pass. Halves avoid overflow; every step of the part's formula is monotone, so parts never overlap."""
    rows = s.select(F.col("grp").alias("g"), F.col("measure").alias("m"), "value", F.col("n").alias("k"))
    within = rows.join(open_, F.col("grp").eqNullSafe(F.col("g")) & (F.col("measure") == F.col("m")) & (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
    where = (F.col("value") * 0.5 - F.col("low") * 0.5) / (F.col("high") * 0.5 - F.col("low") * 0.5)
    target = ["grp", "measure", "basis_points"]
    counted = within.groupBy(*target, "rank", "n", "below", F.least(F.lit(parts - 1), F.floor(where * parts)).alias("part")).agg(F.sum("k").alias("k"), F.min("value").alias("low"), F.max("value").alias("high"))
    upto = F.sum("k").over(Window.partitionBy(*target).orderBy("part")) + F.col("below")
    return counted.withColumn("upto", upto).where("rank <= upto and rank > upto - k").select(*target, "n", "low", "high", (F.col("upto") - F.col("k")).alias("below"), "rank")


def questions_once(tc: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row per question id, its latest snapshot; repeated rows are equal."""
    best = F.max(F.struct("dump_snapshot_date", "site", F.substring("question_creation_datetime", 1, 7).alias("month"), *measures)).alias("r")
    return tc.where("question_id is not null").groupBy("question_id").agg(best).select("question_id", "r.*")
