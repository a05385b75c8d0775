"""Rank correlations of many column pairs with false-discovery control."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import materialize

SCHEMA = "position int, first string, second string, observations bigint, rho double, p_value double"


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny) if abs(1 - (a + b) * x / (a + 1)) > tiny else 1 / tiny
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def two_sided_p(rho: float, n: int) -> float:
    """Of Student's t with n - 2 degrees of freedom."""
    if n <= 2:
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def running_counts(counts: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """(group, value, n, upto): the running sum of n by value. Approximate cut points, forty for each group,
    part the values, so no task orders all of them; the sums stay exact wherever the cuts fall."""
    cuts = counts.groupBy(group).agg(F.expr(f"percentile_approx(`{value}`, array({', '.join(str(i / 40) for i in range(1, 40))}), 1000)").alias("_cuts"))
    parted = counts.join(cuts, group).select(group, value, n, F.expr(f"size(filter(_cuts, x -> x < `{value}`))").alias("_part"))
    before = F.sum("_sum").over(Window.partitionBy(group).orderBy("_part")) - F.col("_sum")
    sums = parted.groupBy(group, "_part").agg(F.sum(n).alias("_sum")).select(group, "_part", before.alias("_before"))
    within = F.sum(n).over(Window.partitionBy(group, "_part").orderBy(value))
    return parted.withColumn("_within", within).join(sums, [group, "_part"]).select(group, value, n, (F.col("_within") + F.col("_before")).alias("upto"))


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ranks of each column, ties averaged, by running counts of its distinct values."""
    out = df
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.lit(0).alias("_g"), F.col(c).alias("_value")).agg(F.count("*").alias("_n"))
        ranked = running_counts(counts, "_g", "_value", "_n").select("_value", (F.col("upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(f"_rank_{c}"))
        out = out.join(ranked, F.col(c) == F.col("_value"), "left").drop("_value")
    return out


def rank_correlations(df: DataFrame, columns: Sequence[str], excluded: Sequence[tuple[str, str]] = (), least: int = 20) -> DataFrame:
    """(position, first, second, observations, rho, p_value) of every pair with enough complete rows and two values on both sides.

    Columns are brought into one long table of (pair, x, y) counts, so all pairs are ranked in one shuffle; the number
    of pairs depends on the columns alone.
    """
    skip = {frozenset(p) for p in excluded}
    pairs = [p for p in combinations(columns, 2) if frozenset(p) not in skip]
    if not pairs:
        return df.sparkSession.createDataFrame([], SCHEMA)
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)]))
    both = df.select(items.alias("i")).select("i.*").where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("pair", "x", "y").agg(F.count("*").alias("n"))
    both = materialize(both, "value-pairs")

    def ranks(c: str) -> DataFrame:
        counts = running_counts(both.groupBy("pair", c).agg(F.sum("n").alias("k")), "pair", c, "k")
        return counts.select(F.col("pair").alias(f"p_{c}"), F.col(c).alias(f"v_{c}"), (F.col("upto") - (F.col("k") - 1) / F.lit(2.0)).alias(f"r_{c}"))

    joined = both
    for c in ("x", "y"):
        joined = joined.join(ranks(c), (F.col("pair") == F.col(f"p_{c}")) & (F.col(c) == F.col(f"v_{c}")))
    n, x, y = F.col("n"), F.col("r_x"), F.col("r_y")
    # ranks are centred before they are multiplied, so large counts lose no digits
    total = both.groupBy("pair").agg(F.sum("n").alias("observations"))
    centred = joined.join(total, "pair").withColumns({"dx": x - (F.col("observations") + 1) / 2, "dy": y - (F.col("observations") + 1) / 2})
    sums = centred.groupBy("pair").agg(F.max("observations").alias("observations"), F.sum(n * F.col("dx") * F.col("dy")).alias("xy"), F.sum(n * F.col("dx") * F.col("dx")).alias("xx"), F.sum(n * F.col("dy") * F.col("dy")).alias("yy"))
    rows = []
    for r in sums.where(f"observations >= {least} and xx > 0 and yy > 0").orderBy("pair").collect():  # at most one row per pair of columns
        rho = max(-1.0, min(1.0, r["xy"] / math.sqrt(r["xx"] * r["yy"])))
        rows.append((r["pair"], *pairs[r["pair"]], r["observations"], rho, two_sided_p(rho, r["observations"])))
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def false_discovery(df: DataFrame, p: str = "p_value") -> DataFrame:
    """q_value by Benjamini and Hochberg, for any number of rows.

    Rows are counted by p-value; approximate cuts part the values into ranges, ranks are running counts over the ranges,
    and the least quotient of all higher ranks is that of the later ranges and of the rest of the own range. Equal
    p-values get the quotient of the last of them, which is the least.
    """
    total = df.where(F.col(p).isNotNull()).agg(F.count("*").alias("_n"))
    counts = df.where(F.col(p).isNotNull()).groupBy(F.lit(0).alias("_g"), F.col(p).alias("_p")).agg(F.count("*").alias("_k"))
    ranked = materialize(running_counts(counts, "_g", "_p", "_k").join(total, F.lit(True)).select("_p", "upto", (F.col("_p") * F.col("_n") / F.col("upto")).alias("_ratio")), "ratios")
    cuts = ranked.agg(F.expr(f"percentile_approx(_p, array({', '.join(str(i / 40) for i in range(1, 40))}), 1000)").alias("_cuts"))
    parted = ranked.join(cuts, F.lit(True)).select("_p", "_ratio", F.expr("size(filter(_cuts, x -> x < _p))").alias("_part"))
    ends = parted.groupBy("_part").agg(F.min("_ratio").alias("_least"))
    later = ends.select("_part", F.min("_least").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))  # forty rows
    within = F.min("_ratio").over(Window.partitionBy("_part").orderBy(F.desc("_p")))
    q = parted.withColumn("_within", within).join(later, "_part").select("_p", F.least(F.lit(1.0), "_within", "_later").alias("q_value"))
    return df.join(q, F.col(p) == F.col("_p"), "left").drop("_p")


def retained(df: DataFrame, least_rho: float = 0.30, alpha: float = 0.05, limit: int = 20, labels: dict[str, str] | None = None) -> DataFrame:
    """The strongest pairs below the false-discovery level, ordered by rho. Columns go by their labels where they have one."""
    kept = df.where((F.abs("rho") >= least_rho) & (F.col("q_value") <= alpha)).orderBy(F.desc(F.abs("rho")), "position").limit(limit)
    return kept.withColumn("pair_label", F.concat_ws(" / ", *[reduce(lambda c, kv: F.when(F.col(side) == kv[0], kv[1]).otherwise(c), (labels or {}).items(), F.col(side)) for side in ("first", "second")])).orderBy("rho", "position")
