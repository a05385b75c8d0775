"""Joins whose left side may have a few very frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this part of the rows, so there are never more than SHARE hot keys.
SHARE = 256
#: Rows below which a key is no burden for one task.
LEAST_ROWS = 50_000


def hot_keys(df: DataFrame, key: str, share: int = SHARE, least: int = LEAST_ROWS) -> list:
    """Keys with more than 1/share of the rows and more than `least` rows: at most `share` values."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least)
    total = None
    out = []
    for r in counted.orderBy(F.desc("n")).limit(share).collect():
        total = total or df.count()
        if r["n"] * share > total:
            out.append(r[key])
    return out


def skew_join(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 32, how: str = "inner", hot: list | None = None) -> DataFrame:
    """left join right on key, right unique by key. Rows of hot keys are spread by the column `spread`; their few right rows are repeated."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
