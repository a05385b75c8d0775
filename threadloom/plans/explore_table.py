"""Loading a characteristic table for exploration: types, periods, invariants."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.ids import valid_timestamp
from threadloom.plans.characteristics import invariants
from threadloom.plans.columns import COLUMNS


@dataclass(frozen=True)
class Loaded:
    """The rows to explore and where they come from."""

    table: DataFrame
    rows_in_file: int
    rows_selected: int
    site: str | None
    snapshot: str | None
    analysis_end: str


def convert(df: DataFrame) -> DataFrame:
    """Text columns of a TSV in the contract's types; only empty text is null, bad values raise when read."""
    missing = [n for n, _ in COLUMNS if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    def typed(name: str, kind: str):
        c = F.when(F.col(name) != "", F.col(name))
        if kind == "boolean":
            low = F.lower(F.trim(c))
            bad = F.raise_error(F.concat(F.lit(f"{name}: not a flag: "), c)).cast("boolean")
            return F.when(c.isNull(), F.lit(None)).when(low == "true", True).when(low == "false", False).otherwise(bad)
        return c if kind == "string" else c.cast(kind)

    known = {n for n, _ in COLUMNS}
    return df.select(*[typed(n, k).alias(n) for n, k in COLUMNS], *[c for c in df.columns if c not in known])


def select_period(table: DataFrame, mode: str = "all", start: str | None = None, end: str | None = None, start_year: int | None = None, end_year: int | None = None) -> tuple[DataFrame, str]:
    """The rows of the period and the last day of analysis. Settings of other modes must be left out."""
    given = {"start": start, "end": end, "start_year": start_year, "end_year": end_year}
    wanted = {"all": set(), "date_range": {"start", "end"}, "year_range": {"start_year", "end_year"}}
    if mode not in wanted:
        raise ValueError(f"unknown period mode {mode!r}")
    if {k for k, v in given.items() if v is not None} != wanted[mode]:
        raise ValueError(f"period mode {mode} takes exactly {sorted(wanted[mode]) or 'no settings'}")
    asked = F.to_date(valid_timestamp("question_creation_datetime"))
    snap = table.agg(F.max("dump_snapshot_date").cast("string")).first()[0]
    if mode == "date_range":
        if start > end:
            raise ValueError("start is after end")
        rows, last = table.where(asked.between(F.lit(start).cast("date"), F.lit(end).cast("date"))), min(end, snap or end)
    elif mode == "year_range":
        if start_year > end_year:
            raise ValueError("start_year is after end_year")
        rows, last = table.where(F.year(asked).between(start_year, end_year)), min(f"{end_year}-12-31", snap or f"{end_year}-12-31")
    else:
        rows, last = table, table.agg(F.max(asked).cast("string")).first()[0]
    return rows, last


def load(table: DataFrame, check: bool = True, **period) -> Loaded:
    """Invariants hold for the whole table before the period is cut."""
    if check:
        broken = [f"{r['rule']} ({r['rows']})" for r in invariants(table).where("rows > 0").orderBy("rule").collect()]
        if broken:
            raise ValueError("the table breaks rules: " + ", ".join(broken))
    rows, last = select_period(table, **period)
    n, total = rows.count(), table.count()
    if not n:
        raise ValueError("no question in the period")
    one = rows.agg(F.min("site").alias("site"), F.min("dump_snapshot_date").cast("string").alias("snapshot")).first()
    return Loaded(rows, total, n, one["site"], one["snapshot"], last)


def dataset_summary(loaded: Loaded) -> DataFrame:
    rows = [("site", loaded.site), ("snapshot", loaded.snapshot), ("rows in file", str(loaded.rows_in_file)), ("rows selected", str(loaded.rows_selected)), ("last day of analysis", loaded.analysis_end)]
    return loaded.table.sparkSession.createDataFrame(rows, "item string, value string")


def checked_settings(data: str, export: str | None = None, *, min_tag_questions: int = 20, top_tags: int = 20, min_observations: int = 20, min_absolute_rho: float = 0.30, alpha: float = 0.05, max_pairs: int = 20, max_cases: int = 8) -> dict:
    """The settings of an exploration, or an error that names the first bad one."""
    for name, value in (("min_tag_questions", min_tag_questions), ("top_tags", top_tags), ("min_observations", min_observations), ("max_pairs", max_pairs), ("max_cases", max_cases)):
        if isinstance(value, bool) or not isinstance(value, int) or value < (3 if name == "min_observations" else 1):
            raise ValueError(f"{name} must be a whole number of at least {3 if name == 'min_observations' else 1}: {value!r}")
    for name, value in (("min_absolute_rho", min_absolute_rho), ("alpha", alpha)):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"{name} must be a number: {value!r}")
    if not 0 <= min_absolute_rho <= 1 or not 0 < alpha <= 1:
        raise ValueError("min_absolute_rho must be in [0, 1] and alpha in (0, 1]")
    if export is not None and os.path.realpath(export) == os.path.realpath(data):
        raise ValueError("the export would overwrite the data")
    return {"min_tag_questions": min_tag_questions, "top_tags": top_tags, "min_observations": min_observations, "min_absolute_rho": min_absolute_rho, "alpha": alpha, "max_pairs": max_pairs, "max_cases": max_cases}


def run_status(spark: SparkSession, steps: dict[str, DataFrame]) -> DataFrame:
    """(position, step, status, rows): each step of an exploration, whether it had rows or was left out for want of data. One job."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("position"), F.lit(name).alias("step"), "rows") for i, (name, df) in enumerate(steps.items())]
    if not counts:
        return spark.createDataFrame([], "position int, step string, status string, rows bigint")
    return reduce(DataFrame.unionByName, counts).select("position", "step", F.when(F.col("rows") > 0, "completed").otherwise("no data").alias("status"), "rows")


def status_tally(status: DataFrame) -> DataFrame:
    """(status, steps): how many steps ended in each way."""
    return status.groupBy("status").agg(F.count("*").alias("steps"))
