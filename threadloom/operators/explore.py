"""Descriptive analyses of a one-row-per-question table: outcomes, periods, cohorts, distributions, outliers, tags."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import split_tags
from threadloom.operators.quantiles import exact_quantiles


def percent(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def count_if(c: Column) -> Column:
    return F.count_if(c).cast("bigint")


def tally(df: DataFrame, conditions: dict[str, Column], name: str = "outcome") -> DataFrame:
    """(name, questions, percentage): rows that meet each condition and their part of all rows. One pass."""
    one = df.agg(F.count("*").alias("_all"), *[count_if(c).alias(k) for k, c in conditions.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias(name), F.col(k).alias("questions")) for i, k in enumerate(conditions)]))
    return one.select("_all", rows.alias("r")).select("r.position", f"r.{name}", "r.questions", percent(F.col("r.questions"), F.col("_all")).alias("percentage"))


def availability(df: DataFrame, labels: dict[str, str], limit: int | None = None) -> DataFrame:
    """Present values of each measurement, the least available first; ties keep the order of the labels."""
    out = tally(df, {label: F.col(c).isNotNull() for c, label in labels.items()}, "measurement").withColumnRenamed("questions", "available").orderBy("percentage", "position")
    return out.limit(limit) if limit else out


def spine(df: DataFrame, period: str, unit: str) -> DataFrame:
    """All periods from the first to the last of a date column."""
    ends = df.agg(F.min(period).alias("a"), F.max(period).alias("b")).where("a is not null")
    return ends.select(F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias(period))


def by_period(df: DataFrame, date: Column, unit: str, measures: dict[str, Column]) -> DataFrame:
    """(period, questions, each measure) with zeros for periods without rows."""
    counted = df.withColumn("period", F.trunc(date, "MM" if unit == "month" else "YYYY")).where("period is not null").groupBy("period").agg(F.count("*").alias("questions"), *[count_if(c).alias(k) for k, c in measures.items()])
    return spine(counted, "period", unit).join(counted, "period", "left").fillna(0)


def cumulative(df: DataFrame, events: dict[str, Column], analysis_end: Column) -> DataFrame:
    """(month, running count of each event): events up to analysis_end, on one spine of months.

    Each event is counted per month first, so the running sum orders months, never rows.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("event"), c.alias("at")) for k, c in events.items()]))
    monthly = df.select(rows.alias("r"), analysis_end.alias("_end")).where("r.at is not null and to_date(r.at) <= _end").select(F.trunc("r.at", "MM").alias("month"), "r.event").groupBy("month").agg(*[count_if(F.col("event") == k).alias(k) for k in events])
    ends = monthly.agg(F.min("month").alias("a")).join(df.agg(F.trunc(F.max(analysis_end), "MM").alias("b")), F.lit(True)).where("a is not null")
    months = ends.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    running = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return months.join(monthly, "month", "left").fillna(0).select("month", *[F.sum(k).over(running).alias(k) for k in events])


def cohorts(df: DataFrame, asked: Column, answered: Column, analysis_end: Column) -> DataFrame:
    """(cohort_month, observation_month, cohort_size, answered, answered_percentage) for every month since the cohort's."""
    base = df.select(F.trunc(asked, "MM").alias("cohort_month"), F.when(F.to_date(answered) <= analysis_end, F.trunc(answered, "MM")).alias("answer_month"), analysis_end.alias("_end")).where("cohort_month is not null")
    counted = base.groupBy("cohort_month", "answer_month").agg(F.count("*").alias("n"), F.max("_end").alias("_end"))
    sizes = counted.groupBy("cohort_month").agg(F.sum("n").alias("cohort_size"), F.trunc(F.max("_end"), "MM").alias("_last"))
    grid = sizes.where("_last >= cohort_month").select("cohort_month", "cohort_size", F.explode(F.expr("sequence(cohort_month, _last, interval 1 month)")).alias("observation_month"))
    hits = counted.where("answer_month is not null").select("cohort_month", F.greatest("answer_month", "cohort_month").alias("observation_month"), "n").groupBy("cohort_month", "observation_month").agg(F.sum("n").alias("n"))
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("cohort_month").orderBy("observation_month"))
    out = grid.join(hits, ["cohort_month", "observation_month"], "left").withColumn("answered", running)
    return out.select("cohort_month", "observation_month", "cohort_size", "answered", percent(F.col("answered"), F.col("cohort_size")).alias("answered_percentage"))


def cohort_summary(evolution: DataFrame) -> DataFrame:
    """Per cohort: answered in its own month and by the end."""
    own = F.max(F.when(F.col("observation_month") == F.col("cohort_month"), F.col("answered")))
    return evolution.groupBy("cohort_month").agg(F.max("cohort_size").alias("cohort_size"), own.alias("same_month"), F.max("answered").alias("by_end")).select("*", percent(F.col("same_month"), F.col("cohort_size")).alias("same_month_percentage"), percent(F.col("by_end"), F.col("cohort_size")).alias("by_end_percentage"))


PROFILE = "measurement string, available bigint, low double, high double, displayed bigint, below bigint, above bigint, minimum double, median double, maximum double, edges array<double>"


@dataclass(frozen=True)
class Spec:
    """How one measurement's distribution is shown."""

    column: str
    coverage: float = 0.99
    signed: bool = False
    whole: bool = True
    figure: str = ""
    title: str = ""


def distribution_profiles(df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """One row per measurement: disclosed range, what lies outside it, bins. All measurements share each pass."""
    for s in specs:
        if not 0.5 <= s.coverage < 1:
            raise ValueError(f"coverage of {s.column} must be in [0.5, 1)")
    of = {s.column: s for s in specs}
    quantiles = exact_quantiles(df, {c: ((1 - s.coverage) / 2, 1 - (1 - s.coverage) / 2, 0.5) if s.signed else (s.coverage, 0.5) for c, s in of.items()})
    ends = df.agg(*[F.struct(F.count(F.col(c)).alias("n"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("most")).alias(c) for c in of]).first()
    known, shown = [], []
    for s in specs:
        e, q = ends[s.column], quantiles[s.column]
        if not e["n"]:
            continue
        low, high = (q[0], q[1]) if s.signed else (max(0.0, e["least"]), q[0])
        if s.whole:
            low, high = float(math.floor(low)), float(math.ceil(high))
        if high <= low:
            high = max(e["most"], low + 1)
        known.append((s, {**e.asDict(), "median": q[-1]}, low, high))
        c = F.col(s.column).cast("double")
        inside = F.when((c >= low) & (c <= high), c)
        shown += [inside.alias(s.column), (c < low).alias(f"{s.column}_below"), (c > high).alias(f"{s.column}_above")]
    if not known:
        return df.sparkSession.createDataFrame([], PROFILE)
    displayed = df.select(*shown)
    quartiles = exact_quantiles(displayed, {s.column: (0.25, 0.75) for s, *_ in known})
    tallies = displayed.agg(*[F.struct(F.count(s.column).alias("displayed"), count_if(F.col(f"{s.column}_below")).alias("below"), count_if(F.col(f"{s.column}_above")).alias("above"), F.min(s.column).alias("a"), F.max(s.column).alias("b")).alias(s.column) for s, *_ in known]).first()
    counts = {s.column: {**tallies[s.column].asDict(), "q1": quartiles[s.column][0], "q3": quartiles[s.column][1]} for s, *_ in known}
    rows = []
    for s, r, low, high in known:
        k = counts[s.column]
        edges = bin_edges(s.whole, low, high, k)
        rows.append((s.column, r["n"], float(low), float(high), k["displayed"], k["below"], k["above"], r["least"], r["median"], r["most"], edges))
    return df.sparkSession.createDataFrame(rows, PROFILE)


def distribution_summary(profiles: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """The accounting of each figure in the order of the specifications; a measurement without values is unavailable."""
    all_specs = profiles.sparkSession.createDataFrame([(i, s.figure, s.title, s.column) for i, s in enumerate(specs)], "position int, figure string, title string, measurement string")
    shown = F.concat(F.format_number("low", 1), F.lit(" to "), F.format_number("high", 1))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("available", "displayed", "below", "above")]
    return all_specs.join(profiles.drop("edges"), "measurement", "left").select("position", "figure", F.col("title").alias("measurement"), *counts, percent(F.col("displayed"), F.col("available")).alias("displayed_percentage"), "median", F.coalesce(shown, F.lit("Unavailable")).alias("shown_range"), "minimum", "maximum")


def axis_shares(counted: DataFrame, value: str) -> DataFrame:
    """Every value against the largest of all rows, as bars are scaled. The largest is one row, never a window over all."""
    return counted.join(counted.agg(F.max(value).alias("largest")), F.lit(True)).withColumn("share_of_largest", F.round(F.try_divide(F.col(value).cast("double"), F.col("largest")), 6))


def outlier_dataset(flagged: DataFrame, columns: Sequence[str], labels: dict[str, str]) -> DataFrame:
    """The flagged rows with the source's columns, how many measurements are high and their names."""
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{c}_high"), F.lit(label)) for c, label in labels.items()])), "; ")
    return flagged.where("high_count > 0").select(*columns, F.col("high_count").alias("high_outlier_field_count"), names.alias("high_outlier_measurements"))


def bin_edges(whole: bool, low: float, high: float, k) -> list[float]:
    """Unit bins for short whole ranges, else equal bins, their number by the interquartile rule within 8 to 30."""
    if whole and high - low <= 30:
        return [low - 0.5 + i for i in range(int(high - low) + 2)]
    if not k["displayed"] or k["a"] == k["b"]:
        return [low, low + 1] if high <= low else [low - 0.5, low + 0.5]
    width = 2 * (k["q3"] - k["q1"]) / k["displayed"] ** (1 / 3)
    n = -int(-((k["b"] - k["a"]) / width) // 1) if width > 0 else 1
    n = min(30, max(8, n))
    return [low + (high - low) * i / n for i in range(n + 1)]


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over equal bins of [low, high], the last one closed; bins without rows are 0."""
    c = F.col(column).cast("double")
    place = F.least(F.lit(bins - 1), F.floor((c - low) / (high - low) * bins)).cast("int")
    counted = df.where((c >= low) & (c <= high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").fillna(0, ["n"])


def high_fences(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(measurement, available, q1, q3, fence, outliers, share): the upper fence q3 + 1.5 (q3 - q1) of each column."""
    quartiles = exact_quantiles(df, {c: (0.25, 0.75) for c in columns})
    known = [(i, c, *quartiles[c], quartiles[c][1] + 1.5 * (quartiles[c][1] - quartiles[c][0])) for i, c in enumerate(columns) if quartiles[c][0] is not None]
    fences = df.sparkSession.createDataFrame(known, "position int, measurement string, q1 double, q3 double, fence double")
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("measurement"), F.col(c).cast("double").alias("value")) for c in columns]))
    counted = df.select(values.alias("v")).select("v.*").join(F.broadcast(fences), "measurement").groupBy("position", "measurement", "q1", "q3", "fence").agg(F.count("value").alias("available"), count_if(F.col("value") > F.col("fence")).alias("outliers"))
    return counted.withColumn("share", percent(F.col("outliers"), F.col("available")))


def with_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with a Boolean `<column>_high` for each column, `high_count` and `high_names`. A null is never high."""
    quartiles = exact_quantiles(df, {c: (0.25, 0.75) for c in columns})
    flags = {}
    for c in columns:
        q = quartiles[c]
        flags[c] = F.coalesce(F.col(c).cast("double") > F.lit(q[1] + 1.5 * (q[1] - q[0])), F.lit(False)) if q[0] is not None else F.lit(False)
    total = reduce(lambda a, b: a + b, [f.cast("int") for f in flags.values()])
    names = F.array_join(F.array_compact(F.array(*[F.when(f, F.lit(c)) for c, f in flags.items()])), "; ")
    return df.select("*", *[f.alias(f"{c}_high") for c, f in flags.items()], total.alias("high_count"), names.alias("high_names"))


def flag_histogram(flagged: DataFrame, k: int) -> DataFrame:
    """(high_count, questions) for 0..k, zeros included."""
    counted = flagged.groupBy("high_count").agg(F.count("*").alias("questions"))
    return flagged.sparkSession.range(k + 1).select(F.col("id").cast("int").alias("high_count")).join(counted, "high_count", "left").fillna(0, ["questions"])


GROUPS = ("one or more high", "none high")


def group_label(flagged: Column) -> Column:
    return F.when(flagged, GROUPS[0]).otherwise(GROUPS[1])


def group_outcomes(flagged: DataFrame, outcomes: dict[str, Column]) -> DataFrame:
    """(grp, group_size, outcome, questions, percentage) for both groups, also an empty one (its percentages are null)."""
    counted = flagged.groupBy(group_label(F.col("high_count") > 0).alias("grp")).agg(F.count("*").alias("group_size"), *[count_if(c).alias(k) for k, c in outcomes.items()])
    both = flagged.sparkSession.createDataFrame([(g,) for g in GROUPS], "grp string").join(counted, "grp", "left").fillna(0)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("outcome"), F.col(k).alias("questions")) for k in outcomes]))
    return both.select("grp", "group_size", rows.alias("r")).select("grp", "group_size", "r.*").withColumn("percentage", percent(F.col("questions"), F.col("group_size")))


def tag_rows(df: DataFrame, tags: str, *columns: str) -> DataFrame:
    """One row per question and distinct tag, with what else is needed: no join back."""
    return df.select(*columns, F.explode(split_tags(tags)).alias("tag"))


def tag_outcomes(df: DataFrame, tags: str, outcomes: dict[str, Column]) -> DataFrame:
    """(tag, questions, each outcome, unanswered, percentages); rows are distinct questions."""
    rows = df.select(F.explode(split_tags(tags)).alias("tag"), *[c.alias(k) for k, c in outcomes.items()])
    out = rows.groupBy("tag").agg(F.count("*").alias("questions"), *[count_if(F.col(k)).alias(k) for k in outcomes])
    out = out.withColumn("unanswered", F.col("questions") - F.col("answered")) if "answered" in outcomes else out
    return out.select("*", *[percent(F.col(k), F.col("questions")).alias(f"{k}_percentage") for k in outcomes])


def tag_prevalence(flagged: DataFrame, tags: str, limit: int | None = None) -> DataFrame:
    """Each tag's part of the questions with and without a high measurement, and the difference in points."""
    sizes = flagged.agg(count_if(F.col("high_count") > 0).alias("_high"), count_if(F.col("high_count") == 0).alias("_rest"))
    rows = tag_rows(flagged, tags, "high_count").groupBy("tag").agg(count_if(F.col("high_count") > 0).alias("high"), count_if(F.col("high_count") == 0).alias("rest"))
    both = rows.join(sizes, F.lit(True))  # sizes is one row
    out = both.select("tag", "high", "rest", percent(F.col("high"), F.col("_high")).alias("high_prevalence"), percent(F.col("rest"), F.col("_rest")).alias("rest_prevalence"))
    out = out.withColumn("difference", F.round(F.col("high_prevalence") - F.col("rest_prevalence"), 6))
    return out.orderBy(F.desc("high"), "tag").limit(limit).orderBy("high_prevalence", "tag") if limit else out


def inspection_cases(flagged: DataFrame, delay: str, comments: str, key: str, title: str, limit: int = 8) -> DataFrame:
    """The rows most worth a look: most flags, longest delay, most comments; the key breaks ties."""
    top = flagged.where("high_count > 0").orderBy(F.desc("high_count"), F.desc_nulls_last(delay), F.desc_nulls_last(comments), key).limit(limit)
    return top.select(key, F.substring(F.coalesce(title, F.lit("")), 1, 90).alias("title"), "high_count", delay, comments)


def extremes(df: DataFrame, value: str, *position: str) -> DataFrame:
    """The rows with the largest and the least value, the first on ties."""
    top = df.orderBy(F.desc(value), *position).limit(1).withColumn("extreme", F.lit("largest"))
    return top.unionByName(df.orderBy(value, *position).limit(1).withColumn("extreme", F.lit("least")))
