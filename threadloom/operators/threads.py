"""Assembling threads: parents with their chronologically ordered children. All functions take column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.ids import TIMESTAMP, fraction_digits, valid_second


def distinct_records(df: DataFrame, key: str, order_by: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order_by))
    return df.where(F.col(key).isNotNull()).withColumn("_place", rank).where("_place = 1").drop("_place")


def chronological_key(date: str, id_number: str) -> list[Column]:
    """Exact order of dump rows: second, all fraction digits, numeric id."""
    return [valid_second(date), fraction_digits(date), F.col(id_number)]


def chronological_limit(df: DataFrame, date: str, id_number: str, n: int) -> DataFrame:
    return df.where(F.col(date).rlike(TIMESTAMP)).orderBy(*chronological_key(date, id_number)).limit(n)


def date_range(df: DataFrame, timestamp: Column, start: str, end: str) -> DataFrame:
    """From the first moment of start to the last of end, both days included."""
    return df.where((timestamp >= F.lit(start).cast("timestamp_ntz")) & (timestamp < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))


def first_child(children: DataFrame, parent: str, order_by: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """The first child of each parent. A minimum over structs: combined before the shuffle, no sort."""
    keys = [c if isinstance(c, Column) else F.col(c) for c in order_by]
    first = F.min(F.struct(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], *columns)).alias("_first")
    return children.where(F.col(parent).isNotNull()).groupBy(parent).agg(first).select(parent, *[F.col(f"_first.{c}").alias(c) for c in columns])


def child_counts(children: DataFrame, parent: str, **measures: Column) -> DataFrame:
    """Aggregates of the children of each parent, combined before the shuffle."""
    return children.where(F.col(parent).isNotNull()).groupBy(parent).agg(*[c.alias(n) for n, c in measures.items()])


def with_children(parents: DataFrame, key: str, aggregated: DataFrame, parent: str, zeros: Sequence[str] = ()) -> DataFrame:
    """Every parent once, with its children's aggregates; the named counts are 0 where there are none."""
    out = parents.join(aggregated.withColumnRenamed(parent, "_parent"), F.col(key) == F.col("_parent"), "left").drop("_parent")
    return out.fillna(0, subset=list(zeros)) if zeros else out


def keep_known(df: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    return df.join(ids.select(F.col(id_column).alias(key)).distinct(), key, "left_semi")


def unknown_ids(ids: DataFrame, id_column: str, df: DataFrame, key: str) -> DataFrame:
    return ids.select(id_column).distinct().join(df.select(F.col(key).alias(id_column)), id_column, "left_anti")


def competition_rank(df: DataFrame, key: str, score: str) -> Column:
    """1 + how many rows of the key score higher; null scores rank nothing."""
    return F.when(F.col(score).isNotNull(), F.rank().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(score))).cast("bigint"))


def earliest_day(events: DataFrame, key: str, day: Column, kind: Column) -> DataFrame:
    """The first day of each key among rows of one kind."""
    return events.where(kind).groupBy(key).agg(F.min(day).alias("first_day"))


def requested(ids: Sequence[str]) -> list[str]:
    """Requested ids without leading zeros, each once, in the order of their first occurrence."""
    out: dict[str, None] = {}
    for raw in ids:
        text = str(raw).strip()
        if not (text.isascii() and text.isdigit() and int(text)):
            raise ValueError(f"not a positive id: {raw!r}")
        out[str(int(text))] = None
    if not out:
        raise ValueError("no ids requested")
    return list(out)


def nested_threads(questions: DataFrame, answers: DataFrame, comments: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str], comment_columns: Sequence[str]) -> DataFrame:
    """(key, question, comments, answers): children as arrays in chronological order, empty where there are none.

    answers and comments carry the question's id as `parent`. For requested threads, so an array is one thread long.
    """

    def gathered(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
        item = F.struct(*[k.alias(f"_k{i}") for i, k in enumerate(order)], F.struct(*cols).alias("row"))
        return df.groupBy("parent").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["row"]).alias(name))

    a, c = gathered(answers, columns, "answers"), gathered(comments, comment_columns, "comments")
    out = questions.select(F.col(key).alias("parent"), F.struct(*columns).alias("question")).join(c, "parent", "left").join(a, "parent", "left")
    empty = lambda n: F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)).alias(n)
    return out.select(F.col("parent").alias(key), "question", empty("comments"), empty("answers"))
