"""References to records that do not exist (problem 7).

Parent keys are compressed into contiguous runs within fixed blocks of the key space. Distinct references are matched
as of the preceding run start in the same block: a key beyond that run's end has no parent. A run also carries the
latest arrival of its members, so only references older than that are looked up one by one to see whether the parent
came later. A block holds at most BLOCK keys whatever the data's size, and a key that many rows refer to is one key
until the rows are joined with the few flagged keys.

Defined results: attributes that refer to nothing are left out; references beyond int64 are missing; rows without a
valid id are left out; repeated rows are one record with its earliest arrival; unknown arrivals are never late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.ids import positive_id, reference, valid_timestamp
from threadloom.operators.skew import skew_join
from threadloom.session import materialize

BLOCK = 1 << 16


def key_runs(keys: DataFrame, key: str = "key", arrival: str = "loaded_at") -> DataFrame:
    """(block, start, stop, last_arrival) of contiguous keys; keys are distinct int64."""
    block = F.expr(f"`{key}` div {BLOCK}")
    place = F.row_number().over(Window.partitionBy("block").orderBy(key))
    return keys.select(block.alias("block"), F.col(key), F.col(arrival)).withColumn("island", F.col(key) - place).groupBy("block", "island").agg(F.min(key).alias("start"), F.max(key).alias("stop"), F.max(arrival).alias("last_arrival")).drop("island")


def match_runs(references: DataFrame, runs: DataFrame, key: str = "key") -> DataFrame:
    """The distinct references(key, earliest) with `present` and, for present ones, the run's `last_arrival`."""
    marks = runs.select("block", F.col("start").alias(key), F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("earliest"), "stop", "last_arrival").unionByName(
        references.select(F.expr(f"`{key}` div {BLOCK}").alias("block"), key, F.lit(1).alias("kind"), F.col("earliest").cast("timestamp_ntz"), F.lit(None).cast("bigint").alias("stop"), F.lit(None).cast("timestamp_ntz").alias("last_arrival"))
    )
    w = Window.partitionBy("block").orderBy(key, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    preceding = F.last(F.when(F.col("kind") == 0, F.struct("stop", "last_arrival")), ignorenulls=True).over(w)
    return marks.withColumn("run", preceding).where("kind = 1").select(key, "earliest", F.coalesce(F.col("run.stop") >= F.col(key), F.lit(False)).alias("present"), F.col("run.last_arrival").alias("last_arrival"))


def _records(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row per id: earliest arrival, and the attributes, which repeated rows share."""
    return (
        df.select(positive_id("id").alias("row_id"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), "creation_date", *fields)
        .where("row_id is not null")
        .groupBy("row_id")
        .agg(F.min("loaded_at").alias("loaded_at"), F.max("creation_date").alias("creation_date"), *[F.max(f).alias(f) for f in fields])
    )


def _references(df: DataFrame, source: str, fields: list[str]) -> DataFrame:
    pairs: list[Column] = [F.struct(F.lit(f).alias("field_name"), reference(f).alias("digits")) for f in fields]
    return (
        df.select(F.lit(source).alias("source_table"), "row_id", "loaded_at", "creation_date", F.explode(F.array(*pairs)).alias("r"))
        .where("r.digits is not null")
        .select("source_table", "row_id", F.col("r.field_name").alias("field_name"), F.col("r.digits").try_cast("bigint").alias("key"), "loaded_at", "creation_date")
    )


def orphans(posts: DataFrame, comments: DataFrame, removed: DataFrame) -> DataFrame:
    """(source_table, row_id, field_name, status, creation_date) of every reference that is missing, removed or late."""
    records = materialize(_records(posts, ["accepted_answer_id", "parent_id"]), "records")
    refs = materialize(_references(records, "posts", ["accepted_answer_id", "parent_id"]).unionByName(_references(_records(comments, ["post_id"]), "comments", ["post_id"])), "references")
    parents = records.select(F.col("row_id").alias("key"), "loaded_at")
    distinct = refs.where("key is not null").groupBy("key").agg(F.min("loaded_at").alias("earliest"))
    matched = materialize(match_runs(distinct, key_runs(parents)).where("not present or last_arrival > earliest"), "matched")
    gone = removed.select(F.col("post_id").cast("bigint").alias("key")).where("key is not null").distinct().withColumn("removed", F.lit(True))
    absent = matched.where("not present").join(gone, "key", "left").select("key", F.when(F.col("removed"), "removed").otherwise("missing").alias("status"), F.lit(None).cast("timestamp_ntz").alias("arrived"))
    suspect = matched.where("present").join(parents.select("key", F.col("loaded_at").alias("arrived")), "key").where("arrived > earliest").select("key", F.lit("late").alias("status"), "arrived")
    flagged = materialize(absent.unionByName(suspect), "flagged")
    columns = ["source_table", "row_id", "field_name", "status", "creation_date"]
    # the few flagged keys; one that very many rows refer to is spread over tasks
    named = skew_join(refs.where("key is not null"), flagged, "key", "row_id").where("arrived is null or arrived > loaded_at").select(*columns)
    beyond = refs.where("key is null").withColumn("status", F.lit("missing")).select(*columns)
    return named.unionByName(beyond)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, month of creation_date (null where that is no date) and status."""
    month = F.date_format(valid_timestamp("creation_date"), "yyyy-MM").alias("month")
    return found.select("source_table", "field_name", month, "status").groupBy("source_table", "field_name", "month", "status").agg(F.count("*").alias("orphans"))
