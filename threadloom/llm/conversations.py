"""Rebuilding conversations from message rows (problem 6) with keyed streaming state.

Questions, answers and comments become message rows with the conversation they belong to. The stream buffers the messages
of each open conversation in keyed state; when the watermark passes a conversation's last arrival by `patience`, its
messages are emitted and leave the state. State is keyed by shard, a hash of conversation and part of the message id: a
call works on all conversations of a shard at once in arrays, not on one key at a time, and a conversation of very many
messages is spread over up to `spread` shards, each part closing by its own last arrival. The emitted parts of a
conversation add up: it is validated from what all its parts have seen, also when late messages reopened it.

`replay` drives the stream over finite tables: messages are released in the order of their arrival, each release one or
more micro-batches, and a closing run of its own moves the watermark past everything at the end. A comment arrives in its
conversation when both it and its post are there.

Defined results: a conversation comes out once for each reason for which it is broken, and not at all when it is
sound; rows without a valid id are no messages; references beyond int64 name no conversation; repeated rows change
nothing; empty tables give no rows; messages without arrival count as arrived first. In a live stream rows later than
`lateness` are dropped, as a watermark means; a replay has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.functions.ids import instant_text, positive_id, reference_number, shows_something
from threadloom.operators.skew import skew_join
from threadloom.session import discard, fresh_path, materialize

QUESTION, ANSWER, COMMENT = 1, 2, 3
MESSAGE = "conversation_id bigint, message_id bigint, kind int, user string, said_at string, shown boolean, loaded_at timestamp"
EARLY, LATEST, CLOSING = "1970-01-02 00:00:00", "2199-01-01 00:00:00", "2200-01-01 00:00:00"
SPREAD = 16
RELEASES = 3


def _arrival():
    early, late = F.lit(EARLY).cast("timestamp"), F.lit(LATEST).cast("timestamp")
    return F.greatest(early, F.least(late, F.coalesce(F.col("loaded_at").cast("timestamp"), early))).alias("loaded_at")


def post_messages(posts: DataFrame) -> DataFrame:
    """Questions and answers as message rows."""
    question = F.col("post_type_id") == "1"
    rows = posts.where("post_type_id in ('1', '2')").select(
        F.when(question, positive_id("id")).otherwise(reference_number("parent_id")).alias("conversation_id"), positive_id("id").alias("message_id"), F.when(question, QUESTION).otherwise(ANSWER).alias("kind"),
        F.col("owner_user_id").alias("user"), instant_text("creation_date").alias("said_at"), shows_something("body").alias("shown"), _arrival(),
    )
    return rows.where("message_id is not null and conversation_id is not null")


def comment_messages(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments as message rows; posts are message rows. A post with very many comments is spread over tasks."""
    rows = comments.select(
        reference_number("post_id").alias("post_id"), positive_id("id").alias("message_id"), F.lit(COMMENT).alias("kind"),
        F.col("user_id").alias("user"), instant_text("creation_date").alias("said_at"), F.col("text").isNotNull().alias("shown"), _arrival(),
    ).where("message_id is not null and post_id is not null")
    keys = posts.groupBy(F.col("message_id").alias("post_id"), "conversation_id").agg(F.min("loaded_at").alias("known"))
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    return skew_join(rows, keys, "post_id", "message_id").withColumn("loaded_at", F.greatest("loaded_at", "known")).select(names)


def message_rows(posts: DataFrame, comments: DataFrame) -> DataFrame:
    own = post_messages(posts)
    return own.unionByName(comment_messages(comments, own))


_ARROW = pa.schema([("conversation_id", pa.int64()), ("message_id", pa.int64()), ("kind", pa.int32()), ("user", pa.string()), ("said_at", pa.string()), ("shown", pa.bool_()), ("loaded_at", pa.timestamp("us"))])


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _ARROW) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def closures(messages: DataFrame, patience: str = "30 days", lateness: str = "7 days", shards: int | None = None, spread: int = SPREAD) -> DataFrame:
    """The streaming plan: the buffered messages of each conversation of a stream of message rows, emitted when it closes."""
    shards = shards or 4 * int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = [pa.Table.from_pandas(f, schema=_ARROW, preserve_index=False) for f in frames]
        held = [pa.ipc.open_stream(state.get[0]).read_all()] if state.exists else []
        rows = pa.concat_tables([_ARROW.empty_table(), *held, *new])
        if not rows.num_rows:
            return
        at = rows["loaded_at"].to_numpy().astype("datetime64[ms]").astype(np.int64)
        _, owner = np.unique(rows["conversation_id"].to_numpy(), return_inverse=True)
        last = np.full(owner.max() + 1, np.iinfo(np.int64).min)
        np.maximum.at(last, owner, at)
        ends = last + wait + 1
        still = ends > state.getCurrentWatermarkMs()
        if still.any():
            state.update((_packed(rows.filter(pa.array(still[owner]))),))
            state.setTimeoutTimestamp(int(ends[still].min()))
        else:
            state.remove()
        if not still.all():
            yield rows.filter(pa.array(~still[owner])).to_pandas()

    keyed = messages.withWatermark("loaded_at", lateness).withColumn("shard", F.pmod(F.xxhash64("conversation_id", F.pmod("message_id", F.lit(spread))), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInPandasWithState(step, MESSAGE, "open binary", "append", GroupStateTimeout.EventTimeTimeout)


def replay(messages: DataFrame, releases: int = RELEASES, **how) -> DataFrame:
    """All messages as the stream emits them when they are released by arrival."""
    spark = messages.sparkSession
    messages = materialize(messages, "messages")
    cuts = messages.agg(F.percentile_approx(F.unix_micros("loaded_at"), [i / releases for i in range(1, releases)] or [0.5])).first()[0]
    bounds = [None, *sorted(set(cuts or []))[: releases - 1], None]
    inbox, out, log = fresh_path(spark, "inbox"), fresh_path(spark, "conversations"), fresh_path(spark, "stream")
    closing = spark.range(1).select(F.lit(0).cast("bigint").alias("conversation_id"), F.col("id").alias("message_id"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("user"), F.lit(None).cast("string").alias("said_at"), F.lit(False).alias("shown"), F.lit(CLOSING).cast("timestamp").alias("loaded_at"))
    at = F.unix_micros("loaded_at")
    slices = [messages.where((at > (a if a is not None else -(1 << 62))) & (at <= (b if b is not None else 1 << 62))) for a, b in zip(bounds, bounds[1:])]
    for arrived in [*slices, closing]:
        arrived.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(messages.schema).parquet(inbox)
        query = closures(stream, **how).writeStream.format("parquet").option("checkpointLocation", log).option("path", out).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    discard(messages)
    return spark.read.schema(MESSAGE).parquet(out).where("kind <> 0")


def validate(closed: DataFrame) -> DataFrame:
    """(conversation_id, reason) of the broken conversations among emitted messages."""
    question, answer = F.col("kind") == QUESTION, F.col("kind") == ANSWER
    whole = closed.groupBy("conversation_id").agg(
        F.bool_or(question).alias("asked"), F.bool_or(question & ~F.col("shown")).alias("empty"), F.bool_or(answer).alias("answered"), F.bool_or(answer & F.col("shown")).alias("replied"), F.bool_or(F.col("said_at").isNull()).alias("undated"),
        F.min(F.when(question, F.col("said_at"))).alias("question_at"), F.min(F.when(~question, F.col("said_at"))).alias("reply_at"),
    )
    held = F.array(
        F.when(~F.col("asked") & F.col("answered"), "no_question"),
        F.when(F.col("asked") & F.col("empty"), "empty_question"),
        F.when(F.col("asked") & ~F.col("replied"), "no_reply"),
        F.when(F.col("asked") & F.col("undated"), "undated"),
        F.when(F.col("asked") & (F.col("reply_at") < F.col("question_at")), "early_reply"),
    )
    return whole.select("conversation_id", F.explode(F.array_compact(held)).alias("reason"))


def find_broken(posts: DataFrame, comments: DataFrame, **how) -> DataFrame:
    """(conversation_id, reason) of the broken conversations."""
    return validate(replay(message_rows(posts, comments), **how))


def turns(posts: DataFrame, comments: DataFrame, **how) -> DataFrame:
    """The ordered turns of sound conversations: (conversation_id, turn, role, message_id, source, said_at, text).

    The messages are those the stream emitted. The asker keeps that role in later messages. Order is by instant, then
    question, answers, comments, then id. A turn's number is its place within its day plus the turns of earlier days, so
    no task orders a whole conversation.
    """
    closed = replay(message_rows(posts, comments), **how)
    bad = validate(closed).select("conversation_id").distinct()
    sound = closed.where(F.col("kind") == QUESTION).groupBy("conversation_id").agg(F.max("user").alias("asker")).join(bad, "conversation_id", "left_anti")
    messages = closed.drop("shown", "loaded_at").join(sound, "conversation_id").dropDuplicates(["kind", "message_id"])
    day = F.substring("said_at", 1, 10)
    within = F.row_number().over(Window.partitionBy("conversation_id", "day").orderBy("said_at", "kind", "message_id"))
    placed = materialize(messages.withColumn("day", day).withColumn("place", within), "turns")
    earlier = F.sum("n").over(Window.partitionBy("conversation_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = placed.groupBy("conversation_id", "day").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(earlier, F.lit(0))).drop("n")
    # texts join last, so that they are shuffled once
    said = posts.where("post_type_id in ('1', '2')").select(F.col("post_type_id").cast("int").alias("kind"), positive_id("id").alias("message_id"), F.col("body").alias("text"))
    said = said.unionByName(comments.select(F.lit(COMMENT).alias("kind"), positive_id("id").alias("message_id"), "text")).where("message_id is not null").dropDuplicates(["kind", "message_id"])
    role = F.when((F.col("kind") == QUESTION) | (F.col("user") == F.col("asker")), "asker").when(F.col("kind") == ANSWER, "answerer").otherwise("commenter")
    return placed.join(days, ["conversation_id", "day"]).join(said, ["kind", "message_id"]).select(
        "conversation_id", (F.col("before") + F.col("place")).alias("turn"), role.alias("role"), "message_id", F.when(F.col("kind") == COMMENT, "comments").otherwise("posts").alias("source"), "said_at", "text"
    )
