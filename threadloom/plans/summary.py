"""Selected-field summaries and complete threads of requested questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import positive_id, reference_number
from threadloom.operators.threads import chronological_key, distinct_records, first_child, nested_threads, requested
from threadloom.plans.columns import SUMMARY
from threadloom.sources.xml import attribute

#: Selected without a configuration.
DEFAULT_FIELDS = ["question_id", "question_body", "question_date", "first_comment_id", "first_comment_text", "first_comment_date", "first_answer_id", "first_answer_body", "first_answer_date", "accepted_answer_id", "accepted_answer_body", "accepted_answer_date"]


class UnknownQuestions(ValueError):
    """Requested ids that are absent or are no questions."""


def _wanted(posts: DataFrame, ids: Sequence[str] | None) -> tuple[DataFrame, list[str] | None]:
    q = posts.where("post_type_id = '1'").withColumn("id_number", positive_id("id")).where("id_number is not null")
    if ids is None:
        return q, None
    wanted = requested(ids)
    numbers = [int(i) for i in wanted]  # a request is typed by a person
    q = q.where(F.col("id_number").isin(numbers))
    seen = {r[0] for r in q.select("id_number").distinct().collect()}
    missing = [i for i in numbers if i not in seen]
    if missing:
        others = {r[0]: r[1] for r in posts.withColumn("n", positive_id("id")).where(F.col("n").isin(missing)).select("n", "post_type_id").collect()}
        raise UnknownQuestions("; ".join(f"{i}: {'is a post of type ' + str(others[i]) if i in others else 'not found'}" for i in missing))
    return q, wanted


def summaries(posts: DataFrame, comments: DataFrame, fields: Sequence[str] = tuple(DEFAULT_FIELDS), ids: Sequence[str] | None = None) -> DataFrame:
    """One row per requested question (all without ids) with the fields in order; what is unavailable is ''."""
    known = {f: (record, attribute) for f, record, attribute in SUMMARY}
    unknown = [f for f in fields if f not in known]
    if unknown or not fields or len(set(fields)) != len(fields):
        raise ValueError(f"unknown, repeated or no fields: {unknown or list(fields)}")
    q, _ = _wanted(posts, ids)
    q = distinct_records(q, "id_number", ["loaded_at", "score"] if "loaded_at" in q.columns else ["id"])
    needed = {record: sorted({a for f in fields for r, a in [known[f]] if r == record}) for record in {known[f][0] for f in fields}}
    out = q.select("id_number", reference_number("accepted_answer_id").alias("accepted"), F.struct(*[F.col(c) for c in dict.fromkeys(["id", *needed.get("question", [])])]).alias("question"))
    answers = posts.where("post_type_id = '2'").withColumn("n", positive_id("id")).withColumn("parent", reference_number("parent_id"))
    order = chronological_key("creation_date", "n")
    if cols := needed.get("first_answer"):
        first = first_child(answers.where(order[0].isNotNull()), "parent", order, cols).select(F.col("parent").alias("id_number"), F.struct(*cols).alias("first_answer"))
        out = out.join(first, "id_number", "left")
    if cols := needed.get("first_comment"):
        c = comments.withColumn("n", positive_id("id")).withColumn("parent", reference_number("post_id")).where(order[0].isNotNull())
        out = out.join(first_child(c, "parent", order, cols).select(F.col("parent").alias("id_number"), F.struct(*cols).alias("first_comment")), "id_number", "left")
    if cols := needed.get("accepted_answer"):
        acc = first_child(answers.where("n is not null"), "n", [*order, F.col("parent")], [*cols, "parent"]).select(F.col("n").alias("accepted"), F.col("parent").alias("id_number"), F.struct(*cols).alias("accepted_answer"))
        out = out.join(acc, ["accepted", "id_number"], "left")
    return out.select(*[F.coalesce(F.col(f"{known[f][0]}.{known[f][1]}").cast("string"), F.lit("")).alias(f) for f in fields])


def threads(posts: DataFrame, comments: DataFrame, ids: Sequence[str], columns: Sequence[str] = ("id", "creation_date", "score", "owner_user_id", "body"), comment_columns: Sequence[str] = ("id", "creation_date", "score", "user_id", "text")) -> DataFrame:
    """Complete threads of requested questions in the order of the request."""
    q, wanted = _wanted(posts, ids)
    q = distinct_records(q, "id_number", ["id"])
    a = posts.where("post_type_id = '2'").withColumn("n", positive_id("id")).withColumn("parent", reference_number("parent_id")).join(q.select(F.col("id_number").alias("parent")), "parent", "left_semi")
    c = comments.withColumn("n", positive_id("id")).withColumn("parent", reference_number("post_id")).join(q.select(F.col("id_number").alias("parent")), "parent", "left_semi")
    place = F.array_position(F.array(*[F.lit(int(i)) for i in wanted]), F.col("id_number"))
    return nested_threads(q, a, c, "id_number", chronological_key("creation_date", "n"), columns, comment_columns).withColumn("place", place).orderBy("place")


def source_threads(posts: DataFrame, comments: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Complete threads of requested questions from lossless rows: every attribute of every row, in source order."""

    def named(df: DataFrame, names: dict[str, str]) -> DataFrame:
        return df.select("attrs", *[attribute(a).alias(c) for c, a in names.items()])

    own = named(posts, {"id": "Id", "post_type_id": "PostTypeId", "parent_id": "ParentId", "creation_date": "CreationDate"})
    said = named(comments, {"id": "Id", "post_id": "PostId", "creation_date": "CreationDate"})
    return threads(own, said, ids, ["attrs"], ["attrs"])
