"""The one-row-per-question characteristic table, its issues and its validation checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.html import html_measures
from threadloom.functions.ids import positive_id, reference_number, valid_timestamp
from threadloom.functions.scalars import bad_integer, elapsed_hours, half_even_6, mismatch, optional_integer, tag_names
from threadloom.operators.quantiles import group_medians
from threadloom.operators.threads import chronological_key, date_range, distinct_records, first_child
from threadloom.plans.columns import NAMES
from threadloom.session import materialize

DATES = {"posts": ["creation_date", "last_edit_date", "closed_date"], "comments": ["creation_date"], "votes": ["creation_date"]}


class DataIssues(ValueError):
    """The source breaks rules; names the least offenders."""


def records(df: DataFrame) -> DataFrame:
    """One row per id: repeated rows are one record, the earliest loaded, of those the least score."""
    order = [F.col("loaded_at").asc_nulls_last()] if "loaded_at" in df.columns else []
    return distinct_records(df.withColumn("id_number", positive_id("id")), "id_number", [*order, optional_integer("score").asc_nulls_last() if "score" in df.columns else F.col("id")])


def issues(posts: DataFrame, comments: DataFrame, votes: DataFrame) -> DataFrame:
    """(source, rule, id, value, context) of every value that breaks a rule, and of every event that precedes its source.

    It is evaluated apart, so no optimization can skip it. Context names the Id, ParentId and PostId that the row has.
    """

    def context(df: DataFrame) -> Column:
        shown = {"Id": "id", "ParentId": "parent_id", "PostId": "post_id"}
        return F.concat_ws(", ", *[F.concat(F.lit(f"{k}='"), F.col(c), F.lit("'")) for k, c in shown.items() if c in df.columns]).alias("context")

    def of(df: DataFrame, source: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), F.col(c).alias("value"))) for rule, (bad, c) in rules.items()]))
        return df.select(F.lit(source).alias("source"), "id", context(df), F.explode(found).alias("i")).select("source", "i.rule", "id", "i.value", "context")

    at = valid_timestamp
    date = lambda c, needed: (at(c).isNull() & (F.lit(needed) | (F.col(c).isNotNull() & (F.col(c) != ""))), c)
    ident = {"id": (positive_id("id").isNull(), "id"), "creation_date": date("creation_date", True)}
    question = {**ident, "last_edit_date": date("last_edit_date", False), "closed_date": date("closed_date", False), "score": (bad_integer("score"), "score"), **{c: (bad_integer(c, False), c) for c in ("view_count", "answer_count", "comment_count")}}
    question |= {f"{c}_before_question": (at(c) < at("creation_date"), c) for c in ("last_edit_date", "closed_date")}

    # events of children against their question, and acceptances against the accepted answer
    q = records(posts.where("post_type_id = '1'")).select(F.col("id_number").alias("parent"), at("creation_date").alias("asked"), reference_number("accepted_answer_id").alias("accepted")).where("asked is not null")
    early = {"before_question": (at("creation_date") < F.col("asked"), "creation_date")}
    known = q.select("parent", "asked")
    answers = posts.where("post_type_id = '2'").withColumn("parent", reference_number("parent_id"))
    said = comments.withColumn("parent", reference_number("post_id"))
    days = acceptance_days(votes).join(q.where("accepted is not null").select(F.col("accepted").alias("answer"), "parent", "asked"), "answer")
    posted = records(posts.where("post_type_id = '2'")).select(F.col("id_number").alias("answer"), reference_number("parent_id").alias("parent"), at("creation_date").alias("posted"))
    accepted = days.join(posted, ["answer", "parent"], "left").select(F.col("parent").cast("string").alias("id"), F.col("acceptance_date").cast("string").alias("day"), "acceptance_date", F.to_date("asked").alias("asked"), F.to_date("posted").alias("posted"))
    return (
        of(posts.where("post_type_id = '1'"), "questions", question)
        .unionByName(of(posts.where("post_type_id = '2'"), "answers", {**ident, "score": (bad_integer("score"), "score")}))
        .unionByName(of(comments, "comments", ident))
        .unionByName(of(votes.where("vote_type_id = '1'"), "votes", {"creation_date": date("creation_date", True)}))
        .unionByName(of(answers.join(known, "parent"), "answers", early))
        .unionByName(of(said.join(known, "parent"), "comments", early))
        .unionByName(of(accepted, "acceptances", {"before_question": (F.col("acceptance_date") < F.col("asked"), "day"), "before_answer": (F.col("acceptance_date") < F.col("posted"), "day")}))
    )


def raise_issues(found: DataFrame, show: int = 5) -> None:
    worst = found.orderBy("source", "rule", "id").limit(show).collect()
    if worst:
        raise DataIssues("; ".join(f"{r['source']} row ({r['context'] or 'no identifier'}): bad {r['rule']} {r['value']!r}" for r in worst))


def acceptance_days(votes: DataFrame) -> DataFrame:
    """The earliest acceptance day of each answer; other kinds of votes do not count."""
    return votes.where("vote_type_id = '1'").select(reference_number("post_id").alias("answer"), F.to_date(valid_timestamp("creation_date")).alias("day")).where("answer is not null").groupBy("answer").agg(F.min("day").alias("acceptance_date"))


def build(posts: DataFrame, comments: DataFrame, votes: DataFrame, snapshot: str, site: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = None, strict: bool = False) -> DataFrame:
    """The table of questions in [start, end] (all without them), at most `limit` in chronological order.

    strict raises on the first issues; otherwise bad values are null, undated questions are left out, undated answers
    and comments are not counted, and delays that would be negative are null. Children shuffle once, on their parent;
    bodies of answers travel only for accepted ones.
    """
    if strict:
        raise_issues(issues(posts, comments, votes))
    q = records(posts.where("post_type_id = '1'")).withColumn("asked", valid_timestamp("creation_date")).where("asked is not null")
    if start or end:
        q = date_range(q, F.col("asked"), start or "0001-01-01", end or "9998-12-31")
    if limit:
        q = q.orderBy(*chronological_key("creation_date", "id_number")).limit(limit)
    q = q.withColumn("accepted", reference_number("accepted_answer_id"))
    keys = q.select("id_number", "asked")

    a = records(posts.where("post_type_id = '2'")).withColumn("parent", reference_number("parent_id")).withColumn("at", valid_timestamp("creation_date")).where("parent is not null and at is not null")
    answers = a.select("parent", "id_number", "id", "creation_date", "at", optional_integer("score").alias("points")).join(keys.withColumnRenamed("id_number", "parent"), "parent")
    accepted = a.select(F.col("id_number").alias("accepted"), F.col("parent").alias("id_number"), F.struct(F.col("creation_date").alias("created"), "at", F.col("owner_user_id").alias("user"), F.col("owner_display_name").alias("shown"), F.col("content_license").alias("license"), optional_integer("score").alias("points"), F.col("body").alias("body")).alias("acc"))
    to_beat = q.select("id_number", "accepted").where("accepted is not null").join(accepted.select("accepted", "id_number", F.col("acc.points").alias("to_beat")), ["accepted", "id_number"]).select(F.col("id_number").alias("parent"), "to_beat")
    timed = materialize(answers.join(to_beat, "parent", "left").withColumn("delay", elapsed_hours(F.col("at"), F.col("asked"))), "answers")
    order = chronological_key("creation_date", "id_number")
    first = F.min(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)], "id", "creation_date", "at", "delay")).alias("first")
    per_answer = timed.groupBy("parent").agg(F.count("*").alias("n"), first, (F.max("points") - F.min("points")).alias("spread"), F.count_if(F.col("points") > F.col("to_beat")).alias("better"))
    medians = group_medians(timed, "parent", "delay", width=24.0).select("parent", half_even_6("median").alias("median_delay"))
    per_answer = per_answer.join(medians, "parent", "left")

    c = records(comments).select(reference_number("post_id").alias("parent"), "id_number", "creation_date", valid_timestamp("creation_date").alias("at")).where("at is not null")
    firsts = per_answer.select("parent", F.col("first.at").alias("first_at"), F.struct("first.k0", "first.k1").alias("first_key"))
    said = c.join(keys.select(F.col("id_number").alias("parent")), "parent").join(firsts, "parent", "left")
    instant = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(chronological_key("creation_date", "id_number")[:2])])
    per_comment = said.groupBy("parent").agg(F.count("*").alias("comments"), F.count_if(instant < F.col("first_key")).alias("before"))

    t = (
        q.join(per_answer.withColumnRenamed("parent", "id_number"), "id_number", "left")
        .join(accepted, ["id_number", "accepted"], "left")
        .join(per_comment.withColumnRenamed("parent", "id_number"), "id_number", "left")
        .join(acceptance_days(votes).withColumnRenamed("answer", "accepted"), "accepted", "left")
        .withColumn("m", html_measures("body"))
        .withColumn("am", F.when(F.col("acc").isNotNull(), html_measures("acc.body")))
    )
    where = F.lit(site) if site else F.col("site")
    asked_day, snap = F.to_date("asked"), F.lit(snapshot).cast("date")
    platform, none = optional_integer("answer_count"), F.lit(None)
    positive = lambda c: F.when(optional_integer(c) >= 0, optional_integer(c))
    acc_days = F.datediff("acceptance_date", asked_day).cast("bigint")
    values = {
        "site": where, "dump_snapshot_date": snap, "question_id": F.col("id_number").cast("string"), "question_url": F.concat(F.lit("https://"), where, F.lit("/questions/"), F.col("id_number").cast("string")), "question_creation_datetime": F.col("creation_date"), "question_last_edit_datetime": F.col("last_edit_date"),
        "question_title": F.col("title"), "question_body_html": F.col("body"), "question_body_text": F.col("m.visible_text"), "question_tags_raw": F.col("tags"), "question_tags": F.array_join(tag_names("tags"), ";"), "question_content_license": F.col("content_license"), "owner_user_id": F.col("owner_user_id"), "owner_display_name": F.col("owner_display_name"),
        "question_score": optional_integer("score"), "question_view_count": positive("view_count"), "stackexchange_answer_count": positive("answer_count"), "has_stackexchange_answer": positive("answer_count") > 0, "stackexchange_comment_count": positive("comment_count"), "accepted_answer_id": F.col("accepted").cast("string"), "closed_datetime": F.col("closed_date"),
        "question_word_count": F.col("m.word_count"), "code_character_count": F.col("m.code_characters"), "code_line_count": F.col("m.code_lines"), "link_count": F.col("m.links"), "image_count": F.col("m.images"), "tag_count": F.size(tag_names("tags")).cast("bigint"), "available_answer_count": F.coalesce("n", F.lit(0)), "has_available_answer": F.coalesce(F.col("n") > 0, F.lit(False)),
        "first_answer_id": F.col("first.id"), "first_answer_creation_datetime": F.col("first.creation_date"), "time_to_first_answer_hours": F.col("first.delay"), "median_answer_response_hours": F.col("median_delay"), "accepted_answer_available": F.col("acc").isNotNull(), "accepted_answer_creation_datetime": F.col("acc.created"),
        "accepted_answer_url": F.concat(F.lit("https://"), where, F.lit("/a/"), F.col("accepted").cast("string")), "accepted_answer_owner_user_id": F.col("acc.user"), "accepted_answer_owner_display_name": F.col("acc.shown"), "accepted_answer_content_license": F.col("acc.license"), "time_to_eventually_accepted_answer_post_hours": elapsed_hours(F.col("acc.at"), F.col("asked")),
        "acceptance_date": F.col("acceptance_date"), "days_to_acceptance": F.when(acc_days >= 0, acc_days), "accepted_answer_score": F.col("acc.points"), "accepted_answer_body_text": F.col("am.visible_text"), "answer_score_spread": F.col("spread"),
        "accepted_answer_score_rank": F.when(F.col("acc.points").isNotNull(), F.col("better") + 1), "available_question_comment_count": F.coalesce("comments", F.lit(0)), "comments_before_first_answer": F.when(F.col("n") > 0, F.coalesce("before", F.lit(0))), "observation_days_at_dump": F.datediff(snap, asked_day).cast("bigint"),
    }
    del platform, none
    return t.select(*[values[n].alias(n) for n in NAMES])


def validation(table: DataFrame, expected: list[str] = NAMES) -> DataFrame:
    """(check_name, status, observed, meaning): ten checks in one pass over the table."""
    avail, plat = F.col("available_answer_count"), F.col("stackexchange_answer_count")
    one = table.agg(
        F.count("*").alias("rows"), F.count("question_id").alias("ids"), F.count_distinct("question_id").alias("distinct_ids"),
        F.count_if(F.col("has_available_answer") != (avail > 0)).alias("flag_available"), F.count_if(F.coalesce(F.col("has_stackexchange_answer") != (plat > 0), F.col("has_stackexchange_answer").isNotNull() != plat.isNotNull())).alias("flag_platform"),
        F.count_if(mismatch(plat, avail)).alias("answers_differ"), F.count_if(mismatch(F.col("stackexchange_comment_count"), F.col("available_question_comment_count"))).alias("comments_differ"),
        F.count_if(F.col("accepted_answer_id").isNotNull() & ~F.col("accepted_answer_available")).alias("accepted_without_row"), F.count_if(F.col("accepted_answer_id").isNotNull() & F.col("acceptance_date").isNull()).alias("accepted_without_date"),
        F.count_if(F.coalesce(F.col("observation_days_at_dump") < 0, F.lit(True))).alias("bad_observation"),
    )
    same = F.lit(sorted(table.columns) == sorted(expected))
    checks = [
        ("rows_produced", F.col("rows") > 0, "FAIL", F.col("rows"), "more than 0"), ("columns_match", same, "FAIL", F.lit(len(table.columns)), "exactly the contract's columns"), ("ids_present_and_unique", (F.col("ids") == F.col("rows")) & (F.col("distinct_ids") == F.col("rows")), "FAIL", F.col("rows") - F.col("distinct_ids"), "no repeated or missing id"),
        *[(n, F.col(n) == 0, level, F.col(n), "0 rows") for n, level in (("flag_available", "FAIL"), ("flag_platform", "FAIL"), ("answers_differ", "WARN"), ("comments_differ", "WARN"), ("accepted_without_row", "WARN"), ("accepted_without_date", "WARN"), ("bad_observation", "FAIL"))],
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.when(ok, "PASS").otherwise(level).alias("status"), seen.cast("string").alias("observed"), F.lit(meaning).alias("meaning")) for n, ok, level, seen, meaning in checks]))
    return one.select(rows.alias("r")).select("r.*")


def invariants(table: DataFrame) -> DataFrame:
    """(rule, rows) of broken rules of a loaded table: flags against counts, ids, signs, one site and snapshot, order of events."""
    when = lambda c: valid_timestamp(c)
    snap = F.col("dump_snapshot_date")
    asked = when("question_creation_datetime")
    rules = {
        "flag_against_count": F.col("has_available_answer") != (F.col("available_answer_count") > 0),
        "negative_count": reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in NAMES if c.endswith("_count") or c.endswith("_hours")]),
        "answer_before_question": when("first_answer_creation_datetime") < asked,
        "acceptance_before_question": F.col("acceptance_date") < F.to_date(asked),
        "question_after_snapshot": asked >= F.date_add(snap, 1).cast("timestamp_ntz"),
        "answer_after_snapshot": when("first_answer_creation_datetime") > snap.cast("timestamp_ntz"),
        "closed_after_snapshot": when("closed_datetime") > snap.cast("timestamp_ntz"),
    }
    one = table.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()], (F.count("*") - F.count_distinct("question_id")).alias("repeated_id"), F.greatest(F.lit(0), F.count_distinct("site") - 1).alias("other_sites"), F.greatest(F.lit(0), F.count_distinct("dump_snapshot_date") - 1).alias("other_snapshots"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("rows")) for k in (*rules, "repeated_id", "other_sites", "other_snapshots")]))
    return one.select(rows.alias("r")).select("r.*")


__all__ = ["DataIssues", "acceptance_days", "build", "first_child", "invariants", "issues", "raise_issues", "records", "validation"]
