"""Queries of the core operators over whole tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.html import html_measures
from threadloom.functions.ids import positive_id, reference, reference_number, valid_timestamp
from threadloom.functions.scalars import elapsed_microseconds, number_label, optional_integer, split_tags, tag_names, word_count
from threadloom.operators import correlations, explore, quantiles, references, threads
from threadloom.plans import characteristics, explore_table, summary
from threadloom.plans.columns import CORRELATED, DISTRIBUTIONS, FLAGGED, NAMES, STRUCTURAL, SUMMARY
from threadloom.session import fresh_path, table
from threadloom.sinks import publish, workbook
from threadloom.sources import xml
from threadloom.streaming.periods import daily_outcomes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ---- shared SQL

REF = r"try_cast(nullif(regexp_extract({}, '^\s*0*([1-9][0-9]*)\s*$', 1), '') AS BIGINT)"
DIGITS = r"nullif(regexp_extract({}, '^\s*0*([1-9][0-9]*)\s*$', 1), '')"
FULL = r"regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\.[0-9]+)?')"
SECOND = f"CASE WHEN {FULL} THEN try_cast(left({{0}}, 19) AS TIMESTAMP) END"
# microseconds of the fraction, further digits cut off
MOMENT = f"CASE WHEN {FULL} THEN try_cast(left({{0}}, 19) AS TIMESTAMP) + to_microseconds(CAST(rpad(left(regexp_extract({{0}}, '\\.([0-9]+)$', 1), 6), 6, '0') AS BIGINT)) END"
FRACTION = r"regexp_replace(regexp_extract({0}, '\.([0-9]+)$', 1), '0+$', '')"
INTEGER = r"CASE WHEN regexp_full_match({0}, '\s*[+-]?[0-9]+\s*') THEN try_cast(trim({0}) AS BIGINT) END"
ONE = "row_number() OVER (PARTITION BY id_number ORDER BY loaded_at NULLS LAST, points NULLS LAST) = 1"
QA = f"""
WITH p AS (SELECT *, {REF.format('id')} AS id_number, {INTEGER.format('score')} AS points, {SECOND.format('creation_date')} AS sec, {FRACTION.format('creation_date')} AS frac, {MOMENT.format('creation_date')} AS said, {REF.format('parent_id')} AS parent, {REF.format('accepted_answer_id')} AS accepted FROM posts),
q AS (SELECT * FROM p WHERE post_type_id = '1' AND id_number IS NOT NULL QUALIFY {ONE}),
a AS (SELECT * FROM p WHERE post_type_id = '2' AND id_number IS NOT NULL QUALIFY {ONE}),
c0 AS (SELECT *, {REF.format('id')} AS id_number, {INTEGER.format('score')} AS points, {SECOND.format('creation_date')} AS sec, {FRACTION.format('creation_date')} AS frac, {REF.format('post_id')} AS parent FROM comments),
c AS (SELECT * FROM c0 WHERE id_number IS NOT NULL QUALIFY {ONE})
"""
NOT_NAN = "CASE WHEN NOT isnan({0}) THEN {0} END AS {0}"
HOURS = ("time_to_first_answer_hours", "median_answer_response_hours", "time_to_eventually_accepted_answer_post_hours")
T = f"""
WITH t AS (SELECT DISTINCT ON (question_id) * REPLACE ({', '.join(NOT_NAN.format(h) for h in HOURS)}), {MOMENT.format('question_creation_datetime')} AS asked, {MOMENT.format('first_answer_creation_datetime')} AS answered, {MOMENT.format('closed_datetime')} AS closed, {MOMENT.format('accepted_answer_creation_datetime')} AS accepted_at
FROM thread_characteristics WHERE question_id IS NOT NULL ORDER BY question_id)
"""
END = "DATE '2025-03-31'"


# ---- HTML in SQL, for markup as the tables have it

ENTITIES = {"&nbsp;": "chr(160)", "&#160;": "chr(160)", "&#8203;": "chr(8203)", "&#39;": "chr(39)", "&commat;": "'@'", "&#x40;": "'@'", "&#64;": "'@'", "&quot;": "chr(34)", "&lt;": "'<'", "&gt;": "'>'", "&amp;": "'&'"}


def _text_sql(source: str, between: str = " ") -> str:
    out = f"regexp_replace({source}, '(?s)<!--.*?-->|<[a-zA-Z/!?][^>]*>', '{between}', 'g')"
    for entity, character in ENTITIES.items():
        out = f"replace({out}, '{entity}', {character})"
    return out


def _measures_sql(body: str) -> dict[str, str]:
    b = f"coalesce({body}, '')"
    inner = lambda tag: f"regexp_extract_all({b}, '(?s)<{tag}[^>]*>(.*?)(?:</{tag}>|$)', 1)"
    prose = f"regexp_replace({b}, '(?s)<pre[^>]*>.*?(?:</pre>|$)|<code[^>]*>.*?(?:</code>|$)', ' ', 'g')"
    runs = r"'[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}]+)*'"
    return {
        "visible_text": rf"trim(regexp_replace({_text_sql(b)}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'))", "word_count": f"len(list_filter(regexp_extract_all({_text_sql(prose)}, {runs}), lambda w: NOT contains(w, '_')))",
        "code_characters": f"CAST(coalesce(list_sum(list_transform({inner('code')}, lambda w: length({_text_sql('w', '')}))), 0) AS BIGINT)", "code_lines": f"CAST(coalesce(list_sum(list_transform({inner('pre')}, lambda w: len(list_filter(string_split({_text_sql('w', '')}, chr(10)), lambda y: trim(y) <> '')))), 0) AS BIGINT)",
        "links": rf"len(regexp_extract_all({b}, '<a\s[^>]*href'))", "images": f"len(regexp_extract_all({b}, '<img[^a-z]'))",
    }


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- shared frames


def _questions(spark: SparkSession, d: str) -> DataFrame:
    q = characteristics.records(table(spark, d, "posts").where("post_type_id = '1'"))
    return q.withColumns({"asked": valid_timestamp("creation_date"), "accepted": reference_number("accepted_answer_id")})


def _answers(spark: SparkSession, d: str) -> DataFrame:
    a = characteristics.records(table(spark, d, "posts").where("post_type_id = '2'"))
    return a.withColumns({"parent": reference_number("parent_id"), "at": valid_timestamp("creation_date"), "points": optional_integer("score")})


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return characteristics.records(table(spark, d, "comments")).withColumns({"parent": reference_number("post_id"), "at": valid_timestamp("creation_date")})


def _once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each question of the characteristic table once; NaN hours are null. Repeated rows are equal, so only what is used is shuffled."""
    t = table(spark, d, "thread_characteristics").where("question_id is not null")
    t = t.withColumns({h: F.when(~F.isnan(h), F.col(h)) for h in HOURS})
    if columns:
        return t.groupBy("question_id").agg(*[F.first(c).alias(c) for c in columns if c != "question_id"])
    return t.dropDuplicates(["question_id"])


def _order() -> list:
    return threads.chronological_key("creation_date", "id_number")

# ---- threads


@query(QA + "SELECT parent AS question_id, id_number AS answer_id, creation_date FROM a WHERE parent IS NOT NULL AND sec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent ORDER BY sec, frac, id_number) = 1")
def first_child(spark: SparkSession, d: str) -> DataFrame:
    found = threads.first_child(_answers(spark, d).where("at is not null"), "parent", _order(), ["id_number", "creation_date"])
    return found.withColumnsRenamed({"parent": "question_id", "id_number": "answer_id"})


@query(
    QA
    + """SELECT q.id_number AS question_id, count(a.id_number) AS answers, count(a.id_number) > 0 AS has_answer, max(a.points) - min(a.points) AS score_spread,
CAST(floor(quantile_cont(date_diff('microsecond', q.said, a.said), 0.5)) AS BIGINT) AS median_delay_us FROM q LEFT JOIN a ON a.parent = q.id_number AND a.said IS NOT NULL WHERE q.said IS NOT NULL GROUP BY q.id_number"""
)
def child_aggregate(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d).where("asked is not null").select("id_number", "asked")
    a = _answers(spark, d).where("at is not null").select("parent", "at", "points").join(q.withColumnRenamed("id_number", "parent"), "parent").withColumn("delay", elapsed_microseconds(F.col("at"), F.col("asked")))
    medians = quantiles.group_medians(a, "parent", "delay", width=86_400e6).select("parent", F.floor("median").cast("bigint").alias("median_delay_us"))
    per = threads.child_counts(a, "parent", answers=F.count("*"), score_spread=F.max("points") - F.min("points")).join(medians, "parent", "left")
    out = threads.with_children(q, "id_number", per, "parent", ["answers"])
    return out.select(F.col("id_number").alias("question_id"), "answers", (F.col("answers") > 0).alias("has_answer"), "score_spread", "median_delay_us")


@query(
    QA
    + """, f AS (SELECT parent, sec, frac FROM a WHERE parent IS NOT NULL AND sec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent ORDER BY sec, frac, id_number) = 1)
SELECT q.id_number AS question_id, count(c.id_number) AS comments, count(*) FILTER (c.sec < f.sec OR (c.sec = f.sec AND c.frac < f.frac)) AS before_first FROM q JOIN c ON c.parent = q.id_number AND c.sec IS NOT NULL LEFT JOIN f ON f.parent = q.id_number GROUP BY q.id_number"""
)
def children_before_first(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d).select(F.col("id_number").alias("parent"))
    first = threads.first_child(_answers(spark, d).where("at is not null"), "parent", _order(), ["creation_date"]).select("parent", F.struct(*threads.chronological_key("creation_date", "parent")[:2]).alias("first"))
    c = _comments(spark, d).where("at is not null").join(q, "parent").join(first, "parent", "left")
    instant = F.struct(*_order()[:2])
    return threads.child_counts(c, "parent", comments=F.count("*"), before_first=F.count_if(instant < F.col("first"))).withColumnRenamed("parent", "question_id")


@query(QA + "SELECT q.id_number AS question_id, q.accepted AS accepted_answer_id, a.id_number IS NOT NULL AS available, a.creation_date AS accepted_created FROM q LEFT JOIN a ON a.id_number = q.accepted AND a.parent = q.id_number WHERE q.accepted IS NOT NULL")
def accepted_answer(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).select(F.col("id_number").alias("accepted"), F.col("parent").alias("id_number"), F.col("creation_date").alias("accepted_created"), F.lit(True).alias("hit"))
    q = _questions(spark, d).where("accepted is not null").select("id_number", "accepted").join(a, ["accepted", "id_number"], "left")
    return q.select(F.col("id_number").alias("question_id"), F.col("accepted").alias("accepted_answer_id"), F.coalesce("hit", F.lit(False)).alias("available"), "accepted_created")


@query(QA + "SELECT id_number AS answer_id, parent AS question_id, points, CASE WHEN points IS NOT NULL THEN rank() OVER (PARTITION BY parent ORDER BY points DESC NULLS LAST) END AS score_rank FROM a WHERE parent IS NOT NULL")
def score_rank(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).where("parent is not null")
    return a.select(F.col("id_number").alias("answer_id"), F.col("parent").alias("question_id"), "points", threads.competition_rank(a, "parent", "points").alias("score_rank"))


@query(f"SELECT {REF.format('post_id')} AS answer_id, min(CAST({SECOND.format('creation_date')} AS DATE)) AS acceptance_date FROM votes WHERE vote_type_id = '1' AND {REF.format('post_id')} IS NOT NULL GROUP BY 1")
def earliest_event_day(spark: SparkSession, d: str) -> DataFrame:
    return characteristics.acceptance_days(table(spark, d, "votes")).withColumnRenamed("answer", "answer_id")


@query(QA + "SELECT id_number AS answer_id FROM a WHERE parent IN (SELECT id_number FROM q WHERE said >= TIMESTAMP '2024-01-01' AND said < TIMESTAMP '2025-01-01')")
def id_semi(spark: SparkSession, d: str) -> DataFrame:
    q = threads.date_range(_questions(spark, d), F.col("asked"), "2024-01-01", "2024-12-31")
    return threads.keep_known(_answers(spark, d), "parent", q, "id_number").select(F.col("id_number").alias("answer_id"))


@query(QA + "SELECT DISTINCT parent AS missing_id FROM a WHERE parent IS NOT NULL AND parent NOT IN (SELECT id_number FROM q)")
def id_anti(spark: SparkSession, d: str) -> DataFrame:
    ids = _answers(spark, d).where("parent is not null").select(F.col("parent").alias("missing_id"))
    return threads.unknown_ids(ids, "missing_id", _questions(spark, d), "id_number")


@query(QA + "SELECT id_number AS question_id, creation_date FROM q WHERE said >= TIMESTAMP '2023-03-15' AND said < TIMESTAMP '2023-09-01'")
def date_range_select(spark: SparkSession, d: str) -> DataFrame:
    return threads.date_range(_questions(spark, d), F.col("asked"), "2023-03-15", "2023-08-31").select(F.col("id_number").alias("question_id"), "creation_date")


@query(QA + "SELECT id_number AS question_id, creation_date FROM q WHERE sec IS NOT NULL ORDER BY sec, frac, id_number LIMIT 100")
def chrono_limit(spark: SparkSession, d: str) -> DataFrame:
    return threads.chronological_limit(_questions(spark, d).where("asked is not null"), "creation_date", "id_number", 100).select(F.col("id_number").alias("question_id"), "creation_date")


@query(
    QA
    + """SELECT q.id_number AS question_id, (SELECT count(*) FROM c WHERE c.parent = q.id_number) AS comments, (SELECT count(*) FROM a WHERE a.parent = q.id_number) AS answers,
coalesce((SELECT string_agg(a.id, ',' ORDER BY sec NULLS FIRST, frac NULLS FIRST, id_number) FROM a WHERE a.parent = q.id_number), '') AS answer_ids,
coalesce((SELECT string_agg(c.id || ':' || coalesce(c.user_id, ''), ',' ORDER BY sec NULLS FIRST, frac NULLS FIRST, id_number) FROM c WHERE c.parent = q.id_number), '') AS comment_users, coalesce((SELECT sum(length(a.body)) FROM a WHERE a.parent = q.id_number), 0) AS answer_characters, q.title FROM q"""
)
def thread_nested(spark: SparkSession, d: str) -> DataFrame:
    n = threads.nested_threads(_questions(spark, d), _answers(spark, d).where("parent is not null"), _comments(spark, d).where("parent is not null"), "id_number", _order(), ["id", "creation_date", "score", "owner_user_id", "title", "body"], ["id", "creation_date", "score", "user_id", "text"])
    more = [
        F.array_join(F.transform("comments", lambda c: F.concat_ws(":", c["id"], F.coalesce(c["user_id"], F.lit("")))), ",").alias("comment_users"),
        F.aggregate("answers", F.lit(0).cast("bigint"), lambda n, a: n + F.coalesce(F.length(a["body"]), F.lit(0))).alias("answer_characters"), F.col("question.title").alias("title"),
    ]
    return n.select(*more, F.col("id_number").alias("question_id"), F.size("comments").cast("bigint").alias("comments"), F.size("answers").cast("bigint").alias("answers"), F.array_join(F.transform("answers", lambda a: a["id"]), ",").alias("answer_ids"))


def _summary_sql() -> str:
    sides = {"question": "q", "first_comment": "fc", "first_answer": "fa", "accepted_answer": "x"}
    fields = ", ".join(f"coalesce({sides[record]}.{attribute}, '') AS {field}" for field, record, attribute in SUMMARY)
    first = "SELECT * FROM {0} WHERE sec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent ORDER BY sec, frac, id_number) = 1"
    return QA + f", fc AS ({first.format('c')}), fa AS ({first.format('a')}) SELECT {fields} FROM q LEFT JOIN fc ON fc.parent = q.id_number LEFT JOIN fa ON fa.parent = q.id_number LEFT JOIN a x ON x.id_number = q.accepted AND x.parent = q.id_number"


@query(_summary_sql())
def summary_fields(spark: SparkSession, d: str) -> DataFrame:
    """All selectable fields of all questions; repeated rows count with the score of the record that is kept."""
    posts, comments = (characteristics.records(table(spark, d, t)).drop("id_number") for t in ("posts", "comments"))
    return summary.summaries(posts, comments, [f for f, _, _ in SUMMARY])


HTML_COLUMNS = ("question_body_text", "question_word_count", "code_character_count", "code_line_count", "link_count", "image_count", "accepted_answer_body_text")
COUNT = "CASE WHEN {0} >= 0 THEN {0} END"
SIX = "CAST(format('{{:.6f}}', {0}) AS DOUBLE)"  # correctly rounded from the binary value
DELAY = "CASE WHEN date_diff('microsecond', {0}, {1}) >= 0 THEN CAST(format('{{:.6f}}', date_diff('microsecond', {0}, {1}) / 1e6 / 3600e0) AS DOUBLE) END"
CHARACTERISTICS = (
    QA
    + f""", f AS (SELECT a.* FROM a WHERE parent IS NOT NULL AND said IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent ORDER BY sec, frac, id_number) = 1),
k AS (SELECT a.parent, count(*) AS n, max(a.points) - min(a.points) AS spread, median({DELAY.format('q.said', 'a.said')}) AS med FROM a JOIN q ON q.id_number = a.parent AND q.said IS NOT NULL WHERE a.said IS NOT NULL GROUP BY 1),
s AS (SELECT c.parent, count(*) AS n, count(*) FILTER (c.sec < f.sec OR (c.sec = f.sec AND c.frac < f.frac)) AS before FROM c LEFT JOIN f ON f.parent = c.parent WHERE c.sec IS NOT NULL GROUP BY 1),
v AS (SELECT {REF.format('post_id')} AS answer, min(CAST({SECOND.format('creation_date')} AS DATE)) AS day FROM votes WHERE vote_type_id = '1' GROUP BY 1),
z AS (SELECT q.*, {INTEGER.format('q.view_count')} AS views, {INTEGER.format('q.answer_count')} AS platform_answers, {INTEGER.format('q.comment_count')} AS platform_comments FROM q WHERE q.said IS NOT NULL),
x AS (SELECT * FROM a WHERE said IS NOT NULL), y AS (SELECT z.id_number, count(*) FILTER (a.points > x.points) AS better FROM z JOIN x ON x.id_number = z.accepted AND x.parent = z.id_number JOIN x a ON a.parent = z.id_number GROUP BY 1)
SELECT z.site, {END} AS dump_snapshot_date, CAST(z.id_number AS VARCHAR) AS question_id, 'https://' || z.site || '/questions/' || z.id_number AS question_url, z.creation_date AS question_creation_datetime, z.last_edit_date AS question_last_edit_datetime, z.title AS question_title, z.body AS question_body_html, z.tags AS question_tags_raw,
array_to_string(regexp_extract_all(coalesce(z.tags, ''), '<([^<>]+)>', 1), ';') AS question_tags, z.content_license AS question_content_license, z.owner_user_id, z.owner_display_name, z.points AS question_score, {COUNT.format('z.views')} AS question_view_count, {COUNT.format('z.platform_answers')} AS stackexchange_answer_count,
CASE WHEN z.platform_answers >= 0 THEN z.platform_answers > 0 END AS has_stackexchange_answer, {COUNT.format('z.platform_comments')} AS stackexchange_comment_count, CAST(z.accepted AS VARCHAR) AS accepted_answer_id, z.closed_date AS closed_datetime, len(regexp_extract_all(coalesce(z.tags, ''), '<([^<>]+)>', 1)) AS tag_count,
coalesce(k.n, 0) AS available_answer_count, coalesce(k.n, 0) > 0 AS has_available_answer, f.id AS first_answer_id, f.creation_date AS first_answer_creation_datetime, {DELAY.format('z.said', 'f.said')} AS time_to_first_answer_hours, CASE WHEN k.med IS NOT NULL THEN {SIX.format('k.med')} END AS median_answer_response_hours, x.id_number IS NOT NULL AS accepted_answer_available,
x.creation_date AS accepted_answer_creation_datetime, 'https://' || z.site || '/a/' || z.accepted AS accepted_answer_url, x.owner_user_id AS accepted_answer_owner_user_id, x.owner_display_name AS accepted_answer_owner_display_name, x.content_license AS accepted_answer_content_license, {DELAY.format('z.said', 'x.said')} AS time_to_eventually_accepted_answer_post_hours,
v.day AS acceptance_date, CASE WHEN v.day >= CAST(z.said AS DATE) THEN date_diff('day', CAST(z.said AS DATE), v.day) END AS days_to_acceptance, x.points AS accepted_answer_score, k.spread AS answer_score_spread, CASE WHEN x.points IS NOT NULL THEN y.better + 1 END AS accepted_answer_score_rank,
coalesce(s.n, 0) AS available_question_comment_count, CASE WHEN k.n > 0 THEN coalesce(s.before, 0) END AS comments_before_first_answer, date_diff('day', CAST(z.said AS DATE), {END}) AS observation_days_at_dump
FROM z LEFT JOIN k ON k.parent = z.id_number LEFT JOIN f ON f.parent = z.id_number LEFT JOIN s ON s.parent = z.id_number LEFT JOIN x ON x.id_number = z.accepted AND x.parent = z.id_number LEFT JOIN y ON y.id_number = z.id_number LEFT JOIN v ON v.answer = z.accepted"""
)


_HEAD, _TAIL = CHARACTERISTICS.split("\nSELECT z.site", 1)
_OWN = dict(zip(("visible_text", "word_count", "code_characters", "code_lines", "links", "images"), HTML_COLUMNS))


@query(_HEAD + ", r AS (SELECT z.site" + _TAIL + ") SELECT r.*, " + ", ".join(f"{c} AS {_OWN[k]}" for k, c in _measures_sql("r.question_body_html").items()) + f", CASE WHEN r.accepted_answer_available THEN {_measures_sql('x.body')['visible_text']} END AS accepted_answer_body_text FROM r LEFT JOIN a x ON CAST(x.id_number AS VARCHAR) = r.accepted_answer_id AND CAST(x.parent AS VARCHAR) = r.question_id")
def characteristic_table(spark: SparkSession, d: str) -> DataFrame:
    return characteristics.build(table(spark, d, "posts"), table(spark, d, "comments"), table(spark, d, "votes"), snapshot="2025-03-31")


@query(CHARACTERISTICS)
def characteristic_fields(spark: SparkSession, d: str) -> DataFrame:
    """All columns but those of the HTML walk."""
    return characteristic_table(spark, d).drop(*HTML_COLUMNS)


def _issue_sql(source: str, where: str, rules: dict[str, tuple[str, str]], parent: str | None) -> str:
    named = lambda shown, c: f"'{shown}=' || chr(39) || {c} || chr(39)"
    context = f"concat_ws(', ', {named('Id', 'id')}" + (f", {named(parent, {'ParentId': 'parent_id', 'PostId': 'post_id'}[parent])})" if parent else ")")
    return " UNION ALL ".join(f"SELECT '{source}' AS source, '{rule}' AS rule, id, {value} AS value, {context} AS context FROM {where} AND coalesce({bad}, false)" for rule, (bad, value) in rules.items())


def _issues_sql() -> str:
    bad_date = lambda c: f"{SECOND.format(c)} IS NULL AND {c} IS NOT NULL AND {c} <> ''"
    bad_int = lambda c: f"{c} IS NOT NULL AND {c} <> '' AND {INTEGER.format(c)} IS NULL"
    ident = {"id": (f"{REF.format('id')} IS NULL", "id"), "creation_date": (f"{SECOND.format('creation_date')} IS NULL", "creation_date")}
    votes_only = {"creation_date": ident["creation_date"]}
    question = {**ident, "last_edit_date": (bad_date("last_edit_date"), "last_edit_date"), "closed_date": (bad_date("closed_date"), "closed_date"), "score": (bad_int("score"), "score")}
    question |= {c: (f"({bad_int(c)}) OR {INTEGER.format(c)} < 0", c) for c in ("view_count", "answer_count", "comment_count")}
    question |= {f"{c}_before_question": (f"{MOMENT.format(c)} < {MOMENT.format('creation_date')}", c) for c in ("last_edit_date", "closed_date")}
    early = {"before_question": (f"{MOMENT.format('creation_date')} < asked", "creation_date")}
    child = "(SELECT z.*, q.said AS asked FROM {0} z JOIN q ON q.id_number = {1} AND q.said IS NOT NULL WHERE {2}) WHERE true"
    parts = [
        _issue_sql("questions", "posts WHERE post_type_id = '1'", question, "ParentId"), _issue_sql("answers", "posts WHERE post_type_id = '2'", {**ident, "score": (bad_int("score"), "score")}, "ParentId"), _issue_sql("comments", "comments WHERE true", ident, "PostId"),
        _issue_sql("votes", "votes WHERE vote_type_id = '1'", votes_only, "PostId"), _issue_sql("answers", child.format("posts", REF.format("z.parent_id"), "z.post_type_id = '2'"), early, "ParentId"), _issue_sql("comments", child.format("comments", REF.format("z.post_id"), "true"), early, "PostId"),
        _issue_sql("acceptances", "x WHERE true", {"before_question": ("day < CAST(asked AS DATE)", "CAST(day AS VARCHAR)"), "before_answer": ("day < CAST(posted AS DATE)", "CAST(day AS VARCHAR)")}, None),
    ]
    votes = f"v AS (SELECT {REF.format('post_id')} AS answer, min(CAST({SECOND.format('creation_date')} AS DATE)) AS day FROM votes WHERE vote_type_id = '1' GROUP BY 1)"
    return QA + f", {votes}, x AS (SELECT CAST(q.id_number AS VARCHAR) AS id, v.day, q.said AS asked, a.said AS posted FROM q JOIN v ON v.answer = q.accepted LEFT JOIN a ON a.id_number = q.accepted AND a.parent = q.id_number WHERE q.said IS NOT NULL) " + " UNION ALL ".join(parts)


@query(_issues_sql())
def data_issues(spark: SparkSession, d: str) -> DataFrame:
    return characteristics.issues(table(spark, d, "posts"), table(spark, d, "comments"), table(spark, d, "votes"))


# ---- scalar functions


@query("SELECT id, " + ", ".join(f"{c} AS {k}" for k, c in _measures_sql("body").items()) + " FROM posts")
def html_measures_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts").select("id", html_measures("body").alias("m")).select("id", "m.*")


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}]+)*')) AS run FROM documents)
SELECT d.doc_id, coalesce(n, 0) AS words FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM w WHERE NOT contains(run, '_') GROUP BY 1) USING (doc_id)"""
)
def text_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", word_count("text").alias("words"))


@query(f"SELECT id, {REF.format('parent_id')} AS parent, {DIGITS.format('accepted_answer_id')} AS accepted_digits, {MOMENT.format('creation_date')} AS created, {INTEGER.format('score')} AS points FROM posts")
def parsed_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts").select("id", reference_number("parent_id").alias("parent"), reference("accepted_answer_id").alias("accepted_digits"), valid_timestamp("creation_date").alias("created"), optional_integer("score").alias("points"))


@query("SELECT DISTINCT id, unnest(regexp_extract_all(coalesce(tags, ''), '<([^<>]+)>', 1)) AS tag FROM posts WHERE post_type_id = '1'")
def tags_explode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts").where("post_type_id = '1'").select("id", F.explode(tag_names("tags")).alias("tag")).distinct()


# ---- exploration of the characteristic table

OUTCOMES_SQL = "has_available_answer AS answered, accepted_answer_id IS NOT NULL AS accepted, closed_datetime IS NOT NULL AS closed"


def _outcomes() -> dict:
    return {"answered": F.col("has_available_answer"), "accepted": F.col("accepted_answer_id").isNotNull(), "closed": F.col("closed_datetime").isNotNull()}


def _tally_sql(name: str, conditions: dict[str, str]) -> str:
    parts = [f"SELECT {i} AS position, '{k}' AS {name}, count(*) FILTER ({c}) AS questions, round(100e0 * count(*) FILTER ({c}) / count(*), 6) AS percentage FROM t" for i, (k, c) in enumerate(conditions.items())]
    return T + " UNION ALL ".join(parts)


@query(_tally_sql("outcome", {"answered": "has_available_answer", "accepted": "accepted_answer_id IS NOT NULL", "closed": "closed_datetime IS NOT NULL", "unanswered": "NOT has_available_answer"}))
def overall_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = _outcomes()
    return explore.tally(_once(spark, d, "has_available_answer", "accepted_answer_id", "closed_datetime"), {**o, "unanswered": ~o["answered"]})


MEASURES = ["question_score", "question_view_count", "time_to_first_answer_hours", "median_answer_response_hours", "days_to_acceptance", "accepted_answer_score", "answer_score_spread", "accepted_answer_score_rank", "comments_before_first_answer"]


@query("SELECT * FROM (" + _tally_sql("measurement", {m: f"{m} IS NOT NULL" for m in MEASURES}).replace("questions, round", "available, round") + ") ORDER BY percentage, position LIMIT 8")
def availability(spark: SparkSession, d: str) -> DataFrame:
    return explore.availability(_once(spark, d, *MEASURES), {m: m for m in MEASURES}, 8)


CONSISTENCY = {"answers": ("stackexchange_answer_count", "available_answer_count"), "comments": ("stackexchange_comment_count", "available_question_comment_count")}


@query(_tally_sql("check_name", {**{k: f"{a} IS NOT NULL AND {a} <> {b}" for k, (a, b) in CONSISTENCY.items()}, "accepted_without_row": "accepted_answer_id IS NOT NULL AND NOT accepted_answer_available", "accepted_without_date": "accepted_answer_id IS NOT NULL AND acceptance_date IS NULL"}))
def consistency(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, *[c for p in CONSISTENCY.values() for c in p], "accepted_answer_id", "accepted_answer_available", "acceptance_date")
    accepted = F.col("accepted_answer_id").isNotNull()
    differ = {k: F.col(a).isNotNull() & (F.col(a) != F.col(b)) for k, (a, b) in CONSISTENCY.items()}
    return explore.tally(t, {**differ, "accepted_without_row": accepted & ~F.col("accepted_answer_available"), "accepted_without_date": accepted & F.col("acceptance_date").isNull()}, "check_name")


def _period_sql(unit: str) -> str:
    return T + (
        f", m AS (SELECT CAST(date_trunc('{unit}', asked) AS DATE) AS period, {OUTCOMES_SQL} FROM t WHERE asked IS NOT NULL), s AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 {unit})) AS DATE) AS period FROM m)"
        " SELECT s.period, count(m.period) AS questions, count(*) FILTER (answered) AS answered, count(*) FILTER (accepted) AS accepted, count(*) FILTER (closed) AS closed, count(m.period) - count(*) FILTER (answered) AS unanswered FROM s LEFT JOIN m USING (period) GROUP BY 1"
    )


def _periods(spark: SparkSession, d: str, unit: str) -> DataFrame:
    t = _once(spark, d, "question_creation_datetime", "has_available_answer", "accepted_answer_id", "closed_datetime")
    return explore.by_period(t, valid_timestamp("question_creation_datetime"), unit, _outcomes()).withColumn("unanswered", F.col("questions") - F.col("answered"))


@query(_period_sql("month"))
def periods_month(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d, "month")


@query(_period_sql("year"))
def periods_year(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d, "year")


@query(
    T
    + f""", e AS (SELECT 'posted' AS k, asked AS said FROM t UNION ALL SELECT 'answered', answered FROM t UNION ALL SELECT 'accepted', acceptance_date FROM t UNION ALL SELECT 'closed', closed FROM t),
m AS (SELECT CAST(date_trunc('month', said) AS DATE) AS month, k FROM e WHERE CAST(said AS DATE) <= {END}), s AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM m), DATE '2025-03-01', INTERVAL 1 month)) AS DATE) AS month),
n AS (SELECT s.month, count(*) FILTER (k = 'posted') AS p, count(*) FILTER (k = 'answered') AS a, count(*) FILTER (k = 'accepted') AS c, count(*) FILTER (k = 'closed') AS x FROM s LEFT JOIN m USING (month) GROUP BY 1),
r AS (SELECT month, CAST(sum(p) OVER w AS BIGINT) AS posted, CAST(sum(a) OVER w AS BIGINT) AS answered, CAST(sum(c) OVER w AS BIGINT) AS accepted, CAST(sum(x) OVER w AS BIGINT) AS closed FROM n WINDOW w AS (ORDER BY month))
SELECT *, greatest(posted - answered, 0) AS waiting FROM r"""
)
def cumulative(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "question_creation_datetime", "first_answer_creation_datetime", "acceptance_date", "closed_datetime")
    events = {"posted": valid_timestamp("question_creation_datetime"), "answered": valid_timestamp("first_answer_creation_datetime"), "accepted": F.col("acceptance_date").cast("timestamp_ntz"), "closed": valid_timestamp("closed_datetime")}
    return explore.cumulative(t, events, F.lit("2025-03-31").cast("date")).withColumn("waiting", F.greatest(F.col("posted") - F.col("answered"), F.lit(0)))


COHORT = T + (
    f", b AS (SELECT CAST(date_trunc('month', asked) AS DATE) AS cohort_month, CASE WHEN CAST(answered AS DATE) <= {END} THEN greatest(CAST(date_trunc('month', answered) AS DATE), CAST(date_trunc('month', asked) AS DATE)) END AS am FROM t WHERE asked IS NOT NULL),"
    " z AS (SELECT cohort_month, count(*) AS cohort_size FROM b GROUP BY 1), g AS (SELECT cohort_month, cohort_size, CAST(unnest(generate_series(cohort_month, DATE '2025-03-01', INTERVAL 1 month)) AS DATE) AS observation_month FROM z),"
    " v AS (SELECT g.cohort_month, g.observation_month, g.cohort_size, count(b.am) AS answered, round(100e0 * count(b.am) / g.cohort_size, 6) AS answered_percentage FROM g LEFT JOIN b ON b.cohort_month = g.cohort_month AND b.am <= g.observation_month GROUP BY 1, 2, 3)"
)


@query(COHORT + " SELECT * FROM v")
def cohorts(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "question_creation_datetime", "first_answer_creation_datetime")
    return explore.cohorts(t, valid_timestamp("question_creation_datetime"), valid_timestamp("first_answer_creation_datetime"), F.lit("2025-03-31").cast("date"))


@query(COHORT + ", y AS (SELECT cohort_month, max(cohort_size) AS cohort_size, max(CASE WHEN observation_month = cohort_month THEN answered END) AS same_month, max(answered) AS by_end FROM v GROUP BY 1) SELECT *, round(100e0 * same_month / cohort_size, 6) AS same_month_percentage, round(100e0 * by_end / cohort_size, 6) AS by_end_percentage FROM y")
def cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    return explore.cohort_summary(cohorts(spark, d))


SPECS = [explore.Spec(column, coverage, signed, whole, figure, title) for figure, title, column, coverage, signed, whole in DISTRIBUTIONS]


def _profile_sql() -> str:
    parts = []
    for s in SPECS:
        c, tail = f"CAST({s.column} AS DOUBLE)", (1 - s.coverage) / 2
        low = f"quantile_cont({c}, {tail}::DOUBLE)" if s.signed else f"greatest(0, min({c}))"
        high = f"quantile_cont({c}, {(1 - tail) if s.signed else s.coverage}::DOUBLE)"
        if s.whole:
            low, high = f"floor({low})", f"ceil({high})"
        parts.append(f"SELECT '{s.column}' AS measurement, {c} AS v, (SELECT {low} FROM t) AS low, (SELECT {high} FROM t) AS h0 FROM t WHERE {s.column} IS NOT NULL")
    return T + (
        f", u AS ({' UNION ALL '.join(parts)}), w AS (SELECT measurement, v, low, CASE WHEN h0 <= low THEN greatest(max(v) OVER (PARTITION BY measurement), low + 1) ELSE h0 END AS high FROM u),"
        " profile AS (SELECT measurement, count(*) AS available, min(low) AS low, min(high) AS high, count(*) FILTER (v BETWEEN low AND high) AS displayed, count(*) FILTER (v < low) AS below, count(*) FILTER (v > high) AS above, min(v) AS minimum, quantile_cont(v, 0.5) AS median, max(v) AS maximum FROM w GROUP BY 1)"
    )


ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in ("low", "high", "minimum", "median", "maximum"))
SPEC_ROWS = "(VALUES " + ", ".join(f"({i}, '{s.figure}', '{s.title}', '{s.column}', {s.whole})" for i, s in enumerate(SPECS)) + ") x(position, figure, title, measurement, whole)"


@query(_profile_sql() + f" SELECT measurement, available, displayed, below, above, {ROUNDED} FROM profile")
def profile(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).drop("edges").withColumns({c: F.round(c, 4) for c in ("low", "high", "minimum", "median", "maximum")})


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return explore.distribution_profiles(_once(spark, d, *[s.column for s in SPECS]), SPECS)


@query(
    _profile_sql()
    + f""", k AS (SELECT measurement, count(*) AS n, count(DISTINCT v) AS kinds, min(v) AS a, max(v) AS b, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS spread, min(low) AS low, min(high) AS high FROM w WHERE v BETWEEN low AND high GROUP BY 1),
e AS (SELECT k.*, x.whole AND high - low <= 30 AS unit, 2 * spread / cbrt(n) AS width FROM k JOIN {SPEC_ROWS} USING (measurement)),
c AS (SELECT *, CASE WHEN unit THEN CAST(high - low AS INTEGER) + 1 WHEN kinds < 2 THEN 1 ELSE least(30, greatest(8, CASE WHEN width > 0 THEN CAST(ceil((b - a) / width) AS INTEGER) ELSE 1 END)) END AS bins FROM e),
g AS (SELECT *, CAST(unnest(range(bins + 1)) AS INTEGER) AS place FROM c)
SELECT measurement, place, round(CASE WHEN unit THEN low - 0.5 + place WHEN kinds < 2 THEN a - 0.5 + place ELSE low + (high - low) * place / bins END, 6) AS edge FROM g"""
)
def profile_bins(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("measurement", F.posexplode("edges").alias("place", "edge")).withColumn("edge", F.round("edge", 6))


@query(
    _profile_sql()
    + f""" SELECT x.position, x.figure, x.title AS measurement, coalesce(available, 0) AS available, coalesce(displayed, 0) AS displayed, coalesce(below, 0) AS below, coalesce(above, 0) AS above, round(100e0 * displayed / available, 6) AS displayed_percentage,
round(median, 4) AS median, coalesce(format('{{:,.1f}}', low) || ' to ' || format('{{:,.1f}}', high), 'Unavailable') AS shown_range, round(minimum, 4) AS minimum, round(maximum, 4) AS maximum FROM {SPEC_ROWS} LEFT JOIN profile p USING (measurement)"""
)
def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    return explore.distribution_summary(_profiles(spark, d), SPECS).withColumns({c: F.round(c, 4) for c in ("median", "minimum", "maximum")})


@query(T + ", h AS (SELECT CAST(least(19, floor((CAST(question_word_count AS DOUBLE) - 0) / 400 * 20)) AS INTEGER) AS bin FROM t WHERE question_word_count BETWEEN 0 AND 400) SELECT b.bin, count(h.bin) AS n FROM (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin) b LEFT JOIN h USING (bin) GROUP BY 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return explore.histogram(_once(spark, d, "question_word_count"), "question_word_count", 0, 400, 20)


FENCED = list(FLAGGED)
FLAGS = T + f", f AS (SELECT {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), 0.75) + 1.5 * (quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS {c}_f' for c in FENCED)} FROM t), g AS (SELECT t.*, {', '.join(f'coalesce(t.{c} > f.{c}_f, false) AS {c}_high' for c in FENCED)}, {' + '.join(f'CAST(coalesce(t.{c} > f.{c}_f, false) AS INTEGER)' for c in FENCED)} AS high_count FROM t, f)"


def _flagged(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return explore.with_flags(_once(spark, d, *dict.fromkeys([*FENCED, *more])), FENCED)


@query(
    T
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS measurement, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3, round(quantile_cont(CAST({c} AS DOUBLE), 0.75) * 2.5 - quantile_cont(CAST({c} AS DOUBLE), 0.25) * 1.5, 4) AS fence, count({c}) AS available, count(*) FILTER ({c} > (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.75) + 1.5 * (quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) FROM t)) AS outliers, round(100e0 * count(*) FILTER ({c} > (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.75) + 1.5 * (quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) FROM t)) / count({c}), 6) AS share FROM t"
        for i, c in enumerate(FENCED)
    )
)
def tukey(spark: SparkSession, d: str) -> DataFrame:
    return explore.high_fences(_once(spark, d, *FENCED), FENCED).withColumns({c: F.round(c, 4) for c in ("q1", "q3", "fence")})


@query(FLAGS + " SELECT CAST(k.high_count AS INTEGER) AS high_count, count(g.high_count) AS questions FROM (SELECT unnest(range(9)) AS high_count) k LEFT JOIN g ON g.high_count = k.high_count GROUP BY 1")
def flags_histogram(spark: SparkSession, d: str) -> DataFrame:
    return explore.flag_histogram(_flagged(spark, d), len(FENCED))


@query(FLAGS + f" SELECT question_id, high_count, concat_ws('; ', {', '.join(f'CASE WHEN {c}_high THEN {chr(39)}{c}{chr(39)} END' for c in FENCED)}) AS high_names FROM g WHERE high_count > 0")
def outlier_rows(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).where("high_count > 0").select("question_id", "high_count", "high_names")


@query(FLAGS + f" SELECT {', '.join(NAMES)}, high_count AS high_outlier_field_count, concat_ws('; ', {', '.join(f'CASE WHEN {c}_high THEN {chr(39)}{label}{chr(39)} END' for c, label in FLAGGED.items())}) AS high_outlier_measurements FROM g WHERE high_count > 0")
def outlier_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The whole rows of flagged questions, as they are exported."""
    return explore.outlier_dataset(explore.with_flags(_once(spark, d), FENCED), NAMES, FLAGGED)


GROUP_SQL = "CASE WHEN high_count > 0 THEN 'one or more high' ELSE 'none high' END"


@query(FLAGS + f", o AS (SELECT {GROUP_SQL} AS grp, {OUTCOMES_SQL} FROM g) " + " UNION ALL ".join(f"SELECT grp, count(*) AS group_size, '{k}' AS outcome, count(*) FILTER ({k}) AS questions, round(100e0 * count(*) FILTER ({k}) / count(*), 6) AS percentage FROM o GROUP BY grp" for k in ("answered", "accepted", "closed")))
def outlier_groups(spark: SparkSession, d: str) -> DataFrame:
    return explore.group_outcomes(_flagged(spark, d, "has_available_answer", "accepted_answer_id", "closed_datetime"), _outcomes())


SPLIT = "SELECT DISTINCT question_id, trim(x) AS tag{more} FROM (SELECT *, unnest(string_split(question_tags, ';')) AS x FROM {src}) WHERE trim(x) <> ''"


@query(
    FLAGS
    + ", r AS ("
    + SPLIT.format(more=", high_count", src="g")
    + "), z AS (SELECT count(*) FILTER (high_count > 0) AS a, count(*) FILTER (high_count = 0) AS b FROM g), n AS (SELECT tag, count(*) FILTER (high_count > 0) AS high, count(*) FILTER (high_count = 0) AS rest FROM r GROUP BY 1), p AS (SELECT tag, high, rest, round(100e0 * high / a, 6) AS high_prevalence, round(100e0 * rest / b, 6) AS rest_prevalence FROM n, z) SELECT *, round(high_prevalence - rest_prevalence, 6) AS difference FROM p ORDER BY high DESC, tag LIMIT 20"
)
def tag_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return explore.tag_prevalence(_flagged(spark, d, "question_tags"), "question_tags", 20)


@query(
    T
    + ", r AS ("
    + SPLIT.format(more=", has_available_answer AS answered, accepted_answer_id IS NOT NULL AS accepted, closed_datetime IS NOT NULL AS closed", src="t")
    + "), n AS (SELECT tag, count(*) AS questions, count(*) FILTER (answered) AS answered, count(*) FILTER (accepted) AS accepted, count(*) FILTER (closed) AS closed FROM r GROUP BY 1) SELECT *, questions - answered AS unanswered, round(100e0 * answered / questions, 6) AS answered_percentage, round(100e0 * accepted / questions, 6) AS accepted_percentage, round(100e0 * closed / questions, 6) AS closed_percentage FROM n"
)
def tag_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return explore.tag_outcomes(_once(spark, d, "question_tags", "has_available_answer", "accepted_answer_id", "closed_datetime"), "question_tags", _outcomes())


@query(T + ", r AS (" + SPLIT.format(more="", src="t") + ") SELECT tag, count(*) AS questions FROM r GROUP BY 1 HAVING count(*) >= 20 ORDER BY questions DESC, tag LIMIT 24")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = _once(spark, d, "question_tags").select(F.explode(split_tags("question_tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("questions"))
    return counted.where("questions >= 20").orderBy(F.desc("questions"), "tag").limit(24)


@query(FLAGS + " SELECT question_id, left(coalesce(question_title, ''), 90) AS title, high_count, time_to_first_answer_hours, available_question_comment_count FROM g WHERE high_count > 0 ORDER BY high_count DESC, time_to_first_answer_hours DESC NULLS LAST, available_question_comment_count DESC NULLS LAST, question_id LIMIT 8")
def cases_topk(spark: SparkSession, d: str) -> DataFrame:
    return explore.inspection_cases(_flagged(spark, d, "question_title"), "time_to_first_answer_hours", "available_question_comment_count", "question_id", "question_title")


RANKED = list(CORRELATED)
_PAIRS = [(a, b) for i, a in enumerate(RANKED) for b in RANKED[i + 1 :] if (a, b) not in STRUCTURAL]
# Student's t by Simpson's rule over the angle whose sine is rho, and Benjamini and Hochberg over all pairs
RHO = (
    T
    + ", c0 AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{a}' AS first, '{b}' AS second, count(*) AS observations, corr(x, y) AS rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2e0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2e0 AS y FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL) HAVING count(*) >= 20 AND min(x) < max(x) AND min(y) < max(y)"
        for i, (a, b) in enumerate(_PAIRS)
    )
    + """), c1 AS (SELECT *, asin(least(1, abs(rho))) AS lo, least(pi() / 2, asin(least(1, abs(rho))) + 12 / sqrt(observations - 2)) AS hi FROM c0),
c2 AS (SELECT position, any_value(first) AS first, any_value(second) AS second, any_value(observations) AS observations, any_value(rho) AS rho,
 2 * exp(lgamma((any_value(observations) - 1) / 2e0) - lgamma((any_value(observations) - 2) / 2e0)) / sqrt(pi()) * any_value(hi - lo) / 6000 * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp((observations - 3) * ln(greatest(1e-300, cos(lo + (hi - lo) * k / 2000))))) AS p FROM c1, (SELECT unnest(range(2001)) AS k) GROUP BY position),
c3 AS (SELECT *, CASE WHEN abs(rho) >= 1 THEN 0 ELSE p END AS p_value FROM c2), c4 AS (SELECT *, row_number() OVER (ORDER BY p_value, position) AS r, count(*) OVER () AS n FROM c3),
rho AS (SELECT position, first, second, observations, rho, p_value, least(1, min(p_value * n / r) OVER (ORDER BY r DESC)) AS q_value FROM c4)
"""
)


def _rho(spark: SparkSession, d: str) -> DataFrame:
    return correlations.false_discovery(correlations.rank_correlations(_once(spark, d, *RANKED), RANKED, STRUCTURAL))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({"rho": F.round("rho", 6) + 0.0, "p_value": F.round("p_value", 7) + 0.0, "q_value": F.round("q_value", 7) + 0.0})


SHOWN = "position, first, second, observations, round(rho, 6) + 0 AS rho, round(p_value, 7) AS p_value, round(q_value, 7) AS q_value"


@query(RHO + f"SELECT {SHOWN} FROM rho")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_rho(spark, d))


@query(
    RHO
    + f", m AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in CORRELATED.items())}) x(name, label)) SELECT {SHOWN}, a.label || ' / ' || b.label AS pair_label FROM rho JOIN m a ON a.name = first JOIN m b ON b.name = second WHERE abs(rho) >= 0.3 AND q_value <= 0.05 ORDER BY abs(rho) DESC, position LIMIT 20"
)
def spearman_retained(spark: SparkSession, d: str) -> DataFrame:
    return _shown(correlations.retained(_rho(spark, d), labels=CORRELATED))


BH = "SELECT CAST(p_partkey AS INTEGER) AS position, p_retailprice / 1e6 AS p_value FROM part"


@query(f"WITH b AS ({BH}), r AS (SELECT *, row_number() OVER (ORDER BY p_value, position) AS r, count(*) OVER () AS n FROM b) SELECT position, p_value, round(least(1, min(p_value * n / r) OVER (ORDER BY r DESC)), 9) AS q_value FROM r")
def bh(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("cast(p_partkey as int) as position", "p_retailprice / 1e6D as p_value")
    return correlations.false_discovery(p).withColumn("q_value", F.round("q_value", 9))


CHECKS = {
    "rows_produced": ("FAIL", "count(*) > 0", "count(*)", "more than 0"), "columns_match": ("FAIL", "count(*) >= 0", "49 + 0 * count(*)", "exactly the contract''s columns"), "ids_present_and_unique": ("FAIL", "count(question_id) = count(*) AND count(DISTINCT question_id) = count(*)", "count(*) - count(DISTINCT question_id)", "no repeated or missing id"),
    **{k: (s, f"count(*) FILTER ({c}) = 0", f"count(*) FILTER ({c})", "0 rows") for k, s, c in [
        ("flag_available", "FAIL", "has_available_answer <> (available_answer_count > 0)"), ("flag_platform", "FAIL", "coalesce(has_stackexchange_answer <> (stackexchange_answer_count > 0), (has_stackexchange_answer IS NOT NULL) <> (stackexchange_answer_count IS NOT NULL))"),
        ("answers_differ", "WARN", "stackexchange_answer_count <> available_answer_count"), ("comments_differ", "WARN", "stackexchange_comment_count <> available_question_comment_count"), ("accepted_without_row", "WARN", "accepted_answer_id IS NOT NULL AND NOT accepted_answer_available"), ("accepted_without_date", "WARN", "accepted_answer_id IS NOT NULL AND acceptance_date IS NULL"), ("bad_observation", "FAIL", "coalesce(observation_days_at_dump < 0, true)"),
    ]},
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS check_name, CASE WHEN {ok} THEN 'PASS' ELSE '{level}' END AS status, CAST({seen} AS VARCHAR) AS observed, '{m}' AS meaning FROM thread_characteristics" for k, (level, ok, seen, m) in CHECKS.items()))
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return characteristics.validation(table(spark, d, "thread_characteristics"))


def _invariants_sql() -> str:
    asked, answered, closed, snap = MOMENT.format("question_creation_datetime"), MOMENT.format("first_answer_creation_datetime"), MOMENT.format("closed_datetime"), "CAST(dump_snapshot_date AS TIMESTAMP)"
    rules = {
        "flag_against_count": "has_available_answer <> (available_answer_count > 0)", "negative_count": " OR ".join(f"coalesce({c} < 0, false)" for c in NAMES if c.endswith("_count") or c.endswith("_hours")),
        "answer_before_question": f"{answered} < {asked}", "acceptance_before_question": f"acceptance_date < CAST({asked} AS DATE)", "question_after_snapshot": f"{asked} >= {snap} + INTERVAL 1 DAY", "answer_after_snapshot": f"{answered} > {snap}", "closed_after_snapshot": f"{closed} > {snap}",
    }
    parts = [f"SELECT '{k}' AS rule, count(*) FILTER ({c}) AS rows FROM thread_characteristics" for k, c in rules.items()]
    parts += ["SELECT 'repeated_id', count(*) - count(DISTINCT question_id) FROM thread_characteristics"] + [f"SELECT '{k}', greatest(0, count(DISTINCT {c}) - 1) FROM thread_characteristics" for k, c in (("other_sites", "site"), ("other_snapshots", "dump_snapshot_date"))]
    return " UNION ALL ".join(parts)


@query(_invariants_sql())
def table_invariants(spark: SparkSession, d: str) -> DataFrame:
    return characteristics.invariants(table(spark, d, "thread_characteristics"))


@query(
    T
    + "SELECT 0 AS position, 'answered' AS step, CASE WHEN count(*) > 0 THEN 'completed' ELSE 'no data' END AS status, count(*) AS rows FROM t WHERE has_available_answer UNION ALL SELECT 1, 'closed', CASE WHEN count(*) > 0 THEN 'completed' ELSE 'no data' END, count(*) FROM t WHERE closed_datetime IS NOT NULL UNION ALL SELECT 2, 'of another century', 'no data', count(*) FROM t WHERE CAST(asked AS DATE) < DATE '1900-01-01'"
)
def run_status(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "has_available_answer", "closed_datetime", "question_creation_datetime")
    return explore_table.run_status(spark, {"answered": t.where("has_available_answer"), "closed": t.where("closed_datetime is not null"), "of another century": t.where(F.to_date(valid_timestamp("question_creation_datetime")) < "1900-01-01")})


@query(T + "SELECT question_id, question_creation_datetime FROM t WHERE CAST(asked AS DATE) BETWEEN DATE '2023-01-01' AND DATE '2023-12-31'")
def period_select(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "question_creation_datetime", "dump_snapshot_date")
    return explore_table.select_period(t, "year_range", start_year=2023, end_year=2023)[0].select("question_id", "question_creation_datetime")


@query(_period_sql("month").replace("SELECT s.period, count", "SELECT * FROM (SELECT s.period, count") + ") QUALIFY row_number() OVER (ORDER BY period) <= 12 OR row_number() OVER (ORDER BY period DESC) <= 12")
def periods_head_tail(spark: SparkSession, d: str) -> DataFrame:
    p = _periods(spark, d, "month")
    return p.orderBy("period").limit(12).union(p.orderBy(F.desc("period")).limit(12)).distinct()


@query(f"WITH p AS ({_period_sql('month')}) SELECT *, max(questions) OVER () AS largest, round(CAST(questions AS DOUBLE) / max(questions) OVER (), 6) AS share_of_largest FROM p")
def axis_shares(spark: SparkSession, d: str) -> DataFrame:
    return explore.axis_shares(_periods(spark, d, "month"), "questions")


@query(f"WITH p AS ({_period_sql('month')}) (SELECT *, 'largest' AS extreme FROM p ORDER BY questions DESC, period LIMIT 1) UNION ALL (SELECT *, 'least' FROM p ORDER BY questions, period LIMIT 1)")
def period_extremes(spark: SparkSession, d: str) -> DataFrame:
    return explore.extremes(_periods(spark, d, "month"), "questions", "period")


@query("SELECT 'p_brand' AS column, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2")
def catalogue_accounts(spark: SparkSession, d: str) -> DataFrame:
    return workbook.catalogue_accounts(table(spark, d, "part"), "p_brand", "p_type")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def catalogue_repeats(spark: SparkSession, d: str) -> DataFrame:
    return workbook.repeated_names(table(spark, d, "part"), "p_name")


@query("SELECT n_regionkey AS r_regionkey, n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def schema_join(spark: SparkSession, d: str) -> DataFrame:
    return workbook.current_output(table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, d, "region"), "r_regionkey")


@query("WITH a AS (SELECT id, vote_type_id FROM votes), b AS (SELECT DISTINCT id, vote_type_id FROM votes) SELECT id, vote_type_id, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT id, vote_type_id, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def drift(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "votes").select("id", "vote_type_id")
    return workbook.drift(v, v.distinct())


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS rows, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def streaming_days(spark: SparkSession, d: str) -> DataFrame:
    """The extension: daily windows over a stream, every one closed by a mark far beyond the last row."""
    source = table(spark, d, "events")
    marks = fresh_path(spark, "mark")
    spark.range(1).selectExpr("timestamp'2200-01-01' as ts", "'' as event_type").write.parquet(marks)
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    stream = rows.unionByName(spark.readStream.schema("ts timestamp, event_type string").parquet(marks))
    out = fresh_path(spark, "days")
    plan = daily_outcomes(stream, "ts", "1 day", {"purchases": F.col("event_type") == "purchase"})
    plan.writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, "stream")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(plan.schema).parquet(out).where("day < '2199-01-01'")


# ---- sources and sinks, by writing a table and reading it back

XML_COLUMNS = ["Id", "PostTypeId", "ParentId", "CreationDate", "Score", "Title", "Tags", "Body"]


def _written_xml(spark: SparkSession, d: str) -> str:
    out = fresh_path(spark, "xml")
    table(spark, d, "posts").select(*[F.col(xml.snake(c)).alias(f"_{c}") for c in XML_COLUMNS]).write.format("xml").option("rowTag", "row").option("rootTag", "posts").option("attributePrefix", "_").option("valueTag", "_value_of_row").save(out)
    return out


@query("SELECT id, post_type_id, parent_id, creation_date, score, title, tags, body FROM posts")
def xml_rows(spark: SparkSession, d: str) -> DataFrame:
    """The typed scan: absent attributes null, empty ones empty, blanks kept."""
    return xml.read_rows(spark, _written_xml(spark, d), XML_COLUMNS)


@query("SELECT id, CAST((id IS NOT NULL)::INT + (post_type_id IS NOT NULL)::INT + (parent_id IS NOT NULL)::INT + (creation_date IS NOT NULL)::INT + (score IS NOT NULL)::INT + (title IS NOT NULL)::INT + (tags IS NOT NULL)::INT + (body IS NOT NULL)::INT AS BIGINT) AS attributes, title, concat_ws(',', CASE WHEN id IS NOT NULL THEN 'Id' END, CASE WHEN post_type_id IS NOT NULL THEN 'PostTypeId' END, CASE WHEN parent_id IS NOT NULL THEN 'ParentId' END, CASE WHEN creation_date IS NOT NULL THEN 'CreationDate' END, CASE WHEN score IS NOT NULL THEN 'Score' END, CASE WHEN title IS NOT NULL THEN 'Title' END, CASE WHEN tags IS NOT NULL THEN 'Tags' END, CASE WHEN body IS NOT NULL THEN 'Body' END) AS names FROM posts")
def xml_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The lossless scan: which attributes each row has, in their order."""
    rows = xml.read_all_attributes(spark, _written_xml(spark, d).removeprefix("file://") + "/part-*")
    return rows.select(xml.attribute("Id").alias("id"), F.size("attrs").cast("bigint").alias("attributes"), xml.attribute("Title").alias("title"), F.array_join(F.transform("attrs", lambda a: a["name"]), ",").alias("names"))


@query("SELECT id, coalesce(parent_id, '') AS parent_id, coalesce(creation_date, '') AS creation_date, coalesce(title, '') AS title, coalesce(tags, '') AS tags FROM posts")
def tsv_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table written as TSV parts without passing the driver, and read again."""
    out = fresh_path(spark, "tsv")
    rows = table(spark, d, "posts").select("id", "parent_id", "creation_date", "title", "tags")
    publish.write_tsv_distributed(rows, out)
    back = spark.read.csv(out, sep="\t", schema=rows.schema, multiLine=True, quote='"', escape='"', emptyValue="", lineSep="\r\n")
    return back.fillna("")


@query("SELECT p_partkey, CASE WHEN v >= 1000 THEN format('{:,.0f}', v) WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE format('{:.1f}', v) END AS label FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN floor(p_retailprice) ELSE p_retailprice END * CASE WHEN p_partkey % 2 = 0 THEN 1000 ELSE 0.5 END AS v FROM part)")
def number_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.when(F.col("p_partkey") % 3 == 0, F.floor("p_retailprice").cast("double")).otherwise(F.col("p_retailprice")) * F.when(F.col("p_partkey") % 2 == 0, 1000.0).otherwise(0.5)).alias("v"))
    return p.select("p_partkey", number_label("v").alias("label"))


@query("SELECT * FROM (VALUES (0, '7'), (1, '12'), (2, '300')) t(place, id)")
def requested_ids(spark: SparkSession, d: str) -> DataFrame:
    """Requested ids in the order of their first occurrence, without leading zeros and repetitions."""
    return spark.createDataFrame(list(enumerate(threads.requested(["007", " 12 ", "7", "300", "0012"]))), "place int, id string")


# ---- references between records


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(table(spark, d, "posts"), table(spark, d, "comments"), table(spark, d, "removed_posts"))


P7 = f"""
WITH p AS (SELECT {REF.format('id')} AS row_id, min(loaded_at) AS loaded_at, max(creation_date) AS creation_date, max({DIGITS.format('accepted_answer_id')}) AS acc, max({DIGITS.format('parent_id')}) AS par FROM posts GROUP BY 1),
c AS (SELECT {REF.format('id')} AS row_id, min(loaded_at) AS loaded_at, max(creation_date) AS creation_date, max({DIGITS.format('post_id')}) AS pid FROM comments GROUP BY 1),
r AS (SELECT 'posts' AS source_table, row_id, 'accepted_answer_id' AS field_name, acc AS ref, loaded_at, creation_date FROM p
      UNION ALL SELECT 'posts', row_id, 'parent_id', par, loaded_at, creation_date FROM p
      UNION ALL SELECT 'comments', row_id, 'post_id', pid, loaded_at, creation_date FROM c),
f AS (SELECT r.*, CASE WHEN p.row_id IS NOT NULL THEN CASE WHEN p.loaded_at > r.loaded_at THEN 'late' END WHEN d.post_id IS NOT NULL THEN 'removed' ELSE 'missing' END AS status
      FROM r LEFT JOIN p ON try_cast(r.ref AS BIGINT) = p.row_id LEFT JOIN (SELECT DISTINCT post_id FROM removed_posts) d ON try_cast(r.ref AS BIGINT) = d.post_id
      WHERE r.ref IS NOT NULL AND r.row_id IS NOT NULL)
"""


@query(P7 + "SELECT source_table, row_id, field_name, status FROM f WHERE status IS NOT NULL")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("creation_date")


@query(P7 + f"SELECT source_table, field_name, strftime({SECOND.format('creation_date')}, '%Y-%m') AS month, status, count(*) AS orphans FROM f WHERE status IS NOT NULL GROUP BY 1, 2, 3, 4")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return characteristic_table(spark, d)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["flagship", "oracle_sql", "positive_id", "queries"]
