"""Queries of the training-data operators, by problem, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, conversations, defects, neardup, packing, pairs, percentiles, pii, spans
from threadloom.session import materialize, table


MEASURES = ("time_to_first_answer_hours", "median_answer_response_hours")


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per site and month of the question, and per site (null month) from the combined states of its months."""
    once = percentiles.questions_once(table(spark, d, "thread_characteristics"), MEASURES)
    months = materialize(percentiles.state(once, ["site", "month"], MEASURES), "months")
    return percentiles.percentiles(months.unionByName(percentiles.roll_up(months, "month"))).select("grp.site", "grp.month", "measure", "basis_points", "value", "n")


def p1_sites(spark: SparkSession, d: str) -> DataFrame:
    """Per site alone: a few rows at any size."""
    once = percentiles.questions_once(table(spark, d, "thread_characteristics"), MEASURES)
    return percentiles.percentiles(percentiles.state(once, ["site"], MEASURES)).select("grp.site", "measure", "basis_points", "value", "n")


ERROR = 0.01


def p1_compressed(spark: SparkSession, d: str) -> DataFrame:
    """Per site from compressed states of its months, and whether each value is within the stated relative error of the exact one."""
    once = percentiles.questions_once(table(spark, d, "thread_characteristics"), MEASURES)
    months = materialize(percentiles.state(once, ["site", "month"], MEASURES), "months")
    of = lambda s: percentiles.percentiles(percentiles.roll_up(s, "month")).select("grp.site", "measure", "basis_points", "value", "n")
    exact, near = of(months), of(percentiles.compress(months, ERROR)).withColumnsRenamed({"value": "near", "n": "k"})
    close = (F.col("n") == F.col("k")) & (F.abs(F.col("near") - F.col("value")) <= F.abs("value") * ERROR * 1.000001)
    return exact.join(near, exact["site"].eqNullSafe(near["site"]) & (exact["measure"] == near["measure"]) & (exact["basis_points"] == near["basis_points"])).select(exact["site"], exact["measure"], exact["basis_points"], "n", close.alias("within_error"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.broken_pairs(table(spark, d, "posts"), table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.above_chance(pairs.associations(pairs.question_tags(table(spark, d, "posts")), least=5))
    return found.selectExpr("item_a AS tag_a", "item_b AS tag_b")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.scored(pairs.associations(pairs.question_tags(table(spark, d, "posts")))).withColumnsRenamed({"item_a": "tag_a", "item_b": "tag_b"})


def p3_user_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Tags that the same users ask about: a busy user's basket is huge."""
    return pairs.scored(pairs.row_associations(pairs.user_tags(table(spark, d, "posts")))).withColumnsRenamed({"item_a": "tag_a", "item_b": "tag_b"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(neardup.questions(table(spark, d, "posts"))).selectExpr("id_a AS question_id_a", "id_b AS question_id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(neardup.questions(table(spark, d, "posts"))).withColumnRenamed("id", "question_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "posts"), table(spark, d, "comments"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "posts"), table(spark, d, "comments"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.find_broken(table(spark, d, "posts"), table(spark, d, "comments"))


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.turns(table(spark, d, "posts"), table(spark, d, "comments"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_table(table(spark, d, "documents"))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "container_sizes"), bpe.DEFAULT_TOKENIZERS)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p9_packing(spark, d))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing, for each kind of container."""
    return packing.checks(p9_packing(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.found(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_percentiles, p1_sites, p1_compressed, p2_found, p3_found, p3_pairs, p3_user_pairs, p4_found, p4_groups, p5_found, p5_redacted, p6_found, p6_turns, p8_ids, p9_packing, p9_fill, p9_checks, p10_found, p10_shares)}


P1 = """
WITH u AS (SELECT DISTINCT ON (question_id) question_id, site, question_creation_datetime[:7] AS month, time_to_first_answer_hours AS a, median_answer_response_hours AS b FROM thread_characteristics WHERE question_id IS NOT NULL ORDER BY question_id, dump_snapshot_date DESC),
v AS (SELECT site, month, 'time_to_first_answer_hours' AS measure, a AS value FROM u UNION ALL SELECT site, month, 'median_answer_response_hours', b FROM u),
z AS (SELECT * FROM v UNION ALL SELECT site, NULL, measure, value FROM v),
w AS (SELECT *, row_number() OVER (PARTITION BY site, month, measure ORDER BY value) AS r, count(*) OVER (PARTITION BY site, month, measure) AS n FROM z WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))
SELECT site, month, measure, p.bp AS basis_points, value, n FROM w, (SELECT unnest([500, 1000, 2500, 5000, 7500, 9000, 9500, 9900]) AS bp) p WHERE r = greatest(1, (n * p.bp + 9999) // 10000)
"""

P3 = r"""
WITH q AS (SELECT try_cast(nullif(regexp_extract(id, '^\s*0*([1-9][0-9]*)\s*$', 1), '') AS BIGINT) AS id, max(tags) AS tags FROM posts WHERE post_type_id = '1' GROUP BY 1),
t AS (SELECT DISTINCT id, lower(trim(x)) AS tag FROM (SELECT id, unnest(regexp_extract_all(tags, '<([^<>]*)>', 1)) AS x FROM q WHERE id IS NOT NULL) WHERE trim(x) <> ''),
s AS (SELECT tag, count(*) AS n FROM t GROUP BY 1),
m AS (SELECT count(DISTINCT id) AS n FROM t),
x AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM t a JOIN t b ON a.id = b.id AND a.tag < b.tag GROUP BY 1, 2),
y AS (SELECT x.*, sa.n AS n_a, sb.n AS n_b, m.n AS n FROM x JOIN s sa ON sa.tag = tag_a JOIN s sb ON sb.tag = tag_b, m)
"""


REF = r"try_cast(nullif(regexp_extract({}, '^\s*0*([1-9][0-9]*)\s*$', 1), '') AS BIGINT)"
DAY = r"CASE WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\.[0-9]+)?') AND try_cast(left({0}, 19) AS TIMESTAMP) IS NOT NULL THEN left({0}, 19) || regexp_replace(regexp_replace({0}[20:], '0+$', ''), '^\.$', '') END"
SHOWS = r"coalesce(regexp_matches(regexp_replace(regexp_replace({}, '(?s)<!--.*?-->|<[a-zA-Z/!?][^>]*>', ' ', 'g'), '&nbsp;|&#160;|&#8203;|&#xA0;|&#x200B;', ' ', 'g'), '[^\s\p{{Z}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]'), false)"
P6 = f"""
WITH p AS (SELECT {REF.format('id')} AS id, post_type_id AS t, {REF.format('parent_id')} AS par, {DAY.format('creation_date')} AS said, {SHOWS.format('body')} AS shown FROM posts WHERE post_type_id IN ('1', '2')),
q AS (SELECT DISTINCT id, said, shown FROM p WHERE t = '1' AND id IS NOT NULL),
a AS (SELECT DISTINCT id, par, said, shown FROM p WHERE t = '2' AND id IS NOT NULL AND par IS NOT NULL),
k AS (SELECT id AS post, id AS conv FROM q UNION SELECT id, par FROM a),
c AS (SELECT DISTINCT {REF.format('id')} AS id, k.conv, {DAY.format('creation_date')} AS said FROM comments JOIN k ON {REF.format('post_id')} = k.post),
r AS (SELECT par AS conv, said FROM a UNION ALL SELECT conv, said FROM c WHERE id IS NOT NULL),
x AS (SELECT q.id, q.said, q.shown, (SELECT count(*) FROM a WHERE a.par = q.id AND a.shown) AS replies, (SELECT count(*) FROM r WHERE r.conv = q.id AND r.said IS NULL) AS bad, (SELECT min(r.said) FROM r WHERE r.conv = q.id) AS first FROM q)
"""
P6_REASONS = """
SELECT DISTINCT par AS conversation_id, 'no_question' AS reason FROM a WHERE par NOT IN (SELECT id FROM q)
UNION ALL SELECT id, 'empty_question' FROM x WHERE NOT shown
UNION ALL SELECT id, 'no_reply' FROM x WHERE replies = 0
UNION ALL SELECT id, 'undated' FROM x WHERE said IS NULL OR bad > 0
UNION ALL SELECT id, 'early_reply' FROM x WHERE first < said
"""
P1_SITES = P1.replace("z AS (SELECT * FROM v UNION ALL SELECT site, NULL, measure, value FROM v)", "z AS (SELECT site, NULL AS month, measure, value FROM v)").replace("SELECT site, month, measure, p.bp", "SELECT site, measure, p.bp")
P1_COMPRESSED = P1_SITES.replace("basis_points, value, n FROM", "basis_points, n, true AS within_error FROM")
P3_USERS = P3.replace("q AS (SELECT", "o AS (SELECT").replace("AS id, max(tags) AS tags FROM", "AS id, max(owner_user_id) AS owner, max(tags) AS tags FROM").replace("t AS (SELECT DISTINCT id,", "t AS (SELECT DISTINCT owner AS id,").replace("(SELECT id, unnest(regexp_extract_all(tags, '<([^<>]*)>', 1)) AS x FROM q WHERE id IS NOT NULL)", "(SELECT owner, unnest(regexp_extract_all(tags, '<([^<>]*)>', 1)) AS x FROM o WHERE id IS NOT NULL AND owner IS NOT NULL)")
SCORES = "SELECT *, round(n_ab * n / (n_a * n_b), 4) AS lift, round(log2(n_ab * n / (n_a * n_b)), 4) AS pmi, round(n_ab / n, 6) AS support FROM y"
P6_TURNS = f"""
, bad AS ({P6_REASONS}),
m0 AS (SELECT {REF.format('id')} AS id, CASE WHEN post_type_id = '1' THEN {REF.format('id')} ELSE {REF.format('parent_id')} END AS conv, CAST(post_type_id AS INTEGER) AS kind, owner_user_id AS usr, {DAY.format('creation_date')} AS said, body AS text FROM posts WHERE post_type_id IN ('1', '2')
 UNION ALL SELECT {REF.format('comments.id')}, k.conv, 3, user_id, {DAY.format('creation_date')}, text FROM comments JOIN k ON {REF.format('post_id')} = k.post),
m AS (SELECT DISTINCT * FROM m0 WHERE id IS NOT NULL AND conv IN (SELECT id FROM q) AND conv NOT IN (SELECT conversation_id FROM bad)),
w AS (SELECT m.*, max(usr) FILTER (kind = 1) OVER (PARTITION BY conv) AS asker, row_number() OVER (PARTITION BY conv ORDER BY said, kind, id) AS turn FROM m)
SELECT conv AS conversation_id, turn, CASE WHEN kind = 1 OR usr = asker THEN 'asker' WHEN kind = 2 THEN 'answerer' ELSE 'commenter' END AS role, id AS message_id, CASE WHEN kind = 3 THEN 'comments' ELSE 'posts' END AS source, said AS said_at, text FROM w
"""
P9_CHECKS = "SELECT container_name, capacity_tokens, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS incomplete, CAST(0 AS BIGINT) AS split_needlessly, true AS filled_well FROM container_sizes"
P10 = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
h AS (SELECT doc_id, i, hash(substr(text, CAST(i AS INTEGER), 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d)),
g AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
w AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM g))
"""
P10_SHARES = P10 + """
, o AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS onward, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS back FROM w),
s AS (SELECT doc_id, CAST(sum(least(200, coalesce(onward - i, 200))) AS BIGINT) AS n, count(*) FILTER (back IS NULL OR i > back + 200) AS k FROM o GROUP BY 1)
SELECT doc_id, coalesce(length(text), 0) AS characters, coalesce(n, 0) AS shared_characters, coalesce(round(n / length(text), 6), 0) AS shared_part, coalesce(k, 0) AS spans FROM documents LEFT JOIN s USING (doc_id)
"""
TEXT = r"replace(replace(replace(replace(replace(replace(regexp_replace({}, '(?s)<!--.*?-->|<[a-zA-Z/!?][^>]*>', ' ', 'g'), '&nbsp;', ' '), '&commat;', '@'), '&#x40;', '@'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
WORDS = r"regexp_extract_all(regexp_replace(lower({}), '[\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}\x{{ad}}]', '', 'g'), '[\p{{L}}\p{{N}}]+')"
P4 = f"""
WITH RECURSIVE q AS (SELECT {REF.format('id')} AS id, any_value(coalesce(title, '')) AS title, any_value(coalesce(body, '')) AS body FROM posts WHERE post_type_id = '1' GROUP BY 1),
w AS (SELECT id, {WORDS.format(TEXT.format('body'))} AS own, {WORDS.format('title')} || {WORDS.format(TEXT.format('body'))} AS words FROM q WHERE id IS NOT NULL),
b AS (SELECT id, word, count(*) AS k FROM (SELECT id, unnest(words) AS word FROM w WHERE len(own) >= 20) GROUP BY 1, 2),
s AS (SELECT id, sum(k) AS n FROM b GROUP BY 1),
c AS (SELECT x.id AS one, y.id AS two, sum(least(x.k, y.k)) AS common FROM b x JOIN b y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2),
near AS (SELECT one, two FROM c JOIN s sa ON sa.id = one JOIN s sb ON sb.id = two WHERE 10 * common >= 4 * (sa.n + sb.n)),
"""
P4_GROUPS = P4 + """
e AS (SELECT one, two FROM near UNION SELECT two, one FROM near),
r AS (SELECT one AS id, one AS reached FROM e UNION SELECT r.id, e.two FROM r JOIN e ON e.one = r.reached)
SELECT id AS question_id, min(reached) AS group_id FROM r GROUP BY 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": P4.rstrip().removesuffix(",") + " SELECT one AS question_id_a, two AS question_id_b FROM near",
        "p4_groups": P4_GROUPS,
        "p1_percentiles": P1,
        "p6_found": P6 + P6_REASONS,
        "p6_turns": P6 + P6_TURNS,
        "p1_sites": P1_SITES,
        "p1_compressed": P1_COMPRESSED,
        "p3_user_pairs": P3_USERS + SCORES,
        "p9_checks": P9_CHECKS,
        "p10_found": P10 + "SELECT DISTINCT doc_id FROM w",
        "p10_shares": P10_SHARES,
        "p3_found": P3 + "SELECT tag_a, tag_b FROM y WHERE n_ab >= 5 AND n_ab * n >= 4 * n_a * n_b",
        "p3_pairs": P3 + SCORES,
    }
