import datetime as dt

from threadloom.operators.references import key_runs, match_runs, orphan_report, orphans

from conftest import rows_of

T1, T2, T3 = (dt.datetime(2024, 1, d) for d in (1, 2, 3))
REMOVED = "post_id bigint, post_type_id string, removed_at timestamp_ntz"


def test_orphans(spark, make):
    posts = make["posts"](
        dict(id="1", post_type_id="1", accepted_answer_id=" 0002 ", creation_date="2024-01-01T00:00:00", loaded_at=T1),
        dict(id="2", post_type_id="2", parent_id="1", loaded_at=T2),
        dict(id="2", post_type_id="2", parent_id="1", loaded_at=T3),  # the same record again
        dict(id="4", post_type_id="2", parent_id="9", loaded_at=T1, creation_date="no date"),
        dict(id="5", post_type_id="2", parent_id="x1", loaded_at=T1),
        dict(id="6", post_type_id="2", parent_id="0", loaded_at=T1),
        dict(id="7", post_type_id="2", parent_id="99999999999999999999", loaded_at=None),
        dict(id=None, post_type_id="2", parent_id="77", loaded_at=T1),
    )
    comments = make["comments"](dict(id="20", post_id="8", loaded_at=T1), dict(id="21", post_id="2", loaded_at=T1), dict(id="22", post_id="2", loaded_at=T2), dict(id="23", loaded_at=T1))
    removed = spark.createDataFrame([(8, "1", T1), (8, "1", T2), (1, "1", T1)], REMOVED)
    got = rows_of(orphans(posts, comments, removed).drop("creation_date"))
    assert got == sorted([("posts", 1, "accepted_answer_id", "late"), ("posts", 4, "parent_id", "missing"), ("posts", 7, "parent_id", "missing"), ("comments", 20, "post_id", "removed"), ("comments", 21, "post_id", "late")], key=repr)
    report = rows_of(orphan_report(orphans(posts, comments, removed)))
    assert ("posts", "accepted_answer_id", "2024-01", "late", 1) in report and sum(r[-1] for r in report) == 5
    assert orphans(make["posts"](), make["comments"](), removed).count() == 0


def test_runs(spark):
    keys = [*range(10, 20), 21, 65534, 65535, 65536, 65537, 200000]
    runs = key_runs(spark.createDataFrame([(k, T1) for k in keys], "key bigint, loaded_at timestamp_ntz"))
    assert sorted((r["start"], r["stop"]) for r in runs.collect()) == [(10, 19), (21, 21), (65534, 65535), (65536, 65537), (200000, 200000)]
    asked = [1, 10, 15, 19, 20, 21, 22, 65536, 65538, 200000, 300000]
    refs = spark.createDataFrame([(k, T1) for k in asked], "key bigint, earliest timestamp_ntz")
    got = {r["key"]: r["present"] for r in match_runs(refs, runs).collect()}
    assert got == {k: k in keys for k in asked}
