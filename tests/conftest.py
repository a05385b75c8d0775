import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from threadloom.session import local_session

    session = local_session("threadloom-tests", cores="4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


POST = "site string, id string, post_type_id string, accepted_answer_id string, parent_id string, creation_date string, score string, view_count string, body string, owner_user_id string, owner_display_name string, last_activity_date string, title string, tags string, answer_count string, comment_count string, last_edit_date string, closed_date string, content_license string, loaded_at timestamp_ntz, key string, value string, cls string, block string, n string"
COMMENT = "site string, id string, post_id string, score string, text string, creation_date string, user_id string, content_license string, loaded_at timestamp_ntz, key string, kind string, n string"
VOTE = "id string, post_id string, vote_type_id string, creation_date string"


def _frame(spark, schema, rows):
    """Rows given as dicts; columns left out are null. The schema also has columns whose names clash with those of operators."""
    names = [c.split()[0] for c in schema.split(", ")]
    for r in rows:
        assert set(r) <= set(names), set(r) - set(names)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="session")
def make(spark):
    return {"posts": lambda *rows: _frame(spark, POST, rows), "comments": lambda *rows: _frame(spark, COMMENT, rows), "votes": lambda *rows: _frame(spark, VOTE, rows)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
