import datetime as dt

from threadloom.llm import conversations

T = lambda d: dt.datetime(2024, 1, d)


def test_conversations(spark, make):
    q = dict(post_type_id="1", body="<p>q</p>", creation_date="2024-01-01T00:00:00.5", loaded_at=T(1), owner_user_id="7")
    a = dict(post_type_id="2", body="a", creation_date="2024-01-01T00:00:01", loaded_at=T(2), owner_user_id="8")
    posts = make["posts"](
        dict(q, id="1"), dict(q, id="1"), dict(a, id="10", parent_id="1"), dict(q, id="2"), dict(q, id="3", body="&nbsp;"), dict(a, id="11", parent_id="3", body="<p></p>"),
        dict(a, id="12", parent_id="99"), dict(q, id="4", creation_date="2024-02-30T00:00:00"), dict(a, id="13", parent_id=" 04 "), dict(q, id="5"), dict(a, id="14", parent_id="5", creation_date="2024-01-01T00:00:00.49999999"),
        dict(q, id="6"), dict(a, id="15", parent_id="6", loaded_at=None), dict(a, id="16", parent_id=None), dict(a, id="x", parent_id="6", creation_date=None), dict(id="17", post_type_id="5", parent_id="6"),
    )
    c = dict(creation_date="2024-01-01T00:00:02", text="c", user_id="7")
    comments = make["comments"](dict(c, id="30", post_id="1", loaded_at=T(20)), dict(c, id="31", post_id="10", creation_date="2024-01-01T00:00:00.6", loaded_at=T(5)), dict(c, id="32", post_id="15", creation_date="bad", loaded_at=T(6)), dict(c, id="33", post_id="12", creation_date="bad", loaded_at=T(6)), dict(c, id="34", post_id="777", loaded_at=T(6)))
    want = {(2, "no_reply"), (3, "empty_question"), (3, "no_reply"), (99, "no_question"), (4, "undated"), (5, "early_reply"), (6, "undated")}
    for releases in (1, 4):
        assert {tuple(r) for r in conversations.find_broken(posts, comments, releases=releases).collect()} == want
    turns = [(r["conversation_id"], r["turn"], r["role"], r["message_id"]) for r in conversations.turns(posts, comments).orderBy("conversation_id", "turn").collect()]
    assert turns == [(1, 1, "asker", 1), (1, 2, "asker", 31), (1, 3, "answerer", 10), (1, 4, "asker", 30)]
    assert conversations.find_broken(posts.where("false"), comments.where("false")).count() == 0


def _message(conversation, message, kind, day, month=1, said="2024-01-01T00:00:00"):
    return (conversation, message, kind, "7", said, True, dt.datetime(2024, month, day))


def _run(spark, tmp_path, batches, **how):
    """The rows emitted after each batch of arrivals."""
    out, seen = [], 0
    for rows in batches:
        spark.createDataFrame(rows, conversations.MESSAGE).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(conversations.MESSAGE).parquet(str(tmp_path / "in"))
        query = conversations.closures(stream, shards=3, spread=1, **how).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        all_rows = sorted((r["conversation_id"], r["message_id"]) for r in spark.read.schema(conversations.MESSAGE).parquet(str(tmp_path / "out")).collect())
        out.append(all_rows)
    return out


def test_state_buffers_late_messages_and_closes(spark, tmp_path):
    """A conversation waits for late messages, closes once the watermark has passed it, and may come out in parts."""
    got = _run(
        spark, tmp_path,
        [
            [_message(1, 1, 1, 1), _message(2, 2, 1, 3)],
            [_message(1, 10, 2, 2), _message(2, 11, 2, 20)],  # the first arrives out of order, yet not late
            [_message(3, 3, 1, 20, 2)],  # watermark: 13 February; conversation 1 has waited over 30 days
            [_message(2, 12, 3, 15, 2), _message(0, 0, 0, 1, 12)],  # a later part of 2, then the closing mark
        ],
    )
    assert got[0] == got[1] == []
    assert got[2] == [(1, 1), (1, 10)]
    assert got[3] == [(1, 1), (1, 10), (2, 2), (2, 11), (2, 12), (3, 3)]


def test_parts_of_a_conversation_add_up(spark):
    """Parts that were closed apart are one conversation when it is validated."""
    closed = spark.createDataFrame([_message(1, 1, 1, 1), _message(1, 5, 2, 9, 5), _message(2, 6, 2, 1)], conversations.MESSAGE)
    assert [tuple(r) for r in conversations.validate(closed).collect()] == [(2, "no_question")]


def test_turns_query_holds_the_messages(spark, make, tmp_path):
    from threadloom.llm.queries import queries

    at = dict(creation_date="2024-01-01T00:00:00", loaded_at=T(1))
    q, a = dict(at, id="1", post_type_id="1", body="<p>Why?</p>"), dict(at, id="2", post_type_id="2", parent_id="1", body="<p>So.</p>")
    make["posts"](q, q, a).write.parquet(str(tmp_path / "posts.parquet"))
    make["comments"](dict(at, id="1", post_id="2", text="Thanks"), dict(at, id="2", post_id="1", text=None)).write.parquet(str(tmp_path / "comments.parquet"))
    got = [(r["turn"], r["message_id"], r["source"], r["text"]) for r in queries()["p6_turns"](spark, str(tmp_path)).orderBy("turn").collect()]
    assert got == [(1, 1, "posts", "<p>Why?</p>"), (2, 2, "posts", "<p>So.</p>"), (3, 1, "comments", "Thanks"), (4, 2, "comments", None)]
