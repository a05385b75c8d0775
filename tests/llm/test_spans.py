import random

from threadloom.llm import spans


def brute(docs, length):
    owners = {}
    for key, text in docs:
        for i in range(len(text or "") - length + 1):
            owners.setdefault(text[i : i + length], set()).add(key)
    marked = {}
    for key, text in docs:
        c = bytearray(len(text or ""))
        for i in range(len(c) - length + 1):
            if len(owners[text[i : i + length]]) > 1:
                c[i : i + length] = b"\1" * length
        marked[key] = sum(c)
    return marked


def make_docs():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdé \n漢😀", k=n))
    docs = [(i, text(rng.randint(0, 500))) for i in range(60)]
    for n in (39, 40, 41, 60, 95, 120, 300):  # planted runs, one just too short
        run = text(n)
        for key in rng.sample(range(60), 2):
            old = docs[key][1]
            at = rng.randint(0, len(old))
            docs[key] = (key, old[:at] + run + old[at:])
    whole = text(200)
    docs += [(100 + i, whole) for i in range(20)]  # copies
    docs += [(200 + i, text(50) + whole[30:72] + text(50)) for i in range(8)]
    docs += [(300, "ab" * 4000), (301, None), (302, ""), (303, "x" * 39), (304, "x" * 45), (305, "x" * 44)]
    return docs


def test_against_brute_force(spark):
    docs = make_docs()
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id bigint, text string, anchor int, start int")
    want = brute(docs, 40)
    assert {r[0] for r in spans.found(df, length=40, gram=16).collect()} == {k for k, n in want.items() if n}
    got = {r["doc_id"]: r for r in spans.shares(df, length=40, gram=16).collect()}
    assert {k: r["shared_characters"] for k, r in got.items()} == want
    assert got[301]["characters"] == 0 and got[301]["shared_part"] == 0.0


def test_repeated_rows_are_one_record(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=400))
    df = spark.createDataFrame([(1, text), (1, text), (2, "z")], "doc_id bigint, text string")
    assert spans.found(df).count() == 0
    assert spans.found(df.where("false")).count() == 0
    assert [tuple(r) for r in spans.spans(df.union(spark.createDataFrame([(3, "q" + text[100:310])], df.schema))).orderBy("id").collect()] == [(1, 100, 310), (3, 1, 211)]
