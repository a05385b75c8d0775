import math
import random
from collections import Counter
from itertools import combinations

from threadloom.llm import pairs, percentiles


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    baskets = [(i, sorted(rng.sample("abcdefghijkl", rng.randint(1, 4)))) for i in range(200)] + [(1000, sorted(f"t{k:03}" for k in range(150))), (1001, sorted(f"t{k:03}" for k in range(140, 215)))]
    want = Counter(p for _, b in baskets for p in combinations(b, 2))
    single = Counter(x for _, b in baskets for x in b)
    df = spark.createDataFrame(baskets, "id bigint, items array<string>")
    for chunk in (64, 7):
        got = pairs.associations(df, chunk=chunk).collect()
        assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in got} == want
        assert all((r["n_a"], r["n_b"], r["n"]) == (single[r["item_a"]], single[r["item_b"]], len(baskets)) for r in got)
    rows = spark.createDataFrame([(i, x) for i, b in baskets for x in b], "id bigint, item string")
    for chunk in (64, 7):
        got = pairs.row_associations(rows, chunk=chunk).collect()
        assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in got} == want
        assert all((r["n_a"], r["n_b"], r["n"]) == (single[r["item_a"]], single[r["item_b"]], len(baskets)) for r in got)
    assert pairs.row_associations(rows.where("false")).count() == 0
    frequent = {(r["item_a"], r["item_b"]) for r in pairs.above_chance(pairs.associations(df, least=5)).collect()}
    assert frequent == {p for p, n in want.items() if n >= 5 and n * len(baskets) >= 4 * single[p[0]] * single[p[1]]}


def test_tags(make):
    df = make["posts"](
        dict(id="1", post_type_id="1", tags="<B>< a ><><a>"), dict(id="1", post_type_id="1", tags="<B>< a ><><a>"), dict(id=" 2 ", post_type_id="1", tags=None), dict(id="3", post_type_id="1", tags=""), dict(id="4", post_type_id="2", tags="<a><b>"), dict(id="x", post_type_id="1", tags="<a>"),
    )
    assert [tuple(r) for r in pairs.question_tags(df).collect()] == [(1, ["a", "b"])]
    assert pairs.associations(pairs.question_tags(df.where("false"))).count() == 0


def nearest(values, bp):
    values = sorted(values)
    return values[max(1, -(-len(values) * bp // 10000)) - 1]


def test_percentiles_exact(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.lognormvariate(1, 3), 0.0, -0.0, -rng.random(), 5.0, 1e300, -1e300, 1e-300])) for g in "aab" * 300]
    rows += [("n", None), ("n", math.nan), ("i", math.inf), (None, 1.0), (None, 2.0), ("one", 3.0)]
    df = spark.createDataFrame([(g, v, 1) for g, v in rows], "site string, x double, n int")
    got = {}
    for r in percentiles.percentiles(percentiles.state(df, ["site"], ["x"])).collect():
        got.setdefault(r["grp"]["site"], {})[r["basis_points"]] = r["value"]
    groups = {}
    for g, v in rows:
        if v is not None and math.isfinite(v):
            groups.setdefault(g, []).append(v)
    assert got == {g: {bp: nearest(v, bp) for bp in percentiles.PERCENTILES} for g, v in groups.items()}
    few = percentiles.percentiles(percentiles.state(df, ["site"], ["x"]), parts=2).collect()
    assert {(r["grp"]["site"], r["basis_points"], r["value"]) for r in few} == {(g, bp, v) for g, x in got.items() for bp, v in x.items()}
    assert percentiles.percentiles(percentiles.state(df.where("false"), ["site"], ["x"])).count() == 0


def test_states_add_up(spark):
    df = spark.range(1000).selectExpr("'s' AS site", "cast(id % 7 AS string) AS part", "pow(1.01, id) AS x")
    key = lambda d: sorted((r["basis_points"], r["value"], r["n"]) for r in d.collect())
    whole = key(percentiles.percentiles(percentiles.state(df, ["site"], ["x"])))
    parts = [percentiles.state(df.where(f"part = '{i}'"), ["site"], ["x"]) for i in range(7)]
    assert key(percentiles.percentiles(percentiles.merge(*parts))) == whole
    rolled = percentiles.roll_up(percentiles.state(df, ["site", "part"], ["x"]), "part")
    assert key(percentiles.percentiles(rolled)) == whole
    rough = key(percentiles.percentiles(percentiles.merge(*[percentiles.compress(p, 0.01) for p in parts])))
    assert all(abs(a[1] - b[1]) <= 0.0101 * b[1] for a, b in zip(rough, whole))


def test_each_question_once(spark):
    df = spark.createDataFrame([("1", "s", "2024-12-31", "2020-01-05T", 1.0), ("1", "s", "2024-12-31", "2020-01-05T", 1.0), ("1", "s", "2025-03-31", "2020-01-05T", 4.0), (None, "s", "2024-12-31", "x", 9.0)], "question_id string, site string, dump_snapshot_date string, question_creation_datetime string, h double")
    assert [(r["question_id"], r["h"]) for r in percentiles.questions_once(df, ["h"]).collect()] == [("1", 4.0)]
