import pytest
from pyspark.sql import functions as F

from threadloom.operators import correlations, explore, skew

from conftest import rows_of


def test_fences(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 100)], "a int")
    r = explore.high_fences(df, ["a"]).first()
    assert (r["q1"], r["q3"], r["fence"], r["outliers"]) == (2, 4, 7, 1)
    flagged = explore.with_flags(df, ["a"])
    assert rows_of(explore.flag_histogram(flagged, 2)) == [(0, 4), (1, 1), (2, 0)]
    groups = explore.group_outcomes(flagged.where("high_count = 0"), {"big": F.col("a") > 2}).collect()
    assert {(r["grp"], r["group_size"], r["percentage"]) for r in groups} == {(explore.GROUPS[0], 0, None), (explore.GROUPS[1], 4, 50.0)}


def test_distribution(spark):
    p = explore.distribution_profiles(spark.range(10).withColumnRenamed("id", "a"), [explore.Spec("a", 0.90)]).first()
    assert (p["high"], p["displayed"], len(p["edges"]), p["edges"][0], p["edges"][-1]) == (9, 10, 11, -0.5, 9.5)
    many = spark.range(2000).select((F.col("id") * F.col("id") / 1000).alias("a"))
    p = explore.distribution_profiles(many, [explore.Spec("a", 0.95, whole=False)]).first()
    assert p["displayed"] + p["below"] + p["above"] == p["available"] == 2000 and 9 <= len(p["edges"]) <= 31
    none = explore.distribution_profiles(many.where("false"), [explore.Spec("a")])
    assert none.count() == 0
    row = explore.distribution_summary(none, [explore.Spec("a", figure="1a", title="A")]).first()
    assert (row["figure"], row["measurement"], row["available"], row["shown_range"], row["median"]) == ("1a", "A", 0, "Unavailable", None)
    bars = explore.axis_shares(spark.createDataFrame([("x", 4), ("y", 1)], "k string, n int"), "n").collect()
    assert {(r["k"], r["largest"], r["share_of_largest"]) for r in bars} == {("x", 4, 1.0), ("y", 4, 0.25)}
    with pytest.raises(ValueError):
        explore.distribution_profiles(many, [explore.Spec("a", 0.4)])


def test_periods_and_cohorts(spark):
    df = spark.createDataFrame([("2024-01-05", "2024-03-01"), ("2024-01-20", None), ("2024-03-02", "2024-03-03")], "q string, a string").select(F.col("q").cast("date").alias("q"), F.col("a").cast("date").alias("a"))
    months = rows_of(explore.by_period(df, F.col("q"), "month", {"answered": F.col("a").isNotNull()}))
    assert [(str(m), n, k) for m, n, k in months] == [("2024-01-01", 2, 1), ("2024-02-01", 0, 0), ("2024-03-01", 1, 1)]
    end = F.lit("2024-04-30").cast("date")
    total = explore.cumulative(df, {"posted": F.col("q"), "answered": F.col("a")}, end).orderBy("month").collect()
    assert [(r["posted"], r["answered"]) for r in total] == [(2, 0), (2, 0), (3, 2), (3, 2)]
    grid = explore.cohorts(df, F.col("q"), F.col("a"), end).orderBy("cohort_month", "observation_month").collect()
    assert [r["answered"] for r in grid] == [0, 0, 1, 1, 1, 1]
    assert {(r["cohort_size"], r["same_month"], r["by_end"]) for r in explore.cohort_summary(explore.cohorts(df, F.col("q"), F.col("a"), end)).collect()} == {(2, 0, 1), (1, 1, 1)}


def test_correlations(spark):
    df = spark.range(40).select(F.col("id").alias("a"), (-F.col("id")).alias("b"), (F.col("id") % 2).alias("c"), F.lit(1).alias("d"))
    got = {(r["first"], r["second"]): r for r in correlations.rank_correlations(df, list("abcd")).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")} and got["a", "b"]["rho"] == -1 and got["a", "b"]["p_value"] == 0
    assert abs(correlations.two_sided_p(0.5, 20) - 0.0247696) < 1e-6 and abs(correlations.two_sided_p(2.228 / (10 + 2.228**2) ** 0.5, 12) - 0.05) < 1e-4
    q = correlations.false_discovery(spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.03, 0.04, 0.5))], "position int, p_value double")).orderBy("position").collect()
    assert [round(r["q_value"], 4) for r in q] == [0.04, 0.0533, 0.0533, 0.5]
    many = spark.range(3000).select(F.col("id").cast("int").alias("position"), F.when(F.col("id") % 7 == 0, 0.01).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("p_value"))
    values = sorted((r["p_value"], r["position"]) for r in many.collect())
    want, least = {}, 1.0
    for i in range(len(values), 0, -1):
        least = min(least, values[i - 1][0] * len(values) / i)
        want[values[i - 1][1]] = least
    assert {r["position"]: pytest.approx(r["q_value"]) for r in correlations.false_discovery(many).collect()} == want
    kept = correlations.retained(correlations.false_discovery(correlations.rank_correlations(df, list("abc"))), labels={"a": "First"}).collect()
    assert [r["pair_label"] for r in kept] == ["First / b"]
    assert correlations.rank_correlations(df, ["a", "b"], excluded=[("b", "a")]).count() == 0
    plain = correlations.average_ranks(spark.createDataFrame([(1,), (1,), (3,)], "x int"), ["x"])
    assert sorted(r["_rank_x"] for r in plain.collect()) == [1.5, 1.5, 3.0]


def test_skew_join(spark):
    left = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"))
    right = spark.range(1, 2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = skew.hot_keys(left, "k", least=100)
    assert hot == [1]
    assert rows_of(skew.skew_join(left, right, "k", "row", hot=hot).select("row", "v")) == rows_of(left.join(right, "k").select("row", "v"))


def test_quantiles_of_any_size(spark):
    import random

    import numpy as np

    from threadloom.operators.quantiles import exact_quantiles, group_medians

    rng = random.Random(3)
    rows = [(i % 5, rng.choice([rng.lognormvariate(0, 4), 1.0, -2.5, 0.0]), None) for i in range(3000)] + [(9, float("nan"), None), (9, None, None), (8, 4.0, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    probabilities = [0, 0.005, 0.25, 0.5, 0.75, 0.99, 1]
    values = [x for _, x, _ in rows if x is not None and x == x]
    got = exact_quantiles(df, {"x": probabilities, "y": [0.5], "g": [0.5]})
    assert np.allclose(got["x"], np.quantile(values, probabilities), rtol=1e-12) and got["y"] == [None] and got["g"] == [2.0]
    medians = {r["g"]: r["median"] for r in group_medians(df.where("not isnan(x)"), "g", "x", 1.5).collect()}
    assert medians == {g: np.median([x for k, x, _ in rows if k == g and x is not None and x == x]) for g in (0, 1, 2, 3, 4, 8)}
