import random
from collections import Counter, defaultdict

from threadloom.llm import packing


def best_fit(capacity, lengths):
    """One item at a time, longest first, into the fullest container that takes it."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        runs, bins = packing.plan(capacity, Counter(lengths))
        assert bins == best_fit(capacity, lengths)
        load, seen = defaultdict(int), Counter()
        for r in runs:
            for rank in range(r.start, r.stop):
                load[r.first_bin + (rank - r.start) // r.per_bin] += r.length
                seen[r.length] += 1
        assert seen == Counter(lengths) and max(load.values(), default=0) <= capacity and len(load) == bins


def test_pack(spark, monkeypatch):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 3, 5, 5, 5, 8, 13, 40, 101])) for i in range(600)] + [(600, None), (601, 7), (601, 7)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([("s", 10), ("l", 64), ("l", 64), ("none", None), ("zero", 0)], "container_name string, capacity_tokens bigint")
    results = []
    for salted, joined in ((packing.ROWS_A_SALT, packing.RUNS_BROADCAST), (20, packing.RUNS_BROADCAST), (20, 0)):
        monkeypatch.setattr(packing, "ROWS_A_SALT", salted)
        monkeypatch.setattr(packing, "RUNS_BROADCAST", joined)
        rows = packing.pack(df, kinds).collect()
        results.append(len(rows))
        for name, capacity in (("s", 10), ("l", 64)):
            mine = [r for r in rows if r["container_name"] == name]
            load = Counter()
            for r in mine:
                load[r["container_no"]] += r["n_tokens"]
            assert max(load.values()) <= capacity
            items = [min(capacity, (n or 0) - k * capacity) for _, n in sizes for k in range(max(1, -(-(n or 0) // capacity)))]
            assert sorted(items) == sorted(r["n_tokens"] for r in mine)
            assert len({r["container_no"] for r in mine}) == best_fit(capacity, [x for x in items if x])
            assert len({(r["doc_id"], r["piece_no"], r["container_no"]) for r in mine if r["doc_id"] != 601}) == len([r for r in mine if r["doc_id"] != 601])
    assert len(set(results)) == 1
    assert packing.pack(df.where("false"), kinds).count() == 0 and packing.pack(df, kinds.where("false")).count() == 0
