import random
from collections import Counter
from itertools import combinations

import numpy as np

from threadloom.functions.text import visible_text, words
from threadloom.llm import neardup


def test_masks_cover():
    """Two masks share one coordinate at most, and no ORDER - 1 coordinates touch all masks."""
    m = neardup.masks()
    rng = np.random.default_rng(0)
    assert all(len(set(a) & set(b)) <= 1 for a, b in combinations(m.tolist(), 2))
    touched = np.zeros((len(m), neardup.ORDER * neardup.COLUMNS), bool)
    touched[np.arange(len(m))[:, None], m] = True
    assert touched.sum(axis=0).max() == neardup.ORDER and len(m) == neardup.ORDER**2
    for _ in range(2000):
        assert (~touched[:, rng.choice(touched.shape[1], neardup.ORDER - 1, replace=False)].any(axis=1)).any()


def test_loss_at_the_threshold_is_small():
    assert neardup.missed(0.8) < 0.001 and neardup.missed(0.86) < 1e-4 and neardup.missed(0.8, groups=3) < 1e-4


def test_bags_count_repeats():
    element, begins = neardup.bags([["a", "b", "a"], ["b", "a"], [], ["a", "a", "b"]])
    parts = [set(element[a:b].tolist()) for a, b in zip(begins, begins[1:])]
    assert [len(p) for p in parts] == [3, 2, 0, 3] and parts[0] == parts[3] and parts[1] < parts[0]


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(150):
        docs.append([rng.choice(vocabulary) for _ in range(rng.randint(25, 120))])
    for base in list(docs[:60]):
        new = list(base)
        for _ in range(max(1, len(new) // 12)):
            k = rng.randrange(len(new))
            new[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] if rng.random() < 0.6 else []
        if rng.random() < 0.5:
            cut = rng.randrange(len(new))
            new = new[cut:] + new[:cut]
        docs.append(new)
    docs += [docs[3]] * 4 + [["short"] * 19, ["common"] * 25, ["common"] * 27]
    return [(i + 1, "t" if i % 2 else None, f"<p>{' '.join(d)}</p>") for i, d in enumerate(docs)]


def test_against_brute_force(spark, make):
    docs = corpus()
    posts = make["posts"](*[dict(id=str(i), post_type_id="1", title=t, body=b) for i, t, b in docs], dict(id="1", post_type_id="1", title=docs[0][1], body=docs[0][2]), dict(id="900", post_type_id="1"), dict(id="901", post_type_id="1", body=""), dict(id="902", post_type_id="2", body=docs[0][2]))
    bags = {i: Counter(words(t or "") + words(visible_text(b))) for i, t, b in docs if len(words(visible_text(b))) >= 20}
    want = {(a, b) for a, b in combinations(sorted(bags), 2) if 2 * (bags[a] & bags[b]).total() >= 0.8 * (bags[a].total() + bags[b].total()) - 1e-9}
    found = neardup.similar_pairs(neardup.questions(posts))
    got = {tuple(r) for r in found.collect()}
    assert got == want
    assert {tuple(r) for r in neardup.similar_pairs(neardup.questions(posts), crowded=4).collect()} == want  # all buckets split into cells
    groups = {r["id"]: r["group_id"] for r in neardup.groups(found).collect()}
    assert groups == {r["id"]: r["group_id"] for r in neardup.similar_groups(neardup.questions(posts)).collect()}
    assert all(groups[a] == groups[b] for a, b in got) and all(g <= i for i, g in groups.items())
    assert neardup.similar_pairs(neardup.questions(posts.where("false"))).count() == 0


def test_groups_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "id_a bigint, id_b bigint")
    got = {r["id"]: r["group_id"] for r in neardup.groups(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def texts_and_copies(other, pairs=120):
    """Texts of 100 words, and copies of them that agree in exactly 0.8; other(k, n) is the n-th word that copy k has instead."""
    rng = random.Random(5)
    texts = [rng.sample([f"v{i}" for i in range(300)], 100) for _ in range(pairs)]
    for k in range(pairs):
        new = list(texts[k])
        for n, at in enumerate(rng.sample(range(100), 20)):
            new[at] = other(k, n)
        texts.append(new)
    return texts, {(k + 1, k + 1 + pairs) for k in range(pairs)}


def pairs_of(spark, texts, repeat=1):
    rows = [(i + 1, None, " ".join(t)) for i, t in enumerate(texts)] * repeat
    return {tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(rows, "id bigint, title string, body string")).collect()}


def test_pairs_in_a_corpus_of_many_words(spark):
    """Pairs whose differing words no other text holds are found whatever number of words the corpus has."""
    texts, want = texts_and_copies(lambda k, n: f"only{k}x{n}")
    texts += [[f"filler{i}x{j}" for j in range(1000)] for i in range(300)]
    assert pairs_of(spark, texts) == want


def test_pairs_that_differ_in_rare_words(spark):
    """Pairs of exactly 0.8 are found if the words that differ are rare but stand in another text too."""
    texts, want = texts_and_copies(lambda k, n: f"rare{k}x{n}")
    texts += [[f"rare{k}x{n}" for n in range(20)] + [f"own{k}x{n}" for n in range(30)] for k in range(120)]
    assert pairs_of(spark, texts) == want


def test_repeated_rows_change_nothing(spark):
    texts, want = texts_and_copies(lambda k, n: f"only{k}x{n}")
    assert pairs_of(spark, texts, repeat=3) == want


def test_pairs_that_differ_in_frequent_words(spark):
    texts, want = texts_and_copies(lambda k, n: f"often{n}")
    texts += [[f"often{n}" for n in range(20)] + [f"own{k}x{n}" for n in range(80)] for k in range(200)]
    assert pairs_of(spark, texts) >= want


def test_sketches_never_drop_a_pair():
    rng = np.random.default_rng(2)
    bags = [rng.choice(400, rng.integers(20, 300), replace=False) for _ in range(120)]
    hashed = neardup.mix(np.arange(400, dtype=np.uint64))
    sizes = np.array([len(b) for b in bags])
    sketch = neardup.parities(hashed[np.concatenate(bags)], np.append(0, np.cumsum(sizes)))
    x, y = neardup.close(sizes, sketch, np.full(120, 120), 1, 2)
    alike = {(i, j) for i, j in combinations(range(120), 2) if 4 * len(np.intersect1d(bags[i], bags[j])) >= len(bags[i]) + len(bags[j])}
    assert alike <= set(zip(x.tolist(), y.tolist()))
