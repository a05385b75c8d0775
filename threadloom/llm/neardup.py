"""Near-duplicate records with small edits (problem 4) by covering hashing of sampled elements.

A record is the bag of its words; its elements are (word, occurrence), so the shared part of two bags is a plain set
intersection whatever the words' order. Equal bags are one class throughout.

* Sampling: each coordinate is the least hash of a bag's elements under its own hash function, so two bags agree in a
  coordinate with their Jaccard similarity, whatever their words are; no word is weighed and no count of the corpus
  enters, so recall is the same at every size.
* Covering: a group has COLUMNS x ORDER coordinates, and one mask for each line of the affine plane of that order, which
  holds one coordinate of each column. Two lines meet in one coordinate at most, and fewer than ORDER coordinates cannot
  touch all lines: two bags that differ in at most ORDER - 1 coordinates of a group agree in some mask and collide.
* Loss: a pair at the threshold exactly (0.8, which is Jaccard 2/3) misses both groups with probability 0.0005, at 0.82
  with 0.0001, at 0.86 with 0.000002. `missed` computes this; `groups` more groups lower it further.
* Checks of those that collide drop no true pair: first sizes and a 256-bit parity sketch (what two bags share cancels in
  the exclusive or, so more bits than the sizes allow mean a lower similarity), then the bags themselves.

A bucket of more than CROWDED classes is split into chunks, and every pair of chunks is a task's cell of its own. Null
texts are empty; records with fewer than `least` body words take no part; rows with one id are one record; an empty
table gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import positive_id
from threadloom.functions.text import visible_text, words
from threadloom.llm.spans import SEED, mix, salt
from threadloom.session import discard, materialize

ORDER, COLUMNS, GROUPS = 7, 5, 2  # ORDER is a prime, at least COLUMNS
SKETCH = 256
CROWDED = 4096
SKETCHES = [f"s{i}" for i in range(SKETCH // 64)]
KEY_ROWS = "key bigint, cls bigint, n int, " + ", ".join(f"{s} bigint" for s in SKETCHES)


def masks() -> np.ndarray:
    """Lines x COLUMNS: the coordinates of each line y = m x + b over the columns x."""
    return np.array([[x * ORDER + (m * x + b) % ORDER for x in range(COLUMNS)] for m in range(ORDER) for b in range(ORDER)])


def missed(similarity: float, groups: int = GROUPS, trials: int = 100_000, seed: int = 0) -> float:
    """Estimated probability that a pair of this similarity collides in no mask."""
    agree = np.random.default_rng(seed).random((trials, ORDER * COLUMNS)) < similarity / (2 - similarity)
    return float((~agree[:, masks()].all(axis=2).any(axis=1)).mean() ** groups)


def bags(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted element hashes of each word list in a row, and where each list begins (one more than lists)."""
    import xxhash

    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.append(0, np.cumsum(sizes))
    coded = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = hashes[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((word, owner))
    word = word[order]
    fresh = np.empty(len(word), bool)
    fresh[:1] = True
    fresh[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    occurrence = np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))
    element = mix(word + occurrence.astype(np.uint64) * SEED)
    return element[np.lexsort((element, owner))], begins


def bag_table(df: DataFrame, least: int) -> DataFrame:
    """(id, cls, bag) of df(id, title, body); cls is the hash of the whole bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, texts = [], []
            for i, (title, body) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                own = words(visible_text(body))
                if len(own) >= least:
                    keep.append(i)
                    texts.append(words(title or "") + own)
            if keep:
                element, begins = bags(texts)
                total = np.add.reduceat(mix(element ^ SEED), begins[:-1]) + np.diff(begins).astype(np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(element.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(mix(total).view(np.int64)), lists], ["id", "cls", "bag"])

    return df.select("id", "title", "body").mapInArrow(run, "id bigint, cls bigint, bag array<bigint>")


def keys(elements: np.ndarray, begins: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """records x masks: the key under which each mask of each group files a record. Every bag has at least one element."""
    lines, out = masks(), []
    for g in range(groups):
        least = np.array([np.minimum.reduceat(mix(elements + salt(g * ORDER * COLUMNS + c + 1)), begins[:-1]) for c in range(ORDER * COLUMNS)])
        for number, line in enumerate(lines):
            key = np.full(len(begins) - 1, salt(g * len(lines) + number + 1))
            for c in line:
                key = mix(key ^ least[c]) + SEED
            out.append(key)
    return np.array(out).T


def parities(elements: np.ndarray, begins: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """records x (bits / 64): the bits under which an odd number of a record's elements is filed."""
    records = len(begins) - 1
    at = np.repeat(np.arange(records), np.diff(begins)) * bits + (elements & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=records * bits) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(records, bits // 64)


def key_table(rows: DataFrame, groups: int) -> DataFrame:
    """KEY_ROWS of rows(id, cls, bag): one row per class and mask and input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            fresh = [i for i, c in enumerate(b.column(0).to_pylist()) if not (c in seen or seen.add(c))]
            for i in range(0, len(fresh), 256):
                some = b.take(pa.array(fresh[i : i + 256]))
                elements, begins = some.column(1).flatten().to_numpy().view(np.uint64), some.column(1).offsets.to_numpy().astype(np.int64)
                begins = begins - begins[0]
                filed, sketch = keys(elements, begins, groups), parities(elements, begins)
                each = filed.shape[1]
                columns = [filed.ravel().view(np.int64), np.repeat(some.column(0).to_numpy(), each), np.repeat(np.diff(begins).astype(np.int32), each)]
                columns += [np.repeat(np.ascontiguousarray(s).view(np.int64), each) for s in sketch.T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "cls", "n", *SKETCHES])

    return rows.select("cls", "bag").mapInArrow(run, KEY_ROWS)


def close(n: np.ndarray, sketch: np.ndarray, ends: np.ndarray, share_num: int, share_den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket (row i's bucket ends before ends[i]) whose sizes and sketches allow the similarity."""
    n, at, found = n.astype(np.int64), np.arange(len(n)), []
    step = 0
    while len(at):
        step += 1
        at = at[at + step < ends[at]]
        other = at + step
        both = n[at] + n[other]
        fits = 2 * share_den * np.minimum(n[at], n[other]) >= share_num * both
        x, y, both = at[fits], other[fits], both[fits]
        apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
        alike = share_den * apart <= (share_den - share_num) * both
        found.append((x[alike], y[alike]))
    return np.concatenate([x for x, _ in found] or [at]), np.concatenate([y for _, y in found] or [at])


def meet(rows: DataFrame, share_num: int, share_den: int, crowded: int) -> DataFrame:
    """Of KEY_ROWS that lie together and sorted by (key, cls): (a, b) candidates, and the rows of buckets over `crowded`."""
    names = ["a", "b", "key", "cls", "n", *SKETCHES]

    def pairs(own: list[np.ndarray]) -> pa.RecordBatch:
        key, cls, n = own[:3]
        once = np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))
        key, cls, n, sketch = key[once], cls[once], n[once], np.stack([s[once].view(np.uint64) for s in own[3:]], axis=1)  # bits of signed numbers are counted without sign
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(key)))
        x, y = close(n, sketch, np.repeat(first + sizes, sizes), share_num, share_den)
        both = np.unique(np.stack([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])], axis=1), axis=0)
        return of(pa.array(both[:, 0]), pa.array(both[:, 1]), None)

    def of(a: pa.Array | None, b: pa.Array | None, own: list[np.ndarray] | None) -> pa.RecordBatch:
        count, kinds = len(own[0]) if own else len(a), [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * len(SKETCHES)]
        rest = [pa.array(c) for c in own] if own else [pa.nulls(count, k) for k in kinds]
        return pa.RecordBatch.from_arrays([a or pa.nulls(count, pa.int64()), b or pa.nulls(count, pa.int64()), *rest], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        overfull = None  # the key whose rows are passed on
        for b in batches:
            if not b.num_rows:
                continue
            new = [c.to_numpy() for c in b.columns]
            held = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            if overfull is not None:
                own = int(np.searchsorted(held[0], overfull, "right"))
                if own:
                    yield of(None, None, [c[:own] for c in held])
                held = [c[own:] for c in held]
                if not len(held[0]):
                    continue
                overfull = None
            last = int(np.searchsorted(held[0], held[0][-1], "left"))
            if last:
                yield from settled([c[:last] for c in held])
                held = [c[last:] for c in held]
            if len(held[0]) > crowded:
                overfull = held[0][-1]
                yield of(None, None, held)
                held = [c[:0] for c in held]
        if held is not None and len(held[0]):
            yield from settled(held)

    def settled(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Whole buckets: the pairs of ordinary ones, the rows of those over `crowded`."""
        first = np.flatnonzero(np.append(True, own[0][1:] != own[0][:-1]))
        sizes = np.diff(np.append(first, len(own[0])))
        large = np.repeat(sizes > crowded, sizes)
        if large.any():
            yield of(None, None, [c[large] for c in own])
            own = [c[~large] for c in own]
        if len(own[0]):
            yield pairs(own)

    return rows.mapInArrow(run, "a bigint, b bigint, " + KEY_ROWS)


def candidates(rows: DataFrame, share_num: int, share_den: int, groups: int = GROUPS, crowded: int = CROWDED) -> DataFrame:
    """(a, b), a < b: classes of rows(id, cls, bag) that share a key and whose sizes and sketches allow the similarity."""
    together = lambda df: df.repartition("key").sortWithinPartitions("key", "cls")
    met = materialize(meet(together(key_table(rows, groups)), share_num, share_den, crowded), "met")
    members = met.where("key is not null").select("key", "cls", "n", *SKETCHES).dropDuplicates(["key", "cls"])
    chunks = members.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(crowded)).cast("int").alias("chunks"))
    placed = members.join(chunks, "key").withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = placed.select(F.xxhash64("key", F.least("mine", "theirs"), F.greatest("mine", "theirs")).alias("key"), "cls", "n", *SKETCHES)
    split = meet(together(cells), share_num, share_den, 1 << 62)
    return met.where("key is null").select("a", "b").unionByName(split.select("a", "b")).distinct()


def class_pairs(rows: DataFrame, share_num: int, share_den: int, **how: int) -> DataFrame:
    """(a, b), a < b: different classes of rows(id, cls, bag) that have the similarity."""
    near = materialize(candidates(rows, share_num, share_den, **how), "candidates")
    needed = materialize(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "needed")
    own = materialize(rows.select("cls", "bag").join(needed, "cls", "left_semi").groupBy("cls").agg(F.first("bag").alias("bag")), "needed-bags")
    both = near.join(own.select(F.col("cls").alias("a"), F.col("bag").alias("bag_a")), "a").join(own.select(F.col("cls").alias("b"), F.col("bag").alias("bag_b")), "b")
    return both.where(2 * share_den * F.size(F.array_intersect("bag_a", "bag_b")) >= share_num * (F.size("bag_a") + F.size("bag_b"))).select("a", "b")


def similar_pairs(df: DataFrame, least: int = 20, share_num: int = 4, share_den: int = 5, **how: int) -> DataFrame:
    """(id_a, id_b), smaller first: records of df(id, title, body) with 2 * common / (words of a + words of b) >= share."""
    rows = materialize(bag_table(df, least), "bags")
    alike = class_pairs(rows, share_num, share_den, **how)
    members = rows.select("cls", "id").distinct()
    one, two = members.select(F.col("cls").alias("a"), F.col("id").alias("x")), members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    across = alike.join(one, "a").join(two, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    within = one.join(two, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(within)


def similar_groups(df: DataFrame, least: int = 20, share_num: int = 4, share_den: int = 5, **how: int) -> DataFrame:
    """(id, group_id): records connected by similar ones; group_id is the least id. Links are between classes; copies are never paired."""
    rows = materialize(bag_table(df, least), "bags")
    first = rows.groupBy("cls").agg(F.min("id").alias("first"), (F.min("id") < F.max("id")).alias("copied"))
    linked = class_pairs(rows, share_num, share_den, **how)
    by = lambda x: first.select(F.col("cls").alias(x), F.col("first").alias(f"id_{x}"))
    labels = groups(linked.join(by("a"), "a").join(by("b"), "b").select("id_a", "id_b")).withColumnRenamed("id", "first")
    named = first.join(labels, "first", "left").where("copied OR group_id IS NOT NULL").select("cls", F.coalesce("group_id", "first").alias("group_id"))
    return rows.select("cls", "id").distinct().join(named, "cls").select("id", "group_id")


def questions(posts: DataFrame) -> DataFrame:
    return posts.where("post_type_id = '1'").select(positive_id("id").alias("id"), "title", "body").where("id is not null")


def groups(pairs: DataFrame) -> DataFrame:
    """(id, group_id): connected records of pairs(id_a, id_b); group_id is the least id of the group.

    Each round every record takes the least label among its own and its neighbours', then the label of its label;
    paths halve, so the rounds grow with the logarithm of a group's diameter. Nothing is gathered on the driver.
    """
    edges = materialize(pairs.select(F.col("id_a").alias("x"), F.col("id_b").alias("y")).union(pairs.select("id_b", "id_a")), "edges")
    labels = written = materialize(edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).select(F.col("x").alias("id"), "label"), "labels")
    while True:
        seen = edges.join(labels.select(F.col("id").alias("y"), F.col("label").alias("other")), "y").groupBy("x").agg(F.min("other").alias("other"))
        step = labels.join(seen, F.col("id") == F.col("x")).select("id", "label", F.least("label", "other").alias("low"))
        jump = step.join(labels.select(F.col("id").alias("low"), F.col("label").alias("beyond")), "low", "left").select("id", "label", F.least("low", F.coalesce("beyond", "low")).alias("next"))
        new = materialize(jump, "labels")
        discard(written)
        written = new
        if new.where("next <> label").isEmpty():
            return new.select("id", F.col("next").alias("group_id"))
        labels = new.select("id", F.col("next").alias("label"))
