"""Items that appear together (problem 3): pair counts over baskets of any size, and association scores.

A basket of more than CHUNK items is cut into chunks; each pair of chunks becomes its own group, so the product of a
huge basket is spread over tasks, and no row ever holds more than the product of two chunks. Counts are combined on
the map side before the shuffle. Nothing is capped: every pair of every basket is counted.

Defined results: null and empty baskets, and repeated items of a basket, count nothing; repeated rows of one id are
one basket; an empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import positive_id
from threadloom.session import materialize

CHUNK = 64


def tag_items(tags: str = "tags"):
    """Distinct tags of `<a><b>`, lower case, trimmed, sorted by code point, blank ones left out."""
    names = F.regexp_extract_all(F.coalesce(F.col(tags), F.lit("")), F.lit("<([^<>]*)>"), F.lit(1))
    clean = F.transform(names, lambda t: F.lower(F.regexp_replace(t, r"^[\s ]+|[\s ]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t != "")))


def question_tags(posts: DataFrame) -> DataFrame:
    """(id, items) of each distinct question that has a tag."""
    return posts.where("post_type_id = '1'").select(positive_id("id").alias("id"), "tags").where("id is not null").groupBy("id").agg(F.max("tags").alias("tags")).select("id", tag_items().alias("items")).where("size(items) > 0")


def _within(items: str) -> str:
    return f"flatten(transform({items}, (x, i) -> transform(slice({items}, i + 2, size({items})), y -> struct(x as item_a, y as item_b))))"


def basket_pairs(baskets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(item_a, item_b) of each basket(id, items); items are distinct and sorted."""
    small = baskets.where(f"size(items) between 2 and {chunk}").select(F.explode(F.expr(_within("items"))).alias("p")).select("p.*")
    cut = f"transform(sequence(0, (size(items) - 1) div {chunk}), i -> slice(items, i * {chunk} + 1, {chunk}))"
    chunks = baskets.where(f"size(items) > {chunk}").select("id", F.expr(f"(size(items) - 1) div {chunk}").alias("last"), F.posexplode(F.expr(cut)).alias("i", "part"))
    sent = chunks.select("id", "i", "part", F.explode(F.expr("sequence(0, last)")).alias("other"))
    met = sent.groupBy("id", F.least("i", "other").alias("a"), F.greatest("i", "other").alias("b")).agg(F.min(F.struct("i", "part")).alias("first"), F.max(F.struct("i", "part")).alias("second"))
    across = "flatten(transform(first.part, x -> transform(second.part, y -> struct(x as item_a, y as item_b))))"
    large = met.select(F.explode(F.expr(f"if(a = b, {_within('first.part')}, {across})")).alias("p")).select("p.*")
    return small.unionByName(large)


def user_tags(posts: DataFrame) -> DataFrame:
    """(id, item): each distinct tag of each asker's questions; questions without owner are left out."""
    once = posts.where("post_type_id = '1'").select(positive_id("id").alias("id"), "owner_user_id", "tags").where("id is not null").groupBy("id").agg(F.max("owner_user_id").alias("owner"), F.max("tags").alias("tags"))
    return once.where("owner is not null").select(F.col("owner").alias("id"), F.explode(tag_items()).alias("item")).distinct()


def row_pairs(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(item_a, item_b) of baskets given as distinct rows(id, item), so that no basket is ever gathered whole.

    Items go to chunks by hash, as many as the basket's size asks for; every pair of chunks of a basket is a group.
    """
    chunks = rows.groupBy("id").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
    parts = rows.join(chunks, "id").groupBy("id", "chunks", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int").alias("i")).agg(F.array_sort(F.collect_list("item")).alias("part"))
    sent = parts.select("id", "i", "part", F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
    met = sent.groupBy("id", F.least("i", "other").alias("a"), F.greatest("i", "other").alias("b")).agg(F.min(F.struct("i", "part")).alias("first"), F.max(F.struct("i", "part")).alias("second"), F.count("*").alias("sides"))
    across = "flatten(transform(first.part, x -> transform(second.part, y -> struct(least(x, y) as item_a, greatest(x, y) as item_b))))"
    return met.where("a = b or sides = 2").select(F.explode(F.expr(f"if(a = b, {_within('first.part')}, {across})")).alias("p")).select("p.*")


def row_associations(rows: DataFrame, least: int = 1, chunk: int = CHUNK) -> DataFrame:
    """associations() of baskets given as distinct rows(id, item)."""
    rows = materialize(rows, "basket-rows")
    return _joined(row_pairs(rows, chunk), rows.groupBy("item").agg(F.count("*").alias("n_item")), rows.select("id").distinct().count(), least)


def associations(baskets: DataFrame, least: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n): pairs on at least `least` of the n baskets, with their single counts."""
    baskets = materialize(baskets, "baskets")
    n = baskets.count()
    single = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n_item"))
    return _joined(basket_pairs(baskets, chunk), single, n, least)


def _joined(pairs: DataFrame, single: DataFrame, n: int, least: int) -> DataFrame:
    pairs = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= least)
    of = lambda name, count: single.select(F.col("item").alias(name), F.col("n_item").alias(count))
    return pairs.join(of("item_a", "n_a"), "item_a").join(of("item_b", "n_b"), "item_b").select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"))


def above_chance(pairs: DataFrame, times: int = 4) -> DataFrame:
    """Pairs at least `times` as often together as their single counts give by chance; decided in whole numbers."""
    left = F.col("n_ab").cast("decimal(38,0)") * F.col("n")
    return pairs.where(left >= F.col("n_a").cast("decimal(38,0)") * F.col("n_b") * times)


def scored(pairs: DataFrame) -> DataFrame:
    """Lift, pointwise mutual information in bits and the part of all baskets."""
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    return pairs.select("*", F.round(lift, 4).alias("lift"), F.round(F.log2(lift), 4).alias("pmi"), F.round(F.col("n_ab") / F.col("n"), 6).alias("support"))
