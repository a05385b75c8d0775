"""Filling containers of fixed capacity (problem 9): best fit over counts of lengths, then a join on rank within length.

Only the histogram of lengths reaches the driver; it has at most capacity + 1 rows for each container. Rows take their
planned slots by their rank within their length, counted in salted parts so that a frequent length is no single task.

Defined results: null and empty texts have length 0 and go into container 0; a text longer than the capacity fills
whole containers and leaves one piece for the rest; repeated rows are repeated items; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import discard, materialize

#: Rows that one task ranks within one length.
ROWS_A_SALT = 200_000
#: Slot runs that are broadcast (24 bytes each); beyond it they are joined.
RUNS_BROADCAST = 1_000_000


class Run(NamedTuple):
    """Ranks start..stop-1 of a length go into bins from first_bin on, per_bin in each."""

    length: int
    start: int
    stop: int
    first_bin: int
    per_bin: int


def plan(capacity: int, counts: dict[int, int]) -> tuple[list[Run], int]:
    """Best fit in order of decreasing length, over counts. The slot runs and the number of containers."""
    runs: list[Run] = []
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, n))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"length {length} exceeds the capacity {capacity}")
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[i]
            else:
                room, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            each = room // length
            whole = min(n, left // each)
            if whole:
                runs.append(Run(length, rank, rank + whole * each, first, each))
                put(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and left < each:
                used = 0
                if left:
                    runs.append(Run(length, rank, rank + left, first + whole, left))
                    put(room - left * length, first + whole, 1)
                    rank, left, used = rank + left, 0, 1
                put(room, first + whole + used, n - whole - used)
    if counts.get(0):
        runs.append(Run(0, 0, counts[0], 0, counts[0]))
        bins = max(bins, 1)
    return runs, bins


def pack(sizes: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(container_name, capacity_tokens, container_no, key, piece_no, n_tokens): every row of sizes, for each container.

    containers is a parameter table (container_name, capacity_tokens) of at most a thousand rows; null or non-positive capacities are left out.
    """
    kinds = [(r[0], int(r[1])) for r in containers.select("container_name", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("more than a thousand kinds of containers")
    kinds.sort(key=lambda k: (k[1], str(k[0])))
    spark = sizes.sparkSession
    id_type = sizes.schema[key].dataType.simpleString()
    if not kinds:
        return spark.createDataFrame([], f"container_name string, capacity_tokens bigint, container_no bigint, `{key}` {id_type}, piece_no bigint, n_tokens bigint")
    length = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    caps = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for i, (_, c) in enumerate(kinds)])
    items = (
        sizes.select(F.col(key), length.alias("_n"))
        .select(key, "_n", F.explode(caps).alias("_c"))
        .select(key, "_n", "_c.kind", "_c.capacity")
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.expr("(_n + capacity - 1) div capacity"), F.lit(1)) - 1)))
        .select("kind", key, "piece_no", F.least(F.col("capacity"), F.col("_n") - F.col("piece_no") * F.col("capacity")).alias("n_tokens"))
    )
    counted = items.groupBy("kind", "n_tokens").count().collect()  # at most capacity + 1 rows for each kind
    by_kind: list[dict[int, int]] = [{} for _ in kinds]
    for r in counted:
        by_kind[r[0]][r[1]] = r[2]
    salts = max(1, -(-max((r[2] for r in counted), default=0) // ROWS_A_SALT))
    salted = items.withColumn("salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(salts)))
    parts = salted.groupBy("kind", "n_tokens", "salt").count()
    before = F.sum("count").over(Window.partitionBy("kind", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    ranked = salted.withColumn("rank", (F.row_number().over(Window.partitionBy("kind", "n_tokens", "salt").orderBy(key, "piece_no")) - 1).cast("bigint"))
    if salts > 1:
        offsets = parts.select("kind", "n_tokens", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
        ranked = ranked.join(offsets, ["kind", "n_tokens", "salt"]).withColumn("rank", F.col("rank") + F.col("offset"))
    runs = [(i, *r) for i, (_, c) in enumerate(kinds) for r in plan(c, by_kind[i])[0]]
    ranked = ranked.select("kind", key, "piece_no", "n_tokens", "rank")
    if len(runs) <= RUNS_BROADCAST:
        placed = _place_by_search(ranked, runs, key, id_type)
    else:
        slots = spark.createDataFrame(runs, "kind int, n_tokens bigint, start bigint, stop bigint, first_bin bigint, per_bin bigint")
        placed = ranked.join(slots, ["kind", "n_tokens"]).where("rank >= start and rank < stop").selectExpr("kind", f"first_bin + (rank - start) div per_bin AS container_no", f"`{key}`", "piece_no", "n_tokens")
    names = F.array(*[F.lit(n) for n, _ in kinds])[F.col("kind")]
    size_of = F.array(*[F.lit(c).cast("bigint") for _, c in kinds])[F.col("kind")]
    return placed.select(names.alias("container_name"), size_of.alias("capacity_tokens"), "container_no", key, "piece_no", "n_tokens")


def _place_by_search(ranked: DataFrame, runs: list[tuple], key: str, id_type: str) -> DataFrame:
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 6)
    # runs of one kind and length stand together in order of start
    group = columns[:, 0] << 32 | columns[:, 1]
    names, first = np.unique(group, return_index=True)
    shared = ranked.sparkSession.sparkContext.broadcast((names, np.append(first, len(group)), columns[:, 2].copy(), columns[:, 4].copy(), columns[:, 5].copy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, start, first_bin, per_bin = shared.value
        for b in batches:
            kind, n, rank = (b.column(i).to_numpy() for i in (0, 3, 4))
            g = np.searchsorted(names, kind.astype(np.int64) << 32 | n)
            low, high = first[g], first[g + 1]
            while (more := high - low > 1).any():
                middle = (low + high) // 2
                right = more & (start[np.minimum(middle, len(start) - 1)] <= rank)
                low, high = np.where(right, middle, low), np.where(more & ~right, middle, high)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first_bin[low] + (rank - start[low]) // per_bin[low]), b.column(1), b.column(2), b.column(3)], ["kind", "container_no", key, "piece_no", "n_tokens"])

    return ranked.mapInArrow(run, f"kind int, container_no bigint, `{key}` {id_type}, piece_no bigint, n_tokens bigint")


def pack_documents(documents: DataFrame, containers: DataFrame, tokenizers: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """pack() over the token counts of texts; the counts are written once and read by both passes."""
    from threadloom.llm.bpe import count_table

    return pack(materialize(count_table(documents, key, text, tokenizers), "sizes"), containers, key)


def fill(packed: DataFrame) -> DataFrame:
    """Per kind of container: how many are used, their tokens and the part of their space that is used."""
    spread = packed.groupBy("container_name", "capacity_tokens", "container_no").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return spread.groupBy("container_name", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("items").alias("pieces"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"),
        F.round(F.sum("n") / (F.count("*") * F.first("capacity_tokens")), 6).alias("filled"),
    )


def checks(packed: DataFrame, key: str = "doc_id", well: float = 0.95) -> DataFrame:
    """What must hold of a packing, per kind of container: documents, containers over capacity, documents with a gap in their pieces, documents split
    though a container could hold them, and whether the containers but the last are filled to `well` on average."""
    kind = ["container_name", "capacity_tokens"]
    packed = materialize(packed, "packed")
    bins = packed.groupBy(*kind, "container_no").agg(F.sum("n_tokens").alias("n")).groupBy(*kind).agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"), (F.sum("n") >= well * F.col("capacity_tokens") * (F.count("*") - 1)).alias("filled_well"))
    last = F.max("piece_no") + 1
    docs = packed.groupBy(*kind, key).agg((last != F.count("*")).alias("gap"), ((last > 1) & (F.min(F.when(F.col("piece_no") < 1, F.col("n_tokens"))) < F.col("capacity_tokens"))).alias("needless"))
    whole = docs.groupBy(*kind).agg(F.count("*").alias("documents"), F.count_if("gap").alias("incomplete"), F.count_if("needless").alias("split_needlessly"))
    return bins.join(whole, kind).select(*kind, "documents", "overfull", "incomplete", "split_needlessly", "filled_well")


__all__ = ["Run", "checks", "discard", "fill", "pack", "pack_documents", "plan"]
