"""Long exact spans that records share (problem 10).

Rabin-Karp hashes are taken of every window of `gram` characters and of every window of `length` characters. Each long
window is filed under its anchor, the short window with the least hash inside it: two equal long windows have the same
anchor, so grouping by anchors loses none. Neighbouring long windows with one anchor form a segment. Spark counts
segments: a segment that two records hold is shared as a whole. Where only the anchor recurs, the long windows of
these segments themselves are hashed and counted. Shared windows then merge into maximal intervals.

Lengths are code points of the text as it is. Null texts and texts shorter than `length` share nothing. Rows with the
same key are one record. Equality is that of two independent 64-bit hashes, of anchor and segment or window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.bpe import chunks
from threadloom.session import materialize

LENGTH, GRAM = 200, 64
CHUNK = 2_000_000
PLACE = np.uint64(22)  # bits of a position within a chunk; longer chunks use more
SEED = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(k: int) -> np.uint64:
    """The k-th multiple of the seed as a 64-bit word."""
    return np.uint64(k * int(SEED) & 0xFFFFFFFFFFFFFFFF)


class Powers:
    """Powers of the base and of its inverse, as many as asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + 1)
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
            cls.up, cls.down = grow(BASE), grow(INVERSE)
        return cls.up[:n], cls.down[:n]


class Rolling:
    """Hashes of any substring of a text by prefix sums."""

    def __init__(self, points: np.ndarray) -> None:
        up, self.down = Powers.get(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + SEED) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    size = len(x) - n + 1
    blocks = -(-len(x) // n)
    padded = np.concatenate([x, np.full(blocks * n - len(x), np.iinfo(np.uint64).max, np.uint64)]).reshape(blocks, n)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:size], ahead[n - 1 : n - 1 + size])


def segments(texts: list[str], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts in a row: text number, start and length of each segment, its anchor's hash and its own hash."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(points) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling(points)
    hashes = rolling.windows(gram)
    bits = max(PLACE, np.uint64(len(points).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    anchor = (least & low).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: len(anchor)] == owner[length - 1 : length - 1 + len(anchor)]
    change = np.empty(len(anchor), bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (owner[1 : len(anchor)] != owner[: len(anchor) - 1])
    first = np.flatnonzero(change)
    windows = np.diff(np.append(first, len(anchor)))
    keep = inside[first]
    first, windows = first[keep], windows[keep]
    at = anchor[first]
    whole = windows + length - 1
    own = mix(rolling.of(first, first + whole) + (at - first).astype(np.uint64) * SEED + whole.astype(np.uint64))
    text = owner[first]
    begins = np.cumsum(sizes) - sizes
    return text, first - begins[text], whole, hashes[at], own


def segment_table(df: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, start, size, anchor, whole) of every segment. A map over the scan of two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column(1).to_pylist(), CHUNK):
                number, start, size, anchor, whole = segments(texts, length, gram)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(number + first)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))], ["id", "start", "size", "anchor", "whole"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.length(text) >= length).select(key, text).mapInArrow(run, f"id {kind}, start int, size int, anchor bigint, whole bigint")


def window_table(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(id, start, anchor, hash) of each long window in the segments of `places`(id, spots array<struct<start,size,anchor>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                spots = b.column(2)[i].values
                start, size, anchor = (spots.field(k).to_numpy() for k in range(3))
                rolling = Rolling(np.frombuffer(b.column(1)[i].as_py().encode("utf-32-le"), np.uint32))
                n = (size - length + 1).astype(np.int64)
                at = np.repeat(start - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(at), i))), pa.array(at.astype(np.int32)), pa.array(np.repeat(anchor, n)), pa.array(rolling.of(at, at + length).view(np.int64))], ["id", "start", "anchor", "hash"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.join(places, "id").select("id", "text", "spots").mapInArrow(run, f"id {kind}, start int, anchor bigint, hash bigint")


def _in_two(df: DataFrame, *columns: str) -> DataFrame:
    """The values of columns that two different records hold."""
    return df.groupBy(*columns).agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a <> _b").select(*columns)


def _windows_in_two(df: DataFrame, key: str, text: str, rows: DataFrame, length: int) -> DataFrame:
    """Shared long windows in the segments `rows`(id, start, size, anchor)."""
    places = materialize(rows.groupBy("id").agg(F.collect_list(F.struct("start", "size", "anchor")).alias("spots")), "places")  # as many as a text has segments
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.length("text") >= length)
    windows = materialize(window_table(texts, places, length), "windows")
    return windows.join(_in_two(windows, "anchor", "hash"), ["anchor", "hash"], "left_semi")


def found(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The keys of records that hold a run of at least `length` characters that another record holds too."""
    rows = materialize(segment_table(df, key, text, length, gram), "segments")
    sure = materialize(rows.join(_in_two(rows, "anchor", "whole"), ["anchor", "whole"], "left_semi").select("id").distinct(), "sure")
    open_ = rows.join(sure, "id", "left_anti").join(_in_two(rows, "anchor"), "anchor", "left_semi")
    anchors = materialize(open_.select("anchor").distinct(), "anchors")
    more = _windows_in_two(df, key, text, rows.join(anchors, "anchor", "left_semi"), length)
    return sure.union(more.select("id")).distinct().select(F.col("id").alias(key))


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, start, stop): the maximal intervals of each record that consist of shared runs; stop is exclusive."""
    rows = materialize(segment_table(df, key, text, length, gram), "segments")
    sure = rows.join(_in_two(rows, "anchor", "whole"), ["anchor", "whole"], "left_semi")
    rest = rows.join(_in_two(rows, "anchor", "whole"), ["anchor", "whole"], "left_anti").join(_in_two(rows, "anchor"), "anchor", "left_semi")
    # a segment that no other record holds as a whole may share windows with any segment of its anchor
    anchors = materialize(rest.select("anchor").distinct(), "anchors")
    more = _windows_in_two(df, key, text, rows.join(anchors, "anchor", "left_semi"), length)
    pieces = sure.select("id", "start", (F.col("start") + F.col("size")).alias("stop")).union(more.select("id", "start", (F.col("start") + length).alias("stop")))
    reach = F.max("stop").over(Window.partitionBy("id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.col("reach"), 1).otherwise(0)).over(Window.partitionBy("id").orderBy("start", "stop"))
    return pieces.withColumn("reach", reach).withColumn("island", island).groupBy("id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("id", "start", "stop")


def shares(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per record: its characters, those in shared spans, their part and the number of spans."""
    own = df.groupBy(F.col(key).alias("id")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).cast("bigint").alias("characters"))
    sums = spans(df, key, text, length, gram).groupBy("id").agg(F.sum(F.col("stop") - F.col("start")).alias("n"), F.count("*").alias("k"))
    shared = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return own.join(sums, "id", "left").select(
        F.col("id").alias(key), "characters", shared.alias("shared_characters"), F.coalesce(F.round(F.try_divide(shared, F.col("characters")), 6), F.lit(0.0)).alias("shared_part"), F.coalesce(F.col("k"), F.lit(0)).cast("bigint").alias("spans")
    )
