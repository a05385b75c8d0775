"""Byte-level BPE of whole corpora by a pair occurrence index (problem 8).

Texts are cut into pieces with array operations on code points, equal pieces of a chunk are
encoded once, and the merges of all distinct pieces run together: an index maps each pair to its
positions, active ranks are applied in ascending order and the lists they touch are updated.
A pair made by a merge always has a higher rank than that merge, so one ascending sweep is exact.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary
text; very long texts are one row like any other, and repeated rows stay repeated.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Code points handled together; bounds a worker's memory, never a result.
CHUNK = 4_000_000
#: Distinct pieces remembered between chunks; beyond it the memory starts anew.
REMEMBERED = 400_000

OTHER, LETTER, NUMBER, SPACE, END = 0, 1, 2, 3, 4
END_POINT = 0xFFFFFFFF


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, as character to byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def code_point_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, whole):
            out[points[m.start() : m.end()]] = kind
    return out


class Encoder:
    """One worker's tokenizer. encode(texts) gives flat ids and the number of ids of each text."""

    _loaded: dict[str, Encoder] = {}

    @classmethod
    def load(cls, folder: str, name: str = "byte_bpe_50k") -> Encoder:
        key = f"{folder}/{name}"
        if key not in cls._loaded:
            cls._loaded[key] = cls(key + ".json")
        return cls._loaded[key]

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_alphabet()
        vocab, raw = model["vocab"], lambda t: bytes(of[ch] for ch in t)
        special = {t for t in vocab if any(ch not in of for ch in t)} | {"<|endoftext|>"}
        self.whole = {raw(t): i for t, i in vocab.items() if t not in special}
        self.byte_id = np.array([self.whole[bytes([b])] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.classes = code_point_classes()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # pieces

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Byte offsets of all pieces, the text each is of, and the bytes of all texts in a row."""
        mark = b"\xff\xff\xff\xff"
        points = np.frombuffer(mark.join(t.encode("utf-32-le") for t in texts) + mark, np.uint32)
        ends = points == END_POINT
        kind = self.classes[np.where(ends, 0, points)]
        kind[ends] = END
        start = np.empty(len(points), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= ends
        # the last blank before something visible stands alone or, if it is a space, joins what follows
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        # contractions
        quote = np.flatnonzero(start & (points == 39))
        if len(quote):
            after = lambda k: points[np.minimum(quote + k, len(points) - 1)]
            one, two = after(1), after(2)
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
            for found, n in ((short, 1), (long & ~short, 2)):
                start[quote[found] + 1] = False
                start[quote[found] + 1 + n] = True
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        width[ends] = 0
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offset[1:])
        begins = np.flatnonzero(start & ~ends)
        of_text = np.cumsum(ends)[begins]
        data = "".join(texts).encode()
        return np.append(offset[begins], len(data)).astype(np.int32), of_text, data

    # merges

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (right >= 0), self.rank_of[i], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row and how many each has, by the pair occurrence index."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbol)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        stop = np.cumsum(length)
        following[stop - 1] = -1
        before[stop - length] = -1
        alive = np.ones(n, bool)
        rank = self.ranks(symbol, np.where(following >= 0, symbol[np.minimum(following, n - 1)], -1))
        index: dict[int, list[np.ndarray]] = {}

        def add(where: np.ndarray) -> None:
            """Enter positions into the lists of their pairs."""
            where = where[rank[where] >= 0]
            if not len(where):
                return
            r = rank[where]
            if len(where) > 1:
                order = np.argsort(r, kind="stable")
                where, r = where[order], r[order]
                edges = np.flatnonzero(r[1:] != r[:-1]) + 1
                groups, names = np.split(where, edges), r[np.append(0, edges)].tolist()
            else:
                groups, names = [where], r.tolist()
            for name, group in zip(names, groups):
                if name in index:
                    index[name].append(group)
                else:
                    index[name] = [group]
                    heapq.heappush(active, name)

        active: list[int] = []
        add(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                linked = following[at[:-1]] == at[1:]
                if linked.any():  # a run of one symbol: every second position, from the left
                    first = np.flatnonzero(np.append(True, ~linked))
                    step = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                    at = at[step % 2 == 0]
            gone = following[at]
            then = following[gone]
            symbol[at] = self.merged[r]
            alive[gone] = False
            rank[gone] = -1
            following[at] = then
            has = then >= 0
            before[then[has]] = at[has]
            prior = before[at]
            touched = np.concatenate([at, prior[prior >= 0]])
            if len(touched) > 1:
                touched = np.unique(touched)
            other = following[touched]
            rank[touched] = self.ranks(symbol[touched], np.where(other >= 0, symbol[np.maximum(other, 0)], -1))
            add(touched)
        counts = np.add.reduceat(alive, stop - length, dtype=np.int64)
        return symbol[alive].astype(np.int32), counts

    def learn(self, pieces: list[bytes]) -> None:
        """Encode pieces that are not known yet."""
        rest, ids = [], []
        position, known = len(self.at) - 1, self.known
        for p in pieces:
            if (i := self.whole.get(p)) is None:
                rest.append(p)
            else:
                known[p] = position
                position += 1
                ids.append(i)
        flat, counts = [np.array(ids, np.int32)], [np.ones(len(ids), np.int64)]
        if rest:
            more, n = self.merge(rest)
            flat.append(more)
            counts.append(n)
            for p in rest:
                known[p] = position
                position += 1
        self.flat = np.concatenate([self.flat, *flat])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(counts))])

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        offsets, of_text, data = self.cut(texts)
        if not len(of_text):
            return np.zeros(0, np.int64), of_text
        pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        self.learn([p for p in distinct if p not in self.known])
        entry = np.fromiter((self.known[p] for p in distinct), np.int64, len(distinct))
        return entry[pieces.indices.to_numpy()], of_text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        entry, of_text = self._pieces(texts)
        n = self.at[entry + 1] - self.at[entry]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(self.at[entry] - (ends - n), n)
        return self.flat[where], np.bincount(of_text, n, len(texts)).astype(np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        entry, of_text = self._pieces(texts)
        return np.bincount(of_text, self.at[entry + 1] - self.at[entry], len(texts)).astype(np.int64)


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts up to a number of code points, a longer one alone; null counts as empty."""
    first, size, own = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if own and size + len(t) > limit:
            yield first, own
            first, size, own = i, 0, []
        own.append(t)
        size += len(t)
    if own:
        yield first, own


def encode_table(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = DEFAULT_TOKENIZERS) -> DataFrame:
    """One row per row of df: (key, ids). No shuffle; a map over the scan of two columns."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizers)
        for b in batches:
            for first, texts in chunks(b.column(1).to_pylist()):
                ids, n = encoder.encode(texts)
                offsets = np.append(0, np.cumsum(n)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), lists], [key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def count_table(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = DEFAULT_TOKENIZERS) -> DataFrame:
    """One row per row of df: (key, n_tokens)."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizers)
        for b in batches:
            for first, texts in chunks(b.column(1).to_pylist()):
                n = encoder.count(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(n, pa.int64())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, schema)
