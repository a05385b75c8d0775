"""Personal information in free text (problem 5): a linear-chain conditional random field over word-shape features.

The model is trained on the driver from the labelled table of pii_table (a few thousand sentences made by rule, a
fixed parameter) by gradient ascent on the likelihood, and decoded by Viterbi in numpy batches of lines of like length.
Besides its shape a word has the feature whether public vocabularies know it, and whether only with a capital.
From upper bounds of what each token can gain by a label other than O, the best sum over any stretch through a token
tells whether it can be part of anything; only runs of such tokens are decoded, all others are O on the best path.

Texts are taken whole; HTML is decoded to visible text first. Null, empty and blank texts hold nothing. Rows with one
id are one record. Placeholders are [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME].
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import positive_id
from threadloom.functions.text import visible_text
from threadloom.llm.bpe import DEFAULT_TOKENIZERS, LETTER, NUMBER, SPACE, code_point_classes
from threadloom.llm.pii_table import GIVEN, KINDS, TITLES, labelled_table

LABELS = ["O", *[f"{b}-{k}" for k in KINDS for b in "BI"]]
N = len(LABELS)
OFFSETS = (-2, -1, 0, 1, 2)
GLUE = 4  # (no space before this token) + 2 * (no space before the next)
NEVER = -1e4
CHUNK = 1_000_000
REMEMBERED = 300_000
LEAN = 0.75  # added to the score of a beginning name, of which fewer are recognized than of other kinds
VOCABULARIES = ("byte_bpe_50k", "byte_bpe_multi_50k")

_SETS = {"given": {g.lower() for g in GIVEN}, "title": {t.lower().rstrip(".") for t in TITLES}}
_STREET = re.compile(r"(?:stra(?:ß|ss)e|str|weg|gasse|platz|allee)$")


def shape(token: str) -> str:
    if token.isdigit():
        return "9" * min(len(token), 12)
    if token.isalpha():
        return "X" if len(token) == 1 and token.isupper() else "XX" if token.isupper() else "x" if token.islower() else "Xx" if token[1:].islower() else "xX"
    return token


@cache
def lexicon(folder: str) -> tuple[frozenset[str], frozenset[str]]:
    """Words, and words known only with a capital, among the whole tokens of public vocabularies; a fixed size."""
    import base64

    known = set()
    for name in VOCABULARIES:
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            for line in f:
                token = base64.b64decode(line.split()[0])
                if token[:1] == b" " and (word := token[1:].decode("utf-8", "ignore")).isalpha():
                    known.add(word)
    lower = frozenset(w for w in known if w.islower())
    return lower, frozenset(w.lower() for w in known if w.istitle() and w.lower() not in lower)


def features(token: str, words: tuple[frozenset[str], frozenset[str]]) -> list[str]:
    low, s = token.lower(), shape(token)
    out = ["s=" + s, "w=" + low]
    if token.isalpha():
        kind = "common" if low in words[0] else "proper" if low in words[1] else "unknown"
        out += ["k=" + kind, f"k={kind} {s}"]
        out += [f"l={min(len(token), 9)}", "z=" + low[-3:], "y=" + low[-2:]]
        # a lower-case word that the vocabularies know is a word first, even if it is a name too
        out += ["in=" + k for k, names in _SETS.items() if low in names and not (kind == "common" and token.islower())]
        if _STREET.search(low):
            out.append("street")
    elif token.isdigit():
        out += ["digits", "long" if len(token) > 5 else "short", "a=" + token[:2]]
    return out


class Tokens:
    """Tokens of many texts in a row: runs of letters, runs of digits, and single other characters."""

    def __init__(self, texts: list[str], classes: np.ndarray) -> None:
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        kind = classes[points]
        start = np.empty(len(points), bool)
        start[:1] = True
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
        line = points == 10
        start |= line
        start[1:] |= line[:-1]
        at = np.flatnonzero(start)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offset[1:])
        data = "\n".join([*texts, ""]).encode()
        every = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(offset[at], len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        blank = kind[at] == SPACE
        keep = np.flatnonzero(~blank)
        self.types = [t.decode() for t in every.dictionary.to_pylist()]
        self.type = every.indices.to_numpy()[keep]
        self.start = at[keep]
        self.stop = np.append(at[1:], len(points))[keep]
        glued = np.empty(len(keep), bool)
        glued[:1] = False
        glued[1:] = keep[1:] == keep[:-1] + 1
        self.glue = glued + 2 * np.append(glued[1:], False).astype(np.int64)
        # lines, and the text that each belongs to
        self.line = np.cumsum(line)[self.start]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.start, side="right")
        self.begins = ends - np.array([len(t) + 1 for t in texts])


class Model:
    """Weights of the field. emission(types) gives for every type and offset its scores of the labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, glue: np.ndarray, moves: np.ndarray, first: np.ndarray, words: tuple[frozenset[str], frozenset[str]]) -> None:
        self.names, self.weights, self.glue, self.moves, self.first, self.words = names, weights, glue, moves, first, words
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(OFFSETS), N), np.float32)

    def rows(self, types: list[str]) -> np.ndarray:
        """Row of each type in the table of emissions, which grows by new types."""
        if len(self.known) > REMEMBERED:
            self.forget()
        new = [t for t in types if t not in self.known]
        if new:
            ids, owner = [], []
            for i, t in enumerate(new):
                self.known[t] = len(self.known)
                for f in features(t, self.words):
                    if (k := self.names.get(f)) is not None:
                        ids.append(k)
                        owner.append(i)
            more = np.zeros((len(new), len(OFFSETS), N), np.float32)
            np.add.at(more, np.array(owner, np.int64), self.weights[np.array(ids, np.int64)])
            self.table = np.concatenate([self.table, more])
        return np.fromiter((self.known[t] for t in types), np.int64, len(types))


def _allowed() -> np.ndarray:
    moves = np.zeros((N, N), np.float32)
    for a, x in enumerate(LABELS):
        for b, y in enumerate(LABELS):
            if y[0] == "I" and x[1:] != y[1:]:
                moves[a, b] = NEVER
    return moves


def _emissions(table: np.ndarray, rows: np.ndarray, glue: np.ndarray, glue_weights: np.ndarray) -> np.ndarray:
    """Scores of padded lines: rows is lines x (length + 4), -1 where there is no token; its middle are the tokens."""
    length = rows.shape[1] - 4
    out = glue_weights[glue]
    for k in range(len(OFFSETS)):
        part = rows[:, k : k + length]
        out = out + np.where((part >= 0)[..., None], table[np.maximum(part, 0), k], 0)
    return out


def _pad(lines: list[np.ndarray], length: int, fill: int, margin: int) -> np.ndarray:
    out = np.full((len(lines), length + 2 * margin), fill, np.int64)
    for i, x in enumerate(lines):
        out[i, margin : margin + len(x)] = x
    return out


@cache
def train(seed: int = 7, epochs: int = 10, batch: int = 256, rate: float = 0.12, decay: float = 2e-5, part: str = "all", tokenizers: str = DEFAULT_TOKENIZERS) -> tuple:
    """Weights from the labelled table. Runs on the driver in a few seconds; the table's size is fixed."""
    table = labelled_table(seed, part=part)
    tokens = Tokens([t for t, _ in table], code_point_classes())
    label = np.zeros(len(tokens.type), np.int64)
    for i, (_, spans) in enumerate(table):
        for a, b, kind in spans:
            inside = np.flatnonzero((tokens.text == i) & (tokens.start >= tokens.begins[i] + a) & (tokens.stop <= tokens.begins[i] + b))
            label[inside] = 2 + 2 * KINDS.index(kind)
            label[inside[:1]] -= 1
    # an item that goes on in the next line begins there anew
    heads = np.diff(tokens.line, prepend=-1) != 0
    label[heads & (label > 0) & (label % 2 == 0)] -= 1
    words = lexicon(tokenizers)
    own = [features(t, words) for t in tokens.types]
    seen = Counter(f for k in tokens.type.tolist() for f in own[k])
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 4))}
    pairs = [(i, names[f]) for i, fs in enumerate(own) for f in fs if f in names]
    of_type, of_feature = (np.array(x) for x in zip(*pairs))
    spelled = np.array([f[:2] in ("w=", "z=", "y=") for f in sorted(names, key=names.get)])[of_feature]
    given = np.array([f[:3] == "in=" for f in sorted(names, key=names.get)])[of_feature]
    dropped = np.where(spelled, 0.4, np.where(given, 0.3, 0.1))
    weights, glue, moves, first = np.zeros((len(names), len(OFFSETS), N), np.float32), np.zeros((GLUE, N), np.float32), np.zeros((N, N), np.float32), np.zeros(N, np.float32)
    mask = _allowed()
    start_mask = np.where([x[0] == "I" for x in LABELS], NEVER, 0).astype(np.float32)
    edges = np.flatnonzero(np.diff(tokens.line, prepend=-1))
    lines = [np.arange(a, b) for a, b in zip(edges, np.append(edges[1:], len(tokens.line)))]
    rng = np.random.default_rng(seed)
    squares = [np.full(x.shape, 1e-4, np.float32) for x in (weights, glue, moves, first)]
    emit_of = np.zeros((len(tokens.types), len(OFFSETS), N), np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(lines))
        order = order[np.argsort([len(lines[i]) // 8 for i in order], kind="stable")]
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            chosen = [lines[i] for i in groups[g]]
            length = max(map(len, chosen))
            # words are left out at random, so that shapes and neighbours carry their part
            keep = rng.random(len(of_type)) > dropped
            emit_of[:] = 0
            np.add.at(emit_of, of_type[keep], weights[of_feature[keep]])
            rows = _pad([tokens.type[x] for x in chosen], length, -1, 2)
            glued = _pad([tokens.glue[x] for x in chosen], length, 0, 0)
            y = _pad([label[x] for x in chosen], length, 0, 0)
            real = rows[:, 2:-2] >= 0
            scores = np.clip(_emissions(emit_of, rows, glued, glue), -60, 60)
            p, p_moves = _expectations(scores, real, moves + mask, first + start_mask)
            gold = np.eye(N, dtype=np.float32)[y] * real[..., None]
            diff = gold - p
            both = real[:, 1:]
            gold_moves = np.zeros((N, N), np.float32)
            np.add.at(gold_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
            grad_type = np.zeros_like(emit_of)
            for k in range(len(OFFSETS)):
                part = rows[:, k : k + length]
                ok = (part >= 0) & real
                np.add.at(grad_type[:, k], part[ok], diff[ok])
            grad_w = np.zeros_like(weights)
            np.add.at(grad_w, of_feature[keep], grad_type[of_type[keep]])
            grad_g = np.zeros_like(glue)
            np.add.at(grad_g, glued[real], diff[real])
            for x, grad, sq in zip((weights, glue, moves, first), (grad_w, grad_g, gold_moves - p_moves, diff[:, 0].sum(0)), squares):
                grad = grad / len(chosen) - decay * x
                sq += grad * grad
                x += rate * grad / np.sqrt(sq)
    glue[:, LABELS.index("B-name")] += LEAN
    return names, weights, glue, moves + mask, first + start_mask, words


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _expectations(scores: np.ndarray, real: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels (lines x length x N) and expected counts of moves, by forward and backward sums."""
    lines, length, _ = scores.shape
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + first
    for t in range(1, length):
        step = _logsum(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t]
        ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = _logsum(moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(real[:, t + 1, None], step, back[:, t + 1])
    total = _logsum(ahead[:, -1], 1)
    p = np.exp(ahead + back - total[:, None, None]) * real[..., None]
    counts = np.zeros((N, N), np.float32)
    for t in range(1, length):
        on = real[:, t]
        if on.any():
            joint = ahead[on, t - 1, :, None] + moves + (scores[on, t] + back[on, t])[:, None, :] - total[on, None, None]
            counts += np.exp(joint).sum(0)
    return p, counts


def viterbi(scores: np.ndarray, real: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of padded lines."""
    lines, length, _ = scores.shape
    best = scores[:, 0] + first
    came = np.zeros((length, lines, N), np.int8)
    same = np.arange(N, dtype=np.int8)
    for t in range(1, length):
        options = best[:, :, None] + moves
        came[t] = options.argmax(1)
        step = np.take_along_axis(options, came[t][:, None, :].astype(np.int64), 1)[:, 0] + scores[:, t]
        on = real[:, t]
        best = np.where(on[:, None], step, best)
        came[t][~on] = same
        if t % 256 == 0:  # sums of long lines would outgrow the digits that tell labels apart
            best -= best.max(axis=1, keepdims=True)
    out = np.zeros((lines, length), np.int64)
    out[:, -1] = best.argmax(1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = came[t][np.arange(lines), out[:, t]]
    return np.where(real, out, 0)


class Finder:
    """One worker's decoder."""

    def __init__(self, trained: tuple) -> None:
        self.model = Model(*trained)
        self.classes = code_point_classes()
        # any path other than all O pays at least this much for its moves, or gains that much
        moves, first = self.model.moves, self.model.first
        self.move_gain = max(0.0, float((moves - moves[0, 0]).max()), float((first - first[0]).max()))

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, stop, kind) of each text, in order."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        tokens = Tokens(texts, self.classes)
        n = len(tokens.type)
        if not n:
            return out
        rows = self.model.rows(tokens.types)[tokens.type]
        table = self.model.table
        # the most that a label of each kind gains over O, by type and offset
        over = lambda x: np.maximum(x[..., 1::2], x[..., 2::2]) - x[..., :1]
        gain = np.take(over(table), rows, axis=0)
        fresh = np.diff(tokens.line, prepend=-1) != 0
        bound = gain[:, 2] + over(self.model.glue)[tokens.glue]
        for k in (1, 2):
            same = (tokens.line[k:] == tokens.line[: n - k])[:, None]
            bound[k:] += same * gain[: n - k, 2 - k]
            bound[: n - k] += same * gain[k:, 2 + k]
        bound = bound.max(axis=1) + self.move_gain
        # the best sum over stretches that end, and that begin, at each token of a line
        bound = bound.astype(np.float64)
        apart = 1e7 * tokens.line
        total = np.cumsum(bound)
        upto = total - np.minimum.accumulate(total - bound - apart) - apart
        onward = np.maximum.accumulate((total - apart)[::-1])[::-1] + apart - (total - bound)
        hopeful = upto + onward - bound > 0
        change = np.flatnonzero(np.diff(np.concatenate([[0], hopeful.astype(np.int8), [0]])) | np.concatenate([fresh & hopeful & np.concatenate([[False], hopeful[:-1]]), [False]]))
        lines = [(int(a), int(b)) for a, b in zip(change, change[1:]) if hopeful[a]]  # whole, however long: no item is split
        lines.sort(key=lambda ab: ab[1] - ab[0])
        i = 0
        while i < len(lines):
            longest = lines[i][1] - lines[i][0]
            j = i
            while j < len(lines) and lines[j][1] - lines[j][0] <= longest * 1.2 + 2 and (j - i + 1) * (lines[j][1] - lines[j][0]) <= 60_000:
                j += 1
            j = max(j, i + 1)
            self._decode(tokens, rows, lines[i:j], texts, out)
            i = j
        for found in out:
            found.sort()
        return out

    def _decode(self, tokens: Tokens, rows: np.ndarray, lines: list[tuple[int, int]], texts: list[str], out: list) -> None:
        length = lines[-1][1] - lines[-1][0]
        first = np.array([a for a, _ in lines])
        size = np.array([b - a for a, b in lines])
        at = first[:, None] + np.arange(-2, length + 2)
        inside = (at >= 0) & (at < len(rows))
        at = np.clip(at, 0, len(rows) - 1)
        near = inside & (np.arange(-2, length + 2) < size[:, None] + 2) & (tokens.line[at] == tokens.line[first][:, None])
        padded = np.where(near, rows[at], -1)
        real = np.arange(length) < size[:, None]
        glued = np.where(real, tokens.glue[at[:, 2:-2]], 0)
        moves, begin = self.model.moves, self.model.first
        scores = _emissions(self.model.table, padded, glued, self.model.glue)
        # what stands before and after a run is O
        heads = (first == 0) | (tokens.line[np.maximum(first - 1, 0)] != tokens.line[first])
        scores[:, 0] += np.where(heads[:, None], begin, moves[0])
        last = first + size
        tails = (last < len(rows)) & (tokens.line[np.minimum(last, len(rows) - 1)] == tokens.line[first])
        scores[np.flatnonzero(tails), size[tails] - 1] += moves[:, 0]
        labels = viterbi(scores, real, moves, np.zeros(N, np.float32))
        for i in np.flatnonzero((labels > 0).any(1)):
            path, base, t = labels[i], first[i], 0
            while t < size[i]:
                if path[t] == 0:
                    t += 1
                    continue
                kind, begin = (path[t] - 1) // 2, t
                t += 1
                while t < size[i] and path[t] == 2 + 2 * kind:
                    t += 1
                text = tokens.text[base + begin]
                a, b = int(tokens.start[base + begin] - tokens.begins[text]), int(tokens.stop[base + t - 1] - tokens.begins[text])
                if plausible(texts[text][a:b], KINDS[kind]):
                    out[text].append((a, b, KINDS[kind]))


def plausible(item: str, kind: str) -> bool:
    """An exact check of what was decoded."""
    digits = sum(ch.isdigit() for ch in item)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", item, re.IGNORECASE)) and bool(re.search(r"\w\s*[\[(]?(?:@|\bat\b)[\])]?\s*\w", item, re.IGNORECASE))
    if kind == "phone":
        return 7 <= digits <= 17
    if kind == "id_number":
        return digits >= 5
    if kind == "address":
        return digits >= 1 and bool(re.search(r"[^\W\d_]{2}", item))
    parts = re.findall(r"[^\W\d_]+", item)
    comma = "," not in item or bool(parts) and parts[0].isupper()  # FAMILY, Given
    sentence = re.search(r"[^\W\d_]{4,}\.\s", item)  # a longer word with a full stop ends a sentence; titles are shorter
    return len(parts) >= 2 and not digits and comma and not sentence


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in found:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*parts, text[at:]])


def _batches(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    from threadloom.llm.bpe import chunks

    return chunks(texts, CHUNK)


def _texts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    p = posts.select(F.lit("posts").alias("source_table"), positive_id("id").alias("record_id"), F.col("body").alias("text"))
    return p.unionByName(comments.select(F.lit("comments").alias("source_table"), positive_id("id").alias("record_id"), "text")).where("record_id is not null and text is not null")


def _clean(source: str, text: str) -> str:
    return visible_text(text) if source == "posts" else text


def _run(rows: DataFrame, schema: str, emit) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(train())  # fixed size: the features of the labelled table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for b in batches:
            source, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = [_clean(s, t) for s, t in zip(source, b.column(2).to_pylist())]
            for first, own in _batches(texts):
                found = finder.find(own)
                out = [r for i, spans in enumerate(found) for r in emit(source[first + i], ids[first + i], own[i], spans)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def found(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(source_table, record_id, kind): the kinds of personal information that each record holds."""
    emit = lambda source, key, text, spans: [(source, key, kind) for kind in dict.fromkeys(k for _, _, k in spans)]
    return _run(_texts(posts, comments), "source_table string, record_id bigint, kind string", emit).distinct()


def redacted(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(source_table, record_id, text): every text with placeholders; posts come out as visible text."""
    emit = lambda source, key, text, spans: [(source, key, redact(text, spans))]
    return _run(_texts(posts, comments), "source_table string, record_id bigint, text string", emit).dropDuplicates(["source_table", "record_id"])
