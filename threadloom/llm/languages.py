"""Languages of texts by a character n-gram model, trained from labelled texts.

Counts of hashed 1- to 3-grams of letters per language give log probabilities (multinomial naive Bayes). The
training sample is bounded: about `per_language` texts of each label, chosen by a hash of the text, so the model's size
and the cost of training do not grow. Wrong labels in the sample blur it a little and decide nothing.

Null, empty and letterless texts have no language. With fewer than two labels nothing is ever another language.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import visible_text

BITS = 15
PER_LANGUAGE = 200
CHARACTERS = 4000  # of a training text
SMOOTHING = 0.1
#: A text is in another language when that language scores so much better a gram, and altogether, than the expected one.
MARGIN, EVIDENCE = 0.2, 30.0


@cache
def letters() -> np.ndarray:
    return np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), bool)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of letters and word boundaries of texts in a row, and the text of each."""
    joined = "".join(f" {t} " for t in texts).lower()  # lower() may lengthen, so the owner is found from the parts
    sizes = np.array([len(f" {t} ".lower()) for t in texts], np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one boundary after a run of letters
    keep[np.cumsum(sizes) - sizes] = True  # and one before each text
    points, owner = np.where(letter, points, 32)[keep].astype(np.uint64), np.repeat(np.arange(len(texts)), sizes)[keep]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    inside = (owner[:-2] == owner[1:-1]) & (owner[1:-1] == owner[2:])
    mixed = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)[inside]
    three = np.stack([mixed(b + np.uint64(7)), mixed((a << np.uint64(21)) + b + np.uint64(11)), mixed((a << np.uint64(42)) + (b << np.uint64(21)) + c)], axis=1)
    return three.ravel(), np.repeat(owner[1:-1][inside], 3)


class LanguageModel:
    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.names = sorted(samples)
        counts = np.full((1 << BITS, len(self.names)), SMOOTHING)
        for k, name in enumerate(self.names):
            np.add.at(counts[:, k], grams(samples[name])[0], 1)
        self.scores = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def rate(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts x languages: the sum of scores; and each text's number of grams."""
        bucket, owner = grams(texts)
        sums, n = np.zeros((len(texts), len(self.names))), np.bincount(owner, minlength=len(texts))
        some = np.flatnonzero(n)
        if len(some) and self.names:
            sums[some] = np.add.reduceat(self.scores[bucket], np.searchsorted(owner, some), axis=0, dtype=np.float64)
        return sums, n

    def differ(self, texts: list[str], others: list[str]) -> list[bool]:
        """Of each text: is it in another language than its other text?"""
        if not self.names or not texts:
            return [False] * len(texts)
        distinct = list(dict.fromkeys(others))
        expected = dict(zip(distinct, zip(*self.rate(distinct))))
        out = []
        for scores, n, other in zip(*self.rate(texts), others):
            theirs, m = expected[other]
            lead = scores.max() - scores[int(theirs.argmax())]
            out.append(bool(n and m and lead >= EVIDENCE and lead >= MARGIN * n))
        return out


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """The model of labelled(lang, text). A bounded sample comes to the driver."""
    known = labelled.where("lang is not null and lang not in ('', 'und') and length(text) >= 12").select("lang", F.substring(F.regexp_replace("text", "<[^<>]*>", " "), 1, CHARACTERS).alias("text"), F.xxhash64("text").alias("h"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count")).limit(100).collect()}
    if not sizes:
        return LanguageModel({})
    step = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, n // per_language))])[F.col("lang")]
    samples: dict[str, list[str]] = {}
    for r in known.where(F.pmod("h", step) == 0).select("lang", "text").collect():  # about per_language of each of at most 100 labels
        samples.setdefault(r["lang"], []).append(visible_text(r["text"]))
    return LanguageModel(samples)
