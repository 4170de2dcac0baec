"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by their extreme-value law."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import alnum_words, crc_remainder, free_name, per_text, small_batches, table, utf8
from helixframe.llm.labelled import SAMPLE, fit_logistic, labelled_sample

#: Bytes of the prefixes whose words share a prior, shortest first.
PREFIXES = (5, 6, 7, 8)
#: Documents' worth of prior that a prefix, or a word, takes from the next shorter prefix.
STRENGTH = 24.0
#: What each token of a passage costs: a geometric prior on its length, without which common words would have a score of zero.
DRIFT = 1.0
#: Cells that words and prefixes are hashed into, as a power of two: the model's size, whatever the vocabulary.
CELLS = 21
#: Distinct words a worker remembers the scores of.
MEMO = 300_000
BINS = np.arange(-10.0, 12.0, 0.25)


def chain(word: bytes) -> list[int]:
    """Cells of a word's back-off, shortest prefix first, the word last."""
    keys = [b"p" + word[:n] for n in PREFIXES if len(word) > n] + [b"w" + word]
    return [xxhash.xxh64_intdigest(k) >> (64 - CELLS) for k in keys]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in one scan.

    A segment's score exceeds that of each of its prefixes and suffixes, and no longer run of positions that has this
    property contains it.
    """
    start, end, low, high, link = [], [], [], [], []
    total = 0.0
    for pos, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        now = (pos, pos + 1, before, total)
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= now[2]:
                j = link[j]
            if j < 0 or high[j] >= now[3]:
                break
            now = (start[j], now[1], low[j], now[3])
            del start[j:], end[j:], low[j:], high[j:], link[j:]
        start.append(now[0]), end.append(now[1]), low.append(now[2]), high.append(now[3]), link.append(j)
    return [(a, b, h - lo) for a, b, lo, h in zip(start, end, low, high, strict=True)]


def log_odds(share: float) -> float:
    return math.log(share / (1 - share))


@dataclass
class ToxicModel:
    """Evidence for words and prefixes, and the law of the best segment in clean text: P(S >= s) = 1 - exp(-K n e^(-rate s)).

    toxic and docs tell, for each cell, in how many toxic documents and in how many of all its words occur.
    """

    toxic: np.ndarray = field(default_factory=lambda: np.zeros(1 << CELLS, np.float32))
    docs: np.ndarray = field(default_factory=lambda: np.zeros(1 << CELLS, np.float32))
    base: float = 0.5
    rate: float = 1.0
    log_k: float = math.log(0.01)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def word(self, word: bytes) -> float:
        """Log-odds of a word against all documents, less the drift.

        A word's share of toxic documents has a Dirichlet prior centred on the share of its longest prefix, that on the next
        shorter one's, and the shortest rests on all documents.
        """
        share = self.base
        for cell in chain(word):
            share = (float(self.toxic[cell]) + STRENGTH * share) / (float(self.docs[cell]) + STRENGTH)
        return log_odds(min(max(share, 1e-4), 1 - 1e-4)) - log_odds(self.base) - DRIFT

    def reader(self, memo: int = MEMO):
        """A function from text bytes to its words' scores and maximal segments; it remembers words."""
        known: dict[bytes, float] = {}

        def read(text: bytes) -> tuple[list[float], list[tuple[int, int, float]]]:
            words = alnum_words(text)
            if len(known) > memo:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self.word(w)
            scores = list(map(known.__getitem__, words))
            return scores, maximal_segments(scores)

        return read

    def features(self, n: int, segments: list[tuple[int, int, float]]) -> list[float]:
        """Minus log E of the best segment, the best sum statistic of several, the segments that are significant; all bounded, 0 without segments."""
        space = self.log_k + math.log(max(n, 1))
        best = sorted((s for *_, s in segments), reverse=True)
        sums = total = 0.0
        for r, s in enumerate(best, 1):
            total += self.rate * s - space
            sums = max(sums, total + math.lgamma(r + 1))
        first = self.rate * best[0] - space if best else 0.0
        many = sum(self.rate * s - space > math.log(20) for s in best)
        return [min(max(first, 0.0), 12.0), min(max(sums, 0.0), 24.0) / 2, min(many, 5.0)]

    def probability(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(n, segments)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(sample: DataFrame) -> ToxicModel:
    """Log-odds from two thirds of the labelled sample, the extreme-value law and the calibration from the rest.

    The driver gets two numbers for each cell, of which there are 2**CELLS, and four for each document of the sample.
    """

    def count(batches):
        n = {0: Counter(), 1: Counter()}
        docs = Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs[y] += 1
                n[y].update({k for w in set(alnum_words(text)) for k in chain(w)})
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([-1, *n[y]], pa.int32()), pa.array([docs[y], *n[y].values()], pa.int64()), pa.array([y] * (len(n[y]) + 1), pa.int32())], names=["k", "n", "y"])

    parts = sample.where("u < 0.667").select("text", "y").mapInArrow(count, "k int, n bigint, y int")
    cells = parts.groupBy("k").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).cast("float").alias("t"), F.sum("n").cast("float").alias("n")).toArrow()
    at, toxic, docs = (cells[c].to_numpy() for c in ("k", "t", "n"))
    model = ToxicModel()
    model.toxic[at[at >= 0]], model.docs[at[at >= 0]] = toxic[at >= 0], docs[at >= 0]
    model.base = float((toxic[at < 0].sum() + 0.5) / (docs[at < 0].sum() + 1))

    def law(batches):
        read = model.reader()
        for b in batches:
            out = [(len(scores), max((s for *_, s in segments), default=0.0), np.histogram(np.clip(scores, -9.9, 11.9), BINS)[0].tolist()) for scores, segments in map(read, b.column(0).to_pylist())]
            n, s, h = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(h, pa.list_(pa.int64()))], names=["n", "s", "h"])

    rest = sample.where("u >= 0.667").select("text", "y")
    plain = rest.where("y = 0").mapInArrow(law, "n bigint, s double, h array<bigint>").where("n > 0").collect()
    if plain:
        length = np.array([r["n"] for r in plain])
        model.rate = _rate((BINS[:-1] + BINS[1:]) / 2, np.sum([r["h"] for r in plain], axis=0) / length.sum())
        model.log_k = math.log(len(plain) / np.sum(length * np.exp(-model.rate * np.array([r["s"] for r in plain]))))

    def measure(batches):
        read = model.reader()
        for b in batches:
            x = [model.features(len(scores), segments) for scores, segments in map(read, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    seen = rest.mapInArrow(measure, "y int, x array<double>").collect()
    model.weights = fit_logistic(np.array([r["x"] for r in seen]).reshape(len(seen), 3), np.array([r["y"] for r in seen], float))
    return model


def _rate(score: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share e^(rate score)) = 1 by bisection; 1 where scores never exceed zero."""
    if not share[score > 0].sum() or (score * share).sum() >= 0:
        return 1.0
    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(mid * score)).sum() < 1 else (low, mid)
    return max(0.05, (low + high) / 2)


def score_texts(docs: DataFrame, model: ToxicModel, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with a struct column <name>: score (0 to 1), predicted (1 if score >= 0.5), segments of words with their score and E-value.

    Only significant segments (E < 0.05) are listed.  Null and empty texts have no segment and the score of clean text.
    Rows are scored one by one, so repeats and ties don't matter and an empty table gives an empty one.  If docs has a
    column <name>, underscores go in front of the new one's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        read = m.reader()

        def one(text: bytes):
            scores, segments = read(text)
            n = len(scores)
            p = m.probability(n, segments)
            found = [{"start": a, "end": b, "score": s, "e_value": e} for a, b, s in segments if (e := math.exp(min(50.0, m.log_k + math.log(n) - m.rate * s))) < 0.05]
            return p, int(p >= 0.5), found

        return one

    made = per_text(make, "score double, predicted int, segments array<struct<start:int,end:int,score:double,e_value:double>>")
    return small_batches(docs).withColumn(free_name(docs, name), made(utf8(text_col)))


def fit_from_labels(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> ToxicModel:
    """Fitted on labelled documents outside the fold crc32(doc_id) mod 5 = 0; `bound` of them at most.

    What labelled_sample says holds for nulls and repeats.  Without labels, or with one only, the score is their share.
    """
    return fit(labelled_sample(small_batches(docs), labels, "toxic", 5, 0, bound=bound))


def drop_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model predicts to be toxic; columns as they were.  Null and empty texts stay unless clean text wouldn't."""
    name = free_name(docs, "toxicity")
    return score_texts(docs, model, text_col, name).where(F.col(f"`{name}`.predicted") == 0).drop(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, fit_from_labels(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "toxicity.score", "toxicity.predicted", F.size("toxicity.segments").alias("n_segments"))
