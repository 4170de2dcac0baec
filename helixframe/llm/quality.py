"""Line quality by a linear-chain conditional random field, and document quality from its marginals."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import crc_remainder, free_name, per_text, small_batches, table, utf8
from helixframe.llm.labelled import fit_logistic, labelled_sample

#: Labelled documents that the field is fitted on, at most.
SAMPLE = 10_000
#: Lines that it is fitted on, at most: documents in the order of a hash of their text, while their lines add up to so many.
LINES = 400_000
#: A document of more lines isn't fitted on; it is scored like any other.
LONGEST = 20_000
#: A bad line makes its document bad with this probability, each on its own.
SPOILS = 0.3
_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_SYMBOL = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
#: Features of a line that its neighbours see as well.
SHARED = (2, 3, 7, 8)
WIDTH = 13 + 2 * len(SHARED) + 1


def lines_of(text: bytes) -> list[bytes]:
    """Lines that have a word."""
    return [x for x in (line.strip() for line in text.split(b"\n")) if x]


def line_features(lines: list[bytes]) -> np.ndarray:
    """(line, feature): shape of the line, repetition in it and in the document, and the same of its neighbours."""
    times = Counter(lines)
    out = np.zeros((len(lines), WIDTH), np.float32)
    before: set[bytes] = set()
    for t, line in enumerate(lines):
        n = len(line)
        words = line.lower().split()
        k = len(words)
        distinct = set(words)
        out[t, :13] = (
            1.0,
            math.log1p(n) / 5,
            (n - len(line.translate(None, _UPPER))) / n,
            (n - len(line.translate(None, _SYMBOL))) / n,
            (n - len(line.translate(None, _DIGIT))) / n,
            min(n / k / 10, 3.0),
            len(distinct) / k,
            sum(map(bytes.__eq__, words, words[1:])) / k,
            min(times[line] - 1, 3) / 3,
            1.0 if n < 20 else 0.0,
            1.0 if line[-1:] in (b".", b"!", b"?") else 0.0,
            math.log1p(k - len(distinct)) / 5,
            min((n - len(line.translate(None, _SYMBOL))) / k, 4.0) / 4,
        )
        out[t, WIDTH - 1] = len(distinct & before) / len(distinct | before)
        before = distinct
    side = list(SHARED)
    out[1:, 13 : 13 + len(side)] = out[:-1, side]
    out[:-1, 13 + len(side) : 13 + 2 * len(side)] = out[1:, side]
    return out


@dataclass
class LineField:
    """Good lines score w x, bad ones 0; move[a, b] is for a line of kind b after one of kind a (1: good)."""

    w: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def marginals(self, x: np.ndarray) -> list[float]:
        """P(good) of each line by the forward-backward recursion, in log-odds."""
        s = (x @ self.w).tolist()
        (a00, a01), (a10, a11) = np.exp(self.move).tolist()
        step = lambda m, p, q, r, t: math.log(p * m + q) - math.log(r * m + t)
        bound = lambda v: math.exp(max(-50.0, min(50.0, v)))
        forward, back = [s[0]], [0.0]
        for v in s[1:]:
            forward.append(v + step(bound(forward[-1]), a11, a01, a10, a00))
        for v in s[:0:-1]:
            back.append(step(bound(v + back[-1]), a11, a10, a01, a00))
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, f + b)))) for f, b in zip(forward, reversed(back), strict=True)]

    def summary(self, lengths: list[int], good: list[float]) -> list[float]:
        """Length-weighted P(good), the share of bytes in lines that are rather bad, the worst line."""
        total = sum(lengths)
        mean = sum(n * g for n, g in zip(lengths, good, strict=True)) / total
        return [mean, sum(n for n, g in zip(lengths, good, strict=True) if g < 0.5) / total, min(good)]

    def probability(self, lengths: list[int], good: list[float]) -> float:
        """Calibrated quality of a document; one without lines has the share of good documents."""
        z = self.weights[0] + (float(np.dot(self.weights[1:], self.summary(lengths, good))) if good else float(np.dot(self.weights[1:], [0.5, 0.5, 0.5])))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@dataclass
class Chains:
    """Documents as whole chains of lines, padded: x is (chain, line, feature), sorted by falling length; y the documents' labels."""

    x: np.ndarray
    length: np.ndarray
    y: np.ndarray

    def expect(self, w: np.ndarray, move: np.ndarray, spare: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each chain log Z, P(good) of its lines and its expected moves, by forward-backward; bad lines weigh e^-spare."""
        chains, most, _ = self.x.shape
        live = [int((self.length > t).sum()) for t in range(most)]
        s = self.x @ w + spare
        alpha, beta = np.zeros((chains, most, 2)), np.zeros((chains, most, 2))
        alpha[:, 0, 1] = s[:, 0]
        for t in range(1, most):
            k = live[t]
            alpha[:k, t] = np.logaddexp(alpha[:k, t - 1, :1] + move[0], alpha[:k, t - 1, 1:] + move[1])
            alpha[:k, t, 1] += s[:k, t]
        for t in range(most - 2, -1, -1):
            k = live[t + 1]
            after = beta[:k, t + 1] + np.stack([np.zeros(k), s[:k, t + 1]], axis=1)
            beta[:k, t] = np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1])
        log_z = np.logaddexp(*np.moveaxis(alpha[np.arange(chains), self.length - 1], 1, 0))
        mask = np.arange(most) < self.length[:, None]
        good = np.where(mask, np.exp(np.minimum(alpha[..., 1] + beta[..., 1] - log_z[:, None], 0)), 0)
        moves = np.zeros((chains, 2, 2))
        for t in range(1, most):
            k = live[t]
            after = beta[:k, t] + np.stack([np.zeros(k), s[:k, t]], axis=1)
            for a in (0, 1):
                moves[:k, a] += np.exp(np.minimum(alpha[:k, t - 1, a : a + 1] + move[a] + after - log_z[:k, None], 0))
        return log_z - spare * self.length, good, moves

    def gradient(self, w: np.ndarray, move: np.ndarray, spoils: float = SPOILS) -> tuple[float, np.ndarray]:
        """Log-likelihood of the documents' labels with the lines' kinds summed out, and its slope in w and move."""
        z1, good1, moves1 = self.expect(w, move, -math.log(1 - spoils))
        z0, good0, moves0 = self.expect(w, move, 0.0)
        gap = np.maximum(z0 - z1, 1e-12)  # minus the log of P(the document is good)
        value = np.where(self.y == 1, -gap, np.log(-np.expm1(-gap)))
        weight = np.where(self.y == 1, 1.0, -1 / np.expm1(np.minimum(gap, 500)))
        slope = np.concatenate([np.einsum("c,ct,ctf->f", weight, good1 - good0, self.x, optimize=True), np.einsum("c,cab->ab", weight, moves1 - moves0).ravel()])
        return float(value.sum()), slope


def chains_of(docs: list[tuple[np.ndarray, int]], cells: int = 4_000_000) -> list[Chains]:
    """Documents (line features, label) as whole chains; those of like length are padded together, so many numbers at once."""
    out, of = [], sorted(docs, key=lambda d: -len(d[0]))
    at = 0
    while at < len(of):
        most, width = of[at][0].shape
        # no chain is padded to more than twice its length
        n = next((k for k in range(1, len(of) - at) if (k + 1) * most * width > cells or len(of[at + k][0]) * 2 < most), len(of) - at)
        part = of[at : at + n]
        x = np.zeros((n, most, width), np.float32)
        for i, (f, _) in enumerate(part):
            x[i, : len(f)] = f
        out.append(Chains(x, np.array([len(f) for f, _ in part]), np.array([y for _, y in part])))
        at += n
    return out


def fit_chains(docs: list[tuple[np.ndarray, int]], rounds: int = 150, ridge: float = 1e-4, rate: float = 0.08, spoils: float = SPOILS) -> tuple[np.ndarray, np.ndarray]:
    """w and move that maximise the documents' labels' mean log-likelihood, by Adam.

    A line's kind isn't observed.  A document is good if none of its bad lines spoils it, and the kinds are summed out:
    so a bad document may have good lines, and the field sees where one kind ends and the other begins.
    """
    parts = chains_of(docs)
    width = docs[0][0].shape[1]
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, rounds + 1):
        grad = sum(p.gradient(theta[:width], theta[width:].reshape(2, 2), spoils)[1] for p in parts) / len(docs) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:width], theta[width:].reshape(2, 2)


def fit(sample: DataFrame, most_lines: int = LINES, longest: int = LONGEST) -> LineField:
    """Fitted on the sample's line features, which is all that comes to the driver; then calibrated on documents.

    Of the sample, documents of `longest` lines or fewer count, in the order of a hash of their text, while their lines add up to
    most_lines or fewer: so no document leaves out more than itself, and all but `longest` of most_lines are made use of.  Lines
    are those that the field reads, not blank ones.
    """

    def measure(batches):
        for b in batches:
            y, n, x = [], [], []
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if 0 < len(lines := lines_of(text)) <= longest:
                    y.append(label), n.append([len(i) for i in lines]), x.append(line_features(lines).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(n, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["y", "n", "x"])

    # the window is over the sample's rows, whose number is bounded, without their texts
    n_lines = per_text(lambda: lambda text: (len(lines_of(text)),), "k int")(F.col("text"))["k"]
    size = sample.select(F.xxhash64("text").alias("h"), n_lines.alias("k")).where(F.col("k") <= longest)
    size = size.groupBy("h").agg(F.sum("k").alias("k")).withColumn("total", F.sum("k").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
    last = size.where(F.col("total") <= most_lines).agg(F.max("h")).first()[0]
    use = sample.where(F.xxhash64("text") <= F.lit(last if last is not None else -(1 << 63)))
    got = use.select("text", "y").mapInArrow(measure, "y int, n array<int>, x array<float>").toArrow()
    model = LineField()
    docs = [(y, n, np.array(x, np.float32).reshape(len(n), WIDTH)) for y, n, x in zip(got["y"].to_pylist(), got["n"].to_pylist(), (v.values.to_numpy() if v.values is not None else [] for v in got["x"]), strict=True)]
    if docs:
        model.w, model.move = fit_chains([(x, y) for y, _, x in docs])
    summaries = np.array([model.summary(n, model.marginals(x)) for _, n, x in docs]).reshape(len(docs), 3)
    model.weights = fit_logistic(summaries, np.array([y for y, *_ in docs], float), ridge=0.1)
    return model


def score_texts(docs: DataFrame, model: LineField, text_col: str = "text", name: str = "quality") -> DataFrame:
    """docs with a struct column <name>: score (0 to 1), predicted (1 if score >= 0.5), lines (length in bytes and P(good) of each).

    Lines without a word don't count; null and empty texts have none and score as an undecided document.  Rows are scored
    one by one, so repeats and ties don't matter and an empty table gives an empty one.  If docs has a column <name>,
    underscores go in front of the new one's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def one(text: bytes):
            lines = lines_of(text)
            lengths = [len(x) for x in lines]
            good = m.marginals(line_features(lines)) if lines else []
            p = m.probability(lengths, good)
            return p, int(p >= 0.5), [{"n_bytes": n, "good": g} for n, g in zip(lengths, good, strict=True)]

        return one

    return small_batches(docs).withColumn(free_name(docs, name), per_text(make, "score double, predicted int, lines array<struct<n_bytes:int,good:double>>")(utf8(text_col)))


def fit_from_labels(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> LineField:
    """Fitted on labelled documents outside the fold crc32(doc_id) mod 3 = 1; `bound` of them and LINES lines at most.

    What labelled_sample says holds for nulls and repeats.  Without labels, or with one only, the score is their share.
    """
    return fit(labelled_sample(small_batches(docs), labels, "quality", 3, 1, bound=bound))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, fit_from_labels(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "quality.score", "quality.predicted", F.size("quality.lines").alias("n_lines"))
