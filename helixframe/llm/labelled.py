"""A bounded sample of labelled rows, and a small logistic fit: shared by the classifiers."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import alnum_words, crc_remainder, per_text, utf8

#: Labelled documents that a classifier is fitted on, at most; which ones, a hash of their ids decides.
SAMPLE = 30_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, held: int, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """(text bytes, y 0/1, u in [0, 1)) of at most `bound` labelled ids outside the held-out fold; u deals them into parts.

    Null ids and labels don't count; an id that is labelled twice has its largest label.  Of texts with the same three
    least shingle hashes (which copies have, near copies mostly, and texts that only share a passage seldom) and the same
    label the one of least id stays: else a text that was copied a thousand times would teach its every word, and its copies
    in the other part would confirm it.  u follows the least hash, so that what is like it falls in the same part.  Only ids
    and labels are broadcast.
    """
    use = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    use = use.where(crc_remainder("id", mod) != held).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    use = use.orderBy(F.xxhash64(F.col("id"), F.lit("sample")), "id").limit(bound)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), utf8(text_col).alias("text"))
    rows = own.join(F.broadcast(use), "id").withColumn("k", per_text(lambda: lambda text: (least_shingles(text),), "h array<bigint>")(F.col("text"))["h"])
    rows = rows.groupBy("k", "y").agg(F.min_by("text", F.struct("id", "text")).alias("text"))
    return rows.select("text", "y", (F.pmod(F.xxhash64(F.col("k")[0], F.lit("part")), F.lit(1000)) / 1000.0).alias("u"))


def least_shingles(text: bytes, size: int = 5, least: int = 3) -> list[int]:
    """The least hashes of the text's runs of five words, as signed numbers; of the whole text if it has fewer."""
    words = alnum_words(text)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return [h - (1 << 63) for h in sorted({xxhash.xxh64_intdigest(r) for r in runs})[:least]]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, intercept first, by Newton's steps with a small ridge; without both labels the intercept alone."""
    x = np.column_stack([np.ones(len(y)), x]) if len(y) else np.zeros((0, 1 + x.shape[1]))
    w = np.zeros(x.shape[1])
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    w[0] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * np.r_[0, w[1:]]
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-6, np.full(len(w) - 1, ridge)])
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w
