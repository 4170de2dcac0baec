"""Resampled subspaces, planted-truth labels, hidden-change blocks, data of figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.functions.arrow import row_struct
from helixframe.operators import vectors as V


def _basis(x: np.ndarray, energy: float = 0.9, most: int = 50) -> np.ndarray:
    """L6 of the rows of x, by singular values."""
    if not len(x):
        return np.zeros((0, 0))
    _, s, v = np.linalg.svd(x, full_matrices=False)
    share = np.cumsum(s**2) / max((s**2).sum(), 1e-12)
    return v[: max(1, min(most, int((share < energy).sum()) + 1))].T


def overlap_replicates(spark: SparkSession, sets: list[np.ndarray], reps: int, pools: list[np.ndarray] | None = None, seed: int = 0) -> DataFrame:
    """(rep, overlap): mean pairwise subspace overlap of resampled sets of directions (rows).

    Without pools each set is resampled with replacement; with pools a set of its size is drawn from its pool without
    replacement, which is the null of a relabelling.  Replicates are rows dealt over tasks; each has a generator of its own.
    """
    data = spark.sparkContext.broadcast((sets, pools))

    def run(batches):
        own, pool = data.value
        for b in batches:
            values = []
            for rep in b["id"]:
                rng = np.random.default_rng([seed, int(rep)])
                drawn = [_basis(p[rng.choice(len(p), min(len(x), len(p)), replace=False)] if pool else x[rng.integers(0, len(x), len(x))]) for x, p in zip(own, pool or own, strict=True)]
                pairs = [V.subspace_overlap(a, c) for i, a in enumerate(drawn) for c in drawn[i + 1 :]]
                known = [p for p in pairs if p is not None]
                values.append(float(np.mean(known)) if known else None)
            yield pd.DataFrame({"rep": b["id"], "overlap": values})

    return spark.range(reps).repartition(min(reps, spark.sparkContext.defaultParallelism)).mapInPandas(run, "rep bigint, overlap double")


def ground_truth(weights: DataFrame, channels: np.ndarray, n_motif: int) -> DataFrame:
    """(feature_id, is_causal, margin): whether a feature's best absolute cosine with a motif channel exceeds 0.3 and all others'."""
    keys, w = V.matrix(weights)
    unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    c = np.abs(unit(w) @ unit(channels.T).T)
    motif, other = c[:, :n_motif].max(axis=1), c[:, n_motif:].max(axis=1)
    return weights.sparkSession.createDataFrame([(int(k), bool(m > 0.3 and m > o), float(m - o)) for k, m, o in zip(keys, motif, other)], "feature_id bigint, is_causal boolean, margin double")


def hidden_change(x: np.ndarray, model, layer: int) -> np.ndarray:
    """(position, dimension): mean over the 3 mutations of the absolute change of the mutated position's own hidden row."""
    n, r = len(x), model.reach(layer) + 9
    base = model.hidden(x, layer)
    out = np.zeros_like(base)
    for p in range(n):
        a, b = (0, n) if n < 4 * r else (max(0, p - 2 * r), min(n, p + 2 * r + 1))
        for alt in range(4):
            if alt != x[p]:
                y = x[a:b].copy()
                y[p - a] = alt
                out[p] += np.abs(model.hidden(y, layer)[p - a] - base[p]) / 3
    return out


def sensitivity_blocks(elements: DataFrame, model, layer: int) -> DataFrame:
    """M16 as probe rows (elem_id, pos, x, y): hidden changes against the measured effect."""

    def one(seq, e_mean):
        s = hidden_change(S.codes(seq), model, layer)
        return ([{"pos": i, "x": v.tolist(), "y": float(e)} for i, (v, e) in enumerate(zip(s, e_mean, strict=False))],)

    u = row_struct(one, "rows array<struct<pos:int,x:array<double>,y:double>>")
    return elements.select("elem_id", F.explode(u("seq", "e_mean")["rows"]).alias("r")).select("elem_id", "r.*")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 40) -> DataFrame:
    """The data of a histogram figure: (bin, n); values beyond the ends count in bins 0 and bins + 1."""
    return df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box(df: DataFrame, by: str, value: str) -> DataFrame:
    """The data of a box figure: quartiles and ends of each group."""
    q = F.percentile(value, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    return df.groupBy(by).agg(q.alias("q")).select(by, *[F.col("q")[i].alias(k) for i, k in enumerate(("low", "q1", "mid", "q3", "high"))])
