"""A model without weights to download: motif, GC and random channels, mixed by depth, in a fixed rotation; ISM through any encoder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.functions.arrow import row_struct

WINDOWS = (11, 31)


@dataclass(frozen=True)
class ToyModel:
    """M4.  hidden(x, layer) is (position, d_model); reach positions to either side decide a row of it."""

    d_model: int = 64
    layers: int = 4
    seed: int = 0
    kmer: int = 7

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        n = len(S.MOTIFS) + len(WINDOWS) + self.n_random
        r = rng.standard_normal((self.d_model, n))
        object.__setattr__(self, "rotation", r / (np.linalg.norm(r, axis=0, keepdims=True) + 1e-9))
        object.__setattr__(self, "mixing", rng.standard_normal((self.kmer, 4, self.n_random)))

    @property
    def n_random(self) -> int:
        return max(4, self.d_model // 8)

    def reach(self, layer: int) -> int:
        return max(WINDOWS) // 2 + layer

    def channels(self, x: np.ndarray) -> np.ndarray:
        """Positive motif log-odds at their starts, centred GC averages, projections of the one-hot k-mer around."""
        n = len(x)
        out = np.zeros((n, len(S.MOTIFS) + len(WINDOWS) + self.n_random))
        for c, (consensus, _) in enumerate(S.MOTIFS.values()):
            v = S.motif_scan(x, consensus)
            out[: len(v), c] = np.maximum(v, 0)
        gc = ((x == 1) | (x == 2)).astype(float)
        for c, w in enumerate(WINDOWS, len(S.MOTIFS)):
            out[:, c] = S.moving_average(gc, w) - 0.5
        half = self.kmer // 2
        for o in range(self.kmer):
            a, b = max(0, half - o), min(n, n + half - o)
            if a < b:
                out[a:b, -self.n_random :] += self.mixing[o][x[a + o - half : b + o - half]]
        return out

    def hidden(self, x: np.ndarray, layer: int) -> np.ndarray:
        g = self.channels(x)
        for _ in range(layer - 1):  # W6
            p = np.vstack([np.zeros(g.shape[1]), g, np.zeros(g.shape[1])])
            g = (p[:-2] + p[1:-1] + p[2:]) / 3
        return g @ self.rotation.T


BACKENDS: dict[str, Callable[..., object]] = {"toy": ToyModel}


def load_model(name: str, **settings):
    """M5: a registered backend; others can register under a name (M1: hidden(x, layer), reach(layer)).  Unknown ones fall back to the toy."""
    return BACKENDS.get(name, ToyModel)(**settings)


def topk_encoder(w: np.ndarray, b: np.ndarray, k: int) -> Callable[[np.ndarray], np.ndarray]:
    """M7 as a function of a matrix of hidden rows."""

    def encode(h: np.ndarray) -> np.ndarray:
        z = np.maximum((h - b) @ w.T, 0)
        if k < z.shape[1]:
            np.put_along_axis(z, np.argsort(-z, axis=1, kind="stable")[:, k:], 0.0, axis=1)
        return z

    return encode


def relu_encoder(w: np.ndarray, theta: np.ndarray | float = 0.0) -> Callable[[np.ndarray], np.ndarray]:
    """Directions that fire above theta."""
    return lambda h: np.maximum(h @ w.T - theta, 0)


def sensitivity(x: np.ndarray, model, encode, layer: int, alts: str = "all", summary: str = "max") -> tuple[np.ndarray, np.ndarray]:
    """|base - mutant| (position, alternative, feature), and the base code.

    A mutation changes rows within the model's reach; only these are computed again, and maxima to their left and right stand
    for the rest.  summary "token" takes the mutated row for the mutant, but the maximum for the base.
    """
    n, r = len(x), model.reach(layer)
    z = encode(model.hidden(x, layer))
    top = z.max(axis=0)
    none = np.full((1, z.shape[1]), -np.inf)
    left = np.vstack([none, np.maximum.accumulate(z)])
    right = np.vstack([np.maximum.accumulate(z[::-1])[::-1], none])
    others = np.array([[b for b in range(4) if b != c] for c in range(4)])[:, : 3 if alts == "all" else 1]
    out = np.zeros((n, others.shape[1], z.shape[1]))
    whole = n < 4 * r
    for p in range(n):
        a, b = (0, n) if whole else (max(0, p - 2 * r - 9), min(n, p + 2 * r + 10))
        lo, hi = (0, n) if whole else (max(0, p - r - 9), min(n, p + r + 1))
        for j, base in enumerate(others[x[p]]):
            y = x[a:b].copy()
            y[p - a] = base
            part = encode(model.hidden(y, layer)[lo - a : hi - a])
            mutant = part[p - lo] if summary == "token" else np.maximum(np.maximum(part.max(axis=0), left[lo]), right[hi])
            out[p, j] = np.abs(top - mutant)
    return out, z


def activations(corpus: DataFrame, model, layer: int) -> DataFrame:
    """(seq_id, pos, token, h) of every position; a window is one row until it is encoded."""

    def run(batches):
        for b in batches:
            for i, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = model.hidden(S.codes(seq), layer)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(h)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h.tolist(), pa.list_(pa.float64()))], names=["seq_id", "pos", "h"])

    a = corpus.where("seq IS NOT NULL").select(F.col("seq_id").cast("string").alias("seq_id"), "seq").mapInArrow(run, "seq_id string, pos int, h array<double>")
    return a.withColumn("token", F.xxhash64("seq_id", "pos"))


def layer_candidates(n: int) -> list[int]:
    """A quarter, half and three quarters of the layers, at least the first, each once."""
    return list(dict.fromkeys(max(1, n * q // 4) for q in (1, 2, 3)))


def elements_of(corpus: DataFrame) -> DataFrame:
    """Elements (elem_id, seq, e_mean, e_signed, e_max, e_alt by position and base) of windows with planted motifs."""

    def one(seq, planted):
        e = S.motif_effect(S.codes(seq), [(p["start"], p["motif"]) for p in planted])
        total = e.sum(axis=1)
        return (total / 3).tolist(), (-total / 3).tolist(), e.max(axis=1).tolist(), e.tolist()

    u = row_struct(one, "e_mean array<double>, e_signed array<double>, e_max array<double>, e_alt array<array<double>>")
    return corpus.select(F.col("seq_id").alias("elem_id"), "seq", u("seq", "planted").alias("e")).select("elem_id", "seq", "e.*")


def _spearman(i: np.ndarray, e: np.ndarray) -> float:
    from helixframe.plans.programs import _rank

    if len(i) < 3 or np.ptp(i) < 1e-12 or np.ptp(e) < 1e-12:
        return 0.0
    return float(np.corrcoef(_rank(i), _rank(e))[0, 1])


def alignments(elements: DataFrame, model, encode, layer: int, metric: str = "spearman_all", alts: str = "all", summary: str = "max", every: bool = False) -> DataFrame:
    """The alignment fact (feature_id, elem_id, a_f, mass) of the features active on each element, or of all.

    Effects of another length than the sequence, as of a shuffled partner, count over the positions that both have.
    """
    from helixframe.operators.metrics import get_metric
    from helixframe.plans.programs import _weighted_precision

    get_metric(metric)
    score = {
        "spearman_all": _spearman,
        "spearman_active": lambda i, e: _spearman(i[i > 1e-9], e[i > 1e-9]),
        "precision_weighted": _weighted_precision,
    }[metric]

    def one(seq, e_mean):
        x, e = S.codes(seq), np.array(e_mean)
        d, z = sensitivity(x, model, encode, layer, alts, summary)
        n = min(len(d), len(e))
        i, e = d.mean(axis=1)[:n], e[:n]
        return ([{"feature_id": int(f), "a_f": score(i[:, f], e), "mass": float(z[:, f].sum())} for f in range(z.shape[1]) if every or z[:, f].max() > 0],)

    u = row_struct(one, "a array<struct<feature_id:int,a_f:double,mass:double>>")
    r = elements.where(F.length("seq") > 0).select("elem_id", u("seq", "e_mean").alias("s"))
    return r.select("elem_id", F.explode("s.a").alias("a")).select("a.feature_id", "elem_id", "a.a_f", "a.mass")


def alignments_subst(elements: DataFrame, model, encode, layer: int) -> DataFrame:
    """C2 with X9: (feature_id, elem_id, a_f, a_f_subst, mass): the precision-weighted score by position and by substitution."""
    from helixframe.plans.programs import _weighted_precision

    others = np.array([[b for b in range(4) if b != c] for c in range(4)])

    def one(seq, e_mean, e_alt):
        x, e, by_base = S.codes(seq), np.array(e_mean), np.array(e_alt)
        d, z = sensitivity(x, model, encode, layer)
        flat = by_base[np.arange(len(x))[:, None], others[x]].ravel()
        rows = []
        for f in np.flatnonzero(z.max(axis=0) > 0):
            i = d[:, :, f]
            rows.append({"feature_id": int(f), "a_f": _weighted_precision(i.mean(axis=1), e), "a_f_subst": _weighted_precision(i.ravel(), flat), "mass": float(z[:, f].sum())})
        return (rows,)

    u = row_struct(one, "a array<struct<feature_id:int,a_f:double,a_f_subst:double,mass:double>>")
    r = elements.where("length(seq) > 0 AND e_alt IS NOT NULL").select("elem_id", u("seq", "e_mean", "e_alt").alias("s"))
    return r.select("elem_id", F.explode("s.a").alias("a")).select("a.feature_id", "elem_id", "a.a_f", "a.a_f_subst", "a.mass")


def subspace_tracks(elements: DataFrame, model, layer: int, basis: np.ndarray) -> DataFrame:
    """G19 with L11: for each element what the size of a row's projection onto the basis follows: AUROC of the repeat mask, rank
    correlation with the GC share around and with the measured effect; null or 0 where a side is constant."""
    from helixframe.plans.programs import _rank

    def one(seq, e_mean):
        x = S.codes(seq)
        m = np.linalg.norm(model.hidden(x, layer) @ basis, axis=1)
        mask = S.repeat_mask(seq)
        p, n = int(mask.sum()), int((~mask).sum())
        auc = float((_rank(m)[mask].sum() - p * (p + 1) / 2) / (p * n)) if p and n else None
        gc = S.moving_average(((x == 1) | (x == 2)).astype(float), 25)
        return auc, _spearman(m, gc), _spearman(m, np.array(e_mean))

    u = row_struct(one, "repeat_auroc double, gc_rho double, effect_rho double")
    return elements.where("length(seq) > 0").select("elem_id", u("seq", "e_mean").alias("t")).select("elem_id", "t.*")


def loglik_baseline(elements: DataFrame) -> DataFrame:
    """Precision-weighted alignment of the bigram log-likelihood's sensitivity, one feature with unit weights."""
    from helixframe.plans.programs import _weighted_precision

    def one(seq, e_mean):
        return (_weighted_precision(S.loglik_sensitivity(S.codes(seq)), np.array(e_mean)),)

    u = row_struct(one, "a double")
    return elements.select(F.lit(-1).alias("feature_id"), "elem_id", u("seq", "e_mean")["a"].alias("a_f"), F.lit(1.0).alias("mass"))


def annotate(codes: DataFrame, windows: DataFrame, hits: DataFrame, features: DataFrame, n: int = 10, p: float = 1e-4) -> DataFrame:
    """(feature_id, density, top_motif, p_value, element_class, label).

    codes (seq_id, token, feature_id, z), windows (seq_id, cls), hits (seq_id, motif, has).  Of each feature's n strongest tokens, the
    sequences' motifs are tested against all sequences, and the commonest class is taken, ties by name (A16).  label: dead without
    a token, motif below p, element for class ccre, else unannotated.
    """
    from pyspark.sql import Window

    from helixframe.operators import vectors as V

    top = V.top_activating(codes, n).select("feature_id", "seq_id").distinct()
    density = codes.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    bg = hits.groupBy("motif").agg(F.count(F.lit(1)).alias("n_bg"), F.count_if("has").alias("bg"))
    fg = top.join(hits, "seq_id").groupBy("feature_id", "motif").agg(F.count(F.lit(1)).alias("k"), F.count_if("has").alias("h"))

    def tail(k, h, n_bg, b):
        from math import exp, lgamma

        total, good = n_bg + k, max(1, round(b / n_bg * n_bg)) + h
        choose = lambda a, c: lgamma(a + 1) - lgamma(c + 1) - lgamma(a - c + 1)
        return (min(1.0, sum(exp(choose(good, i) + choose(total - good, k - i) - choose(total, k)) for i in range(h, min(k, good) + 1) if k - i <= total - good)),)

    tested = fg.join(F.broadcast(bg), "motif").withColumn("p_value", row_struct(tail, "p double")("k", "h", "n_bg", "bg")["p"])
    best = tested.groupBy("feature_id").agg(F.min(F.struct("p_value", "motif")).alias("m")).select("feature_id", F.col("m.motif").alias("top_motif"), F.col("m.p_value").alias("p_value"))
    w = Window.partitionBy("feature_id").orderBy(F.desc("c"), "cls")
    cls = top.join(windows, "seq_id").groupBy("feature_id", "cls").agg(F.count(F.lit(1)).alias("c")).withColumn("r", F.row_number().over(w)).where("r = 1").select("feature_id", F.col("cls").alias("element_class"))
    out = features.select("feature_id").join(density, "feature_id", "left").join(best, "feature_id", "left").join(cls, "feature_id", "left")
    label = F.when(F.col("n_tokens").isNull(), "dead").when(F.col("p_value") < p, "motif").when(F.col("element_class") == "ccre", "element").otherwise("unannotated")
    return out.withColumn("label", label)
