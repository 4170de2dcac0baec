"""Vector operators: projections, sparse encoders, decoder geometry.

acts is (token, h array<double>, ...); weights (feature_id, w array<double>) are a model's parameters: they are collected
behind a check of their size and multiply whole Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a parameter matrix that tasks may hold, at most.
MOST = 50_000_000


def matrix(weights: DataFrame, key: str = "feature_id", vec: str = "w") -> tuple[np.ndarray, np.ndarray]:
    """Keys and the (key, dimension) matrix, by key; too large a model is refused before anything is collected."""
    size = weights.agg(F.coalesce(F.sum(F.size(vec)), F.lit(0))).first()[0]
    if size > MOST:
        raise ValueError(f"{size} parameters; split the features into blocks")
    rows = weights.select(key, vec).orderBy(key).collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)


def _dense(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def tree_sum(parts: DataFrame, lanes: int = 64) -> dict[int, np.ndarray]:
    """{k: sum of v} of parts (k bigint, v array<double>): tasks first add up in lanes, so the driver adds `lanes` arrays a key at most.

    Arrays of a key have one length; a task holds one array a key.
    """

    def add(batches):
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                out[k] = out[k] + v if k in out else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([v.tolist() for v in out.values()], pa.list_(pa.float64()))], names=["k", "v"])

    laid = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes))).repartition("lane").select("k", "v").mapInArrow(add, "k bigint, v array<double>")
    total: dict[int, np.ndarray] = {}
    for r in laid.collect():
        total[r["k"]] = total.get(r["k"], 0.0) + np.array(r["v"])
    return total


def _codes(acts: DataFrame, keys: np.ndarray, z) -> DataFrame:
    """Long sparse codes (token, feature_id, z) of z(h) > 0, a batch of tokens at a time."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = z(_dense(b.column(1)))
            i, j = np.nonzero(v > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(keys[j]), pa.array(v[i, j])], names=["token", "feature_id", "z"])

    return acts.where("h IS NOT NULL").select("token", "h").mapInArrow(run, f"token {acts.schema['token'].dataType.simpleString()}, feature_id bigint, z double")


def project(acts: DataFrame, weights: DataFrame) -> DataFrame:
    """L1: (token, feature_id, dot) for every pair of a token and a direction."""
    keys, w = matrix(weights)

    def run(batches):
        for b in batches:
            v = _dense(b.column(1)) @ w.T if b.num_rows else np.zeros((0, len(keys)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), len(keys)))), pa.array(np.tile(keys, b.num_rows)), pa.array(v.ravel())], names=["token", "feature_id", "dot"])

    return acts.where("h IS NOT NULL").select("token", "h").mapInArrow(run, f"token {acts.schema['token'].dataType.simpleString()}, feature_id bigint, dot double")


def encode_topk(acts: DataFrame, weights: DataFrame, k: int, bias=0.0) -> DataFrame:
    """M7 with T4: ReLU(w h + bias), the k largest of each token, ties by feature; fewer if fewer are positive.

    bias is a number, or an array with one for each feature in the order of their ids.
    """
    keys, w = matrix(weights)

    def z(h):
        v = np.maximum(h @ w.T + bias, 0)
        if k < v.shape[1]:
            order = np.argsort(-v, axis=1, kind="stable")[:, k:]
            np.put_along_axis(v, order, 0.0, axis=1)
        return v

    return _codes(acts, keys, z)


def encode_gated(acts: DataFrame, weights: DataFrame, r_mag=0.0, b_gate=0.0, b_mag=0.0, bias=0.0) -> DataFrame:
    """M8: ReLU(exp(r_mag) w (h - bias) + b_mag) where w (h - bias) + b_gate > 0.

    Each is a number for all features, or an array with one for each in the order of their ids; bias is one for each dimension.
    """
    keys, w = matrix(weights)

    def z(h):
        p = (h - bias) @ w.T
        return np.where(p + b_gate > 0, np.maximum(np.exp(r_mag) * p + b_mag, 0), 0)

    return _codes(acts, keys, z)


def encode_jumprelu(acts: DataFrame, weights: DataFrame, theta=0.0, b=0.0, bias=0.0) -> DataFrame:
    """M9: ReLU(w (h - bias) + b) where it exceeds theta; theta and b as encode_gated's."""
    keys, w = matrix(weights)

    def z(h):
        p = np.maximum((h - bias) @ w.T + b, 0)
        return np.where(p > theta, p, 0)

    return _codes(acts, keys, z)


def encode(acts: DataFrame, family: str, p: dict[str, np.ndarray], bias: np.ndarray, k: int = 16) -> DataFrame:
    """Codes of a trained encoder (models.train), whichever its family."""
    w = acts.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p["w"])], "feature_id bigint, w array<double>")
    if family == "gated":
        return encode_gated(acts, w, p["r_mag"], p["b_gate"], p["b_mag"], bias)
    if family == "jumprelu":
        return encode_jumprelu(acts, w, np.exp(p["log_theta"]), p["b"], bias)
    keys, d = matrix(w)
    return encode_topk(acts, w, k, -(d @ bias))


def reconstruction(acts: DataFrame, z, w: np.ndarray, bias=0.0) -> tuple[float, np.ndarray, int]:
    """(A11's FVU, in how many tokens each feature is active, tokens) of the codes z(h) rebuilt as z w + bias.

    Residuals are summed where tokens are encoded: what travels is a few numbers a dimension and task.
    """

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = _dense(b.column(0))
                c = z(x)
                e = x - (c @ w + bias)
                v = np.concatenate([[len(x), (e * e).sum()], x.sum(axis=0), (x * x).sum(axis=0), (c > 0).sum(axis=0)])
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["k", "v"])

    got = tree_sum(acts.where("h IS NOT NULL").select("h").mapInArrow(run, "k bigint, v array<double>"))
    if not got:
        return 0.0, np.zeros(len(w)), 0
    v, d = got[0], w.shape[1]
    n, s, xx = v[0], v[2 : 2 + d], v[2 + d : 2 + 2 * d]
    return float(v[1] / ((xx - s * s / n).sum() + 1e-9)), v[2 + 2 * d :], int(n)


def decode(codes: DataFrame, weights: DataFrame) -> DataFrame:
    """M6: (token, h) rebuilt from sparse codes, whose features' vectors are joined and added up by dimension."""
    parts = codes.join(weights, "feature_id").select("token", "z", F.posexplode("w").alias("j", "x"))
    dims = parts.groupBy("token", "j").agg(F.sum(F.col("z") * F.col("x")).alias("v"))
    return dims.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("h"))


def fvu(acts: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Squared residuals over squared deviations from the mean, plus 1e-9; tokens without a code count as zero vectors."""
    long = acts.select("token", F.posexplode("h").alias("j", "x"))
    back = rebuilt.select("token", F.posexplode("h").alias("j", "y"))
    s = long.join(back, ["token", "j"], "left").groupBy("j").agg(
        F.sum(F.pow(F.col("x") - F.coalesce("y", F.lit(0.0)), F.lit(2.0))).alias("r"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")
    )
    return s.agg((F.sum("r") / (F.sum(F.col("xx") - F.col("s") * F.col("s") / F.col("n")) + F.lit(1e-9))).alias("fvu"))


def firing_density(codes: DataFrame, tokens: int) -> DataFrame:
    """A10: share of all tokens on which each feature is active."""
    return codes.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_active"), F.max("z").alias("max_z")).withColumn("density", F.col("n_active") / F.lit(float(tokens)))


def top_activating(codes: DataFrame, n: int, block: int | None = None) -> DataFrame:
    """T5: the n strongest tokens of each feature, ties by token; with block, only each block's strongest takes part."""
    from pyspark.sql import Window

    rows = codes
    if block:
        w = Window.partitionBy("feature_id", F.floor(F.col("token") / block)).orderBy(F.desc("z"), "token")
        rows = rows.withColumn("first", F.row_number().over(w)).where("first = 1").drop("first")
    w = Window.partitionBy("feature_id").orderBy(F.desc("z"), "token")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def moments(acts: DataFrame) -> DataFrame:
    """(j, mean, var) of each dimension (population variance); tasks return sums, deviations are taken from the mean."""

    def sums(centre):
        def run(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    x = _dense(b.column(0)) - centre
                    v = np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
                    total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["k", "v"])

        return tree_sum(acts.where("h IS NOT NULL").select("h").mapInArrow(run, "k bigint, v array<double>")).get(0)

    if (v := sums(0.0)) is None:
        return acts.sparkSession.createDataFrame([], "j int, mean double, var double")
    d = len(v) // 2
    mean = v[1 : 1 + d] / v[0]
    v = sums(mean)
    off = v[1 : 1 + d] / v[0]
    rows = [(j, float(m + o), float(s / v[0] - o * o)) for j, (m, o, s) in enumerate(zip(mean, off, v[1 + d :], strict=True))]
    return acts.sparkSession.createDataFrame(rows, "j int, mean double, var double")


def projection_quantiles(acts: DataFrame, weights: DataFrame, q: float, few: int = 64, counts: int = 200_000) -> DataFrame:
    """(feature_id, value): the exact q-quantile, by linear interpolation, of each direction's projections; null vectors don't count.

    Projections never leave the task that makes them.  Each direction has two ranks to find, and each rank a bracket of values, at first from
    the least to the greatest.  A pass counts, in every task, the projections in the bins of each bracket; what is added up are the counts,
    `counts` numbers or so, and the bin with the rank is the next bracket.  Once a bracket holds `few` values or none between
    its ends, its values are fetched.  Without vectors there are no rows.
    """
    keys, w = matrix(weights)
    known = acts.where("h IS NOT NULL").select("h")

    def ends(batches):
        lo, hi, n = np.full(len(keys), np.inf), np.full(len(keys), -np.inf), 0
        for b in batches:
            if b.num_rows:
                v = _dense(b.column(0)) @ w.T
                lo, hi, n = np.minimum(lo, v.min(axis=0)), np.maximum(hi, v.max(axis=0)), n + len(v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(lo), pa.array(hi), pa.array(np.full(len(keys), n))], names=["j", "lo", "hi", "n"])

    got = known.mapInArrow(ends, "j bigint, lo double, hi double, n bigint").groupBy("j").agg(F.min("lo"), F.max("hi"), F.sum("n")).orderBy("j").collect()
    spark = acts.sparkSession
    if not got:
        return spark.createDataFrame([], "feature_id bigint, value double")
    n = got[0][3]
    # probes: two ranks a direction, each with its bracket [lo, hi], the number of values below it and in it
    at = (n - 1) * q
    rank = np.tile([int(np.floor(at)), int(np.ceil(at))], len(keys))
    direction = np.repeat(np.arange(len(keys)), 2)
    lo, hi = np.repeat([r[1] for r in got], 2), np.repeat([r[2] for r in got], 2)
    below, inside = np.zeros(len(rank), np.int64), np.full(len(rank), n)
    bins = int(np.clip(counts // len(rank), 16, 1024))
    # rounding may put a value in the bin beside its own, so brackets are a little wider; what is below is counted anew at last
    slack = 4 * np.spacing(np.maximum(np.abs(lo), np.abs(hi)))
    while len(wide := np.flatnonzero((inside > few) & (np.nextafter(lo, np.inf) < hi))):
        d, a, z = direction[wide], lo[wide], hi[wide]

        def bin_counts(batches, d=d, a=a, z=z):
            out = np.zeros(len(d) * bins, np.int64)
            for b in batches:
                if b.num_rows:
                    v = (_dense(b.column(0)) @ w.T)[:, d]
                    bin_ = (v - a) / (z - a) * bins
                    i, j = np.nonzero((v >= a) & (v <= z))
                    out += np.bincount(j * bins + np.clip(bin_[i, j], 0, bins - 1).astype(np.int64), minlength=len(out))
            cell = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(out[cell])], names=["cell", "n"])

        total = known.mapInArrow(bin_counts, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        held = np.zeros(len(d) * bins, np.int64)
        held[total["cell"].to_numpy()] = total["n"].to_numpy()
        upto = below[wide][:, None] + np.cumsum(held.reshape(-1, bins), axis=1)
        k = (upto <= rank[wide][:, None]).sum(axis=1)
        step = (z - a) / bins
        new_lo, new_hi = np.maximum(a, a + k * step - slack[wide]), np.minimum(z, a + (k + 1) * step + slack[wide])
        stuck = (new_lo <= a) & (new_hi >= z)
        below[wide] = np.where(k > 0, upto[np.arange(len(k)), np.maximum(k - 1, 0)], below[wide])
        inside[wide] = np.where(stuck, 0, held.reshape(-1, bins)[np.arange(len(k)), k])
        lo[wide], hi[wide] = new_lo, new_hi

    def last(batches):
        under, values = np.zeros(len(rank), np.int64), {}
        for b in batches:
            if b.num_rows:
                v = (_dense(b.column(0)) @ w.T)[:, direction]
                under += (v < lo).sum(axis=0)
                for j in np.flatnonzero(((v >= lo) & (v <= hi)).any(axis=0)):
                    x, m = np.unique(v[(v[:, j] >= lo[j]) & (v[:, j] <= hi[j]), j], return_counts=True)
                    for one, times in zip(x.tolist(), m.tolist(), strict=True):
                        values[j, one] = values.get((j, one), 0) + times
        rows = [(j, None, int(m)) for j, m in enumerate(under) if m] + [(int(j), x, m) for (j, x), m in values.items()]
        j, x, m = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int64()), pa.array(x, pa.float64()), pa.array(m, pa.int64())], names=["j", "x", "m"])

    found, passed = np.full(len(rank), np.nan), np.zeros(len(rank), np.int64)
    for r in known.mapInArrow(last, "j bigint, x double, m bigint").groupBy("j", "x").agg(F.sum("m").alias("m")).orderBy("j", F.col("x").asc_nulls_first()).collect():
        passed[r["j"]] += r["m"]
        if r["x"] is not None and np.isnan(found[r["j"]]) and passed[r["j"]] > rank[r["j"]]:
            found[r["j"]] = r["x"]
    share = at - np.floor(at)
    return spark.createDataFrame([(int(k), float(a + share * (b - a))) for k, (a, b) in zip(keys, found.reshape(-1, 2), strict=True)], "feature_id bigint, value double")


def matched_null_theta(acts: DataFrame, weights: DataFrame, density: float) -> DataFrame:
    """For each direction the (1 - density) quantile of its projections, so that it fires as rarely."""
    return projection_quantiles(acts, weights, 1 - density).withColumnRenamed("value", "theta")


def unit_norm(vectors: DataFrame, vec: str = "w") -> DataFrame:
    """L2: vectors divided by their norm plus 1e-9, and the norm."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda t, x: t + x * x))
    return vectors.withColumn("norm", norm).withColumn(vec, F.transform(vec, lambda x: x / (F.col("norm") + F.lit(1e-9))))


def cosine_nearest(a: DataFrame, b: DataFrame, signed: bool = False) -> DataFrame:
    """L3 and L4: each vector of a with its nearest of b by (absolute) cosine, ties by id; b is the model that is held."""
    keys, w = matrix(b)
    w = w / (np.linalg.norm(w, axis=1, keepdims=True) + 1e-9)
    step = max(1, 4_000_000 // max(1, len(w)))  # rows whose cosines are held at once

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                h = _dense(batch.column(1))
                h = h / (np.linalg.norm(h, axis=1, keepdims=True) + 1e-9)
                j, best = np.zeros(len(h), np.int64), np.zeros(len(h))
                for at in range(0, len(h), step):
                    c = h[at : at + step] @ w.T
                    c = c if signed else np.abs(c)
                    j[at : at + step] = c.argmax(axis=1)
                    best[at : at + step] = c.max(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[j]), pa.array(best)], names=["feature_id", "nearest", "cosine"])

    return a.select("feature_id", "w").mapInArrow(run, "feature_id bigint, nearest bigint, cosine double")


def projection_magnitude(acts: DataFrame, basis: np.ndarray) -> DataFrame:
    """Norm of each vector's projection onto the basis (dimension, rank)."""

    def run(batches):
        for b in batches:
            v = np.linalg.norm(_dense(b.column(1)) @ basis, axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v)], names=["token", "magnitude"])

    return acts.select("token", "h").mapInArrow(run, f"token {acts.schema['token'].dataType.simpleString()}, magnitude double")


def gram(vectors: DataFrame, vec: str = "w", by: str | None = None) -> dict:
    """{key: (n, sum, X'X)} of the vectors; partitions add up, one d x d matrix a key and task travels, summed as a tree."""

    def run(batches):
        out: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, keys = _dense(b.column(0)), b.column(1).to_numpy()
            for k in np.unique(keys):
                part = x[keys == k]
                v = np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
                out[int(k)] = out[int(k)] + v if int(k) in out else v
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([v.tolist() for v in out.values()], pa.list_(pa.float64()))], names=["k", "v"])

    key = F.col(by).cast("bigint") if by else F.lit(0).cast("bigint")
    total = tree_sum(vectors.where(F.col(vec).isNotNull() & key.isNotNull()).select(vec, key.alias("k")).mapInArrow(run, "k bigint, v array<double>"))
    width = {k: int(round((4 * len(v) - 3) ** 0.5 - 1)) // 2 for k, v in total.items()}  # 1 + d + d * d numbers
    return {k: (int(v[0]), v[1 : 1 + width[k]], v[1 + width[k] :].reshape(width[k], width[k])) for k, v in total.items()}


def subspace_basis(vectors: DataFrame, energy: float = 0.9, most: int = 50) -> np.ndarray:
    """Eigenvectors of the Gram matrix up to the energy, at least one and at most `most`; the vectors stay where they are."""
    found = gram(vectors)
    if not found:
        return np.zeros((0, 0))
    value, basis = np.linalg.eigh(found[0][2])
    value, basis = np.maximum(value[::-1], 0), basis[:, ::-1]
    share = np.cumsum(value) / max(value.sum(), 1e-12)
    return basis[:, : max(1, min(most, int((share < energy).sum()) + 1))]


def subspace_overlap(a: np.ndarray, b: np.ndarray) -> float | None:
    """Squared Frobenius norm of A'B over the smaller rank; none for an empty basis."""
    return float((np.abs(a.T @ b) ** 2).sum() / min(a.shape[1], b.shape[1])) if a.size and b.size else None


def random_basis(width: int, rank: int, seed: int) -> np.ndarray:
    """A random orthonormal basis."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((width, rank)))[0]


def eigen_spectrum(vectors: DataFrame, vec: str = "w", top: int = 50) -> np.ndarray:
    """Largest eigenvalues of the sample covariance."""
    n, s, g = gram(vectors, vec)[0]
    return np.sort(np.linalg.eigvalsh((g - np.outer(s, s) / n) / max(1, n - 1)))[::-1][:top]


def geometric_median(vectors: DataFrame, vec: str = "h", rounds: int = 100, eps: float = 1e-7) -> np.ndarray:
    """Weiszfeld's iteration from the mean; each round is one aggregate over the vectors, which are kept on disk for it."""
    from pyspark import StorageLevel

    held = vectors.where(F.col(vec).isNotNull()).select(vec).persist(StorageLevel.DISK_ONLY)
    n, s, _ = gram(held, vec)[0]
    centre = s / n
    for _ in range(rounds):

        def run(batches, centre=centre):
            v = np.zeros(len(centre) + 1)
            for b in batches:
                if b.num_rows:
                    x = _dense(b.column(0))
                    w = 1 / np.maximum(np.linalg.norm(x - centre, axis=1), 1e-12)
                    v += np.append(w @ x, w.sum())
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["k", "v"])

        total = tree_sum(held.mapInArrow(run, "k bigint, v array<double>"))[0]
        new = total[:-1] / total[-1]
        moved = np.linalg.norm(new - centre)
        centre = new
        if moved < eps:
            break
    held.unpersist()
    return centre
