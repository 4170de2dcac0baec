"""Grouped probes, assignment, signed-rank test and encoder training: small algebra on the driver over distributed sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.durable import durable
from helixframe.functions import prefix, stats
from helixframe.operators import vectors as V


def ridge(n: int, s: np.ndarray, g: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """M11 from sums of (x, y): standardised by population sd + 1e-8, y centred; weights on raw x and the intercept."""
    mean, d = s / n, len(s) - 1
    cov = g / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:d], 0)) + 1e-8
    xx, xy = cov[:d, :d] / np.outer(sd, sd), cov[:d, d] / sd
    w = np.linalg.solve(n * xx + alpha * np.eye(d), n * xy) / sd
    return w, float(mean[d] - w @ mean[:d])


def pls(n: int, s: np.ndarray, g: np.ndarray, rank: int) -> tuple[np.ndarray, float]:
    """M12 from the same sums: partial least squares with one response, by deflating the covariances."""
    mean, d = s / n, len(s) - 1
    cov = g / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:d], 0)) + 1e-8
    a, b = cov[:d, :d] / np.outer(sd, sd), cov[:d, d] / sd
    basis, left = [], b.copy()
    for _ in range(min(rank, d)):
        if np.linalg.norm(left) < 1e-12:
            break
        w = left / np.linalg.norm(left)
        for v in basis:
            w = w - v * (v @ a @ w)
        t = w @ a @ w
        if t < 1e-12:
            break
        w = w / np.sqrt(t)
        basis.append(w)
        left = left - a @ w * (w @ left)
    coef = (sum(v * (v @ b) for v in basis) if basis else np.zeros(d)) / sd
    return coef, float(mean[d] - coef @ mean[:d])


#: Up to so many features a group's sums are columns, which Spark adds up; beyond, matrices that tasks add up.
NARROW = 3


def fold_scores(probe: DataFrame, fits: dict, x: str = "x", y: str = "y", group: str = "grp", lanes: int = 16) -> tuple[DataFrame, DataFrame]:
    """(grp, fit, rho) of leave-one-group-out predictions by Spearman, and the folds' weights (grp, fit, w).

    fits names functions of a fold's row count, sums and Gram matrix, all fitted in one pass: a fold's are the total, which the
    driver knows, less the group's.  A group's sums stay on the executors, which fit its fold.  Weights meet the rows by a join on the
    group.  Groups of bounded size are predicted and ranked by one task each after one shuffle; larger ones are few, so their weights
    go to the rows, and several tasks rank such a group.  Values are centred by the grand mean first.  Null groups, features and responses
    don't count.
    """
    spark = probe.sparkSession
    known = probe.where(F.col(group).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    first = known.select(F.size(x)).first()
    if first is None:
        return spark.createDataFrame([], f"{group} bigint, fit string, rho double"), spark.createDataFrame([], f"{group} bigint, fit string, w array<double>")
    narrow, names = first[0] <= NARROW, list(fits)
    if narrow:
        vs = [*(F.get(F.col(x), F.lit(i)).cast("double") for i in range(first[0])), F.col(y).cast("double")]
        both = known.select(F.col(group).cast("bigint").alias("k"), *[v.alias(f"v{i}") for i, v in enumerate(vs)]).dropna()
        sums, total, mean = _narrow_sums(both, len(vs))
    else:
        both = known.select(F.col(group).cast("bigint").alias("k"), F.concat(x, F.array(F.col(y))).alias("v"))
        sums, total, mean = _wide_sums(both, lanes)
    if total is None:
        return spark.createDataFrame([], f"{group} bigint, fit string, rho double"), spark.createDataFrame([], f"{group} bigint, fit string, w array<double>")
    d = len(mean)

    def fitted(batches):
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = v.values.to_numpy(zero_copy_only=False)[: len(total)]
                rest = total - own
                if rest[0] >= 0.5:
                    out += [(k, i, int(round(own[0])), w.tolist(), float(b)) for i, (w, b) in enumerate(fit(int(round(rest[0])), rest[1 : 1 + d], rest[1 + d :].reshape(d, d)) for fit in fits.values())]
            k, i, n, w, b = zip(*out, strict=True) if out else ((),) * 5
            columns = [pa.array(k, pa.int64()), pa.array(i, pa.int32()), pa.array(n, pa.int64()), pa.array(w, pa.list_(pa.float64())), pa.array(b, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_g", "_fit", "_rows", "w", "b"])

    table = durable(sums.mapInArrow(fitted, "_g bigint, _fit int, _rows bigint, w array<double>, b double"))
    sizes = table.where("_fit = 0").agg(F.count_if(F.col("_rows") <= prefix.CELLS), F.sum(F.when(F.col("_rows") > prefix.CELLS, F.col("_rows"))))
    small, large = sizes.first()
    over = F.col("_rows") > prefix.CELLS

    def predicted(rows: DataFrame, folds: DataFrame) -> DataFrame:
        folds = folds.select("_g", "_fit", "w", "b")
        if narrow:
            guess = F.col("b")
            for i in range(d - 1):
                guess = guess + (F.col(f"v{i}") - F.lit(float(mean[i]))) * F.col("w")[i]
            # so that rounding of sums makes no difference between equal predictions
            guess, at = F.rint(guess * 1e9), F.col(f"v{d - 1}")
        else:
            centred = F.zip_with("v", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b)
            rows = rows.select("k", centred.alias("v"))
            guess = F.aggregate(F.zip_with(F.slice("v", 1, d - 1), "w", lambda a, b: a * b), F.col("b"), lambda t, v: t + v)
            guess, at = F.round(guess, 9), F.element_at("v", -1)
        return rows.join(folds, F.col("k") == F.col("_g")).select("_g", "_fit", guess.alias("_p"), at.alias("_y")).where("_p IS NOT NULL AND _y IS NOT NULL")

    parts, by = [], ["_g", "_fit"]
    if small:
        folds = table.where(~over)
        folds = F.broadcast(folds) if small * len(names) * d <= stats.FEW else folds.hint("shuffle_hash")
        rows = both.join(F.broadcast(table.where(over & (F.col("_fit") == 0)).select("_g")), F.col("k") == F.col("_g"), "left_anti") if large else both
        parts.append(stats.spearman_windows(predicted(rows, folds), by, "_p", "_y"))
    if large:  # a group for each CELLS rows at most
        parts.append(stats.spearman_blocks(predicted(both, F.broadcast(table.where(over))), by, "_p", "_y", large * len(names)))
    named = F.element_at(F.array(*[F.lit(name) for name in names]), F.col("_fit") + 1).alias("fit")
    if not parts:
        parts.append(spark.createDataFrame([], "_g bigint, _fit int, rho double"))
    rho = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rho.select(F.col("_g").alias(group), named, "rho"), table.select(F.col("_g").alias(group), named, "w")


def _narrow_sums(both: DataFrame, d: int) -> tuple[DataFrame, np.ndarray | None, np.ndarray]:
    """(k, v): rows, sums and Gram matrix of each group of (k, v0, v1, ...), centred; the same of all rows; the centre."""
    known = both.agg(*[F.avg(f"v{i}") for i in range(d)]).first()
    if known[0] is None:
        return both, None, np.zeros(0)
    mean = np.array(known, float)
    c = [F.col(f"v{i}") - F.lit(float(m)) for i, m in enumerate(mean)]
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(c)], *[F.sum(c[i] * c[j]).alias(f"g{i}_{j}") for i, j in upper]]
    found = durable(both.groupBy("k").agg(*sums))
    laid = ["n", *[f"s{i}" for i in range(d)], *[f"g{min(i, j)}_{max(i, j)}" for i in range(d) for j in range(d)]]
    total = found.agg(*[F.sum(name).alias(f"_{i}") for i, name in enumerate(laid)]).first()
    return found.select("k", F.array(*laid).alias("v")), np.array(total, float), mean


def _wide_sums(both: DataFrame, lanes: int) -> tuple[DataFrame, np.ndarray | None, np.ndarray]:
    """_narrow_sums of (k, v): tasks add up what they have of a group's matrix, lanes of tasks are added up next, and then the lanes."""
    whole = V.gram(both, "v").get(0)
    if whole is None:
        return both, None, np.zeros(0)
    n, s, g = whole
    mean = s / n
    # sums of centred values
    total = np.concatenate([[n], np.zeros(len(s)), (g - n * np.outer(mean, mean)).ravel()])

    def parts(batches):
        for b in batches:
            if b.num_rows:
                v, keys = V._dense(b.column(1)) - mean, b.column(0).to_numpy()
                order = np.argsort(keys, kind="stable")
                found, begin = np.unique(keys[order], return_index=True)
                rows = [np.concatenate([[len(p)], p.sum(axis=0), (p.T @ p).ravel()]).tolist() for p in np.split(v[order], begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["k", "v"])

    def added(batches):
        """Sums of runs of equal keys, which come one after the other."""
        key, held = None, None
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                if k == key:
                    held = held + v
                else:
                    if held is not None:
                        yield key, held
                    key, held = k, v
        if held is not None:
            yield key, held

    def run_sums(batches):
        for k, v in added(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["k", "v"])

    laid = both.mapInArrow(parts, "k bigint, v array<double>").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    for key in (["k", "lane"], ["k"]):
        laid = laid.repartition(*key).sortWithinPartitions("k").select("k", "v").mapInArrow(run_sums, "k bigint, v array<double>")
    return laid, total, mean


def group_folds(probe: DataFrame, fit, x: str = "x", y: str = "y", group: str = "grp", most: int = 50_000_000) -> tuple[DataFrame, np.ndarray]:
    """fold_scores of one fit: (grp, rho), and the folds' weights (fold, dimension) in the driver, whose number is checked."""
    rho, w = fold_scores(probe, {"": fit}, x, y, group)
    if (size := w.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]) > most:
        raise ValueError(f"{size} weights; take fold_scores, which leaves them where they are")
    return rho.drop("fit"), np.array([r["w"] for r in w.orderBy(group).collect()])


def mean_scores(probe: DataFrame, fits: dict) -> dict[str, float | None]:
    """The folds' mean correlation of each fit; all in one pass."""
    got = dict(fold_scores(probe, fits)[0].groupBy("fit").agg(F.avg("rho")).collect())
    return {name: got.get(name) for name in fits}


def direction_stability(w: np.ndarray) -> float | None:
    """Mean absolute cosine of the folds' weights, pair by pair."""
    if len(w) < 2:
        return None
    u = w / (np.linalg.norm(w, axis=1, keepdims=True) + 1e-12)
    c = np.abs(u @ u.T)
    return float(c[np.triu_indices(len(u), 1)].mean())


#: Rows of a network's batch whose layers are held at once; gradients of all rows are added up.
ROWS = 4096


def mlp_fit_predict(x: np.ndarray, y: np.ndarray, test: np.ndarray, hidden: int = 64, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """One ReLU layer on standardised inputs, full-batch Adam; hidden layers exist for `ROWS` rows at a time."""
    rng, mean, sd = np.random.default_rng(seed), x.mean(axis=0), x.std(axis=0) + 1e-8
    x, test, centre = x - mean, (test - mean) / sd, y.mean()
    x /= sd
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v = [0 * a for a in p], [0 * a for a in p]
    for t in range(1, rounds + 1):
        grad = [1e-4 * p[0], 0 * p[1], 1e-4 * p[2], 0 * p[3]]
        for at in range(0, len(y), ROWS):
            part = x[at : at + ROWS]
            z = part @ p[0] + p[1]
            a = np.maximum(z, 0)
            e = (a @ p[2] + p[3] - (y[at : at + ROWS] - centre)) / len(y)
            back = np.outer(e, p[2]) * (z > 0)
            for g, d in zip(grad, (part.T @ back, back.sum(axis=0), a.T @ e, e.sum()), strict=True):
                g += d
        for i, g in enumerate(grad):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return np.concatenate([np.zeros(0), *(np.maximum(test[at : at + ROWS] @ p[0] + p[1], 0) @ p[2] + p[3] + centre for at in range(0, len(test), ROWS))])


def mlp_folds(probe: DataFrame, most: int = 200_000) -> DataFrame:
    """M13 under M14: (grp, rho); each fold is fitted by a task over a checked, bounded table."""
    rows = probe.select("grp", "x", "y").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a network in memory")
    g, x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    spark = probe.sparkSession
    data = spark.sparkContext.broadcast((g, x, y))

    def run(folds):
        import pandas as pd

        gg, xx, yy = data.value
        for f in folds:
            for k in f["grp"]:
                t = gg == k
                yield pd.DataFrame({"grp": int(k), "p": np.round(mlp_fit_predict(xx[~t], yy[~t], xx[t]), 9), "y": yy[t]})

    folds = spark.createDataFrame([(int(k),) for k in np.unique(g)], "grp bigint").repartition(max(1, len(np.unique(g))))
    return stats.spearman(folds.mapInPandas(run, "grp bigint, p double, y double"), ["grp"], "p", "y", "rho")


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least cost, by shortest augmenting paths; rows are no more than columns."""
    rows, cols = cost.shape
    u, v, match = np.zeros(rows + 1), np.zeros(cols + 1), np.full(cols + 1, -1)
    for r in range(rows):
        match[cols], free = r, cols
        reach, came, done = np.full(cols, np.inf), np.full(cols, cols), np.zeros(cols + 1, bool)
        while match[free] >= 0:
            done[free] = True
            i = match[free]
            slack = np.where(done[:cols], np.inf, cost[i] - u[i] - v[:cols])
            closer = slack < reach
            reach[closer], came[closer] = slack[closer], free
            open_reach = np.where(done[:cols], np.inf, reach)
            j = int(open_reach.argmin())
            delta = open_reach[j]
            u[match[done]] += delta
            v[np.flatnonzero(done)] -= delta
            reach[~done[:cols]] -= delta
            free = j
        while free != cols:
            match[free], free = match[came[free]], came[free]
    out = np.full(rows, -1)
    for j in range(cols):
        if match[j] >= 0:
            out[match[j]] = j
    return out


def match_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """L5 on signed cosine: (a_id, b_id, cosine), one to one, of greatest total cosine; no matrix of all pairs exists."""
    from helixframe.operators import assignment

    return assignment.match(a, b)


def wilcoxon(values, centre: float = 0.5) -> float | None:
    """One-sided signed-rank p that values exceed the centre, zeros dropped; exact without ties up to 50, else by the normal law."""
    from math import erfc, sqrt

    d = np.array([v - centre for v in values if v is not None and v != centre])
    n = len(d)
    if not n:
        return None
    order = np.abs(d)
    rank = np.array([(order < x).sum() + ((order == x).sum() + 1) / 2 for x in order])
    w = rank[d > 0].sum()
    if n <= 50 and len(np.unique(order)) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        return float(ways[int(w) :].sum() / 2.0**n)
    ties = sum(t**3 - t for t in np.unique(order, return_counts=True)[1])
    return float(erfc((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2)) / 2)


#: Weights of the sparsity and auxiliary losses, width of the step's kernel.
SPARSITY, AUXILIARY, KERNEL = 1e-3, 1 / 32, 1e-2


def encoder_start(family: str, width: int, d: int, seed: int = 0) -> dict[str, np.ndarray]:
    """M6: random unit directions (feature, dimension) that encode and decode, and what the family has besides."""
    w = np.random.default_rng(seed).standard_normal((width, d))
    p = {"w": w / np.linalg.norm(w, axis=1, keepdims=True)}
    if family == "gated":
        return p | {"r_mag": np.zeros(width), "b_gate": np.zeros(width), "b_mag": np.zeros(width)}
    if family == "jumprelu":
        return p | {"b": np.zeros(width), "log_theta": np.full(width, np.log(1e-2))}
    if family == "topk":
        return p
    raise ValueError(f"unknown family {family!r}")


def encoder_gradient(family: str, p: dict[str, np.ndarray], x: np.ndarray, k: int, dead: np.ndarray) -> tuple[dict[str, np.ndarray], float, np.ndarray]:
    """Gradients of the family's loss summed over the rows of x, the summed squared residual, and how often each feature fired.

    topk (M7): residual, plus what the k strongest dead features leave of it.  gated (M8): residual, L1 of the open gates and the
    residual of the gates alone through a frozen decoder.  jumprelu (M9): residual and L0, the step's slope by a box kernel.
    """
    w = p["w"]
    pre = x @ w.T
    g = {n: np.zeros_like(v) for n, v in p.items()}
    if family == "topk":
        z = np.maximum(pre, 0)
        np.put_along_axis(z, np.argsort(-z, axis=1, kind="stable")[:, k:], 0.0, axis=1)
        e = z @ w - x
        g["w"] = 2 * (z.T @ e + ((e @ w.T) * (z > 0)).T @ x)
        if dead.any():
            q = np.where(dead, np.maximum(pre, 0), 0)
            np.put_along_axis(q, np.argsort(-q, axis=1, kind="stable")[:, k:], 0.0, axis=1)
            left = q @ w + e
            g["w"] += 2 * AUXILIARY * (q.T @ left + ((left @ w.T) * (q > 0)).T @ x)
    elif family == "gated":
        gate, scale = pre + p["b_gate"], np.exp(p["r_mag"])
        mag = pre * scale + p["b_mag"]
        z = np.where(gate > 0, np.maximum(mag, 0), 0)
        e = z @ w - x
        d_mag = 2 * (e @ w.T) * (z > 0)
        open_gate = np.maximum(gate, 0)
        d_gate = (SPARSITY + 2 * ((open_gate @ w - x) @ w.T)) * (gate > 0)
        g |= {"r_mag": (d_mag * pre * scale).sum(axis=0), "b_mag": d_mag.sum(axis=0), "b_gate": d_gate.sum(axis=0), "w": 2 * z.T @ e + (d_mag * scale + d_gate).T @ x}
    else:
        pi, theta = np.maximum(pre + p["b"], 0), np.exp(p["log_theta"])
        z = np.where(pi > theta, pi, 0)
        e = z @ w - x
        d_z = 2 * (e @ w.T)
        d_pi = d_z * (z > 0)
        box = (np.abs((pi - theta) / KERNEL) < 0.5) / KERNEL
        g |= {"b": d_pi.sum(axis=0), "log_theta": (-(d_z * theta + SPARSITY) * box).sum(axis=0) * theta, "w": 2 * z.T @ e + d_pi.T @ x}
    return g, float((e * e).sum()), (z > 0).sum(axis=0)


def train(acts: DataFrame, width: int, k: int = 16, epochs: int = 3, family: str = "topk", rate: float = 3e-3, seed: int = 0, batch: int = 256, idle: int = 20_000) -> tuple[dict[str, np.ndarray], np.ndarray, list[float]]:
    """An encoder's parameters, the bias taken off its input, and the mean squared residual by epoch.

    A step of Adam for every `batch` rows, unit directions after each; a feature that hasn't fired for `idle` tokens is dead.
    Every partition makes an epoch's steps on its own rows from common parameters, and at the epoch's end parameters and
    moments are averaged by rows: numbers of the size of the model travel once an epoch, and rows stay where they are.  With one
    partition this is plain mini-batch training.  Rows come in another order in each epoch.  The bias is the geometric
    median of the activations.
    """
    import pyarrow as pa
    from pyspark import StorageLevel

    held = acts.where("h IS NOT NULL").select("h").persist(StorageLevel.DISK_ONLY)
    b = V.geometric_median(held, rounds=20)
    p = encoder_start(family, width, len(b), seed)
    names, shapes = list(p), {n: x.shape for n, x in p.items()}
    m, v = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))
    quiet, steps, losses = np.zeros(width), 0.0, []
    for epoch in range(epochs):
        shared = acts.sparkSession.sparkContext.broadcast((p, m, v, quiet, steps))

        def run(batches, shared=shared):
            now, first, second, since, t = shared.value
            now, first, second = ({c: x.copy() for c, x in d.items()} for d in (now, first, second))
            since, loss, n = since.copy(), 0.0, 0
            for part in batches:
                rows = V._dense(part.column(0)) - b if part.num_rows else np.zeros((0, len(b)))
                for at in range(0, len(rows), batch):
                    x = rows[at : at + batch]
                    g, e, fired = encoder_gradient(family, now, x, k, since > idle)
                    loss, n, t = loss + e, n + len(x), t + 1
                    since = np.where(fired > 0, 0, since + len(x))
                    for c in names:
                        d = g[c] / len(x)
                        first[c], second[c] = 0.9 * first[c] + 0.1 * d, 0.999 * second[c] + 0.001 * d * d
                        now[c] = now[c] - rate * (first[c] / (1 - 0.9**t)) / (np.sqrt(second[c] / (1 - 0.999**t)) + 1e-8)
                    now["w"] = now["w"] / (np.linalg.norm(now["w"], axis=1, keepdims=True) + 1e-9)
            if n:
                flat = np.concatenate([*(d[c].ravel() for d in (now, first, second) for c in names), since, [t]]) * n
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([[*flat.tolist(), loss, n]], pa.list_(pa.float64()))], names=["k", "v"])

        order = held.sortWithinPartitions(F.xxhash64("h", F.lit(epoch)))
        got = V.tree_sum(order.mapInArrow(run, "k bigint, v array<double>"))
        if not got:
            break
        total = got[0]
        losses.append(float(total[-2] / total[-1]))
        mean, at = total[:-2] / total[-1], 0
        for d in (p, m, v):
            for c in names:
                size = int(np.prod(shapes[c]))
                d[c] = mean[at : at + size].reshape(shapes[c])
                at += size
        p["w"] = p["w"] / (np.linalg.norm(p["w"], axis=1, keepdims=True) + 1e-9)
        quiet, steps = mean[at:-1], float(round(mean[-1]))
    held.unpersist()
    return p, b, losses


def codes_of(family: str, p: dict[str, np.ndarray], bias: np.ndarray, k: int):
    """M7-M9 of a trained encoder as a function of a matrix of hidden rows."""
    w = p["w"]

    def z(h: np.ndarray) -> np.ndarray:
        pre = (h - bias) @ w.T
        if family == "gated":
            return np.where(pre + p["b_gate"] > 0, np.maximum(np.exp(p["r_mag"]) * pre + p["b_mag"], 0), 0)
        if family == "jumprelu":
            pi = np.maximum(pre + p["b"], 0)
            return np.where(pi > np.exp(p["log_theta"]), pi, 0)
        out = np.maximum(pre, 0)
        if k < out.shape[1]:
            np.put_along_axis(out, np.argsort(-out, axis=1, kind="stable")[:, k:], 0.0, axis=1)
        return out

    return z


def train_topk(acts: DataFrame, width: int, k: int, epochs: int = 3, rate: float = 3e-3, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """M10 for the top-k family: directions, bias, losses."""
    p, b, losses = train(acts, width, k, epochs, "topk", rate, seed)
    return p["w"], b, losses
