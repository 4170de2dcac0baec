import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import models as M
from helixframe.operators import vectors as V
from helixframe.plans import programs as P


def frame(spark, x, **more):
    return spark.createDataFrame([(i, [float(v) for v in r], *(m[i] for m in more.values())) for i, r in enumerate(x)], "token bigint, h array<double>" + "".join(f", {k} {'double' if k == 'y' else 'bigint'}" for k in more))


def weights(spark, w):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(w)], "feature_id bigint, w array<double>")


def test_topk_ties_and_small_k(spark):
    acts = frame(spark, [[1.0, 1.0, 0.5], [-1.0, -1.0, 2.0]])
    got = {(r.token, r.feature_id) for r in V.encode_topk(acts, weights(spark, np.eye(3)), 1).collect()}
    assert got == {(0, 0), (1, 2)}
    assert V.encode_topk(acts, weights(spark, np.eye(3)), 9).count() == 4


def test_reconstruction_is_exact_with_a_basis(spark):
    x = np.abs(np.random.default_rng(0).random((20, 4)))
    acts, w = frame(spark, x), weights(spark, np.eye(4))
    assert V.fvu(acts, V.decode(V.encode_topk(acts, w, 4), w)).first()[0] == pytest.approx(0, abs=1e-9)


def test_hungarian_equals_brute_force():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 6)):
        c = rng.random((n, m))
        got = M.hungarian(c)
        best = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert len(set(got)) == n and c[np.arange(n), got].sum() == pytest.approx(best)


@pytest.mark.parametrize("n, m, copies", [(40, 40, 1), (23, 41, 1), (41, 23, 1), (60, 60, 4), (50, 33, 3)])
def test_matching_holds_no_matrix_and_equals_brute_force(spark, monkeypatch, n, m, copies):
    """Whole vectors never come to the driver; few partners at a time, small blocks and several parts give the same total."""
    from helixframe.operators import assignment

    for name, value in (("BLOCK", 7), ("PARTNERS", 5), ("PART", 25), ("PIECE", 2)):
        monkeypatch.setattr(assignment, name, value)
    monkeypatch.setattr(V, "matrix", None)
    rng = np.random.default_rng(n)
    x, y = (rng.standard_normal((k // copies + 1, 6)).repeat(copies, 0)[:k] for k in (n, m))
    if copies > 1:
        y[0] = 0.0
    got = sorted(map(tuple, M.match_features(weights(spark, x).repartition(3), weights(spark, y)).collect()))
    unit = lambda w: w / (np.linalg.norm(w, axis=1, keepdims=True) + 1e-9)
    c = unit(x) @ unit(y).T
    assert len({r[0] for r in got}) == len({r[1] for r in got}) == len(got) == min(n, m)
    assert all(c[i, j] == pytest.approx(v, abs=1e-9) for i, j, v in got)
    want = M.hungarian(-c) if n <= m else M.hungarian(-c.T)
    assert sum(r[2] for r in got) == pytest.approx((c if n <= m else c.T)[np.arange(len(want)), want].sum(), abs=1e-9)
    if copies == 1:
        assert [r[:2] for r in got] == sorted((i, int(j)) if n <= m else (int(j), i) for i, j in enumerate(want))
    assert M.match_features(weights(spark, x[:0]), weights(spark, y)).isEmpty()


def test_matching_of_many_kinds_proposes_few_pairs(spark, monkeypatch):
    """What the driver holds of a kind doesn't depend on PARTNERS where kinds are many; the total stays that of all pairs."""
    from helixframe.operators import assignment

    for name, value in (("PAIRS", 10), ("FEWEST", 2), ("STEP", 7)):
        monkeypatch.setattr(assignment, name, value)
    cores, real = [], assignment.Core.solve
    monkeypatch.setattr(assignment.Core, "solve", lambda core: cores.append(len(core.code)) or real(core))
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((60, 6)), rng.standard_normal((60, 6))
    got = M.match_features(weights(spark, x), weights(spark, y)).collect()
    unit = lambda w: w / (np.linalg.norm(w, axis=1, keepdims=True) + 1e-9)
    c = unit(x) @ unit(y).T
    assert {(r.a_id, r.b_id) for r in got} == set(enumerate(M.hungarian(-c)))
    assert cores[0] <= 5 * 60


def test_a_core_takes_little_memory():
    import tracemalloc

    from helixframe.operators import assignment

    n, most, rng = 20_000, assignment.PARTNERS, np.random.default_rng(0)
    i, j, c = np.repeat(np.arange(n), most), rng.integers(0, n, n * most), rng.random(n * most)
    tracemalloc.start()
    core = assignment.Core(np.ones(n, np.int64), np.ones(n, np.int64))
    core.add(i, j, c)
    core._tops()
    core._rise()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * 1350


@pytest.mark.parametrize("n, m", [(700, 700), (699, 700), (700, 699)])
def test_matching_leaves_few_rows_to_single_paths(spark, monkeypatch, n, m):
    """Auctions find nearly all of the matching, also where one side has one more, and their prices need no row's own search."""
    from helixframe.operators import assignment

    searched, real = [], assignment.Core._augment
    monkeypatch.setattr(assignment.Core, "_augment", lambda core, row, *a: searched.append(row) or real(core, row, *a))
    rng = np.random.default_rng(11)
    x, y = rng.standard_normal((n, 8)), rng.standard_normal((m, 8))
    y[:300] = x[:300] + rng.normal(0, 0.05, (300, 8))
    got = M.match_features(weights(spark, x), weights(spark, y)).collect()
    unit = lambda w: w / (np.linalg.norm(w, axis=1, keepdims=True) + 1e-9)
    c = unit(x) @ unit(y).T
    want = {(i, int(j)) for i, j in enumerate(M.hungarian(-c))} if n <= m else {(int(i), j) for j, i in enumerate(M.hungarian(-c.T))}
    assert {(r.a_id, r.b_id) for r in got} == want
    assert len(searched) < 70


def test_pairs_within_single_precision_are_told_apart(spark):
    """Of partners whose cosines differ in the ninth digit the better one is taken."""
    x = np.eye(6)[:3]
    y = np.vstack([x + [0, 0, 0, e, 0, 0] for e in (3e-5, 2e-5, 1e-5, 0.0)])
    got = M.match_features(weights(spark, x), weights(spark, y)).collect()
    unit = lambda w: w / (np.linalg.norm(w, axis=1, keepdims=True) + 1e-9)
    c = unit(x) @ unit(y).T
    assert sorted((r.a_id, r.b_id) for r in got) == [(0, 9), (1, 10), (2, 11)]
    assert all(r.cosine == pytest.approx(c[r.a_id, r.b_id], abs=1e-15) for r in got)


def test_wilcoxon_exact():
    v = [0.6, 0.7, 0.45, 0.9, 0.52]
    d = np.array(v) - 0.5
    rank = np.abs(d).argsort().argsort() + 1
    w = rank[d > 0].sum()
    p = np.mean([sum(r for r, s in zip(rank, signs) if s) >= w for signs in itertools.product((0, 1), repeat=5)])
    assert M.wilcoxon(v) == pytest.approx(p)
    assert M.wilcoxon([0.5]) is None


def naive_folds(x, y, g, alpha):
    out = {}
    for k in np.unique(g):
        t = g == k
        mean, sd = x[~t].mean(0), x[~t].std(0) + 1e-8
        z = (x[~t] - mean) / sd
        w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y[~t] - y[~t].mean()))
        p = np.round((x[t] - mean) / sd @ w, 9)
        r = lambda v: P._rank(v)
        out[k] = np.corrcoef(r(p), r(y[t]))[0, 1]
    return out


def test_grouped_ridge_equals_fitting_each_fold(spark):
    rng = np.random.default_rng(2)
    x, g = rng.random((180, 6)), np.repeat([0, 1, 2, 3, 4, 4], 30)
    y = x @ rng.random(6) + rng.normal(0, 0.3, 180)
    d = spark.createDataFrame([([float(v) for v in a], float(b), int(k)) for a, b, k in zip(x, y, g)], "x array<double>, y double, grp bigint")
    rho, w = M.group_folds(d, lambda n, s, gr: M.ridge(n, s, gr, 10.0))
    want = naive_folds(x, y, g, 10.0)
    assert {r.grp: pytest.approx(r.rho, abs=1e-6) for r in rho.collect()} == want
    assert 0.9 < M.direction_stability(w) <= 1 + 1e-9


def test_folds_of_many_groups_stay_on_the_executors(spark, monkeypatch):
    """All fits from one pass, groups of one row and a group that holds a third of all, without a group's matrix in the driver."""
    rng = np.random.default_rng(5)
    g = np.r_[np.repeat(7, 150), np.repeat(np.arange(100, 130), 10), -np.arange(1, 4)]
    x = rng.random((len(g), 4))
    y = x @ rng.random(4) + rng.normal(0, 0.3, len(g))
    rows = [([float(v) for v in a], float(b), int(k)) for a, b, k in zip(x, y, g)] + [(None, 1.0, 7), ([1.0] * 4, None, 7), ([1.0] * 4, 1.0, None)]
    d = spark.createDataFrame(rows, "x array<double>, y double, grp bigint").repartition(5)
    summed = []
    real = M.V.tree_sum
    monkeypatch.setattr(M.V, "tree_sum", lambda *a, **k: summed.append(real(*a, **k)) or summed[-1])
    rho, w = M.fold_scores(d, {str(a): lambda n, s, gr, a=a: M.ridge(n, s, gr, a) for a in (1.0, 10.0)}, lanes=3)
    for alpha in (1.0, 10.0):
        got = {r.grp: r.rho for r in rho.where(F.col("fit") == str(alpha)).collect()}
        want = naive_folds(x, y, g, alpha)
        assert got.keys() == set(g.tolist())
        assert all(got[k] == (pytest.approx(want[k], abs=1e-6) if k > 0 else 0.0) for k in got)
    assert [list(t) for t in summed] == [[0]] and w.count() == 2 * len(set(g.tolist()))
    scores, _ = M.fold_scores(d.limit(0), {"a": lambda *a: None})
    assert scores.count() == 0


def test_folds_of_few_features_take_one_shuffle_of_rows(spark, monkeypatch):
    """Groups below and above what one task ranks, ties and zeros of both signs; no matrices in Python, no copy of the rows."""
    from helixframe.functions import stats

    monkeypatch.setattr(M.V, "gram", None)
    monkeypatch.setattr(stats.prefix, "CELLS", 40)
    monkeypatch.setattr(stats, "durable", lambda df, real=stats.durable: real(df) if {"_c", "_n"} <= set(df.columns) else pytest.fail("rows written down"))
    rng = np.random.default_rng(8)
    g = np.r_[np.repeat(7, 300), np.repeat(8, 90), np.repeat(np.arange(100, 130), 10), -1]
    x = rng.integers(-2, 3, (len(g), 2)).astype(float) * rng.choice([1.0, -1.0], (len(g), 2))
    y = np.round(x @ [1.0, 0.5] + rng.normal(0, 1, len(g)), 1) * 1.0
    y[::9] = -0.0
    d = spark.createDataFrame([([float(v) for v in a], float(b), int(k)) for a, b, k in zip(x, y, g)], "x array<double>, y double, grp bigint").repartition(5)
    got = {r.grp: r.rho for r in M.fold_scores(d, {"": lambda n, s, gr: M.ridge(n, s, gr, 10.0)})[0].collect()}
    want = naive_folds(x, y, g, 10.0)
    assert got.keys() == want.keys() and got[-1] == 0.0
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got if k > 0)


def test_pls_at_full_rank_is_least_squares():
    rng = np.random.default_rng(3)
    x = rng.random((100, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    v = np.column_stack([x, y])
    w, b = M.pls(100, v.sum(0), v.T @ v, 3)
    assert np.allclose(x @ w + b, y, atol=1e-6)


def test_subspaces(spark):
    a = weights(spark, np.eye(5)[:2])
    assert V.subspace_overlap(V.subspace_basis(a), V.subspace_basis(a)) == pytest.approx(1)
    assert V.subspace_overlap(V.subspace_basis(a), V.subspace_basis(weights(spark, np.eye(5)[3:]))) == pytest.approx(0)
    assert V.subspace_overlap(np.zeros((0, 0)), np.eye(2)) is None


def test_geometric_median_resists_an_outlier(spark):
    m = V.geometric_median(frame(spark, [[0.0, 0.0], [0.1, 0.0], [0.0, 0.1], [100.0, 100.0]]))
    assert np.abs(m).max() < 0.2


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(4)
    d = np.eye(8)
    x = np.array([d[rng.integers(8)] * rng.random() + d[rng.integers(8)] * rng.random() for _ in range(200)])
    got = P.train_and_test(frame(spark, x), 12, 3, 15)
    assert got["last_loss"] < got["first_loss"]


def test_too_large_a_model_is_refused(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST", 3)
    with pytest.raises(ValueError):
        V.matrix(weights(spark, np.eye(2)))


@pytest.mark.parametrize("family", ["topk", "gated", "jumprelu"])
def test_gradients_by_differences(family):
    rng = np.random.default_rng(5)
    x, p = rng.standard_normal((6, 4)), M.encoder_start(family, 7, 4, 1)
    if family == "jumprelu":
        p["b"] = p["b"] + 0.1
    for c in ("r_mag", "b_gate", "b_mag"):
        if c in p:
            p[c] = p[c] + 0.05
    none = np.zeros(7, bool)
    g, _, fired = M.encoder_gradient(family, p, x, 3, none)
    assert fired.shape == (7,)

    def loss(q):
        w = q["w"]
        pre = x @ w.T
        if family == "topk":
            z = np.maximum(pre, 0)
            np.put_along_axis(z, np.argsort(-z, axis=1, kind="stable")[:, 3:], 0.0, axis=1)
            return ((z @ w - x) ** 2).sum()
        if family == "gated":
            gate = pre + q["b_gate"]
            z = np.where(gate > 0, np.maximum(pre * np.exp(q["r_mag"]) + q["b_mag"], 0), 0)
            return ((z @ w - x) ** 2).sum() + M.SPARSITY * np.maximum(gate, 0).sum() + ((np.maximum(gate, 0) @ p["w"] - x) ** 2).sum()
        pi = np.maximum(pre + q["b"], 0)
        return ((np.where(pi > np.exp(q["log_theta"]), pi, 0) @ w - x) ** 2).sum()

    for c in p:
        if c == "log_theta":
            continue  # the step has no slope of its own
        for i in np.ndindex(p[c].shape):
            up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
            up[c][i] += 1e-6
            down[c][i] -= 1e-6
            assert (loss(up) - loss(down)) / 2e-6 == pytest.approx(g[c][i], abs=1e-3)


@pytest.mark.parametrize("family", ["topk", "gated", "jumprelu"])
def test_every_family_trains(spark, family):
    x = np.abs(np.random.default_rng(6).standard_normal((120, 6)))
    _, _, losses = M.train(frame(spark, x), 9, 3, 12, family)
    assert losses[-1] < losses[0]
    with pytest.raises(ValueError):
        M.encoder_start("other", 2, 2)


def test_network_holds_few_rows_of_its_layers():
    import tracemalloc

    import numpy as np

    from helixframe.operators import models as M

    rng = np.random.default_rng(0)
    x = rng.standard_normal((60_000, 8))
    y = np.maximum(x[:, 0], 0) - x[:, 1]
    tracemalloc.start()
    p = M.mlp_fit_predict(x[:-9000], y[:-9000], x[-9000:], rounds=30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(p) == 9000 and np.corrcoef(p, y[-9000:])[0, 1] > 0.9
    assert peak < 30e6  # a layer of all rows alone is 26 MB, and there were five
