import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.operators import alignment as A
from helixframe.operators import metrics as M


def one(df, col):
    return df.first()[col]


def test_weighted_median(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 3.0, 10.0), ("z", 1.0, 0.0), ("z", 2.0, 0.0), ("n", None, 1.0)], "g string, v double, w double")
    got = {r.g: r.wmedian for r in stats.weighted_median(d, ["g"], "v", "w").collect()}
    assert got == {"a": 2.0, "b": 3.0, "z": 1.5}  # no weight: the plain, averaged median


def rows(spark, groups):
    return spark.createDataFrame([(g, p, float(i), float(e)) for g, (x, y) in groups.items() for p, (i, e) in enumerate(zip(x, y))], "elem string, pos int, i double, e double")


def test_spearman(spark):
    x = np.arange(50.0)
    d = rows(spark, {"up": (x, x**2), "down": (x, -x), "flat": (x, x * 0), "short": (x[:2], x[:2])})
    got = {r.elem: r.score for r in M.spearman_all(d).collect()}
    assert got["up"] == pytest.approx(1) and got["down"] == pytest.approx(-1) and got["flat"] == 0 and got["short"] == 0


def test_precision_weighted_prefers_the_right_place_and_has_no_scale(spark):
    e = np.zeros(100)
    e[20:26] = 1
    right, wrong = e.copy(), np.roll(e, 40)
    d = rows(spark, {"right": (right, e), "wrong": (wrong, e), "scaled": (right * 7, e), "none": (e * 0, e)})
    got = {r.elem: r.score for r in M.precision_weighted(d).collect()}
    assert got["right"] > 0.8 and got["wrong"] < 0.1 and got["scaled"] == pytest.approx(got["right"]) and got["none"] == 0


def test_metric_registry():
    assert M.get_metric("spearman_all") is M.spearman_all
    with pytest.raises(ValueError):
        M.get_metric("nope")


def test_pvalues_and_qvalues(spark):
    f = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.5), (4, -1.0), (5, None)], "id int, a double")
    n = spark.createDataFrame([(x / 10,) for x in range(10)], "b double")
    p = {r.id: r.p_value for r in stats.empirical_pvalue(f, "a", n, "b").collect()}
    assert p[1] == pytest.approx(2 / 11) and p[2] == p[3] == pytest.approx(6 / 11) and p[4] == 1 and p[5] is None
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0.01, 0.02, 0.02, 0.5, 1.0])] + [(9, None)], "id int, p double")
    bh = {r.id: r.q_value for r in stats.bh_qvalue(d, "p").collect()}
    by = {r.id: r.q_value for r in stats.bh_qvalue(d, "p", dependent=True).collect()}
    assert bh[0] == pytest.approx(0.02 * 5 / 3) and bh[1] == bh[2] == pytest.approx(0.02 * 5 / 3) and bh[4] == 1 and bh[9] is None
    assert all(by[k] >= bh[k] for k in range(5)) and all(0 < v <= 1 for k, v in bh.items() if k < 9)


def test_empty_null_has_no_pvalue(spark):
    f = spark.createDataFrame([(1, 0.9)], "id int, a double")
    n = spark.createDataFrame([], "b double")
    assert one(stats.empirical_pvalue(f, "a", n, "b"), "p_value") is None


def test_classify_and_fraction(spark):
    d = spark.createDataFrame([(0.9,), (0.8,), (0.0,), (-0.5,), (None,)], "A_f double")
    got = [r[0] for r in d.select(A.classify(F.col("A_f"), F.lit(0.3))).collect()]
    assert got == ["causal", "causal", "correlational", "correlational", "inactive"]
    assert one(A.causal_fraction(d, F.lit(0.3)), "causal_fraction") == 0.5


def test_stratified_threshold_needs_twenty(spark):
    nulls = spark.createDataFrame([(float(i % 19), 0.0) for i in range(19)] + [(100.0 + i, 1.0) for i in range(200)], "d double, A_f double")
    f = spark.createDataFrame([(0.0, 0.5), (150.0, 0.5)], "d double, A_f double")
    got = {r.d: r.threshold for r in A.stratified_threshold(f, nulls, "d", bins=2).collect()}
    assert got[150.0] == 1.0 and 0.0 <= got[0.0] <= 1.0


def test_jaccard_of_nothing(spark):
    d = spark.createDataFrame([(1, False, False)], "k int, a boolean, b boolean")
    assert one(A.jaccard(d, "k", "a", "b"), "jaccard") is None


def test_mann_whitney(spark):
    a = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 5.0)], "A_f double")
    b = spark.createDataFrame([(x,) for x in (0.0, 2.0, 3.0)], "A_f double")
    r = A.mann_whitney(a, b).first()
    u = sum(1.0 if x > y else 0.5 if x == y else 0 for x in (1, 2, 2, 5) for y in (0, 2, 3))
    assert r.u_statistic == u and r.prob_greater == pytest.approx(u / 12) and 0 < r.p_value < 1


def test_moving_average_same(spark):
    v = np.random.default_rng(0).random(40)
    d = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "g int, pos int, v double")
    for w in (3, 4, 11):
        got = [r.s for r in stats.moving_average_same(d, ["g"], "pos", "v", w, "s").orderBy("pos").collect()]
        assert np.allclose(got, np.convolve(v, np.ones(w) / w, mode="same"))


def test_rank_correlation_ranks_distinct_pairs(spark, monkeypatch):
    from helixframe.functions import prefix

    seen, plain = [], prefix.average_rank
    monkeypatch.setattr(prefix, "average_rank", lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
    rows = [("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 3.0, 5.0), ("a", 3.0, 4.0), (None, 1.0, 1.0), (None, 2.0, 2.0)] * 5 + [("a", None, 1.0)]
    got = dict(stats.spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect())
    assert seen == [6, 6]
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    for g in ("a", None):
        x, y = (rank([r[i] for r in rows if r[0] == g and r[1] is not None]) for i in (1, 2))
        assert got[g] == pytest.approx(np.corrcoef(x, y)[0, 1])


@pytest.mark.parametrize("times", [None, "n"])
def test_spearman_by_windows_and_by_blocks(spark, monkeypatch, times):
    """Both equal the definition: several blocks and one, a null group, a hot value, ties and zeros of both signs."""
    monkeypatch.setattr(stats.prefix, "CELLS", 30)
    rng = np.random.default_rng(3)
    rows = [(k, float(a) * int(s), float(b), 1) for k, n in (("a", 400), ("b", 60), (None, 80), ("c", 12), ("d", 2)) for a, b, s in zip(rng.integers(0, 50, n) * (rng.random(n) < 0.7), rng.integers(-30, 30, n), rng.choice([1, -1], n))]
    if times:
        rows = [(*r[:3], int(k)) for r, k in zip(rows, rng.integers(1, 4, len(rows)))]
    d = spark.createDataFrame(rows, "g string, x double, y double, n bigint").repartition(4)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    for got in (stats.spearman_windows(d, ["g"], "x", "y", times=times), stats.spearman_blocks(d, ["g"], "x", "y", len(rows), times=times)):
        got = dict(got.collect())
        for k in ("a", "b", None, "c"):
            v = np.array([r[1:3] for r in rows if r[0] == k for _ in range(r[3])])
            assert got[k] == pytest.approx(np.corrcoef(rank(v[:, 0]), rank(v[:, 1]))[0, 1])
        assert times or got["d"] == 0.0
    few = d.where("g = 'c'").drop("g")
    v = np.array([r[1:3] for r in rows if r[0] == "c" for _ in range(r[3])])
    assert stats.spearman_blocks(few, [], "x", "y", 12, times=times).first()[0] == pytest.approx(np.corrcoef(rank(v[:, 0]), rank(v[:, 1]))[0, 1])
