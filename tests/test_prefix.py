"""Scans in two levels against the definition, with blocks so small that groups span many."""

import random
import time

import pytest
from pyspark.sql import functions as F

from helixframe.functions import prefix, stats


def made(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.randint(0, 30) / 4, rng.gauss(0, 5), -0.0, None, float("inf"), float("-inf")])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("cells", [1, 7, 10_000])
def test_average_rank(spark, cells):
    rows, df = made(spark)
    got = prefix.average_rank(df, ["g"], "v", "r", cells_a_block=cells).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [v for g, v in rows if g == r.g and v is not None]
        want = None if r.v is None else sum(v < r.v for v in own) + (sum(v == r.v for v in own) + 1) / 2
        assert r.r == want


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("cells", [1, 5, 10_000])
def test_running(spark, by, down, cells):
    rng = random.Random(4)
    rows = sorted({(rng.choice("ab") if by else "a", rng.randint(0, 60) / 2) for _ in range(90)})
    df = prefix.blocked(spark.createDataFrame([(g, v, i * 7 % 11) for i, (g, v) in enumerate(rows)], "g string, v double, n int"), "v", cells)
    n = {(g, v): i * 7 % 11 for i, (g, v) in enumerate(rows)}
    if cells == 1:
        assert df.select(prefix.BLOCK).distinct().count() > 10
    got = prefix.running(prefix.running(df, by, "v", "n", "s", descending=down), by, "v", "n", "m", how="min", descending=down).collect()
    assert len(got) == len(rows)
    for r in got:
        upto = [x for (g, v), x in n.items() if g == r.g and (v >= r.v if down else v <= r.v)]
        assert (r.s, r.m) == (sum(upto), min(upto))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert prefix.average_rank(none, ["g"], "v", "r").count() == 0
    assert stats.bh_qvalue(none, "v").count() == 0
    nulls = spark.createDataFrame([("a", None)], "g string, v double")
    assert prefix.average_rank(nulls, ["g"], "v", "r").first().r is None and stats.bh_qvalue(nulls, "v").first().q_value is None


@pytest.mark.parametrize("dependent", [False, True])
@pytest.mark.parametrize("n", [10, 64, 65, 300])
def test_qvalues(spark, monkeypatch, dependent, n):
    monkeypatch.setattr(prefix, "CELLS", 20)
    monkeypatch.setattr(prefix.blocked, "__defaults__", (20,))
    rng = random.Random(n)
    p = [round(rng.random() ** 3, 2) for _ in range(n)]
    got = {r.p: r.q_value for r in stats.bh_qvalue(spark.createDataFrame([(x,) for x in p], "p double"), "p", dependent=dependent).collect()}
    scale = sum(1 / i for i in range(1, n + 1)) if dependent else 1
    ranked = sorted(p)
    for x in set(p):
        assert got[x] == pytest.approx(min(1, min(y * n * scale / (i + 1) for i, y in enumerate(ranked) if y >= x)), abs=1e-12)


def test_no_task_holds_all_of_a_hot_group(spark):
    """One element holds all rows: its cells are scanned in several tasks, and no window is without a partition."""
    df = spark.range(0, 120_000, numPartitions=4).select(F.lit("hot").alias("g"), F.xxhash64("id").cast("double").alias("v"))
    ranked = prefix.average_rank(df, ["g"], "v", "r", cells_a_block=5000)
    assert ranked.agg(F.sum("r"), F.max("r")).first() == (120_000 * 120_001 / 2, 120_000)
    cells = df.groupBy("g", F.col("v").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    blocks = prefix.blocked(cells, "_c", 5000).groupBy(prefix.BLOCK).count()
    assert blocks.count() >= 20 and blocks.agg(F.max("count")).first()[0] < 8000
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window [sum(_n" in plan and "windowspecdefinition(_c" not in plan


def test_dependent_costs_no_more_than_twice(spark):
    """All p distinct: the harmonic number is one value."""
    df = spark.range(0, 100_000, numPartitions=4).select((F.xxhash64("id") / 2.0**64 + 0.5).alias("p"))
    took = {}
    for dependent in (False, False, True):
        began = time.perf_counter()
        stats.bh_qvalue(df, "p", dependent=dependent).write.format("noop").mode("overwrite").save()
        took[dependent] = time.perf_counter() - began
    assert took[True] < 2 * took[False] + 2


def test_last_at_or_before(spark):
    points = spark.createDataFrame([(x,) for x in [None, -1, 0, 3, 4, 4, 9, 100]], "t bigint")
    marks = spark.createDataFrame([(0,), (4,), (9,), (None,)], "m bigint")
    got = sorted(((r.t, r.last) for r in prefix.last_at_or_before(points, marks, "t", "m", "last", 2).collect()), key=str)
    assert got == sorted([(None, None), (-1, None), (0, 0), (3, 0), (4, 4), (4, 4), (9, 9), (100, 9)], key=str)
    assert prefix.last_at_or_before(points, marks.limit(0), "t", "m", "last").where("last IS NOT NULL").count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 500, 998, 999, 1000, 5000])
def test_least_rows(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([-(1 << 63), (1 << 63) - 1, rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(-5, 5)]), rng.randint(0, 40)) for _ in range(999)]
    df = spark.createDataFrame([*rows, (None, 1), (3, None)], "d bigint, k int")
    for most in (3, 20_000):
        if most == 3 and 0 < n < 999:
            rows_, most_ = [(i * 977 % 65536 - 30000 + (i << 40), 0) for i in range(999)], 3
            got = prefix.least_rows(spark.createDataFrame(rows_, "d bigint, k int"), "d", "k", n, most_).collect()
            assert sorted(map(tuple, got)) == sorted(rows_)[:n]
        else:
            got = prefix.least_rows(df, "d", "k", n, 20_000).collect()
            assert sorted(map(tuple, got)) == sorted(rows)[:n]


def test_draws_that_are_none(spark):
    with pytest.raises(ValueError, match="more than 5 rows"):
        prefix.least_rows(spark.range(10).select(F.lit(7).cast("bigint").alias("d"), "id"), "d", "id", 3, most=5)


@pytest.mark.parametrize("parts", [1, 7])
def test_batches_are_exact_and_don_t_hang_on_partitions(spark, parts):
    from helixframe.sources import genome

    df = spark.range(0, 103, numPartitions=parts)
    by_epoch = [{r.id: r.batch for r in genome.batches(df, "id", 10, e).collect()} for e in (0, 1)]
    for got in by_epoch:
        assert sorted(__import__("collections").Counter(got.values()).items()) == [(b, 10) for b in range(10)] + [(10, 3)]
    assert by_epoch[0] != by_epoch[1]
    assert by_epoch[0] == {r.id: r.batch for r in genome.batches(df.repartition(3), "id", 10, 0).collect()}
    assert genome.sample_exact(df, "id", 40).count() == 40


@pytest.mark.parametrize("q", [0.0, 0.25, 0.9, 1.0])
def test_projection_quantiles(spark, q):
    """Exact for ties, clusters far apart, constants and few vectors, and no task x direction rows in any plan."""
    import numpy as np

    from helixframe.operators import vectors as V

    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3))
    x[:, 0] = np.where(rng.random(700) < 0.5, 0.0, 1e6)
    x[:, 1] = np.round(x[:, 1], 1)
    w = np.vstack([np.eye(3), rng.normal(size=(4, 3)), np.zeros(3)])
    acts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "token bigint, h array<double>").repartition(5)
    dirs = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(w)], "feature_id bigint, w array<double>")
    for few, counts in ((2, 500), (64, 200_000)):
        got = {r.feature_id: r.value for r in V.projection_quantiles(acts, dirs, q, few, counts).collect()}
        for i, v in enumerate(w):
            assert got[i * 10] == pytest.approx(np.quantile(x @ v, q), abs=1e-9)
    assert V.projection_quantiles(acts.limit(0), dirs, q).count() == 0


def test_token_positions(spark):
    from helixframe.operators import sequence

    corpus = spark.createDataFrame([(5, "ACG"), (2, "A"), (3, ""), (4, None), (9, "TTTT")], "seq_id bigint, seq string")
    tokens = spark.createDataFrame([(t,) for t in [None, -1, 0, 1, 3, 3, 4, 7, 8]], "token bigint")
    got = sorted(((r.token, r.seq_id, r.pos) for r in sequence.token_positions(tokens, corpus).collect()), key=str)
    assert got == sorted([(None, None, None), (-1, None, None), (0, 2, 0), (1, 5, 0), (3, 5, 2), (3, 5, 2), (4, 9, 0), (7, 9, 3), (8, None, None)], key=str)


def test_jaccard_by_q(spark):
    from helixframe.operators import alignment

    a, b = {1: 0.1, 2: 0.2, 3: None, 4: 0.3}, {1: 0.2, 2: 0.1, 3: 0.1, 5: 0.3}
    frame = lambda d: spark.createDataFrame(list(d.items()), "feature_id int, q_value double")
    got = {r.q: (r.n_both, r.n_either) for r in alignment.jaccard_by_q(frame(a), frame(b)).collect()}
    for q in (0.1, 0.2, 0.3):
        sets = [{k for k, v in d.items() if v is not None and v <= q} for d in (a, b)]
        assert got[q] == (len(sets[0] & sets[1]), len(sets[0] | sets[1]))
