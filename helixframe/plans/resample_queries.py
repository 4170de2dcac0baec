"""Driver queries of the resampling operators, all draws from the integer generator."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import alignment as A
from helixframe.operators import resample as R
from helixframe.plans import programs as P
from helixframe.plans.align_queries import _LOCI, _P, _THR, _features_sql, _q_sql
from helixframe.plans.registry import query
from helixframe.sources import tables as T

_BOOT = f"""WITH {_LOCI}, rows_ AS (SELECT feature_id, a_f AS v, mass AS w, row_number() OVER (PARTITION BY feature_id ORDER BY locus) - 1 AS slot, count(*) OVER (PARTITION BY feature_id) AS n FROM rl),
dr AS (SELECT feature_id, rep, CAST(floor(CAST({T.lcg('rep', 'slot', 'feature_id')} AS DOUBLE) * n) AS INT) AS slot FROM rows_, range(50) t(rep) WHERE n > 1),
pk AS (SELECT feature_id, rep, v, sum(w) AS w FROM dr JOIN rows_ USING (feature_id, slot) GROUP BY ALL),
cu AS (SELECT *, sum(w) OVER (PARTITION BY feature_id, rep ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY feature_id, rep) AS tot FROM pk),
md AS (SELECT feature_id, rep, min(v) FILTER (cum >= tot / 2) AS m FROM cu GROUP BY ALL)"""


@query(f"{_BOOT} SELECT feature_id, round(quantile_cont(m, 0.025) + 1e-12, 8) AS lo, round(quantile_cont(m, 0.975) + 1e-12, 8) AS hi, round(stddev_samp(m), 8) AS se FROM md GROUP BY 1")
def bootstrap_ci(spark, sf_dir):
    out = R.bootstrap_ci(A.collapse_to_loci(T.align(spark, sf_dir)), "feature_id", "locus", "a_f", "mass", 50)
    return out.withColumns({"lo": F.round(F.col("lo") + 1e-12, 8), "hi": F.round(F.col("hi") + 1e-12, 8), "se": F.round("se", 8)})


@query(f"""{_BOOT}, {_features_sql('rf', 'rl')}, se AS (SELECT feature_id, stddev_samp(m) AS se FROM md GROUP BY 1)
SELECT feature_id, A_f, round(CASE WHEN n_active >= 3 AND se > 1e-9 THEN A_f / se END, 5) AS t FROM rf LEFT JOIN se USING (feature_id)""")
def studentised(spark, sf_dir):
    return P.calibration(T.align(spark, sf_dir), 50).select("feature_id", "A_f", F.round("t", 5).alias("t"))


@query(f"""{_BOOT}, {_features_sql('rf', 'rl')}, {_features_sql('nf', 'nl')}, {_THR}, {_P}, {_q_sql('qv', 'pv')}, ci AS (SELECT feature_id, quantile_cont(m, 0.025) AS lo FROM md GROUP BY 1)
SELECT feature_id, A_f, round(q, 9) AS q_value, round(lo + 1e-12, 8) AS lo, coalesce(round(lo, 9) > round(t, 9), false) AS ci_robust, coalesce(q < 0.9 AND round(lo, 9) > round(t, 9), false) AS high_confidence FROM qv LEFT JOIN ci USING (feature_id), thr""")
def high_confidence(spark, sf_dir):
    """P12 and G6 with 50 replicates and a wide q, as these tables hold no signal."""
    out = P.high_confidence(T.align(spark, sf_dir, "R"), T.align(spark, sf_dir, "N"), 0.9, 50)
    return out.select("feature_id", "A_f", F.round("q_value", 9).alias("q_value"), F.round(F.col("lo") + 1e-12, 8).alias("lo"), "ci_robust", "high_confidence")


def _loci(spark, sf_dir):
    a = A.collapse_to_loci(T.align(spark, sf_dir))
    return a, a.select("locus").distinct()


_SUB = f"""WITH {_LOCI}, lo AS (SELECT DISTINCT locus FROM rl), pk AS (SELECT locus, rep, row_number() OVER (PARTITION BY rep ORDER BY {T.lcg('rep', 'locus')}, locus) AS i FROM lo, range(30) t(rep)),
sz AS (SELECT * FROM (VALUES (4), (8), (12), (16), (21)) t(size)), a AS (SELECT size, rep, feature_id, a_f AS v, mass AS w FROM pk JOIN sz ON i <= size JOIN rl USING (locus)),
c AS (SELECT size, rep, feature_id, v, sum(w) AS w FROM a GROUP BY ALL), k AS (SELECT *, sum(w) OVER (PARTITION BY size, rep, feature_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY size, rep, feature_id) AS tot FROM c),
m AS (SELECT size, rep, feature_id, min(v) FILTER (cum >= tot / 2) AS m FROM k GROUP BY ALL), e AS (SELECT size, rep, avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM m GROUP BY ALL)"""


@query(f"{_SUB} SELECT size, round(avg(share), 6) AS mean_share, round(min(share), 6) AS least, round(max(share), 6) AS most FROM e GROUP BY 1")
def subsample_curve(spark, sf_dir):
    out = R.subsample_curve(*_loci(spark, sf_dir), [4, 8, 12, 16, 21], 30)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_share", "least", "most")})


def _medians_sql(name: str, source: str, by: str) -> str:
    """Weighted medians m of (by, v, w) rows."""
    return f"""{name}_c AS (SELECT {by}, v, sum(w) AS w FROM {source} GROUP BY ALL), {name}_k AS (SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY {by}) AS tot FROM {name}_c),
{name} AS (SELECT {by}, min(v) FILTER (cum >= tot / 2) AS m FROM {name}_k GROUP BY ALL)"""


_HALVES = f"""lo AS (SELECT DISTINCT locus FROM rl), gr AS (SELECT locus, rep, CAST(floor(2 * (row_number() OVER (PARTITION BY rep ORDER BY {T.lcg('rep', 'locus')}, locus) - 1) / (count(*) OVER (PARTITION BY rep))::DOUBLE) AS INT) AS half FROM lo, range(200) t(rep))"""


@query(f"""WITH {_LOCI}, {_HALVES}, rw AS (SELECT rep, half, feature_id, a_f AS v, mass AS w FROM rl JOIN gr USING (locus)), {_medians_sql('md', 'rw', 'rep, half, feature_id')},
f AS (SELECT rep, feature_id, bool_or(m > 0 AND half = 0) AS x, bool_or(m > 0 AND half = 1) AS y FROM md GROUP BY ALL), j AS (SELECT rep, count(*) FILTER (x AND y) AS i, count(*) FILTER (x OR y) AS u FROM f GROUP BY 1)
SELECT round(avg(i / u::DOUBLE), 6) AS mean, round(stddev_pop(i / u::DOUBLE), 6) AS sd, count(*) AS splits FROM j WHERE u > 0""")
def noise_ceiling(spark, sf_dir):
    return R.split_half(*_loci(spark, sf_dir), 200).select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "splits")


_DESIGN = f"""WITH {_LOCI}, gr AS (SELECT * FROM (SELECT locus, rep, (row_number() OVER (PARTITION BY rep ORDER BY {T.lcg('rep', 'locus')}, locus) - 1) // (count(*) OVER (PARTITION BY rep) // 2) AS half FROM (SELECT DISTINCT locus FROM rl), range(200) t(rep)) WHERE half < 2),
rw AS (SELECT run, rep, half, feature_id, a_f AS v, mass AS w FROM (SELECT 0 AS run, * FROM rl UNION ALL SELECT 1, * FROM ol UNION ALL SELECT 2, * FROM nl) JOIN gr USING (locus)), {_medians_sql('md', 'rw', 'run, rep, half, feature_id')},
nn AS (SELECT rep, half, count(*) AS n FROM md WHERE run = 2 GROUP BY ALL),
ge AS (SELECT run, rep, half, feature_id, m, coalesce(sum(CAST(run = 2 AS INT)) OVER (PARTITION BY rep, half ORDER BY m DESC RANGE UNBOUNDED PRECEDING), 0) AS k FROM md),
pv AS (SELECT run, rep, half, feature_id, m, (1.0::DOUBLE + k) / (1 + n) AS p FROM ge JOIN nn USING (rep, half) WHERE run < 2),
rk AS (SELECT *, p * count(*) OVER g / row_number() OVER (PARTITION BY run, rep, half ORDER BY p, feature_id) AS raw, row_number() OVER (PARTITION BY run, rep, half ORDER BY p, feature_id) AS j FROM pv WINDOW g AS (PARTITION BY run, rep, half)),
qv AS (SELECT *, round(least(min(raw) OVER (PARTITION BY run, rep, half ORDER BY j DESC ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE), 9) < 0.9 AS hit FROM rk),
ce AS (SELECT * FROM (VALUES ('data', 0, 1), ('run', 1, 0), ('both', 1, 1)) t(cell, run, half)),
mt AS (SELECT coalesce(x.cell, y.cell) AS cell, coalesce(x.rep, y.rep) AS rep, coalesce(x.hit, false) AS x, coalesce(y.hit, false) AS y, x.m AS ax, y.m AS ay
       FROM (SELECT cell, rep, feature_id, hit, m FROM qv, ce WHERE qv.run = 0 AND qv.half = 0) x FULL JOIN (SELECT cell, rep, feature_id, hit, m FROM qv JOIN ce USING (run, half)) y ON x.cell = y.cell AND x.rep = y.rep AND x.feature_id = y.feature_id),
ja AS (SELECT cell, rep, count(*) FILTER (x AND y) AS i, count(*) FILTER (x OR y) AS u FROM mt GROUP BY ALL),
rs AS (SELECT cell, rep, rank() OVER (PARTITION BY cell, rep ORDER BY ax) + (count(*) OVER (PARTITION BY cell, rep, ax) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY cell, rep ORDER BY ay) + (count(*) OVER (PARTITION BY cell, rep, ay) - 1) / 2.0::DOUBLE AS ry FROM mt WHERE ax IS NOT NULL AND ay IS NOT NULL),
rh AS (SELECT cell, rep, CASE WHEN count(*) < 3 OR var_pop(rx) = 0 OR var_pop(ry) = 0 THEN 0.0::DOUBLE ELSE corr(rx, ry) END AS rho FROM rs GROUP BY ALL)
SELECT cell, round(avg(i / u::DOUBLE) FILTER (u > 0), 6) AS mean_jaccard, round(stddev_pop(i / u::DOUBLE) FILTER (u > 0), 6) AS sd_jaccard, round(avg(rho), 6) AS mean_rho, count(*) FILTER (u > 0) AS splits FROM ja LEFT JOIN rh USING (cell, rep) GROUP BY 1"""


@query(_DESIGN)
def split_design(spark, sf_dir):
    """R7 and G17 with the survey's 200 splits and a wide q, as these tables hold no signal."""
    first, second, null = (A.collapse_to_loci(T.align(spark, sf_dir, f)) for f in "RAN")
    return R.split_design(first, second, null, 200, 0.9).select("cell", *[F.round(c, 6).alias(c) for c in ("mean_jaccard", "sd_jaccard", "mean_rho")], "splits")


@query(f"""WITH {_LOCI}, {_features_sql('rf', 'rl')}, {_features_sql('of', 'ol')}, pr AS (SELECT feature_id - 1 AS pair_id, rf.A_f > 0 AS a, of.A_f > 0 AS b FROM rf JOIN of USING (feature_id)),
dr AS (SELECT rep, CAST(floor(CAST({T.lcg('rep', 'pair_id')} AS DOUBLE) * (SELECT count(*) FROM pr)) AS BIGINT) AS pair_id FROM pr, range(2000) t(rep)),
j AS (SELECT rep, count(*) FILTER (a AND b) AS i, count(*) FILTER (a OR b) AS u FROM dr JOIN pr USING (pair_id) GROUP BY 1)
SELECT round(quantile_cont(i / u::DOUBLE, 0.025), 6) AS lo, round(quantile_cont(i / u::DOUBLE, 0.975), 6) AS hi FROM j WHERE u > 0""")
def jaccard_bootstrap(spark, sf_dir):
    a = A.aggregate_features(A.collapse_to_loci(T.align(spark, sf_dir, "R"))).select("feature_id", (F.col("A_f") > 0).alias("a_hit"))
    b = A.aggregate_features(A.collapse_to_loci(T.align(spark, sf_dir, "A"))).select("feature_id", (F.col("A_f") > 0).alias("b_hit"))
    pairs = a.join(b, "feature_id").withColumn("pair_id", F.col("feature_id") - 1)
    return R.pair_bootstrap(pairs, 2000).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_ZERO = f"SELECT f, c AS coverage, round((CAST({T.lcg('f', 'k', 'c')} AS DOUBLE) - 0.5) * 0.1, 9) AS v FROM range(500) a(f), (VALUES (4), (8), (16), (21)) b(c), range(1, 22) d(k) WHERE k <= c"


@query(f"WITH d AS ({_ZERO}), m AS (SELECT coverage, f, v AS m FROM (SELECT *, row_number() OVER (PARTITION BY coverage, f ORDER BY v) AS i FROM d) WHERE i = (coverage + 1) // 2) SELECT coverage, round(stddev_samp(m), 7) AS sd_A, avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_positive FROM m GROUP BY 1")
def zero_signal_sim(spark, sf_dir):
    return R.zero_signal(spark, 500, [4, 8, 16, 21])


_POWER = f"""WITH d AS (SELECT effect, n, rep, round(CAST({T.lcg('rep', 'k', 'n')} AS DOUBLE) - 0.5 + effect, 9) AS v FROM range(150) a(rep), (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) b(effect), (VALUES (4), (16), (64)) c(n), range(1, 65) e(k) WHERE k <= n),
m AS (SELECT effect, n, rep, avg(v) AS m FROM d GROUP BY ALL) SELECT effect, n, avg(CASE WHEN m > 1.645 / sqrt(12.0 * n) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS power FROM m GROUP BY ALL"""


@query(_POWER)
def power_curve(spark, sf_dir):
    return R.power_curve(spark, [0.0, 0.1, 0.2], [4, 16, 64], 150)


@query(f"SELECT effect, min(n) FILTER (power >= 0.8) AS least_n FROM ({_POWER}) GROUP BY 1")
def power_least_n(spark, sf_dir):
    return R.smallest_reaching(R.power_curve(spark, [0.0, 0.1, 0.2], [4, 16, 64], 150), "effect", "n", "power")


def _survivors_sql(name: str, part: str) -> str:
    p = f"{name}p AS (SELECT rf.feature_id, (1.0::DOUBLE + (SELECT count(*) FROM {part} n WHERE n.A_f >= rf.A_f)) / (1 + (SELECT count(*) FROM {part})) AS p FROM rf)"
    return f"{p}, {_q_sql(name, name + 'p')}"


@query(f"""WITH {_LOCI}, {_features_sql('rf', 'rl')}, {_features_sql('nf', 'nl')}, nt AS (SELECT * FROM nf WHERE {T.lcg('feature_id')} < 0.1), {_survivors_sql('qt', 'nt')}, {_survivors_sql('qa', 'nf')}
SELECT 'tenth' AS "null", count(*) FILTER (q < 0.5) AS survivors FROM qt UNION ALL SELECT 'all', count(*) FILTER (q < 0.5) FROM qa""")
def null_size_sweep(spark, sf_dir):
    """Survivors at q < 0.5 against a tenth of the null and all of it, in one plan."""
    from helixframe.functions import stats

    real, null = (A.aggregate_features(A.collapse_to_loci(T.align(spark, sf_dir, f))) for f in "RN")
    out = []
    for name, part in (("tenth", null.where(F.expr(f"{T.lcg('feature_id')} < 0.1"))), ("all", null)):
        q = stats.bh_qvalue(stats.empirical_pvalue(real.select("feature_id", "A_f"), "A_f", part, "A_f"), "p_value")
        out.append(q.agg(F.lit(name).alias("null"), F.count_if(F.col("q_value") < 0.5).alias("survivors")))
    return out[0].unionByName(out[1])
