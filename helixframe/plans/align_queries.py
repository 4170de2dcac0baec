"""Driver queries over the alignment view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.operators import alignment as A
from helixframe.plans.registry import query
from helixframe.sources import tables as T

_LOCI = f"""real AS ({T.align_sql('R')}), nul AS ({T.align_sql('N')}), other AS ({T.align_sql('A')}),
rl AS (SELECT feature_id, locus, round(avg(a_f) + 1e-12, 9) AS a_f, avg(mass) AS mass FROM real GROUP BY ALL),
nl AS (SELECT feature_id, locus, round(avg(a_f) + 1e-12, 9) AS a_f, avg(mass) AS mass FROM nul GROUP BY ALL),
ol AS (SELECT feature_id, locus, round(avg(a_f) + 1e-12, 9) AS a_f, avg(mass) AS mass FROM other GROUP BY ALL)"""


def _features_sql(name: str, source: str) -> str:
    return f"""{name}_c AS (SELECT feature_id, a_f AS v, sum(mass) AS w, count(*) AS n FROM {source} GROUP BY ALL),
{name}_k AS (SELECT *, sum(w) OVER (PARTITION BY feature_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY feature_id) AS tot FROM {name}_c),
{name}_m AS (SELECT feature_id, min(v) FILTER (cum >= tot / 2) AS A_f FROM {name}_k GROUP BY 1),
{name} AS (SELECT feature_id, A_f, n_active, mean_mass FROM {name}_m JOIN (SELECT feature_id, count(*) AS n_active, avg(mass) AS mean_mass FROM {source} GROUP BY 1) USING (feature_id))"""


_FEATURES = f"WITH {_LOCI},\n{_features_sql('rf', 'rl')},\n{_features_sql('nf', 'nl')}"
_THR = "thr AS (SELECT coalesce(quantile_cont(A_f, 0.95), 0.0) AS t FROM nf)"
_P = "pv AS (SELECT rf.*, (1.0::DOUBLE + (SELECT count(*) FROM nf WHERE nf.A_f >= rf.A_f)) / (1 + (SELECT count(*) FROM nf)) AS p FROM rf)"


def _q_sql(name: str, source: str, p: str = "p", factor: str = "1.0::DOUBLE") -> str:
    return f"""{name} AS (SELECT *, least(greatest(min(raw) OVER (ORDER BY j DESC ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE), 1.0::DOUBLE) AS q
  FROM (SELECT *, {p} * count(*) OVER () / row_number() OVER (ORDER BY {p}, feature_id) * {factor} AS raw, row_number() OVER (ORDER BY {p}, feature_id) AS j FROM {source}))"""


def _real(spark, sf):
    return A.collapse_to_loci(T.align(spark, sf, "R"))


def _pair(spark, sf):
    return A.aggregate_features(_real(spark, sf)), A.aggregate_features(A.collapse_to_loci(T.align(spark, sf, "N")))


@query(f"""{_FEATURES}, {_THR}, {_P}, {_q_sql('qv', 'pv')}
SELECT feature_id, A_f, n_active, round(mean_mass, 6) AS mean_mass, p AS p_value, round(q, 9) AS q_value, round(t, 9) AS threshold, CASE WHEN A_f > t THEN 'causal' ELSE 'correlational' END AS label FROM qv, thr""")
def causal_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.causal_test(T.align(spark, sf_dir, "R"), T.align(spark, sf_dir, "N"))
    return out.withColumns({"mean_mass": F.round("mean_mass", 6), "q_value": F.round("q_value", 9), "threshold": F.round("threshold", 9)})


@query(f"WITH {_LOCI} SELECT feature_id, locus, a_f, round(mass, 6) AS mass FROM rl")
def collapse_to_loci(spark, sf_dir):
    return _real(spark, sf_dir).withColumn("mass", F.round("mass", 6))


@query(f"WITH {_LOCI}, {_features_sql('rf', 'real')} SELECT feature_id, A_f FROM rf")
def weighted_median(spark, sf_dir):
    return stats.weighted_median(T.align(spark, sf_dir), ["feature_id"], "a_f", "mass", "A_f")


@query(f"{_FEATURES} SELECT feature_id, A_f, n_active, round(mean_mass, 6) AS mean_mass FROM rf WHERE n_active >= 5 ORDER BY A_f DESC, feature_id")
def aggregate_features(spark, sf_dir):
    return A.aggregate_features(_real(spark, sf_dir), 5).withColumn("mean_mass", F.round("mean_mass", 6)).orderBy(F.desc("A_f"), "feature_id")


@query(f"{_FEATURES}, {_THR} SELECT round(t, 9) AS threshold FROM thr")
def null_threshold(spark, sf_dir):
    return stats.percentile_of(_pair(spark, sf_dir)[1], "A_f", 0.95).select(F.round("threshold", 9).alias("threshold"))


@query(f"{_FEATURES}, {_THR} SELECT f.feature_id, CASE WHEN A_f IS NULL THEN 'inactive' WHEN A_f > t THEN 'causal' ELSE 'correlational' END AS label FROM (SELECT DISTINCT feature_id FROM (SELECT feature_id FROM rl UNION ALL SELECT feature_id FROM nl)) f LEFT JOIN (SELECT * FROM rf WHERE n_active >= 15) rf USING (feature_id), thr")
def classify(spark, sf_dir):
    real, null = _pair(spark, sf_dir)
    every = real.select("feature_id").union(null.select("feature_id")).distinct()
    t = stats.percentile_of(null, "A_f", 0.95)
    return every.join(real.where("n_active >= 15"), "feature_id", "left").crossJoin(F.broadcast(t)).select("feature_id", A.classify(F.col("A_f"), F.col("threshold")).alias("label"))


@query(f"{_FEATURES}, {_THR} SELECT avg(CASE WHEN A_f > t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS causal_fraction FROM rf, thr")
def causal_fraction(spark, sf_dir):
    real, null = _pair(spark, sf_dir)
    return A.causal_fraction(real.crossJoin(F.broadcast(stats.percentile_of(null, "A_f", 0.95))), F.col("threshold"))


@query(f"{_FEATURES}, {_P} SELECT feature_id, A_f, p AS p_value FROM pv")
def empirical_pvalue(spark, sf_dir):
    real, null = _pair(spark, sf_dir)
    return stats.empirical_pvalue(real.select("feature_id", "A_f"), "A_f", null, "A_f")


_MIRROR = "mv AS (SELECT rf.*, (1.0::DOUBLE + (SELECT count(*) FROM nf WHERE nf.A_f <= rf.A_f)) / (1 + (SELECT count(*) FROM nf)) AS p FROM rf)"


@query(f"{_FEATURES}, {_MIRROR} SELECT feature_id, A_f, p AS p_value FROM mv")
def mirror_pvalue(spark, sf_dir):
    real, null = _pair(spark, sf_dir)
    return stats.empirical_pvalue(real.select("feature_id", "A_f"), "A_f", null, "A_f", upper=False)


def _q(spark, sf_dir, upper=True, dependent=False):
    real, null = _pair(spark, sf_dir)
    return stats.bh_qvalue(stats.empirical_pvalue(real.select("feature_id", "A_f"), "A_f", null, "A_f", upper), "p_value", dependent=dependent)


@query(f"{_FEATURES}, {_P}, {_q_sql('qv', 'pv')} SELECT feature_id, p AS p_value, round(q, 9) AS q_value FROM qv")
def bh_qvalue(spark, sf_dir):
    return _q(spark, sf_dir).select("feature_id", "p_value", F.round("q_value", 9).alias("q_value"))


@query(f"{_FEATURES}, {_P}, {_q_sql('qv', 'pv', factor='(SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) FROM pv) + 1) t(i))')} SELECT feature_id, p AS p_value, round(q, 9) AS q_value FROM qv")
def by_qvalue(spark, sf_dir):
    return _q(spark, sf_dir, dependent=True).select("feature_id", "p_value", F.round("q_value", 9).alias("q_value"))


@query(f"""{_FEATURES}, {_features_sql('of', 'ol')}, {_P}, po AS (SELECT of.*, (1.0::DOUBLE + (SELECT count(*) FROM nf WHERE nf.A_f >= of.A_f)) / (1 + (SELECT count(*) FROM nf)) AS p FROM of),
{_q_sql('qa', 'pv')}, {_q_sql('qb', 'po')}, j AS (SELECT round(qa.q, 9) AS x, round(qb.q, 9) AS y FROM qa FULL JOIN qb USING (feature_id)),
t AS (SELECT x AS q FROM j WHERE x IS NOT NULL UNION SELECT y FROM j WHERE y IS NOT NULL)
SELECT q, count(*) FILTER (x <= q AND y <= q) AS n_both, count(*) FILTER (x <= q OR y <= q) AS n_either, count(*) FILTER (x <= q AND y <= q) / count(*) FILTER (x <= q OR y <= q)::DOUBLE AS jaccard FROM t, j GROUP BY q""")
def jaccard_by_q(spark, sf_dir):
    real, null = _pair(spark, sf_dir)
    other = A.aggregate_features(A.collapse_to_loci(T.align(spark, sf_dir, "A")))
    q = lambda f: stats.bh_qvalue(stats.empirical_pvalue(f.select("feature_id", "A_f"), "A_f", null, "A_f"), "p_value").withColumn("q_value", F.round("q_value", 9))
    return A.jaccard_by_q(q(real), q(other))


@query(f"{_FEATURES}, {_P}, {_MIRROR}, {_q_sql('qu', 'pv')}, {_q_sql('ql', 'mv')} SELECT (SELECT count(*) FROM qu WHERE q < 0.5) AS n_upper, (SELECT count(*) FROM ql WHERE q < 0.5) AS n_lower")
def mirror_fdr(spark, sf_dir):
    up = _q(spark, sf_dir).agg(F.count_if(F.col("q_value") < 0.5).alias("n_upper"))
    return up.crossJoin(_q(spark, sf_dir, upper=False).agg(F.count_if(F.col("q_value") < 0.5).alias("n_lower")))


@query(f"{_FEATURES}, t AS (SELECT quantile_cont(A_f, 0.95) AS hi, quantile_cont(A_f, 0.05) AS lo FROM nf) SELECT avg(CAST(A_f > hi AS INT)) AS upper, avg(CAST(A_f < lo AS INT)) AS lower, round(avg(CAST(A_f > hi AS INT)) - avg(CAST(A_f < lo AS INT)), 9) AS difference FROM rf, t")
def tail_symmetry(spark, sf_dir):
    return A.tail_symmetry(*_pair(spark, sf_dir)).withColumn("difference", F.round("difference", 9))


@query(f"""{_FEATURES}, u AS (SELECT sum(CASE WHEN rf.A_f > nf.A_f THEN 1.0::DOUBLE WHEN rf.A_f = nf.A_f THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS u, (SELECT count(*) FROM rf) AS n1, (SELECT count(*) FROM nf) AS n0 FROM rf, nf)
SELECT u AS u_statistic, u / (n1 * n0) AS prob_greater FROM u""")
def mann_whitney_u(spark, sf_dir):
    return A.mann_whitney(*_pair(spark, sf_dir)).drop("p_value")


@query(f"""{_FEATURES}, c AS (SELECT A_f AS v, sum(x) AS x, sum(y) AS y FROM (SELECT A_f, 1 AS x, 0 AS y FROM rf UNION ALL SELECT A_f, 0, 1 FROM nf) GROUP BY 1),
u AS (SELECT *, x * (coalesce(sum(y) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + y / 2.0::DOUBLE) AS u FROM c),
s AS (SELECT sum(u) AS u, CAST(sum(x) AS DOUBLE) AS a, CAST(sum(y) AS DOUBLE) AS b, sum(pow(x + y, 3.0) - (x + y)) AS ties FROM u),
z AS (SELECT (u - a * b / 2 - 0.5) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) AS z FROM s), k AS (SELECT z, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
w AS (SELECT z, exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS p FROM k)
SELECT round(CASE WHEN z >= 0 THEN p ELSE 1 - p END, 6) AS p_value FROM w""")
def mann_whitney_p(spark, sf_dir):
    return A.mann_whitney(*_pair(spark, sf_dir)).select(F.round("p_value", 6).alias("p_value"))


@query(f"""WITH {_LOCI}, r AS (SELECT locus, mass > 25 AS y, rank() OVER (PARTITION BY locus ORDER BY a_f) + (count(*) OVER (PARTITION BY locus, a_f) - 1) / 2.0::DOUBLE AS k FROM real)
SELECT locus, round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 9) AS auroc FROM r GROUP BY 1""")
def auroc_rank(spark, sf_dir):
    a = T.align(spark, sf_dir).withColumn("y", F.col("mass") > 25)
    return stats.auroc(a, ["locus"], "a_f", "y").withColumn("auroc", F.round("auroc", 9))


@query(f"""{_FEATURES}, e AS (SELECT quantile_cont(mean_mass, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS ed, quantile_cont(A_f, 0.95) AS allt FROM nf),
nb AS (SELECT len(list_filter(ed, lambda x: round(x, 6) <= round(mean_mass, 6))) AS bin, A_f FROM nf, e), own AS (SELECT bin, quantile_cont(A_f, 0.95) AS own, count(*) AS n FROM nb GROUP BY 1)
SELECT feature_id, bin, round(CASE WHEN n >= 20 THEN own ELSE allt END, 9) AS threshold FROM (SELECT feature_id, len(list_filter(ed, lambda x: round(x, 6) <= round(mean_mass, 6))) AS bin, allt FROM rf, e) LEFT JOIN own USING (bin)""")
def stratified_threshold(spark, sf_dir):
    real, null = _pair(spark, sf_dir)
    out = A.stratified_threshold(real.withColumn("mean_mass", F.round("mean_mass", 6)), null.withColumn("mean_mass", F.round("mean_mass", 6)), "mean_mass")
    return out.select("feature_id", F.col("bin").cast("bigint").alias("bin"), F.round("threshold", 9).alias("threshold"))


@query(f"""{_FEATURES}, {_THR} SELECT bin, count(*) AS n, round(stddev_samp(A_f), 7) AS sd, avg(CASE WHEN A_f > t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS upper
FROM (SELECT *, CASE WHEN n_active <= 8 THEN '1-8' WHEN n_active <= 12 THEN '9-12' WHEN n_active <= 16 THEN '13-16' WHEN n_active <= 19 THEN '17-19' ELSE '20+' END AS bin FROM rf), thr GROUP BY 1 HAVING count(*) >= 20""")
def coverage_bins(spark, sf_dir):
    real, null = _pair(spark, sf_dir)
    return A.coverage_bins(real.crossJoin(F.broadcast(stats.percentile_of(null, "A_f", 0.95))), "n_active", F.col("threshold")).withColumn("sd", F.round("sd", 7))


@query(f"WITH {_LOCI} SELECT feature_id, elem_id, a_f, rank FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY a_f DESC, elem_id) AS rank FROM real) WHERE rank <= 3")
def top_drivers(spark, sf_dir):
    return A.top_drivers(T.align(spark, sf_dir)).select("feature_id", "elem_id", "a_f", "rank")


@query(f"""{_FEATURES}, {_THR} SELECT s_nationkey, count(*) AS n, round(median(A_f), 9) AS median_A, avg(CASE WHEN A_f > t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS above FROM rf JOIN supplier ON s_suppkey = feature_id, thr GROUP BY 1""")
def class_breakdown(spark, sf_dir):
    real, null = _pair(spark, sf_dir)
    t = F.broadcast(stats.percentile_of(null, "A_f", 0.95))
    j = real.join(T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("feature_id"), "s_nationkey"), "feature_id").crossJoin(t)
    return j.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("A_f", F.lit(0.5)), 9).alias("median_A"), F.avg((F.col("A_f") > F.col("threshold")).cast("double")).alias("above"))


_HITS = f"{_FEATURES}, {_features_sql('of', 'ol')}, {_THR}"


def _hits(spark, sf_dir):
    real, null = _pair(spark, sf_dir)
    other = A.aggregate_features(A.collapse_to_loci(T.align(spark, sf_dir, "A")))
    t = F.broadcast(stats.percentile_of(null, "A_f", 0.95))
    above = lambda d: d.crossJoin(t).select("feature_id", "A_f", (F.col("A_f") > F.col("threshold")).alias("hit"))
    return above(real), above(other)


@query(f"""{_HITS}, a AS (SELECT feature_id FROM rf, thr WHERE A_f > t), b AS (SELECT feature_id FROM of, thr WHERE A_f > t)
SELECT n_both, n_either, CASE WHEN n_either > 0 THEN n_both::DOUBLE / n_either END AS jaccard FROM (SELECT (SELECT count(*) FROM a JOIN b USING (feature_id)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_either)""")
def jaccard_sets(spark, sf_dir):
    a, b = _hits(spark, sf_dir)
    j = a.where("hit").select("feature_id", F.lit(True).alias("x")).join(b.where("hit").select("feature_id", F.lit(True).alias("y")), "feature_id", "full")
    return A.jaccard(j.fillna(False, ["x", "y"]), "feature_id", "x", "y")


@query(f"""{_HITS} SELECT avg(CASE WHEN coalesce(of.A_f, -9) > t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS reproduced FROM rf LEFT JOIN of USING (feature_id), thr WHERE rf.A_f > t""")
def seed_reproduced(spark, sf_dir):
    a, b = _hits(spark, sf_dir)
    own = a.select("feature_id").distinct().join(b.select("feature_id", "hit"), "feature_id", "left").fillna(False, ["hit"])
    return A.seed_reproduced(a.select("feature_id", F.lit(0).alias("seed"), "hit").unionByName(own.select("feature_id", F.lit(1).alias("seed"), "hit")))


@query(f"""{_HITS}, s AS (SELECT feature_id, A_f AS a FROM rf UNION ALL SELECT feature_id, A_f FROM of)
SELECT feature_id, count(*) AS n_seeds, round(abs(stddev_pop(a) / avg(a)), 6) AS cv FROM s GROUP BY 1 HAVING count(*) >= 2 AND abs(avg(a)) > 1e-9""")
def seed_cv(spark, sf_dir):
    a, b = _hits(spark, sf_dir)
    return A.seed_cv(a.select("feature_id", F.lit(0).alias("seed"), F.col("A_f").alias("a")).unionByName(b.select("feature_id", F.lit(1), F.col("A_f").alias("a")).toDF("feature_id", "seed", "a"))).withColumn("cv", F.round("cv", 6))


@query(f"WITH {_LOCI} SELECT locus, avg(CASE WHEN a_f > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS positive FROM rl GROUP BY 1")
def per_locus_positive_fraction(spark, sf_dir):
    return _real(spark, sf_dir).groupBy("locus").agg(F.avg((F.col("a_f") > 0).cast("double")).alias("positive"))


@query(f"{_FEATURES} SELECT rf.feature_id, A_f, s_name FROM rf LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = feature_id")
def annotation_left_join(spark, sf_dir):
    notes = T.read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("feature_id"), "s_name")
    return _pair(spark, sf_dir)[0].select("feature_id", "A_f").join(notes, "feature_id", "left")


@query(f"{_HITS} SELECT feature_id, A_f FROM rf WHERE feature_id NOT IN (SELECT feature_id FROM rf, thr WHERE A_f > t)")
def noncausal_pool(spark, sf_dir):
    a, _ = _hits(spark, sf_dir)
    return a.select("feature_id", "A_f").join(a.where("hit").select("feature_id"), "feature_id", "left_anti")


@query(f"WITH {_LOCI} SELECT locus, min(elem_id) AS elem_id FROM real GROUP BY 1")
def locus_representative(spark, sf_dir):
    return A.locus_representative(T.align(spark, sf_dir))


_PARTNER = f"""el AS (SELECT elem, elem % 21 AS locus, row_number() OVER (PARTITION BY elem % 21 ORDER BY {T.lcg('elem', '7')}, elem) - 1 AS k, count(*) OVER (PARTITION BY elem % 21) AS m FROM (SELECT DISTINCT elem FROM p)),
lo AS (SELECT locus, any_value(m) AS m, row_number() OVER (ORDER BY {T.lcg('locus', '7')}, locus) - 1 AS i, count(*) OVER () AS n FROM el GROUP BY locus),
pa AS (SELECT a.elem, a.locus, d.elem AS other, d.locus AS other_locus FROM el a JOIN lo b USING (locus) JOIN lo c ON c.i = (b.i + 1) % b.n JOIN el d ON d.locus = c.locus AND d.k = a.k % c.m WHERE a.locus <> d.locus)"""


@query(f"""WITH p AS ({T.PROFILE_SQL}), {_PARTNER}, j AS (SELECT pa.elem, pa.other, x.i, y.e FROM pa JOIN p x ON x.elem = pa.elem JOIN p y ON y.elem = pa.other AND y.pos = x.pos),
r AS (SELECT elem, other, i, count(*) OVER (PARTITION BY elem) AS m, rank() OVER (PARTITION BY elem ORDER BY e) + (count(*) OVER (PARTITION BY elem, e) - 1) / 2.0::DOUBLE AS b FROM j)
SELECT elem, other, round(CASE WHEN n >= 3 AND s > 0 THEN 2 * t / s - 1 ELSE 0.0::DOUBLE END, 6) AS a_f FROM (SELECT elem, other, count(*) AS n, sum(i) AS s, sum(i * (b - 1) / (m - 1 + 1e-12)) AS t FROM r GROUP BY ALL)""")
def shuffled_scores(spark, sf_dir):
    """Each element's sensitivities against the effects of an element of another locus."""
    p = T.profile(spark, sf_dir).withColumn("locus", F.col("elem") % 21)
    return A.shuffled_scores(p, "precision_weighted", 7).select("elem", "other", F.round("a_f", 6).alias("a_f"))


@query(f"""{_HITS}, s AS (SELECT (SELECT avg(CAST(A_f > t AS INT)) FROM rf, thr) AS real, (SELECT avg(CAST(A_f > t AS INT)) FROM nf, thr) AS "null", (SELECT avg(CAST(A_f > t AS INT)) FROM of, thr) AS shuffled)
SELECT round(real, 9) AS real, round("null", 9) AS "null", round(shuffled, 9) AS shuffled, real > "null" AS g1, shuffled <= "null" + 0.03 AS g2, shuffled < real AS g3 FROM s""")
def metric_gate(spark, sf_dir):
    """G30, the second run standing for the shuffled side."""
    from helixframe.plans import programs as P

    out = P.metric_gate(*(T.align(spark, sf_dir, f) for f in "RNA"))
    return out.withColumns({c: F.round(c, 9) for c in ("real", "null", "shuffled")})


def _headline_sql(level: str, real: str, null: str) -> str:
    return f"""SELECT '{level}' AS level, (SELECT count(*) FROM {real}) AS n, (SELECT round(median(A_f), 9) FROM {real}) AS median_A, round(hi, 9) AS threshold, (SELECT avg(CAST(A_f > hi AS INT)) FROM {real}) AS upper, (SELECT avg(CAST(A_f < lo AS INT)) FROM {real}) AS lower,
(SELECT round(avg(CASE WHEN a.A_f > b.A_f THEN 1.0::DOUBLE WHEN a.A_f = b.A_f THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 9) FROM {real} a, {null} b) AS prob_greater FROM (SELECT quantile_cont(A_f, 0.95) AS hi, quantile_cont(A_f, 0.05) AS lo FROM {null})"""


@query(f"{_FEATURES}, {_features_sql('re', 'real')}, {_features_sql('ne', 'nul')} {_headline_sql('element', 're', 'ne')} UNION ALL {_headline_sql('locus', 'rf', 'nf')}")
def headline(spark, sf_dir):
    """G28 without the counts of survivors, which mirror_fdr has."""
    from helixframe.plans import programs as P

    out = P.headline(T.align(spark, sf_dir, "R"), T.align(spark, sf_dir, "N"))
    return out.select("level", "n", F.round("median_A", 9).alias("median_A"), F.round("threshold", 9).alias("threshold"), "upper", "lower", F.round("prob_greater", 9).alias("prob_greater"))


@query(f"WITH {_LOCI} SELECT feature_id, count(DISTINCT locus) AS n_loci FROM real GROUP BY 1")
def loci_per_feature(spark, sf_dir):
    return A.loci_per_feature(T.align(spark, sf_dir))


@query(f"""WITH {_LOCI}, el AS (SELECT DISTINCT elem_id, locus FROM real), lo AS (SELECT locus, min(elem_id) AS other, row_number() OVER (ORDER BY locus) - 1 AS i, count(*) OVER () AS n FROM el GROUP BY 1)
SELECT el.elem_id, el.locus, b.other, b.locus AS other_locus FROM el JOIN lo a USING (locus) JOIN lo b ON b.i = (a.i + 1) % a.n WHERE b.locus <> el.locus""")
def shuffle_control(spark, sf_dir):
    return A.shuffle_control(T.align(spark, sf_dir).select("elem_id", "locus").distinct())


@query(f"""{_HITS}, {_features_sql('re', 'real')}, {_features_sql('ne', 'nul')}, te AS (SELECT quantile_cont(A_f, 0.95) AS t FROM ne)
SELECT 'element' AS level, count(*) AS n, count(*) FILTER (A_f > te.t) AS n_causal FROM re, te UNION ALL SELECT 'locus', count(*), count(*) FILTER (A_f > thr.t) FROM rf, thr""")
def element_vs_locus(spark, sf_dir):
    real, null = T.align(spark, sf_dir, "R"), T.align(spark, sf_dir, "N")
    out = []
    for level, up in (("element", lambda d: d), ("locus", A.collapse_to_loci)):
        t = F.broadcast(stats.percentile_of(A.aggregate_features(up(null)), "A_f", 0.95))
        out.append(A.aggregate_features(up(real)).crossJoin(t).agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("A_f") > F.col("threshold")).alias("n_causal")))
    return out[0].unionByName(out[1])
