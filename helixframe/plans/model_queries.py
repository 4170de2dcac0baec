"""Driver queries of probes, matching and subspaces; closed forms on NumPy have no SQL, tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import alignment as A
from helixframe.operators import models as M
from helixframe.operators import vectors as V
from helixframe.plans import programs as P
from helixframe.plans.registry import query
from helixframe.sources import tables as T


def _probe(spark, sf_dir):
    """Embeddings as probe rows: the first dimension is the response, the rest explain it, labels are groups."""
    v = T.vectors(spark, sf_dir)
    return v.select(F.col("label").cast("bigint").alias("grp"), F.slice("h", 2, 63).alias("x"), F.col("h")[0].alias("y"))


def _two(spark, sf_dir):
    """All embeddings as two sets of directions, by the parity of their number."""
    v = T.vectors(spark, sf_dir).select(F.col("token").alias("feature_id"), F.col("h").alias("w"))
    return v.where("feature_id % 2 = 0"), v.where("feature_id % 2 = 1")


def _values(spark, values: dict) -> object:
    return spark.createDataFrame([(k, None if v is None else round(float(v), 6)) for k, v in values.items()], "name string, value double")


@query(None)
def ridge_logo_cv(spark, sf_dir):
    return M.group_folds(_probe(spark, sf_dir), lambda n, s, g: M.ridge(n, s, g, 10.0))[0].withColumn("rho", F.round("rho", 6))


def _few(spark, sf_dir):
    """Measurements as probe rows: two explaining variables, one response; parts are elements and brands their loci."""
    v = T.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("elem"), (F.col("l_suppkey") % 7).alias("locus"), F.array("l_quantity", "l_discount").alias("x"), F.col("l_extendedprice").alias("y"))
    return v


def _ridge_sql(group: str, alpha: float = 10.0) -> str:
    """Leave-one-group-out ridge over two variables in closed form: f_<group>(grp, rho)."""
    sums = "count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(y) AS sy, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_"
    less = ", ".join(f"t.{c} - s.{c} AS {c}" for c in ("n", "sa", "sb", "sy", "aa", "ab", "bb", "ay", "by_"))
    return f"""d_{group} AS (SELECT {group} AS grp, l_quantity - (SELECT avg(l_quantity) FROM li) AS a, l_discount - (SELECT avg(l_discount) FROM li) AS b, l_extendedprice - (SELECT avg(l_extendedprice) FROM li) AS y FROM li),
s_{group} AS (SELECT grp, {sums} FROM d_{group} GROUP BY 1), t_{group} AS (SELECT {sums} FROM d_{group}), r_{group} AS (SELECT s.grp, {less} FROM s_{group} s, t_{group} t),
z_{group} AS (SELECT grp, n, sqrt(aa / n - sa * sa / n / n) + 1e-8 AS da, sqrt(bb / n - sb * sb / n / n) + 1e-8 AS db, aa / n - sa * sa / n / n AS caa, ab / n - sa * sb / n / n AS cab, bb / n - sb * sb / n / n AS cbb,
  ay / n - sa * sy / n / n AS cay, by_ / n - sb * sy / n / n AS cby FROM r_{group}),
k_{group} AS (SELECT grp, da, db, n * caa / da / da + {alpha} AS p, n * cab / da / db AS q, n * cbb / db / db + {alpha} AS r, n * cay / da AS u, n * cby / db AS v FROM z_{group}),
w_{group} AS (SELECT grp, (r * u - q * v) / (p * r - q * q) / da AS wa, (p * v - q * u) / (p * r - q * q) / db AS wb FROM k_{group}),
g_{group} AS (SELECT grp, y, round(wa * a + wb * b, 6) AS e FROM d_{group} JOIN w_{group} USING (grp)),
e_{group} AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY e) + (count(*) OVER (PARTITION BY grp, e) - 1) / 2.0::DOUBLE AS i, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0::DOUBLE AS j FROM g_{group}),
f_{group} AS (SELECT grp, CASE WHEN count(*) >= 3 AND var_pop(i) > 0 AND var_pop(j) > 0 THEN corr(i, j) ELSE 0.0 END AS rho FROM e_{group} GROUP BY 1)"""


_LI = "WITH li AS (SELECT l_suppkey AS elem, l_suppkey % 7 AS locus, l_quantity, l_discount, l_extendedprice FROM lineitem)"


@query(f"{_LI}, {_ridge_sql('locus')} SELECT grp, round(rho, 3) AS rho FROM f_locus")
def ridge_two_variables(spark, sf_dir):
    """M14 in so few dimensions that SQL can say it as well."""
    rho, _ = M.fold_scores(_few(spark, sf_dir).withColumn("grp", F.col("locus")), {"ridge": lambda n, s, g: M.ridge(n, s, g, 10.0)})
    return rho.select("grp", F.round("rho", 3).alias("rho"))


@query(f"""{_LI}, {_ridge_sql('elem')}, {_ridge_sql('locus')}, m AS (SELECT (SELECT avg(rho) FROM f_elem) AS e, (SELECT avg(rho) FROM f_locus) AS l)
SELECT name, round(value, 2) AS value FROM (SELECT 'element' AS name, e AS value FROM m UNION ALL SELECT 'locus', l FROM m)""")
def paired_probe(spark, sf_dir):
    """Folds that leave out an element, and ones that leave out a whole locus; both mean correlations."""
    rows, fits = _few(spark, sf_dir), {"ridge": lambda n, s, g: M.ridge(n, s, g, 10.0)}
    values = {name: M.mean_scores(rows.withColumn("grp", F.col(c)), fits)["ridge"] for name, c in (("element", "elem"), ("locus", "locus"))}
    return spark.createDataFrame([(k, None if v is None else round(float(v), 2)) for k, v in values.items()], "name string, value double")


@query(None)
def pls_rank_sweep(spark, sf_dir):
    fits = {f"rank_{r}": lambda n, s, g, r=r: M.pls(n, s, g, r) for r in (1, 2, 3, 5, 10)}
    return _values(spark, M.mean_scores(_probe(spark, sf_dir), fits))


@query(None)
def mlp_probe(spark, sf_dir):
    return M.mlp_folds(_probe(spark, sf_dir)).withColumn("rho", F.round("rho", 3))


@query(None)
def hungarian_match(spark, sf_dir):
    return M.match_features(*_two(spark, sf_dir)).withColumn("cosine", F.round("cosine", 6))


@query(None)
def matched_jaccard(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    hit = lambda d: d.select(F.col("feature_id").alias("id"), (F.col("w")[0] > 0).alias("hit"))
    return A.matched_jaccard(M.match_features(a, b), hit(a), hit(b))


@query(None)
def subspace_overlap(spark, sf_dir):
    return _values(spark, P.subspace_stability(*_two(spark, sf_dir)))


@query(None)
def signal_audit(spark, sf_dir):
    audit = P.signal_audit(T.align(spark, sf_dir, "R"), T.align(spark, sf_dir, "N"))
    half, paired = P.locus_tests(audit["loci"])
    shift, tails = audit["shift"].first(), audit["tails"].first()
    return _values(spark, {"prob_greater": shift["prob_greater"], "p_shift": shift["p_value"], "upper": tails["upper"], "lower": tails["lower"], "wilcoxon_half": half, "wilcoxon_null": paired})


@query(None)
def encoder_training(spark, sf_dir):
    return _values(spark, P.train_and_test(T.vectors(spark, sf_dir), 32, 8, 5))


@query(None)
def subspace_permutation(spark, sf_dir):
    """R9 on two samples of embeddings: the observed overlap, its bootstrap interval, and the share of relabellings that reach it."""
    from helixframe.operators import audit

    a, b = (V.matrix(d)[1] for d in _two(spark, sf_dir))
    x, y = a[: len(a) // 2], b[: len(b) // 2]
    seen = V.subspace_overlap(audit._basis(x), audit._basis(y))
    boot = audit.overlap_replicates(spark, [x, y], 100).agg(F.percentile("overlap", F.lit(0.025)).alias("lo"), F.percentile("overlap", F.lit(0.975)).alias("hi")).first()
    null = audit.overlap_replicates(spark, [x, y], 100, [a, b], 1).agg(F.avg((F.col("overlap") >= seen).cast("double"))).first()[0]
    return _values(spark, {"overlap": seen, "lo": boot["lo"], "hi": boot["hi"], "p": null})


@query(None)
def sensitivity_probe(spark, sf_dir):
    """G9 on synthetic elements: hidden changes under leave-one-element-out ridge."""
    from helixframe.operators import audit, toy
    from helixframe.sources import genome

    elements = toy.elements_of(genome.synthetic_corpus(spark, 12, 120, weights={"ccre": 1.0, "background": 0.0}))
    blocks = audit.sensitivity_blocks(elements, toy.ToyModel(d_model=32, layers=2), 1)
    rows = blocks.withColumn("grp", F.substring("elem_id", 4, 7).cast("bigint"))
    return M.group_folds(rows, lambda n, s, g: M.ridge(n, s, g, 10.0))[0].withColumn("rho", F.round("rho", 5))


@query("SELECT CAST(CASE WHEN l_discount < 0 THEN 0 WHEN l_discount >= 0.08 THEN 9 ELSE floor(round(l_discount * 100) / 1.0) + 1 END AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf_dir):
    from helixframe.operators import audit

    d = T.read(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 100).alias("v"))
    return audit.histogram(d, "v", 0.0, 8.0, 8)


@query("SELECT l_returnflag, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS mid, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def box_summary(spark, sf_dir):
    from helixframe.operators import audit

    return audit.box(T.read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
