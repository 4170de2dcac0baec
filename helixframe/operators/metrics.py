"""Alignment metrics of profiles (elem, pos, i, e): sensitivity i against effect e."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import stats


def spearman_all(profile: DataFrame) -> DataFrame:
    """Rank correlation over all positions."""
    return stats.spearman(profile, ["elem"], "i", "e", "score")


def spearman_active(profile: DataFrame) -> DataFrame:
    """The same over positions with i > 1e-9; an element with fewer than three gives 0."""
    return profile.select("elem").distinct().join(stats.spearman(profile.where("i > 1e-9"), ["elem"], "i", "e", "score"), "elem", "left").fillna(0.0, ["score"])


def precision_weighted(profile: DataFrame) -> DataFrame:
    """X8."""
    return stats.precision_weighted(profile, ["elem"], "i", "e")


def precision_weighted_alt(sens: DataFrame, effects: DataFrame) -> DataFrame:
    """X9 with J7: X8 over (elem, pos, alt) pairs that both sides have; alt -1 is an unused slot."""
    return stats.precision_weighted(sens.where("alt >= 0").join(effects, ["elem", "pos", "alt"]), ["elem"], "i", "e")


def partial_gc(profile: DataFrame) -> DataFrame:
    """Correlation of the ranks of i and e after the rank of the covariate gc is taken out of both."""
    d = profile.where("i IS NOT NULL AND e IS NOT NULL AND gc IS NOT NULL")
    for c in ("i", "e", "gc"):
        d = stats.average_rank(d, ["elem"], c, f"_r{c}")
    d = stats.residual(stats.residual(d, ["elem"], "_ri", "_rgc", "_a"), ["elem"], "_re", "_rgc", "_b")
    s = d.groupBy("elem").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_a") * F.col("_b")).alias("ab"), F.sum(F.col("_a") * F.col("_a")).alias("aa"), F.sum(F.col("_b") * F.col("_b")).alias("bb"))
    ok = (F.col("n") >= 3) & (F.col("aa") > 1e-9) & (F.col("bb") > 1e-9)
    return s.select("elem", F.when(ok, F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(F.lit(0.0)).alias("score"))


def overlap_auroc(profile: DataFrame) -> DataFrame:
    """X11: 2 AUROC - 1 of i for positions with e above the element's median + 1e-12; one class alone gives 0."""
    mid = profile.groupBy("elem").agg(F.percentile("e", F.lit(0.5)).alias("_m"))
    d = profile.join(mid, "elem").withColumn("_y", F.col("e") > F.col("_m") + F.lit(1e-12))
    return stats.auroc(d, ["elem"], "i", "_y").select("elem", F.coalesce(2 * F.col("auroc") - 1, F.lit(0.0)).alias("score"))


#: The registries of metrics by name.
METRICS = {"spearman_all": spearman_all, "spearman_active": spearman_active, "precision_weighted": precision_weighted}
EXPERIMENT = {**METRICS, "partial_gc": partial_gc, "overlap_auroc": overlap_auroc}


def get_metric(name: str):
    """A metric by name; an unknown one is a ValueError."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; there are {sorted(METRICS)}")
    return METRICS[name]
