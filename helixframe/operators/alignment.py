"""Re-reductions of the alignment fact align(feature_id, elem_id, locus, a_f, mass)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import prefix, stats


def collapse_to_loci(align: DataFrame) -> DataFrame:
    """A3: mean a_f and mass for each feature and locus; partial averages travel, not rows.

    Rounded to 9 digits, for all who use it: a median or threshold picks one of these values, and which one must not hang on the
    order of summation; 1e-12 settles halves.
    """
    return align.groupBy("feature_id", "locus").agg(F.round(F.avg("a_f") + F.lit(1e-12), 9).alias("a_f"), F.avg("mass").alias("mass"))


def attach_loci(align: DataFrame, loci: DataFrame) -> DataFrame:
    """The locus of each element; an unknown element is its own locus."""
    return align.join(loci, "elem_id", "left").withColumn("locus", F.coalesce("locus", F.col("elem_id").cast(loci.schema["locus"].dataType)))


def aggregate_features(align: DataFrame, min_active: int = 1) -> DataFrame:
    """A2 with P8: mass-weighted median, support and mean mass of each feature with enough rows."""
    known = align.where(F.col("a_f").isNotNull())
    counts = known.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_active"), F.avg("mass").alias("mean_mass")).where(F.col("n_active") >= min_active)
    return stats.weighted_median(known, ["feature_id"], "a_f", "mass", "A_f").join(counts, "feature_id")


def classify(a: Column, threshold: Column) -> Column:
    """Inactive without a value, causal strictly above the threshold, else correlational."""
    return F.when(a.isNull() | F.isnan(a), "inactive").when(a > threshold, "causal").otherwise("correlational")


def causal_fraction(features: DataFrame, threshold: Column, value: str = "A_f") -> DataFrame:
    """Share of known values strictly above the threshold; null without any."""
    return features.where(F.col(value).isNotNull()).agg(F.avg((F.col(value) > threshold).cast("double")).alias("causal_fraction"))


def causal_test(real: DataFrame, null: DataFrame, pct: float = 0.95, min_active: int = 1) -> DataFrame:
    """Features by locus against the null's percentile, with class, p and q."""
    features = aggregate_features(collapse_to_loci(real), min_active)
    nulls = aggregate_features(collapse_to_loci(null), min_active)
    threshold = stats.percentile_of(nulls, "A_f", pct)
    out = stats.bh_qvalue(stats.empirical_pvalue(features, "A_f", nulls, "A_f"), "p_value")
    return out.crossJoin(F.broadcast(threshold)).withColumn("label", classify(F.col("A_f"), F.col("threshold")))


def tail_symmetry(features: DataFrame, nulls: DataFrame) -> DataFrame:
    """Share above the null's 95th percentile, share below its 5th, and their difference."""
    t = nulls.agg(F.percentile("A_f", F.lit(0.95)).alias("hi"), F.percentile("A_f", F.lit(0.05)).alias("lo"))
    s = features.where("A_f IS NOT NULL").crossJoin(F.broadcast(t))
    return s.agg(F.avg((F.col("A_f") > F.col("hi")).cast("double")).alias("upper"), F.avg((F.col("A_f") < F.col("lo")).cast("double")).alias("lower")).withColumn("difference", F.col("upper") - F.col("lower"))


def mann_whitney(a: DataFrame, b: DataFrame, value: str = "A_f") -> DataFrame:
    """P(a > b) with ties counting half, U, and the one-sided p by the normal law with tie and continuity corrections.

    Counts of distinct values are all that is ranked.
    """
    side = lambda d, x, y: d.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    cells = side(a, 1, 0).union(side(b, 0, 1)).groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    cells = prefix.running(prefix.blocked(cells, "v"), [], "v", "y", "upto")
    cells = cells.withColumn("u", F.col("x") * (F.col("upto") - F.col("y") / 2.0)).withColumn("t", F.col("x") + F.col("y"))
    s = cells.agg(F.sum("u").alias("u"), F.sum("x").cast("double").alias("n1"), F.sum("y").cast("double").alias("n0"), F.sum(F.pow(F.col("t"), F.lit(3.0)) - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n0")
    var = F.col("n1") * F.col("n0") / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = (F.col("u") - F.col("n1") * F.col("n0") / 2 - 0.5) / F.sqrt(var)
    return s.select(F.col("u").alias("u_statistic"), F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("u") / (F.col("n1") * F.col("n0"))).alias("prob_greater"), normal_tail(z).alias("p_value"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal law, by the rational approximation of Abramowitz and Stegun 26.2.17 (error < 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def stratified_threshold(features: DataFrame, nulls: DataFrame, density: str, pct: float = 0.95, bins: int = 10, least: int = 20) -> DataFrame:
    """Each feature's threshold from the null values in its density bin, or from all where the bin has too few.

    Bin edges are the null densities' quantiles, the outer ones open; they are bins + 1 numbers.
    """
    edges = F.broadcast(nulls.agg(F.percentile(density, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_edges"), F.percentile("A_f", F.lit(pct)).alias("_all")))
    binned = lambda d: d.crossJoin(edges).withColumn("bin", F.size(F.filter("_edges", lambda x: x <= F.col(density))))
    own = binned(nulls).groupBy("bin").agg(F.percentile("A_f", F.lit(pct)).alias("_own"), F.count("A_f").alias("_n"))
    out = binned(features).join(own, "bin", "left")
    return out.withColumn("threshold", F.when(F.col("_n") >= least, F.col("_own")).otherwise(F.col("_all"))).drop("_edges", "_all", "_own", "_n")


def top_drivers(align: DataFrame, k: int = 3) -> DataFrame:
    """The k elements of most a_f for each feature, ties by element."""
    w = Window.partitionBy("feature_id").orderBy(F.desc("a_f"), "elem_id")
    return align.where("a_f IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def jaccard(df: DataFrame, key: str, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, a, b) with membership flags: intersection, union and their ratio; an empty union gives null."""
    s = df.groupBy(*by).agg(F.count_if(F.col(a) & F.col(b)).alias("n_both"), F.count_if(F.col(a) | F.col(b)).alias("n_either"))
    return s.withColumn("jaccard", F.when(F.col("n_either") > 0, F.col("n_both") / F.col("n_either")))


def jaccard_by_q(a: DataFrame, b: DataFrame, key: str = "feature_id", q: str = "q_value") -> DataFrame:
    """(q, n_both, n_either, jaccard) at every distinct q of two runs: of the keys with a q-value of q or less in both or in either.

    A key joins the union at the lesser of its two q-values and the intersection at the greater, so one scan over the distinct
    values serves all thresholds.  Null q-values never join; a key of one run alone never joins the intersection.
    """
    j = a.select(F.col(key).alias("k"), F.col(q).alias("x")).join(b.select(F.col(key).alias("k"), F.col(q).alias("y")), "k", "full")
    one = F.struct(F.least("x", "y").alias("q"), F.lit(0).alias("both"), F.lit(1).alias("either"))  # least skips nulls
    two = F.struct(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.greatest("x", "y")).alias("q"), F.lit(1).alias("both"), F.lit(0).alias("either"))
    cells = j.select(F.inline(F.array(one, two))).where("q IS NOT NULL").groupBy("q").agg(F.sum("both").alias("both"), F.sum("either").alias("either"))
    cells = prefix.running(prefix.running(prefix.blocked(cells, "q"), [], "q", "both", "n_both"), [], "q", "either", "n_either")
    return cells.select("q", "n_both", "n_either", (F.col("n_both") / F.col("n_either")).alias("jaccard"))


def matched_jaccard(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """U2 and U3 over pairs(a_id, b_id): both / either among pairs, and both / union of the raw ids; a, b are (id, hit)."""
    j = pairs.join(a.select(F.col("id").alias("a_id"), F.col("hit").alias("a_hit")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("hit").alias("b_hit")), "b_id")
    s = j.agg(F.count_if(F.col("a_hit") & F.col("b_hit")).alias("both"), F.count_if(F.col("a_hit") | F.col("b_hit")).alias("either"))
    ids = a.where("hit").select("id").union(b.where("hit").select("id")).distinct().agg(F.count(F.lit(1)).alias("ids"))
    return s.crossJoin(ids).select(F.when(F.col("either") > 0, F.col("both") / F.col("either")).alias("pair_jaccard"), F.when(F.col("ids") > 0, F.col("both") / F.col("ids")).alias("hybrid_jaccard"))


def seed_reproduced(hits: DataFrame) -> DataFrame:
    """hits(feature_id, seed, hit): share of the first seed's hits that every other seed has as well."""
    first = hits.agg(F.min("seed").alias("s0"))
    each = hits.crossJoin(F.broadcast(first)).groupBy("feature_id").agg(F.bool_or(F.col("hit") & (F.col("seed") == F.col("s0"))).alias("base"), F.bool_and("hit").alias("everywhere"))
    return each.where("base").agg(F.avg(F.col("everywhere").cast("double")).alias("reproduced"))


def seed_cv(values: DataFrame) -> DataFrame:
    """values(feature_id, seed, a): abs(sd / mean) over seeds (population sd), two seeds at least and a mean off zero."""
    s = values.where("a IS NOT NULL").groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("a").alias("m"), F.stddev_pop("a").alias("sd"))
    return s.where((F.col("n_seeds") >= 2) & (F.abs("m") > 1e-9)).select("feature_id", "n_seeds", F.abs(F.col("sd") / F.col("m")).alias("cv"))


def coverage_bins(features: DataFrame, n_loci: str, threshold: Column, least: int = 20) -> DataFrame:
    """Spread and tails of A_f by coverage bin; bins of fewer features are left out (sample sd)."""
    n = F.col(n_loci)
    label = F.when(n <= 8, "1-8").when(n <= 12, "9-12").when(n <= 16, "13-16").when(n <= 19, "17-19").otherwise("20+")
    s = features.where("A_f IS NOT NULL").groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("A_f").alias("sd"), F.avg((F.col("A_f") > threshold).cast("double")).alias("upper"))
    return s.where(F.col("n") >= least)


def locus_representative(elements: DataFrame, order: str = "elem_id") -> DataFrame:
    """The first element of each locus."""
    return elements.groupBy("locus").agg(F.min(order).alias(order))


def loci_per_feature(align: DataFrame) -> DataFrame:
    """In how many loci each feature has a value; joined to features, the n_loci of coverage_bins."""
    return align.where("a_f IS NOT NULL").groupBy("feature_id").agg(F.count_distinct("locus").alias("n_loci"))


def robust(features: DataFrame, ci: DataFrame, threshold: DataFrame, q: float = 0.10) -> DataFrame:
    """Features (feature_id, q_value) with ci (feature_id, lo): ci_robust if the interval's lower end is above the
    threshold, high_confidence if q_value is below q as well.  Without an interval neither holds."""
    j = features.join(ci.select("feature_id", "lo"), "feature_id", "left").crossJoin(F.broadcast(threshold.select(F.col("threshold").alias("_t"))))
    # rounded, as both sides are interpolated sums
    j = j.withColumn("ci_robust", F.coalesce(F.round("lo", 9) > F.round("_t", 9), F.lit(False)))
    return j.withColumn("high_confidence", F.col("ci_robust") & F.coalesce(F.col("q_value") < q, F.lit(False))).drop("_t")


def partners(elements: DataFrame, seed: int = 0) -> DataFrame:
    """Elements (elem, locus) -> (elem, locus, other, other_locus) with an element of another locus for each.

    Loci stand in a seeded order and each takes the next one's elements, in a seeded order as well and over again if they are
    fewer: no try can fail, so there is no fallback but for a single locus, whose elements get no partner.  Windows are over loci,
    and within a locus.
    """
    from helixframe.sources.tables import lcg

    kinds = dict(elements.dtypes)
    draw = lambda c: F.expr(lcg(f"cast({c} as bigint)", str(seed))) if kinds[c] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(c, F.lit(seed))
    order = lambda c: [draw(c), F.col(c)]
    own = elements.select("elem", "locus").distinct().withColumn("k", F.row_number().over(Window.partitionBy("locus").orderBy(*order("elem"))) - 1)
    loci = own.groupBy("locus").agg(F.count(F.lit(1)).alias("m"))
    loci = loci.withColumns({"i": F.row_number().over(Window.orderBy(*order("locus"))) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})
    after = loci.select(F.pmod(F.col("i") - 1, F.col("n")).alias("i"), F.col("locus").alias("other_locus"), F.col("m").alias("other_m"))
    found = own.join(loci.select("locus", "i"), "locus").join(after, "i").where("locus <> other_locus").withColumn("other_k", F.col("k") % F.col("other_m"))
    return found.join(own.select(F.col("locus").alias("other_locus"), F.col("k").alias("other_k"), F.col("elem").alias("other")), ["other_locus", "other_k"]).select("elem", "locus", "other", "other_locus")


def shuffled_scores(profiles: DataFrame, metric: str = "precision_weighted", seed: int = 0) -> DataFrame:
    """(elem, locus, other, a_f, mass): profiles (elem, locus, pos, i, e) scored against the partner's effects.

    Positions that both have count, so the longer one is cut; the mass is 1.  What is left to do is A2 over it.
    """
    from helixframe.operators.metrics import EXPERIMENT

    pairs = partners(profiles.select("elem", "locus").distinct(), seed)
    effects = profiles.select(F.col("elem").alias("other"), "pos", "e")
    crossed = profiles.select("elem", "pos", "i", *[c for c in ("gc",) if c in profiles.columns]).join(pairs, "elem").join(effects, ["other", "pos"])
    return EXPERIMENT[metric](crossed).withColumnRenamed("score", "a_f").join(pairs, "elem").select("elem", "locus", "other", "a_f", F.lit(1.0).alias("mass"))


def shuffle_control(profiles: DataFrame, shift: int = 1) -> DataFrame:
    """Element pairs (elem, other) of different loci, by rotating the loci; elements(elem_id, locus).

    Ranks are over loci, one row each; an element takes the least element of the locus `shift` further on.
    """
    loci = profiles.groupBy("locus").agg(F.min("elem_id").alias("other"))
    ranked = loci.withColumns({"i": F.row_number().over(Window.orderBy("locus")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})
    turned = ranked.select(F.pmod(F.col("i") - shift, F.col("n")).alias("i"), F.col("locus").alias("other_locus"), "other")
    return profiles.join(ranked.select("locus", "i"), "locus").join(turned, "i").where("locus <> other_locus").select("elem_id", "locus", "other", "other_locus")
