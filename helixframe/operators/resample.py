"""Resampling in one job: replicates are rows, draws are hashes of (replicate, slot), nothing loops over actions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.durable import durable
from helixframe.functions import prefix, stats
from helixframe.sources.tables import lcg


def bootstrap(values: DataFrame, by: str, order: str, value: str, weight: str, reps: int) -> DataFrame:
    """(by, rep, wmedian): weighted medians of `reps` resamples of each group with more than one row.

    A row's slots are drawn by number, so each replicate of a group is as large as the group.
    """
    w = Window.partitionBy(by)
    rows = values.where(F.col(value).isNotNull()).select(by, F.col(value).alias("v"), F.col(weight).alias("w"), (F.row_number().over(w.orderBy(order)) - 1).alias("slot"), F.count(F.lit(1)).over(w).alias("n")).where("n > 1")
    draws = rows.select(by, "slot", "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = draws.select(by, "rep", F.expr(f"cast(floor(cast({lcg('rep', 'slot', by)} as double) * n) as int)").alias("slot"))
    picked = draws.groupBy(by, "rep", "slot").agg(F.count(F.lit(1)).alias("times")).join(rows.select(by, "slot", "v", "w"), [by, "slot"])
    return stats.weighted_median(picked.withColumn("tw", F.col("w") * F.col("times")), [by, "rep"], "v", "tw")


def bootstrap_ci(values: DataFrame, by: str, order: str, value: str, weight: str, reps: int = 100) -> DataFrame:
    """2.5th and 97.5th percentile and standard error (sample) of the replicates; null for groups of one."""
    b = bootstrap(values, by, order, value, weight, reps)
    s = b.groupBy(by).agg(F.percentile("wmedian", F.lit(0.025)).alias("lo"), F.percentile("wmedian", F.lit(0.975)).alias("hi"), F.stddev_samp("wmedian").alias("se"))
    return values.select(by).distinct().join(s, by, "left")


def studentised(features: DataFrame, ci: DataFrame, by: str = "feature_id", least: int = 3) -> DataFrame:
    """A_f over its bootstrap standard error; null below `least` rows or an error of 1e-9."""
    ok = (F.col("n_active") >= least) & (F.col("se") > 1e-9)
    return features.join(ci.select(by, "se"), by).withColumn("t", F.when(ok, F.col("A_f") / F.col("se")))


#: Features whose medians over all parts are worked out at once, as rows of a matrix.
TOGETHER = 256


def _deal_medians(a: np.ndarray, w: np.ndarray, deal: np.ndarray, letter: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted medians (feature, split) of the cells dealt the letter, and where there are any; a, w (feature, cell) by value, deal (feature, cell, split)."""
    features, cells, splits = deal.shape
    mine = [deal[:, i] == letter for i in range(cells)]
    total, known = np.zeros((features, splits)), np.zeros((features, splits), bool)
    for i in range(cells):
        total += w[:, i, None] * mine[i]
        known |= mine[i]
    cum, out, left = np.zeros_like(total), np.zeros_like(total), total > 0
    for i in range(cells):
        cum += w[:, i, None] * mine[i]
        now = left & (cum >= total / 2)
        if i + 1 < cells:
            now &= (a[:, i] != a[:, i + 1])[:, None]  # equal values are one cell
        out = np.where(now, a[:, i, None], out)
        left &= ~now
    for f, s in np.argwhere(known & ~(total > 0)):
        out[f, s] = np.median(a[f, deal[f, :, s] == letter])
    return out, known


def deal_medians(values: DataFrame, deals: DataFrame, by: list[str], parts: int) -> DataFrame:
    """(by, m0, m1, ...): weighted medians of a_f by mass over the loci of each part of every split, null for a part without any.

    deals (locus, deal): a letter for each split, which names the locus's part, or another one.  A group's few loci come
    together once, however many splits there are, and what leaves is one array of `splits` numbers a part.
    """
    rows = values.where("a_f IS NOT NULL").join(deals, "locus").groupBy(*by).agg(F.collect_list(F.struct("a_f", "locus", "mass", "deal")).alias("_s"))
    rows = rows.select(*by, F.sort_array("_s").alias("_s"))
    at = len(by)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            held, size = b.column(at).flatten(), b.column(at).value_lengths().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            a = held.field("a_f").to_numpy(zero_copy_only=False)
            w = np.nan_to_num(held.field("mass").to_numpy(zero_copy_only=False).astype(float))
            text = held.field("deal").to_pylist()
            deal = np.frombuffer("".join(text).encode(), np.uint8).reshape(len(text), -1)
            out, known = np.zeros((parts, b.num_rows, deal.shape[1])), np.zeros((parts, b.num_rows, deal.shape[1]), bool)
            for n in np.unique(size):
                same = np.flatnonzero(size == n)
                for k in range(0, len(same), TOGETHER):
                    f = same[k : k + TOGETHER]
                    cell = first[f][:, None] + np.arange(n)
                    for part in range(parts):
                        out[part, f], known[part, f] = _deal_medians(a[cell], w[cell], deal[cell], ord("0") + part)
            ends = pa.array(np.arange(b.num_rows + 1) * deal.shape[1], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(out[i].ravel(), mask=~known[i].ravel())) for i in range(parts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *lists], names=[*by, *names])

    names = [f"m{i}" for i in range(parts)]
    schema = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in by] + [f"{n} array<double>" for n in names])
    return rows.mapInArrow(run, schema)


def _places(loci: DataFrame, reps: int) -> DataFrame:
    """(locus, rep, place, n): for every replicate the loci's places from 0 on in order of a draw, and their number."""
    grid = loci.select("locus").distinct().crossJoin(F.broadcast(loci.sparkSession.range(reps).select(F.col("id").cast("int").alias("rep"))))
    w = Window.partitionBy("rep")
    return grid.withColumns({"place": F.row_number().over(w.orderBy(F.expr(lcg("rep", "locus")), "locus")) - 1, "n": F.count(F.lit(1)).over(w)})


def _deals(placed: DataFrame, *letters: Column) -> DataFrame:
    """(locus, deal): of each of letters, columns of a locus's place, one letter a replicate."""
    held = placed.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("rep", *[c.alias(f"l{i}") for i, c in enumerate(letters)]))).alias("r"))
    return held.select("locus", F.concat(*[F.array_join(F.col(f"r.l{i}"), "") for i in range(len(letters))]).alias("deal"))


def subsample_curve(align: DataFrame, loci: DataFrame, sizes: list[int], reps: int, threshold: float = 0.0) -> DataFrame:
    """Mean share of features above the threshold by number of loci: for every replicate the `size` loci of least draw."""
    deals = _deals(_places(loci, reps), *[F.when(F.col("place") < s, "0").otherwise("-") for s in sizes])
    a = deal_medians(align, deals, ["feature_id"], 1).select(F.posexplode("m0").alias("at", "A_f")).where("A_f IS NOT NULL")
    size = F.element_at(F.array(*map(F.lit, sizes)), (F.floor(F.col("at") / reps) + 1).cast("int"))
    each = a.groupBy(size.alias("size"), (F.col("at") % reps).alias("rep")).agg(F.avg((F.col("A_f") > threshold).cast("double")).alias("share"))
    return each.groupBy("size").agg(F.avg("share").alias("mean_share"), F.min("share").alias("least"), F.max("share").alias("most"))


def split_half(align: DataFrame, loci: DataFrame, splits: int, threshold: float = 0.0) -> DataFrame:
    """Jaccard of the features above the threshold in the two halves of each split, and its summary (population sd)."""
    deals = _deals(_places(loci, splits), F.floor(2 * F.col("place") / F.col("n")).cast("string"))
    both = deal_medians(align, deals, ["feature_id"], 2).select(F.posexplode(F.arrays_zip("m0", "m1")).alias("rep", "m"))
    x, y = (F.coalesce(F.col(f"m.m{i}") > threshold, F.lit(False)) for i in range(2))
    j = both.groupBy("rep").agg(F.count_if(x & y).alias("i"), F.count_if(x | y).alias("u"))
    return j.where("u > 0").agg(F.avg(F.col("i") / F.col("u")).alias("mean"), F.stddev_pop(F.col("i") / F.col("u")).alias("sd"), F.count(F.lit(1)).alias("splits"))


#: The comparisons of split_design: the run and half that stand against the first run's first half.
CELLS = {"data": (0, 1), "run": (1, 0), "both": (1, 1)}


def split_design(first: DataFrame, second: DataFrame, null: DataFrame, splits: int, q: float = 0.05, pairs: DataFrame | None = None) -> DataFrame:
    """R7 and G17, the crossed design of runs and data: (cell, mean_jaccard, sd_jaccard, mean_rho, splits).

    Each split deals the first run's loci in two halves of equal size, the odd one out.  A run's features of a half are tested
    against the null's features of that half, and those with a q-value below `q` are its set.  Three comparisons with the first
    run's first half: its second half ("data": noise of estimation alone), the second run on the same half ("run"), the second run on
    the other half ("both"); the fourth cell compares a set with itself.  mean_jaccard and its sd (population) are over the
    splits, as many as `splits` says, in which either set has a feature; null if there is none.  mean_rho is the mean rank
    correlation of A_f over features known to both, of a second run's feature with its partner in pairs(first_id, second_id), or with
    the feature of its own id without pairs; fewer than three features give 0, none give no rho.

    A feature's medians of all splits are worked out at once and kept as two arrays a run.  What is tested are distinct values of
    A_f with their counts: a set is all features from some value of A_f on, as q falls with it, so all that comes back to the features
    is one number for each run, half and split.  Inputs are collapsed to loci (feature_id, locus, a_f, mass).
    """
    deals = _deals(_places(first, splits), F.coalesce(F.least(F.floor(F.try_divide("place", F.floor(F.col("n") / 2))), F.lit(2)), F.lit(2)).cast("string"))
    runs = [d.select(F.lit(i).alias("run"), "feature_id", "locus", "a_f", "mass") for i, d in enumerate((first, second, null))]
    wide = durable(deal_medians(runs[0].unionByName(runs[1]).unionByName(runs[2]), deals, ["run", "feature_id"], 2))
    cells = wide.select("run", F.posexplode(F.concat("m0", "m1")).alias("at", "A_f")).where("A_f IS NOT NULL")
    cells = cells.groupBy("run", (F.col("at") % splits).alias("rep"), F.floor(F.col("at") / splits).cast("int").alias("half"), "A_f").agg(F.count(F.lit(1)).alias("times"))
    cells = durable(cells)
    # splits are many groups of like size, so each is scanned by one window, which sorts outside memory
    many = prefix.CELLS * 2 * splits
    tested = stats.empirical_pvalue(cells.where("run < 2"), "A_f", cells.where("run = 2"), "A_f", by=("rep", "half"), times="times", cells_a_block=many)
    # rounded, as a q-value is a product of quotients
    hits = stats.bh_qvalue(tested, "p_value", by=("run", "rep", "half"), times="times", cells_a_block=many).where(F.round("q_value", 9) < q)
    least = lambda r, h: F.min(F.when((F.col("run") == r) & (F.col("half") == h), F.col("A_f")))
    cut = hits.groupBy("rep").agg(*[least(r, h).alias(f"c{r}{h}") for r in range(2) for h in range(2)]).withColumnRenamed("rep", "_rep")
    side = lambda r: wide.where(F.col("run") == r).select("feature_id", F.col("m0").alias(f"a{r}0"), F.col("m1").alias(f"a{r}1"))
    names = ["a00", "a01", "a10", "a11"]
    nothing = F.array_repeat(F.lit(None).cast("double"), splits)

    def met(other):
        both = side(0).join(other, "feature_id", "full").select(*[F.coalesce(c, nothing).alias(c) for c in names])
        return both.select(F.posexplode(F.arrays_zip(*names)).alias("rep", "a")).select("rep", "a.*")

    hit = lambda r, h: F.coalesce(F.col(f"a{r}{h}") >= F.col(f"c{r}{h}"), F.lit(False))
    counts = []
    for c, (r, h) in CELLS.items():
        counts += [F.count_if(hit(0, 0) & hit(r, h)).alias(f"{c}_i"), F.count_if(hit(0, 0) | hit(r, h)).alias(f"{c}_u"), F.count_if(F.col("a00").isNotNull() | F.col(f"a{r}{h}").isNotNull()).alias(f"{c}_n")]
    by_id = met(side(1))
    j = by_id.join(F.broadcast(cut), F.col("rep") == F.col("_rep"), "left").groupBy("rep").agg(*counts)
    j = j.select("rep", F.inline(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(f"{c}_i").alias("i"), F.col(f"{c}_u").alias("u"), F.col(f"{c}_n").alias("n")) for c in CELLS]))).where("n > 0")
    if pairs is not None:
        named = side(1).join(pairs.select(F.col("second_id").alias("feature_id"), "first_id"), "feature_id").groupBy(F.col("first_id").alias("feature_id"))
        most = lambda c: F.reduce(F.collect_list(c), nothing, lambda s, x: F.zip_with(s, x, lambda a, b: F.greatest(a, b))).alias(c)
        by_id = met(named.agg(most("a10"), most("a11")))
    values = by_id.select("rep", F.inline(F.array(*[F.struct(F.lit(c).alias("cell"), F.col("a00").alias("ax"), F.col(f"a{r}{h}").alias("ay")) for c, (r, h) in CELLS.items()]))).where("ax IS NOT NULL AND ay IS NOT NULL")
    group = Window.partitionBy("rep", "cell")
    rank = lambda c: F.rank().over(group.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("rep", "cell", c)) - 1) / F.lit(2.0)
    rho = stats.correlation(["rep", "cell"], values.withColumn("rx", rank("ax")).withColumn("ry", rank("ay")), "rx", "ry", "rho")
    each = j.join(rho, ["rep", "cell"], "left").withColumn("jaccard", F.when(F.col("u") > 0, F.col("i") / F.col("u")))
    return each.groupBy("cell").agg(F.avg("jaccard").alias("mean_jaccard"), F.stddev_pop("jaccard").alias("sd_jaccard"), F.avg("rho").alias("mean_rho"), F.count("jaccard").alias("splits"))


def pair_bootstrap(pairs: DataFrame, reps: int) -> DataFrame:
    """Percentiles of the pair Jaccard over resampled pairs (pair_id 0..n-1, a_hit, b_hit)."""
    n = pairs.count()
    draws = pairs.select("pair_id").crossJoin(F.broadcast(pairs.sparkSession.createDataFrame([(r,) for r in range(reps)], "rep int")))
    draws = draws.select("rep", F.expr(f"cast(floor(cast({lcg('rep', 'pair_id')} as double) * {n}) as bigint)").alias("pair_id"))
    s = draws.join(pairs, "pair_id").groupBy("rep").agg(F.count_if(F.col("a_hit") & F.col("b_hit")).alias("i"), F.count_if(F.col("a_hit") | F.col("b_hit")).alias("u")).where("u > 0")
    return s.agg(F.percentile(F.col("i") / F.col("u"), F.lit(0.025)).alias("lo"), F.percentile(F.col("i") / F.col("u"), F.lit(0.975)).alias("hi"))


def zero_signal(spark, features: int, coverage: list[int], sd: float = 0.1) -> DataFrame:
    """(coverage, sd_A, share_positive) of medians of as many centred draws: spread falls with coverage without any signal."""
    d = spark.range(features).select(F.col("id").alias("f"), F.explode(F.array(*map(F.lit, coverage))).alias("coverage"))
    draws = d.select("f", "coverage", F.explode(F.sequence(F.lit(1), F.col("coverage"))).alias("k"))
    draws = draws.withColumn("v", F.round((F.expr(f"cast({lcg('f', 'k', 'coverage')} as double)") - 0.5) * sd, 9)).withColumn("w", F.lit(1.0))
    a = stats.weighted_median(draws, ["coverage", "f"], "v", "w", "A_f")
    return a.groupBy("coverage").agg(F.round(F.stddev_samp("A_f"), 7).alias("sd_A"), F.avg((F.col("A_f") > 0).cast("double")).alias("share_positive"))


def power_curve(spark, effects: list[float], sizes: list[int], reps: int, alpha_z: float = 1.645) -> DataFrame:
    """Share of replicates whose mean of n shifted draws exceeds its null's limit, over an effect x size grid."""
    grid = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.array(*map(F.lit, effects))).alias("effect"))
    grid = grid.select("rep", "effect", F.explode(F.array(*map(F.lit, sizes))).alias("n"))
    draws = grid.select("rep", "effect", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    draws = draws.withColumn("v", F.round(F.expr(f"cast({lcg('rep', 'k', 'n')} as double)") - 0.5 + F.col("effect"), 9))
    means = draws.groupBy("effect", "n", "rep").agg(F.avg("v").alias("m"))
    return means.groupBy("effect", "n").agg(F.avg((F.col("m") > alpha_z / F.sqrt(F.lit(12.0) * F.col("n"))).cast("double")).alias("power"))


def smallest_reaching(curve: DataFrame, by: str, n: str, power: str, target: float = 0.8) -> DataFrame:
    """The least n whose power reaches the target, null if none does."""
    return curve.groupBy(by).agg(F.min(F.when(F.col(power) >= target, F.col(n))).alias("least_n"))
