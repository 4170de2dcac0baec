"""Grouped statistics as plans of built-in functions.

Nulls stand for missing values throughout: they are ignored by aggregates and stay null in projections.  A hot group is
pre-aggregated by distinct value before any window, so what a window sorts is the group's distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.durable import durable
from helixframe.functions import prefix

#: Rows of a table that is sent to all tasks, at most.
FEW = 100_000


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, out: str = "wmedian") -> DataFrame:
    """A1: the lowest value whose cumulative weight reaches half the total; a total of zero or less gives the plain median."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"_cum": F.sum("_w").over(up), "_all": F.sum("_w").over(Window.partitionBy(*by))})
    return cells.groupBy(*by).agg(F.min(F.when(F.col("_cum") >= F.col("_all") / 2, F.col("_v"))).alias("_low"), F.max("_all").alias("_all"), F.percentile("_v", F.lit(0.5), F.col("_n")).alias("_mid")).select(
        *by, F.when(F.col("_all") > 0, F.col("_low")).otherwise(F.col("_mid")).alias(out)
    )


def average_rank(df: DataFrame, by: list[str], value: str, out: str, times: str | None = None) -> DataFrame:
    """Rank within the group, ties sharing their mean rank; null for a null value.  A hot group is ranked by several tasks."""
    return prefix.average_rank(df, by, value, out, times=times)


def _correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    vx, vy = n * xx - x * x, n * yy - y * y
    return F.when((n >= 3) & (vx > 0) & (vy > 0), (n * xy - x * y) / (F.sqrt(vx) * F.sqrt(vy))).otherwise(F.lit(0.0))


def correlation(by: list[str], df: DataFrame, x: str, y: str, out: str, times: str | None = None) -> DataFrame:
    """Pearson's correlation by sums; fewer than 3 rows or a constant side gives 0.  Sums of ranks are exact.

    A row counts as often as its `times` says, if that is given.
    """
    c, n = F.col, F.col(times) if times else F.lit(1)
    sums = df.groupBy(*by).agg(F.sum(n).alias("_n"), F.sum(n * c(x)).alias("_x"), F.sum(n * c(y)).alias("_y"), F.sum(n * c(x) * c(x)).alias("_xx"), F.sum(n * c(y) * c(y)).alias("_yy"), F.sum(n * c(x) * c(y)).alias("_xy"))
    return sums.select(*by, _correlation(*(c(k) for k in ("_n", "_x", "_y", "_xx", "_yy", "_xy"))).alias(out))


def spearman(df: DataFrame, by: list[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Rank correlation of the rows where both sides are known; degenerate groups give 0.

    What is ranked are distinct pairs with their counts, made once: rows of a group with equal pairs travel as one.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = durable(known.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_times")))
    ranked = average_rank(average_rank(pairs, by, "_x", "_rx", "_times"), by, "_y", "_ry", "_times")
    return correlation(by, ranked, "_rx", "_ry", out, "_times")


def spearman_windows(df: DataFrame, by: list[str], x: str, y: str, out: str = "rho", times: str | None = None) -> DataFrame:
    """spearman of groups of prefix.CELLS rows at most, none null: a group is ranked in one task, all of it after one shuffle."""

    def rank(value: str) -> Column:
        to = Window.partitionBy(*by).orderBy(value)  # up to the last row of an equal value
        if times is None:
            return (F.rank().over(to) + F.count(F.lit(1)).over(to)) / F.lit(2.0)
        return F.sum(times).over(to) - (F.sum(times).over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)

    return correlation(by, df.withColumn("_rx", rank(x)).withColumn("_ry", rank(y)), "_rx", "_ry", out, times)


def spearman_blocks(df: DataFrame, by: list[str], x: str, y: str, rows: int, out: str = "rho", times: str | None = None) -> DataFrame:
    """spearman of groups of any size, about so many rows in all, none null; df is read three times.

    Rows get their rank in x alone.  The sums need, of a group's rows of one y, only their number and the sum of those ranks: such cells
    are cut in blocks by y and scanned there, and what a block adds follows from the ranks within it and the number of rows in earlier ones.
    """
    c, n = F.col, F.col(times) if times else F.lit(1)
    xs = prefix.running(prefix.blocked(df.groupBy(*by, c(x).alias("_c")).agg(F.sum(n).alias("_n")), "_c", prefix.CELLS), by, "_c", "_n", "_to")
    xs = durable(xs.select(*by, "_c", "_n", (c("_to") - (c("_n") - 1) / F.lit(2.0)).alias("_rx")))
    few = xs.count() <= FEW
    kept = df.select(*by, c(x).alias("_x"), c(y).alias("_y"), n.alias("_t"))
    joined = prefix.attach(prefix.cut(kept, "_y", rows, prefix.CELLS), F.broadcast(xs) if few else xs, by, c("_x"), "_c", "_rx")
    block = [prefix.BLOCK] if prefix.BLOCK in joined.columns else []
    cells = joined.groupBy(*by, *block, "_y").agg(F.sum("_t").alias("_n"), F.sum(c("_t") * c("_rx")).alias("_s"))
    to = F.sum("_n").over(Window.partitionBy(*by, *block).orderBy("_y").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("_r", to - (c("_n") - 1) / F.lit(2.0))
    part = cells.groupBy(*by, *block).agg(F.sum("_n").alias("_n"), F.sum(c("_n") * c("_r")).alias("_y"), F.sum(c("_n") * c("_r") * c("_r")).alias("_yy"), F.sum("_s").alias("_x"), F.sum(c("_s") * c("_r")).alias("_xy"))
    # at most prefix.BLOCKS rows a group
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if block else F.lit(0)
    part = part.withColumn("_o", before.cast("double"))
    o = c("_o")
    sums = part.groupBy(*by).agg(F.sum("_n").alias("_n"), F.sum("_x").alias("_x"), F.sum(c("_y") + o * c("_n")).alias("_y"), F.sum(c("_yy") + 2 * o * c("_y") + o * o * c("_n")).alias("_yy"), F.sum(c("_xy") + o * c("_x")).alias("_xy"))
    squares = xs.groupBy(*by).agg(F.sum(c("_n") * c("_rx") * c("_rx")).alias("_xx")).select(*[c(k).alias(f"_k{i}") for i, k in enumerate(by)], "_xx")
    sums = sums.join(squares, [c(k).eqNullSafe(c(f"_k{i}")) for i, k in enumerate(by)]) if by else sums.crossJoin(squares)
    return sums.select(*by, _correlation(*(c(k) for k in ("_n", "_x", "_y", "_xx", "_yy", "_xy"))).alias(out))


def precision_weighted(df: DataFrame, by: list[str], i: str, e: str, out: str = "score") -> DataFrame:
    """2 sum(i r(e)) / sum(i) - 1, r the average rank scaled to 0..1; fewer than 3 rows or no weight gives 0."""
    ranked = average_rank(df.where(F.col(i).isNotNull() & F.col(e).isNotNull()), by, e, "_r")
    # the scale of a rank is its group's, so it is applied to the sum
    s = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(i).alias("_s"), F.sum(F.col(i) * (F.col("_r") - 1)).alias("_t"))
    return s.select(*by, F.when((F.col("_n") >= 3) & (F.col("_s") > 0), 2 * F.col("_t") / (F.col("_n") - 1 + F.lit(1e-12)) / F.col("_s") - 1).otherwise(F.lit(0.0)).alias(out))


def auroc(df: DataFrame, by: list[str], score: str, positive: str, out: str = "auroc") -> DataFrame:
    """Probability that a positive row scores above a negative one, ties counting half; one class alone gives null."""
    ranked = average_rank(df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()), by, score, "_r")
    s = ranked.groupBy(*by).agg(F.count_if(positive).alias("_p"), F.count_if(~F.col(positive)).alias("_m"), F.sum(F.when(F.col(positive), F.col("_r"))).alias("_s"))
    p, m = F.col("_p"), F.col("_m")
    return s.select(*by, F.when((p > 0) & (m > 0), (F.col("_s") - p * (p + 1) / F.lit(2.0)) / (p * m)).alias(out))


def residual(df: DataFrame, by: list[str], y: str, x: str, out: str) -> DataFrame:
    """Y less its least-squares line on x within the group; a constant x leaves the deviation from the mean."""
    w = Window.partitionBy(*by)
    n, sx, sy = F.count(F.lit(1)).over(w), F.sum(x).over(w), F.sum(y).over(w)
    sxx, sxy = F.sum(F.col(x) * F.col(x)).over(w), F.sum(F.col(x) * F.col(y)).over(w)
    d = df.withColumns({"_n": n, "_sx": sx, "_sy": sy, "_sxx": sxx, "_sxy": sxy})
    v = F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    slope = F.when(F.abs(v) > 1e-9, (F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / v).otherwise(F.lit(0.0))
    return d.withColumn("_slope", slope).withColumn(out, F.col(y) - F.col("_sy") / F.col("_n") - F.col("_slope") * (F.col(x) - F.col("_sx") / F.col("_n"))).drop("_n", "_sx", "_sy", "_sxx", "_sxy", "_slope")


def percentile_of(df: DataFrame, value: str, q: float, by: tuple[str, ...] = (), out: str = "threshold") -> DataFrame:
    """Exact percentile with linear interpolation, nulls removed; no values give 0."""
    return df.groupBy(*by).agg(F.coalesce(F.percentile(value, F.lit(q)), F.lit(0.0)).alias(out))


def empirical_pvalue(df: DataFrame, value: str, null: DataFrame, null_value: str, upper: bool = True, out: str = "p_value", by: tuple[str, ...] = (), times: str | None = None, cells_a_block: int = prefix.CELLS) -> DataFrame:
    """(1 + null values at least (at most) as extreme) / (1 + null values); null for a null value or an empty null.

    With `by`, columns of both sides, a row is held against its own group's null values.  Counts come from one pass over the union
    of distinct values: no pairing of features with null values.  A null row stands for as many as its `times` says, if that is given.
    """
    by, v = list(by), F.col(value)
    cells = df.where(v.isNotNull()).select(*by, v.alias("_v"), F.lit(0).cast("bigint").alias("_n"))
    cells = cells.unionByName(null.where(F.col(null_value).isNotNull()).select(*by, F.col(null_value).alias("_v"), (F.col(times) if times else F.lit(1)).cast("bigint").alias("_n")))
    cells = cells.groupBy(*by, "_v").agg(F.sum("_n").alias("_n"))
    cells = prefix.running(prefix.blocked(cells, "_v", cells_a_block), by, "_v", "_n", "_k", descending=upper)
    cells = prefix.totals(cells, by, "_n", "_all").select(*by, "_v", F.when(F.col("_all") > 0, (1 + F.col("_k")) / (1 + F.col("_all"))).alias(out))
    return prefix.attach(df, cells, by, v, "_v", out)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: added up as far as 64, by Euler's and Maclaurin's formula, exact to the last digits, beyond."""
    few = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.least(n, F.lit(64).cast("bigint"))), F.lit(0.0), lambda t, i: t + F.lit(1.0) / i)
    x = n.cast("double")
    return F.when(n <= 64, few).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4))))


def bh_qvalue(df: DataFrame, p: str, out: str = "q_value", dependent: bool = False, by: tuple[str, ...] = (), times: str | None = None, cells_a_block: int = prefix.CELLS) -> DataFrame:
    """X3 (X4 with dependent): least of p_j n / j over j from the row's rank on, clipped to 0..1; null for a null p.

    A q-value depends on p alone, so both scans, of ranks upwards and of minima downwards, go over distinct p-values, block by block.
    A row stands for as many as its `times` says, if that is given.
    """
    by = list(by)
    cells = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_c"))
    cells = prefix.totals(prefix.running(prefix.blocked(cells, "_p", cells_a_block), by, "_p", "_c", "_j"), by, "_c", "_n")
    raw = F.col("_p") * F.col("_n") / F.col("_j") * (harmonic(F.col("_n")) if dependent else F.lit(1.0))
    cells = prefix.running(cells.withColumn("_raw", raw), by, "_p", "_raw", "_q", how="min", descending=True)
    return prefix.attach(df, cells.withColumn(out, F.least(F.greatest("_q", F.lit(0.0)), F.lit(1.0))), by, F.col(p), "_p", out)


def moving_average_same(df: DataFrame, by: list[str], order: str, value: str, width: int, out: str) -> DataFrame:
    """Centred moving sum over width rows by the divisor width, also at the edges, where zeros are added."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn(out, F.sum(value).over(w) / F.lit(float(width)))
