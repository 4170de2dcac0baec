"""Running sums, running minima and ranks in value order, at any size: a scan in two levels.

Splitters cut the range of values in blocks of about equally many cells.  A block is scanned by itself, and the totals of a group's
earlier blocks, of which there are a bounded number, are brought to it.  As splitters are those of all cells,
no group has more cells in a block than the block has, however much of the table it holds.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.durable import durable

#: Cells of a block, about, and blocks at most; the latter bounds what the driver and a window over blocks hold.
CELLS, BLOCKS = 250_000, 1000
BLOCK = "_block"


def blocked(cells: DataFrame, value: str, cells_a_block: int = CELLS) -> DataFrame:
    """cells, written down once, with the block of each one's value, which isn't null; blocks are in order of the values.

    Splitters are approximate quantiles, and no result hangs on which they are.  Where one block holds all cells, there is no column
    for it and running() takes each group in one go.
    """
    kept = durable(cells)
    return cut(kept, value, kept.count(), cells_a_block)


def cut(df: DataFrame, value: str, rows: int, rows_a_block: int = CELLS) -> DataFrame:
    """df, of about so many rows, with the block of each one's value, as blocked() has it; df is read once more for the splitters."""
    at = F.col(value).cast("double")
    blocks = min(BLOCKS, -(-rows // rows_a_block))
    if blocks <= 1:
        return df
    marks = df.agg(F.percentile_approx(at, F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), F.lit(10 * blocks))).first()[0]
    ends = sorted({m + 0.0 for m in marks or ()} - {float("inf"), float("-inf")})
    ends = [e for e in ends if e == e]
    if not ends:
        return df
    split = Bucketizer(splits=[float("-inf"), *ends, float("inf")], inputCol="_at", outputCol=BLOCK, handleInvalid="keep")
    return split.transform(df.withColumn("_at", at)).drop("_at")


def running(cells: DataFrame, by: list[str], value: str, column: str, out: str, how: str = "sum", descending: bool = False) -> DataFrame:
    """cells of blocked() with <out>: the sum, min or max of <column> over the group's cells from the first in value order to this one.

    Each (by, value) is one cell, and by may hold nulls.
    """
    total, join = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}[how]
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    own = Window.partitionBy(*by, *([BLOCK] if BLOCK in cells.columns else [])).orderBy(turn(F.col(value))).rowsBetween(Window.unboundedPreceding, 0)
    if BLOCK not in cells.columns:  # CELLS or fewer in all
        return cells.withColumn(out, total(column).over(own))
    blocks = cells.groupBy(*by, BLOCK).agg(total(column).alias("_total"))
    # at most BLOCKS rows a group
    before = Window.partitionBy(*by).orderBy(turn(F.col(BLOCK))).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", total("_total").over(before)).where(F.col("_before").isNotNull())
    keys = [*by, BLOCK]
    blocks = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    scanned = cells.withColumn("_own", total(column).over(own)).join(blocks, on, "left")
    both = F.when(F.col("_before").isNull(), F.col("_own")).otherwise(join(F.col("_own"), F.col("_before")))
    return scanned.withColumn(out, both).drop("_own", "_before", *[f"_k{i}" for i in range(len(keys))])


def totals(cells: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """cells with the sum of <column> over the group, by partial sums and a join."""
    if not by:
        return cells.crossJoin(F.broadcast(cells.agg(F.sum(column).alias(out))))  # one row
    sums = cells.groupBy(*by).agg(F.sum(column).alias(out)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], out)
    return cells.join(sums, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]).drop(*[f"_k{i}" for i in range(len(by))])


def attach(df: DataFrame, cells: DataFrame, by: list[str], value: Column, at: str, *outs: str) -> DataFrame:
    """df with columns of the cell of each row's group and value; null where it has none.  A hot value is split by the join."""
    held = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col(at).alias("_v"), *outs)
    on = [value == F.col("_v"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by))]
    return df.join(held, on, "left").drop("_v", *[f"_k{i}" for i in range(len(by))])


def average_rank(df: DataFrame, by: list[str], value: str, out: str, cells_a_block: int = CELLS, times: str | None = None) -> DataFrame:
    """df with the rank of each row's value in its group, ties sharing their mean rank; null for a null value.

    A row stands for as many as its `times` says, if that is given.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_c")).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_n"))
    cells = running(blocked(cells, "_c", cells_a_block), by, "_c", "_n", "_to")
    return attach(df, cells.withColumn("_rank", F.col("_to") - (F.col("_n") - 1) / F.lit(2.0)), by, F.col(value), "_c", "_rank").withColumnRenamed("_rank", out)


def row_ranks(df: DataFrame, order: str, key: str, out: str, cells_a_block: int = CELLS) -> DataFrame:
    """df with each row's number from 1 on in the order of a column without nulls, rows of equal values in that of the key.

    Only rows of equal values are brought together, so the order should have few such: a draw, say.
    """
    cells = running(blocked(df.groupBy(F.col(order).alias("_c")).agg(F.count(F.lit(1)).alias("_n")), "_c", cells_a_block), [], "_c", "_n", "_to")
    ties = df.withColumn("_i", F.row_number().over(Window.partitionBy(order).orderBy(key)))
    return attach(ties, cells, [], F.col(order), "_c", "_to", "_n").withColumn(out, F.col("_to") - F.col("_n") + F.col("_i")).drop("_to", "_n", "_i")


def last_at_or_before(points: DataFrame, marks: DataFrame, at: str, mark: str, out: str, cells_a_block: int = CELLS) -> DataFrame:
    """points with <out>: the largest mark that is no larger than the point's <at>; null where there is none or <at> is null.

    One scan over the union of both sides' distinct values, so neither side is held in one place.
    """
    side = lambda d, c, m: d.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_c")).agg(m.alias("_m"))
    cells = side(points, at, F.max(F.lit(None).cast(marks.schema[mark].dataType))).unionByName(side(marks, mark, F.max(mark)))
    cells = running(blocked(cells.groupBy("_c").agg(F.max("_m").alias("_m")), "_c", cells_a_block), [], "_c", "_m", "_last", how="max")
    return attach(points, cells, [], F.col(at), "_c", "_last").withColumnRenamed("_last", out)


def least_rows(df: DataFrame, draw: str, key: str, n: int, most: int = 20_000) -> DataFrame:
    """Exactly n rows of df (all if fewer): those of least (draw, key).

    draw is a bigint, key an order among rows of equal draws; rows with a null in either don't count.  The n-th least draw is found by
    counting in digits of 16 bits, the top one first, then those below what was found, until `most` rows or fewer are left in question; these
    few draws and keys come to the driver and decide, and the rows are filtered where they are.  More than `most` rows with one draw
    are an error: they aren't draws.  Of rows that repeat both draw and key any may be taken.
    """
    known = df.where(F.col(draw).isNotNull() & F.col(key).isNotNull())
    digits = F.col(draw).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))  # ordered as unsigned numbers are
    left, prefix, bits = n, 0, 64
    while True:
        # rows in question: those whose digits above `bits` are the prefix
        least = (prefix << bits) - (1 << 63)
        asked = known if bits == 64 else known.where(F.col(draw).between(least, least + (1 << bits) - 1))
        if bits == 0:
            raise ValueError(f"more than {most} rows have the draw {least}")
        bits -= 16
        counts = sorted(asked.groupBy(F.shiftrightunsigned(digits, bits).bitwiseAND(F.lit(0xFFFF)).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        if left >= sum(c for _, c in counts):
            return known  # all of them; below the top digit fewer are left than there are
        for d, c in counts:
            if left < c:
                break
            left -= c
        prefix = prefix << 16 | d
        if c <= most:
            break
    least = (prefix << bits) - (1 << 63)
    below, asked = known.where(F.col(draw) < least), known.where(F.col(draw).between(least, least + (1 << bits) - 1))
    if not left:
        return below
    pairs = sorted(tuple(r) for r in asked.select(draw, key).collect())
    last = pairs[left - 1]
    first = asked.where((F.col(draw) < last[0]) | ((F.col(draw) == last[0]) & (F.col(key) < F.lit(last[1]))))
    ties = asked.where((F.col(draw) == last[0]) & (F.col(key) == F.lit(last[1])))
    return below.unionByName(first).unionByName(ties.limit(left - sum(p < last for p in pairs)))
