"""Job 2, batch: from dated measurements to a report on which features line up with them, by element and by locus.

    python -m jobs.alignment_report --measurements PATH --output PATH [--months 1994-03,1994-04] [--config FILE]

Sums of the alignment fact that merge are kept in partitions (month); a run replaces those of the months it is given, or all.
The report is made anew from all sums, in partitions (level, label).  Both writes replace what they write, so a
run can be repeated, also after one that broke off.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import alignment
from helixframe.plans import align_queries
from jobs.common import logger, new_folder, session, settings

#: Rows of months without a date.
UNDATED = "undated"


def monthly_sums(measurements: DataFrame) -> DataFrame:
    """(month, side, feature_id, elem_id, d, q, n): sums of integers, so that they merge exactly in any order."""
    month = F.coalesce(F.date_format("l_shipdate", "yyyy-MM"), F.lit(UNDATED))
    keys = (month.alias("month"), F.col("l_returnflag").alias("side"), F.col("l_suppkey").alias("feature_id"), (F.col("l_partkey") % 29).alias("elem_id"))
    d, q = F.round(F.col("l_discount") * 100).cast("bigint"), F.col("l_quantity").cast("bigint")
    return measurements.groupBy(*keys).agg(F.sum(d).alias("d"), F.sum(q).alias("q"), F.count(F.lit(1)).alias("n"))


def of_months(measurements: DataFrame, months: list[str]) -> DataFrame:
    """Rows of some months, by ranges of dates that the scan can use."""
    date, which = F.col("l_shipdate"), F.lit(False)
    for m in months:
        begin = F.to_timestamp(F.lit(f"{m}-01")).cast("timestamp_ntz")
        which = which | (date.isNull() if m == UNDATED else (date >= begin) & (date < F.add_months(begin, 1).cast("timestamp_ntz")))
    return measurements.where(which)


def fact(sums: DataFrame, side: str, loci: int) -> DataFrame:
    """align(feature_id, elem_id, locus, a_f, mass) of one side over all months."""
    s = sums.where(F.col("side") == side).groupBy("feature_id", "elem_id").agg(*(F.sum(c).alias(c) for c in ("d", "q", "n")))
    a_f = F.round((F.col("d") / F.col("n") - 5) / 5, 9)
    return s.select("feature_id", "elem_id", (F.col("elem_id") % loci).alias("locus"), a_f.alias("a_f"), F.round(F.col("q") / F.col("n"), 9).alias("mass"))


def report(real: DataFrame, null: DataFrame, percentile: float, min_active: int) -> DataFrame:
    """The causal test with loci as units and with elements as their own loci."""
    own = lambda d: d.withColumn("locus", F.col("elem_id"))
    levels = {"locus": (real, null), "element": (own(real), own(null))}
    parts = [alignment.causal_test(*sides, pct=percentile, min_active=min_active).withColumn("level", F.lit(level)) for level, sides in levels.items()]
    return parts[0].unionByName(parts[1])


def run(spark: SparkSession, measurements: str, output: str, config: dict, months: list[str] | None = None) -> DataFrame:
    """Brings the sums of the given months (or all) up to date and writes the report, which it returns as read back."""
    log, seen = logger("alignment_report"), Observation()
    rows = spark.read.parquet(measurements)
    rows = rows if months is None else of_months(rows, months)
    sums = monthly_sums(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    mode = "static" if months is None else "dynamic"
    sums.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("month").parquet(f"{output}/sums")
    log.info("read %d rows of %s (%s), wrote sums to %s/sums", seen.get["n"], measurements, "all months" if months is None else ", ".join(months), output)
    kept = spark.read.parquet(f"{output}/sums")
    out = report(fact(kept, "R", config["loci"]), fact(kept, "N", config["loci"]), config["percentile"], config["min_active"])
    out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("level", "label").parquet(f"{output}/report")
    done = read(spark, output)
    log.info("wrote %d rows to %s/report", done.count(), output)
    return done


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(f"{output}/report")


def job2_alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all measurements into one new folder, and the report as it stands after the second."""
    out, config = new_folder(spark, "alignment-report"), settings(__file__)
    for _ in range(2):
        run(spark, f"{sf_dir}/lineitem.parquet", out, config)
    done = read(spark, out)
    return done.select("level", "label", "feature_id", "A_f", "n_active", F.round("mean_mass", 6).alias("mean_mass"), "p_value", F.round("q_value", 9).alias("q_value"), F.round("threshold", 9).alias("threshold"))


def _level_sql(level: str, real: str, null: str) -> str:
    """The causal test of one level; real and null name its rows (feature_id, a_f, mass)."""
    A = align_queries
    return f"""SELECT '{level}' AS level, CASE WHEN A_f > t THEN 'causal' ELSE 'correlational' END AS label, feature_id, A_f, n_active, round(mean_mass, 6) AS mean_mass,
  p AS p_value, round(q, 9) AS q_value, round(t, 9) AS threshold
FROM (WITH {A._features_sql('rf', real)}, {A._features_sql('nf', null)}, {A._THR}, {A._P}, {A._q_sql('qv', 'pv')} SELECT * FROM qv, thr)"""


_UNITS = "{} AS (SELECT feature_id, round(a_f + 1e-12, 9) AS a_f, mass FROM {})"
SQL = f"""WITH {align_queries._LOCI}, {_UNITS.format('re', 'real')}, {_UNITS.format('ne', 'nul')}
{_level_sql('locus', 'rl', 'nl')} UNION ALL {_level_sql('element', 're', 'ne')}"""


def main(words: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Reports which features line up with the measurements.")
    for name in ("measurements", "output"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--months", help="months to bring up to date, comma-separated, as 1994-03; all if not given")
    args.add_argument("--config")
    given = args.parse_args(words)
    spark = session("alignment_report")
    try:
        run(spark, given.measurements, given.output, settings(__file__, given.config), given.months.split(",") if given.months else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
