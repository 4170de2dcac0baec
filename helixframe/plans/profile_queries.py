"""Driver queries over profiles (events as elements) and the assay view of lineitem."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixframe.durable import shared_dir
from helixframe.functions import stats
from helixframe.operators import metrics as M
from helixframe.plans.registry import query
from helixframe.sources import folders
from helixframe.sources import genome as G
from helixframe.sources import tables as T

_P = f"WITH p AS ({T.PROFILE_SQL})"


def _rank_sql(value: str, source: str = "p") -> str:
    return f"rank() OVER (PARTITION BY elem ORDER BY {value}) + (count(*) OVER (PARTITION BY elem, {value}) - 1) / 2.0::DOUBLE"


def _corr_sql(source: str) -> str:
    return f"""SELECT elem, round(CASE WHEN n >= 3 AND n * xx - x * x > 0 AND n * yy - y * y > 0 THEN (n * xy - x * y) / (sqrt(n * xx - x * x) * sqrt(n * yy - y * y)) ELSE 0.0::DOUBLE END, 8) AS score
FROM (SELECT elem, count(*) AS n, sum(a) AS x, sum(b) AS y, sum(a * a) AS xx, sum(b * b) AS yy, sum(a * b) AS xy FROM {source} GROUP BY 1)"""


def _rounded(df, digits=8):
    return df.withColumn("score", F.round("score", digits))


@query(f"{_P}, r AS (SELECT elem, {_rank_sql('i')} AS a, {_rank_sql('e')} AS b FROM p) {_corr_sql('r')}")
def spearman_all(spark, sf_dir):
    return _rounded(M.spearman_all(T.profile(spark, sf_dir)))


@query(f"{_P}, q AS (SELECT * FROM p WHERE i > 1e-9), r AS (SELECT elem, {_rank_sql('i')} AS a, {_rank_sql('e')} AS b FROM q), s AS ({_corr_sql('r')}) SELECT elem, coalesce(score, 0.0::DOUBLE) AS score FROM (SELECT DISTINCT elem FROM p) LEFT JOIN s USING (elem)")
def spearman_active(spark, sf_dir):
    return _rounded(M.spearman_active(T.profile(spark, sf_dir)))


_PW = """SELECT elem, round(CASE WHEN n >= 3 AND s > 0 THEN 2 * t / s - 1 ELSE 0.0::DOUBLE END, 6) AS score
FROM (SELECT elem, count(*) AS n, sum(i) AS s, sum(i * (b - 1) / (m - 1 + 1e-12)) AS t FROM r GROUP BY 1)"""


@query(f"{_P}, r AS (SELECT elem, i, count(*) OVER (PARTITION BY elem) AS m, {_rank_sql('e')} AS b FROM p) {_PW}")
def precision_weighted(spark, sf_dir):
    return _rounded(M.precision_weighted(T.profile(spark, sf_dir)), 6)


_SUB = """sens AS (SELECT elem, pos // 4 AS pos, pos % 4 AS alt, i FROM p), eff AS (SELECT elem, pos // 4 AS pos, 3 - pos % 4 AS alt, e FROM p)"""


@query(f"{_P}, {_SUB}, j AS (SELECT * FROM sens JOIN eff USING (elem, pos, alt)), r AS (SELECT elem, i, count(*) OVER (PARTITION BY elem) AS m, {_rank_sql('e')} AS b FROM j) {_PW}")
def precision_weighted_alt(spark, sf_dir):
    p = T.profile(spark, sf_dir)
    cut = F.floor(F.col("pos") / 4).alias("pos")
    return _rounded(M.precision_weighted_alt(p.select("elem", cut, (F.col("pos") % 4).alias("alt"), "i"), p.select("elem", cut, (3 - F.col("pos") % 4).alias("alt"), "e")), 6)


@query(f"""{_P}, g AS (SELECT elem, i, e, pos % 5 AS gc FROM p), r AS (SELECT elem, {_rank_sql('i')} AS x, {_rank_sql('e')} AS y, {_rank_sql('gc')} AS z FROM g),
s AS (SELECT elem, count(*) AS n, sum(z) AS sz, sum(z * z) AS zz, sum(x) AS sx, sum(y) AS sy, sum(x * z) AS xz, sum(y * z) AS yz FROM r GROUP BY 1),
d AS (SELECT elem, n, x - sx / n - (CASE WHEN abs(n * zz - sz * sz) > 1e-9 THEN (n * xz - sx * sz) / (n * zz - sz * sz) ELSE 0 END) * (z - sz / n) AS a,
             y - sy / n - (CASE WHEN abs(n * zz - sz * sz) > 1e-9 THEN (n * yz - sy * sz) / (n * zz - sz * sz) ELSE 0 END) * (z - sz / n) AS b FROM r JOIN s USING (elem))
SELECT elem, round(CASE WHEN count(*) >= 3 AND sum(a * a) > 1e-9 AND sum(b * b) > 1e-9 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) ELSE 0.0::DOUBLE END, 6) AS score FROM d GROUP BY 1""")
def partial_gc(spark, sf_dir):
    return _rounded(M.partial_gc(T.profile(spark, sf_dir).withColumn("gc", F.col("pos") % 5)), 6)


@query(f"""{_P}, m AS (SELECT elem, median(e) AS mid FROM p GROUP BY 1), r AS (SELECT elem, {_rank_sql('i')} AS k, e > mid + 1e-12 AS y FROM p JOIN m USING (elem)),
s AS (SELECT elem, count(*) FILTER (y) AS a, count(*) FILTER (NOT y) AS b, sum(k) FILTER (y) AS t FROM r GROUP BY 1)
SELECT elem, round(CASE WHEN a > 0 AND b > 0 THEN 2 * (t - a * (a + 1) / 2.0::DOUBLE) / (a * b) - 1 ELSE 0.0::DOUBLE END, 8) AS score FROM s""")
def overlap_auroc(spark, sf_dir):
    return _rounded(M.overlap_auroc(T.profile(spark, sf_dir)))


@query(f"{_P} SELECT elem, pos, round(sum(e) OVER (PARTITION BY elem ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11.0::DOUBLE, 8) AS smooth FROM p")
def moving_average_same(spark, sf_dir):
    return stats.moving_average_same(T.profile(spark, sf_dir), ["elem"], "pos", "e", 11, "smooth").select("elem", "pos", F.round("smooth", 8).alias("smooth"))


_W3 = "OVER (PARTITION BY elem ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0::DOUBLE"


@query(f"{_P}, a AS (SELECT elem, pos, sum(e) {_W3} AS v FROM p) SELECT elem, pos, round(sum(v) {_W3}, 8) AS v FROM a")
def layer_smoothing(spark, sf_dir):
    """W6 for layer 3: two rounds of the three-wide average."""
    p = T.profile(spark, sf_dir)
    p = stats.moving_average_same(p, ["elem"], "pos", "e", 3, "v")
    return stats.moving_average_same(p, ["elem"], "pos", "v", 3, "v2").select("elem", "pos", F.round("v2", 8).alias("v"))


_ASSAY = """WITH raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS Element, CAST(l_partkey % 40 AS INT) AS Position, 'ACGT'[CAST(l_linenumber % 4 AS INT) + 1] AS Ref,
 'ACGT-'[CAST(l_orderkey % 5 AS INT) + 1] AS Alt, round(l_discount - 0.05, 2) AS Coefficient, (l_orderkey * 8 + l_linenumber) * 10000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS row FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT * FROM raw WHERE Alt <> '-')"""


def _assay(spark, sf_dir, rows="l_returnflag = 'R'", *more):
    d = T.read(spark, sf_dir, "lineitem").where(rows)
    raw = d.select(
        F.col("l_suppkey").cast("string").alias("Element"), (F.col("l_partkey") % 40).alias("Position"), F.expr("substr('ACGT', cast(l_linenumber % 4 as int) + 1, 1)").alias("Ref"),
        F.expr("substr('ACGT-', cast(l_orderkey % 5 as int) + 1, 1)").alias("Alt"), F.round(F.col("l_discount") - 0.05, 2).alias("Coefficient"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000_000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("order"), *more
    )
    table = G.assay_table(raw.drop("order"))
    # the driver's rows have an order of their own, which stands for the order in a file
    return table.drop("row"), raw


@query(f"{_ASSAY} SELECT Element AS element, count(*) AS n, count(DISTINCT Position) AS n_pos FROM a GROUP BY 1")
def assay_filter(spark, sf_dir):
    return _assay(spark, sf_dir)[0].groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("n_pos"))


@query(f"""{_ASSAY}, c AS (SELECT Element AS element, Position AS pos, Alt, arg_max(Coefficient, row) AS eff, arg_max(Ref, row) AS ref, max(row) AS row FROM a GROUP BY ALL),
t AS (SELECT element, pos, sum(abs(eff)) / greatest(1, count(*) FILTER (eff <> 0)) AS e_mean, sum(eff) / greatest(1, count(*) FILTER (eff <> 0)) AS e_signed, max(abs(eff)) AS e_max, arg_max(ref, row) AS ref FROM c GROUP BY ALL),
g AS (SELECT element, CAST(unnest(range(min(pos), max(pos) + 1)) AS INT) AS pos FROM t GROUP BY element HAVING max(pos) - min(pos) + 1 >= 10)
SELECT element, pos, coalesce(ref, 'A') AS ref, round(coalesce(e_mean, 0), 6) + 0.0::DOUBLE AS e_mean, round(coalesce(e_signed, 0), 6) + 0.0::DOUBLE AS e_signed, round(coalesce(e_max, 0), 6) + 0.0::DOUBLE AS e_max FROM g LEFT JOIN t USING (element, pos)""")
def assay_pivot(spark, sf_dir):
    _, raw = _assay(spark, sf_dir)
    ordered = raw.where(F.col("Alt") != "-").select(F.col("Element").alias("element"), F.col("Position").cast("int").alias("pos"), F.col("Ref").alias("ref"), F.col("Alt").alias("alt"), F.col("Coefficient").alias("eff"), F.col("order").alias("row"))
    out = G.assay_elements(ordered)
    return out.select("element", "pos", "ref", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("e_mean", "e_signed", "e_max")])


@query(f"""WITH raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS element, CAST(l_partkey % 40 AS INT) AS pos, 'ACGT'[CAST(l_linenumber % 4 AS INT) + 1] AS ref, 'ACGT-'[CAST(l_orderkey % 5 AS INT) + 1] AS alt,
 round(l_discount - 0.05, 2) AS eff, (l_orderkey * 8 + l_linenumber) * 10000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS row, l_linestatus FROM lineitem WHERE l_returnflag <> 'A'),
a AS (SELECT * FROM raw WHERE alt <> '-' AND l_linestatus = 'O'), c AS (SELECT element, pos, alt, arg_max(eff, row) AS eff, arg_max(ref, row) AS ref, max(row) AS row FROM a GROUP BY ALL),
t AS (SELECT element, pos, sum(abs(eff)) / greatest(1, count(*) FILTER (eff <> 0)) AS e_mean, max(abs(eff)) AS e_max, sum(abs(eff)) AS size, arg_max(ref, row) AS ref FROM c GROUP BY ALL),
g AS (SELECT element, CAST(unnest(range(min(pos), max(pos) + 1)) AS INT) AS pos FROM t GROUP BY element HAVING max(pos) - min(pos) + 1 >= 10)
SELECT element AS elem_id, string_agg(coalesce(ref, 'A'), '' ORDER BY pos) AS seq, round(coalesce(sum(e_mean), 0), 6) AS e_mean, round(coalesce(max(e_max), 0), 6) AS e_max, round(coalesce(sum(size), 0), 6) AS e_alt FROM g LEFT JOIN t USING (element, pos) GROUP BY 1""")
def assay_folder(spark, sf_dir):
    """Line items as a folder of CSV tables of two releases, read back as elements by the source's name."""
    _, raw = _assay(spark, sf_dir, "l_returnflag <> 'A'", F.when(F.col("l_linestatus") == "O", "GRCh38").otherwise("GRCh37").alias("Release"))
    folder = f"{shared_dir(spark)}/assay-{uuid.uuid4().hex}"
    # files follow one another by name as the driver's rows do by their order
    raw.orderBy("order").drop("order").write.option("header", True).csv(folder)
    out = folders.load_elements(spark, "assay", folder, "GRCh38")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x)
    return out.select("elem_id", "seq", F.round(total("e_mean"), 6).alias("e_mean"), F.round(F.array_max("e_max"), 6).alias("e_max"), F.round(F.aggregate("e_alt", F.lit(0.0), lambda t, x: t + total(x)), 6).alias("e_alt"))
