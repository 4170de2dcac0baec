"""Connected components of a distributed edge list, and sending a group's values back to its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import durable

#: Copies of a star's centre: its neighbours, which may be a third of all nodes, are dealt over them.
SALTS = 16


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node u hands the least node m it sees to its neighbours; large keeps those above u."""
    seen = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    joined = salted.join(least.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))), ["u", "salt"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the least node of its component.

    Alternating large and small stars: each round a few joins on nodes, whose rows never exceed the edges; the
    rounds grow with the logarithm of the longest chain.  Every round is cut by a checkpoint in the shared folder.
    No group is ever gathered in one task: least neighbours come from partial aggregates, and go back by salted copies.
    """
    now = durable(edges.select("u", "v").where("u <> v").distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = durable(_stars(_stars(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def send_back(rows: DataFrame, key: list[str], values: DataFrame) -> DataFrame:
    """rows (with a column run) joined with one row of values for each key, left outer; keys have no nulls.

    A key may hold a third of the rows: values first go to the runs that have the key, then to those runs' rows.
    """
    homes = rows.select("run", *key).distinct().join(values, key)
    return rows.join(homes, ["run", *key], "left")
