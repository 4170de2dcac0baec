"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import LOWER, UPPER, free_name, lower_ascii, numbered, small_batches, stored, table, without

KEY = ["digest", "check", "n_bytes"]


def _merged(rows: DataFrame, best, count) -> DataFrame:
    """Rows brought together by run and digest range, put in order there, and merged in one pass over the sorted stream.

    The aggregate's keys start with those of the exchange and of the sort, so Spark adds neither to it.
    """
    order = ["run", "range", *KEY]
    return rows.repartition("run", "range").sortWithinPartitions(*order).groupBy(*order).agg(best.alias("best"), count.alias("n"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in_bits: int = 4, rid_col: str | None = None) -> DataFrame:
    """One row for each row of df: rid, <id_col>, digest (binary), keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of a group the row with the
    largest (keep="max") or smallest (keep="min") id stays; a null id loses to any other; of rows that repeat
    the id too, the one of least rid stays.  An empty table gives an empty table; other columns don't matter.
    rid_col names a column of row numbers that df has; without one rows are numbered and the numbers written down.

    Each input partition makes a run of its distinct digests in order, with the extreme id and a count.  In every
    round runs whose numbers agree but for the last fan_in_bits bits are exchanged and merged, so a digest meets
    2**fan_in_bits entries at most, however many rows share it.  A run is cut in ranges of digests, as many as there
    are runs at first, so the last one isn't a single task's.  A second hash and the length travel along and entries
    merge only if all three agree.  The last level's winner goes back to the runs, then from a run to its rows: a hot
    group is spread over the runs that hold it.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is max or min")
    pick, sign = (F.max, -1) if keep == "max" else (F.min, 1)
    # struct order: for max, null ids come last by nature; for min the flag in front sees to it
    flag = F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()
    rid = F.col(f"`{rid_col}`") if rid_col else F.monotonically_increasing_id()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), lower_ascii(text_col).alias("normal"), rid.alias("rid"))
    rows = rows.select("id", "rid", F.unhex(F.sha2("normal", 256)).alias("digest"), F.xxhash64("normal").alias("check"), F.octet_length("normal").alias("n_bytes"), F.spark_partition_id().alias("run"))
    # written once: both the way up and the way down read the same numbers
    rows = stored(rows)
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    bits = min(24, (n_runs - 1).bit_length())
    first = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int")
    entry = F.struct(flag.alias("flag"), F.col("id"), (F.col("rid") * sign).alias("order"))
    leaves = stored(_merged(rows.withColumn("range", F.shiftright(first, 24 - bits)), pick(entry), F.count(F.lit(1))))
    level = leaves
    for _ in range(-(-bits // fan_in_bits)):
        level = _merged(level.withColumn("run", F.shiftright("run", fan_in_bits)), pick("best"), F.sum("n"))
    winners = level.select(*KEY, F.col("best").alias("winner"), F.col("n").alias("group_size"))
    homes = leaves.select("run", *KEY).join(winners, KEY)
    return rows.join(homes, ["run", *KEY]).select(
        "rid",
        F.col("id").alias(id_col),
        "digest",
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("rid") * sign == F.col("winner.order")).alias("kept"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """df without the rows that another row of equal text replaces; columns as they were, null and empty texts one group.

    Rows are numbered once, in a table written for the purpose, so which rows go doesn't depend on how a scan is split.
    Texts are shuffled only if a bitmap of the dropped rows, which are the fewer, has a mark for them.
    """
    rid = free_name(df, "rid")
    rows = numbered(small_batches(df), rid)
    dropped = exact_duplicates(rows, id_col, text_col, keep, rid_col=rid).where("NOT kept").select(F.col("rid").alias(rid))
    return without(rows, dropped, rid).drop(rid)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
