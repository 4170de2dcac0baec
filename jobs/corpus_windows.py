"""Job 1, incremental: keeps a corpus of sequence windows up to date with a growing folder of documents.

    python -m jobs.corpus_windows --documents PATH --output PATH --checkpoint PATH [--config FILE]

A file stream with a checkpoint takes the files of --documents that no earlier run took.  Their texts' bases are cut in windows of
equal length; windows of low complexity or extreme GC go, and of windows that are equal, or each other's reverse complement, one
stays over all runs.  A micro-batch writes its windows to partitions (batch, cls) of its own and replaces them if it is run
again after a failure, so that a run can be repeated at any time.
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.sequence import reverse_complement
from helixframe.sources import tables
from jobs.common import logger, new_folder, session, settings

SCHEMA = "seq_id bigint, start int, seq string, gc double, digest string, copies bigint, batch bigint, cls string"


def windows(corpus: DataFrame, window: int, stride: int, longest_run: int, least_gc: float, most_gc: float) -> DataFrame:
    """(seq_id, cls, start, seq, gc, digest) of the whole windows of corpus(seq_id, cls, seq) that are complex enough.

    digest is that of the window or of its reverse complement, whichever comes first.  A window goes if one base repeats more than
    longest_run times in a row or its GC share is outside the bounds.  Null and short sequences have none.
    """
    starts = F.when(F.length("seq") >= window, F.sequence(F.lit(0), F.length("seq") - window, F.lit(stride)))
    cut = corpus.select("seq_id", "cls", F.explode(F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(F.col("seq"), i + 1, F.lit(window)).alias("seq")))).alias("w"))
    cut = cut.select("seq_id", "cls", "w.start", "w.seq", (F.length(F.translate("w.seq", "AT", "")) / F.lit(window)).alias("gc"))
    runs = "|".join(f"{base}{{{longest_run + 1}}}" for base in tables.ACGT)
    return cut.where(F.col("gc").between(least_gc, most_gc) & ~F.col("seq").rlike(runs)).withColumn("digest", F.sha2(F.least("seq", reverse_complement(F.col("seq"))), 256))


def distinct(cut: DataFrame) -> DataFrame:
    """Of each digest the window of least (seq_id, start), with the number of copies.  Tasks aggregate first, so a hot window is a row a task."""
    best = cut.groupBy("digest").agg(F.min(F.struct("seq_id", "start", "cls", "seq", "gc")).alias("w"), F.count(F.lit(1)).alias("copies"))
    return best.select("w.seq_id", "w.start", "w.seq", "w.gc", "digest", "copies", "w.cls")


def _before(spark: SparkSession, output: str, batch: int) -> DataFrame | None:
    """Digests that earlier batches wrote."""
    try:
        return spark.read.schema(SCHEMA).parquet(output).where(F.col("batch") < batch).select("digest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> int:
    """Takes what is new below `documents` (Parquet with doc_id, text and lang) and returns how many rows that were."""
    log, limits, rows = logger("corpus_windows"), {k: v for k, v in config.items() if k != "files_a_batch"}, 0

    def put(docs: DataFrame, batch: int) -> None:
        spark = docs.sparkSession
        new = distinct(windows(tables.sequences(docs), **limits))
        if (before := _before(spark, output, batch)) is not None:
            new = new.join(before, "digest", "left_anti")
        new.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "cls").parquet(output)
        log.info("batch %d: wrote %d windows to %s", batch, spark.read.schema(SCHEMA).parquet(output).where(F.col("batch") == batch).count(), output)

    source = spark.readStream.schema(spark.read.parquet(documents).select("doc_id", "text", "lang").schema)
    if config["files_a_batch"]:
        source = source.option("maxFilesPerTrigger", config["files_a_batch"])
    stream = source.parquet(documents).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = sum(p["numInputRows"] for p in stream.recentProgress)
    log.info("read %d new rows of %s", rows, documents)
    return rows


def read(spark: SparkSession, output: str) -> DataFrame:
    """All windows that the runs so far have written."""
    return spark.read.schema(SCHEMA).parquet(output)


def job1_corpus_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all documents into one new folder, and what stands there after the second.

    The table is a folder or a single file; a stream takes the latter by a pattern only.
    """
    out, config = new_folder(spark, "corpus-windows"), settings(__file__)
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet*", f"{out}/windows", f"{out}/checkpoint", config)
    return read(spark, f"{out}/windows").select("seq_id", "start", "cls", "seq", "gc", "digest", "copies")


_C = settings(__file__)
SQL = f"""WITH corpus AS ({tables.CORPUS_SQL}),
cut AS (SELECT seq_id, cls, CAST(start AS INTEGER) AS start, substr(seq, start + 1, {_C['window']}) AS seq
        FROM (SELECT *, unnest(range(0, length(seq) - {_C['window']} + 1, {_C['stride']})) AS start FROM corpus)),
kept AS (SELECT *, length(translate(seq, 'AT', '')) / {_C['window']}::DOUBLE AS gc FROM cut
         WHERE NOT regexp_matches(seq, '{"|".join(f"{b}{{{_C['longest_run'] + 1}}}" for b in tables.ACGT)}')),
named AS (SELECT *, sha256(least(seq, reverse(translate(seq, 'ACGT', 'TGCA')))) AS digest FROM kept WHERE gc BETWEEN {_C['least_gc']} AND {_C['most_gc']})
SELECT seq_id, start, cls, seq, gc, digest, copies
FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY seq_id, start) AS k, count(*) OVER (PARTITION BY digest) AS copies FROM named) WHERE k = 1"""


def main(words: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Keeps a corpus of sequence windows up to date.")
    for name in ("documents", "output", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args(words)
    spark = session("corpus_windows")
    try:
        run(spark, given.documents, given.output, given.checkpoint, settings(__file__, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
