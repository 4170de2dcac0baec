"""Views of the driver's tables in the shape of the domain: same columns and keys, no biological meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACGT = "ACGT"
#: Numbers of the integer generator that all draws come from.
LCG_A, LCG_M = 48271, 2147483647


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def align(spark: SparkSession, sf_dir: str, flag: str = "R") -> DataFrame:
    """D10 from lineitem: flag R is the real side, N the null, A a second run.  Sums are of integers, so exact."""
    f = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    s = f.groupBy(F.col("l_suppkey").alias("feature_id"), (F.col("l_partkey") % 29).alias("elem_id")).agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("d"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.count(F.lit(1)).alias("n")
    )
    return s.select("feature_id", "elem_id", (F.col("elem_id") % 21).alias("locus"), F.round((F.col("d") / F.col("n") - 5) / 5, 9).alias("a_f"), F.round(F.col("q") / F.col("n"), 9).alias("mass"))


def align_sql(flag: str = "R") -> str:
    return f"""SELECT feature_id, elem_id, elem_id % 21 AS locus, round((d / n - 5) / 5, 9) AS a_f, round(q / n, 9) AS mass
        FROM (SELECT l_suppkey AS feature_id, l_partkey % 29 AS elem_id, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS d,
                     CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS q, count(*) AS n
              FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY ALL)"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles (elem, pos, i, e) from events: a user's events in order of time; e is the property k."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("elem"), pos.alias("pos"), F.round("value", 6).alias("i"), F.get_json_object("props", "$.k").cast("double").alias("e"))


PROFILE_SQL = """SELECT user_id AS elem, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, round(value, 6) AS i,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS e FROM events"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 from documents: letters other than A, C, G, T are left out of the upper-cased text."""
    return sequences(read(spark, sf_dir, "documents"))


def sequences(documents: DataFrame) -> DataFrame:
    """(seq_id, cls, seq) of documents(doc_id, lang, text): the bases among a text's letters."""
    return documents.select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("cls"), F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "").alias("seq"))


CORPUS_SQL = "SELECT doc_id AS seq_id, lang AS cls, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 from embeddings: token, label and the vector in double precision."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("token"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("h"))


VECTORS_SQL = "SELECT vec_id AS token, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS h FROM embeddings"


def lcg(*terms: str) -> str:
    """SQL, for either engine, of a number in [0, 1) drawn from integer terms; two steps of the generator."""
    seed = " + ".join(f"cast(({t}) as bigint) * {m}" for t, m in zip(terms, (7919, 104729, 1299709, 15485863), strict=False))
    return f"(((({seed} + 12345) * {LCG_A} % {LCG_M}) * {LCG_A} % {LCG_M}) / {LCG_M}.0)"


def directions(spark: SparkSession, n: int, width: int) -> DataFrame:
    """N unit directions (r, w) from the integer generator."""
    one = f"transform(sequence(0, {width - 1}), j -> cast({lcg('r', 'j')} as double) - 0.5D)"
    d = spark.range(n).select(F.col("id").alias("r"), F.expr(one.replace("(r)", "(id)")).alias("w"))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda t, x: t + x * x)) + F.lit(1e-9)
    return d.select("r", F.transform("w", lambda x: x / norm).alias("w"))


def directions_sql(n: int, width: int) -> str:
    return f"""SELECT r, list_transform(w, lambda x: x / (sqrt(list_sum(list_transform(w, lambda y: y * y))) + 1e-9)) AS w
        FROM (SELECT r, list_transform(range({width}), lambda j: CAST({lcg('r', 'j')} AS DOUBLE) - 0.5) AS w FROM range({n}) t(r))"""
