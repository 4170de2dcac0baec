"""Helpers the training-data operators share: text normal forms, Arrow UDF plumbing, durable cuts of lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def _alnum_table() -> bytes:
    """Maps A-Z to a-z and every ASCII byte that is no letter or digit to a space; bytes above 0x7F stay."""
    out = bytearray(range(256))
    for b in range(128):
        ch = chr(b)
        out[b] = ord(ch.lower()) if ch.isalnum() else 0x20
    return bytes(out)


ALNUM = _alnum_table()


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text after lower-casing A-Z."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z: exactly what bytes.lower and bytes.split do."""
    return text.lower().split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(name: str) -> Column:
    """The column's text as bytes; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")


def lower_ascii(name: str) -> Column:
    """Lower-cases A-Z only.  Pure ASCII takes the fast built-in, other texts go through translate."""
    text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_remainder(name: str, k: int) -> Column:
    """crc32 of the id as text, mod k; a null id has remainder -1 and so is in no fold that a number names."""
    return F.coalesce(F.crc32(F.col(f"`{name}`").cast("string")) % F.lit(k), F.lit(-1)).cast("int")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet, in any case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def per_text(make: Callable[[], Callable[[bytes], tuple]], schema: str):
    """An Arrow UDF from text bytes to a struct: make() runs once for each task and returns what maps one text.

    If what it returns has a function prepare, that gets the texts of each batch first.
    Declared nondeterministic so that a filter on the result doesn't evaluate it a second time.
    """
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for texts in batches:
            texts = texts.to_pylist()
            if prepare := getattr(one, "prepare", None):
                prepare(texts)
            rows = [one(x) for x in texts]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kind)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], names=[f.name for f in kind])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, StructType.fromDDL(schema)).asNondeterministic()


def with_struct(df: DataFrame, text: str, udf, name: str) -> DataFrame:
    return df.withColumn(name, udf(utf8(text)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a folder of this machine only in local mode, where that is unset."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", path)
        remove_at_exit(spark, path)
    return path


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Has the session's file system remove a folder when the application ends."""
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder, which outlives any executor and goes when the application ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
        remove_at_exit(spark, spark.sparkContext.getCheckpointDir())
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it reads alike ever after, by column, however the readers split it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a row number (unique, not dense) that belongs to the row for good: it is written along with it.

    monotonically_increasing_id() names rows by the splits of a scan, and two scans may split a table in different ways.
    """
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


class Marks:
    """A bitmap of fixed size over hashes of some row numbers: a number without a mark is none of them, one with a mark may be.

    8 MB go to the workers whatever the number of rows; when nearly all bits are set it spares nothing, and harms nothing.
    """

    BITS = 26

    def __init__(self, numbers: DataFrame):
        """numbers has one column of row numbers without nulls."""
        at = F.pmod(F.xxhash64(numbers.columns[0]), F.lit(1 << self.BITS)) + 1
        parts = numbers.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        held = np.zeros((1 << self.BITS) // 8, np.uint8)
        for r in parts.toLocalIterator():
            part = np.frombuffer(bytes(r["bits"]), np.uint8)
            held[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part
        self.shared = numbers.sparkSession.sparkContext.broadcast(held)

    @classmethod
    def place(cls, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{name}`")), F.lit(1 << cls.BITS)).cast("int")

    def has(self, name: str) -> Column:
        """Whether the row number of a column may be among the marked."""
        from pyspark.sql.functions import arrow_udf

        shared = self.shared

        def run(places: pa.Array) -> pa.Array:
            return pa.array(marked(shared.value, places.to_numpy()))

        run.__annotations__ = {"places": pa.Array, "return": pa.Array}
        return arrow_udf(run, "boolean")(self.place(name))


def marked(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def without(rows: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """rows but those whose number, in a column of that name, dropped has.  Only rows that may be dropped are shuffled.

    rows is read twice, so it has to be a table whose row numbers are written, as numbered() makes it.
    """
    dropped = stored(dropped)
    may = Marks(dropped).has(name)
    return rows.where(~may).unionByName(rows.where(may).join(dropped, name, "left_anti"))


def small_batches(df: DataFrame, rows: int = 1000, size: str = "16m") -> DataFrame:
    """df, with Arrow batches held to so many rows and bytes in its session: texts can be long, and a worker holds a batch at a time.

    The setting stays, as the plan is only run later.  All operators that run Python pass here, so it also sees to it
    that workers can import them.
    """
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    if conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch", None) is not None:
        conf.set(key, size)
    return df
