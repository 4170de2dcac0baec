"""Folders of text files as sources and sinks: assay tables with the precedence of their names, a corpus as FASTA and metadata,
elements, reports; all by Spark's own readers and writers, which split large files."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.sources import genome as G

_TABLE = re.compile(r"\.(tsv|txt|csv)(\.gz)?$")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def assay_files(spark: SparkSession, path: str) -> list[str]:
    """The tables that a path stands for, in the order of their names.

    A table's own path is itself.  Of a folder: `elements.tsv.gz` alone, else `elements.tsv` alone, else the first name with
    `elements` before `.tsv`, else every tsv, txt and csv file, gzipped or not.  None at all is a FileNotFoundError.
    """
    if _TABLE.search(path.rstrip("/")) and not _is_folder(spark, path):
        return [path]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path")
    by_name = {p.rsplit("/", 1)[-1]: p for p in sorted(r["path"] for r in listed.collect())}
    for first in ("elements.tsv.gz", "elements.tsv"):
        if first in by_name:
            return [by_name[first]]
    if combined := [p for name, p in by_name.items() if "elements" in name.split(".tsv")[0] and ".tsv" in name]:
        return combined[:1]
    if tables := [p for name, p in by_name.items() if _TABLE.search(name)]:
        return tables
    raise FileNotFoundError(f"no assay tables in {path}")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _headers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """First line that is neither blank nor a comment -> the files that start with it; a line a file comes to the driver."""
    lines = spark.read.text(files).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("id", F.monotonically_increasing_id())
    lines = lines.where("trim(value) <> '' AND NOT startswith(value, '#')")
    first = lines.groupBy("file_path").agg(F.min_by("value", F.struct("file_block_start", "id")).alias("head")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(first, key=lambda r: r["file_path"]):
        out.setdefault(r["head"], []).append(r["file_path"])
    return out


def read_assay(spark: SparkSession, path: str, release: str | None = None) -> DataFrame:
    """(element, pos, ref, alt, eff, row) of an assay's file or folder (`assay_files`), by P1 and P2.

    Files may differ in their columns: those of one header are one read, so plans grow with the headers, not the files.  A file
    without an element column is one element of the file's name.  `row` orders rows by file, place of the split in it, and place
    in the split: the last row of a cell is the same one however a large file is split, and of several files the last name's.
    Elements of one name in several files are one element.  Finding the headers of more than one file reads the files once more.
    """
    files = assay_files(spark, path)
    groups: dict[tuple[str, ...], list[str]] = {}
    if len(files) == 1:
        groups[(_separator(files[0]),)] = files
    else:
        for head, those in _headers(spark, files).items():
            for f in those:
                sep = _separator(f)
                groups.setdefault((sep, *next(csv.reader([head], delimiter=sep))), []).append(f)
    out = None
    for (sep, *_), those in groups.items():
        # file paths in the metadata are URL-encoded, those that readers take are not
        raw = spark.read.option("header", True).option("sep", sep).option("comment", "#").csv([unquote(f) for f in those])
        names = raw.columns
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
        stem = F.regexp_replace(F.url_decode(F.regexp_extract("_metadata.file_path", "[^/]*$", 0)), _TABLE.pattern, "")
        one = G.assay_table(raw.select(*[F.col(f"`{c}`") for c in names], stem.alias("_stem"), at.alias("_row")), release=release, default=F.col("_stem"), row=F.col("_row"))
        out = one if out is None else out.unionByName(one)
    return out


def _separator(path: str) -> str:
    return "," if re.search(r"\.csv(\.gz)?$", path) else "\t"


def assay_sequences(assay: DataFrame, least: int = 10) -> DataFrame:
    """(elem_id, seq, e_mean, e_signed, e_max, e_alt) of an assay's elements, as `operators/toy.elements_of` has them.

    The sequence is the reference bases in order of position; e_alt has the size of each effect by position and base A, C, G, T.
    Null effects count as none.  An element is one row, so its length is what a row holds.
    """
    last = assay.where("element IS NOT NULL AND pos IS NOT NULL").groupBy("element", "pos", "alt").agg(F.max_by(F.struct("eff", "ref"), "row").alias("v"), F.max("row").alias("row"))
    eff, n = F.col("v.eff"), F.greatest(F.lit(1), F.count_if(F.col("v.eff") != 0))
    zero = F.lit(0.0)
    size = [F.coalesce(F.max(F.when(F.col("alt") == b, F.abs(eff))), zero) for b in "ACGT"]
    at = last.groupBy("element", "pos").agg(
        F.coalesce(F.max_by("v.ref", "row"), F.lit("A")).alias("ref"), F.coalesce(F.sum(F.abs(eff)) / n, zero).alias("e_mean"), F.coalesce(F.sum(eff) / n, zero).alias("e_signed"),
        F.coalesce(F.max(F.abs(eff)), zero).alias("e_max"), F.array(*size).alias("e_alt"),
    )
    # positions up to the next known one have base A and no effect
    after = F.coalesce(F.lead("pos").over(Window.partitionBy("element").orderBy("pos")) - 1, F.col("pos"))
    own = F.struct("ref", "e_mean", "e_signed", "e_max", "e_alt")
    none = F.struct(F.lit("A").alias("ref"), zero.alias("e_mean"), zero.alias("e_signed"), zero.alias("e_max"), F.array(*[zero] * 4).alias("e_alt"))
    run = at.select("element", F.struct("pos", F.concat(F.array(own), F.array_repeat(none, after - F.col("pos"))).alias("v")).alias("r"))
    rows = run.groupBy("element").agg(F.array_sort(F.collect_list("r")).alias("r")).select("element", F.flatten(F.transform("r", lambda x: x["v"])).alias("p")).where(F.size("p") >= least)
    take = lambda name: F.transform("p", lambda x: x[name])
    return rows.select(F.col("element").alias("elem_id"), F.array_join(F.transform("p", lambda x: F.substring(x["ref"], 1, 1)), "").alias("seq"), *[take(c).alias(c) for c in ("e_mean", "e_signed", "e_max", "e_alt")])


def synthetic_elements(spark: SparkSession, n: int, length: int, gc: float = 0.42, seed: int = 0) -> DataFrame:
    """Elements of hashed windows with planted motifs."""
    from helixframe.operators import toy

    return toy.elements_of(G.synthetic_corpus(spark, n, length, seed, gc, {"ccre": 1.0, "background": 0.0}))


def load_elements(spark: SparkSession, source: str, path: str = "", release: str | None = None, n: int = 24, length: int = 240, gc: float = 0.42, seed: int = 0) -> DataFrame:
    """Elements of the named source: `assay` (a path), `table` (elements that `write_elements` wrote) or `synthetic`.

    Another name is a ValueError, and so is a source of files without a path.
    """
    if source in ("assay", "table") and not path:
        raise ValueError(f"source {source} needs a path")
    if source == "assay":
        return assay_sequences(read_assay(spark, path, release))
    if source == "table":
        return read_elements(spark, path)
    if source == "synthetic":
        return synthetic_elements(spark, n, length, gc, seed)
    raise ValueError(f"no source of elements: {source}")


def write_elements(elements: DataFrame, path: str) -> None:
    """Elements as Parquet with nested arrays, in place of what the path holds."""
    elements.write.mode("overwrite").parquet(path)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements that `write_elements` wrote; e_alt is null where they had none."""
    d = spark.read.parquet(path)
    return d if "e_alt" in d.columns else d.withColumn("e_alt", F.lit(None).cast("array<array<double>>"))


def write_corpus(corpus: DataFrame, folder: str) -> None:
    """Corpus (seq_id, cls, seq[, planted]) as `corpus.fasta`, headers `>id cls`, and `corpus_meta`, a CSV of seq_id, cls, len
    and planted motifs in JSON; in place of what is there.  The metadata come last, so they stand for a whole corpus."""
    d = corpus if "planted" in corpus.columns else corpus.withColumn("planted", F.lit(None).cast("array<struct<start:int,end:int,motif:string>>"))
    G.write_fasta(d, f"{folder}/corpus.fasta")
    meta = d.select("seq_id", "cls", F.length("seq").alias("len"), F.coalesce(F.to_json("planted"), F.lit("[]")).alias("planted"))
    meta.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/corpus_meta")


def load_corpus(spark: SparkSession, folder: str, build=None) -> DataFrame:
    """(seq_id, seq, cls, len, planted) of the corpus that write_corpus wrote; without one, build()'s is written first.

    A sequence without metadata has nulls there.  Without a corpus and a build it is a FileNotFoundError.
    """
    if not exists(spark, f"{folder}/corpus_meta/_SUCCESS"):
        if build is None:
            raise FileNotFoundError(f"no corpus in {folder}")
        write_corpus(build(), folder)
    meta = spark.read.option("header", True).option("escape", '"').schema("seq_id string, cls string, len int, planted string").csv(f"{folder}/corpus_meta")
    meta = meta.withColumn("planted", F.from_json("planted", "array<struct<start:int,end:int,motif:string>>"))
    return G.read_fasta(spark, f"{folder}/corpus.fasta", meta)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text, such as a report or the settings' snapshot, as one file in a folder of its own."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
