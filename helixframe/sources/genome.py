"""Sequence sources and sinks: synthetic windows, FASTA, BED windows over contigs, assay tables, memoised results, reports."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.durable import durable
from helixframe.functions import prefix
from helixframe.functions.sequences import MOTIFS
from helixframe.sources.tables import lcg

#: Names under which an assay's columns are looked for, in order.
ASSAY_COLUMNS = {
    "pos": ("position", "pos", "start"),
    "ref": ("ref", "reference", "ref_allele"),
    "alt": ("alt", "alternate", "alt_allele", "variant"),
    "eff": ("coefficient", "value", "log2foldchange", "log2fc", "effect", "expression_log2", "score"),
    "element": ("element", "region", "name"),
    "release": ("release",),
}


def synthetic_corpus(spark: SparkSession, n: int, length: int, seed: int = 0, gc: float = 0.42, weights: dict[str, float] | None = None) -> DataFrame:
    """(seq_id, cls, seq, planted): hashed bases at a GC rate, with 2-4 motifs in ccre windows, 1-2 in genic ones.

    Class sizes are round(n weight), background takes what is left.  Every letter is a function of (seed, window, position), so
    any partitioning gives the same corpus.
    """
    weights = weights or {"ccre": 0.4, "genic": 0.3, "background": 0.3}
    sizes = {c: round(n * w) for c, w in weights.items()}
    sizes["background"] = sizes.get("background", 0) + n - sum(sizes.values())
    edges, total = [], 0
    for c, k in sizes.items():
        total += k
        edges.append(f"when id < {total} then '{c}'")
    at, gt = (1 - gc) / 2, 0.5
    base = f"case when u < {at} then 'A' when u < {gt} then 'C' when u < {gt + gc / 2} then 'G' else 'T' end"
    draw = lcg("id", "j", str(seed))
    seq = f"array_join(transform(transform(sequence(0, {length - 1}), j -> cast({draw} as double)), u -> {base}), '')"
    names = ", ".join(f"'{m}'" for m in MOTIFS)
    text = ", ".join(f"'{c}'" for c, _ in MOTIFS.values())
    count = f"case cls when 'ccre' then 2 + cast(floor({lcg('id', '1', str(seed + 1))} * 3) as int) when 'genic' then 1 + cast(floor({lcg('id', '2', str(seed + 1))} * 2) as int) else 0 end"
    slot = length // 5  # a motif in each of the first slots, so none overlaps
    which = f"cast(floor({lcg('id', 'k', str(seed + 2))} * {len(MOTIFS)}) as int)"
    start = f"k * {slot} + cast(floor({lcg('id', 'k', str(seed + 3))} * {max(1, slot - 9)}) as int)"
    d = spark.range(n).selectExpr("id", f"case {' '.join(edges)} else 'background' end as cls", f"{seq} as seq")
    d = d.withColumn("n_motifs", F.expr(count))
    planted = f"transform(filter(sequence(0, 4), k -> k < n_motifs), k -> named_struct('start', {start}, 'which', {which}))"
    d = d.withColumn("plan", F.expr(planted))
    d = d.withColumn("seq", F.expr(f"aggregate(plan, seq, (s, p) -> overlay(s placing element_at(array({text}), p.which + 1) from p.start + 1))"))
    d = d.withColumn("planted", F.expr(f"transform(plan, p -> named_struct('start', p.start, 'end', p.start + length(element_at(array({text}), p.which + 1)), 'motif', element_at(array({names}), p.which + 1)))"))
    return d.select(F.format_string("win%07d", "id").alias("seq_id"), "cls", "seq", "planted")


def write_fasta(corpus: DataFrame, path: str) -> None:
    """One text record for each window, header `>id cls`, in place of what the path holds; executors write their own parts."""
    corpus.select(F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit(" "), F.coalesce("cls", F.lit("")), F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def read_fasta(spark: SparkSession, path: str, metadata: DataFrame | None = None) -> DataFrame:
    """(seq_id, seq) of a FASTA file or folder, sequences of any number of lines; left-joined with metadata on seq_id.

    A record starts at a `>` that starts a line, so a header may hold others; large files are split between records.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)")
    out = records.select(F.split(F.trim(head), r"\s+")[0].alias("seq_id"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return out.join(metadata, "seq_id", "left") if metadata is not None else out


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Chrom, start, end of a BED file, whose further columns don't matter."""
    d = spark.read.option("sep", "\t").option("comment", "#").csv(path)
    return d.select(d[0].alias("chrom"), d[1].cast("bigint").alias("start"), d[2].cast("bigint").alias("end"))


def bed_windows(bed: DataFrame, contigs: DataFrame, width: int, most_n: float = 0.05) -> DataFrame:
    """Windows centred on the intervals' midpoints, from zero on; of full length and with few enough N (F11).  Other
    columns of the intervals stay."""
    start = F.greatest(F.floor((F.col("start") + F.col("end")) / 2) - width // 2, F.lit(0))
    d = bed.withColumn("window_start", start)
    return with_bases(d, contigs, width, most_n).drop("start", "end")


#: Bases of a piece that contigs are cut in, and positions of a tile of the interval index; windows wider than that touch more.
PIECE = 4096


def pieces(contigs: DataFrame, size: int = PIECE) -> DataFrame:
    """(chrom, tile, piece): contigs (chrom, seq) in pieces of `size` upper-cased bases, the last one shorter."""
    cut = contigs.select("chrom", "seq", F.explode(F.expr(f"sequence(0, cast((length(seq) - 1) div {size} as int))")).alias("tile")).where(F.length("seq") > 0)
    return cut.select("chrom", "tile", F.upper(F.expr(f"substring(seq, tile * {size} + 1, {size})")).alias("piece"))


def with_bases(windows: DataFrame, contigs: DataFrame, width: int, most_n: float = 0.05, size: int = PIECE) -> DataFrame:
    """windows (chrom, window_start) with seq, those that lie within their contig and have less than most_n of N.

    A window meets the one or two pieces it touches, never its contig, so a contig that most windows are on is many join keys.
    Windows of equal place are looked up once.
    """
    places = windows.select("chrom", "window_start").where("window_start >= 0").distinct()
    touched = places.withColumn("tile", F.explode(F.expr(f"sequence(cast(window_start div {size} as int), cast((window_start + {width - 1}) div {size} as int))")))
    got = touched.join(pieces(contigs, size), ["chrom", "tile"])
    # positions within the piece, which a window enters at its start or at the piece's
    lo = f"greatest(window_start - tile * cast({size} as bigint), 0)"
    part = F.expr(f"substring(piece, cast({lo} + 1 as int), cast(least(window_start + {width} - tile * cast({size} as bigint), {size}) - {lo} as int))")
    whole = got.groupBy("chrom", "window_start").agg(F.array_sort(F.collect_list(F.struct("tile", part.alias("part")))).alias("parts"))
    whole = whole.select("chrom", "window_start", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("seq"))
    n = F.length("seq") - F.length(F.replace("seq", F.lit("N")))
    return windows.join(whole.where((F.length("seq") == width) & (n < most_n * width)), ["chrom", "window_start"])


def off_intervals(windows: DataFrame, intervals: DataFrame, width: int, size: int = PIECE) -> DataFrame:
    """windows (chrom, window_start) that share no position with any interval (chrom, start, end), end left out; a tiled index.

    Windows and intervals meet in the tiles they touch.  Intervals within a tile are told apart by a join on the tile; one that
    covers a whole tile is said once for the tile, however many do, so stacked intervals don't multiply.
    """
    tiled = intervals.where("start < end").select("chrom", "start", "end").distinct()
    tiled = tiled.withColumn("tile", F.explode(F.expr(f"sequence(cast(start div {size} as int), cast((end - 1) div {size} as int))")))
    cut = tiled.select("chrom", "tile", F.greatest("start", F.col("tile").cast("bigint") * size).alias("a"), F.least("end", (F.col("tile").cast("bigint") + 1) * size).alias("b")).distinct()
    touch = F.explode(F.expr(f"sequence(cast(window_start div {size} as int), cast((window_start + {width - 1}) div {size} as int))"))
    places = windows.select("chrom", "window_start").distinct().withColumn("tile", touch)
    w, i = places.alias("w"), cut.alias("i")
    hit = (F.col("w.chrom") == F.col("i.chrom")) & (F.col("w.tile") == F.col("i.tile")) & (F.col("i.a") < F.col("w.window_start") + width) & (F.col("i.b") > F.col("w.window_start"))
    bad = w.join(i, hit, "left_semi").select("chrom", "window_start").distinct()
    return windows.join(bad, ["chrom", "window_start"], "left_anti")


#: Halvings of a class among which _chosen looks for a bound, and how finely ranks are told apart there.
HALVINGS, RANKS = 20, 10_000


def _chosen(known: DataFrame, per_class: dict[str, int], seed: int, draw: Column | None) -> DataFrame:
    """per_class[cls] different rows (all, if fewer) of each class of known(cls, chrom, start, end), those of least draw; written down.

    One pass finds a draw for each class that about four times as many rows as asked for are below; another one takes those rows,
    which alone are made distinct.  A class that has too few different rows among them takes half as many halvings, up to none: all rows.
    """
    key = F.concat_ws(":", "cls", F.col("chrom").cast("string"), "start", "end")
    drawn = known.where(F.col("cls").isin(*per_class)).withColumn("_key", key)
    drawn = drawn.withColumn("_draw", F.xxhash64("_key", F.lit(seed)) if draw is None else draw).where("_draw IS NOT NULL")
    shares = F.array(*[F.lit(0.5**h) for h in range(1, HALVINGS + 1)])
    marks = {r["cls"]: r for r in drawn.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_draw", shares, F.lit(RANKS)).alias("at")).collect()}
    out, open_ = None, {}
    for cls, n in per_class.items():
        if cls in marks:
            open_[cls] = sum(marks[cls]["n"] * 0.5**h >= 4 * n + 16 for h in range(1, HALVINGS + 1))
    while open_:
        # no halving: all rows
        below = [(F.col("cls") == c) & (F.lit(True) if not h else F.col("_draw") <= marks[c]["at"][h - 1]) for c, h in open_.items()]
        some = durable(drawn.where(reduce(or_, below)).select("cls", "chrom", "start", "end", "_key", "_draw").distinct())
        found = dict(some.groupBy("cls").count().collect())
        for cls, h in list(open_.items()):
            if h and found.get(cls, 0) < per_class[cls]:
                at = marks[cls]["at"]
                # of one draw that many rows have, more halvings give no more
                open_[cls] = next((k for k in range(h // 2, 0, -1) if at[k - 1] > at[h - 1]), 0)
                continue
            one = prefix.least_rows(some.where(F.col("cls") == cls), "_draw", "_key", per_class[cls]).select("cls", "chrom", "start", "end")
            out = one if out is None else out.unionByName(one)
            del open_[cls]
    return durable(out if out is not None else known.limit(0))


def sampled_windows(intervals: DataFrame, contigs: DataFrame, width: int, per_class: dict[str, int], background: int, seed: int = 0, most_n: float = 0.05, names: str = "^[^_]+$", size: int = PIECE, draw: Column | None = None, order: Column | None = None) -> DataFrame:
    """(cls, chrom, window_start, seq) of sampled intervals and of background off all intervals.

    intervals (cls, chrom, start, end): of each class exactly per_class[cls] different ones (all, if fewer), those of least draw,
    and of these the midpoint windows that are whole and have few N, so a class can end up smaller.  Two intervals with
    one midpoint give one window.  Background: draw i = 0, 1, ... takes a contig, each as likely, of a name that matches
    `names`, isn't chrM or MT, and is longer than the window, and a start on it; draws that touch any interval, are cut short or
    have many N are rejected, and the first `background` of those left are kept: fewer if 64 times as many draws as asked for,
    and 4096 more, do not give them.  A start drawn twice counts once.  draw (of cls, chrom, start, end) and order (of chrom, its
    contigs' order) are bigints, hashes if not given, so partitions don't matter.
    """
    spark = intervals.sparkSession
    # intervals may repeat: only the few that matter are made distinct
    known = intervals.where("cls IS NOT NULL AND chrom IS NOT NULL AND start < end").select("cls", "chrom", "start", "end")
    chosen = _chosen(known, per_class, seed, draw) if per_class else None
    # a window needs its own contig alone, and intervals on it
    on = lambda df, places: df.join(F.broadcast(places.select("chrom").distinct()), "chrom", "left_semi")
    lengths = contigs.select("chrom", F.length("seq").cast("bigint").alias("n")).where(F.col("chrom").cast("string").rlike(names) & ~F.col("chrom").cast("string").isin("chrM", "MT") & (F.col("n") > width))
    lengths = durable(lengths)
    ranked = durable(prefix.row_ranks(lengths.withColumn("_draw", F.xxhash64(F.col("chrom").cast("string"), F.lit(seed)) if order is None else order), "_draw", "chrom", "_rank").select("chrom", "n", "_rank"))
    many, most, tried = ranked.count(), 64 * background + 4096, 0
    kept = None
    step = min(most, 2 * background + 64)
    while many and tried < most and background:
        # two multipliers of the draw's number: with one, the contig's draw would fix the start
        draws = spark.range(tried, tried + step).select("id", F.expr(f"cast(floor({lcg('id', str(seed))} * {many}) as bigint) + 1").alias("_rank"), F.expr(f"cast({lcg(str(seed), 'id')} as double)").alias("u"))
        placed = durable(draws.join(ranked, "_rank").select("id", "chrom", F.floor(F.col("u") * (F.col("n") - width)).alias("window_start")))
        off = durable(off_intervals(placed, on(known, placed), width, size))
        free = durable(with_bases(off, on(contigs, off), width, most_n, size))
        kept = free if kept is None else kept.unionByName(free)
        first = kept.groupBy("chrom", "window_start").agg(F.min("id").alias("id"), F.first("seq").alias("seq"))
        tried += step
        found = first.count()
        if found >= background:
            break
        step = min(most - tried, max(step, int(1.2 * tried * (background - found) / max(found, 1))))
    out = None
    if chosen is not None:
        out = bed_windows(chosen, on(contigs, chosen), width, most_n).select("cls", "chrom", "window_start", "seq").distinct()
    if kept is not None:
        rest = prefix.least_rows(first, "id", "chrom", background).select(F.lit("background").alias("cls"), "chrom", "window_start", "seq")
        out = rest if out is None else out.unionByName(rest)
    return out


def resolve_columns(columns: list[str]) -> dict[str, str]:
    """Our name -> the file's name, by the first candidate present in any case; position, alt and effect are required."""
    lower = {c.lower(): c for c in columns}
    found = {ours: next((lower[c] for c in names if c in lower), None) for ours, names in ASSAY_COLUMNS.items()}
    if missing := [k for k in ("pos", "ref", "alt", "eff") if not found[k]]:
        raise ValueError(f"assay columns not found: {missing}")
    return {ours: name for ours, name in found.items() if name}


def assay_table(raw: DataFrame, name: str = "element", release: str | None = None, default: Column | None = None, row: Column | None = None) -> DataFrame:
    """(element, pos, ref, alt, eff, row) of an assay frame; a file without an element column is one element, called
    `default`, or `name` if that isn't given.

    Rows whose alt is no base go, and rows of other releases if one is asked for and the column is there.  `row` orders the rows;
    if it isn't given it is the order in which they were read, which holds for one file in one split.
    """
    c = resolve_columns(raw.columns)
    element = F.col(f"`{c['element']}`") if "element" in c else F.lit(name) if default is None else default
    d = raw.withColumn("row", F.monotonically_increasing_id() if row is None else row)
    if release and "release" in c:
        d = d.where(F.upper(F.col(f"`{c['release']}`").cast("string")) == release.upper())
    q = lambda k: F.col(f"`{c[k]}`")
    d = d.select(element.cast("string").alias("element"), q("pos").cast("int").alias("pos"), F.upper(q("ref")).alias("ref"), F.upper(q("alt")).alias("alt"), q("eff").cast("double").alias("eff"), "row")
    return d.where(F.col("alt").isin("A", "C", "G", "T"))


def assay_elements(assay: DataFrame, least: int = 10) -> DataFrame:
    """(element, pos, ref, e_mean, e_signed, e_max) for each position from the first to the last.

    The last row of a (position, alt) wins.  Means divide by the alternatives that aren't zero, one at least; positions
    without a row have base A and zeros; elements shorter than `least` go.
    """
    cells = assay.groupBy("element", "pos", "alt").agg(F.max_by("eff", "row").alias("eff"), F.max_by("ref", "row").alias("ref"), F.max("row").alias("row"))
    n = F.greatest(F.lit(1), F.count_if(F.col("eff") != 0))
    at = cells.groupBy("element", "pos").agg((F.sum(F.abs("eff")) / n).alias("e_mean"), (F.sum("eff") / n).alias("e_signed"), F.max(F.abs("eff")).alias("e_max"), F.max_by("ref", "row").alias("ref"))
    span = at.groupBy("element").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).where(F.col("b") - F.col("a") + 1 >= least)
    grid = span.select("element", F.explode(F.sequence("a", "b")).alias("pos"))
    return grid.join(at, ["element", "pos"], "left").fillna({"ref": "A", "e_mean": 0.0, "e_signed": 0.0, "e_max": 0.0})


def memoised(spark: SparkSession, folder: str, name: str, settings: dict, make) -> DataFrame:
    """The Parquet table that make() once wrote for these settings; a hash of all settings is part of its name."""
    key = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_weights(weights: DataFrame, folder: str) -> None:
    """(family, m, seed, feature_id, w), partitioned by what names a model."""
    weights.write.mode("append").partitionBy("family", "m", "seed").parquet(folder)


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """Exactly n rows (all if fewer), those of least draw: a hash of the key if none is given.  Rows stay where they are."""
    held = df.withColumn("_draw", F.xxhash64(F.col(key), F.lit(seed)) if draw is None else draw)
    return prefix.least_rows(held, "_draw", key, n).drop("_draw")


def batches(df: DataFrame, key: str, size: int, epoch: int = 0, draw: Column | None = None) -> DataFrame:
    """A batch number for each row: `size` rows each but for the last, in an order drawn anew for every epoch.

    The order is that of a draw, by default a hash of key and epoch, and so the same however the rows are partitioned.
    """
    held = df.withColumn("_draw", F.xxhash64(F.col(key), F.lit(epoch)) if draw is None else draw)
    ranked = prefix.row_ranks(held, "_draw", key, "_rank")
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size)).drop("_draw", "_rank")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small frame."""
    rows = df.limit(most).collect()
    line = lambda v: "| " + " | ".join("" if x is None else str(x) for x in v) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
