"""Spelling variants: words one edit apart, found by equal bands of letter-parity masks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import LOWER, UPPER, small_batches, stored, table, utf8

#: A word's least number of code points, its least number of occurrences, and how many times as frequent its form must be.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: One run of a text in so many loses a letter before it is counted.
NOISE = 31
#: Bytes, roughly, of distinct words that a task counts before it passes the counts on.  Bounds memory, not results.
HELD = 96_000_000
#: The letters of each band, dealt out in order of their frequency.
BANDS = ("eosdufpkq", "tihlmgbjz", "anrcwyvx")
#: Bits of a band.  A code point outside a-z has a bit of the third band, by its remainder.
WIDTH = 16

_LOW = str.maketrans(UPPER, LOWER)
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LETTERS},}}")


def _spelt(run: str, doc: int) -> str:
    """The run as it is counted; doc is the crc32 of `<doc_id>:`."""
    h = crc32(run.encode(), doc)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), strict=True):
            start = crc32(f"{doc}:".encode())
            for run, n in Counter(_RUN.findall(text.decode("utf-8", "replace").translate(_LOW))).items():
                if len(word := _spelt(run, start)) >= LETTERS:
                    if word not in held:
                        size += len(word) + 100
                    held[word] += n
            if size > HELD:
                yield out()
                held.clear()
                size = 0
    yield out()


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts that occur OCCURRENCES times or more.

    A word is a maximal run [A-Za-z\\u00C0-\\u00FF]+ with A-Z lower-cased, of LETTERS code points or more.  If NOISE divides the crc32 h of
    `<doc_id>:<run>`, the run first loses its code point h % length.  Null texts have none; a null id counts as empty; a row that
    repeats counts again; an empty table has no words.  Tasks count before the shuffle, so a hot word is one row a task.
    """
    rows = small_batches(docs).select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc"), utf8(text_col).alias("text"))
    counts = rows.mapInArrow(_counts, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _bit(ch: str) -> int:
    for band, letters in enumerate(BANDS):
        if ch in letters:
            return band * WIDTH + letters.index(ch)
    return 2 * WIDTH + len(BANDS[2]) + ord(ch) % (WIDTH - len(BANDS[2]))


def _masks(words: pa.Array) -> pa.Array:
    bits: dict[str, int] = {}
    out = []
    for word in words.to_pylist():
        mask = 0
        for ch in word:
            if ch not in bits:
                bits[ch] = 1 << _bit(ch)
            mask ^= bits[ch]
        out.append(mask)
    return pa.array(out, pa.int64())


_masks.__annotations__ = {"words": pa.Array, "return": pa.Array}


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: both directions of each pair of words that differ by one inserted, deleted or replaced code point.

    words has word and n, each word once and no nulls; an empty table gives an empty one.  A bit of a mask is the parity of its
    letters' number.  An edit flips at most two bits, so one band of three stays as it is, and words meet under an equal band.
    What they meet under says more, to spare them most of their meetings: the length of the shorter word, which is that of the other or
    one less, and a half of the shorter word, as an edit leaves its first or its last half alone.  Of the ways in which a pair meets the
    first counts; the other bits of the masks and then the words decide.
    """
    from pyspark.sql.functions import arrow_udf

    low = (1 << WIDTH) - 1
    w = stored(words.select("word", "n", arrow_udf(_masks, "bigint")("word").alias("mask"), F.char_length("word").alias("size")))
    band = lambda mask, k: f"(shiftright({mask}, {k} * {WIDTH}) & {low})"
    head, tail = "left(word, size_ div 2)", "right(word, size_ - size_ div 2)"
    ways = [(k, h) for k in range(3) for h in (0, 1)]
    meetings = lambda size: "array(" + ", ".join(f"xxhash64({k}, {h}, {size}, {band('mask', k)}, {(head, tail)[h]})".replace("size_", size) for k, h in ways) + ")"
    shorter = w.select(*(F.col(c).alias(f"l_{c}") for c in w.columns), F.posexplode(F.expr(meetings("size"))).alias("l_way", "l_at"))
    # the other word as one of equal length, and as one that is longer by one
    longer = w.select("word", "n", "mask", "size", F.explode(F.array("size", F.col("size") - 1)).alias("met"))
    longer = longer.select("*", F.posexplode(F.expr(meetings("met"))).alias("way", "at"))
    same = " ".join(["CASE", *(f"WHEN {band('l_mask', k)} = {band('mask', k)} THEN {k}" for k in range(3)), "END"])
    first = f"way div 2 = {same} AND (way % 2 = 0 OR left(l_word, met div 2) <> left(word, met div 2))"
    pairs = shorter.join(
        longer,
        F.expr(f"l_at = at AND l_way = way AND l_size = met AND bit_count(l_mask ^ mask) <= 2 AND (met < size OR l_word < word) AND {first} AND levenshtein(l_word, word, 1) = 1"),
    ).select("l_word", "l_n", "word", "n")
    both = F.array(F.struct(F.col("l_word").alias("word"), F.col("l_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")), F.struct("word", "n", F.col("l_word").alias("near"), F.col("l_n").alias("near_n")))
    return pairs.select(F.inline(both))


def roots(edges: DataFrame) -> DataFrame:
    """word, root of edges (word, form): where the forms lead at last.  Each form has edges at most once and none lead back.

    The distance covered doubles in each round, written down in between; a form's n is TIMES its word's, so rounds are few.
    """
    out = stored(edges.select("word", F.col("form").alias("root")))
    while True:
        step = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = stored(out.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not out.where("moved").head(1):
            return out.select("word", "root")
        out = out.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the texts; see words() for what counts as one, nulls and repeats.

    A word's form is its near word of largest n, of equal ones the smallest in code-point order, if its n is TIMES the word's or more; else
    null, as is form_n.  root follows forms to the last and is the word itself where there is none.
    """
    w = stored(words(docs, id_col, text_col))
    near = near_pairs(w).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    near = stored(near)
    linked = stored(
        w.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(-F.col("best.minus") >= F.col("n") * TIMES, F.col("best")).alias("best"))
    )
    linked = linked.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.minus")).alias("form_n"))
    last = roots(linked.where("form IS NOT NULL"))
    return linked.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants over all documents: word, form, root, n, n_near, form_n."""
    return spelling_variants(table(spark, sf_dir, "documents"))
