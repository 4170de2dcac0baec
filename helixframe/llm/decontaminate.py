"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, verified exactly."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import LOWER, UPPER, alnum_words, free_name, numbered, per_text, small_batches, stored, table, utf8

WIDTH = 10
#: Bytes of item text in one index, which takes about eight times as much; a larger benchmark is held against the documents block by block.
BLOCK_BYTES = 16 << 20
#: Cells, as a power of two, in which words' frequencies are counted: any order of words is right, so words may share one.
CELLS = 20


def cell(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> (64 - CELLS)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The number of blocks, and a function that gets block k as a list of (id as string or None, text bytes); the size is measured first."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), utf8(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))

    def block(k: int):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        return [(r["id"], bytes(r["text"])) for r in part.collect()]

    return n, block


def cell_frequency(docs: DataFrame, text_col: str) -> np.ndarray:
    """In how many documents each cell has a word, over all documents in one scan; a task hands on 2**CELLS numbers at most."""

    def count(batches):
        n, known = np.zeros(1 << CELLS, np.int64), {}
        for b in batches:
            for text in b.column(0).to_pylist():
                words = set(alnum_words(text))
                if len(known) > 500_000:
                    known.clear()
                for w in words.difference(known):
                    known[w] = cell(w)
                n[list(set(map(known.__getitem__, words)))] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["cell", "n"])

    out = docs.select(utf8(text_col).alias("text")).mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << CELLS, np.int64)
    n[out["cell"].to_numpy()] = out["n"].to_numpy()
    return n


def word_frequency(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary occurs, over all documents; one small row a word and task."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches):
        words, n = shared.value, Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                n.update(words.intersection(alnum_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    out = docs.select(utf8(text_col).alias("text")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in out}


class WindowIndex:
    """Windows of items by their hash, and the places in windows at which each window's rarest word stands.

    Containment asks for all words of a window, so its prefix under the order by rarity is its rarest word alone.
    Windows are kept once, as ranges of the items' words joined by spaces: a match compares bytes.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], width: int, frequency: Callable[[bytes], int]):
        rarity: dict[bytes, tuple] = {}
        code, start, size, owner, parts, at = array("Q"), array("L"), array("L"), array("L"), [], 0
        postings: dict[bytes, set[tuple[int, int]]] = {}
        shared: dict[tuple[int, int], tuple[int, int]] = {}
        self.ids = [i for i, _ in items]
        for number, (_, text) in enumerate(items):
            words = alnum_words(text)
            for w in set(words).difference(rarity):
                rarity[w] = (frequency(w), w)
            joined = b" ".join(words)
            k = min(width, len(words))
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            for i in range(len(words) - k + 1 if words else 0):
                window = words[i : i + k]
                first, last = (ends[i - 1] if i else 0), ends[i + k - 1] - 1
                code.append(xxhash.xxh64_intdigest(joined[first:last]))
                start.append(at + first), size.append(last - first), owner.append(number)
                rare = min(window, key=rarity.__getitem__)
                place = (window.index(rare), k)
                postings.setdefault(rare, set()).add(shared.setdefault(place, place))
            parts.append(joined)
            at += len(joined)
        order = np.argsort(np.frombuffer(code, np.uint64), kind="stable") if code else np.zeros(0, np.int64)
        take = lambda x, kind: np.array(x, kind)[order]
        self.code, self.start, self.size, self.owner = take(code, np.uint64), take(start, np.uint32), take(size, np.uint32), take(owner, np.uint32)
        self.text = b"".join(parts)
        self.postings = {w: tuple(sorted(p)) for w, p in postings.items()}

    def owners(self, window: bytes) -> list[int]:
        """Numbers of the items that have the window."""
        code = xxhash.xxh64_intdigest(window)
        i, out = bisect_left(memoryview(self.code), code), []
        while i < len(self.code) and self.code[i] == code:
            if self.text[self.start[i] : self.start[i] + self.size[i]] == window:
                out.append(int(self.owner[i]))
            i += 1
        return out

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words [start, end) inside occurrences of windows, merged; ids of the items met."""
        spans: list[tuple[int, int]] = []
        met: set[int] = set()
        if rare := self.postings.keys() & set(words):
            n = len(words)
            for at, word in enumerate(words):
                if word in rare:
                    for offset, size in self.postings[word]:
                        start = at - offset
                        if start >= 0 and start + size <= n and (of := self.owners(b" ".join(words[start : start + size]))):
                            spans.append((start, start + size))
                            met.update(of)
        return merged(spans), {self.ids[i] for i in met}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SCHEMA = "n_words bigint, n_hit bigint, n_items bigint, spans array<struct<a:int,b:int>>, items array<string>, contaminated boolean"


def _row(n_words: int, spans: list[tuple[int, int]], met: set) -> tuple:
    listed = sorted(x for x in met if x is not None)
    return n_words, sum(b - a for a, b in spans), len(listed), [{"a": a, "b": b} for a, b in spans], listed, bool(spans)


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, name: str = "hit") -> DataFrame:
    """docs with a struct column <name>: n_words, n_hit, n_items, spans (of words), items (ids as strings, sorted), contaminated.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z.  A window is width
    consecutive words of an item, or a shorter item as a whole; a document word inside any occurrence of one is
    hit.  Null texts have no words; empty items have no window; items that repeat count once; an item without
    an id hits words but isn't listed.  Empty tables are fine: without items nothing is hit.  Documents that repeat are
    rows of their own.  If docs has a column <name>, underscores go in front of the new one's.

    Rarity is counted over all documents, in one scan: of the items' words if they make one block, else of cells that words
    share, as any order of words gives the same result.  A worker holds one index at a time, of block_bytes of item
    text.  With several blocks the documents are numbered and written, each block's hits are written in turn and its
    index is dropped, and the few rows that have hits go back to their documents.
    """
    sc = docs.sparkSession.sparkContext
    name = free_name(small_batches(docs), name)
    n, block = item_blocks(items, item_id, item_text, block_bytes)
    if n == 1:
        items_held = block(0)
        vocabulary = {w for _, text in items_held for w in alnum_words(text)}
        counts = word_frequency(docs, text_col, vocabulary) if vocabulary else {}
        shared = sc.broadcast(WindowIndex(items_held, width, lambda w: counts.get(w, 0)))

        def make():
            index = shared.value

            def one(text):
                words = alnum_words(text)
                return _row(len(words), *index.find(words))

            return one

        return docs.withColumn(name, per_text(make, SCHEMA)(utf8(text_col)))
    cells = cell_frequency(docs, text_col)
    rid = free_name(docs, "rid")
    rows = numbered(docs, rid)
    texts = rows.select(F.col(rid).alias("rid"), utf8(text_col).alias("text"))
    hits = [_block_hits(texts, WindowIndex(block(k), width, lambda w: int(cells[cell(w)]))) for k in range(n)]
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    found = every.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def joined():
        return lambda text: (len(alnum_words(text)),)

    start = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    spans = F.aggregate(F.array_sort("spans"), start, lambda acc, s: F.when((F.size(acc) > 0) & (s["a"] <= F.element_at(acc, -1)["b"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(s["b"], F.element_at(acc, -1)["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s))))
    found = found.select(F.col("rid").alias(rid), spans.alias("spans"), "items")
    x, s, i = free_name(rows, "x"), free_name(rows, "spans"), free_name(rows, "items")
    out = rows.join(found.select(rid, F.col("spans").alias(s), F.col("items").alias(i)), rid, "left").withColumn(x, per_text(joined, "n bigint")(utf8(text_col)))
    n_hit = F.coalesce(F.aggregate(F.col(s), F.lit(0).cast("bigint"), lambda t, p: t + p["b"] - p["a"]), F.lit(0))
    some = F.coalesce(F.col(i), F.expr("cast(array() as array<string>)"))
    hit = F.struct(F.col(f"{x}.n").alias("n_words"), n_hit.alias("n_hit"), F.size(some).cast("bigint").alias("n_items"), F.coalesce(F.col(s), start).alias("spans"), some.alias("items"), F.col(s).isNotNull().alias("contaminated"))
    return out.withColumn(name, hit).drop(rid, x, s, i)


def _block_hits(texts: DataFrame, index: WindowIndex) -> DataFrame:
    """(rid, spans, items) of the documents that one block's index hits; the index goes with the one scan that uses it."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        mine = shared.value
        for b in batches:
            out = [(r, *mine.find(alnum_words(t))) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            out = [(r, [{"a": a, "b": c} for a, c in spans], sorted(x for x in met if x is not None)) for r, spans, met in out if spans]
            rid, spans, met = zip(*out, strict=True) if out else ((), (), ())
            span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(spans, span), pa.array(met, pa.list_(pa.string()))], names=["rid", "spans", "items"])

    out = stored(texts.mapInArrow(run, "rid bigint, spans array<struct<a:int,b:int>>, items array<string>"))
    shared.destroy()
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "hit.n_words", "hit.n_hit", "hit.n_items", F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"), "hit.contaminated")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP5_SQL = rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS size, array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') AS win
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc),
occ AS (SELECT a.doc_id, a.p, s.size, win.item_id
        FROM pos a JOIN (SELECT DISTINCT size FROM win) s ON a.p + s.size - 1 <= len(a.w)
        JOIN win ON win.size = s.size AND win.win = array_to_string(a.w[a.p:a.p + s.size - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
