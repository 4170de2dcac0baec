"""Near copies: SimHash fingerprints find candidates by multi-index hashing, the texts' shingles verify each one.

A text's anchors are its shingles of least hash under a few orders.  Every anchor that several texts share has tables of its
own, one for each segment of the fingerprint; a text asks in them for all keys within a small Hamming ball, and a match must
hold over the complete fingerprint.  Whether two texts are compared depends on these two alone, at any number of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Marks, durable, free_name, marked, numbered, per_text, small_batches, space_words, stored, utf8, without
from helixframe.llm.components import connected_components, send_back
from helixframe.llm.simhash import _roots

WORDS, SIMILARITY = 5, 0.8
#: Anchors: two texts of similarity s share one of them with probability 1 - (1 - s)^4.
ANCHORS = 4
#: 21 segments of 12 bits; a pair must agree but for one bit in one of them.
SEGMENTS, BITS, RADIUS = 21, 12, 1
#: Differing bits of the 256 that a candidate may have: pairs of similarity 0.8 differ in 39 on average, very short ones in 48.
DISTANCE = 64
#: Bytes of shingle hashes of an anchor's texts in one task; more are dealt as pairs of blocks.
BLOCK_BYTES = 32 << 20
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
_MIX = [np.uint64(x) for x in _ODD]
_SHIFT = [np.uint64(x * (2 * i + 1) % 2**64) for i, x in enumerate(_ODD)]
FEATURES = "n int, fp binary, anchors array<bigint>, same binary, shingles binary"


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted XXH64 of the distinct shingles; fewer words make one shingle, and so does none."""
    of = space_words(text)
    shingles = set(map(b" ".join, zip(*(of[i:] for i in range(words)), strict=False))) if len(of) >= words else [b" ".join(of)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles)))


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The hashes in another order: a bijection of 64 bits for each i."""
    h = (h + _SHIFT[i]) * _MIX[1]
    h = (h ^ h >> np.uint64(29)) * _MIX[2]
    return (h ^ h >> np.uint64(32)) * _MIX[3] ^ h >> np.uint64(27)


def features(text: bytes, words: int = WORDS) -> tuple[int, bytes, list[int], bytes, bytes]:
    """Shingles' number, 256-bit fingerprint, anchors, a digest of the set, and the set as sorted 64-bit numbers."""
    h = shingle_hashes(text, words)
    counts = np.zeros((ANCHORS, 64), np.int64)
    anchors = []
    for i in range(ANCHORS):
        least = None
        for at in range(0, len(h), 65536):
            m = _mixed(h[at : at + 65536], i)
            counts[i] += np.unpackbits(m.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
            low = int(m.min())
            least = low if least is None else min(least, low)
        anchors.append(least - (1 << 63))
    raw = h.tobytes()
    return len(h), np.packbits(counts * 2 > len(h)).tobytes(), sorted(set(anchors)), xxhash.xxh3_128_digest(raw), raw


class Table:
    """Fingerprints and shingle numbers of one anchor's texts; the pairs of them that the segments bring together."""

    def __init__(self, fp: list[bytes], n: list[int], similarity: float, small: int = 192):
        raw = np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), 32)
        self.word = raw.view(np.uint64)
        bits = np.unpackbits(raw, axis=1)[:, : SEGMENTS * BITS].reshape(len(fp), SEGMENTS, BITS)
        self.key = (bits.astype(np.uint16) << np.arange(BITS, dtype=np.uint16)).sum(axis=2, dtype=np.uint16)
        self.n, self.similarity, self.small = np.array(n, np.int64), similarity, small

    def _ok(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of pairs, and which of them are candidates: near over all bits, and of sizes that similarity allows."""
        d = np.bitwise_count(self.word[i] ^ self.word[j]).sum(axis=1, dtype=np.int32)
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        return d, (d <= DISTANCE) & (low >= self.similarity * high)

    def candidates(self):
        """Yields (i, j, distance) arrays of pairs, i < j, each pair once."""
        g = len(self.n)
        if g <= self.small:
            i, j = np.triu_indices(g, 1)
            met = (np.bitwise_count(self.key[i] ^ self.key[j]) <= RADIUS).any(axis=1)
            i, j = i[met], j[met]
            d, ok = self._ok(i, j)
            yield i[ok], j[ok], d[ok]
            return
        balls = [0] + [1 << b for b in range(BITS)]
        order = np.argsort(self.key, axis=0, kind="stable")
        ordered = np.take_along_axis(self.key, order, axis=0)
        step = max(1, 4_000_000 // g)
        for at in range(0, g, step):
            ask = np.arange(at, min(g, at + step))
            met = np.zeros((len(ask), g), bool)
            for s in range(SEGMENTS):
                for mask in balls:
                    key = self.key[ask, s] ^ np.uint16(mask)
                    low, high = np.searchsorted(ordered[:, s], key, "left"), np.searchsorted(ordered[:, s], key, "right")
                    k = high - low
                    if total := int(k.sum()):
                        place = np.repeat(low - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(total)
                        met[np.repeat(np.arange(len(ask)), k), order[place, s]] = True
            i, j = np.nonzero(met)
            i = i + at
            i, j = i[i < j], j[i < j]
            d, ok = self._ok(i, j)
            yield i[ok], j[ok], d[ok]


def _groups(batches, keys: int):
    """Rows sorted by the first columns, as one list of columns for each key."""
    held, now = None, None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def _loose(similarity: float):
    """Streams (anchor, i, j, node, n, fp) in order; returns the nodes that have a candidate, by the group that candidates join."""

    def run(batches):
        out = []
        for key, rows in _groups(batches, 3):
            if len(rows) < 2:
                continue
            node = np.array([r[0] for r in rows], np.int64)
            pairs = [(a, b) for a, b, _ in Table([r[2] for r in rows], [r[1] for r in rows], similarity).candidates() if len(a)]
            if pairs:
                child, root = _roots(np.concatenate([node[a] for a, _ in pairs]), np.concatenate([node[b] for _, b in pairs]))
                top = np.unique(root)
                out += [(*key, int(r), int(c)) for c, r in zip(np.concatenate([child, top]), np.concatenate([root, top]), strict=True)]
            if len(out) > 50_000:
                yield _batch(out, ("anchor", "i", "j", "sub", "node"))
                out = []
        yield _batch(out, ("anchor", "i", "j", "sub", "node"))

    return run


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("i", "j") else pa.int64()) for c, n in zip(columns, names, strict=True)], names=list(names))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the sets' Jaccard similarity reaches the bound, exactly."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= similarity


def _verified(similarity: float):
    """Streams (anchor, i, j, sub, node, n, fp, shingles) in order; returns a forest of the verified links of each group.

    Candidates go nearest first; one whose ends are joined already needs no look, so a group of near copies costs about
    one comparison a text.
    """

    def run(batches):
        out = []
        for _, rows in _groups(batches, 4):
            node = [r[0] for r in rows]
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            label = np.arange(len(rows))
            for i, j, d in Table([r[2] for r in rows], [r[1] for r in rows], similarity).candidates():
                open_ = np.flatnonzero(label[i] != label[j])
                for k in open_[np.argsort(d[open_], kind="stable")].tolist():
                    a, b = i[k], j[k]
                    if label[a] != label[b] and similar(sets[a], sets[b], similarity):
                        label[label == label[a]] = label[b]
                        out.append((node[a], node[b]))
            if len(out) > 50_000:
                yield _batch(out, ("u", "v"))
                out = []
        yield _batch(out, ("u", "v"))

    return run


def verified_links(nodes: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Edges (u, v) that join exactly what the candidate pairs of similarity or more join.

    nodes has one row (node, n, fp, anchors, run) for each distinct set of shingles; texts has (node, text) for them and maybe
    other rows.  Texts are only sent to the groups in which they have a candidate, as their shingles, and a bitmap keeps most
    others from being shuffled.  The texts of an anchor with more than
    block_bytes of shingles are dealt into blocks, and each pair of blocks is a task.
    """
    rows = nodes.select("run", "node", "n", "fp", F.explode("anchors").alias("anchor"))
    size = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("bigint") * 8).alias("b")).where("k > 1").select("anchor", F.ceil(F.col("b") / block_bytes).cast("int").alias("blocks"))
    rows = send_back(rows, ["anchor"], size).where("blocks IS NOT NULL")
    s = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: t != s)
    deals = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(others, lambda t: F.struct(F.least(s, t).alias("i"), F.greatest(s, t).alias("j"))))
    rows = rows.select("anchor", F.explode(deals).alias("x"), "node", "n", "fp").select("anchor", "x.i", "x.j", "node", "n", "fp")
    order = ["anchor", "i", "j"]
    found = durable(rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(_loose(similarity), "anchor bigint, i int, j int, sub bigint, node bigint"))
    shared = Marks(found.select("node").distinct()).shared

    def wanted(batches):
        for b in batches:
            b = b.filter(pa.array(marked(shared.value, b.column(1).to_numpy())))
            rows = [features(t, words) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.binary())], names=["node", "n", "fp", "shingles"])

    order = [*order, "sub"]
    sets = texts.select("node", Marks.place("node"), utf8("text")).mapInArrow(wanted, "node bigint, n int, fp binary, shingles binary")
    sets = found.join(sets, "node").select(*order, "node", "n", "fp", "shingles")
    return sets.repartition(*order).sortWithinPartitions(*order).mapInArrow(_verified(similarity), "u bigint, v bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, rid_col: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: rid, <id_col>, component (the rid of one of its rows), component_id (its smallest id).

    Two texts link if the Jaccard similarity of their distinct shingles is at least so much, exactly, and their fingerprints
    meet; of pairs at 0.8 that is 99.8 % in expectation, and more above.  Shingles are runs of so many words after lower-casing
    A-Z; fewer words are one shingle.  Null texts count as empty; texts without words are copies of each other.  Null ids
    come last; rows that repeat are rows of their own and always link; an empty table gives an empty table.
    """
    if rid_col is None:
        rid_col = free_name(docs, "rid")
        docs = numbered(docs, rid_col)
    make = lambda: lambda text: features(text, words)[:4]
    rows = small_batches(docs).select(F.col(f"`{rid_col}`").alias("rid"), F.col(f"`{id_col}`").alias("id"), per_text(make, FEATURES.rsplit(",", 1)[0])(utf8(text_col)).alias("x"))
    rows = stored(rows.select("rid", "id", "x.*", F.spark_partition_id().alias("run")))
    # texts with the same shingles are one node, named by its least rid
    same = stored(rows.groupBy("same").agg(F.min("rid").alias("node"), F.min("id").alias("least"), F.min_by(F.struct("n", "fp", "anchors", "run"), "rid").alias("x")).select("same", "node", "least", "x.*"))
    edges = verified_links(same, docs.select(F.col(f"`{rid_col}`").alias("node"), F.col(f"`{text_col}`").alias("text")), words, similarity, block_bytes)
    roots = durable(connected_components(edges))
    own = same.select("same", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a component may hold many nodes: its id goes to them by salted copies
    own = own.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(8)))
    ids = own.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.expr("sequence(0L, 7L)")))
    values = own.join(ids, ["root", "salt"]).select("same", F.col("root").alias("component"), "component_id")
    return send_back(rows.select("rid", "id", "run", "same"), ["same"], values).select("rid", F.col("id").alias(id_col), "component", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the row of the smallest id of each component only (of repeated or null ids the first row); columns as they were.

    A row goes only if a chain of verified links leads to the row that stays; see near_copies.
    """
    rid = free_name(docs, "rid")
    rows = numbered(docs, rid)
    found = stored(near_copies(rows, id_col, text_col, words, similarity, rid).select("rid", F.col(f"`{id_col}`").alias("id"), "component"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("rid"))).alias("x")).select("x.rid")
    dropped = found.select("rid").join(first, "rid", "left_anti").select(F.col("rid").alias(rid))
    return without(rows, dropped, rid).drop(rid)
