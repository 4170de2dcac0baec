"""SimHash fingerprints and their links by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import durable, free_name, per_text, small_batches, space_words, table, utf8
from helixframe.llm.components import connected_components, send_back

#: Table rows of one slot in one task; the queries of a larger slot are dealt over several copies of it.
SLOT_ROWS = 20_000
SEED = 42
#: Copies of a component's id.
SALTS = 8


def fingerprint(text: bytes, shingle: int = 4, seeds: tuple[int, ...] = (SEED,), repeats: bool = True) -> tuple[int, ...]:
    """64 bits for each seed, as signed numbers: a bit is set if more than half of the shingles' XXH64 have it.

    Shingles are runs of so many words, with repeats or each once; fewer words make one shingle, none the number 0.
    """
    words = space_words(text)
    if not words:
        return (0,) * len(seeds)
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) if len(words) >= shingle else [b" ".join(words)]
    if not repeats:
        shingles = list(set(shingles))
    return tuple(_majority(shingles, seed) for seed in seeds)


def _majority(shingles: list[bytes], seed: int) -> int:
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65536):
        raw = b"".join([digest(s, seed) for s in shingles[at : at + 65536]])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(shingles)).view(">i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4, seeds: tuple[int, ...] = (SEED,), name: str = "fp", repeats: bool = True) -> DataFrame:
    """docs with columns <name>0, <name>1, ...: a fingerprint as a bigint for each seed; null texts count as empty."""

    def make():
        return lambda text: fingerprint(text, shingle, seeds, repeats)

    held = free_name(docs, f"{name}_struct")
    parts = range(len(seeds))
    out = small_batches(docs).withColumn(held, per_text(make, ", ".join(f"f{i} bigint" for i in parts))(utf8(text_col)))
    return out.withColumns({f"{name}{i}": F.col(f"`{held}`.f{i}") for i in parts}).drop(held)


def segments(distance: int, n: int, parts: int = 1) -> list[tuple[int, int, int, int]]:
    """(part, shift, bits, radius) of each segment to look in, so that no pair within the distance is missed.

    Of m segments with distance = m r + a, either one of the first a + 1 differs in r bits at most or one of the
    others in r - 1: radius -1 needs no look.  m follows the number of fingerprints, so that a slot holds few by chance;
    whatever m is, no link is lost.
    """
    m = next((m for m in range(1, 64) if 64 // m <= max(12, n.bit_length()) + 4 and distance // (m * parts) <= 2), 64)
    radius, extra = divmod(distance, m * parts)
    widths = [64 // m + (i < 64 % m) for i in range(m)] * parts
    return [(i // m, sum(widths[i // m * m : i]), w, r) for i, w in enumerate(widths) if (r := radius if i <= extra else radius - 1) >= 0]


def _slots(plan: list[tuple[int, int, int, int]], prints: DataFrame, fps: list[str]) -> DataFrame:
    """(seg, k, query, node, fps): query 0 enters a fingerprint in the table of its segment, query 1 asks there for what differs by a mask.

    Of two keys that differ by a mask, only the one without the mask's lowest bit asks for the other.
    """
    looks = []
    for i, (part, shift, bits, radius) in enumerate(plan):
        key = f"(shiftrightunsigned({fps[part]}, {shift}) & {(1 << bits) - 1}L)" if bits < 64 else fps[part]
        masks = [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]
        base = f"array(struct({key} AS k, 0 AS query))"
        if masks:
            listed = ", ".join(f"{m}L" for m in masks)
            ask = f"transform(filter(array({listed}), m -> ({key} & m & -m) = 0), m -> struct({key} ^ m AS k, 1 AS query))"
            base = f"concat({base}, {ask})"
        looks.append(f"transform({base}, x -> struct({i}L AS seg, x.k AS k, x.query AS query))")
    out = prints.select("node", *fps, F.explode(F.expr(f"concat({', '.join(looks)})")).alias("x"))
    return out.select(F.col("x.seg").alias("seg"), F.col("x.k").alias("k"), F.col("x.query").cast("int").alias("query"), "node", *fps)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as a forest: each node but the roots with the least node that these links reach from it."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose parts are on the first axis."""
    # as unsigned numbers: of a negative one, bitwise_count takes the absolute value
    return sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16) for x, y in zip(a, b, strict=True))


def _match(distance: int, parts: int):
    """Streams rows sorted by (seg, k, salt, query), links each slot's table with itself and its queries, returns forests.

    query: -1 for a row of the table only, 0 for one that asks too, 1 for one that only asks.
    """

    def links(key: np.ndarray, query: np.ndarray, node: np.ndarray, fp: np.ndarray):
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [len(key)]])
        tables = np.add.reduceat((query <= 0).astype(np.int64), starts)
        silent = np.add.reduceat((query < 0).astype(np.int64), starts)
        busy = (tables > 0) & (ends - starts > 1)
        found_a, found_b = [], []
        # slots of few rows all at once: row i against rows i+1, i+2, ... of its slot; larger ones in blocks
        small = busy & (ends - starts <= 64)
        if small.any():
            owner = np.repeat(np.arange(len(starts)), ends - starts)
            idx = np.flatnonzero(small[owner] & (query <= 0))
            left = ends[owner[idx]] - idx - 1
            for step in range(1, 64):
                idx, left = idx[left >= step], left[left >= step]
                if not len(idx):
                    break
                other = idx + step
                ok = (_far(fp[:, idx], fp[:, other]) <= distance) & (node[idx] != node[other])
                found_a.append(node[idx[ok]])
                found_b.append(node[other[ok]])
        for g in np.flatnonzero(busy & ~small):
            table, ask = slice(starts[g], starts[g] + tables[g]), np.arange(starts[g] + silent[g], ends[g])
            for at in range(0, len(ask), step := max(1, 2_000_000 // tables[g])):
                part = ask[at : at + step]
                i, j = np.nonzero(_far(fp[:, part, None], fp[:, None, table]) <= distance)
                a, b = node[part[i]], node[table][j]
                if (a != b).any():
                    a, b = _roots(a[a != b], b[a != b])
                    found_a.append(a)
                    found_b.append(b)
        if sum(map(len, found_a)):
            return _roots(np.concatenate(found_a), np.concatenate(found_b))
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def run(batches):
        held = None
        for b in _ended(batches):
            if b is not None:
                now = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5 + parts)]
                if held is not None:
                    now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
                key = np.stack(now[:3], axis=1)
                # the last slot may go on in the next batch
                last = np.flatnonzero((key != key[-1]).any(axis=1)) if len(key) else []
                cut = last[-1] + 1 if len(last) else 0
                held = [x[cut:] for x in now]
            else:
                now, cut = held, 0 if held is None else len(held[0])
            if cut:
                u, v = links(np.stack([x[:cut] for x in now[:3]], axis=1), now[3][:cut], now[4][:cut], np.stack([x[:cut] for x in now[5:]]))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _ended(batches):
    yield from batches
    yield None


def hamming_links(prints: DataFrame, plan: list[tuple[int, int, int, int]], distance: int, fps: list[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Edges (u, v) between nodes that join exactly what the pairs within the distance that meet in the plan's segments join.

    prints has one row (node, fps) for each distinct fingerprint, which may have several parts.  Each enters the table
    of each segment and asks there for every key within the segment's radius; matches are verified over all bits.
    A slot returns a forest of its links, not its pairs.  A slot whose table exceeds slot_rows is copied, and its
    queries are dealt over the copies.  Ties don't arise, as a forest of any order joins the same; nodes are distinct and
    not null, and without nodes there are no edges.
    """
    rows = _slots(plan, prints, fps)
    # only a slot's table is copied, silent; its rows ask in one of the copies
    hot = durable(rows.where("query = 0").groupBy("seg", "k").count().where(F.col("count") > slot_rows).select("seg", "k", F.ceil(F.col("count") / slot_rows).cast("int").alias("copies")))
    if hot.isEmpty():
        rows = rows.withColumn("salt", F.lit(0))
    else:
        rows = rows.join(hot, ["seg", "k"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
        ask = F.pmod(F.xxhash64("node"), F.col("copies")).cast("int")
        asking = rows.where("query = 0 AND copies > 1").withColumn("query", F.lit(1)).withColumn("salt", ask)
        rows = rows.withColumn("salt", F.explode(F.when(F.col("query") == 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(ask))))
        rows = rows.withColumn("query", F.when((F.col("query") == 0) & (F.col("copies") > 1), F.lit(-1)).otherwise(F.col("query"))).unionByName(asking).drop("copies")
    spread = rows.select("seg", "k", "salt", "query", "node", *fps).repartition("seg", "k", "salt").sortWithinPartitions("seg", "k", "salt", "query")
    return spread.mapInArrow(_match(distance, len(fps)), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, seeds: tuple[int, ...] = (SEED,), repeats: bool = True) -> DataFrame:
    """One row for each row of docs: rid, <id_col>, fp0 (and fp1, ... for more seeds), root, component_id.

    Fingerprints of 64 bits a seed link at distance bits or fewer; root names the component and component_id is the smallest id reachable, the row's
    own included.  No pair within the distance is missed, at any number of rows.  Null texts count as empty and get fingerprint 0, linked like any other; a null id never is a
    component's id unless all its ids are null; rows that repeat are separate rows; an empty table gives an empty table.
    """
    fps = [f"fp{i}" for i in range(len(seeds))]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = fingerprints(rows, "text", shingle, seeds, repeats=repeats).select("id", *fps, F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("rid"))
    # one part is its own node; several are named by the first row that has them
    rows = durable(rows)
    prints = rows.groupBy(*fps).agg(F.min("id").alias("least"), F.min("rid").alias("first"))
    prints = durable(prints.select(F.col("fp0" if len(fps) == 1 else "first").alias("node"), *fps, "least"))
    plan = segments(distance, prints.count(), len(seeds))
    roots = durable(connected_components(hamming_links(prints.select("node", *fps), plan, distance, fps)))
    own = prints.join(roots, "node", "left")
    # one component may hold many fingerprints: its id goes to them by salted copies; those without a link need none
    linked = own.where("root IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    alone = own.where("root IS NULL").select(*fps, F.col("node").alias("root"), F.col("least").alias("component_id"))
    values = linked.join(ids, ["root", "salt"]).select(*fps, "root", "component_id").unionByName(alone)
    return send_back(rows, fps, values).select("rid", F.col("id").alias(id_col), *fps, "root", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
