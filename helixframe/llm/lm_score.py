"""Language-model scores: a subword lattice gives words their marginal probability over all segmentations."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import crc_remainder, durable, small_batches, space_words, table, utf8
from helixframe.llm.pieces import SPACE, default_path, piece_weights

#: Words with at least one in so many of all tokens have their scores broadcast: no more words than that.  All others are joined.
HEAD = 500_000
#: Distinct words that a task counts before it hands them on, and bytes of text.
FLUSH, FLUSH_BYTES = 400_000, 128 << 20
#: Bytes of a word beyond which its lattice is walked with a window instead of being held.
LONG = 2048
#: Classes of documents with word probabilities of their own; what is left shares the last.
CLASSES = 8
#: Part of a class's backing-off mass that goes to words of any class, the rest to its lattice.
SHARED = 0.1
#: Pseudo-counts with which the vocabulary's own scores enter each re-estimation.
PRIOR = 2000.0
ROUNDS = 2


def lattice_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, number 0 standing for none, and their prior probabilities.

    The mark of a word's start is dropped and pieces with capital A-Z, which no lower-cased word has, are left out;
    every single byte is a piece, so that each string has a segmentation.
    """
    prior: Counter = Counter()
    for piece, weight in piece_weights(path).items():
        raw = piece.replace(SPACE, "").encode()
        if raw and raw == raw.lower():
            prior[raw] += math.exp(weight)
    floor = min(prior.values()) / 10
    for b in range(256):
        prior[bytes([b])] += floor
    names = [b"", *sorted(prior)]
    p = np.array([prior[x] if x else 0.0 for x in names])
    return names, p / p.sum()


class Lattice:
    """Probabilities of words under pieces drawn one by one until a stop, for each of several classes.

    A word of k pieces has the probability of its pieces times (1 - stop)^(k - 1) * stop; all its segmentations add up.
    p is (class, piece), stop has a number for each class.
    """

    def __init__(self, names: list[bytes], p: np.ndarray, stop: np.ndarray):
        code = np.array([_hash(x) for x in names[1:]], np.uint64)
        order = np.argsort(code)
        self.code, self.piece = code[order], order.astype(np.int32) + 1
        self.longest = max(map(len, names))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_slot(code)] = True
        with np.errstate(divide="ignore"):
            self.log_p = np.log(p) + np.log1p(-stop)[:, None]
        self.step = p * (1 - stop)[:, None]
        self.close = np.log(stop) - np.log1p(-stop)

    def arcs(self, words: list[bytes]) -> np.ndarray:
        """Piece numbers of the arcs (arc, word) of words that have one length, by end and then start; 0 for none.

        All words at once: an arc's hash grows from that of the arc a byte shorter, and a table of hashed pieces
        says first which arcs can be one.
        """
        n = len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
        out = np.zeros((sum(min(j, self.longest) for j in range(1, n + 1)), len(words)), np.int32)
        first = np.cumsum([0] + [min(j, self.longest) for j in range(1, n)])  # of the arcs that end at j = 1, 2, ...
        code = np.zeros((n, len(words)), np.uint64)
        for size in range(1, min(n, self.longest) + 1):
            code = code[: n - size + 1] * _BASE + raw[size - 1 :]
            start, word = np.nonzero(self.maybe[_slot(code)])
            if len(start):
                found = code[start, word]
                at = np.minimum(np.searchsorted(self.code, found), len(self.code) - 1)
                hit = self.code[at] == found
                start, word = start[hit], word[hit]
                end = start + size
                out[first[end - 1] + np.minimum(end, self.longest) - size, word] = self.piece[at[hit]]
        return out

    def forward(self, ids: np.ndarray, n: int, z: int) -> np.ndarray:
        """Log forward sums (position, word) in class z."""
        alpha = np.zeros((n + 1, ids.shape[1]))
        at, log_p = 0, self.log_p[z]
        for j in range(1, n + 1):
            k = min(j, self.longest)
            x = alpha[j - k : j] + log_p[ids[at : at + k]]
            top = x.max(axis=0)  # every byte is a piece, so one arc at least is finite
            alpha[j] = top + np.log(np.exp(x - top).sum(axis=0))
            at += k
        return alpha

    def ends(self, word: bytes, a: int, b: int) -> np.ndarray:
        """Piece numbers (end, start) of the arcs that end after a and not after b; the starts are the `longest` places before an end."""
        low = max(0, a - self.longest)
        raw = np.frombuffer(word, np.uint8, b - low, low).astype(np.uint64) + np.uint64(1)
        out = np.zeros((b - a, self.longest), np.int32)
        code = np.zeros(len(raw), np.uint64)
        for size in range(1, min(len(raw), self.longest) + 1):
            code = code[: len(raw) - size + 1] * _BASE + raw[size - 1 :]
            start = np.flatnonzero(self.maybe[_slot(code)])
            end = start + (low + size - 1 - a)
            start, end = start[end >= 0], end[end >= 0]
            if len(start):
                at = np.minimum(np.searchsorted(self.code, code[start]), len(self.code) - 1)
                hit = self.code[at] == code[start]
                out[end[hit], self.longest - size] = self.piece[at[hit]]
        return out

    def walk(self, word: bytes, chunk: int = LONG) -> np.ndarray:
        """Natural-log marginal probability in each class of one word of any length: forward sums of the last places only, scaled as they shrink."""
        span = self.longest
        alpha, scale = np.zeros((len(self.close), span + chunk + 1)), np.zeros(len(self.close))
        alpha[:, span] = 1.0
        for a in range(0, len(word), chunk):
            b = min(len(word), a + chunk)
            steps = self.step[:, self.ends(word, a, b)]
            for i in range(b - a):
                if i % 8 == 0:
                    top = alpha[:, i : i + span + 1].max(axis=1)
                    alpha[:, i : i + span + 1] /= top[:, None]
                    scale += np.log(top)
                alpha[:, i + span + 1] = (alpha[:, i + 1 : i + span + 1] * steps[:, i]).sum(axis=1)
            alpha[:, : span + 1] = alpha[:, b - a : b - a + span + 1].copy()
        return np.log(alpha[:, span]) + scale + self.close

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural-log marginal probability (class, word) of words of one length."""
        if len(words[0]) > LONG:
            return np.stack([self.walk(w) for w in words], axis=1)
        ids, n = self.arcs(words), len(words[0])
        return np.stack([self.forward(ids, n, z)[-1] + self.close[z] for z in range(len(self.close))])

    def expected(self, words: list[bytes], z: int) -> np.ndarray:
        """How often each piece is used, in expectation over the segmentations of the words in class z."""
        n, log_p = len(words[0]), self.log_p[z]
        ids = self.arcs(words)
        alpha = self.forward(ids, n, z)
        beta = np.full((n + 1, len(words)), -np.inf)
        beta[n] = 0.0
        weight = np.empty(ids.shape)
        at = len(ids)
        for j in range(n, 0, -1):
            k = min(j, self.longest)
            at -= k
            step = log_p[ids[at : at + k]] + beta[j]
            weight[at : at + k] = np.exp(alpha[j - k : j] + step - alpha[n])
            beta[j - k : j] = np.logaddexp(beta[j - k : j], step)
        return np.bincount(ids.ravel(), weight.ravel(), len(log_p))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(piece: bytes) -> int:
    code = 0
    for b in piece:
        code = (code * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return code


def _slot(code: np.ndarray) -> np.ndarray:
    return (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)


def _merged(batches, rows: int = 20_000):
    """Batches of so many words at least, but for the last: words of one length are computed together."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _by_length(words: list[bytes], longest: int, most: int = 200_000):
    """Indexes of words of one length, at most so many arcs at once."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, of in groups.items():
        step = max(1, most // (n * min(n, longest)))
        for at in range(0, len(of), step):
            yield of[at : at + step]


def sections(words: list[bytes]) -> list[bytes]:
    """Words to re-estimate pieces from: one of more than LONG bytes by sections of so many, whose arcs don't cross the borders."""
    return [w for w in words if len(w) <= LONG] + [w[i : i + LONG] for w in words if len(w) > LONG for i in range(0, len(w), LONG)]


def word_counts(rows: DataFrame, classes: int) -> DataFrame:
    """(word, n, c0, c1, ...): occurrences in all rows, and in those of each class to learn from (z < 0: none).

    rows has text and z.  Tasks add up before the shuffle.
    """

    def batch(n, c):
        out = [(w, -1, 0, k) for w, k in n.items()]
        out += [(w, z, k, 0) for z, of in c.items() for w, k in of.items()]
        word, z, k, m = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(z, pa.int32()), pa.array(k, pa.int64()), pa.array(m, pa.int64())], names=["word", "z", "c", "n"])

    def count(batches):
        n, c, size = Counter(), {}, 0
        for b in batches:
            for text, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = space_words(text)
                (n if z < 0 else c.setdefault(z, Counter())).update(words)
                size += len(text)
                if size > FLUSH_BYTES or len(n) + sum(map(len, c.values())) > FLUSH:
                    yield batch(n, c)
                    n, c, size = Counter(), {}, 0
        yield batch(n, c)

    parts = rows.select(utf8("text").alias("t"), "z").mapInArrow(count, "word binary, z int, c bigint, n bigint")
    return parts.groupBy("word").agg(F.sum(F.col("n") + F.col("c")).alias("n"), *[F.sum(F.when(F.col("z") == z, F.col("c")).otherwise(0)).alias(f"c{z}") for z in range(classes)])


def fit_lattice(words: DataFrame, classes: int, path: str, rounds: int = ROUNDS, prior: float = PRIOR) -> Lattice:
    """Piece probabilities of each class, re-estimated over all its distinct words, each once, from the vocabulary's scores on.

    What comes to the driver is one number for each class and piece of the vocabulary.
    """
    sc = words.sparkSession.sparkContext
    names, p0 = lattice_pieces(path)
    p, stop = np.tile(p0, (classes, 1)), np.full(classes, 0.3)
    for _ in range(rounds):
        shared = sc.broadcast(Lattice(names, p, stop))

        def use(batches, shared=shared):
            total, n = np.zeros(shared.value.log_p.shape), np.zeros(classes)
            for b in _merged(batches):
                of = b.column(0).to_pylist()
                for z in range(classes):
                    mine = [of[i] for i in np.flatnonzero(b.column(1 + z).to_numpy())]
                    n[z] += len(mine)
                    mine = sections(mine)
                    for group in _by_length(mine, shared.value.longest):
                        total[z] += shared.value.expected([mine[i] for i in group], z)
            z, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([*range(classes), *z], pa.int32()), pa.array([*[-1] * classes, *piece], pa.int32()), pa.array([*n, *total[z, piece]], pa.float64())], names=["z", "piece", "used"])

        parts = words.select("word", *[f"c{z}" for z in range(classes)]).mapInArrow(use, "z int, piece int, used double")
        used, n = np.zeros(p.shape), np.zeros(classes)
        for r in parts.groupBy("z", "piece").agg(F.sum("used").alias("used")).collect():
            if r["piece"] < 0:
                n[r["z"]] = r["used"]
            else:
                used[r["z"], r["piece"]] = r["used"]
        stop = np.where(n > 0, np.clip(n / np.maximum(used.sum(axis=1), 1.0), 0.02, 0.95), stop)
        used += prior * p0
        p = used / used.sum(axis=1, keepdims=True)
    return Lattice(names, p, stop)


def lm_scores(docs: DataFrame, learn_col: str, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, path: str | None = None, head: int = HEAD, rounds: int = ROUNDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: rid, <id_col>, n_tokens, n_known, train_tokens, base_score, score, and columns to keep.

    Tokens are words of an A-Z-lower-cased text and one end.  base_score adds log10((c + 1) / (N + V + 1)).  score is
    the log10 probability of the text, a mixture over classes of documents, which class_col names for the rows to learn
    from and nothing names when scoring.  In class z a word has (max(c - D, 0) + (D V + 1) Q) / (N + 2): D is the absolute
    discount n1 / (n1 + 2 n2), and Q is for the most part the word's marginal probability over all its segmentations into
    pieces, for the rest its share of all words.  The end has (c + 1) / (N + 2).  All strings' probabilities add up to one.

    Null texts are empty: an end alone.  A null in learn_col means no; a null class is one of its own.  Repeated rows
    count and are scored as rows of their own.  Without rows to learn from the pieces decide alone; an empty table gives an
    empty table.  Columns of docs other than those named don't matter.

    Words are counted over all rows.  Those that make up one in `head` tokens or more, so `head` words at most, are broadcast; every other word of a document
    is joined with its score.  Such a word makes up one in `head` tokens at most, and a key that still is large is split by
    AQE, as the side that has it is the outer join's left one.  A document's own columns travel with its first row, so rows
    are numbered and read in one scan and never matched with another.
    """
    sc = small_batches(docs).sparkSession.sparkContext
    kind = F.coalesce(F.col(f"`{class_col}`").cast("string"), F.lit("")) if class_col else F.lit("")
    own = F.struct(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)])
    rows = docs.select(own.alias("own"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{learn_col}`"), F.lit(False)).alias("learn"), kind.alias("kind"))
    sizes = rows.where("learn").groupBy("kind").count().orderBy(F.desc("count"), "kind")
    top = sizes.limit(CLASSES).collect()
    names = [r["kind"] for r in top][: CLASSES - 1 if len(top) == CLASSES else CLASSES]
    classes = len(names) + (len(top) == CLASSES) or 1
    z = F.coalesce(*[F.when(F.col("kind") == n, F.lit(i)) for i, n in enumerate(names)], F.lit(classes - 1))
    rows = rows.withColumn("z", F.when(F.col("learn"), z).otherwise(F.lit(-1)).cast("int"))
    ends = np.zeros(classes)
    for r in rows.where("learn").groupBy("z").count().collect():
        ends[r["z"]] = r["count"]

    counts = durable(word_counts(rows, classes))
    c_all = sum((F.col(f"c{z}") for z in range(classes)), F.lit(0))
    stats = [F.coalesce(F.sum(f"c{z}"), F.lit(0)).alias(f"n{z}") for z in range(classes)] + [F.count_if(F.col(f"c{z}") > 0).alias(f"v{z}") for z in range(classes)]
    s = counts.agg(*stats, F.count_if(c_all > 0).alias("v"), F.count_if(c_all == 1).alias("once"), F.count_if(c_all == 2).alias("twice")).first()
    n_z, v_z = (np.array([s[f"{k}{z}"] for z in range(classes)], float) for k in "nv")
    total, distinct = int(n_z.sum() + ends.sum()), s["v"] + int(ends.sum() > 0)
    discount = s["once"] / (s["once"] + 2 * s["twice"]) if s["once"] and s["twice"] else 0.5
    reserve, below = discount * v_z + 1, n_z + ends + 2
    common = SHARED if n_z.sum() else 0.0
    lattice = sc.broadcast(fit_lattice(counts, classes, path or default_path(), rounds))
    word_total = max(n_z.sum(), 1.0)

    def marginal(batches):
        for b in _merged(batches):
            words = b.column(0).to_pylist()
            out = np.zeros((classes, len(words)))
            for group in _by_length(words, lattice.value.longest):
                out[:, group] = lattice.value.log_probability([words[i] for i in group])
            c = np.stack([b.column(2 + z).to_numpy().astype(float) for z in range(classes)])
            # in log space, as a long word's probability is less than the least float
            with np.errstate(divide="ignore"):
                seen = np.log(np.maximum(c - discount, 0) + reserve[:, None] * common * c.sum(axis=0) / word_total)
            score = (np.logaddexp(seen, np.log(reserve * (1 - common))[:, None] + out) - np.log(below)[:, None]) / math.log(10)
            known = c.sum(axis=0)
            columns = [b.column(0), b.column(1), pa.array(known > 0), pa.array(np.log10((known + 1) / (total + distinct + 1))), *map(pa.array, score)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "known", "base", *[f"s{z}" for z in range(classes)]])

    each = ", ".join(f"s{z} double" for z in range(classes))
    scored = durable(counts.mapInArrow(marginal, f"word binary, n bigint, known boolean, base double, {each}"))
    tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = scored.where(F.col("n") * head >= tokens).collect()
    shared = sc.broadcast(({bytes(r["word"]): i for i, r in enumerate(top)}, np.array([[r["known"], r["base"], *[r[f"s{z}"] for z in range(classes)]] for r in top], float).reshape(len(top), 2 + classes)))
    end = np.array([float(ends.sum() > 0), math.log10((ends.sum() + 1) / (total + distinct + 1)), *np.log10((ends + 1) / below)])

    def split(batches):
        index, values = shared.value
        for b in batches:
            rids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            doc, at, times, rid, word, k, n = [], [], [], [], [], [], []
            for d, (r, text) in enumerate(zip(rids, texts, strict=True)):
                tokens = space_words(text)
                n.append(len(tokens) + 1)
                for w, m in Counter(tokens).items():
                    if (i := index.get(w)) is not None:
                        doc.append(d), at.append(i), times.append(m)
                    else:
                        rid.append(r), word.append(w), k.append(m)
            got = np.array(times, float)[:, None] * values[np.array(at, np.int64)]
            sums = [np.bincount(np.array(doc, np.int64), got[:, i], len(rids)) + end[i] for i in range(2 + classes)]
            # after the tail words a row for each document itself: its key has a space, so it is no word, and spreads the rows
            rest = np.zeros(len(rid))
            columns = [pa.array(rid + rids, pa.int64()), pa.array(word + [b" " + r.to_bytes(8, "big") for r in rids], pa.binary()), pa.array(k + [0] * len(rids), pa.int64()), pa.array([0] * len(rid) + n, pa.int64())]
            columns += [pa.array(np.concatenate([rest, x])) for x in sums]
            columns.append(b.column(2).take(pa.array([None] * len(rid) + [*range(len(rids))], pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "word", "k", "n", "n_known", "base", *[f"s{z}" for z in range(classes)], "own"])

    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), utf8("text").alias("t"), "own")
    parts = numbered.mapInArrow(split, f"rid bigint, word binary, k bigint, n bigint, n_known double, base double, {each}, own {rows.schema['own'].dataType.simpleString()}")
    tail = scored.select("word", F.col("known").alias("w_known"), F.col("base").alias("w_base"), *[F.col(f"s{z}").alias(f"w{z}") for z in range(classes)])
    plus = lambda own, of: F.sum(F.col(own) + F.coalesce(F.col("k") * F.col(of), F.lit(0.0)))
    sums = (
        parts.join(tail, "word", "left")
        .groupBy("rid")
        .agg(
            F.first("own", ignorenulls=True).alias("own"),
            F.sum("n").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(F.col("w_known"), F.col("k")).otherwise(0)).cast("bigint").alias("n_known"),
            plus("base", "w_base").alias("base_score"),
            *[plus(f"s{z}", f"w{z}").alias(f"s{z}") for z in range(classes)],
        )
    )
    # the mixture over classes, in log space
    prior = np.log10((ends + 1) / (ends.sum() + classes))
    parts_z = [F.col(f"s{z}") + F.lit(float(prior[z])) for z in range(classes)]
    best = F.greatest(*parts_z) if classes > 1 else parts_z[0]
    mixed = best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in parts_z), F.lit(0.0)))
    return sums.select("rid", F.col("own.id").alias(id_col), *[F.col(f"own.k{i}").alias(k) for i, k in enumerate(keep)], "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", mixed.alias("score"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", crc_remainder("doc_id", 7) == 2).withColumn("learn", ~F.col("held_out"))
    return lm_scores(docs, "learn", class_col="lang", keep=("held_out",)).drop("rid")
