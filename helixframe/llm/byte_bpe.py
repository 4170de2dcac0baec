"""Byte-level BPE: merges by a segment tree over byte positions that holds the leftmost pair of least rank."""

from __future__ import annotations

import base64
from array import array

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import free_name, per_text, small_batches, table, utf8

#: Pre-tokens that one Python worker remembers; beyond that it starts afresh.  Bounds memory, not results.
MEMO = 100_000
_NONE = 1 << 62
_SHIFT = 32


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes from a rank file: a line holds the token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    The leaf of a live position holds rank << 32 | position of the pair that starts there, so the root is the
    leftmost pair of least rank.  A merge removes the right part and updates the leaves of the merged
    part, its left neighbour and the removed position: three paths to the root.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    tree = [_NONE] * (2 * size)
    end = list(range(1, n + 1))  # where the part that starts here ends; the next part starts there
    before = list(range(-1, n))  # where the part before this one starts
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << _SHIFT | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while (least := tree[1]) != _NONE:
        at = least & 0xFFFFFFFF
        gone = end[at]
        stop = end[gone]
        end[at] = stop
        if stop < n:
            before[stop] = at
            r = get(piece[at : end[stop]])
            changed = [(gone, _NONE), (at, _NONE if r is None else r << _SHIFT | at)]
        else:
            changed = [(gone, _NONE), (at, _NONE)]
        if (left := before[at]) >= 0:
            r = get(piece[left:stop])
            changed.append((left, _NONE if r is None else r << _SHIFT | left))
        for k, value in changed:
            k += size
            if tree[k] == value:
                continue
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                value = a if a < b else b
                if tree[k] == value:
                    break
                tree[k] = value
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Merger:
    """The same merges for many short pre-tokens at once: one segment tree a row, all rows merge their best pair in step."""

    longest = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        keys, values = array("q"), array("q")
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make, or a number above all ranks."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], 1 << 40)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > self.longest:
                out[i] = np.array(merge(p, self.ranks), "<u4").tobytes()
            else:
                sizes.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(i)
        for size, of in sizes.items():
            for at in range(0, len(of), 20_000):
                part = of[at : at + 20_000]
                for i, ids in zip(part, self._rows([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        rows, none = len(pieces), 1 << 60
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(rows, size)
        ids = np.zeros((rows, size + 1), np.int64)
        ids[:, :size] = self.byte[raw]
        place = np.arange(size)
        following = np.tile(np.arange(1, size + 2), (rows, 1))
        before = np.tile(np.arange(-1, size), (rows, 1))
        alive = place < length[:, None]
        tree = np.full((rows, 2 * size), none, np.int64)
        r, c = np.nonzero(place[:-1] + 1 < length[:, None])
        rank = self.pair_ranks(ids[r, c], ids[r, c + 1])
        tree[r, size + c] = np.where(rank < 1 << 40, rank << 8 | c, none)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < none)
        while len(row):
            least = tree[row, 1]
            at = least & 0xFF
            gone = following[row, at]
            stop = following[row, gone]
            left = before[row, at]
            ids[row, at] = least >> 8
            following[row, at] = stop
            alive[row, gone] = False
            inside = stop < length[row]
            before[row[inside], stop[inside]] = at[inside]
            tree[row, size + gone] = none
            fresh = np.full(len(row), none)
            rank = self.pair_ranks(ids[row[inside], at[inside]], ids[row[inside], stop[inside]])
            fresh[inside] = np.where(rank < 1 << 40, rank << 8 | at[inside], none)
            tree[row, size + at] = fresh
            has = left >= 0
            rank = self.pair_ranks(ids[row[has], left[has]], ids[row[has], at[has]])
            tree[row[has], size + left[has]] = np.where(rank < 1 << 40, rank << 8 | left[has], none)
            # the live neighbours' paths to the root, one level at a time
            k = np.concatenate([size + gone, size + at, size + left[has]])
            of = np.concatenate([row, row, row[has]])
            step = size
            while step > 1:
                k = k >> 1
                tree[of, k] = np.minimum(tree[of, 2 * k], tree[of, 2 * k + 1])
                step //= 2
            row = row[tree[row, 1] < none]
        ends = np.cumsum(alive.sum(axis=1)) * 4
        flat = ids[:, :size][alive].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


_workers: dict[tuple[str, str], tuple] = {}


def _codec(path: str, pattern: str):
    """Merger, tokens by id, the compiled pattern and the memo of a worker; they outlive a task."""
    if (path, pattern) not in _workers:
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _workers[path, pattern] = Merger(ranks), tokens, regex.compile(pattern), {}
    return _workers[path, pattern]


def encoder(path: str, pattern: str, memo: int = MEMO):
    """A function from a list of text bytes to their ids, each packed as little-endian unsigned 32-bit integers."""
    merger, _, compiled, known = _codec(path, pattern)

    def encode(texts: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 256):
            parts = [compiled.findall(t.decode("utf-8", "replace")) for t in texts[at : at + 256]]
            if len(known) > memo:
                known.clear()
            new = list(set().union(*parts).difference(known))
            known.update(zip(new, merger([p.encode() for p in new]), strict=True))
            out += [b"".join(map(known.__getitem__, p)) for p in parts]
        return out

    return encode


def decoder(path: str, pattern: str):
    """A function from packed ids to bytes."""
    _, tokens, _, _ = _codec(path, pattern)
    return lambda ids: b"".join(map(tokens.__getitem__, memoryview(ids).cast("I") if len(ids) else ()))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """docs with a binary column <name>: the ids of the whole text, packed little-endian; see unpack.

    Each match of the pattern is encoded by itself; no special tokens.  Null texts count as empty and have no ids.
    A worker remembers the ids of pre-tokens it has met, so merges run once for each distinct one.  Of equal ranks the
    leftmost pair goes first.  Rows that repeat are encoded alike, and an empty table gives an empty one.  If docs has a
    column <name>, underscores go in front of the new one's.
    """

    def make():
        many, ready = encoder(path, pattern), []

        def one(_: bytes):
            return (ready.pop(),)

        def prepare(texts: list[bytes]) -> None:
            ready[:] = many(texts)[::-1]

        one.prepare = prepare
        return one

    return small_batches(docs).withColumn(free_name(docs, name), per_text(make, "ids binary")(utf8(text_col))["ids"])


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """docs with a binary column <name>: the bytes of the packed ids; null and empty ids give no bytes.

    Rows that repeat are decoded alike, and an empty table gives an empty one.  An id that the vocabulary lacks is an error.  If
    docs has a column <name>, underscores go in front of the new one's.
    """

    def make():
        one = decoder(path, pattern)
        return lambda ids: (one(ids),)

    return small_batches(docs).withColumn(free_name(docs, name), per_text(make, "bytes binary")(F.coalesce(F.col(f"`{ids_col}`"), F.lit(b"")))["bytes"])


def unpack(ids: str) -> Column:
    """The packed ids of a column as array<int>."""
    four = lambda i: F.substring(F.hex(F.col(ids)), i * 8 + 1, 8)
    return F.transform(
        F.when(F.octet_length(F.col(ids)) > 0, F.sequence(F.lit(0), (F.octet_length(F.col(ids)) / 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.concat(*[F.substring(four(i), F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("int"),
    )


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the columns of encode and decode, made by one worker in one pass: the text isn't sent to a second one.

    What they say of nulls, repeats, empty tables and columns of the same names holds here too.
    """

    def make():
        many, back, ready = encoder(path, pattern), decoder(path, pattern), []

        def one(_: bytes):
            packed = ready.pop()
            return packed, back(packed)

        def prepare(texts: list[bytes]) -> None:
            ready[:] = many(texts)[::-1]

        one.prepare = prepare
        return one

    held = free_name(docs, "bpe")
    out = small_batches(docs).withColumn(held, per_text(make, "ids binary, decoded binary")(utf8(text_col)))
    ids = free_name(docs, ids)
    out = out.withColumn(ids, F.col(f"`{held}`.ids"))
    return out.withColumn(free_name(out, decoded), F.col(f"`{held}`.decoded")).drop(held)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded from the ids.

    Null texts count as empty; rows that repeat, null ids included, are rows of their own; an empty table gives an empty one.
    """
    out = round_trip(docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text")), path, pattern)
    return out.select(id_col, F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary() -> tuple[str, str]:
    """The rank file and pattern of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *vocabulary())
