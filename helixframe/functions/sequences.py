"""NumPy kernels over one sequence."""

from __future__ import annotations

import math

import numpy as np

# The motif catalogue (consensus, effect weight).
MOTIFS = {
    "TATA": ("TATAAA", 1.0),
    "GATA": ("GATAAG", 0.8),
    "EBOX": ("CACGTG", 0.9),
    "ETS": ("GGAAGT", 0.7),
    "SP1": ("GGGGCGGGG", 0.6),
}
# Fixed value: the AluY consensus.
ALU = "GGCCGGGCGCGGTGGCTCACGCCTGTAATCCCAGCACTTTGGGAGGCCGAGGCGGGCGGATCACGAGGTCAGGAGATCGAGACCATCCCGGCTAAAACGGTGAAACCCCGTCTCTACTAAAAATACAAAAAATTAGCCGGGCGTGGTGGCGGGCGCCTGTAGTCCCAGCTACTCGGGAGGCTGAGGCAGGAGAATGGCGTGAACCCGGGAGGCGGAGCTTGCAGTGAGCCGAGATCGCGCCACTGCACTCCAGCCTGGGCGACAGAGCGAGACTCCGTCTCAAAAAAA"
P_MATCH = 0.85
#: A consensus base scores HIT, any other MISS: the log-odds of 0.85 and 0.05 against a uniform background.
HIT = math.log(P_MATCH + 1e-9) - math.log(0.25 + 1e-9)
MISS = math.log((1 - P_MATCH) / 3 + 1e-9) - math.log(0.25 + 1e-9)
RUN, REPEAT_K = 6, 11

_CODE = np.zeros(256, np.int8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i


def codes(seq: str) -> np.ndarray:
    """A, C, G, T as 0..3 in either case; anything else as 0."""
    return _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


class _Complement(dict):
    def __missing__(self, letter: int) -> str:
        return "N"


_PAIRED = _Complement({ord(a): b for a, b in zip("ACGT", "TGCA", strict=True)})


def reverse_complement(seq: str) -> str:
    """unknown letters become N."""
    return seq[::-1].translate(_PAIRED)


def matches(x: np.ndarray, consensus: str) -> np.ndarray:
    """Bases that agree with the consensus at every start; none for a sequence shorter than it."""
    n = len(x) - len(consensus) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int16)
    for o, want in enumerate(codes(consensus)):
        out += x[o : o + n] == want
    return out.astype(np.int64)


def motif_scan(x: np.ndarray, consensus: str) -> np.ndarray:
    """F8: log-odds of every start."""
    m = matches(x, consensus)
    return m * HIT + (len(consensus) - m) * MISS


def kmer_codes(x: np.ndarray, k: int) -> np.ndarray:
    """Base-4 number of the k bases around every position, A beyond the ends."""
    padded = np.concatenate([np.zeros(k // 2, np.int64), x.astype(np.int64), np.zeros(k, np.int64)])
    return sum(padded[o : o + len(x)] * 4 ** (k - 1 - o) for o in range(k)) if len(x) else np.zeros(0, np.int64)


def moving_average(v: np.ndarray, width: int) -> np.ndarray:
    """Zero padded, the divisor is always the width, which is no more than the length."""
    w = max(1, min(width, len(v)))
    c = np.concatenate([[0.0], np.cumsum(v)])
    i = np.arange(len(v))
    return (c[np.minimum(len(v), i + (w - 1) // 2 + 1)] - c[np.maximum(0, i - w // 2)]) / w


def runs(seq: str) -> list[tuple[int, int]]:
    """(start, end) of runs of one letter, six or more."""
    a = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
    edge = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]) if len(a) else np.zeros(1, int)
    return [(int(s), int(e)) for s, e in zip(edge[:-1], edge[1:], strict=True) if e - s >= RUN]


def word_codes(seq: str, k: int) -> np.ndarray:
    """Base-4 numbers of the k letters from each start on; -1 where one of them is no base, in either case."""
    raw = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    base = _CODE[raw].astype(np.int64)
    unknown = np.concatenate([[0], np.cumsum((_CODE[raw] == 0) & (raw | 32 != ord("a")))])
    code = np.zeros(n, np.int64)
    for o in range(k):
        code = code * 4 + base[o : o + n]
    return np.where(unknown[k:] == unknown[:-k], code, -1)


#: Numbers of the consensus's words on both strands, in order.
REPEAT_WORDS = np.unique(np.concatenate([word_codes(ALU, REPEAT_K), word_codes(reverse_complement(ALU), REPEAT_K)]))


def repeat_mask(seq: str) -> np.ndarray:
    """positions that a word of the repeat covers or that lie in a run; spans are marked at their ends and added up."""
    code = word_codes(seq, REPEAT_K)
    start = np.flatnonzero(REPEAT_WORDS[np.minimum(np.searchsorted(REPEAT_WORDS, code), len(REPEAT_WORDS) - 1)] == code)
    spans = [(start, start + REPEAT_K)]
    if r := runs(seq.upper() if len(seq.upper()) == len(seq) else seq):
        spans.append(tuple(np.array(r).T))
    edge = np.zeros(len(seq) + 1, np.int64)
    for first, last in spans:
        np.add.at(edge, first, 1)
        np.add.at(edge, last, -1)
    return np.cumsum(edge)[:-1] > 0


def probe_features(x: np.ndarray, width: int = 25) -> np.ndarray:
    """(position, 5): the base as one of four, and the centred GC average around it."""
    gc = moving_average(((x == 1) | (x == 2)).astype(float), width) - 0.5 if len(x) else np.zeros(0)
    return np.column_stack([np.eye(4)[x] if len(x) else np.zeros((0, 4)), gc])


def motif_effect(x: np.ndarray, planted: list[tuple[int, str]]) -> np.ndarray:
    """effect (position, base) of planted motifs: weight times the change of log-odds, added where motifs overlap."""
    out = np.zeros((len(x), 4))
    for start, name in planted:
        consensus, weight = MOTIFS[name]
        lo = np.where(np.arange(4) == codes(consensus)[:, None], HIT, MISS)
        ref = x[start : start + len(consensus)]
        out[start : start + len(consensus)] += weight * np.abs(lo - lo[np.arange(len(ref)), ref][:, None])
    return out


#: The three other bases of each base, in order.
OTHERS = np.array([[b for b in range(4) if b != r] for r in range(4)])


def sensitivity(x: np.ndarray, consensus: str) -> np.ndarray:
    """I1-I4 for one motif channel with the max summary: |base - mutant| (position, the 3 other bases in order).

    A mutation changes only the starts that cover it, so the best of all others comes from running maxima to the left and
    right: linear in the length, where encoding each variant anew is quadratic.  Of the starts that cover a position at one offset
    all bases lose its match and one base, the consensus's, gains one, so an offset costs two maxima over small integers.
    """
    n, w = len(x), len(consensus)
    m = matches(x, consensus).astype(np.int16)
    if not (k := len(m)):
        return np.zeros((n, 3))
    every = np.full(n, -1, np.int16)  # the best that any base gets
    every[w:] = np.maximum.accumulate(m)[: k - 1]  # starts before those that cover a position
    every[: k - 1] = np.maximum(every[: k - 1], np.maximum.accumulate(m[::-1])[::-1][1:])  # and after them
    best = np.full((4, n), -1, np.int16)
    for o, want in enumerate(codes(consensus)):
        at = slice(o, o + k)
        without = m - (x[at] == want)
        np.maximum(every[at], without, out=every[at])
        np.maximum(best[want, at], without + 1, out=best[want, at])
    np.maximum(best, every, out=best)
    hits = np.arange(w + 1)
    score = np.maximum(hits * HIT + (w - hits) * MISS, 0.0)
    return np.abs(score[m.max()] - score)[best.ravel()[OTHERS[x] * n + np.arange(n)[:, None]]]


def bigram_table() -> np.ndarray:
    """Log-probabilities of a base after another, from small integers."""
    raw = np.array([[1 + (a * 4 + b) * 7 % 5 for b in range(4)] for a in range(4)], float)
    return np.log(raw / raw.sum(axis=1, keepdims=True))


def loglik_sensitivity(x: np.ndarray) -> np.ndarray:
    """Mean absolute change of the bigram log-likelihood by the 3 mutations of each position; two terms change at most."""
    t, n = bigram_table(), len(x)
    out = np.zeros(n)
    if n:
        padded = np.concatenate([[x[0]], x, [x[-1]]]).astype(np.int64)
        before, after = padded[:-2], padded[2:]
        for b in range(4):
            d = np.zeros(n)
            d[1:] += t[before[1:], b] - t[before[1:], x[1:]]
            d[:-1] += t[b, after[:-1]] - t[x[:-1], after[:-1]]
            out += np.abs(d)
    return out / 3.0
