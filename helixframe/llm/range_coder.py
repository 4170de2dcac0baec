"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block's ids are cut into lanes, which are coded in step, one id of each at a time, as NumPy rows; they share one model.
The last two ids and the last one each propose the id that followed them most steadily before; how steadily, and how frequent
the proposed id is by itself, are three predictions whose log odds a small online mixer weighs into the probability that
the proposal is right.  A second mixer does so for the order-1 proposal where it differs.  An id that is neither is coded
by adaptive order-0 frequencies.  What is true of an id is one part of the whole, so that it narrows its lane's range once.
Predictions have few states, so mixers work out all their answers at once, and learn from some steps at a time.  All of it
is integer arithmetic, so every machine decodes alike.
"""

from __future__ import annotations

import struct
from zlib import crc32

import numpy as np

#: Ids of a block; lanes of a block at most, and ids of a lane at least, where there is more than one.
BLOCK, LANES, LANE = 1 << 22, 8192, 256
#: What a block begins with: mark, version, number of ids, of the vocabulary's ids, crc32 of the ids, 16-bit words that follow.
HEADER = struct.Struct("<4sBIIII")
MARK, VERSION = b"HXRC", 3
#: Most ids of a block and of a vocabulary.
_LONGEST, _WIDEST = 1 << 24, 1 << 18

#: Ranges have this at least between ids; parts are out of _WHOLE, of which _ROOM at least is left to frequencies.
_TOP, _WHOLE, _ROOM = 1 << 48, 1 << 31, 1 << 19
_SLOTS2, _SHARES = 16, 1 << 16
#: Steps after which mixers learn, and after which frequencies are summed up, once many steps are over.
_LEARN, _SUM = 32, 64
_p = (np.arange(4096) + 0.5) / 4096
_STRETCH = np.clip(np.rint(256 * np.log(_p / (1 - _p))), -2047, 2047).astype(np.int64)
_SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 1, 4094).astype(np.uint32)
_U64, _U32 = np.uint64, np.uint32


class _Mixer:
    """Probability, of 4096, that a proposal is right, for every combination of some predictions' states: their log odds
    are weighed by weights which, like the predictions, are learnt as it goes."""

    def __init__(self, *states: int):
        self.states = states
        self.p = [np.full(n, 1 << 14, np.int64) for n in states]
        self.w = [28_000] * len(states)
        self.told: list[np.ndarray] = []
        self._mix()

    def _mix(self) -> None:
        self.odds = [_STRETCH[p >> 4].reshape([-1 if i == k else 1 for k in range(len(self.p))]) for i, p in enumerate(self.p)]
        total = sum(w * o for w, o in zip(self.w, self.odds, strict=True)) >> 16
        self.table = _SQUASH.take(total + 2047, mode="clip").ravel()
        self.part = self.table * _U32(_WHOLE >> 12)

    def tell(self, state: np.ndarray, hit: np.ndarray) -> None:
        """The proposals in these states were right or not."""
        self.told.append(state * 2 + hit)

    def learn(self) -> None:
        told, self.told = np.concatenate(self.told) if self.told else (), []
        if not len(told):
            return
        seen = np.bincount(told, minlength=2 * len(self.table)).reshape(*self.states, 2)
        hits, n = seen[..., 1], seen.sum(-1)
        miss = (hits << 12) - n * self.table.reshape(self.states).astype(np.int64)
        for i, (p, o) in enumerate(zip(self.p, self.odds, strict=True)):
            self.w[i] += int((miss * o).sum()) // len(told) >> 3
            rest = tuple(k for k in range(len(self.p)) if k != i)
            m = n.sum(rest)
            p += (65535 * hits.sum(rest) - m * p) // (m + 64)
        self._mix()


class _Model:
    """What the lanes have seen; the encoder and the decoder take the same steps.

    A step is for the first k lanes, as lanes that are shorter come last; in it, r are the numbers of some of these.
    """

    def __init__(self, lanes: int, ids: int):
        self.ids = ids
        self.one, self.two = np.zeros(ids, np.int32), np.zeros(1 << _SLOTS2, np.int32)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.seen, self.new = np.zeros(ids, np.int64), []
        self.first, self.second = _Mixer(16, 32, 16), _Mixer(16, 16)
        self.steps = 0
        self._sum()

    def _sum(self) -> None:
        """Frequencies, and those below each id: a share of about _SHARES for the times it was seen, and one besides."""
        if self.new:
            self.seen += np.bincount(np.concatenate(self.new), minlength=self.ids)
            self.new = []
        self.share = 1 + self.seen * _SHARES // max(int(self.seen.sum()), _SHARES >> 5)
        ends = np.cumsum(self.share)
        self.total = _U32(ends[-1])
        self.below, self.share = (ends - self.share).astype(_U32), self.share.astype(_U32)
        self.size = np.minimum(np.frexp(self.seen.astype(float))[1], 15).astype(np.int32)
        self.slots = None

    def propose(self, k: int):
        """The proposals of a step, and the part of the whole in which they are right, which begins it."""
        mixed = self.last[:k] * np.uint32(2654435761) + self.before[:k] * np.uint32(2246822519) >> np.uint32(32 - _SLOTS2)
        self.at1, self.at2 = self.last[:k].astype(np.int64), mixed.astype(np.int64)
        self.e1, self.e2 = self.one.take(self.at1, mode="clip"), self.two.take(self.at2, mode="clip")
        self.c1, self.c2 = self.e1 >> 4, self.e2 >> 4
        self.f1, self.f2 = self.e1 & 15, self.e2 & 15
        c = np.where(self.f2 > 0, self.c2, self.c1)
        same = c == self.c1
        self.state = (self.f2 << 9) + (same.astype(np.int32) << 8) + (self.f1 << 4) + self.size.take(c, mode="clip")
        self.more = (self.f1 > 0) & ~same
        return c, self.first.part.take(self.state, mode="clip")

    def again(self, r: np.ndarray, first: np.ndarray):
        """For lanes whose proposal is wrong: where that leaves off, whether there is an order-1 proposal, which, the part in which
        it is right, and the unit of the frequencies, which have the rest."""
        begin, more, c1 = first.take(r), self.more.take(r), self.c1.take(r)
        room = _U32(_WHOLE) - begin
        self.state2 = (self.f1.take(r) << 4) + self.size.take(c1, mode="clip")
        part = np.minimum((room >> _U32(12)) * self.second.table.take(self.state2, mode="clip"), room - _U32(_ROOM)) * more
        return begin, more, c1, part, (room - part) // self.total

    def tell_again(self, more: np.ndarray, hit: np.ndarray) -> None:
        self.second.tell(self.state2[more], hit[more])

    def update(self, k: int, x: np.ndarray) -> None:
        fresh = x << 4 | 1
        for table, at, e, c, f in ((self.one, self.at1, self.e1, self.c1, self.f1), (self.two, self.at2, self.e2, self.c2, self.f2)):
            # one steadier where the proposal was right, else half as steady; it stays as long as it is steady at all
            hit = (c == x).astype(np.int32)
            g = np.minimum(f + hit >> (1 - hit), 15)
            table[at] = np.where(g > 0, e - f + g, fresh)
        self.before[:k] = self.last[:k]
        self.last[:k] = x
        self.new.append(x)
        self.steps += 1
        if self.steps < 16 or self.steps % _LEARN == 0:
            self.first.learn()
            self.second.learn()
        if self.steps % _SUM == 0 or self.steps & (self.steps - 1) == 0:
            self._sum()

    def find(self, at: np.ndarray) -> np.ndarray:
        """The id whose share of the frequencies has place `at`."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(self.ids, dtype=np.min_scalar_type(self.ids)), self.share.astype(np.int64))
        return self.slots.take(at).astype(np.int32)


class _Coder:
    """64-bit ranges, of which an id leaves a part.  16-bit words leave or enter when a range gets narrower than _TOP, two an id at most."""

    def __init__(self, streams: int, width: int):
        self.range = np.full(streams, (1 << 64) - 1, _U64)
        #: Where the words of the streams begin, and where the next ones are.
        self.row = np.arange(streams) * width
        self.place = self.row.copy()

    def settle(self, k: int) -> None:
        """Leaves at least _TOP of each range."""
        small = self.range[:k] < _U64(_TOP)
        bits = small.astype(_U64) << _U64(4)
        self.shift(slice(0, k), bits, small)
        self.range[:k] <<= bits
        if len(r := np.flatnonzero(self.range[:k] < _U64(_TOP))):
            self.shift(r, _U64(16), np.True_)
            self.range[r] <<= _U64(16)


class _Writer(_Coder):
    """Lower ends go up; what goes beyond 64 bits is carried into the words that left before."""

    def __init__(self, streams: int, longest: int):
        self.width = 2 * longest + 16
        super().__init__(streams, self.width)
        self.low, self.words = np.zeros(streams, _U64), np.zeros(streams * self.width, "<u2")

    def shift(self, rows, bits, moved) -> None:
        at, low = self.place[rows], self.low[rows]
        # where none leaves, a later one takes the place
        self.words[at] = low >> _U64(48)
        self.low[rows] = low << bits
        self.place[rows] = at + moved

    def raised(self, k: int, by: np.ndarray) -> None:
        low = self.low[:k]
        low += by
        at = self.place[np.flatnonzero(low < by)] - 1
        while len(at):
            self.words[at] = w = self.words.take(at) + np.uint16(1)
            at = at[w == 0] - 1

    def put(self, k: int, begin: np.ndarray, part: np.ndarray) -> None:
        unit = self.range[:k] >> _U64(31)
        self.raised(k, unit * begin)
        self.range[:k] = unit * part

    def finish(self) -> list[bytes]:
        """One word tells a number in any range of _TOP; zeros follow, and none that end a stream are kept."""
        self.raised(len(self.low), np.full(len(self.low), _TOP - 1, _U64))
        self.shift(slice(None), _U64(16), np.True_)
        flat = self.words.tobytes()
        kept = [flat[a:b].rstrip(b"\0") for a, b in zip((2 * self.row).tolist(), (2 * self.place).tolist(), strict=True)]
        return [w + bytes(len(w) % 2) for w in kept]


class _Reader(_Coder):
    """Holds by how much the words exceed the lower ends."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        """words: those of all streams, one after the other; sizes: how many each has."""
        width = int(sizes.max()) + 8
        super().__init__(len(sizes), width)
        self.words = np.zeros(len(sizes) * width, np.uint16)
        self.words[np.arange(len(words)) + np.repeat(self.row - (np.cumsum(sizes) - sizes), sizes)] = words
        self.most = self.row + width - 1
        self.code = np.zeros(len(sizes), _U64)
        for i in range(4):
            self.code = self.code << _U64(16) | self.words[self.row + i]
        self.place += 4

    def shift(self, rows, bits, moved) -> None:
        at = self.place[rows]
        self.code[rows] = self.code[rows] << bits | self.words.take(at) * moved
        self.place[rows] = np.minimum(at + moved, self.most[rows])

    def within(self, k: int, part: np.ndarray) -> np.ndarray:
        """Whether it is in the part that begins the whole."""
        self.unit = self.range[:k] >> _U64(31)
        return self.code[:k] < self.unit * part

    def where(self, r: np.ndarray) -> np.ndarray:
        return np.minimum(self.code.take(r) // self.unit.take(r), _U64(_WHOLE - 1)).astype(_U32)

    def narrow(self, k: int, begin: np.ndarray, part: np.ndarray) -> None:
        self.code[:k] -= self.unit * begin
        self.range[:k] = self.unit * part


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and ids of each but the last ones."""
    length = -(-n // min(LANES, max(1, n // LANE)))
    return -(-n // length), length


def _encode(ids: np.ndarray, vocabulary: int) -> bytes:
    lanes, length = _lanes(len(ids))
    table = np.zeros(lanes * length, np.int32)
    table[: len(ids)] = ids
    columns, short = np.ascontiguousarray(table.reshape(lanes, length).T), len(ids) - (lanes - 1) * length
    model, coder = _Model(lanes, vocabulary), _Writer(lanes, length)
    for t in range(length):
        k = lanes - (t >= short)
        x = columns[t, :k]
        c, part = model.propose(k)
        hit = (c == x) & (model.f1 + model.f2 > 0)
        model.first.tell(model.state, hit)
        begin = np.zeros(k, _U32)
        if len(r := np.flatnonzero(~hit)):
            y = x.take(r)
            at, more, c1, second, unit = model.again(r, part)
            hit = more & (c1 == y)
            model.tell_again(more, hit)
            begin[r] = np.where(hit, at, at + second + unit * model.below.take(y))
            part[r] = np.where(hit, second, unit * model.share.take(y))
        coder.put(k, begin, part)
        coder.settle(k)
        model.update(k, x)
    words = coder.finish()
    return np.array([len(w) // 2 for w in words], "<u2").tobytes() + b"".join(words)


def _decode(words: bytes, n: int, vocabulary: int) -> np.ndarray:
    lanes, length = _lanes(n)
    sizes = np.frombuffer(words[: 2 * lanes], "<u2").astype(np.int64)
    if len(words) != 2 * lanes + 2 * sizes.sum():
        raise ValueError("a block's lanes hold other numbers of words than it says")
    model, coder = _Model(lanes, vocabulary), _Reader(np.frombuffer(words, "<u2", offset=2 * lanes), sizes)
    columns, short = np.zeros((length, lanes), np.int32), n - (lanes - 1) * length
    for t in range(length):
        k = lanes - (t >= short)
        c, part = model.propose(k)
        hit = coder.within(k, part)
        model.first.tell(model.state, hit)
        x, begin = columns[t, :k], np.zeros(k, _U32)
        x[:] = c
        if len(r := np.flatnonzero(~hit)):
            at, more, c1, second, unit = model.again(r, part)
            place = coder.where(r) - at
            hit = more & (place < second)
            model.tell_again(more, hit)
            x[r] = y = np.where(hit, c1, model.find(np.minimum((place - second) // unit, model.total - _U32(1))))
            begin[r] = np.where(hit, at, at + second + unit * model.below.take(y))
            part[r] = np.where(hit, second, unit * model.share.take(y))
        coder.narrow(k, begin, part)
        coder.settle(k)
        model.update(k, x)
    return columns.T.reshape(-1)[:n].astype("<u4")


def pack(ids: np.ndarray, vocabulary: int, block: int | None = None) -> list[bytes]:
    """Blocks of ids below `vocabulary`; no ids make no block.  An id outside the vocabulary is an error."""
    block = BLOCK if block is None else block
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} is outside a vocabulary of {vocabulary}")
    if not 0 < block <= _LONGEST or vocabulary > _WIDEST:
        raise ValueError(f"a block has 1 to {_LONGEST} ids, a vocabulary up to {_WIDEST}")
    out = []
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        words = _encode(part, vocabulary)
        out.append(HEADER.pack(MARK, VERSION, len(part), vocabulary, crc32(part.astype("<u4").tobytes()), len(words) // 2) + words)
    return out


def unpack(blocks: list[bytes]) -> np.ndarray:
    """Ids of any blocks, each of which can be read without the others; a damaged block is an error."""
    out = []
    for b in blocks:
        if len(b) < HEADER.size:
            raise ValueError("not a block of this format")
        mark, version, n, vocabulary, check, words = HEADER.unpack_from(b)
        if (mark, version) != (MARK, VERSION) or len(b) != HEADER.size + 2 * words or not 0 < n <= _LONGEST or not 0 < vocabulary <= _WIDEST:
            raise ValueError("not a block of this format")
        ids = _decode(b[HEADER.size :], n, vocabulary)
        if crc32(ids.tobytes()) != check:
            raise ValueError("a block's ids differ from its checksum")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")
