"""Adaptive context-mixing range coder for token ids, in numpy.

Ids are coded in blocks of up to ``BLOCK``; every block starts from fresh
tables and carries its own checksum, so any block can be read without the
others. Inside a block the ids stand in up to ``BLOCK / STEPS`` *lanes* of
consecutive ids; all lanes advance together, one id a step, each with a range
coder of its own. The lanes share one model, which learns from all ids of a
step before the next.

An id is coded in one decision, whose odds mix three predictions:

- order 2: the id that last followed the two ids before;
- order 1: the one that last followed the id before;
- order 0: adaptive frequencies of all ids that neither foretold.

The shares of the three are adaptive, kept per pair of the confidences that
orders 2 and 1 have earned. An id that order 0 has not met yet takes its
*escape* share and is then written evenly.

Odds add up to ``2**28`` (12 bits of shares, 16 of order 0). The coder keeps
64-bit bounds and moves 16-bit words out; a carry goes into words already out.
A payload holds the lanes' numbers of words, then their words.
"""

from __future__ import annotations

import numpy as np

STEPS = 128
BLOCK = STEPS << 14
U = np.uint64
IDS = 1 << 16
SLOTS = 1 << 18
CONF, FULL_CONF = 1 << 16, 7  # a prediction is confidence * CONF + id; below CONF: none
LEVELS = FULL_CONF + 1
SHARES, LEAST, MEMORY = 1 << 12, 8, 1 << 15  # of the mix; the least share; ids remembered by a pair
ORDER0 = 1 << 16
REFRESH = 16  # steps between two refreshes of shares and order 0 frequencies; fewer at first
WORD, BOT = U(16), U(1 << 48)
MIX_BITS = U(28)


class _Model:
    """Prediction tables of a block."""

    def __init__(self):
        self.two = np.zeros(SLOTS, np.int32)
        self.one = np.zeros(IDS, np.int32)
        self.seen = np.tile(np.array([1, 1, 2], np.int64), (LEVELS * LEVELS, 1))
        self.count = np.zeros(IDS, np.int64)
        self.missed: list[np.ndarray] = []
        self.misses, self.escapes, self.step = 2, 1, 0
        self._share()
        self._refresh()

    def predict(self, p1: np.ndarray, p2: np.ndarray) -> None:
        """The predictions after the ids ``p1`` and ``p2`` and their shares of the odds."""
        self.p1, self.slot = p1, (p1 * 0x9E3779B1 + p2 * 0x85EBCA77 >> 12) & (SLOTS - 1)
        self.e2, self.e1 = self.two.take(self.slot), self.one.take(p1)
        self.g2, self.g1 = self.e2 & (IDS - 1), self.e1 & (IDS - 1)
        self.pair = (self.e2 >> 16) * LEVELS + (self.e1 >> 16) * (self.g1 != self.g2)
        self.to2, self.to1 = self.upto2.take(self.pair), self.upto1.take(self.pair)

    def learn(self, x: np.ndarray, kind: np.ndarray, missed: np.ndarray, escapes: int) -> None:
        """``x``: the ids of the step; ``kind``: 0, 1 or 2 for foretold by order 2, by
        order 1, by neither; ``missed``: the ids of kind 2, ``escapes`` of them new to order 0."""
        x = x.astype(np.int32)
        for table, at, e, g in ((self.two, self.slot, self.e2, self.g2), (self.one, self.p1, self.e1, self.g1)):
            right = g == x
            g += FULL_CONF * CONF
            new = np.maximum(e - 2 * CONF, 0)
            np.copyto(new, x + CONF, where=e < 2 * CONF)
            np.copyto(new, np.minimum(e + CONF, g), where=right)
            table[at] = new  # of lanes that share a place the last one stays, in both directions
        self.seen += np.bincount(self.pair * 3 + kind, minlength=self.seen.size).reshape(self.seen.shape)
        self.missed.append(missed)
        self.escapes += escapes
        self.step += 1
        if self.step % REFRESH == 0 or not self.step & (self.step - 1):
            self._share()
            self._refresh()

    def _share(self) -> None:
        total = self.seen.sum(axis=1)
        if total.max() > MEMORY:
            self.seen[total > MEMORY] >>= 1
            self.seen |= self.seen == 0
            total = self.seen.sum(axis=1)
        cum = self.seen[:, :2].cumsum(axis=1) * (SHARES - 3 * LEAST) // total[:, None]
        self.upto2, self.upto1 = cum[:, 0] + LEAST, cum[:, 1] + 2 * LEAST

    def _refresh(self) -> None:
        """Order 0 frequencies of the ids missed so far; the rest is the escape share."""
        if self.missed:
            new = np.concatenate(self.missed)
            self.missed = []
            if len(new):
                self.misses += len(new)
                self.count += np.bincount(new, minlength=IDS)
        met = self.count > 0
        kinds, total = int(np.count_nonzero(met)), max(1, int(self.count.sum()))
        room = ORDER0 - max(32, min(ORDER0 // 2, ORDER0 * self.escapes // self.misses))
        if 2 * kinds > room:  # the rarest ids have no room of their own
            self.freq = self.count * room // total
        else:
            self.freq = self.count * (room - kinds) // total + met
        end = self.freq.cumsum()
        self.span, self.escape = (end - self.freq << 17) + self.freq, int(end[-1])
        self._find = None

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids that the order 0 targets ``v`` lie in; IDS for the escape share."""
        if self._find is None:
            self._find = np.full(ORDER0, IDS, np.int32)
            self._find[:self.escape] = np.repeat(np.arange(IDS, dtype=np.int32), self.freq)
        return self._find.take(v).astype(np.int64)


class _Encoder:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, ~U(0))
        room = 3 * steps * lanes + 2 * lanes
        self.out, self.lane, self.n = np.empty(room, np.uint32), np.empty(room, np.uint16), 0
        self.last = np.zeros(lanes, np.int64)  # where each lane's last word is

    def put(self, lanes, bits: np.uint64, start: np.ndarray, size: np.ndarray) -> None:
        """Code a part of ``2**bits`` on ``lanes``, an index array or a slice from 0."""
        low, rng = self.low[lanes], self.range[lanes] >> bits
        at = low + rng * start.view(U)
        rng *= size.view(U)
        over = (at < low).nonzero()[0]
        if len(over):
            self.out[self.last[lanes][over]] += 1
        self.low[lanes], self.range[lanes] = at, rng
        move = (rng < BOT).nonzero()[0]
        if isinstance(lanes, np.ndarray):
            move = lanes[move]
        while len(move):
            at = self.low[move]
            self._out(move, at >> U(48))
            self.low[move] = at << WORD
            rng = self.range[move] << WORD
            self.range[move] = rng
            move = move[rng < BOT]

    def _out(self, lanes: np.ndarray, words: np.ndarray) -> None:
        a, b = self.n, self.n + len(lanes)
        self.out[a:b], self.lane[a:b], self.last[lanes] = words, lanes, np.arange(a, b)
        self.n = b

    def finish(self) -> bytes:
        rows = np.arange(len(self.low))
        end = self.low + U((1 << 32) - 1)  # whatever words follow, they stay inside the range
        self.out[self.last[end < self.low]] += 1
        self._out(rows, end >> U(48))
        self._out(rows, (end >> U(32)) & U(0xFFFF))
        lane = self.lane[:self.n]
        words = self.out[np.argsort(lane, kind="stable")]
        carry = (words >> 16).nonzero()[0]
        while len(carry):
            words[carry] &= 0xFFFF
            carry -= 1
            words[carry] += 1
            carry = carry[words[carry] >> 16 > 0]
        n = np.bincount(lane, minlength=len(rows))
        return n.astype("<u2").tobytes() + words.astype("<u2").tobytes()


class _Decoder:
    def __init__(self, payload: bytes, lanes: int):
        words = np.frombuffer(payload, "<u2", len(payload) // 2)
        if len(words) <= lanes:
            raise ValueError(f"a payload of {len(payload)} bytes for {lanes} lanes")
        n = words[:lanes].astype(np.int64)
        self.words = words[lanes:]
        self.at = np.cumsum(n) - n
        self.range, self.code = np.full(lanes, ~U(0)), np.zeros(lanes, U)
        for _ in range(4):
            self.code = (self.code << WORD) | self.words.take(self.at, mode="clip")
            self.at += 1

    def target(self, lanes, bits: np.uint64) -> np.ndarray:
        return np.minimum(self.code[lanes] // (self.range[lanes] >> bits), (U(1) << bits) - U(1)).view(np.int64)

    def take(self, lanes, bits: np.uint64, start: np.ndarray, size: np.ndarray) -> None:
        """Remove a part of ``2**bits`` from the ``lanes``."""
        rng = self.range[lanes] >> bits
        self.code[lanes] -= rng * start.view(U)
        rng *= size.view(U)
        self.range[lanes] = rng
        move = (rng < BOT).nonzero()[0]
        if isinstance(lanes, np.ndarray):
            move = lanes[move]
        while len(move):
            at = self.at[move]
            self.code[move] = (self.code[move] << WORD) | self.words.take(at, mode="clip")
            self.at[move] = at + 1
            rng = self.range[move] << WORD
            self.range[move] = rng
            move = move[rng < BOT]


def _lanes(n: int) -> tuple[int, int, int]:
    """Lanes, steps and the ids of the last lane, which may be short."""
    steps = min(STEPS, n)
    lanes = -(-n // steps)
    return lanes, steps, n - (lanes - 1) * steps


def _encode(ids: np.ndarray) -> bytes:
    lanes, steps, last = _lanes(len(ids))
    grid = np.zeros((steps + 2, lanes), np.int64)  # two ids 0 before each lane
    padded = np.zeros(lanes * steps, np.uint16)
    padded[:len(ids)] = ids
    grid[2:] = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model, enc = _Model(), _Encoder(lanes, steps)
    for i in range(steps):
        on = slice(0, lanes if i < last else lanes - 1)
        p2, p1, x = (grid[i + k, on] for k in range(3))
        model.predict(p1, p2)
        kind = (x != model.g2).astype(np.int64)
        kind += kind * (x != model.g1)
        second, miss = (kind == 1).nonzero()[0], (kind == 2).nonzero()[0]
        start, size = np.zeros(len(x), np.int64), model.to2 * ORDER0
        start[second] = size[second]
        size[second] = model.to1[second] * ORDER0 - start[second]
        xm, upto = x[miss], model.to1[miss]
        span = model.span.take(xm)
        freq, begin = span & (1 << 17) - 1, span >> 17
        new = (freq == 0).nonzero()[0]
        freq[new], begin[new] = ORDER0 - model.escape, model.escape
        start[miss] = upto * ORDER0 + (SHARES - upto) * begin
        size[miss] = (SHARES - upto) * freq
        enc.put(on, MIX_BITS, start, size)
        if len(new):
            enc.put(miss[new], WORD, xm[new], np.ones(len(new), np.int64))
        model.learn(x, kind, xm, len(new))
    return enc.finish()


def _decode(payload: bytes, n: int) -> np.ndarray:
    lanes, steps, last = _lanes(n)
    grid = np.zeros((steps + 2, lanes), np.int64)
    model, dec = _Model(), _Decoder(payload, lanes)
    for i in range(steps):
        on = slice(0, lanes if i < last else lanes - 1)
        p2, p1, x = (grid[i + k, on] for k in range(3))
        model.predict(p1, p2)
        t = dec.target(on, MIX_BITS)
        share = t >> 16
        kind = (share >= model.to2).astype(np.int64) + (share >= model.to1)
        second, miss = (kind == 1).nonzero()[0], (kind == 2).nonzero()[0]
        start, size = np.zeros(len(x), np.int64), model.to2 * ORDER0
        start[second] = size[second]
        size[second] = model.to1[second] * ORDER0 - start[second]
        upto = model.to1[miss]
        xm = model.find(((t[miss] - upto * ORDER0) / (SHARES - upto)).astype(np.int64))  # exact below 2**53
        new = (xm == IDS).nonzero()[0]
        xm[new] = 0
        span = model.span.take(xm)
        freq, begin = span & (1 << 17) - 1, span >> 17
        freq[new], begin[new] = ORDER0 - model.escape, model.escape
        start[miss] = upto * ORDER0 + (SHARES - upto) * begin
        size[miss] = (SHARES - upto) * freq
        dec.take(on, MIX_BITS, start, size)
        if len(new):
            xm[new] = dec.target(miss[new], WORD)
            dec.take(miss[new], WORD, xm[new], np.ones(len(new), np.int64))
        x[:] = model.g2
        x[second], x[miss] = model.g1[second], xm
        model.learn(x, kind, xm, len(new))
    return grid[2:].astype(np.uint16).T.ravel()[:n]


@np.errstate(over="ignore")
def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Payloads of the blocks of an id array; the models hold ids below 65536,
    a larger one raises ValueError."""
    if len(ids) and ids.max() >= IDS:
        raise ValueError(f"id {ids.max()}: the coder takes ids below 65536 (a vocabulary of 65,536 tokens)")
    return [_encode(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]


@np.errstate(over="ignore")
def decode_blocks(payloads: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids of blocks of ``sizes`` ids, one after the other."""
    parts = [_decode(p, n) for p, n in zip(payloads, np.asarray(sizes).tolist()) if n]
    return np.concatenate([np.empty(0, np.uint16), *parts]).astype(np.int64)
