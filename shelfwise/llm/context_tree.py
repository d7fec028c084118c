"""Context-tree weighting over bytes, in numpy.

A byte is coded as eight binary decisions.  The decision at bit prefix ``p``
after the context ``c1 c2 .. cd`` (most recent byte first) is a node of depth
``d``; it holds how often a zero and a one followed.  Each node has the
Krichevsky-Trofimov probability of what it saw, and the weighted probability

    P_w = 1/2 * P_kt + 1/2 * product of P_w over its children (one byte more)

with P_w = P_kt at the largest depth.  The probability of a next bit is the
ratio of P_w of the root with and without it.  That is a mixture of the KT
estimates of all depths along the context, in which the share of a node is its
posterior weight ``P_kt / (P_kt + product of children)`` and what lies below
has the rest.  A context never seen has KT estimates of 1/2 like any node
without counts.

Rows are (key, count) where the key packs ``c1 c2 c3 c4 c5 symbol`` into six
bytes, so that equal prefixes are equal contexts.  Symbol 0xFF, which UTF-8
never uses, ends a text; bytes 0 stand before its start.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
END = 0xFF
LOG2 = float(np.log(2.0))
_HALF = float(np.log(np.pi))  # 2 * lgamma(1/2)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0 (Stirling after a shift by eight)."""
    x = np.asarray(x, np.float64)
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - _HALF


def keys_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One key per byte of each text and one for its end.

    ``data`` holds the texts one after the other, each preceded by DEPTH zero
    bytes and followed by END; text i is data[starts[i]:ends[i]] with its END.
    The result follows the order of the texts.
    """
    key = np.zeros(len(data), np.uint64)
    for back in range(1, DEPTH + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[back:] = data[:-back]
        key |= shifted << np.uint64(8 * (DEPTH + 1 - back))
    key |= data.astype(np.uint64)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    return key[np.cumsum(inside[:-1]) > 0]


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array for keys_of, with starts and ends."""
    pad = bytes(DEPTH)
    end = bytes([END])
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + DEPTH + 1)
    return data, ends - lengths - 1, ends


class _Level:
    """The nodes of one depth: symbols by context, and for each bit the runs of equal prefix."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        self.key, self.count = key, count
        symbol = (key & np.uint64(255)).astype(np.int64)
        context = key >> np.uint64(8)
        self.run, self.first, self.zeros, self.ones, self.kt = [], [], [], [], []
        for bit in range(8):
            prefix = symbol >> (8 - bit)
            new = np.ones(len(key), bool)
            new[1:] = (context[1:] != context[:-1]) | (prefix[1:] != prefix[:-1])
            first = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            one = (symbol >> (7 - bit)) & 1
            total = np.add.reduceat(count, first) if len(first) else np.zeros(0)
            ones = np.add.reduceat(count * one, first) if len(first) else np.zeros(0)
            self.run.append(run)
            self.first.append(first)
            self.ones.append(ones)
            self.zeros.append(total - ones)
            self.kt.append(log_kt(total - ones, ones))


def shorten(key: np.ndarray, depth: int) -> np.ndarray:
    """Keys of depth+1 context bytes without their oldest byte."""
    return ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255))


class Subtree:
    """All nodes of depths TOP to DEPTH below some contexts of TOP bytes.

    ``key`` are distinct and sorted; a count of 0 marks a key that is asked
    for but was not seen in training.
    """

    TOP = 3

    def __init__(self, key: np.ndarray, count: np.ndarray):
        self.levels: dict[int, _Level] = {DEPTH: _Level(key, count.astype(np.float64))}
        self.parent: dict[int, np.ndarray] = {}
        for depth in range(DEPTH - 1, self.TOP - 1, -1):
            below = self.levels[depth + 1]
            short, where = np.unique(shorten(below.key, depth), return_inverse=True)
            self.parent[depth + 1] = where
            self.levels[depth] = _Level(short, np.bincount(where, below.count, len(short)))
        self.log_weighted = {DEPTH: self.levels[DEPTH].kt}
        self.stays: dict[int, list[np.ndarray]] = {}
        for depth in range(DEPTH - 1, self.TOP - 1, -1):
            here, below, lw, stays = self.levels[depth], self.levels[depth + 1], [], []
            for bit in range(8):
                up = here.run[bit][self.parent[depth + 1][below.first[bit]]]
                children = np.bincount(up, self.log_weighted[depth + 1][bit], len(here.first[bit]))
                lw.append(np.logaddexp(here.kt[bit], children) - LOG2)
                stays.append(1 / (1 + np.exp(np.minimum(children - here.kt[bit], 700))))
            self.log_weighted[depth], self.stays[depth] = lw, stays

    def summary(self) -> dict[str, np.ndarray]:
        """One row per seen node of one byte less than TOP: context, node (1 and the bit prefix), counts and log P_w of the children."""
        top, found = self.levels[self.TOP], []
        for bit in range(8):
            key = top.key[top.first[bit]]
            node = (1 << bit) | ((key & np.uint64(255)).astype(np.int64) >> (8 - bit))
            found.append(np.stack([(key >> np.uint64(16)).astype(np.int64) << 8 | node, top.zeros[bit], top.ones[bit], self.log_weighted[self.TOP][bit]]))
        code, zeros, ones, lw = np.concatenate(found, 1) if found else np.zeros((4, 0))
        seen = zeros + ones > 0
        distinct, where = np.unique(code[seen].astype(np.int64), return_inverse=True)
        total = lambda x: np.bincount(where, x[seen], len(distinct))
        return {"code": distinct, "zeros": total(zeros), "ones": total(ones), "lw": total(lw)}

    def log10(self, top: "Top") -> np.ndarray:
        """log10 probability of each key's symbol after its context."""
        key = self.levels[DEPTH].key
        symbol = (key & np.uint64(255)).astype(np.int64)
        context = (key >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)  # c1 c2
        index, at = {DEPTH: np.arange(len(key))}, np.arange(len(key))
        for depth in range(DEPTH, self.TOP, -1):
            at = self.parent[depth][at]
            index[depth - 1] = at
        out = np.zeros(len(key))
        for bit in range(8):
            one = (symbol >> (7 - bit)) & 1
            q = None
            for depth in range(DEPTH, self.TOP - 1, -1):
                level = self.levels[depth]
                run = level.run[bit][index[depth]]
                zeros, ones = level.zeros[bit][run], level.ones[bit][run]
                kt = (np.where(one == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
                q = kt if q is None else self.stays[depth][bit][run] * kt + (1 - self.stays[depth][bit][run]) * q
            out += np.log10(top.mix(context, (1 << bit) | (symbol >> (8 - bit)), one, q))
        return out


def _posterior(kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))


class Top:
    """Depths 0 to 2, summed on the driver and sent to every task: at most 65,536 contexts of 255 nodes, of which text uses few."""

    def __init__(self, code: np.ndarray, zeros: np.ndarray, ones: np.ndarray, lw: np.ndarray):
        order = np.argsort(code)
        self.code, zeros, ones, lw = code[order], zeros[order], ones[order], lw[order]
        # a last row stands for nodes that were never seen
        self.levels = []
        place = self.code
        for depth in (2, 1, 0):
            kt = log_kt(zeros, ones)
            add = lambda x, last: np.append(x, last)
            self.levels.append((place, add(zeros, 0.0), add(ones, 0.0), add(_posterior(kt, lw), 0.5)))
            weighted = np.logaddexp(kt, lw) - LOG2
            if depth:
                shorter = (place >> 16 << 8 | place & 255) if depth == 2 else place & 255  # without the oldest byte
                place, where = np.unique(shorter, return_inverse=True)
                total = lambda x, where=where, n=len(place): np.bincount(where, x, n)
                zeros, ones, lw = total(zeros), total(ones), total(weighted)

    def mix(self, context: np.ndarray, node: np.ndarray, one: np.ndarray, q: np.ndarray) -> np.ndarray:
        """``q``, the mixture of the depths below, mixed with depths 2, 1 and 0; ``context`` is c1 c2."""
        for (place, zeros, ones, stays), code in zip(self.levels, (context << 8 | node, context >> 8 << 8 | node, node), strict=True):
            at = np.searchsorted(place, code)
            at[at < len(place)] = np.where(place[at[at < len(place)]] == code[at < len(place)], at[at < len(place)], len(place))
            kt = (np.where(one == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            q = stays[at] * kt + (1 - stays[at]) * q
        return q
