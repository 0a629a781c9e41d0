"""Splits of regression trees over binned features, from whole numbers only.

Labels are whole multiples of a small unit, weights are whole, so sums do not depend on the order of rows or on how
they are spread over tasks.  A node is split in the same way whether its sums come from histograms of many tasks
(``best_splits``) or from the sorted rows of one (``grow``): gains are computed by one formula from equal sums, and ties
go to the first feature, then to the lowest bin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Gains below this share of a node's own score are rounding.
ROUNDING = 1e-12
#: Sums by node and bin are counted in up to so many cells a row.
DENSE = 2
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# Probabilities of a Poisson variable of mean 1, summed up.
_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finaliser of SplitMix64)."""
    x = np.asarray(x, dtype=np.uint64) + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(rows: np.ndarray, stream: np.uint64) -> np.ndarray:
    """One number in [0, 1) per row and stream, the same wherever it is asked for."""
    return (mix(rows.astype(np.uint64) ^ stream) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def stream_of(*parts: int) -> np.uint64:
    out = np.uint64(0)
    for part in parts:
        out = mix(np.array([out ^ np.uint64(part & (2**64 - 1))]))[0]
    return out


def bootstrap_weights(rows: np.ndarray, stream: np.uint64) -> np.ndarray:
    """How often each row is drawn: a Poisson number, as in sampling with replacement from very many rows."""
    return np.searchsorted(_POISSON, uniform(rows, stream), side="right").astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """How nodes are split.

    ``depth`` None grows until nodes are pure.  ``least``: weight of either side, ``whole``: of a node that may be split.  ``penalty`` is added to a side's
    weight in its score, ``gain`` must be exceeded.  ``per_split`` features are drawn for each node, ``per_tree``
    for each tree (None: all).
    """

    depth: int | None = None
    least: int = 1
    penalty: float = 0.0
    gain: float = 0.0
    per_split: int | None = None
    per_tree: int | None = None
    whole: int = 2


def children(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the left and right children: a node's place in its tree, at any depth."""
    doubled = hashes * np.uint64(2)
    return mix(doubled), mix(doubled + np.uint64(1))


def _drawn(hashes: np.ndarray, p: int, count: int | None) -> np.ndarray:
    out = np.ones((len(hashes), p), dtype=bool)
    if count is None or count >= p:
        return out
    order = mix(hashes[:, None] ^ mix(np.arange(1, p + 1, dtype=np.uint64))[None, :])
    limit = np.partition(order, count - 1, axis=1)[:, count - 1]
    return order <= limit[:, None]


def allowed(hashes: np.ndarray, tree: np.uint64, p: int, rule: Rule) -> np.ndarray:
    """Features that each node may use, nodes by features."""
    return _drawn(hashes, p, rule.per_split) & _drawn(mix(np.array([tree])), p, rule.per_tree)


def score(total: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    t = total.astype(np.float64)
    return t * t / (weight + penalty)


@dataclass
class Splits:
    """Per node: ``feature`` (-1: a leaf), ``bin`` (the last one that goes left), ``gain``, sums of the left side."""

    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    left_weight: np.ndarray
    left_sum: np.ndarray

    @staticmethod
    def none(n: int) -> Splits:
        whole = lambda v: np.full(n, v, dtype=np.int64)
        return Splits(whole(-1), whole(-1), np.full(n, -np.inf), whole(0), whole(0))

    def settle(self, own: np.ndarray, weight: np.ndarray, rule: Rule) -> Splits:
        """Nodes that are too small or whose best gain is none become leaves."""
        poor = ~(self.gain > rule.gain + ROUNDING * np.abs(own)) | (weight < rule.whole)
        self.feature[poor], self.gain[poor] = -1, 0.0
        return self


def best_splits(weight: np.ndarray, total: np.ndarray, may: np.ndarray, rule: Rule) -> Splits:
    """From histograms (nodes, features, bins) of weights and sums; ``may``: nodes by features."""
    n, p, bins = weight.shape
    lw, ls = np.cumsum(weight, axis=2), np.cumsum(total, axis=2)
    w, s = lw[:, :, -1:], ls[:, :, -1:]
    own = score(s[:, 0, 0], w[:, 0, 0], rule.penalty)
    fits = (lw >= rule.least) & (w - lw >= rule.least) & may[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(ls, lw, rule.penalty) + score(s - ls, w - lw, rule.penalty) - own[:, None, None]
    gain = np.where(fits, gain, -np.inf).reshape(n, p * bins)
    at = gain.argmax(axis=1)
    each = np.arange(n)
    out = Splits(at // bins, at % bins, gain[each, at], lw.reshape(n, -1)[each, at], ls.reshape(n, -1)[each, at])
    return out.settle(own, w[:, 0, 0], rule)


def _first_best(gain: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (ascending in ``node``) and the first place of the best gain of each."""
    begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    best = np.maximum.reduceat(gain, begin)
    hit = np.flatnonzero(gain == np.repeat(best, np.diff(np.append(begin, len(gain)))))
    own = node[hit]
    return node[begin], hit[np.concatenate([[True], own[1:] != own[:-1]])]


def alike(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows that brings equal ones together, and where each run of equal rows begins in it."""
    n, p = bins.shape
    padded = np.zeros((n, -(-p // 8) * 8), dtype=np.uint8)
    padded[:, :p] = bins
    words = padded.view(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for column in words.T:
        key = mix(key ^ column)
    order = np.argsort(key)
    words = words[order]
    # Rows of one hash are compared whole; where two of these mix, a run is cut, never two joined.
    return order, np.flatnonzero(np.concatenate([np.ones(min(n, 1), dtype=bool), (words[1:] != words[:-1]).any(axis=1)]))


def _sums_by_bin(
    keys: np.ndarray, w: np.ndarray, s: np.ndarray, cells: int, countable: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their sums of ``w`` and ``s``.  Keys of few cells are counted; otherwise keys are
    sorted with the places of their rows behind them."""
    if countable and cells <= DENSE * len(keys):
        weight = np.bincount(keys, w, cells)
        found = np.flatnonzero(weight)
        return found, weight[found], np.bincount(keys, s, cells)[found]
    shift = len(keys).bit_length()
    packed = np.sort((keys << shift) | np.arange(len(keys)))
    at, keys = packed & ((1 << shift) - 1), packed >> shift
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(w[at], begin), np.add.reduceat(s[at], begin)


def grow(
    bins: np.ndarray, weight: np.ndarray, value: np.ndarray, held: np.ndarray, rule: Rule, tree: np.uint64,
    root: np.uint64, depth: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """Grow the subtree below a node; returns the mean of the leaf of each held row, and the gain by feature.

    ``bins`` (rows by features) with ``weight`` and ``value`` are the training rows of the node, ``root`` its hash and
    ``depth`` its depth.  All nodes of a level are split at once.  Rows lie node by node, and splitting parts each node's
    rows, so that sums by node and bin of a feature touch memory in order.  Only the rows of nodes that may use a
    feature are added up for it.  Rows of equal bins stay together in any tree: they are added up to one beforehand.
    """
    used = np.flatnonzero(weight > 0)
    order, runs = alike(bins[used])
    used = used[order]
    w, s = weight[used], (weight * value)[used]
    if len(runs) < len(used):
        w, s, used = np.add.reduceat(w, runs), np.add.reduceat(s, runs), used[runs]
    # Sums of whole numbers below 2**53 are exact as floats as well.
    countable = bool(np.abs(s.astype(np.float64)).sum() < 2.0**52 and w.sum() < 2**52)
    if countable:
        w, s = w.astype(np.float64), s.astype(np.float64)
    columns = np.ascontiguousarray(bins[used].T)
    p = len(columns)
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    counts = np.array([len(used)])
    hashes = np.array([root], dtype=np.uint64)
    gains = np.zeros(p)
    out = np.zeros(len(held))
    open_held, held_node = np.arange(len(held)), np.zeros(len(held), dtype=np.int64)
    while len(hashes) and len(w):
        n = len(hashes)
        node = np.repeat(np.arange(n), counts)
        begin = np.cumsum(counts) - counts
        tw, ts = np.add.reduceat(w, begin), np.add.reduceat(s, begin)
        # Nodes of one row or too little weight are leaves, and are not searched.
        stays = (counts > 1) & (tw >= max(rule.whole, 2 * rule.least))
        if not stays.all():
            ends = ~stays[held_node]
            out[open_held[ends]] = (ts / tw)[held_node[ends]]
            open_held, held_node = open_held[~ends], (np.cumsum(stays) - 1)[held_node[~ends]]
            rows = np.flatnonzero(stays[node])
            columns, w, s = columns.take(rows, axis=1), w[rows], s[rows]
            counts, hashes, tw, ts = counts[stays], hashes[stays], tw[stays], ts[stays]
            n = len(hashes)
            if not n:
                break
            node = np.repeat(np.arange(n), counts)
        own = score(ts, tw, rule.penalty)
        splits = Splits.none(n)
        if rule.depth is None or depth < rule.depth:
            may = allowed(hashes, tree, p, rule)
            for j in range(p):
                mine = may[:, j]
                if not mine.any():
                    continue
                if mine.all():
                    keys, own_w, own_s = (node << bits[j]) | columns[j], w, s
                else:
                    rows = np.flatnonzero(np.repeat(mine, counts))
                    keys, own_w, own_s = (node[rows] << bits[j]) | columns[j][rows], w[rows], s[rows]
                cells, cell_w, cell_s = _sums_by_bin(keys, own_w, own_s, n << bits[j], countable)
                at = np.flatnonzero((cells[1:] >> bits[j]) == (cells[:-1] >> bits[j]))
                k, at_bin = cells[at] >> bits[j], cells[at] & ((1 << bits[j]) - 1)
                before_w, before_s = (np.cumsum(t * mine) - t * mine for t in (tw, ts))
                lw, ls = np.cumsum(cell_w)[at] - before_w[k], np.cumsum(cell_s)[at] - before_s[k]
                rw = tw[k] - lw
                if rule.least > 1:
                    fits = (lw >= rule.least) & (rw >= rule.least)
                    k, lw, ls, rw, at_bin = k[fits], lw[fits], ls[fits], rw[fits], at_bin[fits]
                if not len(k):
                    continue
                gain = score(ls, lw, rule.penalty) + score(ts[k] - ls, rw, rule.penalty) - own[k]
                nodes, where = _first_best(gain, k)
                better = gain[where] > splits.gain[nodes]
                nodes, where = nodes[better], where[better]
                splits.feature[nodes], splits.bin[nodes], splits.gain[nodes] = j, at_bin[where], gain[where]
                splits.left_weight[nodes], splits.left_sum[nodes] = lw[where], ls[where]
            splits.settle(own, tw, rule)
        inner = splits.feature >= 0
        np.add.at(gains, splits.feature[inner], splits.gain[inner])
        number = np.cumsum(inner) - 1
        # Held rows of leaves are done.
        stays = ~inner[held_node]
        out[open_held[stays]] = (ts / tw)[held_node[stays]]
        open_held, held_node = open_held[~stays], held_node[~stays]
        right = held[open_held, splits.feature[held_node]] > splits.bin[held_node]
        held_node = 2 * number[held_node] + right
        # Training rows of leaves are dropped, the others parted stably within their node.
        alive = np.flatnonzero(np.repeat(inner, counts))
        above = node[alive]
        turn = columns[splits.feature[above], alive] > splits.bin[above]
        child = 2 * number[above]
        counts = np.bincount(child + turn, minlength=2 * int(inner.sum()))
        # A row goes to its child's start, behind the rows of its side that come before it and after the node's begin.
        offset = np.cumsum(counts) - counts
        for side in (0, 1):
            offset[side::2] -= np.cumsum(counts[side::2]) - counts[side::2]
        rights = np.cumsum(turn) - turn
        parted = np.empty_like(alive)
        parted[offset[child + turn] + np.where(turn, rights, np.arange(len(alive)) - rights)] = alive
        columns, w, s = columns.take(parted, axis=1), w[parted], s[parted]
        left, right_hash = children(hashes[inner])
        hashes = np.empty(2 * len(left), dtype=np.uint64)
        hashes[0::2], hashes[1::2] = left, right_hash
        depth += 1
    return out, gains
