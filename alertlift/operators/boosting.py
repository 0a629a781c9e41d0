"""Gradient boosting of squared or absolute error, many fits side by side.

Each round grows one tree per fit level by level: tasks add up weights and gradients by node, feature and bin, and a
split is chosen by the second-order gain with a penalty on leaves.  Rows and features of a tree are drawn by hashes.
Absolute error takes the sign of the residual as gradient, and then gives each leaf the exact median of its residuals: the
median's digits are found from the highest on, by counts per leaf, with no sort and no buffer of values.

All fits (folds, settings) share every pass over the data, so the number of jobs follows from rounds and depth alone.
Scores are whole numbers of ``UNIT``; they and therefore all trees do not depend on the order of rows.  Rows carry the
scores of the rounds up to the last checkpoint, later trees are applied on reading.

A training set of no more than ``LOCAL_ROWS`` rows is gathered to one task, with the rows to be predicted, and boosted
there by the same code from the same sums: same trees, and no job per level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlift.operators import growth
from alertlift.operators.binning import BLOCK_COLUMNS, MAX_BINS, UNIT, Block, Encoded, thick
from alertlift.operators.folds import SEED
from alertlift.operators.forest import (
    CHUNK, HISTOGRAM, LOCAL_ROWS, Fit, Top, Unit, add_histograms, choose_splits, deal, histogram_batch, histogram_salts, published,
    partitions_for, unit_arrays,
)
from alertlift.sources.shipping import ship_package
from alertlift.sources.staging import stage

#: Rounds between two checkpoints of the scores, and bits of a residual that one pass counts.
CHECKPOINT, DIGIT = 16, 12


@dataclass(frozen=True)
class Boosting:
    """``penalty``: added to a leaf's weight; ``least``: rows of a leaf; ``rows`` and ``columns``: shares drawn for each
    tree; ``gain``: squared minutes that a split must bring."""

    rounds: int = 300
    rate: float = 0.05
    depth: int = 6
    penalty: float = 1.0
    least: int = 1
    rows: float = 1.0
    columns: float = 1.0
    gain: float = 0.0
    absolute: bool = False
    seed: int = SEED

    @property
    def trees(self) -> int:
        return self.rounds

    def rule(self, p: int) -> growth.Rule:
        drawn = None if self.columns >= 1 else max(1, int(self.columns * p))
        gain = 0.0 if self.absolute else self.gain / UNIT**2
        return growth.Rule(self.depth, self.least, self.penalty, gain, None, drawn)

    def stream(self, tree: int) -> np.uint64:
        return growth.stream_of(self.seed, 1, tree)

    def draws(self, tree: int, row: np.ndarray) -> np.ndarray:
        if self.rows >= 1:
            return np.ones(len(row), dtype=np.int64)
        return (growth.uniform(row, growth.stream_of(self.seed, 2, tree)) < self.rows).astype(np.int64)


@dataclass
class _Tree:
    """A grown tree of a fit: where rows go, and what each node adds to the score."""

    top: Top
    adds: np.ndarray

    def of(self, bins: np.ndarray) -> np.ndarray:
        return self.adds[self.top.route(bins)]


@dataclass
class _State:
    """All fits with their base scores and the trees that the rows' scores do not contain yet."""

    fits: Sequence[Fit]
    base: list[int]
    pending: list[list[_Tree]]
    blocks: int

    def bins(self, b: Block, fit: int) -> np.ndarray:
        held = self.fits[fit].held
        return b.bins[:, held if held is not None else self.blocks - 1]

    def scores(self, batch: pa.RecordBatch, b: Block) -> np.ndarray:
        """Rows by fits."""
        n = batch.num_rows
        if "__score" in batch.schema.names:
            packed = b"".join(batch.column("__score").to_pylist())
            out = np.frombuffer(packed, dtype=np.int64).reshape(n, -1).copy()
        else:
            out = np.tile(np.array(self.base, dtype=np.int64), (n, 1))
        for fit, trees in enumerate(self.pending):
            if trees:
                bins = self.bins(b, fit)
                for tree in trees:
                    out[:, fit] += tree.of(bins)
        return out


def _blocks(state: _State, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block, np.ndarray]]:
    for batch in thick(batches):
        b = Block.of(batch, state.blocks)
        yield batch, b, state.scores(batch, b)


def _gradients(state: _State, round_: int, tops: dict[int, Top], wanted: list[tuple[int, int]], salts: int):  # noqa: ANN202
    """Histograms of the wanted (fit, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, salt = None, 0
        for _, b, scores in _blocks(state, batches):
            salt ^= int(b.row[0]) % salts
            if held is None:
                held = np.zeros((2, len(wanted), b.bins.shape[2] * MAX_BINS), dtype=np.int64)
            for fit, top in tops.items():
                spec = state.fits[fit]
                place = np.full(len(top.feature), -1)
                for number, (f, node) in enumerate(wanted):
                    if f == fit:
                        place[node] = number
                if (place < 0).all():
                    continue
                rows = np.flatnonzero(spec.train(b.fold, b.inner))
                w = spec.forest.draws(round_, b.row[rows])
                rows = rows[w > 0]
                bins = state.bins(b, fit)[rows]
                rest = b.y[rows] - scores[rows, fit]
                at = place[top.route(bins)]
                used = at >= 0
                if used.any():
                    value = np.sign(rest) if spec.forest.absolute else rest
                    add_histograms(held, at[used], bins[used], np.ones(int(used.sum()), dtype=np.int64), value[used])
        if held is not None:
            yield histogram_batch(held, salt)

    return run


def _digit_counts(state: _State, round_: int, tops: dict[int, Top], asked: list[tuple[int, int, int]], left: int, offset: int):  # noqa: ANN202
    """For each asked (fit, leaf, digits so far): counts of the next digit of its residuals."""
    by_fit: dict[int, list[tuple[int, int, int]]] = {}
    for number, (fit, leaf, known) in enumerate(asked):
        by_fit.setdefault(fit, []).append((number, leaf, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(asked), 1 << DIGIT), dtype=np.int64)
        for _, b, scores in _blocks(state, batches):
            for fit, own in by_fit.items():
                spec = state.fits[fit]
                rows = np.flatnonzero(spec.train(b.fold, b.inner))
                if round_ >= 0:
                    rows = rows[spec.forest.draws(round_, b.row[rows]) > 0]
                rest = b.y[rows] - scores[rows, fit] + offset
                node = tops[fit].route(state.bins(b, fit)[rows])
                high, digit = rest >> (left + DIGIT), (rest >> left) & ((1 << DIGIT) - 1)
                for number, leaf, known in own:
                    total[number] += np.bincount(digit[(node == leaf) & (high == known)], minlength=1 << DIGIT)
        n = len(asked)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["number", "counts"]
        )

    return run


def _pick(ranks: list[list[int]]):  # noqa: ANN202
    """Digit that holds each wanted rank, and the rank within it; rank None asks for both middle ranks."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("number")[0].as_py()
        counts = sum(np.frombuffer(v.as_buffer(), dtype=np.int64) for v in table.column("counts").combine_chunks())
        upto = np.cumsum(counts)
        n = int(upto[-1])
        wanted = ranks[number] or [(n - 1) // 2, n // 2]
        found = [int(np.searchsorted(upto, r, side="right")) for r in wanted]
        rest = [r - int(upto[d] - counts[d]) for r, d in zip(wanted, found, strict=True)]
        return pa.table({"number": [number] * len(found), "place": list(range(len(found))), "digit": found, "rest": rest}, schema=_PICKED)

    return run


_PICKED = pa.schema([("number", pa.int32()), ("place", pa.int32()), ("digit", pa.int32()), ("rest", pa.int64())])


def leaf_medians(
    rows: DataFrame, state: _State, round_: int, tops: dict[int, Top], leaves: list[tuple[int, int]], bits: int
) -> dict[tuple[int, int], float]:
    """Exact median of the residuals of the training rows in each (fit, leaf); ``round_`` -1 takes all rows."""
    offset, left = 1 << (bits - 1), bits - DIGIT
    #: Per leaf the two middle values: digits so far and the rank among values that share them.
    middle: dict[tuple[int, int], list[tuple[int, int]]] = {}
    while left >= 0:
        if not middle:
            asked, ranks = [(*leaf, 0) for leaf in leaves], [[] for _ in leaves]
            owners = [[(leaf, 0), (leaf, 1)] for leaf in leaves]
        else:
            groups: dict[tuple[int, int, int], list] = {}
            for leaf, pair in middle.items():
                for side, (known, rank) in enumerate(pair):
                    groups.setdefault((*leaf, known), []).append((leaf, side, rank))
            asked = list(groups)
            ranks = [[r for _, _, r in g] for g in groups.values()]
            owners = [[(leaf, side) for leaf, side, _ in g] for g in groups.values()]
        counted = rows.mapInArrow(_digit_counts(state, round_, tops, asked, left, offset), "number int, counts binary")
        picked = counted.groupBy("number").applyInArrow(_pick(ranks), "number int, place int, digit int, rest long")
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for c in picked.collect():
            leaf, side = owners[c.number][c.place]
            pair = found.setdefault(leaf, [(0, 0), (0, 0)])
            pair[side] = ((asked[c.number][2] << DIGIT) | c.digit, c.rest)
        middle = found
        left -= DIGIT
    return {leaf: (low[0] + high[0]) / 2 - offset for leaf, (low, high) in middle.items()}


def _checkpoint(state: _State):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, scores in _blocks(state, batches):
            columns = [batch.column(c) for c in BLOCK_COLUMNS]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([s.tobytes() for s in scores], pa.binary())], [*BLOCK_COLUMNS, "__score"]
            )

    return run


def _scored(state: _State, fits: list[int], rounds: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b, scores in _blocks(state, batches):
            for fit in fits:
                rows = np.flatnonzero(state.fits[fit].scored(b.fold, b.inner))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, fit), pa.int32()), pa.array(np.full(n, rounds), pa.int32()),
                     pa.array(b.row[rows], pa.int64()), pa.array(scores[rows, fit] * UNIT, pa.float64())],
                    ["fit", "trees", "__row", "duration_pred"],
                )

    return run


#: Finds splits of the wanted (fit, node), given the trees so far, the rules and the features allowed: per node its number,
#: split, weight and sum.
Chooser = Callable[[dict[int, Top], list[tuple[int, int]], np.ndarray, list[growth.Rule]], Iterable]


def _grow_round(
    specs: dict[int, Boosting], round_: int, p: int, choose: Chooser
) -> tuple[dict[int, Top], dict[tuple[int, int], tuple[int, int]]]:
    """One tree per fit: ``tops``, and per (fit, node) its weight and sum of gradients."""
    tops = {f: Top.start(spec.stream(round_)) for f, spec in specs.items()}
    sums: dict[tuple[int, int], tuple[int, int]] = {}
    todo = [(f, 0) for f in specs]
    while todo:
        rules = [specs[f].rule(p) for f, _ in todo]
        may = np.concatenate(
            [growth.allowed(np.array([tops[f].hash[n]]), specs[f].stream(round_), p, r) for (f, n), r in zip(todo, rules, strict=True)]
        )
        below = []
        for c in choose(tops, todo, may, rules):
            fit, node = todo[c.number]
            sums[fit, node] = (c.weight, c.total)
            if c.feature < 0:
                continue
            top = tops[fit]
            top.split(node, c.feature, c.bin, (-1, -1))
            left = top.left[node]
            sums[fit, left] = (c.left_weight, c.left_sum)
            sums[fit, left + 1] = (c.weight - c.left_weight, c.total - c.left_sum)
            if top.depth[left] < specs[fit].depth:
                below += [(fit, left), (fit, left + 1)]
        todo = sorted(below)
    return tops, sums


def _ends(top: Top) -> list[int]:
    return [n for n, feature in enumerate(top.feature) if feature < 0]


def _steps(spec: Boosting, top: Top, sums: dict[int, tuple[int, int]], medians: dict[int, float]) -> np.ndarray:
    """What each node adds to the score of its rows."""
    adds = np.zeros(len(top.feature), dtype=np.int64)
    for n in _ends(top):
        weight, gradient = sums.get(n, (0, 0))
        if weight:
            adds[n] = round(spec.rate * (medians[n] if spec.absolute else gradient / (weight + spec.penalty)))
    return adds


def _middle(values: np.ndarray) -> float:
    n = len(values)
    at = sorted({(n - 1) // 2, n // 2})
    part = np.partition(values, at)
    return (int(part[at[0]]) + int(part[at[-1]])) / 2


def _start(total: int, count: int) -> int:
    return round(total / max(count, 1))


class _Level:
    """Rows of one tree in memory: their nodes, and the histograms of the last level."""

    def __init__(self, bins: np.ndarray, value: np.ndarray):
        self.bins, self.value = bins, value
        self.columns = [bins[:, j].astype(np.int64) for j in range(bins.shape[1])]
        self.node = np.zeros(len(bins), dtype=np.int64)
        # Float sums of whole numbers below 2**53 are exact; larger ones are added in halves.
        self.small = len(value) * int(np.abs(value).max(initial=0)) < 1 << 52
        self.last: tuple[dict[int, int], np.ndarray, np.ndarray] | None = None

    def descend(self, top: Top) -> None:
        """One step down for the rows of nodes that were split."""
        if len(top.feature) > 1:
            feature, at, left = np.array(top.feature), np.array(top.bin), np.array(top.left)
            moving = np.flatnonzero(feature[self.node] >= 0)
            here = self.node[moving]
            self.node[moving] = left[here] + (self.bins[moving, feature[here]] > at[here])

    def _sums(self, nodes: list[int], n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(n_nodes, -1)
        place[nodes] = np.arange(len(nodes))
        at = place[self.node]
        rows = np.flatnonzero(at >= 0)
        every = len(rows) == len(at)
        at, own = (at, self.value) if every else (at[rows], self.value[rows])
        at, size, p = at * MAX_BINS, len(nodes) * MAX_BINS, len(self.columns)
        high, low = (None, own) if self.small else (own >> 24, own & ((1 << 24) - 1))
        weight = np.zeros((len(nodes), p, MAX_BINS), dtype=np.int64)
        total = np.zeros_like(weight)
        for j, column in enumerate(self.columns):
            cell = at + (column if every else column[rows])
            weight[:, j] = np.bincount(cell, minlength=size).reshape(-1, MAX_BINS)
            total[:, j] = np.bincount(cell, weights=low, minlength=size).astype(np.int64).reshape(-1, MAX_BINS)
            if high is not None:
                total[:, j] += np.bincount(cell, weights=high, minlength=size).astype(np.int64).reshape(-1, MAX_BINS) << 24
        return weight, total

    def choose(self, tops: dict[int, Top], todo: list, may: np.ndarray, rules: list[growth.Rule]) -> list[_Choice]:
        """Splits of the open nodes.  Of two siblings the smaller one is counted, the other is what the parent has more."""
        top, nodes = tops[0], [n for _, n in todo]
        self.descend(top)
        if self.last is None:
            weight, total = self._sums(nodes, len(top.feature))
        else:
            index, above_w, above_t = self.last
            parent = {top.left[n]: n for n in index if top.feature[n] >= 0}
            size = np.bincount(self.node, minlength=len(top.feature))
            less = [n if size[n] <= size[n + 1] else n + 1 for n in nodes[0::2]]
            small_w, small_t = self._sums(less, len(top.feature))
            up = [index[parent[n]] for n in nodes[0::2]]
            weight = np.empty((len(nodes), *small_w.shape[1:]), dtype=np.int64)
            total = np.empty_like(weight)
            side = np.array(less) - np.array(nodes[0::2])
            pair = 2 * np.arange(len(less))
            for out, own, above in ((weight, small_w, above_w), (total, small_t, above_t)):
                out[pair + side], out[pair + 1 - side] = own, above[up] - own
        self.last = ({n: i for i, n in enumerate(nodes)}, weight, total)
        found = growth.best_splits(weight, total, may, rules[0])
        w, t = weight[:, 0].sum(axis=1), total[:, 0].sum(axis=1)
        columns = (found.feature, found.bin, w, t, found.left_weight, found.left_sum)
        return [_Choice(i, *map(int, c)) for i, c in enumerate(zip(*columns, strict=True))]


def boost(
    spec: Boosting, stops: set[int], row: np.ndarray, y: np.ndarray, bins: np.ndarray, held: np.ndarray
) -> Iterator[tuple[int, np.ndarray]]:
    """Boost one training set held in memory; yields the held rows' scores after each of ``stops`` rounds."""
    p = bins.shape[1]
    base = _start(int(y.sum()), len(y))
    if spec.absolute and len(y):
        base += round(_middle(y - base))
    score, held_score = np.full(len(y), base, dtype=np.int64), np.full(len(held), base, dtype=np.int64)
    for round_ in range(spec.rounds):
        used = np.flatnonzero(spec.draws(round_, row) > 0)
        mine, rest = bins[used], y[used] - score[used]
        value = np.sign(rest) if spec.absolute else rest
        level = _Level(mine, value)
        tops, sums = _grow_round({0: spec}, round_, p, level.choose)
        top = tops[0]
        level.descend(top)
        medians = {}
        if spec.absolute:
            end = level.node.astype(np.int16) if len(top.feature) < 1 << 15 else level.node
            order = np.argsort(end, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], end[order][1:] != end[order][:-1]])) if len(order) else []
            medians = {int(end[part[0]]): _middle(rest[part]) for part in np.split(order, begins[1:]) if len(part)}
        tree = _Tree(top, _steps(spec, top, {n: v for (_, n), v in sums.items()}, medians))
        score[used] += tree.adds[level.node]
        if len(used) < len(y):
            rest_of = np.setdiff1d(np.arange(len(y)), used, assume_unique=True)
            score[rest_of] += tree.of(bins[rest_of])
        held_score += tree.of(held)
        if round_ + 1 in stops:
            yield round_ + 1, held_score.copy()


@dataclass
class _Choice:
    number: int
    feature: int
    bin: int
    weight: int
    total: int
    left_weight: int
    left_sum: int


_SCORED = "fit int, trees int, __row long, duration_pred double"
_SCORED_ARROW = pa.schema([("fit", pa.int32()), ("trees", pa.int32()), ("__row", pa.int64()), ("duration_pred", pa.float64())])


def _in_one_task(fits: Sequence[Fit], units: list[Unit], p: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        fit = units[table.column("unit")[0].as_py()].fit
        row, y, bins, scored, held = unit_arrays(table, p)
        parts = [
            pa.table({"fit": np.full(len(scored), fit), "trees": np.full(len(scored), n), "__row": scored, "duration_pred": s * UNIT}, schema=_SCORED_ARROW)
            for n, s in boost(fits[fit].forest, set(fits[fit].wanted()), row, y, bins, held)
        ]
        return pa.concat_tables(parts)

    return run


def fit_boosted(encoded: Encoded, fits: Sequence[Fit]) -> DataFrame:
    """Boost all fits (``Fit`` with a ``Boosting``): ``fit``, ``trees``, ``__row``, ``duration_pred`` after each wanted number
    of rounds."""
    ship_package(encoded.rows.sparkSession)
    rows, p, blocks = encoded.rows.select(*BLOCK_COLUMNS), len(encoded.names), encoded.k + 1
    stats = rows.groupBy("__fold", "__inner").agg(F.count("*"), F.sum("__y"), F.min("__y"), F.max("__y")).collect()
    fold, inner, count, total, low, high = (np.array(c) for c in zip(*[tuple(r) for r in stats], strict=True))
    members = [f.train(fold, inner) for f in fits]
    counts, totals = [int(count[m].sum()) for m in members], [int(total[m].sum()) for m in members]
    out = []
    local = [i for i, n in enumerate(counts) if n <= LOCAL_ROWS]
    if local:
        units = [Unit(i, 0, fits[i].forest.rounds, 0) for i in local]
        dealt = rows.mapInArrow(deal(fits, {}, units, blocks), CHUNK).repartition(partitions_for(units), "unit")
        out.append(stage(dealt.groupBy("unit").applyInArrow(_in_one_task(fits, units, p), _SCORED)))
    spread = [i for i in range(len(fits)) if i not in set(local)]
    if spread:
        bits = -(-(4 * (int(high.max() - low.min()) + 1)).bit_length() // DIGIT) * DIGIT
        base = {i: _start(totals[i], counts[i]) for i in spread}
        out += _boost_spread(rows, fits, spread, base, blocks, p, bits)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _boost_spread(
    rows: DataFrame, fits: Sequence[Fit], which: list[int], base: dict[int, int], blocks: int, p: int, bits: int
) -> list[DataFrame]:
    """Boost the fits ``which`` over the whole table, a job per level for all of them."""
    salts = histogram_salts(rows)
    state = _State(fits, [base.get(i, 0) for i in range(len(fits))], [[] for _ in fits], blocks)
    absolute = [i for i in which if fits[i].forest.absolute]
    if absolute:
        start = {i: Top.start(np.uint64(0)) for i in absolute}
        for (i, _), m in leaf_medians(rows, state, -1, start, [(i, 0) for i in absolute], bits).items():
            state.base[i] += round(m)
    out = []
    for round_ in range(max(fits[i].forest.rounds for i in which)):
        specs = {i: fits[i].forest for i in which if fits[i].forest.rounds > round_}

        def choose(tops: dict[int, Top], todo: list, may: np.ndarray, rules: list[growth.Rule]) -> list:
            partial = rows.mapInArrow(_gradients(state, round_, tops, todo, salts), HISTOGRAM)  # noqa: B023
            return choose_splits(partial, salts, p, may, rules)

        tops, sums = _grow_round(specs, round_, p, choose)
        exact = [(f, n) for f in specs if specs[f].absolute for n in _ends(tops[f]) if sums.get((f, n), (0, 0))[0] > 0]
        medians = leaf_medians(rows, state, round_, tops, exact, bits) if exact else {}
        for f, spec in specs.items():
            own = {n: v for (g, n), v in sums.items() if g == f}
            adds = _steps(spec, tops[f], own, {n: m for (g, n), m in medians.items() if g == f})
            state.pending[f].append(_Tree(tops[f], adds))
        done = [i for i in specs if round_ + 1 in fits[i].wanted()]
        if done:
            out.append(stage(rows.mapInArrow(_scored(state, done, round_ + 1), _SCORED)))
        if (round_ + 1) % CHECKPOINT == 0:
            columns = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in BLOCK_COLUMNS)
            rows = stage(rows.mapInArrow(_checkpoint(state), f"{columns}, __score binary"))
            state.pending = [[] for _ in fits]
    return out


def out_of_fold(encoded: Encoded, settings: dict[str, Boosting]) -> DataFrame:
    """Out-of-fold predictions of several named settings, all boosted side by side."""
    names = [(name, held) for name in settings for held in range(encoded.k)]
    fits = [Fit(settings[name], held) for name, held in names]
    scored = fit_boosted(encoded, fits)
    result = None
    for name in settings:
        own = [i for i, (n, _) in enumerate(names) if n == name]
        last = scored.where(F.col("fit").isin(own) & (F.col("trees") == settings[name].rounds))
        part = published(encoded, last, name)
        result = part if result is None else result.unionByName(part)
    return result
