"""Many regression forests grown together.

A forest is a role (how often each row counts in training), a target and a seed. Forests of all replicates, folds,
targets, arms and bags are grown in the same jobs:

1. Features are binned once, at quantiles of all rows. A row is its bins, its targets and one array with its weight
   in every role; no row is copied per replicate, fold or bag.
2. Rows are dealt into blocks of bounded size and trees into groups; a task holds one block for one group of trees.
   Rows outside a role have weight zero in the sums but run down its trees all the same, which gives predictions.
3. A level is one sum per (tree, node, feature, bin). With several blocks the sums of a level meet by tree and node
   and the split is chosen there. With one block they are complete where they are made, so its trees grow to the end
   in the task. Both find the same splits: the greatest loss of squared error, ties to the first feature and cut.

Forests average bagged trees, whose bag is a Poisson(1) draw from a hash of row, forest and tree. Boosting adds trees
on residuals, one round after the other, all its forests in step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplepanel.functions.columns import POISSON_ONE_CDF
from ripplepanel.session import cut

#: Rows a task holds, and groups that trees are dealt into.
BLOCK_ROWS, GROUPS = 200_000, 64
#: Row-tree pairs a task works on at once, and nodes whose sums it holds.
PAIRS, NODES = 100_000, 4000
#: Trees whose sums of one level are in flight where rows fill several blocks.
AT_ONCE = 2000
BINS = 32


@dataclass(frozen=True)
class Forest:
    """``role`` and ``target`` are places in the arrays of a row; ``number`` names the forest in the results."""

    number: int
    role: int
    target: int
    seed: int


@dataclass(frozen=True)
class Growth:
    """How trees grow: ``boost`` is the step of boosting, None for bagged trees. ``min_leaf`` counts draws."""

    trees: int = 300
    depth: int = 8
    min_leaf: int = 5
    boost: float | None = None
    bag: bool = True
    bins: int = BINS


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def draws(rows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Poisson(1) draws, a row per seed and a column per row hash."""
    u = (_mix(rows[None, :] ^ _mix(seeds.astype(np.uint64))[:, None]) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(np.array(POISSON_ONE_CDF), u, side="right")


@dataclass
class Trees:
    """Trees as node arrays: the first ``count`` nodes are the roots; a node's right child follows its left one."""

    count: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    left: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    tree: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    open: np.ndarray = field(init=False)

    def __post_init__(self):
        n = self.count
        self.feature, self.cut, self.left = np.full(n, -1), np.zeros(n, int), np.full(n, -1)
        self.value, self.tree, self.gain, self.open = np.full(n, np.nan), np.arange(n), np.zeros(n), np.arange(n)

    def move(self, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Nodes one level further down; rows in a leaf stay. ``node`` has a row per tree, ``bins`` a row per row."""
        feature = self.feature[node]
        inner = feature >= 0
        value = bins[np.arange(bins.shape[0])[None, :], np.maximum(feature, 0)]
        return np.where(inner, self.left[node] + (value > self.cut[node]), node)

    def route(self, bins: np.ndarray, depth: int) -> np.ndarray:
        node = np.broadcast_to(np.arange(self.count)[:, None], (self.count, len(bins)))
        for _ in range(depth):
            node = self.move(node, bins)
        return node

    def split(self, at: np.ndarray, best: "Splits", min_leaf: int) -> None:
        """Split the open nodes ``at`` where ``best`` has a gain; children large enough to split again are open."""
        if (self.value[at] != self.value[at]).any():  # roots have no value yet
            self.value[at] = best.value
        some = best.gain > 0
        parents, n = at[some], int(some.sum())
        first = len(self.feature)
        self.feature[parents], self.cut[parents] = best.feature[some], best.cut[some]
        self.left[parents], self.gain[parents] = first + 2 * np.arange(n), best.gain[some]
        self.feature = np.concatenate([self.feature, np.full(2 * n, -1)])
        self.cut = np.concatenate([self.cut, np.zeros(2 * n, int)])
        self.left = np.concatenate([self.left, np.full(2 * n, -1)])
        self.gain = np.concatenate([self.gain, np.zeros(2 * n)])
        self.tree = np.concatenate([self.tree, np.repeat(self.tree[parents], 2)])
        self.value = np.concatenate([self.value, best.values[some].ravel()])
        self.open = first + np.flatnonzero(best.sizes[some].ravel() >= 2 * min_leaf)

    def importance(self, features: int) -> np.ndarray:
        """Share of each feature in the gain of a tree, averaged over trees that split."""
        total = np.zeros((self.count, features))
        inner = self.feature >= 0
        np.add.at(total, (self.tree[inner], self.feature[inner]), self.gain[inner])
        size = total.sum(axis=1)
        return (total[size > 0] / size[size > 0, None]).sum(axis=0)


def histograms(trees: Trees, asked: np.ndarray, node, bins, n, weight, target, nbins: int) -> np.ndarray:
    """Sums (draws, weight, weight x target) by (asked node, feature, bin); arrays have a row per tree."""
    slot = np.full(len(trees.feature), -1)
    slot[asked] = np.arange(len(asked))
    place = slot[node]
    tree, row = np.nonzero((place >= 0) & (n > 0))
    at, drawn, mass = place[tree, row] * nbins, n[tree, row], weight[tree, row]
    moment = mass * target[tree, row]
    out = np.empty((3, len(asked), bins.shape[1], nbins))
    for f in range(bins.shape[1]):
        cell = at + bins[row, f]
        for part, values in enumerate((drawn, mass, moment)):
            if part == 1 and weight is n:
                out[1, :, f] = out[0, :, f]
            else:
                out[part, :, f] = np.bincount(cell, values, len(asked) * nbins).reshape(-1, nbins)
    return out


@dataclass
class Splits:
    gain: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    values: np.ndarray
    sizes: np.ndarray


def best_splits(sums: np.ndarray, min_leaf: int) -> Splits:
    """The best split of every node: rows whose bin is at most ``cut`` go left."""
    nodes, features, nbins = sums.shape[1:]
    n, w, s = np.cumsum(sums, axis=3)
    all_n, all_w, all_s = n[:, :, -1:], w[:, :, -1:], s[:, :, -1:]
    n, w, s = n[:, :, :-1], w[:, :, :-1], s[:, :, :-1]
    right = (n >= min_leaf) & (all_n - n >= min_leaf) & (w > 0) & (all_w - w > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / w + (all_s - s) ** 2 / (all_w - w) - all_s * all_s / all_w
    # a gain that rounding alone can make is none
    size = np.abs(all_s * all_s) / np.maximum(all_w, 1e-300)
    gain = np.where(right & (gain > 1e-12 * size + 1e-300), gain, 0.0).reshape(nodes, -1)
    at = gain.argmax(axis=1)
    feature, place, every = at // (nbins - 1), at % (nbins - 1), np.arange(nodes)
    w_l, s_l, n_l = (v[every, feature, place] for v in (w, s, n))
    w_a, s_a, n_a = (v[every, feature, 0] for v in (all_w, all_s, all_n))
    with np.errstate(divide="ignore", invalid="ignore"):
        value, values = s_a / w_a, np.stack([s_l / w_l, (s_a - s_l) / (w_a - w_l)], axis=1)
    return Splits(gain[every, at], feature, place, value, values, np.stack([n_l, n_a - n_l], axis=1))


def joined(parts: Sequence[Splits]) -> Splits:
    return Splits(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("gain", "feature", "cut", "value", "values", "sizes")])


class _Block:
    """The rows of a block as arrays."""

    def __init__(self, table: pa.Table, edges: list[np.ndarray]):
        self.table, n = table, table.num_rows
        x = table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.int16)
        self.y = table.column("_y").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.w = table.column("_w").to_numpy()
        self.roles = table.column("_roles").combine_chunks().flatten().to_numpy().reshape(n, -1)
        self.scored = table.column("_scored").to_numpy(zero_copy_only=False)
        self.key = table.column("_key").to_numpy().view(np.uint64)

    def rows_of(self, forest: Forest) -> np.ndarray:
        return np.flatnonzero((self.roles[:, forest.role] > 0) | self.scored)

    def counts(self, forest: Forest, rows: np.ndarray, numbers: np.ndarray, growth: Growth) -> np.ndarray:
        """Draws of each row in each tree."""
        role = self.roles[rows, forest.role].astype(float)
        if growth.boost is not None or not growth.bag:
            return np.broadcast_to(role, (len(numbers), len(rows)))
        return role * draws(self.key[rows], forest.seed * 1_000_003 + numbers)


def _slices(forests: Sequence[Forest], growth: Growth, most: int = 100) -> list[tuple[Forest, int, int]]:
    """Units of work: (forest, first tree, trees). A boosted forest is one unit."""
    if growth.boost is not None:
        return [(f, 0, growth.trees) for f in forests]
    return [(f, a, min(most, growth.trees - a)) for f in forests for a in range(0, growth.trees, most)]


def _grow_here(block: _Block, forest: Forest, numbers: np.ndarray, rows, target, growth: Growth):
    """Trees of one forest on the rows of a block that holds them all; their nodes per row as well."""
    bins, n = block.bins[rows], block.counts(forest, rows, numbers, growth)
    trees = Trees(len(numbers))
    node = trees.route(bins, 0)
    weight = n if (block.w[rows] == 1).all() else n * block.w[rows]
    goal = np.broadcast_to(target, n.shape)
    for _ in range(growth.depth):
        best = [best_splits(histograms(trees, trees.open[i : i + NODES], node, bins, n, weight, goal, growth.bins), growth.min_leaf)
                for i in range(0, len(trees.open), NODES)]
        trees.split(trees.open, joined(best), growth.min_leaf)
        node = trees.move(node, bins)
        if not len(trees.open):
            break
    return trees, node


def _base(block: _Block, forest: Forest, rows: np.ndarray) -> tuple[float, float]:
    """Weight and weighted sum of the target in a role."""
    w = block.roles[rows, forest.role] * block.w[rows]
    return float(w.sum()), float((w * block.y[rows, forest.target]).sum())


def _unit(block: _Block, forest: Forest, first: int, count: int, growth: Growth, features: int):
    """Scored rows of a unit, the sum of their predictions over its trees, and its feature importance."""
    rows = block.rows_of(forest)
    y = block.y[rows, forest.target]
    total, share = np.zeros(len(rows)), np.zeros(features)
    if growth.boost is not None:
        mass, moment = _base(block, forest, rows)
        total += moment / mass if mass > 0 else np.nan
        for r in range(count):
            trees, node = _grow_here(block, forest, np.array([r]), rows, y - total, growth)
            total += growth.boost * trees.value[node[0]]
            share += trees.importance(features)
    else:
        step = max(1, PAIRS // max(1, len(rows)))
        for a in range(first, first + count, step):
            numbers = np.arange(a, min(a + step, first + count))
            trees, node = _grow_here(block, forest, numbers, rows, y, growth)
            total += trees.value[node].sum(axis=0)
            share += trees.importance(features)
    keep = block.scored[rows] & (block.roles[rows, forest.role] == 0)
    return rows[keep], total[keep], share


def _scores(keys: Sequence[str], block: _Block, found: list[tuple]) -> pa.Table:
    """Rows (keys, forest, total, trees), then rows (forest, feature, share)."""
    at = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    parts = {k: block.table.column(k).combine_chunks().take(pa.array(at)) for k in keys}
    size = [len(f[1]) for f in found]
    parts["forest"] = pa.array(np.repeat([f[0].number for f in found], size).astype(np.int32))
    parts["total"] = pa.array(np.concatenate([f[2] for f in found]) if found else np.zeros(0))
    parts["trees"] = pa.array(np.repeat([f[4] for f in found], size).astype(np.int32))
    parts["feature"], parts["share"] = pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.float64())
    rows = pa.table(parts)
    features = len(found[0][3]) if found else 0
    n = len(found) * features
    tail = {k: pa.nulls(n, rows.schema.field(k).type) for k in (*keys, "total")}
    tail["forest"] = pa.array(np.repeat([f[0].number for f in found], features).astype(np.int32))
    tail["trees"] = pa.array(np.repeat([f[4] for f in found], features).astype(np.int32))
    tail["feature"] = pa.array(np.tile(np.arange(features), len(found)).astype(np.int32))
    tail["share"] = pa.array(np.concatenate([f[3] for f in found]) if found else np.zeros(0))
    return pa.concat_tables([rows, pa.table({c: tail[c] for c in rows.column_names})])


class Stack:
    """Rows made ready for growing: blocks, groups and bin edges."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], features: Sequence[str], targets: Sequence[str],
                 roles: Column, scored: Column, weight: Column | None = None, bins: int = BINS, block_rows: int = BLOCK_ROWS):
        self.keys, self.features, self.bins = list(keys), list(features), bins
        shaped = rows.select(
            *self.keys, F.array(*[F.col(c).cast("double") for c in features]).alias("_x"),
            F.array(*[F.col(c).cast("double") for c in targets]).alias("_y"),
            F.coalesce((weight if weight is not None else F.lit(1.0)).cast("double"), F.lit(0.0)).alias("_w"),
            roles.alias("_roles"), scored.alias("_scored"), F.xxhash64(*self.keys).alias("_key"))
        self.rows = cut(shaped, "stacked")
        spots = [i / bins for i in range(1, bins)]
        got = self.rows.agg(F.count(F.lit(1)).alias("n"), *[
            F.percentile_approx(F.col("_x")[f], spots, 10_000).alias(f"e{f}") for f in range(len(self.features))]).first()
        # at most bins - 1 numbers per feature
        self.edges = [np.unique(np.array(got[f"e{f}"] or [0.0], float)) for f in range(len(self.features))]
        self.size = got["n"]
        self.blocks = max(1, -(-got["n"] // block_rows))

    def _dealt(self, groups: int) -> DataFrame:
        block = F.pmod(F.hash("_key"), F.lit(self.blocks)).alias("_block")
        dealt = self.rows.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
        return dealt.repartition(max(1, self.blocks * groups), "_block", "_group")

    def _schema(self) -> str:
        kinds = ", ".join(f"{k} {self.rows.schema[k].dataType.simpleString()}" for k in self.keys)
        return f"{kinds}, forest int, total double, trees int, feature int, share double"

    def grow(self, forests: Sequence[Forest], growth: Growth, groups: int = GROUPS) -> tuple[DataFrame, DataFrame]:
        """Predictions (keys, forest, prediction) of scored rows outside a forest's role, and importance
        (forest, feature, importance). A forest whose role is empty predicts nothing."""
        growth = replace(growth, bins=self.bins)
        found = self._spread(forests, growth, groups) if self.blocks > 1 else self._at_home(forests, growth, groups)
        found = cut(found, "grown")
        scores = found.where(F.col("feature").isNull()).groupBy(*self.keys, "forest").agg(
            (F.sum("total") / (F.lit(1) if growth.boost is not None else F.sum("trees"))).alias("prediction"))
        scores = scores.where(F.col("prediction").isNotNull() & ~F.isnan("prediction"))
        shares = found.where(F.col("feature").isNotNull()).groupBy("forest", "feature").agg(
            (F.sum("share") / F.sum("trees")).alias("importance"))
        return scores, shares

    def _at_home(self, forests: Sequence[Forest], growth: Growth, groups: int) -> DataFrame:
        units = _slices(forests, growth)
        groups = min(groups, len(units))
        keys, edges, features = self.keys, self.edges, len(self.features)

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            block, found = _Block(table, edges), []
            for forest, first, count in units[key[1].as_py() :: groups]:
                rows, total, share = _unit(block, forest, first, count, growth, features)
                found.append((forest, rows, total, share, count))
            return _scores(keys, block, found)

        return self._dealt(groups).groupBy("_block", "_group").applyInArrow(run, self._schema())

    def _spread(self, forests: Sequence[Forest], growth: Growth, groups: int) -> DataFrame:
        """Sums of every level meet by (tree, node); what the driver holds is the trees, never rows."""
        out = None
        if growth.boost is None:
            units = _slices(forests, growth)
            at_once = max(1, AT_ONCE // 100)
            for start in range(0, len(units), at_once):
                part = units[start : start + at_once]
                grown = self._levels(part, growth, groups, None)
                rows = self._predicted(part, [grown], [], growth, groups)
                out = rows if out is None else out.unionByName(rows)
            return out
        units = [(f, 0, 1) for f in forests]
        base, rounds = self._bases(forests), []
        for r in range(growth.trees):
            units = [(f, r, 1) for f in forests]
            rounds.append(self._levels(units, growth, groups, (base, list(rounds))))
        return self._predicted(units, rounds, base, growth, groups)

    def _bases(self, forests: Sequence[Forest]) -> list[float]:
        edges = self.edges

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            block = _Block(table, edges)
            sums = [_base(block, f, block.rows_of(f)) for f in forests]
            return pa.table({"forest": pa.array(range(len(forests)), pa.int32()), "w": [s[0] for s in sums], "s": [s[1] for s in sums]})

        got = self._dealt(1).groupBy("_block", "_group").applyInArrow(run, "forest int, w double, s double").groupBy("forest").agg(
            (F.sum("s") / F.sum("w")).alias("m")).collect()
        mean = {r["forest"]: r["m"] for r in got}
        return [float("nan") if mean.get(i) is None else mean[i] for i in range(len(forests))]

    def _levels(self, units: list[tuple], growth: Growth, groups: int, boosted) -> Trees:
        """The trees of ``units`` as one set of node arrays, grown level by level."""
        spark, edges, features = self.rows.sparkSession, self.edges, len(self.features)
        groups = min(groups, len(units))
        starts = np.cumsum([0] + [u[2] for u in units])
        trees = Trees(int(starts[-1]))
        for depth in range(growth.depth):
            if not len(trees.open):
                break
            sent = spark.sparkContext.broadcast((trees, boosted))

            def sums(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
                now, before = sent.value
                block, at, parts = _Block(table, edges), [], []
                for u in range(key[1].as_py(), len(units), groups):
                    forest, first, count = units[u]
                    rows = block.rows_of(forest)
                    own = _subset(now, starts[u], starts[u + 1])
                    if not len(own.open) or not len(rows):
                        continue
                    n = block.counts(forest, rows, np.arange(first, first + count), growth)
                    goal = block.y[rows, forest.target]
                    if before is not None:
                        goal = goal - _boosted(block.bins[rows], u, before, growth)
                    bins = block.bins[rows]
                    made = histograms(own, own.open, own.route(bins, depth), bins, n, n * block.w[rows], np.broadcast_to(goal, n.shape), growth.bins)
                    at.append(own.names[own.open])
                    parts.append(made.transpose(1, 0, 2, 3).reshape(len(own.open), -1))
                at = np.concatenate(at) if at else np.zeros(0, np.int64)
                raw = [v.tobytes() for p in parts for v in p]
                return pa.table({"node": pa.array(at, pa.int64()), "sums": pa.array(raw, pa.binary())})

            def choose(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = 0.0
                for batch in batches:
                    for v in batch.column("sums"):
                        total = total + np.frombuffer(v.as_buffer())
                best = best_splits(total.reshape(3, 1, features, growth.bins), growth.min_leaf)
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array([key[0].as_py()], pa.int64()), "gain": best.gain, "feature": best.feature, "cut": best.cut,
                    "value": best.value, "low": best.values[:, 0], "high": best.values[:, 1], "n_low": best.sizes[:, 0],
                    "n_high": best.sizes[:, 1]})

            made = self._dealt(groups).groupBy("_block", "_group").applyInArrow(sums, "node long, sums binary")
            # a row per open node of the trees in flight
            got = made.groupBy("node").applyInArrow(
                choose, "node long, gain double, feature long, cut long, value double, low double, high double, n_low double, n_high double"
            ).orderBy("node").toArrow()
            c = {name: got.column(name).to_numpy() for name in got.column_names}
            best = Splits(c["gain"], c["feature"], c["cut"], c["value"], np.stack([c["low"], c["high"]], axis=1),
                          np.stack([c["n_low"], c["n_high"]], axis=1))
            trees.split(c["node"], best, growth.min_leaf)
        return trees

    def _predicted(self, units: list[tuple], grown: list[Trees], base: list[float], growth: Growth, groups: int) -> DataFrame:
        groups = min(groups, len(units))
        keys, edges, features = self.keys, self.edges, len(self.features)
        starts = np.cumsum([0] + [u[2] for u in units])
        sent = self.rows.sparkSession.sparkContext.broadcast((grown, base))

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            rounds, means = sent.value
            block, found = _Block(table, edges), []
            for u in range(key[1].as_py(), len(units), groups):
                forest, _, count = units[u]
                rows = np.flatnonzero(block.scored & (block.roles[:, forest.role] == 0))
                bins = block.bins[rows]
                if means:
                    total, count = _boosted(bins, u, (means, rounds), growth), growth.trees
                    share = sum(_subset(t, u, u + 1).importance(features) for t in rounds)
                else:
                    own = _subset(rounds[0], starts[u], starts[u + 1])
                    total, share = own.value[own.route(bins, growth.depth)].sum(axis=0), own.importance(features)
                # every block sees the whole trees: importance counts once
                found.append((forest, rows, total, share if key[0].as_py() == 0 else share * 0, count))
            return _scores(keys, block, found)

        made = self._dealt(groups).groupBy("_block", "_group").applyInArrow(run, self._schema())
        if self.blocks > 1:  # shares come from one block, tree counts from all
            made = made.withColumn("share", F.col("share") * F.lit(float(self.blocks)))
        return made


def _subset(trees: Trees, start: int, end: int) -> Trees:
    """The trees ``start`` to ``end`` on their own; ``names`` are their nodes' places in the whole."""
    names = np.flatnonzero((trees.tree >= start) & (trees.tree < end))
    place = np.full(len(trees.tree), -1)
    place[names] = np.arange(len(names))
    own = Trees(end - start)
    own.feature, own.cut, own.value, own.gain = trees.feature[names], trees.cut[names], trees.value[names], trees.gain[names]
    own.left = np.where(trees.left[names] >= 0, place[np.maximum(trees.left[names], 0)], -1)
    own.tree = trees.tree[names] - start
    own.open = place[trees.open[(trees.tree[trees.open] >= start) & (trees.tree[trees.open] < end)]]
    own.names = names
    return own


def _boosted(bins: np.ndarray, forest: int, before, growth: Growth) -> np.ndarray:
    """Prediction of a boosted forest after the rounds so far."""
    base, rounds = before
    total = np.full(len(bins), base[forest])
    for trees in rounds:
        own = _subset(trees, forest, forest + 1)
        total = total + growth.boost * own.value[own.route(bins, growth.depth)[0]]
    return total
