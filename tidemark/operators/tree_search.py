"""Decision trees of a search, grown together over one packed table.

Spark's learner reads and bins its training rows anew for every candidate and fold.  Here a row is binned once for each
fold and packed to bytes; a pass over these blocks counts classes by node, feature and bin for all folds' trees, and the
driver, which gets these counts only (their number goes by nodes, features, bins and classes, not by rows), chooses the splits.
Candidates that grow the same tree share it, and a shallower one is its top.  Bins, splits, leaves and merged leaves are
those of Spark's classifier; beyond 10,000 training rows both place bins by a sample of about as many, each its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Bins of a feature, and about how many training rows they are placed by, as in Spark's trees.
BINS, SAMPLE = 32, 10_000
#: Counts that the driver gets of one pass, at most; nodes beyond take another pass.
CELLS = 4_000_000
#: Parameters that candidates may differ in.
PARAMS = {"maxDepth", "minInstancesPerNode", "minInfoGain"}
EPSILON = float(np.finfo(np.float64).eps)


class Tree:
    """A fold's tree for all ``members``, pairs (least rows of a leaf, least gain), that have chosen the same splits."""

    def __init__(self, fold: int, members: Sequence[tuple], stats: np.ndarray):
        self.fold, self.members = fold, list(members)
        self.feature, self.cut, self.child = [0], [0], [0, 0]   # a node without split is its own child
        self.stats, self.open = [stats], [0]

    def divided(self, members: Sequence[tuple]) -> "Tree":
        other = Tree(self.fold, members, self.stats[0])
        other.feature, other.cut, other.child = [*self.feature], [*self.cut], [*self.child]
        other.stats, other.open = [*self.stats], [*self.open]
        return other

    def split(self, node: int, feature: int, cut: int, left: np.ndarray, right: np.ndarray) -> list[int]:
        """The node's children: bins up to ``cut`` of the feature go left.  Returned are those that may be split again."""
        self.feature[node], self.cut[node] = feature, cut
        new = [len(self.feature), len(self.feature) + 1]
        self.child[2 * node:2 * node + 2] = new
        for at, stats in zip(new, (left, right)):
            self.feature.append(0)
            self.cut.append(0)
            self.child += [at, at]
            self.stats.append(stats)
        return [at for at, stats in zip(new, (left, right)) if abs(gini(stats)) >= EPSILON]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.child)

    def leaves(self, depth: int) -> list[int]:
        """For each node the leaf it belongs to in the tree cut off at ``depth``, leaves of one prediction merged."""
        leaf = list(range(len(self.feature)))

        def ends(node: int, level: int) -> int | None:
            """The only prediction below a node, if it becomes a leaf."""
            below = self.child[2 * node:2 * node + 2]
            if below[0] == node:
                return int(np.argmax(self.stats[node]))
            got = [ends(b, level + 1) for b in below]
            if level >= depth or (got[0] is not None and got[0] == got[1]):
                merged = [*below]
                while merged:
                    at = merged.pop()
                    leaf[at] = node
                    merged += [b for b in self.child[2 * at:2 * at + 2] if b != at]
                return int(np.argmax(self.stats[node])) if level >= depth else got[0]
            return None

        ends(0, 0)
        return leaf


def gini(weights: np.ndarray) -> np.ndarray:
    """Gini impurity of class weights (last axis), 0 without any."""
    total = weights.sum(-1)
    out = np.ones(total.shape)
    with np.errstate(invalid="ignore", divide="ignore"):
        for c in range(weights.shape[-1]):
            out -= (weights[..., c] / total) ** 2
    return np.where(total == 0, 0.0, out)


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Values between bins of about equal weight; between all neighbours if there are few different values."""
    seen, at = np.unique(values, return_inverse=True)
    middle = (seen[:-1] + seen[1:]) / 2
    if len(seen) <= bins:
        return middle
    upto = np.cumsum(np.bincount(at, weights))
    stride = upto[-1] / bins
    out, target = [], stride
    for i in range(1, len(seen)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def best_split(counts: np.ndarray, weights: np.ndarray, cuts: Sequence[int], least_rows: int, least_gain: float):
    """(feature, cut, left's, right's class weights) of most gain from (feature, bin, class) counts, None if none gains.

    ``cuts`` holds how many cuts each feature has.  Of equal ones the first feature's first cut is taken.
    """
    weighted = counts * weights
    left = weighted.cumsum(1)[:, :-1]
    whole = weighted.sum(1)
    right = whole[:, None] - left
    rows = counts.sum(2)
    left_rows = rows.cumsum(1)[:, :-1]
    right_rows = rows.sum(1)[:, None] - left_rows
    of_left, of_right = left.sum(2), right.sum(2)
    with np.errstate(invalid="ignore", divide="ignore"):
        total = of_left + of_right
        gain = gini(whole)[:, None] - of_left / total * gini(left) - of_right / total * gini(right)
    valid = (np.arange(gain.shape[1]) < np.array(cuts)[:, None]) & (left_rows >= least_rows) & (right_rows >= least_rows)
    gain = np.where(valid & (gain >= least_gain) & (gain > 0), gain, -np.inf)
    feature, cut = divmod(int(np.argmax(gain)), gain.shape[1])
    if gain[feature, cut] == -np.inf:
        return None
    return feature, cut, left[feature, cut], right[feature, cut]


def _packed(edges: Sequence[Sequence[np.ndarray]], kind: np.dtype):
    """Blocks of rows as bytes, column by column: fold, label, and for each fold's trees the bin of each feature."""
    width = len(edges[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_fold"))
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), width).T
            if not np.isfinite(x).all():
                raise ValueError("features have to be finite numbers")
            columns = [fold, y, *(np.searchsorted(cuts, v) for own in edges for v, cuts in zip(x, own))]
            yield pa.record_batch([pa.array([np.array(columns).astype(kind).tobytes()], pa.binary())], ["block"])
    return run


def _blocks(batches: Iterator[pa.RecordBatch], kind: np.dtype, columns: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for block in batch.column(0):
            yield np.frombuffer(block.as_buffer(), kind).reshape(columns, -1)


def _reached(bins: np.ndarray, arrays: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """The node that each row gets to in ``depth`` steps."""
    feature, cut, child = arrays
    at, row = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(depth):
        at = child[2 * at + (bins[feature[at], row] > cut[at])]
    return at


def _cells(sums: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(sums)
    return pa.record_batch([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["cell", "n"])


def _training_counts(trees: Sequence[tuple], depth: int, kind: np.dtype, folds: int, shape: tuple[int, int, int, int]):
    """A partition's training rows by feature, node, bin and class (``shape``).

    ``trees``: a tree's fold, arrays, where its counted nodes start among all, and each node's place from there (-1: not counted).
    """
    width, nodes, bins, classes = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, nodes * bins * classes), np.int64)
        for block in _blocks(batches, kind, 2 + folds * width):
            for fold, arrays, first, place in trees:
                rows = block[:, block[0] != fold]
                own = rows[2 + fold * width:2 + (fold + 1) * width]
                at = place[_reached(own, arrays, depth)]
                if (at < 0).any():
                    rows, own, at = rows[:, at >= 0], own[:, at >= 0], at[at >= 0]
                base = at * (bins * classes) + rows[1]
                part = sums[:, first * bins * classes:(first + 1 + place.max()) * bins * classes]
                for j in range(width):
                    part[j] += np.bincount(base + own[j].astype(np.int64) * classes, minlength=part.shape[1])
        yield _cells(sums.reshape(-1))
    return run


def _held_out_counts(trees: Sequence[tuple], depth: int, kind: np.dtype, folds: int, shape: tuple[int, int, int]):
    """A partition's held-out rows by node (its tree's first place is given) and class; ``shape``: features, nodes, classes."""
    width, nodes, classes = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(nodes * classes, np.int64)
        for block in _blocks(batches, kind, 2 + folds * width):
            for fold, arrays, first in trees:
                rows = block[:, block[0] == fold]
                at = _reached(rows[2 + fold * width:2 + (fold + 1) * width], arrays, depth)
                sums += np.bincount((first + at) * classes + rows[1], minlength=len(sums))
        yield _cells(sums)
    return run


def _summed(blocks: DataFrame, counts, shape: Sequence[int]) -> np.ndarray:
    got = blocks.mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(np.prod(shape)), np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(shape)


def _grown(blocks: DataFrame, trees: list[Tree], depths: dict[tuple, int], cuts: Sequence[Sequence[int]], weights: np.ndarray,
           kind: np.dtype) -> list[Tree]:
    """The trees, a level a pass, each as deep as its deepest member; those whose members choose differently are divided."""
    folds, width, classes = len(cuts), len(cuts[0]), len(weights)
    bins = 1 + max(map(max, cuts))
    per_pass = max(1, CELLS // (width * bins * classes))
    for level in range(max(depths.values())):
        trees = [part for t in trees for part in _by_choice(t, {m: depths[m] > level for m in t.members})]
        for t in trees:
            if depths[t.members[0]] <= level:
                t.open = []
        nodes = [(i, node) for i, t in enumerate(trees) for node in t.open]
        counts = {}
        for start in range(0, len(nodes), per_pass):
            some = nodes[start:start + per_pass]
            wanted = []
            for i in dict.fromkeys(i for i, _ in some):
                own = [at for at, (k, _) in enumerate(some) if k == i]
                place = np.full(len(trees[i].feature), -1)
                place[[some[at][1] for at in own]] = range(len(own))
                wanted.append((trees[i].fold, trees[i].arrays(), own[0], place))
            shape = (width, len(some), bins, classes)
            run = _training_counts(wanted, level, kind, folds, shape)
            counts.update(zip(some, _summed(blocks, run, shape).swapaxes(0, 1)))
        new = []
        for i, t in enumerate(trees):
            chosen = {m: [best_split(counts[i, node], weights, cuts[t.fold], *m) for node in t.open] for m in t.members}
            for part in _by_choice(t, {m: tuple(s and s[:2] for s in c) for m, c in chosen.items()}):
                found = zip([*part.open], chosen[part.members[0]])
                part.open = [b for node, s in found if s for b in part.split(node, *s)]
                new.append(part)
        trees = new
    return trees


def _by_choice(tree: Tree, choice: dict[tuple, object]) -> list[Tree]:
    groups = {}
    for member, chosen in choice.items():
        groups.setdefault(chosen, []).append(member)
    return [tree.divided(members) for members in groups.values()]


def held_out_scores(dealt: DataFrame, candidates: Sequence[tuple[int, int, float]], folds: int, label_col: str = "label",
                    weight_col: str = "sample_weight", seed: int = SEED) -> DataFrame:
    """(candidate, fold, y_true, n, cls, p): how many held-out rows of a class get which probabilities.

    ``dealt`` has ``features``, ``fold``, the label and its weight, the same for all rows of a label.  A candidate is
    (depth, least rows of a leaf, least gain); each is fitted off each fold and scores the fold's rows.
    """
    spark = dealt.sparkSession
    rows = dealt.select(vector_to_array(F.col("features")).alias("_x"), F.col(label_col).cast("double").alias("_y"),
                        F.col(weight_col).cast("double").alias("_w"), F.col("fold").cast("int").alias("_fold")).persist()
    blocks = None
    try:
        sizes = rows.groupBy("_fold", "_y").agg(F.count(F.lit(1)).alias("n"), F.min("_w").alias("w"), F.max("_w").alias("top")).collect()
        labels = [r["_y"] for r in sizes]
        if any(y is None or y < 0 or y != int(y) for y in labels) or any(r["w"] is None or not 0 <= r["w"] == r["top"] for r in sizes):
            raise ValueError("labels have to be whole numbers from 0, all rows of a label of one weight")
        classes = 1 + int(max(labels, default=-1))
        weights, n = np.zeros(classes), np.zeros((folds, classes), np.int64)
        for r in sizes:
            weights[int(r["_y"])] = r["w"]
            n[r["_fold"], int(r["_y"])] = r["n"]
        train = n.sum(0) - n   # fold, class
        if not train.sum(1).all():
            raise ValueError("a fold leaves no training rows")
        share = np.minimum(1.0, SAMPLE / train.sum(1))
        some = rows.withColumn("_u", F.rand(seed)).where(F.col("_u") < float(share.max())).collect()   # about SAMPLE rows a fold left out
        x = np.array([r["_x"] for r in some], np.float64)
        w, fold, u = (np.array([r[c] for r in some]) for c in ("_w", "_fold", "_u"))
        edges = []
        for f in range(folds):
            own = (fold != f) & (u < share[f])
            edges.append([cut_points(v[own], w[own], min(BINS, int(train[f].sum()))) for v in x.T])
        cuts = [[len(c) for c in own] for own in edges]
        kind = np.min_scalar_type(max(BINS, folds, classes))
        blocks = rows.select("_x", "_y", "_fold").mapInArrow(_packed(edges, kind), "block binary").persist()
        depths: dict[tuple, int] = {}
        for depth, *member in candidates:
            depths[tuple(member)] = max(depth, depths.get(tuple(member), 0))
        trees = [Tree(f, list(depths), train[f] * weights) for f in range(folds)]
        trees = _grown(blocks, trees, depths, cuts, weights, kind)
        first = np.cumsum([0, *(len(t.feature) for t in trees)])
        shape = (int(first[-1]), classes)
        run = _held_out_counts([(t.fold, t.arrays(), int(at)) for t, at in zip(trees, first)], max(depths.values()), kind, folds,
                               (len(cuts[0]), *shape))
        held = _summed(blocks, run, shape)
    finally:
        rows.unpersist()
        if blocks is not None:
            blocks.unpersist()
    out = []
    for at, (depth, *member) in enumerate(candidates):
        for t, start in zip(trees, first):
            if tuple(member) not in t.members:
                continue
            known = 1 + int(np.flatnonzero(train[t.fold])[-1])   # classes up to the largest of the training rows
            for node, leaf in enumerate(t.leaves(depth)):
                stats = t.stats[leaf][:known]
                p = (stats / (stats.sum() or 1.0)).tolist()
                out += [(at, t.fold, c, int(held[start + node, c]), p) for c in np.flatnonzero(held[start + node]).tolist()]
    wide = spark.createDataFrame(out, "candidate int, fold int, y_true long, n long, _p array<double>")
    return wide.select("candidate", "fold", "y_true", "n", F.posexplode("_p").alias("cls", "p"))
