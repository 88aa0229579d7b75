"""Exact nearest donors under the nan-euclidean distance, by cells of like rows.

Rows with the same columns present are cut, at medians of the columns that a row with gaps has, into cells of a bounded number
of rows, the leaves of a tree; every node has a box and the columns that some and all of its rows have.  A missing value first looks for its k nearest donors in the cell where it lies, then in every cell whose
box is no farther than the k-th of these, found from the tree's root, so nothing is left out and work follows the cells
near a row, not the table.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.session import stored

#: Distances are compared after rounding to 1e-9; a box may be this much nearer than it seems.
MARGIN = 2e-9
#: Pairs of rows and nodes looked at together, at most.
PAIRS = 500_000


class Forest:
    """Trees of cells: for each of some sets of columns (``asked``, those that many rows with gaps have), one of the rows of each
    common pattern of present columns, and of the rest, cut along these columns only.  Each set's trees hold all rows.

    A node's rows with a value of column ``dim`` above ``cut`` are those of its second child, others (and nulls) of its first;
    a leaf is its own child.  Cuts are medians of ``sample``; boxes come from all rows.
    """

    def __init__(self, sample: np.ndarray, patterns: Sequence[tuple[bytes, int]], asked: Sequence[bytes], size: int, leaf: float):
        self.dim, self.cut, self.child = [], [], []
        self.asked = [_bits(m, sample.shape[1]) for m in asked]
        common = [m for m, n in sorted(patterns, key=lambda mn: (-mn[1], mn[0])) if n >= size]
        kinds: dict[bytes | None, list[int]] = {m: [] for m in [*common, None]}
        for i, bits in enumerate(np.packbits(~np.isnan(sample), axis=1)):
            own = bits.tobytes()
            kinds[own if own in kinds else None].append(i)
        values = np.where(np.isnan(sample), -np.inf, sample)
        self.roots = [{m: self._grown(values[np.array(own, np.int64)], dims, leaf) for m, own in kinds.items()} for dims in self.asked]
        self.dim, self.cut, self.child = np.array(self.dim, np.int64), np.array(self.cut), np.array(self.child, np.int64).reshape(-1, 2)

    def _node(self) -> int:
        self.child.append([len(self.dim)] * 2)
        self.dim.append(0)
        self.cut.append(0.0)
        return len(self.dim) - 1

    def _grown(self, rows: np.ndarray, dims: np.ndarray, leaf: float) -> int:
        root = self._node()
        todo = [(root, rows)]
        while todo:
            at, some = todo.pop()
            if len(some) <= max(leaf, 1):
                continue
            finite = np.where(np.isinf(some), np.nan, some)
            span = np.array([np.ptp(v[~np.isnan(v)]) if (~np.isnan(v)).any() else 0.0 for v in finite.T])
            for j in [j for j in np.argsort(-span, kind="stable") if dims[j]]:
                v = some[:, j]
                middle = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
                if middle == v.max():
                    below = v[v < middle]
                    middle = below.max() if len(below) else middle
                if middle < v.max() and np.isfinite(middle):
                    right = v > middle
                    self.dim[at], self.cut[at] = int(j), float(middle)
                    self.child[at] = [self._node(), self._node()]
                    todo += [(self.child[at][0], some[~right]), (self.child[at][1], some[right])]
                    break
        return root

    def trees(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The set of columns that suits each row's own best, and (by place) the patterns that rows have."""
        kinds, which = np.unique(np.packbits(~np.isnan(x), axis=1), axis=0, return_inverse=True)
        own = [_bits(k.tobytes(), x.shape[1]) for k in kinds]
        best = [max(range(len(self.asked)), key=lambda t: (int((o & self.asked[t]).sum() - (~o & self.asked[t]).sum()), -t)) for o in own]
        return np.array(best, np.int64)[which.ravel()], which.ravel(), [k.tobytes() for k in kinds]

    def home_root(self, tree: int, pattern: bytes, col: int, p: int) -> int:
        """The tree of rows with a value of ``col`` and most columns in common, of these of most rows."""
        own, roots = _bits(pattern, p), self.roots[tree]
        fit = [(int((own & _bits(m, p)).sum()), -i, r) for i, (m, r) in enumerate(roots.items()) if m is not None and _bits(m, p)[col]]
        return max(fit)[2] if fit else roots[None]

    def leaf(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf of each row below its node ``at``."""
        row = np.arange(len(x))
        while True:
            to = self.child[at, (x[row, self.dim[at]] > self.cut[at]).astype(np.int64)]
            if (to == at).all():
                return at
            at = to

    def bound(self, rows: Sequence, p: int, size: int) -> None:
        """Sets the boxes of all nodes from those of the leaves (``_leaf``, ``_c`` rows, for each column ``n``, ``l``, ``h``).

        A leaf with far more rows than ``size`` (equal rows) takes several cells.
        """
        nodes = len(self.dim)
        self.lo, self.hi = np.full((nodes, p), np.inf), np.full((nodes, p), -np.inf)
        self.some, self.all, self.n = np.zeros((nodes, p), bool), np.ones((nodes, p), bool), np.zeros((nodes, p), np.int64)
        self.first, self.parts = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        cells = 0
        for r in rows:
            at = r["_leaf"]
            self.n[at] = [r[f"n{i}"] for i in range(p)]
            self.some[at], self.all[at] = self.n[at] > 0, self.n[at] == r["_c"]
            for i in np.flatnonzero(self.some[at]):
                self.lo[at, i], self.hi[at, i] = r[f"l{i}"], r[f"h{i}"]
            self.first[at], self.parts[at] = cells, math.ceil(r["_c"] / (4 * size))
            cells += self.parts[at]
        for at in range(nodes - 1, -1, -1):   # children come after their parents
            a, b = self.child[at]
            if a != at:
                self.lo[at], self.hi[at] = np.minimum(self.lo[a], self.lo[b]), np.maximum(self.hi[a], self.hi[b])
                self.some[at], self.all[at] = self.some[a] | self.some[b], self.all[a] & self.all[b]
        self.lo[~self.all], self.hi[~self.all] = -np.inf, np.inf

    def least(self, x: np.ndarray, col: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Least distance of rows from any donor of a node with a value of their column ``col``; inf if there is none."""
        ss, shared = np.zeros(len(row)), np.zeros(len(row))
        for c in range(x.shape[1]):
            v = x[row, c]
            has = ~np.isnan(v)
            off = np.maximum(np.maximum(self.lo[node, c] - v, v - self.hi[node, c]), 0.0)
            ss += np.where(has, off * off, 0.0)
            shared += has & self.some[node, c]
        return np.where((shared > 0) & self.some[node, col[row]], np.sqrt(x.shape[1] / np.maximum(shared, 1) * ss), np.inf)

    def within(self, x: np.ndarray, col: np.ndarray, radius: np.ndarray):
        """Yields (rows, leaves): the leaves that may hold a donor no farther than a row's radius."""
        tree, _, _ = self.trees(x)
        todo = []
        for t, roots in enumerate(self.roots):
            row = np.flatnonzero(tree == t)
            todo += [(row, np.full(len(row), root)) for root in roots.values()]
        while todo:
            row, node = todo.pop()
            if len(row) > PAIRS:
                half = len(row) // 2
                todo += [(row[:half], node[:half]), (row[half:], node[half:])]
                continue
            least = self.least(x, col, row, node)
            near = np.isfinite(least) & ~(least * (1 - 1e-12) - MARGIN > radius[row])
            row, node = row[near], node[near]
            ends = self.child[node, 0] == node
            if ends.any():
                yield row[ends], node[ends]
            if not ends.all():
                row, child = row[~ends], self.child[node[~ends]]
                todo.append((np.concatenate([row, row]), np.concatenate([child[:, 0], child[:, 1]])))


def _bits(pattern: bytes, p: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(pattern, np.uint8))[:p].astype(bool)


def _forest(z: DataFrame, cols: Sequence[str], size: int, n: int) -> Forest:
    present = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols])
    counts = z.groupBy(present.alias("m")).count()
    pack = lambda m: np.packbits([int(b) for b in m]).tobytes()
    common = [(pack(r["m"]), r["count"]) for r in counts.where(F.col("count") >= size).collect()]
    lacking = counts.where(F.col("m").contains("0") & F.col("m").contains("1")).orderBy(F.desc("count"), "m").limit(len(cols) + 1).collect()
    asked = [pack(r["m"]) for i, r in enumerate(lacking) if not i or r["count"] * 100 >= n] or [pack("1" * len(cols))]
    share = min(1.0, max(20_000 / n, 32 / size))    # about 32 rows a cell say where to cut
    some = z.where(F.rand(1) < share).select(*cols).toArrow()
    x = np.column_stack([some.column(c).to_numpy().astype(float) for c in cols]) if some.num_rows else np.zeros((0, len(cols)))
    return Forest(x, common, asked, size, size * share)


def _placed(forest: Forest, cols: Sequence[str]):
    """A row for each set of columns that trees are cut along, with its leaf."""
    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols])
            _, which, kinds = forest.trees(x)
            for roots in forest.roots:
                at = np.array([roots.get(k, roots[None]) for k in kinds], np.int64)[which]
                leaf = pa.array(forest.leaf(x, at).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, leaf], names=[*batch.schema.names, "_leaf"])
    return run


def _vectors(batch, name: str, p: int) -> np.ndarray:
    flat = batch.column(name)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def _home(forest: Forest, k: int, p: int):
    """Adds ``_cell``, where a row would lie itself, if k donors are there and columns of theirs are sure; else -1.  ``_radius`` is inf."""
    def run(batches):
        for batch in batches:
            x, col = _vectors(batch, "_x", p), batch.column("_col").to_numpy()
            tree, which, kinds = forest.trees(x)
            unit, back = np.unique(np.column_stack([tree, which, col]), axis=0, return_inverse=True)
            roots = np.array([forest.home_root(t, kinds[w], c, p) for t, w, c in unit.tolist()], np.int64)
            leaf = forest.leaf(x, roots[back.ravel()])
            full = (forest.n[leaf, col] >= k) & (forest.all[leaf] & ~np.isnan(x)).any(1)
            part = np.arange(len(x)) % np.maximum(forest.parts[leaf], 1)
            cell = np.where(full, forest.first[leaf] + part, -1).astype(np.int32)
            far = np.full(len(x), np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "_cell", "_radius"])
    return run


def _reach(forest: Forest, p: int):
    """A row for each further cell that may hold one of the k nearest."""
    def run(batches):
        for batch in batches:
            x, col = _vectors(batch, "_x", p), batch.column("_col").to_numpy()
            home, radius = batch.column("_home").to_numpy(), batch.column("_radius").to_numpy()
            for row, leaf in forest.within(x, col, radius):
                parts = forest.parts[leaf]
                row, cell = np.repeat(row, parts), np.repeat(forest.first[leaf], parts)
                cell = cell + np.arange(len(cell)) - np.repeat(parts.cumsum() - parts, parts)
                other = cell != home[row]
                if other.any():
                    part = batch.select(["_rid", "_col", "_x"]).take(pa.array(row[other]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[other].astype(np.int32)), pa.array(radius[row[other]])],
                                                     names=["_rid", "_col", "_x", "_cell", "_radius"])
    return run


def _search(cols: Sequence[str], k: int, id_type: pa.DataType):
    """The k nearest donors of a cell, no farther than the radius, for its rows' missing columns, ties by donor id."""
    p = len(cols)

    def run(key, rows: pa.Table, donors: pa.Table) -> pa.Table:
        donors = donors.take(pc.sort_indices(donors.column("_id"))) if donors.num_rows else donors
        d = np.column_stack([donors.column(c).to_numpy().astype(float) for c in cols]) if donors.num_rows else np.zeros((0, p))
        x, col = _vectors(rows, "_x", p), rows.column("_col").to_numpy()
        radius2 = (rows.column("_radius").to_numpy() * (1 + 1e-12) + MARGIN) ** 2
        ids = donors.column("_id").combine_chunks() if donors.num_rows else pa.array([], id_type)
        kinds = pc.unique(ids)
        own, theirs = (pc.fill_null(pc.index_in(v, value_set=kinds), -1).to_numpy(zero_copy_only=False)
                       for v in (rows.column("_rid").combine_chunks() if rows.num_rows else ids, ids))
        take, found = [], []
        has_x = ~np.isnan(x)
        like = np.unique(np.column_stack([col, has_x]), axis=0, return_inverse=True)[1].ravel() if len(x) else col
        for g in np.unique(like):   # rows with the same columns, missing the same one
            at = np.flatnonzero(like == g)
            c, has = col[at[0]], has_x[at[0]]
            cand = np.flatnonzero(~np.isnan(d[:, c]))
            if not len(cand):
                continue
            dc, has_d = d[cand], ~np.isnan(d[cand])
            alike = bool((has_d == has_d[0]).all())
            both = has & has_d[0] if alike else has
            n = float(both.sum()) if alike else (has_d & has).sum(1)
            m = min(k, len(cand))
            filled = [np.ascontiguousarray(dc[:, j]) for j in range(p)]
            step = max(1, 200_000 // len(cand))
            for a in range(0, len(at), step):
                rows_ = at[a:a + step]
                far2 = np.zeros((len(rows_), len(cand)))
                for j in np.flatnonzero(both):
                    off = x[rows_, j][:, None] - filled[j]
                    off *= off
                    far2 += off if alike else np.where(has_d[:, j], off, 0.0)
                far2 *= p / np.maximum(n, 1)
                far2[:, np.broadcast_to(n == 0, len(cand))] = np.inf
                if np.isin(own[rows_], theirs[cand]).any():
                    far2[own[rows_][:, None] == theirs[cand]] = np.inf
                near = far2.min(1) <= radius2[rows_]
                if not near.all():
                    rows_, far2 = rows_[near], far2[near]
                pick = np.argpartition(far2, m - 1, axis=1)[:, :m]
                last = np.sqrt(np.take_along_axis(far2, pick, 1).max(1))
                within = far2 <= ((last + MARGIN) ** 2)[:, None]
                for i in np.flatnonzero(within.sum(1) > m):   # close to the last place: by rounded distance, then id
                    near = np.flatnonzero(within[i])
                    pick[i] = near[np.argsort(np.floor(np.sqrt(far2[i, near]) * 1e9 + 0.5), kind="stable")[:m]]
                far = np.sqrt(np.take_along_axis(far2, pick, 1))
                i, j = np.nonzero(np.isfinite(far) & (far * far <= radius2[rows_][:, None] * (1 + 1e-12)))
                take.append(rows_[i])
                found.append((cand[pick[i, j]], far[i, j], dc[pick[i, j], c]))
        at = np.concatenate(take) if take else np.zeros(0, np.int64)
        which = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        dist, val = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (1, 2))
        return pa.table({"_rid": rows.column("_rid").combine_chunks().take(pa.array(at)) if len(at) else pa.array([], id_type),
                         "_col": pa.array(col[at].astype(np.int32) if len(at) else np.zeros(0, np.int32)),
                         "_did": ids.take(pa.array(which)), "_dist": pa.array(dist), "_val": pa.array(val)})
    return run


def nearest_means(z: DataFrame, cols: Sequence[str], k: int, size: int) -> DataFrame:
    """(_id, _col, _v): for each missing value of column number ``_col`` the mean over its k nearest donors.

    ``z`` has ``_id`` and double columns.  Rows that share an id are never each other's donors and are filled alike;
    a null id neither gives nor takes.  A value without any donor has no row.
    """
    cols = list(cols)
    spark, p = z.sparkSession, len(cols)
    z = z.where(F.col("_id").isNotNull())
    n = z.count()
    if not n:
        return z.select("_id", F.lit(0).alias("_col"), F.lit(None).cast("double").alias("_v"))
    forest = _forest(z, cols, size, n)
    rows = z.select("_id", *cols)
    placed = stored(rows.mapInArrow(_placed(forest, cols), StructType([*rows.schema.fields, StructField("_leaf", IntegerType())])), "knn-donors")
    boxes = placed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_c"), *[e for i, c in enumerate(cols) for e in (
        F.count(c).alias(f"n{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"))]).collect()   # a row a leaf
    forest.bound(boxes, p, size)
    at = spark.createDataFrame([(r["_leaf"], int(forest.first[r["_leaf"]]), int(forest.parts[r["_leaf"]])) for r in boxes],
                               "_leaf int, _first int, _parts int")
    donors = placed.join(F.broadcast(at), "_leaf").select("_id", *cols, (
        F.col("_first") + F.pmod(F.xxhash64("_id"), F.col("_parts"))).cast("int").alias("_cell"))
    id_sql = z.schema["_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(z.schema["_id"].dataType)
    nan = F.lit(float("nan"))
    gaps = F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(cols)])
    todo = z.select(F.col("_id").alias("_rid"), F.explode(F.filter(gaps, lambda g: g.isNotNull())).alias("_col"),
                    F.array(*[F.coalesce(F.col(c), nan) for c in cols]).alias("_x"))
    row = f"_rid {id_sql}, _col int, _x array<double>, _cell int, _radius double"
    units = stored(todo.mapInArrow(_home(forest, k, p), row), "knn-units")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, math.ceil(n / 50_000))

    def searched(rows: DataFrame, name: str) -> DataFrame:  # tasks are many, for it is time that they take, not bytes
        asked = donors.join(F.broadcast(rows.select("_cell").distinct()), "_cell", "leftsemi")   # a cell a row
        return stored(rows.repartition(tasks, "_cell").groupBy("_cell").cogroup(asked.repartition(tasks, "_cell").groupBy("_cell"))
                      .applyInArrow(_search(cols, k, id_type), f"_rid {id_sql}, _col int, _did {id_sql}, _dist double, _val double"), name)

    first = searched(units, "knn-near")
    # a row's own k-th distance: rows that share an id are looked up with the widest of theirs
    radius = first.groupBy("_rid", "_col").agg(F.count(F.lit(1)).alias("_f"), F.max("_dist").alias("_k"))
    wide = units.join(radius, ["_rid", "_col"], "left").select(
        "_rid", "_col", "_x", F.col("_cell").alias("_home"),
        F.when(F.col("_f") >= k, F.col("_k")).otherwise(F.lit(float("inf"))).alias("_radius"))
    more = searched(stored(wide.mapInArrow(_reach(forest, p), row), "knn-reach"), "knn-far")
    from pyspark.sql import Window
    w = Window.partitionBy("_rid", "_col").orderBy(F.round(F.col("_dist") * 1e9, 0), "_did")
    top = first.unionByName(more).withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    return top.groupBy(F.col("_rid").alias("_id"), "_col").agg(F.avg("_val").alias("_v"))
