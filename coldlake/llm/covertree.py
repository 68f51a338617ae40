"""Embedding near-duplicates: cover trees per block of vectors, traversed in pairs with exact bounds."""

from __future__ import annotations

import pickle
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import components, staged

THRESHOLD = 0.93
#: Vectors in a block on average; a block is what one task holds of one side.
BLOCK = 1024
#: Most pivots over all labels; with more vectors cells grow and are cut into more blocks.
MOST_PIVOTS = 16_384
#: Pairs of points that are compared at once rather than by opening their nodes.
DENSE = 4096
#: Blocks of a label in a crew on average; two crews meet in one task, so a block is sent once per crew it may meet.
CREW = 16
_SLACK = 1e-9


class CoverTree:
    """Nested levels with halving radii over unit vectors.

    Points are stored so that each node's are contiguous. A node is (start, end, radius,
    children); its centre is the point at ``start``, which is also the first child's centre, and
    ``radius`` is the true greatest chord from the centre to its points.
    """

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, float, list[int]]] = []
        self.points = vectors
        todo = [(self.order, 2.0, -1)]
        laid: list[tuple[np.ndarray, float, int, list[int], float]] = []
        while todo:
            idx, scale, parent = todo.pop()
            far = _chords(vectors[idx[:1]], vectors[idx])[0]
            radius = float(far.max())
            here = len(laid)
            laid.append((idx, scale, parent, [], radius))
            if parent >= 0:
                laid[parent][3].append(here)
            if len(idx) == 1 or radius <= _SLACK:
                continue
            while scale >= radius:
                scale /= 2
            rest, parts = idx, []
            while len(rest):
                near = _chords(vectors[rest[:1]], vectors[rest])[0] <= scale
                near[0] = True
                parts.append(rest[near])
                rest = rest[~near]
            todo += [(p, scale, here) for p in reversed(parts)]
        order: list[np.ndarray] = []
        spot = 0
        self.nodes = [(0, 0, 0.0, [])] * len(laid)
        stack, starts, ends = [(0, False)], {}, {}
        while stack:  # children in order, so that ranges nest
            k, over = stack.pop()
            if over:
                ends[k] = spot
                self.nodes[k] = (starts[k], spot, laid[k][4], laid[k][3])
                continue
            starts[k] = spot
            stack.append((k, True))
            if laid[k][3]:
                stack += [(c, False) for c in reversed(laid[k][3])]
            else:
                order.append(laid[k][0])
                spot += len(laid[k][0])
        self.order = np.concatenate(order) if order else self.order
        self.points = vectors[self.order]
        self._arrays()

    def _arrays(self) -> None:
        """What the traversal reads of all nodes at once: spans, radii and points in single precision."""
        self.start, self.end = (np.array([n[k] for n in self.nodes], dtype=np.int64) for k in (0, 1))
        self.radius = np.array([n[2] for n in self.nodes], dtype=np.float32) * np.float32(1 + 1e-6)
        self.rough = self.points.astype(np.float32)

    def children(self, node: int) -> np.ndarray:
        """The node's children; a leaf is its own."""
        return np.array(self.nodes[node][3] or [node])

    def __getstate__(self) -> tuple:
        return self.order, self.nodes, self.points

    def __setstate__(self, state: tuple) -> None:
        self.order, self.nodes, self.points = state
        self._arrays()


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _spans(tree: CoverTree, nodes: np.ndarray) -> np.ndarray:
    """Stored positions of the points of ``nodes``."""
    size = tree.end[nodes] - tree.start[nodes]
    return np.repeat(tree.start[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _compared(a: CoverTree, b: CoverTree, rows: np.ndarray, cols: np.ndarray, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs among the points at ``rows`` and ``cols``: single precision rules most out, double precision decides."""
    rough = a.rough[rows] @ b.rough[cols].T >= np.float32(threshold - slack)
    rows, cols = rows[rough.any(axis=1)], cols[rough.any(axis=0)]
    i, j = np.nonzero(a.points[rows] @ b.points[cols].T >= threshold)
    return rows[i], cols[j]


def close_pairs(a: CoverTree, b: CoverTree, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of original positions in ``a`` and ``b`` with cosine at least ``threshold``.

    Dual traversal: a pair of nodes whose centres are further apart than the threshold's chord
    plus both radii holds no such pair and is dropped; others open into their children. Where
    many small pairs are left, or nodes are small, their points are compared at once.
    """
    chord = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-7
    slack = 1e-6 * max(16, a.points.shape[1])  # bounds the rounding of single precision
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        kx, ky = a.children(x), b.children(y)
        rows, cols = _spans(a, np.array([x])), _spans(b, np.array([y]))
        if len(rows) * len(cols) > DENSE and (a.nodes[x][3] or b.nodes[y][3]):
            # a chord of at most t means a cosine of at least 1 - t * t / 2
            reach = np.float32(chord) + a.radius[kx][:, None] + b.radius[ky][None, :]
            near = a.rough[a.start[kx]] @ b.rough[b.start[ky]].T >= 1 - reach * reach / 2 - np.float32(slack)
            if np.count_nonzero(near) * DENSE <= len(rows) * len(cols):
                i, j = np.nonzero(near)
                todo += zip(kx[i].tolist(), ky[j].tolist(), strict=True)
                continue
            rows, cols = _spans(a, kx[near.any(axis=1)]), _spans(b, ky[near.any(axis=0)])
        u, v = _compared(a, b, rows, cols, threshold, slack)
        left.append(u)
        right.append(v)
    return a.order[np.concatenate(left)], b.order[np.concatenate(right)]


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each node's component among ``n`` nodes with edges u-v."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, low[u])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length, without nulls, as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _unit(vectors) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _assign(classes: DataFrame, pivots: dict) -> DataFrame:
    """Adds ``cell``: the nearest of the label's pivots, or -1 where it has none."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            cell = np.full(b.num_rows, -1, dtype=np.int32)
            groups = defaultdict(list)
            for i, key in enumerate(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True)):
                groups[key].append(i)
            for key, rows in groups.items():
                if key in shared.value:
                    x = _unit(_matrix(b.column("vec").take(pa.array(rows))))
                    for lo in range(0, len(rows), 2048):
                        cell[rows[lo:lo + 2048]] = (x[lo:lo + 2048] @ shared.value[key].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", cell int"
    return classes.mapInArrow(run, schema)


def _blocks(classes: DataFrame, block: int, most_pivots: int) -> DataFrame:
    """Staged rows (block, label, dim, centre, radius, ids, sizes, tree): a cover tree per block."""
    total = classes.count()
    size = max(block, -(-total // most_pivots))
    big = classes.groupBy("label", "dim").count().where(F.col("count") > size)
    picked = classes.where(F.pmod(F.col("hash"), F.lit(size)) == 0).join(big, ["label", "dim"], "left_semi").select("label", "dim", "vec").collect()
    pivots = defaultdict(list)
    for r in picked:
        pivots[r["label"], r["dim"]].append(r["vec"])
    cells = staged(_assign(classes, {k: _unit(sorted(v)) for k, v in pivots.items()}), "cells")
    parts = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = cells.join(parts, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("hash"), F.col("parts")))
    rows = dealt.groupBy("label", "dim", "cell", "part").agg(F.collect_list(F.struct("node", "n", "vec")).alias("rows"))
    kind = classes.schema["node"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                mine = b.column("rows").slice(i, 1).flatten()
                tree = CoverTree(_unit(_matrix(mine.field("vec"))))
                yield pa.RecordBatch.from_arrays(
                    [b.column("label").slice(i, 1), b.column("dim").slice(i, 1), b.column("cell").slice(i, 1), b.column("part").slice(i, 1),
                     pa.array([tree.points[0].tolist()], pa.list_(pa.float64())), pa.array([tree.nodes[0][2]]),
                     pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine.field("node")),
                     pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine.field("n")), pa.array([pickle.dumps(tree, protocol=5)], pa.binary())],
                    names=["label", "dim", "cell", "part", "centre", "radius", "ids", "sizes", "tree"])

    label = classes.schema["label"].dataType.simpleString()
    out = rows.mapInArrow(run, f"label {label}, dim int, cell int, part long, centre array<double>, radius double, ids array<{kind}>, sizes array<long>, tree binary")
    return staged(out.withColumn("block", F.xxhash64("label", "dim", "cell", "part")), "blocks")


def _met(blocks: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per vector of two crews' ``blocks``, one after the other: the vectors it links to, and its component's least place."""
    crews = blocks.column("crew").to_pylist()
    trees = [pickle.loads(t) for t in blocks.column("tree").to_pylist()]
    sizes = blocks.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    base = np.cumsum([0, *(len(t.order) for t in trees)])
    two = blocks.column("ca")[0].as_py() != blocks.column("cb")[0].as_py()
    others, ends = np.zeros(len(sizes)), [np.zeros((2, 0), dtype=np.int64)]
    for i, j in combinations_with_replacement(range(len(trees)), 2):
        if two and crews[i] == crews[j]:
            continue
        u, v = close_pairs(trees[i], trees[j], threshold)
        if i == j:
            u, v = u[u != v], v[u != v]
        if not len(u):
            continue
        ni, nj = len(trees[i].order), len(trees[j].order)
        others[base[i]:base[i + 1]] += np.bincount(u, weights=sizes[base[j] + v], minlength=ni)
        if i == j:
            both = np.arange(ni) + base[i]
        else:
            others[base[j]:base[j + 1]] += np.bincount(v, weights=sizes[base[i] + u], minlength=nj)
            both, v = np.r_[np.arange(ni) + base[i], np.arange(nj) + base[j]], v + ni
        low = roots(len(both), u, v)  # of the links, one per node stays
        moved = np.flatnonzero(low != np.arange(len(both)))
        ends.append(np.stack([both[moved], both[low[moved]]]))
    return others.astype(np.int64), roots(len(sizes), *np.concatenate(ends, axis=1))


def links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most_pivots: int = MOST_PIVOTS, crew: int = CREW) -> DataFrame:
    """Staged rows (node, others, root), for each pair of crews and each node linked in it.

    Blocks of a label form crews of about ``crew``; a task takes two of them, with those blocks
    that some block of the other may reach. ``others`` counts the vectors the node links to there,
    ``root`` is a node of its component within the two crews. A crowd of near copies so gives rows
    in proportion to its members, while every single link is counted and joins its ends.
    """
    blocks = _blocks(classes, block, most_pivots)
    head = blocks.select("block", "label", "dim", "centre", "radius")
    crews = head.groupBy("label", "dim").agg(F.ceil(F.count("*") / crew).alias("crews"))
    head = head.join(crews, ["label", "dim"]).withColumn("crew", F.pmod(F.xxhash64("block"), F.col("crews")))
    x, y = head.alias("x"), head.alias("y")
    dot = F.aggregate(F.zip_with("x.centre", "y.centre", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    reach = F.col("x.radius") + F.col("y.radius") + F.lit(float(np.sqrt(2 - 2 * threshold)) + 1e-6)
    pairs = staged(x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.block") <= F.col("y.block")))
                   .where(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= reach)
                   .select("x.label", "x.dim", F.least("x.crew", "y.crew").alias("ca"), F.greatest("x.crew", "y.crew").alias("cb"),
                           F.array(F.struct("x.block", "x.crew"), F.struct("y.block", "y.crew")).alias("both")), "pairs")
    meet = ["label", "dim", "ca", "cb"]
    needed = pairs.select(*meet, F.explode("both").alias("one")).select(*meet, "one.block", "one.crew").distinct()
    kind = classes.schema["node"].dataType.simpleString()

    def run(blocks: pa.Table) -> pa.Table:
        others, low = _met(blocks, threshold)
        ids = blocks.column("ids").combine_chunks().flatten()
        mine = np.flatnonzero(others)
        return pa.table([ids.take(pa.array(mine)), pa.array(others[mine]), ids.take(pa.array(low[mine]))], names=["node", "others", "root"])

    joined = needed.join(blocks.select("block", "ids", "sizes", "tree"), "block").select(*meet, "crew", "ids", "sizes", "tree")
    return staged(joined.groupBy(*meet).applyInArrow(run, f"node {kind}, others long, root {kind}"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most_pivots: int = MOST_PIVOTS,
                    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per input row.

    Vectors of equal label and length link from a cosine of ``threshold`` on, in double
    precision. Equal vectors of a label are one class with a size, so copies never meet in
    pairs. Null, empty, zero and non-finite vectors, and rows with a null id or label, link
    with nothing and are their own component. Rows that repeat an id count as vectors of their
    own; other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = staged(rows.withColumn("ok", ok).withColumn("hash", F.when(F.col("ok"), F.xxhash64("label", "vec"))), "rows")
    classes = (rows.where("ok").groupBy("label", "vec", "hash").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
               .select("label", F.size("vec").alias("dim"), "vec", "hash", F.struct("least", "hash").alias("node"), "n"))
    classes = staged(classes, "classes")
    found = links(classes.select("label", "dim", "vec", "hash", "node", "n"), threshold, block, most_pivots)
    others = found.groupBy(F.col("node").alias("a")).agg(F.sum("others").alias("others"))
    groups = components(found, "node", "root")
    named = (classes.select("hash", "label", "vec", "node", "n").join(others, classes["node"] == others["a"], "left")
             .join(groups.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
             .select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component.least", "node.least").alias("component_id")))
    named = staged(named, "named")
    least = classes.select("label", "vec", "hash", "node")
    mine = rows.where("ok").join(least, ["label", "vec", "hash"]).join(named, "node").select("vec_id", "n_links", "component_id")
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = mine.unionByName(rest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

