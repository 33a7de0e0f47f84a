"""Boosted regression trees over binned features; missing values take the side that fits better.

Rows become byte codes: up to 255 quantile bins per feature and one code for missing values. They are
packed into blocks, chosen and ordered by a hash of the row key, so neither partitioning nor a retried
task changes a model. Trees grow level by level. Per level each block is reduced to counts and
residual sums per (node, feature, bin). Every labelled row is learned from. Up to ``in_task_rows`` of
them their blocks, some 25 bytes a row, grow all trees inside one task. Beyond that only the sums, whose
size depends on depth and bins alone, meet on the driver once per level, and codes with residuals, some
16 bytes a row, are a cached table of which each tree makes the next. A part that is lost with an executor
is made anew from the last one written. There residuals are multiples of a grain so small that their sums
are exact in any order; so only the smaller child of each split is counted, its sibling is the rest.

A fitted model is a table of nodes. It is scored over arrays of these nodes, a batch of rows at a time,
so a table that was saved and read again gives the same predictions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.functions.numbers import portable_hash
from waypoint.operators.quantiles import order_statistics
from waypoint.session import delete, scratch_path, shared_folder, ship_code

MISSING = 255
CHUNK = 32_768
SUMMARY_ROWS = 1_000_000
#: Trees after which codes and residuals are written, so a lost part needs no more than these; blocks and tasks
#: beyond which there are more tasks, and beyond which their sums meet in the cluster first.
KEPT_TREES, TASK_BLOCKS, DRIVER_TASKS = 20, 32, 64
NODES = "tree int, node int, feature string, threshold double, missing_left boolean, left int, right int, value double, n long"


@dataclass(frozen=True)
class Boosting:
    """Every labelled row is learned from, unless a caller sets ``max_rows``: see ``sampled``.

    Up to ``in_task_rows`` of them grow their trees in one task, without a job per level.
    """

    iterations: int = 300
    step: float = 0.05
    depth: int = 6
    min_rows: int = 20
    max_rows: int | None = None
    block_rows: int = 250_000
    in_task_rows: int = 1_000_000


class Tree:
    """Nodes in heap order: the root is 1, the children of k are 2k and 2k + 1."""

    def __init__(self, depth: int, grain: float = 0.0):
        size = 2 ** (depth + 1)
        self.grain = grain  # leaf values are multiples of it
        self.feature = np.full(size, -1)  # -1: no split
        self.bin = np.zeros(size, np.int64)
        self.missing_left = np.zeros(size, bool)
        self.n = np.zeros(size, np.int64)
        self.total = np.zeros(size)  # residuals

    def step_down(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Nodes one level below; rows at a leaf stay."""
        rows = codes.shape[1]
        start = np.maximum(self.feature, 0) * rows
        place = np.arange(len(self.feature))[:, None]
        left = np.arange(256) <= self.bin[:, None]
        left[:, MISSING] = self.missing_left
        child = np.where(self.feature[:, None] >= 0, 2 * place + 1 - left, place).ravel()
        flat, out = codes.ravel(), np.empty_like(node)
        for k in range(0, rows, CHUNK):  # what a chunk needs stays in the cache
            own = node[k : k + CHUNK]
            code = flat.take(start.take(own) + np.arange(k, k + len(own)))
            out[k : k + CHUNK] = child.take(own * 256 + code)
        return out

    def leaf_values(self, step: float) -> np.ndarray:
        return _grained(step * self.total / np.maximum(self.n, 1), self.grain)


class Block:
    """Some rows of the training set, with their residuals after the trees seen so far."""

    def __init__(self, codes: np.ndarray, target: np.ndarray, base: float):
        self.codes, self.residual = codes, target - base
        self.trees = 0
        self.level, self.node = 0, np.ones(len(target), np.int64)

    def finish(self, tree: Tree, params: Boosting) -> None:
        for _ in range(self.level, params.depth):
            self.node = tree.step_down(self.codes, self.node)
        self.residual -= tree.leaf_values(params.step)[self.node]
        self.trees += 1
        self.level, self.node = 0, np.ones(len(self.residual), np.int64)

    def sums(self, tree: Tree, level: int) -> np.ndarray:
        """Counts and residual sums by (place in the level, feature, code)."""
        if self.level > level:  # a level done once more
            self.level, self.node = 0, np.ones(len(self.residual), np.int64)
        while self.level < level:
            self.node = tree.step_down(self.codes, self.node)
            self.level += 1
        width, features = 2**level, len(self.codes)
        active = self.node >= width
        codes = self.codes if active.all() else self.codes[:, active]
        place = (self.node[active] - width) * 256
        residual = self.residual[active]
        out = np.zeros((2, width, features, 256))
        for f in range(features):
            key = place + codes[f]
            out[0, :, f] = np.bincount(key, minlength=width * 256).reshape(width, 256)
            out[1, :, f] = np.bincount(key, residual, minlength=width * 256).reshape(width, 256)
        return out


def _grained(x: np.ndarray, grain: float) -> np.ndarray:
    return np.rint(x / grain) * grain if grain else x


def split(tree: Tree, level: int, sums: np.ndarray, params: Boosting) -> bool:
    """Give each node of the level its best split, if one gains; says whether any did.

    Candidates are (feature, side of the missing, bin). The gain is that in the sum of squares; of
    equal ones the first counts, and where a node has no missing value of the feature, later ones go to
    the child with more rows.
    """
    width = 2**level
    missing = sums[..., MISSING]
    known = np.cumsum(sums[..., :MISSING], axis=-1)
    left = np.stack([known, known + missing[..., None]], axis=-2)  # 2, node, feature, side, bin
    whole = (known[..., -1] + missing)[..., None, None]
    right = whole - left
    allowed = (left[0] >= params.min_rows) & (right[0] >= params.min_rows)
    gain = left[1] ** 2 / np.maximum(left[0], 1) + right[1] ** 2 / np.maximum(right[0], 1) - whole[1] ** 2 / np.maximum(whole[0], 1)
    gain = np.where(allowed, gain, -np.inf).reshape(width, -1)
    best = gain.argmax(axis=1)
    any_split = False
    for k in range(width):
        node = width + k
        if not gain[k, best[k]] > 1e-9:
            continue
        feature, side, at = np.unravel_index(best[k], left.shape[2:])
        tree.feature[node], tree.bin[node] = feature, at
        n, total = left[:, k, feature, side, at], right[:, k, feature, side, at]
        tree.missing_left[node] = n[0] >= total[0] if missing[0, k, feature] == 0 else side == 1
        for child, (count, residual) in ((2 * node, n), (2 * node + 1, total)):
            tree.n[child], tree.total[child] = round(count), residual
        any_split = True
    return any_split


def grow(sums_of: Callable[[Tree, int], np.ndarray], params: Boosting, grain: float = 0.0) -> Tree:
    tree = Tree(params.depth, grain)
    for level in range(params.depth):
        sums = sums_of(tree, level)
        if not level:
            tree.n[1], tree.total[1] = round(sums[0, 0, 0].sum()), sums[1, 0, 0].sum()
        if not split(tree, level, sums, params):
            break
    return tree


def _node_rows(number: int, tree: Tree, names: Sequence[str], edges: Sequence[np.ndarray], step: float) -> list[tuple]:
    values = tree.leaf_values(step)
    rows = []
    for node in np.flatnonzero(tree.n > 0).tolist():
        f = int(tree.feature[node])
        if f < 0:
            rows.append((number, node, None, None, None, None, None, float(values[node]), int(tree.n[node])))
            continue
        at = int(tree.bin[node])
        threshold = float(edges[f][at]) if at < len(edges[f]) else math.inf
        rows.append((number, node, names[f], threshold, bool(tree.missing_left[node]), 2 * node, 2 * node + 1, None, int(tree.n[node])))
    return rows


# ---- rows to blocks ----------------------------------------------------------------------------


def _packed(names: Sequence[str], edges: Sequence[np.ndarray]):
    """Task side: one row per block, its codes and targets in the order of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), None) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        number = rows["_block"].to_numpy()
        for block in np.unique(number):
            own = rows.filter(pa.array(number == block))
            codes = []
            for name, edge in zip(names, edges, strict=True):
                x = own[name].to_numpy(zero_copy_only=False).astype(float)  # null becomes NaN
                codes.append(np.where(np.isnan(x), MISSING, np.searchsorted(edge, x)).astype(np.uint8))
            target = np.ascontiguousarray(own["_target"].to_numpy(), float)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block], pa.int64()),
                    "rows": pa.array([len(target)], pa.int64()),
                    "total": [float(target.sum())],
                    "most": [float(np.abs(target).max())],
                    "codes": [np.stack(codes).tobytes()],
                    "target": [target.tobytes()],
                }
            )

    return run


def bins(rows: DataFrame, names: Sequence[str], total: int) -> list[np.ndarray]:
    """Upper ends of the bins per feature: distinct quantiles, the last bin open.

    Up to ``SUMMARY_ROWS`` of the ``total`` rows summaries hold every value, so they are exact; of more
    rows the same quantiles are found by bracketed selection, exact as well.
    """
    levels = [k / MISSING for k in range(1, MISSING)]
    known = [F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in names]
    if total <= SUMMARY_ROWS:
        found = rows.select(*known).agg(*[F.percentile_approx(c, levels, SUMMARY_ROWS).alias(c) for c in names]).first()
        return [np.unique(np.array(found[c] or [], float)) for c in names]
    values = order_statistics(rows.select(*known), names, levels)
    return [np.unique(np.array(values[c], float)) for c in names]


def sampled(rows: DataFrame, key: Sequence[str], params: Boosting) -> tuple[DataFrame, int]:
    """Rows with ``_order``, a hash of the key, and their number.

    All rows, unless the caller set ``max_rows``: then those below the hash that leaves about as many.
    """
    named = rows.withColumn("_order", portable_hash(*key))
    total = named.count()
    if params.max_rows is None or total <= params.max_rows:
        return named, total
    limit = int(params.max_rows / total * 2**60)
    kept = named.where(F.col("_order") < limit)
    return kept, kept.count()


# ---- training ----------------------------------------------------------------------------------

def _whole(params: Boosting, base: float, names, edges):
    """Task side, all blocks of a bounded sample: their sums meet where they are, so all trees grow there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            for row in batch.to_pylist():
                target = np.frombuffer(row["target"])
                found[row["block"]] = Block(np.frombuffer(row["codes"], np.uint8).reshape(-1, len(target)), target, base)
        blocks = [found[number] for number in sorted(found)]
        for t in range(1, params.iterations + 1 if blocks else 1):
            tree = grow(lambda tree, level: sum(block.sums(tree, level) for block in blocks), params)
            for block in blocks:
                block.finish(tree, params)
            rows = _node_rows(t, tree, names, edges, params.step)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW, strict=True)], _NAMES)

    return run


_NAMES = [part.split()[0] for part in NODES.split(", ")]
_ARROW = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]


def _smaller(tree: Tree, level: int) -> np.ndarray:
    """Nodes of a level that are counted: the root, or of the children of a split the one with fewer rows."""
    if not level:
        return np.array([1])
    left = 2 * (np.flatnonzero(tree.feature[2 ** (level - 1) : 2**level] >= 0) + 2 ** (level - 1))
    return np.where(tree.n[left] <= tree.n[left + 1], left, left + 1)


def _node_sums(codes: np.ndarray, residual: np.ndarray, tree: Tree, level: int, counted: np.ndarray) -> np.ndarray:
    """Counts and residual sums by (place in ``counted``, feature, code)."""
    out = np.empty((2, len(counted), len(codes), 256))
    if level:
        node = np.ones(len(residual), np.int64)
        for _ in range(level):
            node = tree.step_down(codes, node)
        place = np.full(2 ** (level + 1), -1)
        place[counted] = 256 * np.arange(len(counted))
        place = place.take(node)
        rows = np.flatnonzero(place >= 0)
        place, residual = place.take(rows), residual.take(rows)
    for f, code in enumerate(codes):
        key = place + code.take(rows) if level else code
        out[0, :, f] = np.bincount(key, minlength=len(counted) * 256).reshape(-1, 256)
        out[1, :, f] = np.bincount(key, residual, minlength=len(counted) * 256).reshape(-1, 256)
    return out


def _part_sums(tree: Tree, level: int, counted: np.ndarray):
    """Task side: sums of the blocks of a partition for one level, added up."""

    def run(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        out = None
        for codes, residual in blocks:
            sums = _node_sums(codes, residual, tree, level, counted)
            out = sums if out is None else np.add(out, sums, out=out)
        if out is not None:
            yield out

    return run


def _after(tree: Tree, params: Boosting):
    """Task side: a block with its residuals after one more tree."""
    values = tree.leaf_values(params.step)

    def run(block: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes, residual = block
        node = np.ones(len(residual), np.int64)
        for _ in range(params.depth):
            node = tree.step_down(codes, node)
        return codes, residual - values.take(node)

    return run


def _opened(base: float, grain: float):
    """Task side: codes and first residuals of a written block."""

    def run(block: tuple[int, tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        target = np.frombuffer(block[1][1])
        return np.frombuffer(block[1][0], np.uint8).reshape(-1, len(target)), _grained(target - base, grain)

    return run


def _grain(total: int, most: float) -> float:
    """A power of two whose multiples, that many of at most four times ``most``, add up exactly in a double."""
    return 2.0 ** (math.frexp(4.0 * total * most)[1] - 52)


def _together(blocks: DataFrame, params: Boosting, base: float, features: int) -> list[Tree]:
    """Trees over several blocks: one job per level, whose result is a bounded table of sums per task."""
    spark = blocks.sparkSession
    sc = spark.sparkContext
    shared_folder(spark)
    count, total, most = blocks.agg(F.count("block"), F.sum("rows"), F.max("most")).first()
    grain = _grain(total, most + abs(base))
    parts = min(count, max(sc.defaultParallelism, -(-count // TASK_BLOCKS)))
    dealt = blocks.select("block", "codes", "target").rdd.map(lambda r: (r[0], (bytes(r[1]), bytes(r[2]))))
    one_by_one = BatchedSerializer(CPickleSerializer(), 1)

    def held(state: RDD, written: bool) -> RDD:
        state = state._reserialize(one_by_one).persist(StorageLevel.MEMORY_AND_DISK)
        if written:
            state.checkpoint()
        return state

    state, before = held(dealt.partitionBy(parts, int).map(_opened(base, grain), preservesPartitioning=True), True), None
    trees, files = [], []
    try:
        for t in range(1, params.iterations + 1):
            above = None

            def sums_of(tree: Tree, level: int, state=state) -> np.ndarray:
                nonlocal above
                counted = _smaller(tree, level)
                found = state.mapPartitions(_part_sums(tree, level, counted))
                own = found.treeReduce(np.add) if parts > DRIVER_TASKS else sum(found.collect())
                sums = np.zeros((2, 2**level, features, 256))
                sums[:, counted - 2**level] = own
                if level:
                    sums[:, (counted ^ 1) - 2**level] = above[:, counted // 2 - 2 ** (level - 1)] - own
                above = sums
                return sums

            trees.append(grow(sums_of, params, grain))
            if before is not None:
                before.unpersist()
            if state.isCheckpointed():
                files.append(state.getCheckpointFile())
                for path in files[:-1]:
                    delete(spark, path)
                del files[:-1]
            before, state = state, held(state.map(_after(trees[-1], params), preservesPartitioning=True), t % KEPT_TREES == 0)
    finally:
        for kept in (before, state):
            if kept is not None:
                kept.unpersist()
        for path in files:
            delete(spark, path)
    return trees


@dataclass(frozen=True)
class Trees:
    """A fitted model: its nodes as a table, and the names of its features."""

    nodes: DataFrame
    features: tuple[str, ...]

    def save(self, path: str) -> None:
        listed = F.array(*[F.lit(f) for f in self.features])
        self.nodes.withColumn("features", listed).coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Trees:
        table = spark.read.parquet(path)
        return Trees(table.drop("features"), tuple(table.select("features").first()[0]))

    def score(self) -> Column:
        """Prediction for a row that has the features as columns.

        The nodes come to the tasks as arrays in heap order per tree, whose size depth and iterations
        bound. A null or NaN feature takes the learned side at each of its splits.
        """
        ship_code(self.nodes.sparkSession)
        heaps = _heaps(self.nodes.select("tree", "node", "feature", "threshold", "missing_left", "value").collect(), self.features)

        @F.arrow_udf("double")
        def predicted(*columns: pa.Array) -> pa.Array:
            x = np.array([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])  # null becomes NaN
            return pa.array(_predictions(heaps, x))

        return predicted(*[F.col(f).cast("double") for f in self.features])


def _heaps(nodes: Sequence[tuple], features: Sequence[str]) -> tuple[np.ndarray, ...]:
    """Feature, threshold, side of the missing and value by (tree in order, node), trees made complete.

    What lies below a leaf holds the leaf's value, so every row goes down as many levels.
    """
    place = {t: k for k, t in enumerate(sorted({n[0] for n in nodes}))}
    depth = max((n[1] for n in nodes), default=1).bit_length() - 1
    shape = (len(place), 2 ** (depth + 1))
    feature, threshold = np.full(shape, -1), np.zeros(shape)
    missing_left, value = np.zeros(shape, bool), np.zeros(shape)
    for tree, node, name, at, left, result in nodes:
        k = place[tree]
        if name is None:
            value[k, node] = 0.0 if result is None else result
        else:
            feature[k, node], threshold[k, node], missing_left[k, node] = features.index(name), at, left
    for node in range(1, 2**depth):
        leaf = feature[:, node] < 0
        for child in (2 * node, 2 * node + 1):
            value[leaf, child], feature[leaf, child] = value[leaf, node], -1
    return np.maximum(feature, 0), threshold, missing_left, value


def _predictions(heaps: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Sum over the trees, in their order, for rows given as (feature, row)."""
    feature, threshold, missing_left, value = heaps
    n = x.shape[1]
    out, flat, row = np.zeros(n), x.ravel(), np.arange(n)
    levels = feature.shape[1].bit_length() - 2
    gaps = bool(np.isnan(flat).any())
    for t in range(len(feature)):
        offset, node = feature[t] * n, np.ones(n, np.int64)
        for _ in range(levels):
            at = flat[offset[node] + row]
            left = at <= threshold[t][node]
            if gaps:
                left |= np.isnan(at) & missing_left[t][node]
            node = 2 * node + 1 - left
        out += value[t][node]
    return out


def fit(rows: DataFrame, features: Sequence[str], target: str, key: Sequence[str], params: Boosting = Boosting()) -> Trees:
    """Squared-error boosting of ``target`` on the rows where it is known.

    ``key`` identifies a row; its hash orders rows and deals them to blocks. Tree 0 holds the mean. Rows
    whose keys are equal count each.
    """
    spark = rows.sparkSession
    ship_code(spark)
    needed = rows.where(F.col(target).isNotNull()).select(*key, *[F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(features)], F.col(target).cast("double").alias("_target"))
    names = [f"_x{k}" for k in range(len(features))]
    kept, total = sampled(needed, key, params)
    if not total:
        raise ValueError("no row to learn from")
    edges = bins(kept, names, total)
    count = -(-total // params.block_rows)
    dealt = kept.select(*names, "_target", "_order", F.pmod("_order", F.lit(count)).alias("_block"))
    packed = dealt.repartition(count, "_block").sortWithinPartitions("_block", "_order", "_target", *names).mapInArrow(
        _packed(names, edges), "block long, rows long, total double, most double, codes binary, target binary"
    )
    path = scratch_path(spark, "training-blocks")
    packed.write.parquet(path)
    blocks = spark.read.schema(packed.schema).parquet(path)
    sizes = blocks.select("block", "rows", "total").orderBy("block").collect()
    base = math.fsum(r["total"] for r in sizes) / sum(r["rows"] for r in sizes)
    first = [(0, 1, None, None, None, None, None, base, total)]
    if len(sizes) == 1 or total <= params.in_task_rows:
        grown = blocks.coalesce(1).mapInArrow(_whole(params, base, list(features), edges), NODES)
        nodes = grown.unionByName(spark.createDataFrame(first, NODES))
    else:
        trees = _together(blocks, params, base, len(features))
        nodes = spark.createDataFrame(first + [r for t, tree in enumerate(trees, 1) for r in _node_rows(t, tree, list(features), edges, params.step)], NODES)
    path = scratch_path(spark, "trees")
    nodes.coalesce(1).write.parquet(path)
    return Trees(spark.read.schema(NODES).parquet(path), tuple(features))
