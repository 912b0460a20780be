"""Random forests over many rows: ``RandomForestClassifier``'s trees, grown from binned cells.

``RandomForestClassifier`` passes over all rows for every group of nodes that fits its
memory; trees without a depth limit take hundreds of such passes.  Here a tree is one
task, which reads the cells of ``boosting`` (rows with equal bins and label are one cell
with a count) and grows the tree to its end:

* the bootstrap's Poisson draws of rows of one cell add up to one draw of the cell's count;
* a level counts, for every open node, the classes by bin of the slots drawn for that node
  (at most ``ENTRIES`` nodes × slots at a time), and splits by Gini impurity;
* rows in pure or too small nodes are left aside.

A task holds all cells, so beyond ``CELLS`` of them Spark's forest is fitted instead.  The
trees are stored in the format of ``RandomForestClassificationModel`` and loaded as one.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel

from caseflow.operators import boosting
from caseflow.session import scratch_path

CELLS = 4_000_000
ENTRIES = 4_000_000
PURE = 2.0 ** -52  # an impurity of less is none, as in Spark's trees


def _subsets(rng, k, width, share):
    """``share`` different slots for each of ``k`` nodes, in order."""
    pool = np.tile(np.arange(width, dtype=np.int32), (k, 1))
    at = np.arange(k)
    for j in range(share):
        other = rng.integers(j, width, k)
        pool[at, other], pool[:, j] = pool[:, j].copy(), pool[at, other]
    return np.sort(pool[:, :share], axis=1)


def _splits(runs, slot_of, off, sizes, zero, cells, node, w, w1, tot, subset, least):
    """Best split of each node in the slots of its subset: gain (0: none), slot, bin of the cut, and the left counts."""
    k, width = len(tot), len(off)
    size = sizes[subset].ravel()
    start = np.cumsum(size) - size
    place = np.full((k, width), -1, np.int64)
    np.put_along_axis(place, subset, (start.reshape(subset.shape) - off[subset]), axis=1)  # + flat bin = place in the histogram
    drawn = np.zeros((k, width), bool)
    np.put_along_axis(drawn, subset, True, axis=1)
    place, drawn, row = place.ravel(), drawn.ravel(), node * width
    h = np.zeros((2, int(size.sum())))
    for run in runs:
        inside = np.searchsorted(cells, len(run))
        flat = run[cells[:inside]]
        at = row[:inside] + slot_of[flat]
        hit = np.flatnonzero(drawn[at])
        key = place[at[hit]] + flat[hit]
        h[0] += np.bincount(key, w[hit], h.shape[1])
        h[1] += np.bincount(key, w1[hit], h.shape[1])
    owner = np.repeat(np.arange(k), subset.shape[1])
    h[:, start + zero[subset.ravel()]] += tot.T[:, owner] - np.add.reduceat(h, start, axis=1)
    c = np.cumsum(h, axis=1)
    left = c - np.repeat(c[:, start] - h[:, start], size, axis=1)
    of = np.repeat(owner, size)
    n, one = tot[of, 0], tot[of, 1]
    nl, l1 = left
    nr, r1 = n - nl, one - l1
    ok = (nl >= least) & (nr >= least)
    ok[start + size - 1] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, ((l1 * l1 + (nl - l1) ** 2) / nl + (r1 * r1 + (nr - r1) ** 2) / nr - (one * one + (n - one) ** 2) / n) / n, 0.0)
    most = np.maximum.reduceat(gain, start[::subset.shape[1]])
    first = np.flatnonzero(gain == most[of])[::-1]
    best = np.zeros(k, np.int64)
    best[of[first]] = first
    segment = np.searchsorted(start, best, "right") - 1
    return most, subset.ravel()[segment], best - start[segment], left[:, best].T


def _tree(b, p, t):
    """Nodes of tree ``t`` level by level: counts of rows and of class 1, slot (−1: leaf), bin of the cut, left child, gain."""
    off, zero, sizes, share, least = p["off"], p["zero"], p["sizes"], p["share"], p["least"]
    slot_of, width = np.repeat(np.arange(len(off)), sizes), len(off)
    rng = np.random.default_rng([p["seed"], t])
    n = np.empty(len(b["n"]), np.int64)
    n[b["order"]] = b["n"]  # drawn in the order of the cells' codes
    w = rng.poisson(n * p["rate"])[b["order"]].astype(float)
    runs = boosting._runs(b)
    cells = np.flatnonzero(w > 0)
    w = w[cells]
    w1 = w * (b["y"][cells] > 0)
    node = np.zeros(len(cells), np.int64)
    tot = np.array([[w.sum(), w1.sum()]])
    out, begun, chunk = [], 0, max(1, ENTRIES // width)
    for level in range(p["depth"] + 1):
        k = len(tot)
        slot, cut, gain = np.full(k, -1), np.zeros(k, np.int64), np.zeros(k)
        left = np.zeros((k, 2))
        share1 = tot[:, 1] / np.maximum(tot[:, 0], 1.0)
        open_ = np.flatnonzero((tot[:, 0] >= 2 * least) & (2 * share1 * (1 - share1) >= PURE)) if level < p["depth"] else []
        nth = np.full(k, -1)
        nth[open_] = np.arange(len(open_))
        keep = np.flatnonzero(nth[node] >= 0)
        cells, node, w, w1 = cells[keep], nth[node[keep]], w[keep], w1[keep]
        for a in range(0, len(open_), chunk):
            ids = open_[a:a + chunk]
            mine = np.flatnonzero((node >= a) & (node < a + len(ids))) if len(open_) > chunk else slice(None)
            g, s, c, lft = _splits(runs, slot_of, off, sizes, zero, cells[mine], node[mine] - a, w[mine], w1[mine], tot[ids],
                                   _subsets(rng, len(ids), width, share), least)
            good = g > 1e-15
            slot[ids], cut[ids], gain[ids], left[ids] = np.where(good, s, -1), c, g, lft
        inner = np.flatnonzero(slot >= 0)
        child = np.full(k, -1)
        child[inner] = begun + k + 2 * np.arange(len(inner))
        out.append((tot, slot, cut, child, np.where(slot >= 0, gain, 0.0)))
        if not len(inner):
            break
        # each cell of a split node goes to the child of its bin
        at = np.asarray(open_)[node]
        keep = np.flatnonzero(slot[at] >= 0)
        cells, w, w1, at = cells[keep], w[keep], w1[keep], at[keep]
        s, to = slot[at], cut[at]
        go, lo, wide = zero[s] <= to, off[s], sizes[s]
        for run in runs:
            inside = np.searchsorted(cells, len(run))
            bin_ = run[cells[:inside]] - lo[:inside]
            go[:inside] = np.where((bin_ >= 0) & (bin_ < wide[:inside]), bin_ <= to[:inside], go[:inside])
        node = child[at] - begun - k + ~go
        kids = np.empty((2 * len(inner), 2))
        kids[::2], kids[1::2] = left[inner], tot[inner] - left[inner]
        tot, begun = kids, begun + k
    return _pruned(*(np.concatenate(x) for x in zip(*out)))


def _pruned(tot, slot, cut, child, gain):
    """Two leaves with one prediction become one, as in Spark's trees, from the last nodes to the first."""
    leaf, vote = slot < 0, 2 * tot[:, 1] > tot[:, 0]
    gone = np.zeros(len(slot), bool)
    inner = np.flatnonzero(~leaf)
    while len(inner):  # a pass for each level at most
        a = child[inner]
        one = leaf[a] & leaf[a + 1] & (vote[a] == vote[a + 1])
        gone[a[one]] = gone[a[one] + 1] = leaf[inner[one]] = True
        inner = inner[~one]
        if not one.any():
            break
    stay = np.flatnonzero(~gone)
    child = np.where(leaf, -1, (np.cumsum(~gone) - 1)[child])[stay]
    return tot[stay], np.where(leaf, -1, slot)[stay], cut[stay], child, np.where(leaf, 0.0, gain)[stay]


def fit(spark, binned: boosting.Binned, est) -> RandomForestClassificationModel:
    """Fit the estimator's forest to the cells, a task per tree."""
    off, zero, _ = boosting._layout(binned.points)
    sizes = np.array([len(p) + 1 for p in binned.points])
    p = {"off": off, "zero": zero, "sizes": sizes, "depth": est.getMaxDepth(), "least": max(est.getMinInstancesPerNode(), 1),
         "share": boosting._subset_size(est.getFeatureSubsetStrategy(), len(off)), "seed": est.getSeed(), "rate": est.getSubsamplingRate()}
    trees, points = est.getNumTrees(), binned.points
    block = boosting._packed(spark, binned, False, 1).coalesce(1).rdd.map(lambda r: r[0])
    grown = spark.sparkContext.parallelize(range(trees), trees).cartesian(block) \
        .map(lambda x: (x[0], pickle.dumps(_tree(pickle.loads(x[1]), p, x[0]))))
    blank = boosting._blank(spark, est, RandomForestClassificationModel)
    to = scratch_path(spark, "forest")
    schema = blank.nodes

    def nodes(batches):
        for batch in batches:
            for t, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tot, slot, cut, child, gain = pickle.loads(raw)
                one = tot[:, 1] / np.maximum(tot[:, 0], 1.0)
                at = np.array([len(x) for x in points]).cumsum() - [len(x) for x in points]
                inner = slot >= 0
                threshold = np.concatenate([*points, [0.0]])[np.where(inner, at[slot] + cut, 0)]
                ends = np.concatenate([[0], np.cumsum(inner)]).astype(np.int32)
                split = pa.StructArray.from_arrays(
                    [pa.array(slot, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(threshold[inner])),
                     pa.array(np.full(len(slot), -1), pa.int32())], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
                counts = np.stack([tot[:, 0] - tot[:, 1], tot[:, 1]], axis=1)
                fields = {"id": pa.array(np.arange(len(slot)), pa.int32()), "prediction": pa.array((counts[:, 1] > counts[:, 0]).astype(float)),
                          "impurity": pa.array(2 * one * (1 - one)),
                          "impurityStats": pa.ListArray.from_arrays(pa.array(np.arange(len(slot) + 1, dtype=np.int32) * 2), pa.array(counts.ravel())),
                          "rawCount": pa.array(tot[:, 0].astype(np.int64)), "gain": pa.array(np.where(inner, gain, -1.0)),
                          "leftChild": pa.array(child, pa.int32()), "rightChild": pa.array(np.where(inner, child + 1, -1), pa.int32()), "split": split}
                order = [f.name for f in schema["nodeData"].dataType]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), t), pa.int32()), pa.StructArray.from_arrays([fields[f] for f in order], order)], ["treeID", "nodeData"])

    spark.createDataFrame(grown, "tree int, nodes binary").mapInArrow(nodes, schema).write.parquet(f"{to}/data")
    return blank.load(spark, est, to, [1.0] * trees, len(off))
