"""Hard negatives by STR-packed R-trees: boxes bound the inner products of what they hold, a best-first queue leaves out the rest."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

#: Unit of the integer components, anchors among the rows, positives of an anchor, negatives of a positive.
SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: A negative scores at least this share (percent) of its positive, and at most all of it.
SHARE = 80
#: Rows of one tree (a 32nd of all between these bounds), rows of a leaf, children of a box, and anchors that visit a tree together.
LEAST_ROWS, MOST_ROWS, LEAF, FANOUT, ANCHOR_BLOCK = 4_096, 65_536, 64, 16, 8_192
#: Anchors searched at once, and how many more boxes each opens per step.
SEARCHED, GROWTH = 256, 4
#: Integers up to here are exact in double precision; beyond, Python's own integers count.
EXACT = 2**53
LONG = 2**63 - 1


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of rows (integers held as doubles): doubles where they suffice, else Python integers."""
    bound = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, left.shape[1])
    if bound < EXACT / 128:  # so that percentages are exact too
        return left @ right.T
    big = np.vectorize(int, otypes=[object])
    return big(left) @ big(right).T if left.shape[1] else np.zeros((len(left), len(right)), object)


class Tree(NamedTuple):
    """Boxes level by level, leaves first: bounds of the components and of the labels, first and last child.

    Children of a leaf are rows of ``vectors``, those of other boxes are boxes. The root is the last box.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaves: int


def _tiles(vectors: np.ndarray, rows: np.ndarray, axes: np.ndarray) -> list[np.ndarray]:
    """Sort-tile-recursive packing: slabs along the first axis, each packed along the next ones, runs of LEAF rows at the end."""
    leaves = -(-len(rows) // LEAF)
    if leaves <= 1 or not len(axes):
        return [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)]
    rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
    slabs = leaves if len(axes) == 1 else int(np.ceil(leaves ** (1 / len(axes)) - 1e-9))
    size = -(-leaves // slabs) * LEAF
    return [tile for i in range(0, len(rows), size) for tile in _tiles(vectors, rows[i : i + size], axes[1:])]


def pack(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
    """An R-tree packed by sort-tile-recursive. Labels with a leaf of rows or more have leaves of their own."""
    order = np.lexsort((ids, labels))
    labels_sorted = labels[order]
    runs = np.split(order, np.nonzero(np.diff(labels_sorted))[0] + 1) if len(order) else []
    rest = [run for run in runs if len(run) < LEAF]
    spread = vectors.std(axis=0) if len(vectors) else np.zeros(0)
    count = min(vectors.shape[1], max(1, int(np.ceil(np.log2(max(2, len(order) / LEAF))))))
    axes = np.argsort(-spread, kind="stable")[:count]
    tiles = [t for run in runs if len(run) >= LEAF for t in _tiles(vectors, run, axes)]
    if rest:
        mixed = np.concatenate(rest)
        tiles += [mixed[i : i + LEAF] for i in range(0, len(mixed), LEAF)]
    rows = np.concatenate(tiles) if tiles else np.empty(0, np.int64)
    ids, labels, vectors = ids[rows], labels[rows], vectors[rows]
    ends = np.cumsum([len(t) for t in tiles]).astype(np.int64)
    begins = ends - [len(t) for t in tiles]
    if not tiles:
        none = np.empty(0, np.int64)
        return Tree(ids, labels, vectors, vectors, vectors, none, none, none, none, 0)
    reach = lambda f, values, at: f.reduceat(values, at, axis=0)
    levels = [(reach(np.minimum, vectors, begins), reach(np.maximum, vectors, begins), reach(np.minimum, labels, begins), reach(np.maximum, labels, begins))]
    first, last, offset = [begins], [ends], 0
    while len(levels[-1][0]) > 1:
        below = len(levels[-1][0])
        at = np.arange(0, below, FANOUT)
        levels.append(tuple(reach(f, v, at) for f, v in zip((np.minimum, np.maximum) * 2, levels[-1], strict=True)))
        first.append(offset + at)
        last.append(offset + np.minimum(at + FANOUT, below))
        offset += below
    boxes = [np.concatenate(parts) for parts in zip(*levels, strict=True)]
    return Tree(ids, labels, vectors, *boxes, np.concatenate(first), np.concatenate(last), len(tiles))


def search(
    tree: Tree, anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, lows: np.ndarray, highs: np.ndarray, same: bool, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor and score window the k best rows: anchor number, window number, row, score; best first, ties to the smaller id.

    ``lows`` and ``highs`` have a row of windows per anchor (inclusive; a low above its high is an empty window).
    ``same`` asks for rows of the anchor's label, otherwise for those of other labels. Each step the queue opens the
    boxes of greatest bound: their children join the queue, or their rows are scored. A box is left
    out if its interval misses every window of the anchor, or its greatest possible score is strictly below the k-th best so far.
    """
    windows, boxes = lows.shape[1], len(tree.first)
    empty = np.empty(0, np.int64)
    if not boxes or not len(anchors):
        return empty, empty, empty, np.empty(0)
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    most = _products(up, tree.high) + _products(down, tree.low)
    least = _products(up, tree.low) + _products(down, tree.high)
    apart = (tree.label_low > anchor_labels[:, None]) | (tree.label_high < anchor_labels[:, None])
    barred = apart if same else (tree.label_low == tree.label_high) & ~apart
    bars = lows.astype(object) if most.dtype == object else lows.copy()
    opened, queued = np.zeros((2, len(anchors), boxes), bool)
    queued[:, -1] = True
    best = [empty, empty, empty, np.empty(0, most.dtype)]
    bite = 1
    while True:
        wanted = np.zeros_like(queued)
        for w in range(windows):
            high, bar = highs[:, w, None], bars[:, w, None]
            wanted |= queued & ~opened & ~barred & (least <= high) & (np.minimum(most, high) >= bar)
        if not wanted.any():
            return tuple(best)
        if bite < boxes:
            rank = np.where(wanted, most.astype(float), -np.inf)
            wanted &= rank >= -np.partition(-rank, bite - 1, axis=1)[:, bite - 1, None]
        opened |= wanted
        bite *= GROWTH
        for box in np.nonzero(wanted[:, tree.leaves :].any(axis=0))[0] + tree.leaves:
            queued[wanted[:, box], tree.first[box] : tree.last[box]] = True
        found: list[list[np.ndarray]] = [[], [], [], []]
        for leaf in np.nonzero(wanted[:, : tree.leaves].any(axis=0))[0]:
            who = np.nonzero(wanted[:, leaf])[0]
            at = slice(tree.first[leaf], tree.last[leaf])
            scores = _products(anchors[who], tree.vectors[at])
            fit = (tree.labels[at] == anchor_labels[who, None]) == same
            fit &= tree.ids[at] != anchor_ids[who, None]
            for w in range(windows):
                i, row = np.nonzero(fit & (scores >= bars[who, w, None]) & (scores <= highs[who, w, None]))
                for held, more in zip(found, (who[i], np.full(len(i), w), row + at.start, scores[i, row]), strict=True):
                    held.append(more)
        if found[0]:
            anchor, window, row, score = (np.concatenate([old, *new]) for old, new in zip(best, found, strict=True))
            if score.dtype == object:
                key = lambda i: (anchor[i], window[i], -score[i], tree.ids[row[i]])
                order = np.array(sorted(range(len(row)), key=key), np.int64)
            else:
                order = np.lexsort((tree.ids[row], -score, window, anchor))
            anchor, window, row, score = anchor[order], window[order], row[order], score[order]
            group = anchor * windows + window
            place = np.arange(len(group)) - np.searchsorted(group, group)
            kept = place < k
            best = [anchor[kept], window[kept], row[kept], score[kept]]
            full = kept & (place == k - 1)
            bars[anchor[full], window[full]] = score[full]


def windows(tops: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The score windows below the positives' scores; rows with fewer than POSITIVES are filled up with empty windows."""
    low = [[*(-(-SHARE * p // 100) for p in row), *[1] * (POSITIVES - len(row))] for row in tops]
    high = [[*row, *[0] * (POSITIVES - len(row))] for row in tops]
    exact = max((abs(p) for row in tops for p in row), default=0) < EXACT
    return tuple(np.array(x, float if exact else object).reshape(len(tops), POSITIVES) for x in (low, high))


def _matrix(frame: pd.DataFrame, dim: int) -> np.ndarray:
    rows = [v if v is not None else wide for v, wide in zip(frame["v"], frame["wide"], strict=True)]
    return np.array(rows, float).reshape(len(rows), dim)


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``dim`` and the whole components of the rows that take part: ``v``, or ``wide`` if one is beyond 32 bits.

    Not those with a null vec_id, label or vector, or a component that is null or not
    finite (times 256). Of rows that share a vec_id one counts, the least by label, then vector.
    """
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x * SCALE).alias("e"),
    )
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "e")).alias("r")).select("vec_id", "r.label", "r.e")
    moved = F.when(F.col("vec_id") % 7 == 0, ((F.col("label").cast("long") + 1) % 10).cast("int")).otherwise(F.col("label"))
    small = F.forall("e", lambda x: F.abs(x) < 2**31 - 1)
    wide = F.transform("e", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    return rows.select(
        "vec_id", moved.alias("label"), F.size("e").alias("dim"),
        F.when(small, F.transform("e", lambda x: F.floor(x).cast("int"))).alias("v"), F.when(~small, wide).alias("wide"),
    )


def _ranged(rows: DataFrame, name: str, size: int) -> DataFrame:
    """``rows`` dealt into ranges of (length, label, first component) of about ``size`` rows, numbered in the column ``name``.

    Rows alike in these are spread by a hash of vec_id, so no label and no group of copies makes a range grow.
    """
    keyed = rows.withColumn("_first", F.coalesce(F.get("v", F.lit(0)), F.lit(0))).withColumn("_hash", F.xxhash64("vec_id"))
    ranged = keyed.repartitionByRange(max(1, -(-rows.count() // size)), "dim", "label", "_first", "_hash")
    return stored(ranged.withColumn(name, F.spark_partition_id()).drop("_first", "_hash"))


FOUND = "anchor_id long, item int, vec_id long, score long"


def visited(forest: DataFrame, anchors: DataFrame, visits: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best rows per anchor and window (``item``) of each tree that a block of anchors visits.

    ``forest``: rows with ``tree``. ``anchors``: rows with ``block`` and ``tops``, the upper ends of their windows (not
    read for ``same``: all scores are one window). ``visits``: pairs of block and tree. A task holds one tree and one block.
    Scores beyond 64 bits are cut to 64.
    """
    fields = ["tree", "block", "vec_id", "label", "dim", "v", "wide"]
    left = anchors.join(visits, "block").select(*(F.col(c).alias(c) for c in [*fields, "tops"]))  # aliases: columns of its own
    right = forest.join(visits, "tree").select(*(F.col(c).alias(c) for c in fields))

    def joined(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for dim in sorted(set(a["dim"]) & set(c["dim"])):
            own, other = a[a["dim"] == dim], c[c["dim"] == dim]
            tree = pack(other["vec_id"].to_numpy(np.int64), other["label"].to_numpy(np.int64), _matrix(other, dim))
            for at in range(0, len(own), SEARCHED):
                some = own.iloc[at : at + SEARCHED]
                ids, labels = some["vec_id"].to_numpy(np.int64), some["label"].to_numpy(np.int64)
                if same:
                    lows, highs = np.full((len(some), 1), -np.inf), np.full((len(some), 1), np.inf)
                else:
                    lows, highs = windows([[int(x) for x in tops] for tops in some["tops"]])
                found = search(tree, _matrix(some, dim), ids, labels, lows, highs, same, k)
                out += [(ids[i], w, tree.ids[r], min(max(int(s), -LONG), LONG)) for i, w, r, s in zip(*found, strict=True)]
        return pd.DataFrame(out, columns=["anchor_id", "item", "vec_id", "score"])

    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInPandas(joined, FOUND)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is a multiple of ``anchor_every``; their positives the
    5 other rows of their label of greatest inner product, ties to the smaller vec_id. Each anchor and positive
    has the first 5 rows of other labels whose score lies between 80 % and all of the positive's.

    Vectors are packed into R-trees of bounded size, sorted by label first. Anchors
    visit the trees that hold their label for positives, and all trees for negatives, in blocks; what each tree
    finds is merged by anchor. The result is exact. Take no part: see ``usable``. Vectors of
    different length are not compared; empty vectors score 0 among themselves. An
    anchor without positives, or a positive without negatives, has no rows. Other columns are not read. An empty table gives none.
    """
    rows = stored(usable(embeddings))
    size = min(MOST_ROWS, max(LEAST_ROWS, -(-rows.count() // 32)))
    forest = _ranged(rows, "tree", size)
    anchors = _ranged(rows.where(F.col("vec_id") % anchor_every == 0), "block", ANCHOR_BLOCK)
    held = forest.select("dim", "label", "tree").distinct()
    labels = anchors.select("dim", "label", "block").distinct().join(held, ["dim", "label"]).select("block", "tree").distinct()
    found = visited(forest, anchors.withColumn("tops", F.array().cast("array<long>")), labels, True, POSITIVES)
    positives = stored(_best(found, ["anchor_id"], POSITIVES).select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    tops = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))
    tops = tops.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_score").alias("tops"))
    everywhere = anchors.select("dim", "block").distinct().join(forest.select("dim", "tree").distinct(), "dim").select("block", "tree").distinct()
    found = visited(forest, anchors.join(tops, "vec_id"), everywhere, False, NEGATIVES)
    found = _best(found, ["anchor_id", "item"], NEGATIVES).select(
        "anchor_id", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), (F.col("item") + 1).alias("_of")
    )
    named = positives.withColumnRenamed("rank", "_of")
    return found.join(named, ["anchor_id", "_of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_query(embeddings: DataFrame) -> DataFrame:
    return hard_negatives(embeddings)


ORACLE = f"""
WITH usable AS (
  SELECT vec_id, min({{'label': label, 'e': embedding::DOUBLE[]}}) AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (r.label + 1) % 10 ELSE r.label END AS label,
    list_transform(r.e, lambda x: floor(x * {SCALE})::HUGEINT) AS v FROM usable
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0)::HUGEINT AS score
  FROM whole a JOIN whole c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % {ANCHOR_EVERY} = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
  s.vec_id AS negative_id, p.positive_score::BIGINT AS positive_score, s.score::BIGINT AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {SHARE} * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= {NEGATIVES}
"""
