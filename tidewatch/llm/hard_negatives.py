"""Hard negatives: bounds along a spanning tree of the anchors, exact scores where a window is in reach."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, numbered

#: Rows of a block and anchors of a tree; a task holds one of each.
BLOCK, TREE = 4096, 1024
#: Components of this size (after scaling) or more leave products of whole vectors in 64 bits no longer.
LARGEST = 1 << 24
#: Leading components whose signs place an anchor beside its like.
SIGNS = 12


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in preorder, each one's parent by place in that order, length of the edge to it) of the least
    spanning tree; the root has parent -1."""
    n = len(x)
    far, near = np.full(n, np.inf), np.full(n, -1)
    open_ = np.ones(n, bool)
    children: list[list[int]] = [[] for _ in range(n)]
    now = 0
    for _ in range(n - 1):
        open_[now] = False
        d = np.sqrt(((x - x[now]) ** 2).sum(axis=1))
        closer = open_ & (d < far)
        far[closer], near[closer] = d[closer], now
        now = int(np.argmin(np.where(open_, far, np.inf)))
        children[near[now]].append(now)
    order, parent, place, stack = [], [], {}, [(0, -1)]
    while stack:
        at, above = stack.pop()
        place[at] = len(order)
        order.append(at)
        parent.append(-1 if above < 0 else place[above])
        stack += [(c, at) for c in reversed(children[at])]
    rows = np.array(order)
    return rows, np.array(parent), np.where(np.array(parent) < 0, 0.0, far[rows])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b on whole numbers, exactly: in double while sums stay under 2**53, else in 64-bit integers."""
    if a.shape[-1] == 0:
        return np.zeros(len(a), np.int64)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    return (a @ b).astype(np.int64) if bound < 2**53 else a.astype(np.int64) @ b.astype(np.int64)


def walk(x: np.ndarray, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray], take: Callable[[int, np.ndarray, np.ndarray], None]) -> int:
    """Visits the anchors in preorder. A row's score at an anchor lies within edge length times the row's norm of
    its score (or its bounds) at the parent. ``wanted`` gets an anchor's bounds and names the rows whose exact
    scores it needs; ``take`` gets these scores. Returns how many scores were worked out."""
    norms = np.sqrt((x**2).sum(axis=1))
    last_child = np.full(len(anchors), -1)
    last_child[parent[1:]] = np.arange(1, len(anchors))  # the last one written is the last child
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scored = 0
    for p, (a, up) in enumerate(zip(anchors, parent.tolist(), strict=True)):
        if up < 0:
            every = products(x, a)
            low = high = every.astype(float)
            rows = wanted(p, low, high)
            take(p, rows, every[rows])
            scored += len(x)
        else:
            low, high = bounds[up]
            reach = edge[p] * norms * (1 + 1e-9) + 1e-3
            low, high = low - reach, high + reach
            rows = wanted(p, low, high)
            if 2 * len(rows) > len(x):  # the whole product costs less, and what follows gets exact bounds
                every = products(x, a)
                low = high = every.astype(float)
                take(p, rows, every[rows])
                scored += len(x)
            else:
                exact = products(x[rows], a)
                low[rows] = high[rows] = exact
                take(p, rows, exact)
                scored += len(rows)
            if last_child[up] == p:
                del bounds[up]
        if last_child[p] >= 0:
            bounds[p] = (low, high)
    return scored


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def kth_highest(values: np.ndarray, k: int) -> float:
    return np.partition(values, -k)[-k] if len(values) >= k else -np.inf


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK, tree: int = TREE) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of
    another label whose score lies between ``low_percent`` and ``high_percent`` of the positive's, by score, ties
    by smaller id: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. A score is the
    inner product of the components' floor(scale * x).

    Anchors are ordered by the signs of their leading components and cut into groups of ``tree``; each group's
    least spanning tree is made once. Every group meets every block of ``block`` rows in a task of its own: scores
    at the root, then bounds from parent to child, and exact scores only for rows that can be among the first or
    can lie in an anchor's windows. Anchors are a part of the rows, so that blocks times groups grow with the
    square of the table, as the contract's searches do; a task returns at most ``positives`` or ``positives`` *
    ``negatives`` rows an anchor, and windows merge them. No table is broadcast and none is collected.

    Rows with a null id, label or vector, with a null or non-finite component, or with one of 2**24 or more after
    scaling (whose products don't fit 64 bits) take no part. Of rows that share an id the one with the least label
    and vector counts. Scores are defined between vectors of one length; empty vectors score 0 among themselves.
    A negative positive score has an empty window. Anchors without positives, and positives without negatives,
    give no rows, as does an empty table; other columns are ignored.
    """
    x = F.transform(F.col(vec_col), lambda v: F.floor(v.cast("double") * scale))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(F.col(vec_col), lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * scale) >= LARGEST))
    rows = vectors.where(usable).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    many = durable(rows.groupBy("id").count().where("count > 1").select("id"), "repeated")
    if not many.isEmpty():
        least = rows.join(many, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("id", "r.label", "r.x", "r.anchor")
        rows = rows.join(many, "id", "left_anti").unionByName(least)
    rows = durable(rows.withColumn("d", F.size("x")).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "rows")
    sizes = durable(rows.groupBy("d").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.ceil(F.count_if("anchor") / tree).cast("int").alias("trees")).where("trees > 0"), "sizes")

    signs = F.aggregate(F.slice("x", 1, SIGNS), F.lit(0), lambda s, v: s * 2 + (v >= 0).cast("int"))
    ordered = numbered(rows.where("anchor").select("d", "id", "label", "x", signs.alias("signs")), [F.col(c) for c in ("d", "signs", "id")], "place", "anchors")
    first = ordered.groupBy("d").agg(F.min("place").alias("first"))
    grouped = ordered.join(first, "d").withColumn("tree", ((F.col("place") - F.col("first")) / tree).cast("int"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        at, parent, edge = spanning_tree(np.stack(pdf["x"].to_numpy()).astype(float))
        out = pdf.iloc[at][["d", "tree", "id", "label", "x"]].reset_index(drop=True)
        return out.assign(node=np.arange(len(out)), parent=parent, edge=edge)

    kind = dict(rows.dtypes)
    trees = durable(grouped.groupBy("d", "tree").applyInPandas(grow, f"d int, tree int, id {kind['id']}, label {kind['label']}, x array<bigint>, node int, parent int, edge double"), "trees")

    dealt = rows.join(sizes, "d").select("d", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), F.expr("cast(pmod(deal, blocks) as int)").alias("block"), "id", "label", "x")

    def met(anchors: DataFrame, cell, schema: str) -> DataFrame:
        sent = anchors.join(sizes.select("d", "blocks"), "d").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        key = ["d", "tree", "block"]
        return sent.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(cell, schema)

    def opened(anchors: pd.DataFrame, own: pd.DataFrame):
        anchors = anchors.sort_values("node")
        stack = lambda c: np.stack(c.to_numpy()).astype(float)
        return anchors, stack(anchors["x"]), stack(own["x"]), own["id"].to_numpy(), own["label"].to_numpy()

    def find_positives(anchors: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(own):
            anchors, a, x, ids, labels = opened(anchors, own)
            name, label = anchors["id"].to_numpy(), anchors["label"].to_numpy()

            def wanted(p, low, high):
                same = np.flatnonzero((labels == label[p]) & (ids != name[p]))
                return same[high[same] >= kth_highest(low[same], positives)]

            def take(p, at, scores):
                top = best(scores, ids[at], positives)
                out.append(pd.DataFrame({"anchor_id": name[p], "positive_id": ids[at][top], "positive_score": scores[top]}))

            walk(x, a, anchors["parent"].to_numpy(), anchors["edge"].to_numpy(), wanted, take)
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []})

    place = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    found = met(trees, find_positives, f"anchor_id {kind['id']}, positive_id {kind['id']}, positive_score long")
    found = durable(found.withColumn("n", F.row_number().over(place)).where(F.col("n") <= positives), "positives")
    windows = found.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("p"))  # at most ``positives`` each
    with_windows = trees.join(windows, "id", "left").withColumn("ps", F.col("p.positive_id")).withColumn("scores", F.col("p.positive_score")).drop("p")

    def find_negatives(anchors: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(own):
            anchors, a, x, ids, labels = opened(anchors, own)
            name, label = anchors["id"].to_numpy(), anchors["label"].to_numpy()
            ps, scores_of = anchors["ps"].to_list(), anchors["scores"].to_list()
            limits = [[(-(-low_percent * int(s) // 100), high_percent * int(s) // 100) for s in (() if v is None else v)] for v in scores_of]

            def wanted(p, low, high):
                need = np.zeros(len(ids), bool)
                other = labels != label[p]
                for least, most in set(limits[p]):
                    reach = other & (high >= least) & (low <= most)
                    sure = reach & (low >= least) & (high <= most)
                    need |= reach & (high >= kth_highest(low[sure], negatives))
                return np.flatnonzero(need)

            def take(p, at, scores):
                for j, (least, most) in enumerate(limits[p]):
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    top = inside[best(scores[inside], ids[at[inside]], negatives)]
                    if len(top):
                        out.append(pd.DataFrame({"anchor_id": name[p], "positive_id": ps[p][j], "positive_score": scores_of[p][j], "negative_id": ids[at[top]], "negative_score": scores[top]}))

            walk(x, a, anchors["parent"].to_numpy(), anchors["edge"].to_numpy(), wanted, take)
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": [], "negative_id": [], "negative_score": []})

    near = met(with_windows, find_negatives, f"anchor_id {kind['id']}, positive_id {kind['id']}, positive_score long, negative_id {kind['id']}, negative_score long")
    within = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return near.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
