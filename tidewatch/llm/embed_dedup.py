"""Embedding near-duplicates: PCA-ordered tiles, leading dimensions first, suffix norms as bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, summed_matrix
from .components import connected_components, local_roots

#: Cells along the first principal component; their boxes are what is sent to tasks, at any input size.
MOST_CELLS = 1024
#: A tile has so many numbers at most; a table that fits in fewer is still cut into LEAST_TILES.
TILE_NUMBERS, LEAST_TILES = 1 << 22, 8
#: Principal components whose ranges a cell's box records.
BOX = 4
BLOCK = 512


def usable(col) -> F.Column:
    """Neither null, empty nor zero, and every component finite."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return col.isNotNull() & (F.size(col) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(col, lambda x: x != 0)


def unit_rows(v) -> np.ndarray:
    x = np.stack(list(v)).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def second_moment(rows: DataFrame, d: int) -> np.ndarray:
    """The d x d sum of outer products of the unit vectors."""

    def square(pdf: pd.DataFrame) -> np.ndarray:
        u = unit_rows(pdf.v)
        return u.T @ u

    return summed_matrix(rows.select("v"), square, d)


def links_between(a: np.ndarray, b: np.ndarray, threshold: float, basis: np.ndarray, same: bool):
    """Yields (i, j) index arrays of all pairs with cosine >= threshold; only i < j if a is b.

    In principal coordinates, the leading half of the dimensions is multiplied first; with the
    product of the suffix norms it bounds the cosine (Cauchy-Schwarz). Pairs still open get a
    further quarter, then the rest: pair by pair if they are few, else (a crowd of near copies) as
    further slices of the matrix product. What comes within rounding of the threshold is decided on
    the unit vectors in double.
    """
    d = a.shape[1]
    cuts = sorted({max(1, d // 2), max(1, 3 * d // 4), d})
    pa, pb = a @ basis, b @ basis
    tail = lambda p, k: np.sqrt(np.maximum((p[:, k:] ** 2).sum(1), 0.0))
    ta, tb = [tail(pa, k) for k in cuts], [tail(pb, k) for k in cuts]
    fa, fb = pa[:, : cuts[0]].astype(np.float32), pb[:, : cuts[0]].astype(np.float32)

    def exact(i, j):
        return np.concatenate([np.einsum("ij,ij->i", a[i[x : x + 65536]], b[j[x : x + 65536]]) for x in range(0, len(i), 65536)]) if len(i) else np.empty(0)

    for s in range(0, len(a), BLOCK):
        e = min(s + BLOCK, len(a))
        lead = fa[s:e] @ fb.T
        i, j = np.nonzero(lead + np.outer(ta[0][s:e], tb[0]).astype(np.float32) >= threshold - 1e-4)
        if len(i) > 0.2 * lead.size:
            done = pa[s:e, : cuts[0]] @ pb[:, : cuts[0]].T
            for n, k in enumerate(cuts[1:], 1):
                done += pa[s:e, cuts[n - 1] : k] @ pb[:, cuts[n - 1] : k].T
                if not (done + np.outer(ta[n][s:e], tb[n]) >= threshold - 1e-9).any():
                    break
            i, j = np.nonzero(done >= threshold - 1e-9)
            close = np.flatnonzero(done[i, j] < threshold + 1e-9)
            i = i + s
            link = np.ones(len(i), bool)
            link[close] = exact(i[close], j[close]) >= threshold
            i, j = i[link], j[link]
        else:
            i = i + s
            for n, k in enumerate(cuts[1:-1], 1):
                open_ = np.zeros(len(i), bool)
                for x in range(0, len(i), 65536):
                    u, v = i[x : x + 65536], j[x : x + 65536]
                    open_[x : x + 65536] = np.einsum("ij,ij->i", pa[u, :k], pb[v, :k]) + ta[n][u] * tb[n][v] >= threshold - 1e-9
                i, j = i[open_], j[open_]
            link = exact(i, j) >= threshold
            i, j = i[link], j[link]
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tile: int | None = None) -> DataFrame:
    """id, n_links, component_id, kept for each row.

    Equal vectors are grouped first and compared once. The distinct ones are cut into cells along the
    first principal component, each cell into tiles of about ``tile`` rows by a hash of the id, so
    that no task holds more than two tiles however crowded a cell is. Without ``tile``, a tile has as
    many rows as TILE_NUMBERS allow, but an eighth of the table at most: a row is then sent to eight
    tiles at most, until the table has more than eight full ones. A row goes to those pairs of
    tiles only whose box in the leading components it can reach: unit vectors with cosine c are
    sqrt(2 - 2c) apart. A task returns sums of links and, for each row, its root in the task's own
    forest: never pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; a cosine
    is defined between vectors of one length only, so that each length is compared by itself. A row
    without id has no links and a null component. Ids are meant to be unique: rows that share one are
    each judged by their own vector. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("v"))
    good = rows.where(usable(F.col("v")) & F.col("_id").isNotNull())
    lengths = [r.d for r in good.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]  # as many as there are widths of vectors
    classes = edges = None
    for d in lengths:
        found, links = _linked(good.where(F.size("v") == d), d, threshold, tile)
        classes = found if classes is None else classes.unionByName(found)
        edges = links if edges is None else edges.unionByName(links)
    ok = usable(F.col("v")) & F.col("_id").isNotNull()
    out = rows.where(~ok).select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component"))
    if lengths:
        classes = classes.join(connected_components(edges), F.col("_class") == F.col("node"), "left").select("_v", "_links", F.coalesce("component", "_class").alias("_component"))
        out = good.join(classes, F.col("v") == F.col("_v")).select("_id", "_links", "_component").unionByName(out)
    return out.select(F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"), F.coalesce(F.col("_id") == F.col("_component"), F.lit(False)).alias("kept"))


def _linked(good: DataFrame, d: int, threshold: float, tile: int | None) -> tuple[DataFrame, DataFrame]:
    """Of vectors of one length, the distinct ones (_v, _class, _links), and links (a, b) that connect what is linked."""
    distinct = durable(good.groupBy("v").agg(F.min("_id").alias("id"), F.count("*").alias("n")), "vectors")
    count = distinct.count()
    tile = tile or max(1, min(TILE_NUMBERS // d, -(-count // LEAST_TILES)))
    _, basis = np.linalg.eigh(second_moment(distinct, d))
    basis = np.ascontiguousarray(basis[:, ::-1])
    box = min(BOX, d)

    @F.pandas_udf("array<double>")
    def leading(v: pd.Series) -> pd.Series:
        return pd.Series(list(unit_rows(v) @ basis[:, :box]) if len(v) else [], dtype=object)

    placed = distinct.withColumn("p", leading("v"))
    wanted = int(min(MOST_CELLS, max(1, -(-count // tile))))
    cuts = placed.select(F.col("p")[0].alias("x")).approxQuantile("x", [i / wanted for i in range(1, wanted)], 0.25 / wanted) if wanted > 1 else []
    cuts = np.array(sorted(set(cuts)))

    @F.pandas_udf("int")
    def cell_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), side="right"), dtype="int32")

    placed = durable(placed.withColumn("cell", cell_of(F.col("p")[0])), "placed")
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("p")[k]).alias(f"{name}{k}") for k in range(box) for name, f in (("lo", F.min), ("hi", F.max))]).orderBy("cell").toPandas()  # at most MOST_CELLS rows
    cells = boxes.cell.to_numpy()
    low, high = boxes[[f"lo{k}" for k in range(box)]].to_numpy(), boxes[[f"hi{k}" for k in range(box)]].to_numpy()
    tiles = np.maximum(1, -(-boxes.n.to_numpy() // tile))
    first = np.concatenate([[0], np.cumsum(tiles)])
    all_tiles = int(first[-1])
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7

    def deal(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            p = np.stack(pdf.p.to_numpy())
            at = np.searchsorted(cells, pdf.cell.to_numpy())
            own = first[at] + pd.util.hash_array(pdf.id.to_numpy()) % tiles[at].astype(np.uint64)
            own = own.astype(np.int64)
            blob = [np.asarray(v, np.float64).tobytes() for v in pdf.v]
            for c in range(len(cells)):
                gap = np.maximum(0, np.maximum(low[c] - p, p - high[c]))
                near = np.flatnonzero((gap**2).sum(1) <= reach**2)
                if not len(near):
                    continue
                for t in range(first[c], first[c + 1]):
                    lo, hi = np.minimum(own[near], t), np.maximum(own[near], t)
                    yield pd.DataFrame({"pair": lo * all_tiles + hi, "left": own[near] == lo, "id": pdf.id.to_numpy()[near], "n": pdf.n.to_numpy()[near], "v": [blob[x] for x in near]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = int(pdf.pair.iloc[0])
        same = pair // all_tiles == pair % all_tiles
        pdf = pdf.sort_values("id")
        ids, n, left = pdf.id.to_numpy(), pdf.n.to_numpy(), pdf.left.to_numpy()
        u = unit_rows(np.frombuffer(b, np.float64) for b in pdf.v)
        par, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        ia, ib = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        if len(ia) and len(ib):
            for i, j in links_between(u[ia], u[ib], threshold, basis, same):
                i, j = ia[i], ib[j]
                links += np.bincount(i, weights=n[j], minlength=len(ids)).astype(np.int64)
                links += np.bincount(j, weights=n[i], minlength=len(ids)).astype(np.int64)
                local_roots(par, i, j)
        hit = links > 0
        return pd.DataFrame({"id": ids[hit], "links": links[hit], "root": ids[par[hit]]})

    dealt = placed.select("id", "n", "v", "p", "cell").mapInPandas(deal, "pair long, left boolean, id long, n long, v binary")
    found = durable(dealt.groupBy("pair").applyInPandas(compare, "id long, links long, root long"), "links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = distinct.join(sums, "id", "left").select(F.col("v").alias("_v"), F.col("id").alias("_class"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"))
    return classes, found.select(F.col("id").alias("a"), F.col("root").alias("b"))
