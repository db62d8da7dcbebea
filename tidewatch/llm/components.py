"""Connected components over edge tables, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


#: Edges that a task joins into a forest at once.
BATCH = 1 << 20


def _with_least(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with their key's grouped minimum, by a second join key too that follows from the first: so
    Spark deals both sides anew, and can split the rows of a hot node among tasks."""
    bit = F.col(key).bitwiseAND(F.lit(1)).alias("bit")
    return rows.select("*", bit).join(least.select("*", bit), [key, "bit"]).drop("bit")


def _forests(batch: int):
    """Each run of ``batch`` edges as a forest of stars, a node under the least one of its tree: never more edges
    than nodes, and the same components."""

    def run(batches):
        lo, hi, held = [], [], 0

        def forest():
            nodes, at = np.unique(np.concatenate(lo + hi), return_inverse=True)
            half, par = len(at) // 2, np.arange(len(nodes))
            local_roots(par, at[:half], at[half:])
            under = np.flatnonzero(par != np.arange(len(par)))
            return pd.DataFrame({"lo": nodes[par[under]], "hi": nodes[under]})

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                lo.append(part.lo.to_numpy())
                hi.append(part.hi.to_numpy())
                held += len(part)
                if held >= batch:
                    yield forest()
                    lo, hi, held = [], [], 0
        if held:
            yield forest()

    return run


def contracted(e: DataFrame, batch: int = BATCH) -> tuple[DataFrame, tuple]:
    """The edges (lo, hi) as forests of stars, and their ``_state``: first dealt by the smaller node, then as the files
    of the table before come together in tasks, until a pass takes away less than a quarter. A node of a dense group
    would else keep an edge for each task that its edges were dealt to."""
    kind = dict(e.dtypes)["lo"]
    join = lambda x: durable(x.mapInPandas(_forests(batch), f"lo {kind}, hi {kind}").distinct(), "edges")
    e = join(e.hint("rebalance", F.col("lo")))
    state = _state(e)
    while state[0]:
        less = join(e)
        now = _state(less)
        done = 4 * now[0] > 3 * state[0]
        if now[0] < state[0]:
            e, state = less, now
        if done:
            break
    return e, state


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200, batch: int = BATCH) -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node reachable.

    Partitions first join the edges they have into forests of stars, ``batch`` edges at a time, so that dense groups
    shrink to a few edges a node, and small graphs are done (``contracted``). Edges are dealt by their smaller node, in
    partitions of about equal size, those of a hot node to several. Each round then hangs every node's larger neighbours on
    its smallest neighbour (large star), then its smaller ones (small star), by one plan at every size; a
    forest of stars is left after about log(n) rounds. Every step is a grouped minimum and a join; rounds are
    cut by tables in the shared folder. Nulls and self-loops are dropped; no edges give no rows. It raises if
    ``most_rounds`` are not enough, rather than give unfinished components.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e, state = contracted(e, batch)
    for turn in range(most_rounds + 1):
        if not state[0]:
            break
        if turn == most_rounds:
            raise RuntimeError(f"components are not finished after {most_rounds} rounds")
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = _with_least(large, least, "hi")
        hung = small.select(F.col("m").alias("lo"), "hi").union(small.where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
        e = durable(hung.distinct(), "stars")
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def local_roots(par, i, j):
    """Join the index pairs (i, j) into the forest ``par``, in place: each root is its tree's least index."""
    while len(i):
        a, b = par[i], par[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(par, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = par[par]
            if np.array_equal(up, par):
                break
            par[:] = up
