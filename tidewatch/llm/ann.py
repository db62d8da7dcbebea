"""Approximate nearest neighbours: NN-descent builds the graph, greedy search answers queries.

The largest inner product becomes a nearest-neighbour problem by one more coordinate,
sqrt(M^2 - |x|^2), which gives all rows one norm and leaves a query's products as they are. The graph
starts from the cells of a few random partitions. In a round of NN-descent, every node is a hub to
which the nodes linked with it send their coded vectors once: pairs of a hub's guests with a new link
are compared there, as one small matrix, and those that would enter an endpoint's list are sent to it.
Links are capped for each node first, so that hubs, guests and answers are bounded; the work of a
round is linear in the rows and falls as fewer links are new.

The finished graph is a table bucketed by node; a node's row also holds its neighbours, coded relative
to it. A round of the search sends each query to its best open candidates and gets back those
neighbours that beat the last of its beam: the graph is never moved, nor are vectors.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, bucketed, durable, fewer, mix64, partitions
from .embed_dedup import usable

#: Nodes of a graph block, and queries of a search block: what one group of a task holds.
HUBS, ASKERS = 256, 64
#: Nodes, or a search's requests for a node, for a task of a small table.
TASK = 1024
LISTS = "ids array<long>, scores array<double>, open array<boolean>"


def _code(rows: np.ndarray) -> np.ndarray:
    """Lifted rows as bytes: the last coordinate, a step width, and the others in whole steps."""
    x = rows[:, :-1]
    step = np.abs(x).max(axis=1) / 127.0
    step[step == 0] = 1.0
    head = np.stack([rows[:, -1], step], axis=1).astype(np.float64)
    return np.hstack([head.view(np.uint8).reshape(len(x), 16), np.rint(x / step[:, None]).astype(np.int8).view(np.uint8)])


def _decode(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last coordinates, step widths, whole steps) of coded rows."""
    head = np.ascontiguousarray(raw[:, :16]).view(np.float64)
    return head[:, 0], head[:, 1], raw[:, 16:].view(np.int8).astype(np.float32)


def _bytes(column) -> np.ndarray:
    """A binary column of equal lengths as rows of bytes."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _blobs(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(row number, value) of all elements of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy(zero_copy_only=False)


def _lists(size: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values, kind))


def _best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, open_: np.ndarray, before: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """Each owner's ``keep`` best distinct ids, ties to the smaller; of one id's entries, the first by ``before`` counts."""
    o = np.lexsort((before, ids, owner))
    o = o[np.concatenate([[True], (owner[o][1:] != owner[o][:-1]) | (ids[o][1:] != ids[o][:-1])])[: len(o)]]
    o = o[np.lexsort((ids[o], -scores[o], owner[o]))]
    rank = np.arange(len(o)) - np.searchsorted(owner[o], owner[o])
    o = o[rank < keep]
    return owner[o], ids[o], scores[o], open_[o]


def _among(owner: np.ndarray, ids: np.ndarray, of: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which of the pairs (owner, id) are among the pairs (of, those)."""
    one, at = np.unique(np.concatenate([ids, those]), return_inverse=True)
    key = np.concatenate([owner, of]) * len(one) + at
    return np.isin(key[: len(ids)], key[len(ids) :])


def _merged(keep: int, width: int):
    """Of a block: the lists of (id, vec, ids, scores, open), after what was found for them. An id met
    before stays as it was, but for a node just visited (``node``): its own product is exact. The ``width``
    best open entries are closed and listed in ``go``, as those to visit next, and added to a search's
    ``seen``: a node that lost its place once its product was exact comes back closed, since its coded product may be
    over the floor again and again, so that nodes would call each other back without end."""

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        id_ = state["id"].to_numpy()
        at = np.argsort(id_)
        row, got = _flat(found["ids"])
        owner = at[np.searchsorted(id_[at], found["id"].to_numpy()[row])] if len(row) else row
        own, old = _flat(state["ids"])
        score = np.concatenate([_flat(state["scores"])[1], _flat(found["scores"])[1]]).astype(float)
        visited = got == found["node"].to_numpy()[row] if "node" in found.column_names else np.zeros(len(got), bool)
        fresh, searching = ~visited, "seen" in state.column_names
        if searching:
            of, seen = (x.astype(np.int64) for x in _flat(state["seen"]))
            fresh &= ~_among(owner, got.astype(np.int64), of, seen)
        flag = np.concatenate([_flat(state["open"])[1].astype(bool), fresh])
        before = np.concatenate([np.ones(len(own), np.int8), np.where(visited, 0, 2).astype(np.int8)])
        owner, ids, score, flag = _best(np.concatenate([own, owner]).astype(np.int64), np.concatenate([old, got]).astype(np.int64), score, flag, before, keep)
        size = np.bincount(owner, minlength=len(id_))
        nth = np.cumsum(flag)
        nth -= np.append(0, nth)[np.searchsorted(owner, owner)]
        go = flag & (nth <= width)
        lists = [_lists(size, ids, pa.int64()), _lists(size, score, pa.float64()), _lists(size, flag & ~go, pa.bool_())]
        lists.append(_lists(np.bincount(owner[go], minlength=len(id_)), ids[go], pa.int64()))
        if searching:
            of, seen = np.concatenate([of, owner[go]]), np.concatenate([seen, ids[go]])
            lists.append(_lists(np.bincount(of, minlength=len(id_)), seen[np.argsort(of, kind="stable")], pa.int64()))
        return pa.table([state["blk"], state["id"], state["vec"], *lists], names=["blk", "id", "vec", "ids", "scores", "open", "go", "seen"][: 3 + len(lists)])

    return run


def _merge(state: DataFrame, found: DataFrame, keep: int, tasks: int, width: int = 0) -> DataFrame:
    seen = ["seen"] * ("seen" in state.columns)
    both = state.select("blk", "id", "vec", "ids", "scores", "open", *seen).groupBy("blk").cogroup(found.groupBy("blk"))
    return fewer(both.applyInArrow(_merged(keep, width), f"blk int, id long, vec binary, {LISTS}, go array<long>" + ", seen array<long>" * len(seen)), tasks)


def _block(id_: str, blocks: int):
    return F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")


def cells(vectors: DataFrame, count: int, leaf: int = 512, trees: int = 4, seed: int = 11) -> DataFrame:
    """(tree, code, part, id, vec): the rows in the cells of ``trees`` partitions by random hyperplanes.

    A cell of over 2 * leaf rows is cut by three further planes through its own mean, again and again;
    only rows that no plane tells apart are parted by a hash.
    """
    bits, tasks = max(0, int(np.log2(max(1, count / leaf)))), -(-trees * count // TASK)
    width = len(vectors.select("vec").first().vec) - 16
    planes = np.random.default_rng(seed).standard_normal((trees, max(1, bits), width + 1))

    def rows_of(pdf):
        last, step, x = _decode(_bytes(pa.array(pdf.vec, pa.binary())))
        return np.hstack([x * step[:, None], last[:, None]])

    sums = vectors.mapInPandas(lambda batches: (pd.DataFrame({"j": np.arange(width + 1), "s": rows_of(p).sum(0)}) for p in batches if len(p)), "j int, s double").groupBy("j").agg(F.sum("s").alias("s")).orderBy("j").toPandas()
    center = sums.s.to_numpy() / count

    def codes(batches):
        for pdf in batches:
            if len(pdf):
                m = rows_of(pdf) - center
                for t in range(trees):
                    code = ((m @ planes[t].T > 0) @ (1 << np.arange(planes.shape[1]))) if bits else np.zeros(len(m), np.int64)
                    yield pd.DataFrame({"tree": t, "code": code.astype(np.int64), "id": pdf.id, "vec": pdf.vec})

    done, coded, before = None, durable(vectors.select("id", "vec").mapInPandas(codes, "tree int, code long, id long, vec binary"), "codes"), None
    for depth in itertools.count():
        sizes = durable(fewer(coded.groupBy("tree", "code").agg(F.count("*").alias("size")), tasks), "sizes")
        hot = sizes.where(F.col("size") > 2 * leaf)
        now = hot.agg(F.count("*").alias("n"), F.max("size").alias("most"), F.sum("size").alias("all")).first()
        cool = coded.join(sizes.where(F.col("size") <= 2 * leaf).drop("size"), ["tree", "code"]).withColumn("part", F.lit(0))
        done = cool if done is None else done.unionByName(cool)
        if not now.n or now == before:
            break
        before = now
        more = np.random.default_rng([seed, depth]).standard_normal((trees, 3, width + 1))

        def project(batches, more=more):
            for pdf in batches:
                if len(pdf):
                    p = np.einsum("ij,ikj->ik", rows_of(pdf), more[pdf.tree.to_numpy()])
                    yield pdf[["tree", "code", "id", "vec"]].assign(p0=p[:, 0], p1=p[:, 1], p2=p[:, 2])

        cut = durable(coded.join(hot, ["tree", "code"]).select("tree", "code", "id", "vec").mapInPandas(project, "tree int, code long, id long, vec binary, p0 double, p1 double, p2 double"), "cut")
        means = cut.groupBy("tree", "code").agg(*[F.avg(f"p{i}").alias(f"m{i}") for i in range(3)])
        side = F.xxhash64("code", *[F.col(f"p{i}") > F.col(f"m{i}") for i in range(3)])
        coded = durable(fewer(cut.join(means, ["tree", "code"]).select("tree", side.alias("code"), "id", "vec"), tasks), "codes")
    if now.n:
        parts = hot.select("tree", "code", F.ceil(F.col("size") / (2 * leaf)).cast("int").alias("parts"))
        rest = coded.join(parts, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")).cast("int")).drop("parts")
        done = done.unionByName(rest)
    return done


def _thinned(n: int):
    """Of a batch of (id, ids, open): the links (m, old, r, id) from id to m, for each m the ``n`` first by (old, r)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, m = _flat(batch["ids"])
            id_, old = batch["id"].to_numpy()[row], ~_flat(batch["open"])[1].astype(bool)
            r = mix64(mix64(m.astype(np.int64).view(np.uint64)) ^ id_.astype(np.int64).view(np.uint64)).view(np.int64)
            o = np.lexsort((r, old, m))
            o = o[np.arange(len(o)) - np.searchsorted(m[o], m[o]) < n]
            yield pa.RecordBatch.from_arrays([pa.array(m[o], pa.int64()), pa.array(old[o]), pa.array(r[o]), pa.array(id_[o], pa.int64())], names=["m", "old", "r", "id"])

    return run


def _guests(state: DataFrame, cap: int, tasks: int) -> DataFrame:
    """(hub, id, open): each link as two visits, each end as the guest of the other; of the links to a node,
    the ``cap`` first by (not open, hash) count. A hub's many are thinned in each batch before they meet."""
    links = state.select("id", "ids", "open").mapInArrow(_thinned(cap), "m long, old boolean, r long, id long")
    kept = fewer(links.groupBy("m").agg(F.slice(F.sort_array(F.collect_list(F.struct("old", "r", "id"))), 1, cap).alias("e")), tasks)
    kept = kept.select("m", F.explode("e").alias("e")).select("m", F.col("e.id").alias("id"), (~F.col("e.old")).alias("open"))
    return kept.select(F.explode(F.array(F.struct(F.col("m").alias("hub"), "id", "open"), F.struct(F.col("id").alias("hub"), F.col("m").alias("id"), "open"))).alias("x")).select("x.*")


def _local_join(per: int, blocks: int):
    """Of a block of hubs with their guests: for each guest, the ``per`` best others at the same hub that
    its list lacks room against, where either link is new."""

    def run(visits: pa.Table) -> pa.Table:
        visits = visits.sort_by([("hub", "ascending"), ("id", "ascending")])
        hub, ids, new = visits["hub"].to_numpy(), visits["id"].to_numpy(), visits["open"].to_numpy()
        floor, (last, step, x) = visits["floor"].to_numpy(), _decode(_bytes(visits["vec"]))
        first = np.concatenate([[True], hub[1:] != hub[:-1]])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(hub)))
        width = int(size.max())
        place = np.where(np.arange(width) < size[:, None], start[:, None] + np.arange(width), -1)
        to, near, score = [], [], []
        for s in range(0, len(place), 64):
            p = place[s : s + 64]
            g = np.maximum(p, 0)
            value = np.matmul(x[g], x[g].transpose(0, 2, 1)).astype(float) * step[g][:, :, None] * step[g][:, None, :] + last[g][:, :, None] * last[g][:, None, :]
            fit = (p >= 0)[:, :, None] & (p >= 0)[:, None, :] & (new[g][:, :, None] | new[g][:, None, :]) & (ids[g][:, :, None] != ids[g][:, None, :])
            value = np.where(fit & (value > floor[g][:, :, None]), value, -np.inf)
            k = min(per, width)
            top = np.argpartition(-value, k - 1, axis=2)[:, :, :k]
            got = np.take_along_axis(value, top, 2)
            a, b, c = np.nonzero(got > -np.inf)
            to.append(ids[g[a, b]])
            near.append(ids[g[a, top[a, b, c]]])
            score.append(got[a, b, c])
        to, near, score = map(np.concatenate, (to, near, score))
        o = np.lexsort((near, to))
        o = o[np.concatenate([[True], (to[o][1:] != to[o][:-1]) | (near[o][1:] != near[o][:-1])])[: len(o)]]
        one, size = np.unique(to[o], return_counts=True)
        return pa.table([pa.array(one, pa.int64()), _lists(size, near[o], pa.int64()), _lists(size, score[o], pa.float64())], names=["id", "ids", "scores"])

    return run


def build_graph(vectors: DataFrame, count: int, degree: int = 20, trees: int = 4, leaf: int = 512, still: float = 0.2, far: int = 1, seeds: int = 32, per: int = 6, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(id, near): for each row its ``degree`` best others, as many rows that have it among theirs, and
    ``far`` random mates of each of its cells. ``vectors`` is (id, vec, asks), vec coded. Lists are
    improved until a round changes at most the share ``still`` of their entries.

    The second table, (id, ids, scores), holds for rows with ``asks`` the best ``seeds`` rows of each of
    their cells by the product without the last coordinate, and the row itself.
    """
    blocks, tasks = max(1, -(-count // HUBS)), -(-count // TASK)
    leaves = cells(vectors.select("id", "vec"), count, leaf, trees, seed).join(vectors.where("asks").select("id", F.lit(True).alias("asks")), "id", "left")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        (last, step, x), ids, tree = _decode(_bytes(pa.array(pdf.vec, pa.binary()))), pdf.id.to_numpy(), int(pdf.tree.iloc[0])
        n = len(ids)
        plain = (x @ x.T).astype(float) * np.outer(step, step)
        k = min(degree, n - 1)
        out = {"id": ids, "near": [ids[:0]] * n, "s": [step[:0]] * n, "far": [ids[:0]] * n}
        if k > 0:
            s = plain + np.outer(last, last)
            np.fill_diagonal(s, -np.inf)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            # mates by a random rotation of the cell's order, which never gives a row itself
            order = np.argsort(ids)
            turn = np.random.default_rng([seed, tree, int(ids[order[0]]) & MASK]).integers(1, n, (n, far))
            mates = np.empty((n, far), np.int64)
            mates[order] = ids[order[(np.arange(n)[:, None] + turn) % n]]
            out |= {"near": list(ids[best]), "s": list(np.take_along_axis(s, best, 1)), "far": list(mates)}
        first: list = [None] * n
        first_s: list = [None] * n
        asks = np.flatnonzero(pdf.asks.notna())
        if len(asks):
            q = plain[asks]
            m = min(seeds, n)
            top = np.argpartition(-q, m - 1, axis=1)[:, :m]
            for i, a, t in zip(range(len(asks)), asks, top, strict=True):
                t = np.union1d(t, [a])
                first[a], first_s[a] = ids[t], q[i, t]
        return pd.DataFrame(out | {"seeds": pd.Series(first, dtype=object), "seed_scores": pd.Series(first_s, dtype=object)})

    met = leaves.groupBy("tree", "code", "part").applyInPandas(meet, "id long, near array<long>, s array<double>, far array<long>, seeds array<long>, seed_scores array<double>")
    found = durable(fewer(met, trees * tasks), "found")

    def top(ids: str, scores: str, n: int):
        """The n best of a row's few lists, as (s, id)."""
        pairs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip(F.col(scores).alias("s"), F.col(ids).alias("id")))))
        return F.slice(F.sort_array(pairs, asc=False), 1, n).alias("top")

    starts = found.where("seeds is not null").groupBy("id").agg(top("seeds", "seed_scores", trees * (seeds + 1))).select("id", F.expr("transform(top, x -> x.id)").alias("ids"), F.expr("transform(top, x -> x.s)").alias("scores"))
    start = found.groupBy("id").agg(top("near", "s", degree))
    state = vectors.select("id", "vec").join(start, "id").select(_block("id", blocks).alias("blk"), "id", "vec", F.expr("transform(top, x -> x.id)").alias("ids"), F.expr("transform(top, x -> x.s)").alias("scores"), F.expr("transform(top, x -> true)").alias("open"))
    state = durable(fewer(state, tasks), "graph")
    while True:
        floor = F.when(F.size("scores") >= degree, F.element_at("scores", -1)).otherwise(float("-inf"))
        visits = fewer(_guests(state, degree, tasks).join(state.select("id", "vec", floor.alias("floor")), "id"), tasks).withColumn("hubs", _block("hub", blocks))
        better = fewer(visits.groupBy("hubs").applyInArrow(_local_join(per, blocks), "id long, ids array<long>, scores array<double>"), tasks)
        state = durable(_merge(state.withColumn("open", F.transform("open", lambda x: F.lit(False))), better.withColumn("blk", _block("id", blocks)), degree, tasks), "graph")
        new = state.agg(F.sum(F.size(F.filter("open", lambda x: x))).alias("new"), F.sum(F.size("ids")).alias("all")).first()
        if (new.new or 0) <= still * (new.all or 0):
            break
    links = _guests(state, degree, tasks).select("hub", "id").union(state.select("id", F.explode("ids").alias("m"))).union(found.select("id", F.explode("far").alias("m")))
    return fewer(links.toDF("id", "m").distinct(), tasks), starts


def _neighbourhoods(links: DataFrame, vectors: DataFrame, count: int) -> DataFrame:
    """(node, vec, near, codes): a row for each node, with its own vector and its neighbours in whole
    steps from it, so that near copies are told apart. ``vectors`` is (id, x), x of float32."""
    blocks, tasks = max(1, -(-count // HUBS)), -(-count // TASK)
    visits = fewer(links.join(vectors.select(F.col("id").alias("m"), "x"), "m"), tasks).select("id", "m", "x").union(vectors.select("id", F.col("id").alias("m"), "x"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("m", "ascending")])
        node, m, x = t["id"].to_numpy(), t["m"].to_numpy(), _bytes(t["x"]).view(np.float32)
        one, at = np.unique(node, return_inverse=True)
        own = np.empty((len(one), x.shape[1]), np.float32)
        own[at[node == m]] = x[node == m]
        near = node != m
        at, m = at[near], m[near]
        rest = x[near] - own[at]
        step = np.abs(rest).max(axis=1) / 127.0
        step[step == 0] = 1.0
        size = np.bincount(at, minlength=len(one))
        rows = np.hstack([step.astype(np.float32)[:, None].view(np.uint8), np.rint(rest / step[:, None]).astype(np.int8).view(np.uint8)])
        cut = np.concatenate([[0], np.cumsum(size)])
        codes = pa.array([rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        return pa.table([pa.array(one, pa.int64()), _blobs(own), _lists(size, m, pa.int64()), codes], names=["node", "vec", "near", "codes"])

    return fewer(visits.withColumn("blk", _block("id", blocks)).groupBy("blk").applyInArrow(pack, "node long, vec binary, near array<long>, codes binary"), tasks)


def _expand(batches):
    """For each (blk, id, q, floor) at a node: the node itself, and those of its neighbours whose product
    is over the floor."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table(batch)
        q, own = _bytes(table["q"]).view(np.float32), _bytes(table["vec"]).view(np.float32)
        row, near = _flat(table["near"])
        raw = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(row), -1)
        step, codes = np.ascontiguousarray(raw[:, :4]).view(np.float32)[:, 0], raw[:, 4:].view(np.int8)
        base = np.einsum("ij,ij->i", q.astype(float), own.astype(float))
        score = np.empty(len(row))
        for s in range(0, len(row), 65536):
            e = s + 65536
            score[s:e] = base[row[s:e]] + np.einsum("ij,ij->i", codes[s:e].astype(np.float32), q[row[s:e]]).astype(float) * step[s:e]
        hit = score > table["floor"].to_numpy()[row]
        node = table["node"].to_numpy()
        row = np.concatenate([np.arange(len(node)), row[hit]])
        o = np.argsort(row, kind="stable")
        size = np.bincount(row, minlength=len(node))
        ids, scores = np.concatenate([node, near[hit]])[o], np.concatenate([base, score[hit]])[o]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(size, ids, pa.int64()), _lists(size, scores, pa.float64())], names=["blk", "id", "node", "ids", "scores"])


def _search(state: DataFrame, links: DataFrame, vectors: DataFrame, count: int, beam: int, width: int, left: float, asking: int) -> DataFrame:
    """The state (blk, id, vec, ids, scores, open, go, seen) after greedy search. A query visits no node
    twice, so that the search ends."""
    n = partitions(state.sparkSession)
    graph = bucketed(_neighbourhoods(links, vectors, count).repartition(n, "node"), "node", n, "graph")
    tasks, most = -(-asking // ASKERS), -(-asking * width // TASK)
    while True:
        # the nodes in go are asked for their neighbours
        floor = F.when(F.size("scores") >= beam, F.element_at("scores", -1)).otherwise(float("-inf"))
        asks = state.select("blk", "id", F.col("vec").alias("q"), floor.alias("floor"), F.explode("go").alias("node"))
        met = fewer(asks.join(graph, "node").select("blk", "id", "node", "q", "floor", "vec", "near", "codes"), most)
        found = met.mapInArrow(_expand, "blk int, id long, node long, ids array<long>, scores array<double>")
        state = durable(_merge(state, found, beam, tasks, width), "search")
        if state.where(F.size("go") > 0).count() <= left * asking:
            return state


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, beam: int = 448, width: int = 96, left: float = 0.001, id_col: str = "vec_id", vec_col: str = "embedding", **graph) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its ``k`` others
    with the largest inner product in double precision, ties to the smaller id.

    Equal vectors are one node of the graph with its k + 1 least ids, which is all that a result can
    hold. Rows that are null, zero or hold null or non-finite components and rows without id take no
    part; a product is defined between rows of one length only, so that each length is searched by
    itself. Fewer than k others give fewer rows; an empty table none; other columns are ignored. The
    search ends when at most the share ``left`` of the queries has one of its ``beam`` candidates to expand.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    lengths = [r.d for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]  # as many as there are widths of vectors
    parts = [_nearest(rows.where(F.size("v") == d), every, k, beam, width, left, graph) for d in lengths]
    if not parts:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _nearest(rows: DataFrame, every: int, k: int, beam: int, width: int, left: float, graph: dict) -> DataFrame:
    nodes = durable(rows.groupBy("v").agg(F.min("id").alias("id")), "nodes")
    count = nodes.count()
    tasks = -(-count // TASK)
    named = durable(fewer(rows.join(nodes.select("v", F.col("id").alias("node")), "v").select("node", "id"), tasks), "named")

    def least(batches):
        for pdf in batches:
            if len(pdf):
                pdf = pdf.drop_duplicates().sort_values(["node", "id"])
                asks = (pdf.id % every == 0).groupby(pdf.node).transform("any")
                yield pdf.assign(asks=asks).groupby("node").head(k + 1)

    few = named.mapInPandas(least, "node long, id long, asks boolean").groupBy("node", F.pmod(F.xxhash64("id"), F.lit(64)).alias("p")).agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("c"), F.max("asks").alias("asks"))
    copies = fewer(few, tasks).groupBy("node").agg(F.slice(F.sort_array(F.flatten(F.collect_list("c"))), 1, k + 1).alias("copies"), F.max("asks").alias("asks"))
    nodes = durable(fewer(nodes.join(copies, nodes["id"] == copies["node"]).select("id", "v", "copies", "asks"), tasks), "nodes")
    norm = F.expr("sqrt(aggregate(v, cast(0 as double), (a, x) -> a + cast(x as double) * x))")
    longest, asking = nodes.agg(F.max(norm), F.count_if("asks")).first()

    def lift(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.v.to_numpy()).astype(float) / longest
                coded = _code(np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x**2).sum(1)))[:, None]]))
                yield pd.DataFrame({"id": pdf.id, "vec": [r.tobytes() for r in coded], "x": [r.tobytes() for r in x.astype(np.float32)], "asks": pdf.asks})

    lifted = durable(nodes.select("id", "v", "asks").mapInPandas(lift, "id long, vec binary, x binary, asks boolean"), "lifted")
    links, starts = build_graph(lifted.select("id", "vec", "asks"), count, **graph)
    blocks = max(1, -(-asking // ASKERS))
    state = lifted.where("asks").join(starts, "id").select(_block("id", blocks).alias("blk"), "id", F.col("x").alias("vec"), "ids", "scores", F.transform("ids", lambda x, i: i >= width).alias("open"), F.slice("ids", 1, width).alias("go"), F.slice("ids", 1, width).alias("seen"))
    state = _search(durable(fewer(state, blocks), "search"), links, lifted.select("id", "x"), count, beam, width, left, asking)
    # the query's own node is a candidate through its copies
    hits = state.select(F.col("id").alias("node"), F.explode(F.array_union(F.slice("ids", 1, 4 * k), F.array("id"))).alias("hit"))

    @F.pandas_udf("double")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        return pd.Series(np.einsum("ij,ij->i", np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)))

    scored = fewer(hits.join(nodes.select(F.col("id").alias("hit"), F.col("v").alias("w"), "copies"), "hit"), tasks).join(nodes.select(F.col("id").alias("node"), "v"), "node")
    scored = fewer(scored, tasks).select("node", product("v", "w").alias("score"), "copies")
    flat = scored.select("node", "score", F.explode("copies").alias("vec_id"))
    best = flat.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("best"))  # at most (4k + 1)(k + 1) a node
    queries = named.where(F.col("id") % every == 0).select("node", F.col("id").alias("query_id")).distinct()
    own = fewer(queries.join(best, "node"), tasks).select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
