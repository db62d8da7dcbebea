"""The tree-temporal scan: node counts in trailing windows against their share of the frame."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import ratio, window_llr
from ..session import tasks
from .evaluation import running_sums
from .hierarchy import node_counts

#: Replicates of the Monte Carlo null, as in the reference.
REPLICATES = 9999
#: Replicates that a leaf's random stream gives at a time, and leaves of a chunk.
DRAWS, CHUNK = 256, 512


def window_shares(reference: DataFrame, study: int = 12, longest: int = 6) -> DataFrame:
    """(as_of, shares): the shares of the study frame's ``reference`` (q, n_total) that fall into its last
    1, 2, ... quarters. Quarters without a whole frame, or with an empty one, have no row."""
    frame = reference.select("q", "n_total", F.explode(F.sequence(F.lit(0), F.lit(study - 1))).alias("ago")).withColumn("as_of", F.col("q") + F.col("ago"))
    per = frame.groupBy("as_of").agg(F.count("*").alias("k"), F.sum("n_total").alias("frame"), *[F.sum(F.when(F.col("ago") < w, F.col("n_total")).otherwise(0)).alias(f"r{w}") for w in range(1, longest + 1)])
    return per.where((F.col("k") == study) & (F.col("frame") > 0)).select("as_of", F.array(*[ratio(F.col(f"r{w}").cast("double"), F.col("frame")) for w in range(1, longest + 1)]).alias("shares"))


def mention_totals(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """The other reference series: (q, n_total) of all mentions in the quarters of ``reference``, 0 where there
    are none. A quarter in which more is named gets the larger share, so that naming habits cancel."""
    n = counts.groupBy("q").agg(F.sum("n").alias("n_total"))
    return reference.select("q").join(n, "q", "left").fillna(0, ["n_total"])


def scan_cells(counts: DataFrame, reference: DataFrame, nodes: DataFrame, study: int = 12, longest: int = 6) -> DataFrame:
    """(node, level, as_of, window_q, observed, n_study, expected, llr) for all nodes, as-of quarters
    and window lengths. ``reference`` (q, n_total) gives each quarter's share of the frame."""
    shares = window_shares(reference, study, longest).select("as_of", F.posexplode("shares").alias("i", "share"))
    shares = shares.select("as_of", (F.col("i") + 1).alias("window_q"), "share")
    dealt = node_counts(counts, nodes).select("node", "level", "q", "n", F.explode(F.sequence(F.lit(0), F.lit(study - 1))).alias("ago")).withColumn("as_of", F.col("q") + F.col("ago"))
    sums = dealt.groupBy("node", "level", "as_of").agg(F.sum("n").alias("n_study"), *[F.sum(F.when(F.col("ago") < w, F.col("n")).otherwise(0)).alias(f"c{w}") for w in range(1, longest + 1)])
    cells = sums.select("node", "level", "as_of", "n_study", F.posexplode(F.array(*[F.col(f"c{w}") for w in range(1, longest + 1)])).alias("i", "observed"))
    cells = cells.select("node", "level", "as_of", "n_study", (F.col("i") + 1).alias("window_q"), "observed")
    out = cells.join(F.broadcast(shares), ["as_of", "window_q"])  # a few rows a quarter
    return out.withColumn("expected", F.col("n_study") * F.col("share")).withColumn("llr", window_llr(F.col("observed"), F.col("n_study"), F.col("expected"))).drop("share")


def best_windows(cells: DataFrame, least: int = 3) -> DataFrame:
    """Each node's window of the largest llr (the shortest of equals) at each as-of quarter; windows
    under ``least`` cases score 0, and a score of 0 has no window."""
    scored = cells.withColumn("llr", F.when(F.col("observed") < least, 0.0).otherwise(F.col("llr")))
    w = Window.partitionBy("node", "level", "as_of").orderBy(F.desc("llr"), "window_q")
    top = scored.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    none = F.col("llr") <= 0
    return top.withColumns({"window_q": F.when(~none, F.col("window_q")), "obs_exp": F.when(~none, ratio(F.col("observed").cast("double"), F.col("expected")))})


def _llr(c: np.ndarray, n: np.ndarray, share: np.ndarray, least: int) -> np.ndarray:
    """The window statistic for counts c (node, replicate, window) of node totals n; 0 under ``least`` cases."""
    t = n[:, None, None].astype(float)
    e = t * share[None, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(c > 0, c * np.log(c / e), 0.0) + np.where(t > c, (t - c) * np.log((t - c) / (t - e)), 0.0)
    return np.where((c > e) & (e > 1e-9) & (c >= least), v, 0.0)


def leaf_draws(n: int, shares: np.ndarray, seed: int, as_of: int, leaf: str, block: int) -> np.ndarray:
    """(replicate, window): DRAWS random deals of a leaf's n cases over the frame, as sums over the last 1, 2, ...
    quarters. The stream is the leaf's own, so that nothing else changes it."""
    name = int.from_bytes(hashlib.blake2b(leaf.encode(), digest_size=16).digest(), "big")
    p = np.diff(shares, prepend=0.0)
    rng = np.random.default_rng([seed, as_of, name, block])
    return rng.multinomial(n, [*p, max(0.0, 1 - p.sum())], size=DRAWS)[:, :-1].cumsum(axis=1)


def null_maxima(counts: DataFrame, reference: DataFrame, nodes: DataFrame, as_of: int | None = None, study: int = 12, longest: int = 6, least: int = 3, replicates: int = REPLICATES, seed: int = 20260810, chunk: int = CHUNK) -> DataFrame:
    """(as_of, replicate, max_llr) for every as-of quarter (or one): each replicate deals every leaf's total over
    the frame's quarters by their shares, sums nodes over their leaves, and takes the largest llr. The floor of
    ``least`` cases holds for it as for the data.

    Leaves are dealt to chunks by a hash, and every (as_of, chunk, block of replicates) is a row of one job. A
    node whose leaves lie in one chunk is summed and scored there, and only the largest score of a replicate
    leaves the task; a node that spans chunks sends its window sums, which Spark adds up before they are scored.
    Nothing is collected, no task sees all leaves, and a leaf's random stream depends on its name, quarter and
    block alone: partitions and chunks don't change the result.
    """
    shares = window_shares(reference, study, longest)
    shares = shares if as_of is None else shares.where(F.col("as_of") == as_of)
    ago = F.explode(F.sequence(F.lit(0), F.lit(study - 1))).alias("ago")
    totals = counts.select("entity", "n", "q", ago).groupBy(F.col("entity").alias("leaf"), (F.col("q") + F.col("ago")).alias("as_of")).agg(F.sum("n").cast("long").alias("n"))
    totals = totals.where("n > 0").join(F.broadcast(shares), "as_of")  # a row a quarter
    member = nodes.select("node", "leaf").distinct()
    chunks = max(1, -(-member.select("leaf").distinct().count() // chunk))
    placed = member.withColumn("chunk", F.pmod(F.xxhash64("leaf"), F.lit(chunks)).cast("int"))
    spans = placed.groupBy("node").agg((F.min("chunk") < F.max("chunk")).alias("spans"))
    above = placed.join(spans, "node").groupBy("leaf", "chunk").agg(F.collect_list(F.struct("node", "spans")).alias("above"))  # a leaf's nodes: the tree's depth
    blocks = -(-replicates // DRAWS)
    work = totals.join(above, "leaf").groupBy("as_of", "chunk").agg(F.first("shares").alias("shares"), F.collect_list(F.struct("leaf", "n", "above")).alias("leaves"))  # about ``chunk`` leaves
    work = work.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks(counts.sparkSession), "as_of", "chunk", "block")
    sums = [f"c{w}" for w in range(1, longest + 1)]

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                share = np.asarray(r.shares, float)
                at: dict[str, int] = {}
                spanning: list[bool] = []
                for leaf in r.leaves:
                    for x in leaf["above"]:
                        if at.setdefault(x["node"], len(at)) == len(spanning):
                            spanning.append(x["spans"])
                c, n = np.zeros((len(at), DRAWS, longest), np.int64), np.zeros(len(at), np.int64)
                for leaf in r.leaves:
                    mine = [at[x["node"]] for x in leaf["above"]]
                    c[mine] += leaf_draws(leaf["n"], share, seed, r.as_of, leaf["leaf"], r.block)
                    n[mine] += leaf["n"]
                number = r.block * DRAWS + np.arange(min(DRAWS, replicates - r.block * DRAWS))
                own = ~np.array(spanning, bool)
                if own.any():
                    top = _llr(c[own], n[own], share, least).max(axis=(0, 2))[: len(number)]
                    yield pd.DataFrame({"as_of": r.as_of, "replicate": number, "node": None, "max_llr": top} | dict.fromkeys(sums, 0))
                for node, i in at.items():
                    if spanning[i]:
                        yield pd.DataFrame({"as_of": r.as_of, "replicate": number, "node": node, "max_llr": 0.0} | {x: c[i, : len(number), w] for w, x in enumerate(sums)})

    drawn = work.mapInPandas(run, f"as_of int, replicate int, node string, max_llr double, {', '.join(f'{x} long' for x in sums)}")
    whole = drawn.groupBy("as_of", "replicate", "node").agg(F.max("max_llr").alias("max_llr"), *[F.sum(x).alias(x) for x in sums])
    of_node = totals.join(member.join(spans.where("spans"), "node"), "leaf").groupBy(F.col("as_of").alias("_a"), F.col("node").alias("_n")).agg(F.sum("n").alias("n_study"), F.first("shares").alias("shares"))
    scored = whole.join(of_node, (F.col("as_of") == F.col("_a")) & (F.col("node") == F.col("_n")), "left")
    each = [F.when(F.col(x) >= least, window_llr(F.col(x), F.col("n_study"), F.col("n_study") * F.col("shares")[w])).otherwise(0.0) for w, x in enumerate(sums)]
    best = F.when(F.col("n_study").isNull(), F.col("max_llr")).otherwise(F.greatest(*each, F.lit(0.0)))
    return scored.groupBy("as_of", "replicate").agg(F.max(best).alias("max_llr"))


def with_p_values(best: DataFrame, null: DataFrame, replicates: int, salts: int = 1) -> DataFrame:
    """Adds p_value = (1 + # null maxima of the quarter >= llr) / (replicates + 1) and its inverse, the recurrence
    interval; 1 for a score of 0. A quarter's maxima are sorted once a group and searched by halving; its nodes
    are dealt to ``salts`` groups."""
    salt = F.pmod(F.xxhash64("node"), F.lit(salts))
    a = best.withColumn("_salt", salt)
    b = null.select("as_of", "max_llr").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def search(rows: pa.Table, maxima: pa.Table) -> pa.Table:
        m = np.sort(maxima.column("max_llr").to_numpy())
        llr = rows.column("llr").to_numpy(zero_copy_only=False)
        above = len(m) - np.searchsorted(m, llr - 1e-9, "left")  # equal counts, summed in another order, are ties
        return rows.append_column("_above", pa.array(above, pa.int64()))

    schema = T.StructType([*a.schema.fields, T.StructField("_above", T.LongType())])
    out = a.groupBy("as_of", "_salt").cogroup(b.groupBy("as_of", "_salt")).applyInArrow(search, schema)
    p = F.when(F.col("llr") > 0, (1 + F.col("_above")) / F.lit(float(replicates + 1))).otherwise(1.0)
    return out.withColumn("p_value", p).withColumn("recurrence_interval", 1 / F.col("p_value")).drop("_above", "_salt")


def backtest(counts: DataFrame, reference: DataFrame, nodes: DataFrame, study: int = 12, longest: int = 6, least: int = 3, replicates: int = REPLICATES, seed: int = 20260810) -> DataFrame:
    """(node, level, as_of, window_q, observed, n_study, expected, llr, obs_exp, p_value, recurrence_interval) for every
    node at every as-of quarter with a whole frame: what a scan at that quarter would have shown, with the null
    of that quarter. Scores of 0 have interval 1."""
    best = best_windows(scan_cells(counts, reference, nodes, study, longest), least)
    null = null_maxima(counts, reference, nodes, None, study, longest, least, replicates, seed)
    salts = max(1, -(-nodes.select("node").distinct().count() // 50_000))
    return with_p_values(best, null, replicates, salts)


def branch_sweep(best: DataFrame, cells: DataFrame, nodes: DataFrame, least_share: float | None = 0.15, score: str = "llr", branches_only: bool = False, whole_leaves: bool = False) -> DataFrame:
    """(entity, as_of, score, node, excess_share): a node's score is credited to its leaves that have
    cases in its window and at least ``least_share`` of its excess; of several nodes the best score
    counts, then the smaller node, then the lesser name. ``score`` is a column of ``best``, such as llr or,
    after a backtest, recurrence_interval. ``branches_only`` leaves the leaves' own rows out;
    ``whole_leaves`` lets them in without either guard, wholly responsible for themselves."""
    size = nodes.groupBy("node").agg(F.count("*").alias("n_leaves"))
    top = best.where((F.col("llr") > 0) & F.col("window_q").isNotNull()).select("node", "as_of", "window_q", F.col(score).alias("score"), F.col("observed").alias("node_obs"), F.col("expected").alias("node_exp"))
    member = nodes.select("node", F.col("leaf").alias("entity"))
    leaf = cells.where("level = 'substance'").select(F.col("node").alias("entity"), "as_of", "window_q", "observed", "expected")
    rows = top.join(member, "node").join(leaf, ["entity", "as_of", "window_q"]).join(size, "node")
    share = F.when(F.col("node_obs") > F.col("node_exp"), (F.col("observed") - F.col("expected")) / (F.col("node_obs") - F.col("node_exp")))
    rows = rows.where("observed > 0").withColumn("excess_share", share)
    if least_share is not None:
        rows = rows.where(F.col("excess_share") >= least_share)
    if branches_only or whole_leaves:
        rows = rows.join(best.where("level = 'substance'").select("node").distinct(), "node", "left_anti")
    rows = rows.select("entity", "as_of", "score", "node", "n_leaves", "excess_share")
    if whole_leaves:
        own = best.where("level = 'substance' AND llr > 0").select(F.col("node").alias("entity"), "as_of", F.col(score).alias("score"), "node", F.lit(1).cast("long").alias("n_leaves"), F.lit(1.0).alias("excess_share"))
        rows = rows.unionByName(own)
    w = Window.partitionBy("entity", "as_of").orderBy(F.desc("score"), "n_leaves", "node")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("entity", "as_of", "score", "node", "excess_share")


def matched_budget(scan: DataFrame, budget: int) -> tuple[DataFrame, float | None]:
    """(``scan`` with matched_alarm, recurrence interval at the line): the ``budget`` rows of positive score with
    the least p-value, then the highest llr, then the earliest quarter and lesser name, so that two methods are
    compared at the same number of alarms. P-values and equal scores are counted first; no task ranks all rows."""
    hot = scan.where("llr > 0")
    run = F.sum("n").over(Window.orderBy("p_value").rowsBetween(Window.unboundedPreceding, 0))
    by_p = hot.groupBy("p_value").agg(F.count("*").alias("n"))  # at most replicates + 1 values
    line = by_p.withColumn("run", run).where(F.col("run") >= budget).orderBy("p_value").first() if budget else None
    if not budget:
        return scan.withColumn("matched_alarm", F.lit(False)), None
    if line is None:
        last = by_p.agg(F.max("p_value")).first()[0]
        return scan.withColumn("matched_alarm", F.col("llr") > 0), last and 1 / last
    rest = budget - (line.run - line.n)
    at_line = hot.where(F.col("p_value") == line.p_value)
    runs = running_sums(at_line.groupBy("llr").agg(F.count("*").alias("n")), "llr", ["n"], descending=True)
    cut = runs.where(F.col("run_n") >= rest).orderBy(F.desc("llr")).first()
    left = rest - (cut.run_n - cut.n)
    tied = at_line.where(F.col("llr") == cut.llr).orderBy("as_of", "node").limit(left).select("as_of", "node", F.lit(True).alias("_tied"))  # equal to the last digit
    out = scan.join(tied, ["as_of", "node"], "left")
    above = (F.col("llr") > 0) & ((F.col("p_value") < line.p_value) | ((F.col("p_value") == line.p_value) & (F.col("llr") > cut.llr)))
    return out.withColumn("matched_alarm", above | F.coalesce("_tied", F.lit(False))).drop("_tied"), 1 / line.p_value


def head_to_head(scan: DataFrame, cells: DataFrame, eb: DataFrame, counts: DataFrame, nodes: DataFrame, targets: DataFrame, line: float = 100.0, eb_line: float = 1.5) -> DataFrame:
    """When each method first signals each entity of ``targets``: one row each of first_seen, eb05_signal,
    tree_leaf_signal (interval at or over ``line``), tree_leaf_matched_signal (the scan cut to as many alarms as eb05
    raises over all entities), tree_branch_signal with the smallest node that signalled first, the entity's share
    of that node's excess and a verdict on it, the leaf's peak_llr and best_ri, and lags in quarters from first_seen.

    ``scan`` is a backtest, ``cells`` the scan's cells, ``eb`` (entity, as_of, eb05). A branch counts only from
    the quarter the entity was first seen.
    """
    want = targets.select("entity").distinct()
    loud = eb.where(F.col("eb05") >= eb_line)
    scan, _ = matched_budget(scan.where("llr > 0"), loud.count())
    seen = counts.where("n > 0").join(want, "entity", "left_semi").groupBy("entity").agg(F.min("q").alias("first_seen"))
    first_eb = loud.groupBy("entity").agg(F.min("as_of").alias("eb05_signal"))
    when = lambda c: F.min(F.when(c, F.col("as_of")))
    leaf = scan.groupBy(F.col("node").alias("entity")).agg(when(F.col("recurrence_interval") >= line).alias("tree_leaf_signal"), when(F.col("matched_alarm")).alias("tree_leaf_matched_signal"), F.max("llr").alias("peak_llr"), F.max("recurrence_interval").alias("best_ri"))
    size = nodes.groupBy("node").agg(F.count("*").alias("n_leaves"))
    over = nodes.where("level <> 'substance'").select("node", F.col("leaf").alias("entity")).join(want, "entity").join(seen, "entity").join(size, "node")
    fired = scan.where(F.col("recurrence_interval") >= line).join(over, "node").where("as_of >= first_seen")
    top = fired.groupBy("entity").agg(F.min(F.struct("as_of", "n_leaves", "node", "window_q", "observed", "expected")).alias("b")).select("entity", "b.*")
    part = cells.select(F.col("node").alias("entity"), "as_of", "window_q", F.col("observed").alias("own_obs"), F.col("expected").alias("own_exp"))
    top = top.join(part, ["entity", "as_of", "window_q"], "left")
    share = F.when(F.col("observed") > F.col("expected"), F.coalesce(F.col("own_obs") - F.col("own_exp"), F.lit(0.0)) / (F.col("observed") - F.col("expected")))
    branch = top.select("entity", F.col("as_of").alias("tree_branch_signal"), F.col("node").alias("branch_node"), share.alias("branch_excess_share"))
    out = want.join(seen, "entity", "left").join(first_eb, "entity", "left").join(leaf, "entity", "left").join(branch, "entity", "left")
    s = F.col("branch_excess_share")
    verdict = F.when(s >= 0.5, "attributable").when(s >= 0.15, "partly attributable").when(F.col("branch_node").isNotNull(), "not attributable")
    lag = lambda c: (F.col(c) - F.col("first_seen")).alias(c.replace("_signal", "_lag_q"))
    signals = ["eb05_signal", "tree_leaf_signal", "tree_leaf_matched_signal", "tree_branch_signal"]
    return out.select("entity", "first_seen", *signals, "branch_node", "branch_excess_share", verdict.alias("verdict"), "peak_llr", "best_ri", *[lag(c) for c in signals])
