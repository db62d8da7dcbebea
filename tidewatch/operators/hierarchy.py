"""The entity hierarchy: a DAG of nodes over leaves, as membership rows (node, level, leaf)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ["substance", "family", "category", "superclass", "root"]


def modal_category(pairs: DataFrame) -> DataFrame:
    """(entity, category): each entity's most frequent category, ties to the lesser name."""
    n = pairs.groupBy("entity", "category").agg(F.count("*").alias("n"))
    w = Window.partitionBy("entity").orderBy(F.desc("n"), "category")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("entity", "category")


def build_nodes(categories: DataFrame, families: DataFrame, superclasses: DataFrame, default: str = "Other") -> DataFrame:
    """(node, level, leaf) for the root, superclasses (category, superclass), categories, families
    (family, pattern over leaf names) and the leaves themselves; nodes of equal leaves are merged."""
    leaves = categories.select(F.col("entity").alias("leaf"), "category")
    up = superclasses.select(F.col("category").alias("_c"), "superclass")
    above = leaves.join(F.broadcast(up), F.col("category") == F.col("_c"), "left")  # a fixed map
    fam = F.broadcast(families)  # a fixed list
    rows = (
        leaves.select(F.lit("All").alias("node"), F.lit("root").alias("level"), "leaf")
        .unionByName(above.select(F.coalesce("superclass", F.lit(default)).alias("node"), F.lit("superclass").alias("level"), "leaf"))
        .unionByName(leaves.select(F.col("category").alias("node"), F.lit("category").alias("level"), "leaf"))
        .unionByName(leaves.join(fam, F.rlike("leaf", "pattern")).select(F.col("family").alias("node"), F.lit("family").alias("level"), "leaf"))
        .unionByName(leaves.select(F.col("leaf").alias("node"), F.lit("substance").alias("level"), "leaf"))
    )
    return dedupe_nodes(rows.distinct())


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """Of nodes with the same leaves, the one of the most specific level (then the lesser name)."""
    sets = nodes.groupBy("node", "level").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")), F.lit(99))
    w = Window.partitionBy("leaves").orderBy(rank, "node")
    return sets.withColumn("r", F.row_number().over(w)).where("r = 1").select("node", "level", F.explode("leaves").alias("leaf"))


def node_counts(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level, q, n): leaf counts summed over each node's leaves."""
    m = nodes.select("node", "level", F.col("leaf").alias("_l"))
    return counts.join(m, F.col("entity") == F.col("_l")).groupBy("node", "level", "q").agg(F.sum("n").alias("n"))


def edges(nodes: DataFrame) -> DataFrame:
    """(child, parent): a node hangs from every smallest node that holds all its leaves and more."""
    size = nodes.groupBy("node").agg(F.count("*").alias("k"))
    a = nodes.select(F.col("node").alias("child"), "leaf").join(size.select(F.col("node").alias("child"), F.col("k").alias("kc")), "child")
    b = nodes.select(F.col("node").alias("parent"), "leaf").join(size.select(F.col("node").alias("parent"), F.col("k").alias("kp")), "parent")
    over = a.join(b, "leaf").where("kp > kc").groupBy("child", "parent", "kc", "kp").agg(F.count("*").alias("shared")).where("shared = kc")
    # drop a parent that holds another parent of the same child
    x = over.select("child", "parent")
    y = over.select(F.col("child").alias("c2"), F.col("parent").alias("p2"))
    between = x.join(y, x["parent"] == y["c2"]).select("child", F.col("p2").alias("parent"))
    return x.join(between.distinct(), ["child", "parent"], "left_anti")


def closure(edges_: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, leaf) reachable over (child, parent) edges, however deep: must equal the nodes' own leaves."""
    reach = leaves.select(F.col("leaf").alias("node"), "leaf").distinct()
    seen = 0
    while (n := reach.count()) > seen:  # once a level
        seen = n
        up = reach.join(edges_, reach["node"] == edges_["child"]).select(F.col("parent").alias("node"), "leaf")
        reach = reach.unionByName(up).distinct()
    return reach


def member_checks(categories: DataFrame, members: DataFrame, superclasses: DataFrame) -> DataFrame:
    """(kind, owner, name): listed family members (family, member) that no entity is ("missing"), and
    categories without a superclass ("unmapped"): absence, not error."""
    missing = members.join(categories.select(F.col("entity").alias("member")), "member", "left_anti").select(F.lit("missing").alias("kind"), F.col("family").alias("owner"), F.col("member").alias("name"))
    unmapped = categories.select("category").distinct().join(superclasses.select("category"), "category", "left_anti").select(F.lit("unmapped").alias("kind"), F.lit(None).cast("string").alias("owner"), F.col("category").alias("name"))
    return missing.unionByName(unmapped).distinct()


def select_nodes(nodes: DataFrame, levels: list[str] | None = None, least_leaves: int = 0, strict: bool = False) -> DataFrame:
    """The nodes of some levels with enough leaves. ``strict`` keeps a tree: of nodes that overlap without
    one holding the other, families go (all other levels nest by construction)."""
    out = nodes.where(F.col("level") != "family") if strict else nodes
    out = out.where(F.col("level").isin(levels)) if levels else out
    size = out.groupBy("node", "level").agg(F.count("*").alias("_k")).where(F.col("_k") >= least_leaves).select("node", "level")
    return out.join(size, ["node", "level"], "left_semi")
