"""Connected components by hooking and shortcutting, each round a few joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """id, component: for each end of an edge the smallest id it can reach.

    ``edges`` has two columns of one type; direction, loops and repeats don't
    matter, edges with a null end are left out. Every round each root hooks onto
    the smallest root across its tree's edges, then each id takes its root's
    root; rounds go on until no edge joins two trees, or raise after ``rounds``.
    Edges inside a tree are dropped as they arise, so rounds get cheaper. Minima
    are combined before they are shuffled: a hub costs no more than other ids.
    """
    a, b = edges.columns
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    pairs = stage(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = stage(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct().select("id", F.col("id").alias("root")), "roots")
    live = pairs.where("u < v")
    for _ in range(rounds):
        of = lambda side: labels.select(F.col("id").alias(side), F.col("root").alias(f"r{side}"))
        live = live.join(of("u"), "u").join(of("v"), "v").where("ru != rv")
        live = stage(live.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "live")
        if live.isEmpty():
            return labels.select("id", F.col("root").alias("component"))
        # A larger root hooks onto the smallest one beside it: parents only fall, so there are no cycles.
        # Written first, so that the joins below deal both sides themselves and can split a parent with very many roots.
        parent = stage(live.groupBy("v").agg(F.min("u").alias("parent")).select(F.col("v").alias("root"), "parent"), "hooks")
        while True:
            up = parent.select(F.col("root").alias("parent"), F.col("parent").alias("grand"))
            parent = stage(parent.join(up, "parent", "left").select("root", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "parents")
            if parent.where("moved").isEmpty():
                break
            parent = parent.drop("moved")
        labels = stage(labels.join(parent.drop("moved"), "root", "left").select("id", F.coalesce("parent", "root").alias("root")), "roots")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
