"""Nearest neighbours, the graph of shared neighbours, and its communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Cells of a block that is compared with another block at a time.
BLOCK = 2048
#: Neighbours that share less than this of theirs aren't joined.
LEAST_SHARED = 1 / 15
MOST_ROUNDS, MOST_LEVELS = 8, 5


def nearest(points: DataFrame, k: int = 30, block: int = BLOCK) -> DataFrame:
    """cell, near, rank, distance (squared): each cell's k nearest others (ties by name) by its vector pc.

    Exact: blocks of cells are compared with all blocks, and the nearest of every block are ranked. The work grows with
    the square of the cells; a task holds two blocks.
    """
    n = points.count()
    blocks = max(1, -(-n // block))
    placed = checkpointed(points.select("cell", vector_to_array("pc").alias("pc"), F.pmod(F.xxhash64("cell"), F.lit(blocks)).cast("int").alias("b")))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    asked = placed.select("cell", "pc", F.col("b").alias("q"), F.explode(every).alias("t"))
    known = placed.select("cell", "pc", F.col("b").alias("t"), F.explode(every).alias("q"))

    def run(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or others.empty:
            return pd.DataFrame({"cell": [], "near": [], "distance": []})
        others = others.sort_values("cell")
        x, y, names = np.stack(mine["pc"]), np.stack(others["pc"]), others["cell"].to_numpy()
        d = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)
        d[mine["cell"].to_numpy()[:, None] == names[None]] = np.inf
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        rows = pd.DataFrame({"cell": np.repeat(mine["cell"].to_numpy(), at.shape[1]), "near": names[at.ravel()], "distance": np.take_along_axis(d, at, 1).ravel()})
        return rows[np.isfinite(rows["distance"])]

    found = asked.groupBy("q", "t").cogroup(known.groupBy("q", "t")).applyInPandas(run, "cell string, near string, distance double")
    first = F.row_number().over(Window.partitionBy("cell").orderBy("distance", "near"))
    return found.withColumn("rank", first).filter(F.col("rank") <= k)


def shared_neighbours(near: DataFrame, least: float = LEAST_SHARED) -> DataFrame:
    """a, b, weight in both directions: of neighbours, the share of their neighbourhoods (themselves included) that is common."""
    lists = checkpointed(near.groupBy("cell").agg(F.collect_set("near").alias("n")).select("cell", F.array_union("n", F.array("cell")).alias("n")))
    pairs = near.select(F.least("cell", "near").alias("a"), F.greatest("cell", "near").alias("b")).distinct()
    both = pairs.join(lists.select(F.col("cell").alias("a"), F.col("n").alias("na")), "a").join(lists.select(F.col("cell").alias("b"), F.col("n").alias("nb")), "b")
    common = F.size(F.array_intersect("na", "nb"))
    weighed = both.select("a", "b", (common / (F.size("na") + F.size("nb") - common)).alias("weight")).filter(F.col("weight") >= least)
    return weighed.union(weighed.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def _moved(edges: DataFrame, nodes: DataFrame, total: float, resolution: float, turn: int) -> DataFrame:
    """nodes (node, degree, home) after one round: of every other node, by a hash, each moves to the community that raises modularity most."""
    homes = nodes.groupBy("home").agg(F.sum("degree").alias("mass"))
    near = edges.filter(F.col("a") != F.col("b")).join(nodes.select(F.col("node").alias("b"), "home"), "b").groupBy("a", "home").agg(F.sum("weight").alias("w"))
    own = nodes.select(F.col("node").alias("a"), "degree", F.col("home").alias("own"))
    # staying is a choice too, also without an edge into the own community
    offers = near.unionByName(own.select("a", F.col("own").alias("home"), F.lit(0.0).alias("w"))).groupBy("a", "home").agg(F.sum("w").alias("w"))
    without = F.col("mass") - F.when(F.col("home") == F.col("own"), F.col("degree")).otherwise(0.0)
    scored = offers.join(own, "a").join(homes, "home").withColumn("gain", F.col("w") - resolution * F.col("degree") * without / total)
    stays = F.max(F.when(F.col("home") == F.col("own"), F.col("gain")))
    best = scored.groupBy("a").agg(F.min_by("home", F.struct(F.round(-F.col("gain"), 9), "home")).alias("to"), F.max("gain").alias("top"), stays.alias("stay"))
    may = (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0) & (F.col("top") > F.col("stay") + 1e-9)
    return nodes.join(best, nodes["node"] == best["a"], "left").select("node", "degree", F.when(may, F.col("to")).otherwise(F.col("home")).alias("home"), (may & (F.col("to") != F.col("home"))).alias("moved"))


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = MOST_ROUNDS, levels: int = MOST_LEVELS) -> DataFrame:
    """node, community (the name of one of its nodes): by local moves that raise modularity, then the same on the graph of communities, until nothing moves.

    edges: a, b, weight in both directions. Only a count and the total weight come to the driver.
    """
    edges = checkpointed(edges.select("a", "b", F.col("weight").cast("double").alias("weight")))
    total = edges.agg(F.sum("weight")).first()[0] or 1.0
    place = edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("community"))
    for _ in range(levels):
        nodes = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree")).select("node", "degree", F.col("node").alias("home")))
        still, any_moved = 0, False
        for turn in range(rounds):
            new = checkpointed(_moved(edges, nodes, total, resolution, turn))
            changed = new.filter("moved").count()
            nodes = new.drop("moved")
            any_moved |= changed > 0
            # a round moves every other node only
            still = still + 1 if not changed else 0
            if still == 2:
                break
        if not any_moved:
            break
        homes = nodes.select(F.col("node").alias("_n"), "home")
        place = checkpointed(place.join(homes, place["community"] == homes["_n"]).select("node", F.col("home").alias("community")))
        left, right = (nodes.select(F.col("node").alias(x), F.col("home").alias(f"h{x}")) for x in "ab")
        edges = checkpointed(edges.join(left, "a").join(right, "b").groupBy(F.col("ha").alias("a"), F.col("hb").alias("b")).agg(F.sum("weight").alias("weight")))
    return place
