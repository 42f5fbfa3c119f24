"""Cell calling from the barcode-rank curve, whitelist refinement and merging of erroneous barcodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import neighbours, passes_n_rule
from .fuzzy import correct_components, near_pairs
from ..session import checkpointed

#: First characters of a barcode by which barcodes of one count are grouped.
HEAD = 6
LOW_RATIO, HIGH_RATIO = 0.005, 0.80


def drop_uniform(counts: DataFrame, all_components: bool = False) -> DataFrame:
    """Without barcodes whose first component (or any) is all N or all G."""
    parts = F.split("cb", "-")
    bad = lambda x: (x == F.repeat(F.lit("N"), F.length(x))) | (x == F.repeat(F.lit("G"), F.length(x)))
    return counts.filter(~F.exists(parts, bad) if all_components else ~bad(parts[0]))


def rank_curve(counts: DataFrame) -> DataFrame:
    """cb, cb_count, rank (by falling count, then barcode), cumulative reads.

    The global order is by ranges of the count: a window within each range, plus the totals of the ranges above, so no
    task gets all barcodes. Ranges are quarter powers of two; within one, a group is a count and a barcode's first bases.
    """
    # equal counts are ordered by barcode: those of one count are cut at the first characters of the barcode
    bits = F.floor(F.log2(F.greatest("cb_count", F.lit(1)).cast("double")) * 4).cast("int")
    ranged = counts.select("cb", "cb_count", bits.alias("_range"), (-F.col("cb_count")).alias("_neg"), F.substring("cb", 1, HEAD).alias("_head"))
    group = ["_range", "_neg", "_head"]
    totals = ranged.groupBy(*group).agg(F.count("*").alias("_n"), F.sum("cb_count").alias("_s"))
    w = Window.partitionBy("_range").orderBy("_neg", "_head").rowsBetween(Window.unboundedPreceding, -1)
    within = totals.withColumns({"_n0": F.coalesce(F.sum("_n").over(w), F.lit(0)), "_s0": F.coalesce(F.sum("_s").over(w), F.lit(0))})
    by_range = totals.groupBy("_range").agg(F.sum("_n").alias("_rn"), F.sum("_s").alias("_rs"))  # at most 4 x 63 rows
    above = by_range.alias("a").join(by_range.alias("b"), F.col("b._range") > F.col("a._range"), "left").groupBy(F.col("a._range").alias("_range")).agg(F.coalesce(F.sum("b._rn"), F.lit(0)).alias("_n1"), F.coalesce(F.sum("b._rs"), F.lit(0)).alias("_s1"))
    own = Window.partitionBy(*group).orderBy("cb")
    placed = ranged.withColumns({"_r": F.row_number().over(own), "_c": F.sum("cb_count").over(own)})
    out = placed.join(within.select(*group, "_n0", "_s0"), group).join(above, "_range")
    return out.select("cb", "cb_count", (F.col("_n1") + F.col("_n0") + F.col("_r")).alias("rank"), (F.col("_s1") + F.col("_s0") + F.col("_c")).alias("cumulative"))


def knee_data(counts: DataFrame) -> DataFrame:
    """What the rank and knee plots draw."""
    return rank_curve(counts).select("cb", "cb_count", "rank", F.log10(F.col("cumulative").cast("double")).alias("log_cumulative"))


def cell_threshold(counts: DataFrame, expect_cell: int | None = None) -> DataFrame:
    """One row: n_top, threshold. A tenth of q75 + 1.5 IQR of the top barcodes, or of their 99th percentile if over 500."""
    curve = rank_curve(counts)
    if expect_cell:
        top = curve.withColumn("n_top", F.lit(int(expect_cell)).cast("long"))
    else:
        total = curve.agg(F.max("cumulative").alias("_total"))
        n = curve.join(F.broadcast(total)).agg(F.count_if(F.log10(F.col("cumulative").cast("double")) <= F.log10(F.col("_total").cast("double")) * 0.8).alias("n_top"))
        top = curve.join(F.broadcast(n))  # one row
    q = F.percentile("cb_count", F.array(F.lit(0.75), F.lit(0.25), F.lit(0.99)))
    picked = top.filter(F.col("rank") <= F.col("n_top")).groupBy("n_top").agg(q.alias("q"))
    few = (F.col("q")[0] + (F.col("q")[0] - F.col("q")[1]) * 1.5) / 10
    return picked.select("n_top", F.when(F.col("n_top") <= 500, few).otherwise(F.col("q")[2] / 10).alias("threshold"))


def forced_threshold(counts: DataFrame, cells: int) -> DataFrame:
    """One row: the count of the barcode after the first so many; barcodes must have more, so ties at the edge go."""
    return rank_curve(counts).filter(F.col("rank") == cells + 1).agg(F.coalesce(F.max("cb_count").cast("double"), F.lit(-1.0)).alias("threshold"))


def call_cells(counts: DataFrame, expect_cell: int | None = None, force_cell: bool = False) -> DataFrame:
    """The rows of counts above the threshold."""
    threshold = forced_threshold(counts, int(expect_cell)) if force_cell else cell_threshold(counts, expect_cell).select("threshold")
    return counts.join(F.broadcast(threshold), F.col("cb_count") > F.col("threshold")).drop("threshold")


def refine(cells: DataFrame, dictionaries: list[DataFrame | None]) -> DataFrame:
    """Cells that pass the N rule, with corrected: the barcode itself, or its correction to the candidate files; others go."""
    named = cells.filter(passes_n_rule(F.col("cb")))
    if not any(d is not None for d in dictionaries):
        return named.withColumn("corrected", F.col("cb"))
    return correct_components(named, "cb", dictionaries).filter(F.col("corrected").isNotNull())


def regroup(refined: DataFrame) -> DataFrame:
    """Counts by corrected barcode."""
    flat = refined.select(F.col("corrected").alias("cb"), "cb_count", F.posexplode("t_count").alias("pos", "t"))
    by_pos = flat.groupBy("cb", "pos").agg(F.sum("t").alias("t"), F.sum("cb_count").alias("cb_count"))
    return by_pos.groupBy("cb").agg(F.max("cb_count").alias("cb_count"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("t_count"))


def t_ratios(counts: DataFrame) -> DataFrame:
    """counts with t_ratio and n_flags: at how many UMI positions the share of T is above 0.80 or below 0.005."""
    ratio = F.transform("t_count", lambda t: t.cast("double") / F.col("cb_count"))
    return counts.withColumn("t_ratio", ratio).withColumn("n_flags", F.size(F.filter("t_ratio", lambda r: (r > HIGH_RATIO) | (r < LOW_RATIO))))


def _in_order(counts: DataFrame, distance: int, rule) -> DataFrame:
    """cb of the barcodes that a greedy pass by falling count (ties by barcode) accepts.

    Whether one is accepted depends on its neighbours above it alone: of a barcode of L bases there are 4 L at most at
    distance 1. So all whose answer is known are answered at once, round after round; there are as many rounds as the
    longest chain of barcodes that wait for each other, and no group of barcodes is held together. rule gives, from n_open,
    n_accepted, top (the largest accepted count) and own, true, false, or null for not yet.
    """
    nodes = checkpointed(counts.select("cb", "cb_count"))
    named = lambda n: nodes.select(F.col("cb").alias(n), F.col("cb_count").alias(f"{n}_count"))
    met = near_pairs(nodes, distance, "cb").join(named("a"), "a").join(named("b"), "b")
    first = (F.col("a_count") > F.col("b_count")) | ((F.col("a_count") == F.col("b_count")) & (F.col("a") < F.col("b")))
    pick = lambda x, y, out: F.when(first, F.col(x)).otherwise(F.col(y)).alias(out)
    edges = checkpointed(met.select(pick("b", "a", "cb"), pick("b_count", "a_count", "own"), pick("a", "b", "above"), pick("a_count", "b_count", "above_count"), F.lit(None).cast("boolean").alias("accepted")))
    decided = nodes.join(edges.select("cb").distinct(), "cb", "left_anti").select("cb", F.lit(True).alias("accepted"))
    done = [decided]
    while True:
        news = done[-1].select(F.col("cb").alias("above"), F.col("accepted").alias("_new"))
        edges = checkpointed(edges.join(news, "above", "left").withColumn("accepted", F.coalesce("accepted", "_new")).drop("_new"))
        if edges.isEmpty():
            break
        state = edges.groupBy("cb", "own").agg(F.count_if(F.col("accepted").isNull()).alias("n_open"), F.count_if("accepted").alias("n_accepted"), F.max(F.when(F.col("accepted"), F.col("above_count"))).alias("top"))
        answered = checkpointed(state.select("cb", rule.alias("accepted")).filter(F.col("accepted").isNotNull()))
        done.append(answered)
        edges = edges.join(answered.select("cb"), "cb", "left_anti")
    return reduce(DataFrame.unionByName, done).filter("accepted").select("cb")


def greedy_merge(counts: DataFrame, distance: int = 1) -> DataFrame:
    """cb of accepted barcodes: those without an accepted neighbour above, or with exactly one and more than a tenth of its reads."""
    enough = F.col("own") > F.col("top") / 10
    lost = (F.col("n_accepted") >= 2) | ((F.col("n_accepted") == 1) & ~enough)
    return _in_order(counts, distance, F.when(lost, False).when(F.col("n_open") == 0, True))


def greedy_absorb(counts: DataFrame, distance: int = 1) -> DataFrame:
    """cb of the barcodes that are left if each, by falling count, absorbs all within the distance."""
    return _in_order(counts, distance, F.when(F.col("n_accepted") >= 1, False).when(F.col("n_open") == 0, True))


def merge_deleted(counts: DataFrame, merge: bool, distance: int = 1) -> tuple[DataFrame, DataFrame]:
    """(whitelist, removed), both with cb, from counts by corrected barcode.

    Barcodes without a flag make the whitelist (merged greedily if asked, however many they are), those with one flag
    have lost a base and are represented by the largest of each neighbourhood, others go. Of the whitelist, barcodes next
    to a representative whose last base is N are to be removed.
    """
    flagged = checkpointed(t_ratios(counts).select("cb", "cb_count", "n_flags"))
    whole = flagged.filter("n_flags = 0")
    listed = greedy_merge(whole, distance) if merge else whole.select("cb")
    shorter = checkpointed(greedy_absorb(flagged.filter("n_flags = 1"), distance))
    masked = shorter.select(F.explode(neighbours(F.concat(F.expr("left(cb, length(cb) - 1)"), F.lit("N")))).alias("cb")).distinct()
    removed = listed.join(masked, "cb", "left_semi")
    return listed.unionByName(shorter), removed


def candidates(counts: DataFrame, dictionaries: list[DataFrame | None], expect_cell: int | None = None, force_cell: bool = False, distance: int = 1) -> tuple[DataFrame, DataFrame]:
    """(whitelist, removed) from raw barcode counts: filter, call, refine, merge. Merging runs only without candidate files."""
    called = call_cells(drop_uniform(counts), expect_cell, force_cell)
    return merge_deleted(regroup(refine(called, dictionaries)), merge=not dictionaries, distance=distance)


def detected(whitelist: DataFrame, removed: DataFrame) -> DataFrame:
    """The whitelist without what is removed, in order."""
    return whitelist.join(removed, "cb", "left_anti").distinct().orderBy("cb")
