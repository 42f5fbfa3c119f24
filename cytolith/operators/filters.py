"""Filters on cells of a count matrix (cell, gene, count)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import MITO
from .mixture import fit_totals


def cell_totals(counts: DataFrame) -> DataFrame:
    """cell, total."""
    return counts.groupBy("cell").agg(F.sum("count").alias("total"))


def gene_set_counts(counts: DataFrame, pattern: str) -> DataFrame:
    """cell, total, in_set: all counts and those of genes that match."""
    return counts.groupBy("cell").agg(F.sum("count").alias("total"), F.coalesce(F.sum(F.when(F.col("gene").rlike(pattern), F.col("count"))), F.lit(0)).alias("in_set"))


def mito_ratio(counts: DataFrame, species: str = "human", pattern: str | None = None) -> DataFrame:
    """cell, total, ratio of mitochondrial counts."""
    if pattern is None and species not in MITO:
        raise ValueError("species must be human or mouse")
    sums = gene_set_counts(counts, pattern or MITO[species])
    return sums.select("cell", "total", (F.col("in_set").cast("double") / F.col("total")).alias("ratio"))


def mito_filter(counts: DataFrame, species: str = "human", pattern: str | None = None) -> DataFrame:
    """Cells (cell, total, ratio) whose ratio is at most Q3 + 3 IQR; if that is 0.02 or less, at most half the largest if that is more."""
    ratios = mito_ratio(counts, species, pattern)
    q = ratios.agg(F.percentile("ratio", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.max("ratio").alias("top"))
    fence = F.col("q")[1] + 3 * (F.col("q")[1] - F.col("q")[0])
    limit = q.select(F.when(fence <= 0.02, F.greatest(F.col("top") / 2, fence)).otherwise(fence).alias("limit"))
    return ratios.join(F.broadcast(limit), F.col("ratio") <= F.col("limit")).drop("limit")


def low_count_filter(counts: DataFrame, ratio: float = 0.1, take_log: bool = True) -> DataFrame:
    """Cells (cell, total) at or above the cut of a two-part mixture of their totals.

    The mixture is that of all cells: it is fitted to the distinct totals, each weighing as many cells as have it. Totals
    are counts, so one task gets no more rows than the largest total is.
    """
    totals = cell_totals(counts)
    value = F.log10(F.col("total").cast("double")) if take_log else F.col("total").cast("double")
    held = totals.groupBy("total").agg(F.count("*").alias("n")).select(value.alias("x"), "n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        return pd.DataFrame({"cut": [fit_totals(pdf["x"].to_numpy(), ratio, pdf["n"].to_numpy())[1]]})

    cut = held.groupBy().applyInPandas(run, "cut double")
    return totals.join(F.broadcast(cut), value >= F.col("cut")).drop("cut")
