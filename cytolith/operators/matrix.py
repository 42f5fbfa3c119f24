"""Count matrices in coordinates, and their axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def read_counts(molecules: DataFrame) -> DataFrame:
    """cell, gene, count: reads."""
    return molecules.groupBy("cell", "gene").agg(F.sum("depth").alias("count"))


def transcript_counts(molecules: DataFrame, depth_threshold: int = 1) -> DataFrame:
    """cell, gene, count: molecules of so many reads at least."""
    return molecules.filter(F.col("depth") >= depth_threshold).groupBy("cell", "gene").agg(F.count("*").alias("count"))


def axis(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): distinct values numbered from 1 in order.

    Values are sorted by ranges; a value's number is its place in its range plus the sizes of the ranges before.
    """
    place_bits = 33  # of monotonically_increasing_id: the place within a partition
    placed = checkpointed(df.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_at", place_bits), "_place": F.col("_at").bitwiseAND((1 << place_bits) - 1)})
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    base = totals.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(base, "_part").select(column, (F.col("_base") + F.col("_place") + 1).alias(out))


def gene_axis(features: DataFrame) -> DataFrame:
    """gene, gene_idx over all features, counted or not."""
    return axis(features, "gene", "gene_idx")


def cell_axis(molecules: DataFrame, depth_threshold: int = 0) -> DataFrame:
    """cell, cell_idx: all cells; with a threshold those with a passing molecule, and always the first cell."""
    cells = molecules.select("cell")
    if depth_threshold > 0:
        first = molecules.agg(F.min("cell").alias("cell")).filter(F.col("cell").isNotNull())
        cells = molecules.filter(F.col("depth") >= depth_threshold).select("cell").union(first)
    return axis(cells, "cell", "cell_idx")


def coordinates(counts: DataFrame, genes: DataFrame, cells: DataFrame) -> DataFrame:
    """gene_idx, cell_idx, count of the counts that aren't zero."""
    return counts.filter(F.col("count") != 0).join(genes, "gene").join(cells, "cell").select("gene_idx", "cell_idx", "count")


def padded(counts: DataFrame, features: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, gene, count with a zero row, in the first cell, for each feature that no cell has, and for each cell without a count one in the first feature: every feature and cell is on an axis, and nothing else is added."""
    first_cell, first_gene = cells.agg(F.min("cell").alias("cell")), features.agg(F.min("gene").alias("gene"))  # one row each
    genes = features.select("gene").distinct().join(counts.select("gene"), "gene", "left_anti").crossJoin(F.broadcast(first_cell))
    empty = cells.select("cell").distinct().join(counts.select("cell"), "cell", "left_anti").join(genes.select("cell"), "cell", "left_anti").crossJoin(F.broadcast(first_gene))
    zeros = genes.select("cell", "gene").union(empty.select("cell", "gene")).filter("cell is not null and gene is not null").withColumn("count", F.lit(0).cast(counts.schema["count"].dataType))
    return counts.select("cell", "gene", "count").unionByName(zeros)
