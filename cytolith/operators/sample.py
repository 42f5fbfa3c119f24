"""Down-sampling of libraries and of cells: exact numbers of reads, drawn without replacement.

Every read of a molecule is a slot with a hash of (seed, cell, gene, umi, slot); the slots with the smallest hashes are
drawn. The draw is the same however the data are dealt, and exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PREFIX = 4


def slot_hash(seed: int) -> Column:
    """md5 of the slot, so that any engine can repeat the draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), "cell", "gene", "umi", F.col("slot").cast("string")))


def _slots(molecules: DataFrame, seed: int) -> DataFrame:
    return molecules.select("cell", "gene", "umi", F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth").cast("long"))).alias("slot")).withColumn("h", slot_hash(seed))


def _smallest(slots: DataFrame, wanted: DataFrame | int, keys: list[str]) -> DataFrame:
    """The wanted number (a column n by keys, or one number) of slots with the smallest hashes.

    Hash prefixes are counted first: those wholly below the cut are in, and only the prefix at the cut is ranked.
    """
    slots = slots.withColumn("_p", F.substring("h", 1, _PREFIX))
    counts = slots.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys, F.lit(0)).orderBy("_p") if keys else Window.orderBy("_p")
    running = counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_from", F.col("_to") - F.col("_n"))
    n = F.lit(wanted) if isinstance(wanted, int) else F.col("n")
    if not isinstance(wanted, int):
        running = running.join(wanted.select(*keys, "n"), keys)
    cut = running.filter(F.col("_from") < n).select(*keys, "_p", "_from", "_to", n.alias("_want"))
    placed = slots.join(cut, [*keys, "_p"])
    inside = placed.filter(F.col("_to") <= F.col("_want"))
    edge = placed.filter(F.col("_to") > F.col("_want")).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("h", "cell", "gene", "umi", "slot")))
    chosen = edge.filter(F.col("_from") + F.col("_r") <= F.col("_want"))
    return inside.select("cell", "gene", "umi").unionByName(chosen.select("cell", "gene", "umi"))


def down_sample_to(molecules: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """cell, gene, umi, depth of n reads drawn from all."""
    return _smallest(_slots(molecules, seed), int(n), []).groupBy("cell", "gene", "umi").agg(F.count("*").alias("depth"))


def down_sample(molecules: DataFrame, num_unique_read: int, n_cells: int, mean_read: tuple[int, ...] = (10000,), total_read: int | None = None, total_cell: int | None = None, seed: int = 0) -> dict[int, DataFrame]:
    """By mean reads per cell: the molecules after drawing; means that need more reads than there are are left out."""
    molecules = molecules.filter(F.col("depth") >= 1)
    total_read = max(total_read, num_unique_read) if total_read else num_unique_read
    total_cell = min(total_cell, n_cells) if total_cell else n_cells
    depth = molecules.agg(F.sum("depth")).first()[0] or 0
    out = {}
    for k, mean in enumerate(mean_read):
        expected = mean * total_cell
        if expected <= total_read and total_read:
            out[mean] = down_sample_to(molecules, int(depth / total_read * expected + 0.5), seed + k)
    return out


def down_sample_cells(molecules: DataFrame, read_in_cell: DataFrame, expect_read: int = 10000, seed: int = 0) -> DataFrame:
    """Molecules of the cells with so many reads at least, each drawn down to its share of expect_read; cells that need more than they have stay."""
    molecules = molecules.filter(F.col("depth") >= 1)
    depth = molecules.groupBy("cell").agg(F.sum("depth").alias("_depth"))
    cells = read_in_cell.filter(F.col("n_read") >= expect_read).join(depth, "cell")
    wanted = cells.select("cell", F.least("_depth", F.floor(F.lit(expect_read) * F.col("_depth").cast("double") / F.col("n_read") + 0.5).cast("long")).alias("n"))
    chosen = molecules.join(wanted.select("cell"), "cell", "left_semi")
    return _smallest(_slots(chosen, seed), wanted, ["cell"]).groupBy("cell", "gene", "umi").agg(F.count("*").alias("depth"))
