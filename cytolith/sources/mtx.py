"""Matrix Market and the molecule store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = ("molecular_info", "map_info", "feature", "read_in_cell")


def write_mtx(coordinates: DataFrame, genes: DataFrame, cells: DataFrame, prefix: str) -> None:
    """prefix.mtx, prefix_gene.tsv, prefix_barcode.tsv as folders of text parts, in order.

    The header needs three counts; coordinates are range-sorted by column, then row, so parts read one after the other
    are one Matrix Market file.
    """
    spark = coordinates.sparkSession
    shape = (genes.count(), cells.count(), coordinates.count())
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate integer general"), (1, " ".join(map(str, shape)))], "k int, value string").orderBy("k").select("value").coalesce(1)
    body = coordinates.repartitionByRange("cell_idx", "gene_idx").sortWithinPartitions("cell_idx", "gene_idx").select(F.concat_ws(" ", "gene_idx", "cell_idx", "count").alias("value"))
    head.unionByName(body).write.mode("overwrite").text(f"{prefix}.mtx")
    genes.orderBy("gene_idx").select("gene").write.mode("overwrite").csv(f"{prefix}_gene.tsv", sep="\t")
    cells.orderBy("cell_idx").select("cell").write.mode("overwrite").csv(f"{prefix}_barcode.tsv", sep="\t")


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """gene_idx, cell_idx, count of a Matrix Market file or folder.

    The line of sizes is the first, in the file with the format's mark, that is no comment; files of a folder may be
    listed in any order.
    """
    place = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("at"))
    marked = lines.filter(F.col("value").startswith("%%MatrixMarket")).select("file_path").limit(1)
    plain = lines.filter(~F.col("value").startswith("%"))
    sizes = plain.join(F.broadcast(marked), "file_path", "left_semi").agg(F.min(F.struct("file_block_start", "at")).alias("first"), F.first("file_path").alias("head"))
    entries = plain.join(F.broadcast(sizes), (F.col("file_path") == F.col("head")) & (F.col("at") == F.col("first.at")), "left_anti")
    f = F.split("value", r"\s+")
    return entries.select(*(F.get(f, F.lit(k)).try_cast("long").alias(c) for k, c in enumerate(("gene_idx", "cell_idx", "count"))))


def write_store(path: str, **tables: DataFrame) -> None:
    """The four tables of a molecule store, as Parquet in one folder."""
    if set(tables) != set(STORE):
        raise ValueError(f"a store has {STORE}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in STORE}


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """barcode: one to a line."""
    return spark.read.text(path).select(F.trim("value").alias("barcode")).filter("barcode <> ''")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """A barcode count table with header."""
    return spark.read.csv(path, sep="\t", header=True)
