"""GTF reader: annotation rows and the gene map. Spark decompresses .gz."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("attributes"), rf'{name} "([^"]*)"', 1), F.lit(""))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """chrom, feature, start, end, strand, gene_id, gene_name, at of the lines (value, and at: their order if there is one)."""
    f = F.split("value", "\t")
    order = F.col("at") if "at" in lines.columns else F.lit(0).cast("long")
    rows = lines.filter(~F.col("value").startswith("#") & (F.size(f) >= 9))
    cut = rows.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(2)).alias("feature"), F.get(f, F.lit(3)).try_cast("long").alias("start"), F.get(f, F.lit(4)).try_cast("long").alias("end"), F.get(f, F.lit(6)).alias("strand"), F.get(f, F.lit(8)).alias("attributes"), order.alias("at"))
    return cut.select("chrom", "feature", "start", "end", "strand", _attribute("gene_id").alias("gene_id"), _attribute("gene_name").alias("gene_name"), "at")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """All annotation rows, with their line numbers."""
    lines = spark.createDataFrame(spark.sparkContext.textFile(path).zipWithIndex(), "value string, at long")
    return parse_gtf(lines)


def gene_map(annotation: DataFrame) -> DataFrame:
    """gene_id, gene (id_name) of gene rows with both; of a repeated id the last row holds."""
    genes = annotation.filter((F.col("feature") == "gene") & F.col("gene_id").isNotNull() & F.col("gene_name").isNotNull())
    return genes.groupBy("gene_id").agg(F.max_by("gene_name", "at").alias("gene_name")).select("gene_id", F.concat_ws("_", "gene_id", "gene_name").alias("gene"))


def exons(annotation: DataFrame, feature: str = "exon") -> DataFrame:
    """gene_id, chrom, start, end, strand of exons (or whole transcripts)."""
    return annotation.filter((F.col("feature") == feature) & F.col("gene_id").isNotNull()).select("gene_id", "chrom", "start", "end", "strand")
