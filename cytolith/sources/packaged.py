"""Tables that analysis packages ship: wide matrices, mutation lists and networks, as CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """sample, gene, value (null where missing) of a table with a row for each sample, its name first, and a column for each gene."""
    df = _read(spark, path)
    sample, *genes = df.columns
    quoted = [f"`{g}`" for g in genes]
    wide = df.select(F.col(f"`{sample}`").cast("string").alias("sample"), *(F.col(q).try_cast("double").alias(g) for q, g in zip(quoted, genes, strict=True)))
    return wide.unpivot("sample", quoted, "gene", "value")


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """sample, hgnc_symbol, variant_type of a mutation list."""
    return _read(spark, path).select(*(F.col(c).cast("string") for c in ("sample", "hgnc_symbol", "variant_type")))


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """gene, neighbour, weight of a list of edges."""
    return _read(spark, path).select(F.col("gene").cast("string"), F.col("neighbour").cast("string"), F.col("weight").try_cast("double"))


def read_package(spark: SparkSession, folder: str, suffix: str = "csv") -> dict[str, DataFrame]:
    """The five tables of a package: expr, cna.logr and cna.call long, mut, net."""
    at = lambda name: f"{folder}/{name}.{suffix}"
    calls = read_wide(spark, at("cna.call")).select("sample", "gene", F.col("value").cast("int").alias("call"))
    return {"expr": read_wide(spark, at("expr")), "cna.logr": read_wide(spark, at("cna.logr")), "cna.call": calls, "mut": read_mutations(spark, at("mut")), "net": read_network(spark, at("net"))}
