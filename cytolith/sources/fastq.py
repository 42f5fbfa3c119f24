"""FASTQ reader as a Python data source.

``spark.read.format("fastq").load(path)`` gives record_id (position in the file), name, seq, plus, qual. A file is one
partition, since a gzip stream can't be entered in the middle and an uncompressed record has no mark that a quality line
can't have; give many files, or repartition after parsing. Paths are read through Hadoop's file API by
``read_fastq_lines`` where they aren't local.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from glob import glob

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "record_id long, name string, seq string, plus string, qual string"


def records(lines: Iterator[str]) -> Iterator[tuple[int, str, str, str, str]]:
    """Records of four lines; a trailing partial record is an error."""
    k = 0
    while True:
        head = next(lines, None)
        if head is None or head == "" and next(lines, None) is None:
            return
        rest = [next(lines, None) for _ in range(3)]
        if None in rest or not head.startswith("@"):
            raise ValueError(f"record {k} isn't a FASTQ record of four lines")
        yield k, head[1:], rest[0], rest[1], rest[2]
        k += 1


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = sorted(glob(options["path"].removeprefix("file://")))
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple[int, str, str, str, str]]:
        opener = gzip.open if partition.path.endswith("gz") else open
        with opener(partition.path, "rt") as f:
            yield from records(line.rstrip("\r\n") for line in f)


class FastqDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Read local or mounted files."""
    spark.dataSource.register(FastqDataSource)
    return spark.read.format("fastq").load(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, at: the lines of a file, or of a folder's files one after the other by name, numbered from 0, from any store that Spark reads.

    Lines keep their order within a part of a file that is read in one go; the sizes of the parts before are added.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    parts = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))  # a row for each part
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(parts.withColumn("_before", before), ["_file", "_block"]).select("value", (F.col("_id") - F.col("_first") + F.col("_before")).alias("at"))


def read_fastq_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read a file, or a folder of files, from any store that Spark reads; record_id counts over all of them."""
    part = lambda k: F.max(F.when(F.col("at") % 4 == k, F.col("value")))
    rows = numbered_lines(spark, path).groupBy(F.expr("at div 4").alias("record_id")).agg(part(0).alias("head"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual"))
    return rows.filter(F.col("qual").isNotNull()).select("record_id", F.expr("substring(head, 2)").alias("name"), "seq", "plus", "qual")


def read_mates(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """One frame a file."""
    return [read_fastq(spark, p) for p in paths]

