"""Running barcode counts and read metrics over a growing folder of parsed reads.

Reads have no event time, so there is no watermark; state is one row a barcode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reads import barcode_counts


def stream_tuples(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read tuples from Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def count_barcodes(reads: DataFrame, umi_length: int) -> DataFrame:
    """Counts by barcode of a stream of passing reads (cb, umi); needs complete or update mode."""
    return barcode_counts(reads, umi_length)


def stream_metrics(parsed: DataFrame) -> DataFrame:
    """One running row of the pass counters."""
    return parsed.groupBy(F.lit(1).alias("all")).agg(F.count_if(F.col("pass_barcode") & F.col("pass_poly_t")).alias("read_pass"), F.count_if("pass_barcode").alias("read_pass_barcode"), F.count_if("pass_poly_t").alias("read_pass_polyt"), F.count("*").alias("read_total")).drop("all")


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Replace the table at path with the whole counts after each batch, for the files that are there now."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
