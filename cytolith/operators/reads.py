"""Read tuples to tagged reads, barcode counts and pass metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import within_poly_t
from .fuzzy import unique_map
from .template import Template


def join_mates(mates: list[DataFrame]) -> DataFrame:
    """Mate files by record: read tuples with nameK, seqK, qualK. The shortest file decides how many there are."""
    named = [m.select("record_id", *(F.col(c).alias(f"{c}{k}") for c in ("name", "seq", "qual"))) for k, m in enumerate(mates, 1)]
    return reduce(lambda a, b: a.join(b, "record_id"), named)


def parse_reads(tuples: DataFrame, template: Template) -> DataFrame:
    """All tuples with fits (the structure matches), cb_raw, cb (values corrected), umi, pass_barcode, pass_poly_t."""
    spark = tuples.sparkSession
    out = tuples.withColumns({"fits": template.matches, "umi": template.umi} | {f"__{n}": c for n, c in template.barcodes.items()})
    out = out.withColumn("cb_raw", F.concat_ws("-", *(f"__{n}" for n in template.barcodes)))
    for name, values in template.values.items():
        pairs = unique_map(spark.createDataFrame([(v,) for v in values], "barcode string")).withColumnsRenamed({"query": "__query", "target": "__target"})
        out = out.join(F.broadcast(pairs), F.col(f"__{name}") == F.col("__query"), "left").withColumn(f"__{name}", F.col("__target")).drop("__query", "__target")
    whole = reduce(lambda a, b: a & b, [F.col(f"__{n}").isNotNull() for n in template.barcodes], F.lit(True))
    poly_t = within_poly_t(template.poly_t) if template.poly_t is not None else F.lit(True)
    return out.withColumns({"pass_barcode": F.col("fits") & whole, "pass_poly_t": F.col("fits") & poly_t, "cb": F.when(whole, F.concat_ws("-", *(f"__{n}" for n in template.barcodes)))}).drop(*(f"__{n}" for n in template.barcodes))


def kept(parsed: DataFrame) -> DataFrame:
    """Reads that pass all filters."""
    return parsed.filter("pass_barcode AND pass_poly_t")


def read_metrics(parsed: DataFrame, has_poly_t: bool = True) -> DataFrame:
    """(metric, value): reads in all, those that pass, and those that pass each filter; poly-T stays 0 without such a field."""
    row = parsed.agg(
        F.count_if(F.col("pass_barcode") & F.col("pass_poly_t")).alias("read_pass"),
        F.count_if("pass_barcode").alias("read_pass_barcode"),
        (F.count_if("pass_poly_t") if has_poly_t else F.lit(0).cast("long")).alias("read_pass_polyt"),
        F.count("*").alias("read_total"),
    )
    return row.unpivot([], row.columns, "metric", "value")


def barcode_counts(reads: DataFrame, umi_length: int) -> DataFrame:
    """cb, cb_count, t_count: reads by barcode, and how many have T at each UMI position."""
    sums = [F.sum((F.substring("umi", i, 1) == "T").cast("long")) for i in range(1, umi_length + 1)]
    return reads.groupBy("cb").agg(F.count("*").alias("cb_count"), F.array(*sums).alias("t_count"))


def top_barcodes(counts: DataFrame, limit: int) -> DataFrame:
    """The barcodes with the most reads (exact; ties by barcode)."""
    return counts.orderBy(F.desc("cb_count"), "cb").limit(limit)


def merge_counts(parts: list[DataFrame]) -> DataFrame:
    """Counts of several files or chunks as one: vectors are summed position by position."""
    every = reduce(DataFrame.unionByName, parts)
    flat = every.select("cb", "cb_count", F.posexplode_outer("t_count").alias("pos", "t"))
    by_pos = flat.groupBy("cb", "pos").agg(F.sum("t").alias("t"), F.sum("cb_count").alias("cb_count"))
    return by_pos.groupBy("cb").agg(F.max("cb_count").alias("cb_count"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("t_count"))


def tagged_fastq(reads: DataFrame, template: Template) -> DataFrame:
    """Lines (one column value) of the merged FASTQ; the header has the raw barcode. Reads without cDNA are left out."""
    k = template.cdna
    header = F.concat(F.lit("@:CB_"), F.col("cb_raw"), F.lit(":UB_"), F.col("umi"), F.lit(":"), F.col(f"name{k}"))
    return kept(reads).filter(F.length(f"seq{k}") >= 1).select(F.concat_ws("\n", header, F.col(f"seq{k}"), F.lit("+"), F.col(f"qual{k}")).alias("value"))


def wide_counts(counts: DataFrame, umi_length: int) -> DataFrame:
    """The table's file layout: cb, cb_count, 1 .. L, most reads first."""
    return counts.select("cb", "cb_count", *(F.col("t_count")[i].alias(str(i + 1)) for i in range(umi_length))).orderBy(F.desc("cb_count"), "cb")


def long_counts(wide: DataFrame) -> DataFrame:
    """The inverse of wide_counts for a table read from a file."""
    positions = [c for c in wide.columns if c.isdigit()]
    return wide.select("cb", F.col("cb_count").cast("long").alias("cb_count"), F.array(*(F.col(c).cast("long") for c in sorted(positions, key=int))).alias("t_count"))
