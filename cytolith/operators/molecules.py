"""Tagged alignments to molecules.

A read is all alignments of one name. It counts if, on its first alignment, it is mapped (NH is not 0), its barcode
passes the N rule and corrects, and its UMI has neither N nor one base only; and if over all its alignments none is
ambiguous and the genes found are exactly one. So the order inside a read doesn't matter, and one shuffle by name gives
reads, another by (cell, gene, umi) molecules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import count_base, is_homopolymer, passes_n_rule

AMBIGUOUS = "Unassigned_Ambiguity"


def parse_names(alignments: DataFrame) -> DataFrame:
    """alignments with cb and umi from the read name; of several marks the last counts."""
    return alignments.withColumns({"cb": F.regexp_extract("qname", r".*:CB_([A-Z\-]+)", 1), "umi": F.regexp_extract("qname", r".*:UB_([A-Z\-]+)", 1)})


def read_runs(alignments: DataFrame) -> DataFrame:
    """alignments (aln_id, qname, ..) with run: the number of the stretch of equal names that it is in, by file order.

    Only for input whose names come back after other reads. A global window has one partition, so the changes of name
    are numbered within ranges of the file and the ranges' totals added.
    """
    size = 1 << 16
    ranged = alignments.withColumn("_range", F.expr(f"aln_id div {size}"))
    own = Window.partitionBy("_range").orderBy("aln_id")
    before = Window.orderBy("_range")
    edges = ranged.groupBy("_range").agg(F.max_by("qname", "aln_id").alias("_last"))
    last = edges.withColumn("_previous", F.lag("_last").over(before)).drop("_last")
    joined = ranged.join(last, "_range")
    changed = joined.withColumn("_new", (~F.coalesce(F.lag("qname").over(own), F.col("_previous"), F.lit("\u0000")).eqNullSafe(F.col("qname"))).cast("int"))
    totals = changed.groupBy("_range").agg(F.sum("_new").alias("_n"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return changed.join(base, "_range").withColumn("run", F.col("_base") + F.sum("_new").over(own)).drop("_range", "_previous", "_new", "_base")


def reads(alignments: DataFrame, gene_map: DataFrame, cell_map: DataFrame, by: str = "qname") -> DataFrame:
    """One row a read with what decides whether it counts.

    alignments: by, aln_id, cb, umi, is_unmapped, reference_name, nh, xt, xs. gene_map: gene_id, gene.
    cell_map: cb, cell (correctable barcodes only).
    """
    feature = F.coalesce("xt", "reference_name")
    genes = gene_map.select(F.col("gene_id").alias("_id"), F.col("gene").alias("_gene"))
    named = alignments.withColumns({"_feature": feature, "_ambiguous": F.coalesce(F.col("xt").isNull() & (F.col("xs") == AMBIGUOUS), F.lit(False))})
    mapped = named.join(genes, named["_feature"] == genes["_id"], "left")
    first = F.min_by(F.struct("cb", "umi", "nh", "is_unmapped", "_ambiguous", "_gene"), "aln_id")
    read = mapped.groupBy(by).agg(
        first.alias("f"), F.count("*").alias("n_alignments"), F.max("_ambiguous").alias("ambiguous"),
        F.min("_gene").alias("gene"), F.max("_gene").alias("_other"),
    )
    corrected = cell_map.select(F.col("cb").alias("_cb"), "cell")
    read = read.join(corrected, read["f.cb"] == corrected["_cb"], "left")
    rule = passes_n_rule(F.col("f.cb"))
    umi_ok = (count_base(F.col("f.umi"), "N") == 0) & ~is_homopolymer(F.col("f.umi"))
    unmapped = F.coalesce(F.col("f.nh"), F.lit(0)) == 0
    usable = ~unmapped & rule & F.col("cell").isNotNull()
    one_gene = F.col("gene").isNotNull() & (F.col("gene") == F.col("_other"))
    return read.select(
        by, F.col("f.cb").alias("cb"), F.col("f.umi").alias("umi"), "cell", "gene", "n_alignments", rule.alias("n_rule"), unmapped.alias("unmapped"), F.col("f.is_unmapped").alias("flag_unmapped"),
        F.col("f.nh").alias("nh"), umi_ok.alias("umi_ok"), F.col("f._ambiguous").alias("first_ambiguous"), F.col("f._gene").isNull().alias("first_unknown"),
        F.coalesce(usable & umi_ok & ~F.col("ambiguous") & one_gene, F.lit(False)).alias("counted"),
    )


def molecules(read: DataFrame) -> DataFrame:
    """cell, gene, umi, depth."""
    return read.filter("counted").groupBy("cell", "gene", "umi").agg(F.count("*").alias("depth"))


def reads_per_cell(read: DataFrame) -> DataFrame:
    """cell, n_read: reads whose barcode corrects, counted or not."""
    return read.filter(F.col("cell").isNotNull()).groupBy("cell").agg(F.count("*").alias("n_read"))


def map_info(read: DataFrame) -> DataFrame:
    """(metric, value): alignments, reads, unmapped reads, reads left out for barcode, UMI or gene, counted reads."""
    reaches = ~F.col("unmapped") & F.col("n_rule")
    has_cell = F.col("cell").isNotNull()
    checked = reaches & has_cell & F.col("umi_ok") & ~F.col("first_ambiguous")
    lost = (
        (reaches & ~has_cell & ~F.coalesce("flag_unmapped", F.lit(False)))
        | (reaches & has_cell & ~F.col("umi_ok"))
        | (reaches & has_cell & F.col("umi_ok") & F.col("first_ambiguous"))
        | (checked & ~F.col("counted"))
    )
    row = read.agg(
        F.sum("n_alignments").alias("num_alignment"), F.count("*").alias("num_unique_read"), F.count_if("unmapped").alias("num_unmapped_read"),
        F.count_if(lost).alias("num_barcode_with_na"), F.count_if("counted").alias("num_count_read"),
    )
    return row.unpivot([], row.columns, "metric", "value")


def passing_depth(molecule: DataFrame) -> DataFrame:
    """Molecules of depth 0.95 or more, rounded half up."""
    return molecule.filter(F.col("depth") >= 0.95).withColumn("depth", F.floor(F.col("depth") + 0.5).cast("long"))


def choose_cells(molecule: DataFrame, whitelist: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    """Molecules of the whitelist's cells (composite barcodes), without the removed ones (any barcode)."""
    if whitelist is not None:
        molecule = molecule.join(whitelist.select(F.col(whitelist.columns[0]).alias("cell")).distinct(), "cell", "left_semi")
    if removed is not None:
        molecule = molecule.join(removed.select(F.col(removed.columns[0]).alias("cell")).distinct(), "cell", "left_anti")
    return molecule


def features(molecule: DataFrame) -> DataFrame:
    """gene: the sorted feature axis."""
    return molecule.select("gene").distinct().orderBy("gene")
