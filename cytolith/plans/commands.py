"""The four commands, end to end: tag reads, annotate alignments, count UMIs, down-sample.

Each reads and writes files, so a run can go on from any step. Work on reads is distributed; the driver sees paths, the
read structure and a few counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import cells as C
from ..operators import fuzzy as Z
from ..operators import matrix as X
from ..operators import molecules as M
from ..operators import reads as R
from ..operators import sample as S
from ..operators.collapse import collapse_umis
from ..operators.template import STRUCTURES, compile_template, load_config
from ..sources import fastq, gtf, mtx, sam
from ..session import checkpointed


def merge_fastq(spark: SparkSession, paths: list[str], method: str, fastq_out: str, counts_out: str, config: str | None = None) -> DataFrame:
    """Write the tagged reads and the barcode counts; returns the read metrics, also written next to the reads."""
    structure = load_config(config, method) if config else STRUCTURES[method]
    template = compile_template(structure, len(paths))
    parsed = R.parse_reads(R.join_mates(fastq.read_mates(spark, paths)), template).cache()
    R.tagged_fastq(parsed, template).write.mode("overwrite").option("compression", "gzip").text(fastq_out)
    counts = R.barcode_counts(R.kept(parsed), template.umi_length)
    R.wide_counts(counts, template.umi_length).write.mode("overwrite").csv(counts_out, sep="\t", header=True)
    metrics = R.read_metrics(parsed, template.poly_t is not None)
    metrics.orderBy(F.desc("value"), "metric").coalesce(1).write.mode("overwrite").csv(f"{fastq_out}.fastq_count.tsv", sep="\t", header=True)
    return metrics


def tag_bam(spark: SparkSession, bam: str, annotation: str, out: str, multi_mapping: bool = False, intron: bool = False, strand: int = 1) -> DataFrame:
    """Write alignments with the gene that each hits, as Parquet."""
    rows = gtf.read_gtf(spark, annotation).cache()
    introns = gtf.exons(rows, "transcript") if intron else None
    A.annotate(sam.read_alignments(spark, bam), gtf.exons(rows), strand, introns, multi_mapping).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def cell_map(spark: SparkSession, observed: DataFrame, counts: DataFrame | None, candidate_files: list[str], whitelist: str | None = None, expect_cell: int | None = 3000, force_cell: bool = False, all_cell: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(cb -> cell of correctable barcodes, whitelist, removed) of observed barcodes (cb).

    Candidate files are one a component (fewer are padded, ``None`` in a name's place passes a component). all_cell
    corrects to the candidate files only; a whitelist file replaces cell calling.
    """
    dictionaries = [None if p == "None" else mtx.read_barcodes(spark, p) for p in candidate_files]
    barcodes = observed.select("cb").distinct()
    composite = barcodes.filter(F.col("cb").contains("-")).limit(1).count() > 0
    removed = None
    if all_cell:
        done = Z.correct_components(barcodes, "cb", dictionaries, out="cell") if dictionaries else barcodes.withColumn("cell", F.col("cb"))
        known = done.filter(F.col("cell").isNotNull()).select(F.col("cell").alias("cb")).distinct()
        return done.filter(F.col("cell").isNotNull()), known, None
    if whitelist:
        known = mtx.read_barcodes(spark, whitelist).withColumnRenamed("barcode", "cb")
    else:
        if counts is None:
            raise ValueError("barcode counts or a whitelist are needed")
        known, removed = C.candidates(counts, dictionaries, expect_cell, force_cell)
        known, removed = checkpointed(known), checkpointed(removed)
        if known.isEmpty():
            raise ValueError("no cell barcodes were found")
    listed = known.select(F.col("cb").alias("barcode"))
    corrected = Z.correct_constrained(barcodes, "cb", listed, out="cell") if composite else Z.correct(barcodes, "cb", listed, out="cell")
    return corrected.filter(F.col("cell").isNotNull()), known, removed


def count_umi(spark: SparkSession, alignments: DataFrame | str, annotation: str, store: str, out_prefix: str, counts: str | None = None, candidate_files: list[str] | None = None, feature_tag: str = "XT:Z", depth_threshold: int = 1, expect_cell: int | None = 3000, force_cell: bool = False, whitelist: str | None = None, all_cell: bool = False) -> dict[str, DataFrame]:
    """Write the molecule store and both matrices; returns the store's tables."""
    rows = sam.read_alignments(spark, alignments, feature_tag) if isinstance(alignments, str) else alignments
    parsed = M.parse_names(rows)
    if parsed.filter((F.col("cb") != "") | (F.col("umi") != "")).isEmpty():
        raise ValueError("read names carry no barcodes")
    counted = R.long_counts(mtx.read_counts(spark, counts)) if counts else None
    cells, known, removed = cell_map(spark, parsed, counted, candidate_files or [], whitelist, expect_cell, force_cell, all_cell)
    genes = gtf.gene_map(gtf.read_gtf(spark, annotation))
    read = M.reads(parsed, genes, cells).cache()
    composite = known.filter(F.col("cb").contains("-")).limit(1).count() > 0
    molecule = M.choose_cells(M.passing_depth(M.molecules(read)), known if composite else None, removed).cache()
    if molecule.isEmpty():
        raise ValueError("no molecules were counted")
    mtx.write_store(store, molecular_info=molecule.orderBy("cell", "gene", "umi"), map_info=M.map_info(read), feature=genes.select("gene").distinct().orderBy("gene"), read_in_cell=M.reads_per_cell(read))
    tables = mtx.read_store(spark, store)
    write_matrices(tables["molecular_info"], tables["feature"], out_prefix, depth_threshold)
    if removed is not None:
        C.detected(known, removed).coalesce(1).write.mode("overwrite").text(f"{out_prefix}._detected_cb.tsv")
    return tables


def write_matrices(molecule: DataFrame, feature: DataFrame, out_prefix: str, depth_threshold: int = 1, collapse: bool = True) -> None:
    """prefix_read and prefix_depth_D_transcript, with their axes."""
    done = (collapse_umis(molecule) if collapse else molecule).cache()
    genes = X.gene_axis(feature)
    for counts, cells, name in ((X.read_counts(done), X.cell_axis(done), "read"), (X.transcript_counts(done, depth_threshold), X.cell_axis(done, depth_threshold), f"depth_{depth_threshold}_transcript")):
        mtx.write_mtx(X.coordinates(counts, genes, cells), genes, cells, f"{out_prefix}_{name}")
    done.unpersist()


def down_sample(spark: SparkSession, store: str, out_prefix: str, total_read: int | None = None, total_cell: int | None = None, mean_read: tuple[int, ...] = (10000,), depth_threshold: int = 1, seed: int = 0) -> list[int]:
    """Write matrices of the store's library at each mean number of reads a cell; returns the means that it has reads for."""
    tables = mtx.read_store(spark, store)
    unique = tables["map_info"].filter("metric = 'num_unique_read'").first()["value"]
    drawn = S.down_sample(tables["molecular_info"], unique, tables["read_in_cell"].count(), tuple(mean_read), total_read, total_cell, seed)
    for mean, molecule in drawn.items():
        write_matrices(molecule, tables["feature"], f"{out_prefix}_sample_{mean}", depth_threshold)
    return list(drawn)


def down_sample_cell(spark: SparkSession, store: str, out_prefix: str = "", expect_read: int = 10000, depth_threshold: int = 1) -> DataFrame:
    """Write matrices of cells drawn down to so many reads each; returns the molecules."""
    tables = mtx.read_store(spark, store)
    molecule = S.down_sample_cells(tables["molecular_info"], tables["read_in_cell"], expect_read)
    write_matrices(molecule, tables["feature"], f"{out_prefix}.sample_", depth_threshold)
    return molecule
