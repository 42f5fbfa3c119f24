"""Registered queries of the sequencing operators: (spark, sf_dir) -> DataFrame, each with its SQL in ``oracles``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.dna import count_base, is_homopolymer, passes_n_rule, within_poly_t
from ..operators import annotate as A
from ..operators import cells as C
from ..operators import clustering as U
from ..operators import driver_model as D
from ..operators import expression as E
from ..operators import filters as L
from ..operators import fuzzy as Z
from ..operators import markers as K
from ..operators import matrix as X
from ..operators import mixture as B
from ..operators import molecules as M
from ..operators import network as N
from ..operators import reads as R
from ..operators import sample as S
from ..operators.collapse import collapse_umis
from ..operators.template import STRUCTURES, compile_template
from ..session import checkpoint_dir, checkpointed
from ..sources import fastq as Q
from ..sources import gtf as G
from ..sources import mtx as T
from ..sources import packaged as P
from ..sources import sam as A2
from . import commands as W
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
TEMPLATE_UMI = 6


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parse_reads(fx.tuples(spark, sf_dir), compile_template(fx.STRUCTURE))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.barcode_counts(R.kept(_parsed(spark, sf_dir)), TEMPLATE_UMI)


def parsed_reads(spark, sf_dir):
    return R.kept(_parsed(spark, sf_dir)).select("record_id", "cb", "umi", "seq2")


def read_filter_metrics(spark, sf_dir):
    return R.read_metrics(_parsed(spark, sf_dir))


def barcode_counts(spark, sf_dir):
    return _counts(spark, sf_dir).select("cb", "cb_count", *(F.col("t_count")[i].alias(f"t{i + 1}") for i in range(TEMPLATE_UMI)))


def merged_barcode_counts(spark, sf_dir):
    reads = R.kept(_parsed(spark, sf_dir))
    parts = [R.barcode_counts(reads.filter(F.col("record_id") % 3 == k), TEMPLATE_UMI) for k in range(3)]
    return R.merge_counts(parts).select("cb", "cb_count", *(F.col("t_count")[i].alias(f"t{i + 1}") for i in range(TEMPLATE_UMI)))


def top_barcodes(spark, sf_dir):
    return R.top_barcodes(_counts(spark, sf_dir).select("cb", "cb_count"), 50)


def t_frequency(spark, sf_dir):
    return C.t_ratios(_counts(spark, sf_dir)).select("cb", *(F.round(F.col("t_ratio")[i], 6).alias(f"r{i + 1}") for i in range(TEMPLATE_UMI)))


def indel_flags(spark, sf_dir):
    return C.t_ratios(_counts(spark, sf_dir)).select("cb", F.col("n_flags").cast("long").alias("n_flags"))


def tagged_fastq(spark, sf_dir):
    return R.tagged_fastq(_parsed(spark, sf_dir), compile_template(fx.STRUCTURE))


def polyt_filter(spark, sf_dir):
    return fx.tuples(spark, sf_dir).select("record_id", within_poly_t(F.substring("seq1", 15, 5)).alias("keep"))


def value_filter(spark, sf_dir):
    """A barcode with listed values: reads whose barcode is none of them or next to one go; the header keeps the raw one."""
    e = F.col("event_id")
    cb2 = F.when(e % 3 == 0, "CATAACTG").when(e % 3 == 1, F.concat(F.lit("GGAGGTA"), fx.bc(e, 1))).otherwise(fx.bc(e, 8))
    q = lambda c: F.repeat(F.lit("F"), F.length(c))
    reads = fx.table(spark, sf_dir, "events").select(e.alias("record_id"), F.lit("r").alias("name3"), fx.bc(F.col("user_id"), 8).alias("seq1"), cb2.alias("seq2"), F.lit("ACGT").alias("seq3"), F.concat(fx.bc(e, 8), fx.bc(e + 1, 6)).alias("seq4"))
    reads = reads.select("*", *(q(f"seq{k}").alias(f"qual{k}") for k in (1, 2, 3, 4)))
    return R.kept(R.parse_reads(reads, compile_template(STRUCTURES["InDrop"]))).select("record_id", "cb_raw", "cb", "umi")


def _barcodes(spark, sf_dir) -> DataFrame:
    """Observed: composites of two components of 6, of part keys; the suppliers' are known."""
    p = F.col("p_partkey")
    return fx.table(spark, sf_dir, "part").select(p.alias("id"), fx.bc(p, 6).alias("barcode"), F.concat_ws("-", fx.bc(p % 50, 6), fx.bc(p, 5)).alias("composite"))


def n_filter(spark, sf_dir):
    rows = fx.alignments(spark, sf_dir).transform(M.parse_names).select("cb").distinct()
    n = lambda k: count_base(F.split("cb", "-")[k], "N").cast("long")
    return rows.select("cb", n(0).alias("n1"), n(1).alias("n2"), passes_n_rule(F.col("cb")).alias("keep"))


def umi_filter(spark, sf_dir):
    rows = fx.alignments(spark, sf_dir).transform(M.parse_names).select("umi").distinct()
    return rows.select("umi", ((count_base(F.col("umi"), "N") == 0) & ~is_homopolymer(F.col("umi"))).alias("keep"))


def uniform_filter(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, "GGGG-ACGT").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("ACGT-"), fx.bc(F.col("p_partkey"), 4))).otherwise("NNNN-AC").alias("cb"), F.col("p_partkey").alias("cb_count"))
    return C.drop_uniform(rows)


def fuzzy_correct(spark, sf_dir):
    rows = _barcodes(spark, sf_dir)
    return Z.correct(rows.select("id", "barcode"), "barcode", fx.known_barcodes(spark, sf_dir).select("barcode"))


def fuzzy_constrained(spark, sf_dir):
    rows = _barcodes(spark, sf_dir)
    return Z.correct_constrained(rows.select("id", "composite"), "composite", fx.known_barcodes(spark, sf_dir).select("composite"))


def composite_correct(spark, sf_dir):
    rows = _barcodes(spark, sf_dir)
    return Z.correct_components(rows.select("id", "composite"), "composite", [None, fx.known_barcodes(spark, sf_dir).select(F.split("composite", "-")[1].alias("barcode"))])


def near_pairs(spark, sf_dir):
    return Z.near_pairs(_barcodes(spark, sf_dir))


def component_index(spark, sf_dir):
    index = Z.component_index(_barcodes(spark, sf_dir), "composite")
    return index.select(F.col("position").cast("long").alias("position"), "component", F.array_join("composites", ",").alias("composites"))


def primer_merge(spark, sf_dir):
    pairs = fx.table(spark, sf_dir, "part").select(fx.bc(F.col("p_partkey"), 4).alias("dt"), fx.bc(F.col("p_partkey") + 1000, 4).alias("random"))
    return Z.merge_primers(pairs)


def _reads(spark, sf_dir) -> DataFrame:
    parsed = M.parse_names(fx.alignments(spark, sf_dir))
    return M.reads(parsed, fx.gene_map(spark), fx.cell_map(parsed), by="read")


def umi_runs(spark, sf_dir):
    runs = M.read_runs(fx.alignments(spark, sf_dir).select("aln_id", "qname"))
    return runs.select("aln_id", F.col("run").cast("long").alias("run"))


def molecule_counts(spark, sf_dir):
    return M.molecules(_reads(spark, sf_dir))


def reads_per_cell(spark, sf_dir):
    return M.reads_per_cell(_reads(spark, sf_dir))


def map_info(spark, sf_dir):
    return M.map_info(_reads(spark, sf_dir))


def gene_join(spark, sf_dir):
    rows = fx.alignments(spark, sf_dir).select("aln_id", F.coalesce("xt", "reference_name").alias("feature"))
    return Z.lookup(rows, "feature", fx.gene_map(spark), "gene_id", "gene")


def depth_filter(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 30000).alias("depth"))
    return M.passing_depth(rows)


def _intervals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o, p = F.col("o_orderkey"), F.col("p_partkey")
    aln = fx.table(spark, sf_dir, "orders").select(o.alias("aln_id"), F.concat(F.lit("c"), (o % 3).cast("string")).alias("chrom"), (o * 97 % 200000).alias("start"), (o * 97 % 200000 + 90).alias("end"), F.when(o % 2 == 0, "+").otherwise("-").alias("strand"), (1 + (o % 5 == 0).cast("int")).alias("nh"))
    exon = fx.table(spark, sf_dir, "part").select(F.concat(F.lit("g"), (p % 400).cast("string")).alias("gene_id"), F.concat(F.lit("c"), (p % 3).cast("string")).alias("chrom"), (p * 211 % 200000).alias("start"), (p * 211 % 200000 + 100 + p % 7 * 3000).alias("end"), F.when(p % 4 < 2, "+").otherwise("-").alias("strand"))
    return aln, exon


def range_annotate(spark, sf_dir):
    aln, exon = _intervals(spark, sf_dir)
    return A.annotate(aln, exon).select("aln_id", "xt", "xs")


def umi_collapse(spark, sf_dir):
    return collapse_umis(fx.molecules(spark, sf_dir))


def read_counts(spark, sf_dir):
    return X.read_counts(collapse_umis(fx.molecules(spark, sf_dir)))


def transcript_counts(spark, sf_dir):
    return X.transcript_counts(collapse_umis(fx.molecules(spark, sf_dir)))


def deep_transcript_counts(spark, sf_dir):
    return X.transcript_counts(collapse_umis(fx.molecules(spark, sf_dir)), 5)


def padded_matrix(spark, sf_dir):
    mol = fx.molecules(spark, sf_dir)
    some = mol.filter("gene <> 'G3'").filter("cell < 'C'")
    return X.padded(X.read_counts(some), mol.select("gene").distinct(), some.select("cell").distinct())


def mtx_coords(spark, sf_dir):
    mol = fx.molecules(spark, sf_dir)
    done = X.coordinates(X.transcript_counts(mol, 5), X.gene_axis(M.features(mol)), X.cell_axis(mol, 5))
    return done.select(F.col("gene_idx").cast("long").alias("gene_idx"), F.col("cell_idx").cast("long").alias("cell_idx"), "count")


def knee_curve(spark, sf_dir):
    return C.knee_data(fx.skewed_counts(spark, sf_dir)).select("cb", "cb_count", F.col("rank").cast("long").alias("rank"), F.round("log_cumulative", 6).alias("log_cumulative"))


def cell_threshold(spark, sf_dir):
    return C.cell_threshold(fx.skewed_counts(spark, sf_dir)).select(F.col("n_top").cast("long").alias("n_top"), F.round("threshold", 6).alias("threshold"))


def called_cells(spark, sf_dir):
    return C.call_cells(fx.skewed_counts(spark, sf_dir), 700)


def forced_cells(spark, sf_dir):
    return C.call_cells(fx.skewed_counts(spark, sf_dir), 100, force_cell=True)


def whitelist_remove(spark, sf_dir):
    """Whitelist entries next to a shortened barcode whose last base is masked."""
    rows = _barcodes(spark, sf_dir)
    masked = fx.known_barcodes(spark, sf_dir).select(F.explode(Z.neighbours(F.concat(F.substring("barcode", 1, 5), F.lit("N")))).alias("barcode")).distinct()
    return rows.select("barcode").distinct().join(masked, "barcode", "left_semi")


def detected_cells(spark, sf_dir):
    return C.detected(_barcodes(spark, sf_dir).select(F.col("barcode").alias("cb")), fx.known_barcodes(spark, sf_dir).select(F.col("barcode").alias("cb")))


def _part_counts(spark, sf_dir) -> DataFrame:
    return _barcodes(spark, sf_dir).groupBy(F.col("barcode").alias("cb")).agg(F.sum(F.col("id") % 13 + 1).alias("cb_count"))


def greedy_merge(spark, sf_dir):
    return C.greedy_merge(_part_counts(spark, sf_dir))


def greedy_absorb(spark, sf_dir):
    return C.greedy_absorb(_part_counts(spark, sf_dir))


def refined_cells(spark, sf_dir):
    """Barcodes that pass the N rule, corrected in their second component."""
    known = fx.known_barcodes(spark, sf_dir).select(F.split("composite", "-")[1].alias("barcode"))
    return C.refine(fx.flagged_counts(spark, sf_dir), [None, known])


def refined_barcodes(spark, sf_dir):
    return refined_cells(spark, sf_dir).select("cb", "cb_count", "corrected")


def regrouped_counts(spark, sf_dir):
    done = C.regroup(refined_cells(spark, sf_dir))
    return done.select("cb", "cb_count", F.col("t_count")[0].alias("t1"), F.col("t_count")[1].alias("t2"))


def _simple_counts(spark, sf_dir) -> DataFrame:
    """Barcodes of one component, with T counts of which some are flagged."""
    k = F.col("p_partkey")
    rows = fx.table(spark, sf_dir, "part").groupBy(fx.bc(k, 6).alias("cb")).agg(F.sum(k % 13 + 10).alias("cb_count"), F.min(k).alias("k"))
    t = F.floor(F.col("cb_count") * F.when(F.col("k") % 5 == 0, 9).otherwise(3) / 10).cast("long")
    return rows.select("cb", "cb_count", F.array(t, F.floor(F.col("cb_count") / 2).cast("long")).alias("t_count"))


def merged_whitelist(spark, sf_dir):
    """What merging keeps, and which of it is to be removed."""
    listed, removed = C.merge_deleted(_simple_counts(spark, sf_dir), True)
    return listed.select("cb", F.lit("listed").alias("kind")).union(removed.select("cb", F.lit("removed")))


def candidate_cells(spark, sf_dir):
    """From raw counts to detected cells, with a candidate file for the second component."""
    known = fx.known_barcodes(spark, sf_dir).select(F.split("composite", "-")[1].alias("barcode"))
    listed, removed = C.candidates(fx.flagged_counts(spark, sf_dir).filter("cb IS NOT NULL"), [None, known], 150)
    return C.detected(listed, removed)


def chosen_correction(spark, sf_dir):
    """Observed composite barcodes corrected to a whitelist file of composites."""
    path = f"{_folder(spark)}/whitelist"
    fx.known_barcodes(spark, sf_dir).select("composite").distinct().write.text(path)
    done, _, _ = W.cell_map(spark, _barcodes(spark, sf_dir).select(F.col("composite").alias("cb")), None, [], path)
    return done.select("cb", "cell")


# -- files: written to the shared folder, read back


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _mate_file(spark, sf_dir, path: str, mate: int) -> DataFrame:
    rows = fx.tuples(spark, sf_dir).select("record_id", F.concat_ws("\n", F.concat(F.lit("@"), f"name{mate}"), f"seq{mate}", F.lit("+"), f"qual{mate}").alias("value"))
    rows.repartitionByRange(4, "record_id").sortWithinPartitions("record_id").select("value").write.option("compression", "gzip").text(path)
    return Q.read_fastq_lines(spark, path)


def fastq_scan(spark, sf_dir):
    return _mate_file(spark, sf_dir, f"{_folder(spark)}/r1", 1).select("record_id", "name", "seq", "qual")


def mate_scan(spark, sf_dir):
    """Two mate files, met by record."""
    folder = _folder(spark)
    joined = R.join_mates([_mate_file(spark, sf_dir, f"{folder}/r{m}", m) for m in (1, 2)])
    return joined.select("record_id", "name1", "seq1", "seq2")


def sam_scan(spark, sf_dir):
    rows = fx.alignments(spark, sf_dir)
    flag = F.when(F.col("is_unmapped"), "4").otherwise("0")
    tags = F.concat_ws("\t", F.concat(F.lit("NH:i:"), F.col("nh").cast("string")), F.concat(F.lit("XT:Z:"), "xt"), F.concat(F.lit("XS:Z:"), "xs"))
    lines = rows.select(F.concat_ws("\t", "qname", flag, "reference_name", (F.col("aln_id") % 1000 + 1).cast("string"), F.lit("255"), F.lit("20M5N10M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("FFFF"), tags).alias("value"))
    path = f"{_folder(spark)}/alignments.sam"
    spark.createDataFrame([("@HD\tVN:1.6",)], "value string").coalesce(1).union(lines).write.text(path)
    done = A2.read_sam(spark, path)
    return done.groupBy("qname", "is_unmapped", "reference_name", "strand", "nh", "xt", "xs", "start", "end").agg(F.count("*").alias("n"))


def gtf_genes(spark, sf_dir):
    p = F.col("p_partkey")
    attributes = F.concat(F.lit('gene_id "id'), p.cast("string"), F.when(p % 7 == 0, F.lit('";')).otherwise(F.concat(F.lit('"; gene_name "n'), (p % 50).cast("string"), F.lit('";'))))
    kind = F.when(p % 3 == 0, "exon").otherwise("gene")
    lines = fx.table(spark, sf_dir, "part").select(F.concat_ws("\t", F.lit("chr1"), F.lit("x"), kind, p.cast("string"), (p + 10).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes).alias("value"))
    path = f"{_folder(spark)}/genes.gtf"
    spark.createDataFrame([("# a comment",)], "value string").coalesce(1).union(lines).write.text(path)
    return G.gene_map(G.read_gtf(spark, path))


def barcode_file(spark, sf_dir):
    path = f"{_folder(spark)}/barcodes.tsv"
    fx.known_barcodes(spark, sf_dir).select(F.concat("barcode", F.lit(" "))).write.text(path)
    return T.read_barcodes(spark, path)


def count_table(spark, sf_dir):
    """Barcode counts written as a table with header and read again."""
    path = f"{_folder(spark)}/counts.tsv"
    R.wide_counts(_counts(spark, sf_dir), TEMPLATE_UMI).write.csv(path, sep="\t", header=True)
    done = R.long_counts(T.read_counts(spark, path))
    return done.select("cb", "cb_count", *(F.col("t_count")[i].alias(f"t{i + 1}") for i in range(TEMPLATE_UMI)))


def molecule_store(spark, sf_dir):
    """A store written and read again: molecules, and a row for each other table's size."""
    mol = fx.molecules(spark, sf_dir)
    path = f"{_folder(spark)}/store"
    cells = mol.groupBy("cell").agg(F.sum("depth").alias("n_read"))
    T.write_store(path, molecular_info=mol.orderBy("cell", "gene", "umi"), map_info=cells.agg(F.count("*").alias("value")).select(F.lit("num_cell").alias("metric"), "value"), feature=M.features(mol), read_in_cell=cells)
    tables = T.read_store(spark, path)
    named = lambda name: tables[name].agg(F.count("*").alias("depth")).select(F.lit(name).alias("cell"), F.lit("").alias("gene"), F.lit("").alias("umi"), "depth")
    return tables["molecular_info"].select("cell", "gene", "umi", "depth").union(named("feature")).union(named("read_in_cell"))


def packaged_expression(spark, sf_dir):
    """A wide table of samples by genes, as analysis packages ship it, written and read into long form."""
    path = f"{_folder(spark)}/expr.csv"
    fx.expression(spark, sf_dir).groupBy("sample").pivot("gene").agg(F.first("value")).write.csv(path, header=True)
    return P.read_wide(spark, path)


def _some_molecules(spark, sf_dir) -> DataFrame:
    return fx.molecules(spark, sf_dir)


def down_sample(spark, sf_dir):
    return S.down_sample_to(_some_molecules(spark, sf_dir), 5000, seed=3)


def down_sample_cell(spark, sf_dir):
    mol = _some_molecules(spark, sf_dir)
    reads = mol.groupBy("cell").agg((F.sum("depth") + 10).alias("n_read"))
    return S.down_sample_cells(mol, reads, 500)


def choose_cells(spark, sf_dir):
    mol = fx.molecules(spark, sf_dir)
    cells = mol.select("cell").distinct()
    return M.choose_cells(mol, cells.filter("cell < 'G'"), cells.filter("cell LIKE 'A%'"))


def gene_name_reset(spark, sf_dir):
    genes = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("E"), F.col("p_partkey").cast("string"), F.lit("_"), F.regexp_replace("p_name", " ", "_")).alias("gene"))
    return K.reset_gene_names(genes)


# -- cells, clusters and markers


def _matrix(spark, sf_dir) -> DataFrame:
    return X.read_counts(fx.molecules(spark, sf_dir))


def _clusters(spark, sf_dir) -> DataFrame:
    """Cells by their supplier's nation, four clusters."""
    rows = fx.table(spark, sf_dir, "supplier").select(fx.bc(F.col("s_suppkey"), 6).alias("cell"), F.concat(F.lit("c"), (F.col("s_nationkey") % 4).cast("string")).alias("cluster"))
    return rows.groupBy("cell").agg(F.min("cluster").alias("cluster"))


MARKERS = [("T", "G0", "+"), ("T", "G1", "-"), ("B", "G2", "+"), ("B", "G3", "+"), ("B", "G4", "-"), ("N", "G5", "-"), ("M", "G6", "+")]


def _markers(spark) -> DataFrame:
    return spark.createDataFrame(MARKERS, "cell_type string, gene string, sign string")


def _scores(spark, sf_dir) -> DataFrame:
    return K.marker_scores(_matrix(spark, sf_dir), _markers(spark)).withColumn("score", F.round("score", 9))


def marker_score(spark, sf_dir):
    return K.marker_scores(_matrix(spark, sf_dir), _markers(spark)).select("cell", "cell_type", F.round("score", 6).alias("score"))


def marker_auc(spark, sf_dir):
    return K.cluster_auc(_scores(spark, sf_dir), _clusters(spark, sf_dir)).select("cell_type", "cluster", F.round("auc", 6).alias("auc"))


def rank_auc(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("score"), (F.col("l_linestatus") == "O").alias("label"))
    return K.rank_auc(rows, ["l_returnflag"]).select("l_returnflag", F.round("auc", 6).alias("auc"))


def assign_cluster(spark, sf_dir):
    auc = K.cluster_auc(_scores(spark, sf_dir), _clusters(spark, sf_dir)).withColumn("auc", F.round("auc", 6))
    return K.assign_clusters(auc)


def merged_auc(spark, sf_dir):
    scores, clusters = _scores(spark, sf_dir), _clusters(spark, sf_dir)
    assigned = K.assign_clusters(K.cluster_auc(scores, clusters).withColumn("auc", F.round("auc", 6)))
    return K.merged_auc(scores, clusters, assigned).select("cell_type", F.round("auc", 6).alias("auc"))


def average_auc(spark, sf_dir):
    auc = K.cluster_auc(_scores(spark, sf_dir), _clusters(spark, sf_dir)).withColumn("auc", F.round("auc", 6))
    return K.average_auc(K.assign_clusters(auc)).select(F.round("score", 6).alias("score"))


def annotate_clusters(spark, sf_dir):
    auc, _ = K.annotate_clusters(_matrix(spark, sf_dir), _clusters(spark, sf_dir), _markers(spark))
    return auc


def split_markers(spark, sf_dir):
    p = F.col("p_partkey")
    rows = fx.table(spark, sf_dir, "part").select(F.concat(F.lit("t"), (p % 7).cast("string")).alias("cell_type"), F.concat(F.lit("A-"), (p % 31).cast("string"), F.when(p % 5 == 0, "-").otherwise("+")).alias("marker"))
    return K.split_markers(rows)


def top_markers(spark, sf_dir):
    o = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    tests = fx.table(spark, sf_dir, "lineitem").select(
        o.alias("pos"), F.concat(F.lit("k"), (F.col("l_suppkey") % 9).cast("string")).alias("cluster"),
        F.when(F.col("l_partkey") % 6 == 0, "RPL1").when(F.col("l_partkey") % 11 == 0, "MALAT1").otherwise(F.concat(F.lit("GENE"), F.col("l_partkey").cast("string"))).alias("gene"),
        F.col("l_discount").alias("p_val_adj"), (F.col("l_quantity") / 50).alias("pct_1"), F.col("l_tax").alias("pct_2"),
    )
    return K.top_marker_clusters(tests).select("cluster", F.round("ratio", 6).alias("ratio"))


def mito_filter(spark, sf_dir):
    kept = L.mito_filter(_matrix(spark, sf_dir), pattern="^G[01]$")
    return kept.select("cell", "total", F.round("ratio", 9).alias("ratio"))


def mito_ratio(spark, sf_dir):
    named = _matrix(spark, sf_dir).withColumn("gene", F.when(F.col("gene").isin("G7", "G8"), F.concat(F.lit("MT-"), F.col("gene"))).otherwise(F.col("gene")))
    return L.mito_ratio(named).select("cell", "total", F.round("ratio", 9).alias("ratio"))


def low_count_filter(spark, sf_dir):
    counts = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("cell")).agg(F.sum(F.col("o_totalprice")).alias("count"))
    return L.low_count_filter(counts)


def log_normalised(spark, sf_dir):
    return U.normalise(_matrix(spark, sf_dir)).select("cell", "gene", F.round("value", 6).alias("value"))


def expressed_cells(spark, sf_dir):
    rows = X.read_counts(fx.molecules(spark, sf_dir).filter("depth > 14"))
    return U.expressed(rows, 60, 8)


def rank_sum_tests(spark, sf_dir):
    found = U.rank_sum_tests(U.normalise(_matrix(spark, sf_dir)), _clusters(spark, sf_dir), 0.0, -10.0)
    return found.select("cluster", "gene", F.round("z", 5).alias("z"), F.round("pct_1", 6).alias("pct_1"), F.round("pct_2", 6).alias("pct_2"))


def cluster_cells(spark, sf_dir):
    return U.cluster_cells(_matrix(spark, sf_dir), 0.4, 4, min_cells=1, neighbours=10, rounds=4, levels=2).select("cell", "cluster")


# -- expression, networks and mutations


def gene_set_intersection(spark, sf_dir):
    """Genes with expression that are also mutated."""
    return fx.expression(spark, sf_dir).select("gene").distinct().join(_mutations(spark, sf_dir).select(F.col("hgnc_symbol").alias("gene")).distinct(), "gene", "left_semi")


def na_fraction(spark, sf_dir):
    holes = F.when((F.length("sample") + F.length("gene") + F.floor("value").cast("int")) % 3 == 0, None).otherwise(F.col("value"))
    return E.missing_share(fx.expression(spark, sf_dir).withColumn("value", holes))


def quantile_norm(spark, sf_dir):
    return E.quantile_normalise(fx.expression(spark, sf_dir)).select("sample", "gene", F.round("value", 4).alias("value"))


def ideal_fourths(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("gene"), F.col("o_totalprice").alias("value"))
    return E.ideal_fourths(rows, "gene").select("gene", "n", F.round("ql", 4).alias("ql"), F.round("qu", 4).alias("qu"))


def boxplot_outliers(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("gene"), F.pow("l_extendedprice", F.lit(9.0)).alias("value"))
    return E.boxplot_outliers(rows, "gene").select("l_orderkey", "l_linenumber", "gene")


def _mutations(spark, sf_dir) -> DataFrame:
    o = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("HOMD", "HLAMP", "MISSENSE", "NONSENSE", "FRAMESHIFT", "SYNONYMOUS", "SPLICE")))
    rows = fx.table(spark, sf_dir, "orders")
    return rows.select(F.concat(F.lit("P"), (o % 25).cast("string")).alias("sample"), F.concat(F.lit("M"), (1 + o % 997).cast("string")).alias("hgnc_symbol"), kinds[(o % 7).cast("int")].alias("variant_type"))


def complex_mutation(spark, sf_dir):
    return E.recode_complex(_mutations(spark, sf_dir)).groupBy("sample", "hgnc_symbol", "variant_type").agg(F.count("*").alias("n"))


def strong_mutations(spark, sf_dir):
    return E.strong_mutations(_mutations(spark, sf_dir), fx.expression(spark, sf_dir)).distinct()


def _edges(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    rows = fx.table(spark, sf_dir, "part").select(F.concat(F.lit("M"), (1 + p % 12).cast("string")).alias("gene"), F.concat(F.lit("M"), (1 + (F.floor(p / 12)) % 12).cast("string")).alias("neighbour"), ((p * 37 % 100) / 100.0).alias("weight"))
    return rows.groupBy("gene", "neighbour").agg(F.max("weight").alias("weight"))


def top_edges(spark, sf_dir):
    return N.top_edges(_edges(spark, sf_dir).filter("weight >= 0.4 AND gene <> neighbour"), 5, 8)


def network_filter(spark, sf_dir):
    weights = fx.table(spark, sf_dir, "nation").select(F.concat(F.lit("M"), (F.col("n_nationkey") + 1).cast("string")).alias("gene"), (F.col("n_nationkey") % 4 / 4.0 + 0.2).alias("weight"))
    return N.filter_by_weight(_edges(spark, sf_dir), weights, 0.4, 0.4, 2, 5)


def network_expansion(spark, sf_dir):
    return N.expand(_mutations(spark, sf_dir).select(F.col("hgnc_symbol").alias("gene")), _edges(spark, sf_dir), fx.expression(spark, sf_dir))


def bh_adjust(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("gene"), (F.col("l_extendedprice") / 200000 * (F.col("l_discount") + 0.01)).alias("p"))
    return N.adjust(rows, ["gene"]).select("l_orderkey", "l_linenumber", F.round("q", 6).alias("q"))


def z_scores(spark, sf_dir):
    return E.z_scores(fx.expression(spark, sf_dir), "gene", 1.5).select("sample", "gene", F.round("value", 5).alias("value"))


def expression_distribution(spark, sf_dir):
    return E.distributions(fx.expression(spark, sf_dir), _mutations(spark, sf_dir)).select("gene", "sample", "p_down", "p_neutral", "p_up")


def gauss_mixture(spark, sf_dir):
    return E.distributions(fx.expression(spark, sf_dir), None, "gauss").select("gene", "share", "mu", "sigma", "aic", "bic").distinct()


def student_mixture(spark, sf_dir):
    return E.distributions(fx.expression(spark, sf_dir)).select("gene", "share", "mu", "sigma", "nu", "aic", "bic").distinct()


def regulation_heatmap(spark, sf_dir):
    return E.heatmap_data(fx.densities(spark, sf_dir)).select("gene", "sample", F.round("value", 6).alias("value"))


def heatmap_order(spark, sf_dir):
    return E.heatmap_order(E.heatmap_data(fx.densities(spark, sf_dir)))


GAUSS = {"share": [0.2, 0.5, 0.3], "mu": [-1.0, 0.0, 1.5], "sigma": [0.8, 0.5, 1.2]}
STUDENT = GAUSS | {"nu": [4.0, 4.0, 4.0]}


def _standard(spark, sf_dir) -> DataFrame:
    return E.z_scores(fx.expression(spark, sf_dir), "gene")


def gauss_e_step(spark, sf_dir):
    done = B.posteriors(_standard(spark, sf_dir), GAUSS)
    return done.select("sample", "gene", *(F.round(F.col("posterior")[k], 6).alias(f"p{k}") for k in range(3)))


def student_e_step(spark, sf_dir):
    done = B.posteriors(_standard(spark, sf_dir), STUDENT)
    return done.select("sample", "gene", *(F.round(F.col("posterior")[k], 6).alias(f"p{k}") for k in range(3)))


def expression_weights(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample"), (F.col("l_partkey") % 200).cast("string").alias("gene"), F.pow(F.log("l_extendedprice"), 1 + F.col("l_partkey") % 200 % 3 / 10).alias("value"))
    return E.expression_weights(rows)


def impute_knn(spark, sf_dir):
    holes = F.when((F.length("sample") + F.length("gene") + F.floor("value").cast("int")) % 7 == 0, None).otherwise(F.col("value"))
    return E.impute_knn(fx.expression(spark, sf_dir).withColumn("value", holes), 3, block=5).select("sample", "gene", F.round("value", 4).alias("value"))


def flat_copy_number(spark, sf_dir):
    """Genes whose copy number doesn't change lose their median."""
    expr = fx.expression(spark, sf_dir)
    done = E.remove_copy_number(expr, expr.select("sample", "gene", F.lit(0.0).alias("value")))
    return done.select("sample", "gene", F.round("value", 4).alias("value"))


def copy_number_residuals(spark, sf_dir):
    expr = fx.expression(spark, sf_dir)
    return E.remove_copy_number(expr, expr.select("sample", "gene", (F.floor("value") % 5 - 2.0).alias("value")))


def differential_edges(spark, sf_dir):
    return N.differential_edges(_edges(spark, sf_dir).filter("gene <> neighbour"), fx.expression(spark, sf_dir), _mutations(spark, sf_dir))


def edge_tests(spark, sf_dir):
    done = N.edge_tests(_edges(spark, sf_dir).filter("gene <> neighbour"), fx.expression(spark, sf_dir), _mutations(spark, sf_dir))
    return done.select("gene", "neighbour", "n1", "n0", F.round("difference", 1).alias("difference"), F.round(F.col("s2") / 1000, 1).alias("s2"))


def driver_posterior(spark, sf_dir):
    expr, mut, edges = fx.expression(spark, sf_dir), _mutations(spark, sf_dir), _edges(spark, sf_dir).filter("gene <> neighbour")
    dist = checkpointed(E.distributions(expr, mut))
    tables = D.set_priors(dist, mut, edges, cis=False)
    data = D.evidence(dist, expr, mut, edges)
    learned, _ = D.learn(data, tables, rounds=5)
    return D.posterior_table(D.infer(data, learned))


def driver_evidence(spark, sf_dir):
    expr, mut = fx.expression(spark, sf_dir), _mutations(spark, sf_dir)
    done = D.evidence(fx.densities(spark, sf_dir), expr, mut, _edges(spark, sf_dir).filter("gene <> neighbour"))
    return done.select("gene", "sample", "neighbour", *(F.round(c, 6).alias(c) for c in ("p_down", "p_neutral", "p_up", "h")))


def driver_e_step(spark, sf_dir):
    """One exact inference with given tables: how likely each gene drives, and each of its mutations has an effect."""
    data = D.evidence(fx.densities(spark, sf_dir), fx.expression(spark, sf_dir), _mutations(spark, sf_dir), _edges(spark, sf_dir).filter("gene <> neighbour"))
    one = np.ones
    tables = D.Tables(np.array([0.7, 0.3]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.2, 0.6, 0.2], [0.6, 0.2, 0.2], [0.1, 0.3, 0.6]]), one(2), one((2, 2)), one((3, 3)), 0.6)
    done = D.posterior_table(D.infer(data, tables))
    return done.select("sample", "hgnc_symbol", F.round("p_effect", 5).alias("p_effect"), F.round("p_driver", 5).alias("p_driver"))


def driver_priors(spark, sf_dir):
    """The starting table of expression states, from the genes' shares."""
    t = D.set_priors(fx.densities(spark, sf_dir), _mutations(spark, sf_dir), None)
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(t.p_fg)], "state long, p_down double, p_neutral double, p_up double").select("state", *(F.round(c, 6).alias(c) for c in ("p_down", "p_neutral", "p_up")))


def integrated_prior(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), (1 + F.col("p_partkey") % 17).cast("double").alias("b0"), (2 + F.col("p_partkey") % 5).cast("double").alias("b1"))
    return D.integrated_prior(rows).select("gene", F.round("log_p0", 6).alias("log_p0"), F.round("log_p1", 6).alias("log_p1"))


def replicated_tables(spark, sf_dir):
    shared = spark.createDataFrame([("none", 0.9, 0.1), ("effect", 0.2, 0.8)], "state string, p0 double, p1 double")
    return D.replicated(shared, fx.table(spark, sf_dir, "part"), "p_partkey")


def dirichlet_draws(spark, sf_dir):
    return D.dirichlet_draws(fx.table(spark, sf_dir, "part"), [2.0, 5.0, 1.0], 3, "p_partkey")


def trimmed_values(spark, sf_dir):
    """Text without white space at its ends, and whether a nested value is missing."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), "p_name", F.lit("\t"))).otherwise(F.col("p_name"))
    nested = F.when(F.col("p_partkey") % 4 == 0, F.array().cast("array<struct<a:int,b:array<string>>>")).when(F.col("p_partkey") % 4 == 1, F.expr("array(named_struct('a', cast(null as int), 'b', array(cast(null as string))))")).when(F.col("p_partkey") % 4 == 2, F.expr("array(named_struct('a', 1, 'b', array(cast(null as string))))"))
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), nested.alias("nested"))
    return rows.select("p_partkey", V.trimmed(F.col("name")).alias("name"), V.is_missing(F.col("nested"), rows.schema["nested"].dataType).alias("missing"))


def cluster_sizes(spark, sf_dir):
    return U.cluster_sizes(_clusters(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        parsed_reads, read_filter_metrics, barcode_counts, merged_barcode_counts, top_barcodes, t_frequency, indel_flags, tagged_fastq, polyt_filter, value_filter,
        n_filter, umi_filter, uniform_filter, fuzzy_correct, fuzzy_constrained, composite_correct, near_pairs, component_index, primer_merge, umi_runs, molecule_counts,
        reads_per_cell, map_info, gene_join, depth_filter, range_annotate, umi_collapse, read_counts, transcript_counts, deep_transcript_counts, padded_matrix, mtx_coords,
        knee_curve, cell_threshold, called_cells, forced_cells, whitelist_remove, detected_cells, greedy_merge, greedy_absorb, down_sample, down_sample_cell, choose_cells,
        gene_name_reset, marker_score, marker_auc, rank_auc, assign_cluster, merged_auc, average_auc, annotate_clusters, split_markers, top_markers, mito_filter, mito_ratio, low_count_filter,
        log_normalised, expressed_cells, rank_sum_tests, cluster_cells, gene_set_intersection, na_fraction, quantile_norm, ideal_fourths, boxplot_outliers, complex_mutation, strong_mutations,
        top_edges, network_filter, network_expansion, bh_adjust, z_scores, expression_distribution, gauss_mixture, student_mixture, regulation_heatmap, expression_weights, impute_knn,
        copy_number_residuals, differential_edges, driver_posterior, refined_barcodes, regrouped_counts, merged_whitelist, candidate_cells, chosen_correction, fastq_scan, mate_scan, sam_scan,
        gtf_genes, barcode_file, count_table, molecule_store, packaged_expression, heatmap_order, gauss_e_step, student_e_step, flat_copy_number, edge_tests, driver_evidence, driver_e_step,
        driver_priors, integrated_prior, replicated_tables, dirichlet_draws, trimmed_values, cluster_sizes,
    )
}
