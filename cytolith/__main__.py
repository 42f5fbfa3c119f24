"""Command line: python -m cytolith merge_fastq | tag_bam | count_umi | down_sample."""

from __future__ import annotations

import argparse

from .plans import commands
from .session import build_session, ship_package


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cytolith")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("merge_fastq", help="tag reads with their barcodes")
    p.add_argument("fastq", nargs="+")
    p.add_argument("--config", help="YAML of read structures; the built-in ones without it")
    p.add_argument("--method", required=True)
    p.add_argument("--fastq_out", required=True)
    p.add_argument("--cell_barcode_count", required=True)
    p = sub.add_parser("tag_bam", help="annotate alignments with genes")
    p.add_argument("bam")
    p.add_argument("--gtf", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--annotate_multi_mapping", action="store_true")
    p.add_argument("--annotate_intron", action="store_true")
    p.add_argument("--strand", type=int, default=1, choices=(0, 1, 2))
    p = sub.add_parser("count_umi", help="count molecules and write matrices")
    p.add_argument("cb", nargs="*", help="candidate barcode files, one a component; None passes a component")
    p.add_argument("--bam", required=True)
    p.add_argument("--molecular_info", required=True)
    p.add_argument("--gtf", required=True)
    p.add_argument("--cell_barcode_count")
    p.add_argument("--out_prefix")
    p.add_argument("--feature_tag", default="XT:Z")
    p.add_argument("--depth_threshold", type=int, default=1)
    p.add_argument("--expect_cell", type=int, default=3000)
    p.add_argument("--force_cell", action="store_true")
    p.add_argument("--all_cell", action="store_true")
    p.add_argument("--cell_barcode_whitelist")
    p = sub.add_parser("down_sample", help="draw a library down to fewer reads")
    p.add_argument("molecular_info")
    p.add_argument("--total_read", type=int)
    p.add_argument("--total_cell", type=int)
    p.add_argument("--out_prefix", required=True)
    p.add_argument("--mean_read", type=int, nargs="+", default=[10000])
    p.add_argument("--depth_threshold", type=int, default=1)
    p.add_argument("--seed", type=int, default=0)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session()
    ship_package(spark)
    if a.command == "merge_fastq":
        commands.merge_fastq(spark, a.fastq, a.method, a.fastq_out, a.cell_barcode_count, a.config).show()
    elif a.command == "tag_bam":
        commands.tag_bam(spark, a.bam, a.gtf, a.out, a.annotate_multi_mapping, a.annotate_intron, a.strand)
    elif a.command == "count_umi":
        rows = spark.read.parquet(a.bam) if not a.bam.endswith((".bam", ".sam")) else a.bam
        commands.count_umi(spark, rows, a.gtf, a.molecular_info, a.out_prefix or a.molecular_info, a.cell_barcode_count, a.cb, a.feature_tag, a.depth_threshold, a.expect_cell, a.force_cell, a.cell_barcode_whitelist, a.all_cell)
    else:
        print(commands.down_sample(spark, a.molecular_info, a.out_prefix, a.total_read, a.total_cell, tuple(a.mean_read), a.depth_threshold, a.seed))


if __name__ == "__main__":
    main()
