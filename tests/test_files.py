"""File formats, commands and the stream."""

import gzip
import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from cytolith.operators import reads as R
from cytolith.operators.template import compile_template
from cytolith.plans import commands
from cytolith.sources import fastq, gtf, mtx, sam
from cytolith.streaming import barcode_stream


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fastq_reader(spark, tmp_path):
    text = "".join(f"@r{k}\nACGT{'A' * k}\n+\nFFFF{'F' * k}\n" for k in range(5))
    plain = write(tmp_path / "a.fastq", text.rstrip("\n"))
    packed = tmp_path / "a.fastq.gz"
    packed.write_bytes(gzip.compress(text.encode()))
    rows = [tuple(r) for r in fastq.read_fastq(spark, plain).orderBy("record_id").collect()]
    assert rows == [(k, f"r{k}", "ACGT" + "A" * k, "+", "FFFF" + "F" * k) for k in range(5)]
    assert [tuple(r) for r in fastq.read_fastq(spark, str(packed)).orderBy("record_id").collect()] == rows
    assert [tuple(r) for r in fastq.read_fastq_lines(spark, plain).orderBy("record_id").collect()] == rows
    with pytest.raises(ValueError):
        list(fastq.records(iter(["@a", "ACGT", "+"])))


def test_mates_stop_at_the_shortest(spark, tmp_path):
    one = write(tmp_path / "1.fastq", "".join(f"@r{k}\nA\n+\nF\n" for k in range(4)))
    two = write(tmp_path / "2.fastq", "".join(f"@r{k}\nC\n+\nF\n" for k in range(3)))
    assert R.join_mates(fastq.read_mates(spark, [one, two])).count() == 3


def bam(records):
    """A BAM file of (qname, flag, ref, pos, cigar ops, tags)."""
    out = io.BytesIO()
    out.write(b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\x00" + struct.pack("<i", 1000))
    for qname, flag, ref, pos, ops, tags in records:
        name = qname.encode() + b"\x00"
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 0, 0, len(ops), flag, 4, -1, -1, 0) + name + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(c)) for n, c in ops) + b"\x12\x48" + b"FFFF"
        for tag, kind, value in tags:
            body += tag.encode() + kind.encode() + (value.encode() + b"\x00" if kind == "Z" else struct.pack("<B" if kind == "C" else "<i", value))
        out.write(struct.pack("<i", len(body)) + body)
    return gzip.compress(out.getvalue())


def test_sam_and_bam_agree(spark, tmp_path):
    records = [("a:CB_AC:UB_GT:x", 0, 0, 9, [(4, "M")], [("NH", "C", 1), ("XT", "Z", "id1")]), ("b:CB_AC:UB_GG:y", 16, 0, 99, [(2, "M"), (50, "N"), (2, "M")], [("NH", "i", 2), ("XS", "Z", "Unassigned_Ambiguity")]), ("c", 4, -1, -1, [], [("NH", "C", 0)])]
    path = tmp_path / "x.bam"
    path.write_bytes(bam(records))
    lines = ["@HD\tVN:1.0"]
    for qname, flag, ref, pos, ops, tags in records:
        lines.append("\t".join([qname, str(flag), "chr1" if ref >= 0 else "*", str(pos + 1), "0", "".join(f"{n}{c}" for n, c in ops) or "*", "*", "0", "0", "ACGT", "FFFF", *(f"{t}:{'Z' if k == 'Z' else 'i'}:{v}" for t, k, v in tags)]))
    text = write(tmp_path / "x.sam", "\n".join(lines) + "\n")
    a, b = (sorted(map(tuple, sam.read_alignments(spark, p).drop("aln_id").collect()), key=str) for p in (str(path), text))
    assert a == b
    assert (a[1][4], a[1][5], a[1][6], a[1][7], a[1][9]) == (100, 153, "-", 2, "Unassigned_Ambiguity")


GTF = """#comment
chr1\tx\tgene\t1\t500\t.\t+\t.\tgene_id "id1"; gene_name "Old";
chr1\tx\tgene\t1\t500\t.\t+\t.\tgene_id "id1"; gene_name "ONE";
chr1\tx\texon\t1\t100\t.\t+\t.\tgene_id "id1"; gene_name "ONE";
chr1\tx\tgene\t600\t900\t.\t+\t.\tgene_id "id2"; gene_name "TWO";
chr1\tx\texon\t600\t700\t.\t+\t.\tgene_id "id2"; gene_name "TWO";
chr1\tx\tgene\t950\t990\t.\t+\t.\tgene_id "id3";
"""


@pytest.mark.parametrize("packed", [False, True])
def test_gtf_and_gene_map(spark, tmp_path, packed):
    path = tmp_path / ("a.gtf.gz" if packed else "a.gtf")
    path.write_bytes(gzip.compress(GTF.encode()) if packed else GTF.encode())
    rows = gtf.read_gtf(spark, str(path))
    assert {tuple(r) for r in gtf.gene_map(rows).collect()} == {("id1", "id1_ONE"), ("id2", "id2_TWO")}
    assert gtf.exons(rows).count() == 2


def test_matrix_market_round_trip(spark, tmp_path):
    entries = [(1, 1, 5), (3, 2, 7), (2, 4, 1)]
    coords = spark.createDataFrame(entries, "gene_idx long, cell_idx long, count long")
    axis = lambda n, c: spark.createDataFrame([(f"{c}{k}", k) for k in range(1, n + 1)], f"{c} string, {c}_idx int")
    mtx.write_mtx(coords, axis(3, "gene"), axis(4, "cell"), str(tmp_path / "m"))
    assert {tuple(r) for r in mtx.read_mtx(spark, str(tmp_path / "m.mtx")).collect()} == set(entries)
    lines = [x for p in sorted((tmp_path / "m.mtx").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[:2] == ["%%MatrixMarket matrix coordinate integer general", "3 4 3"]


def test_the_four_commands(spark, tmp_path):
    rng = random.Random(1)
    barcodes = ["".join(rng.choice("ACGT") for _ in range(12)) for _ in range(6)]
    one, two, sams = [], [], ["@HD\tVN:1.0"]
    for k in range(600):
        cb, umi = barcodes[k % 6], "".join(rng.choice("ACGT") for _ in range(8))
        one.append(f"@r{k}\n{cb}{umi}TTTTT\n+\n{'F' * 25}\n")
        two.append(f"@r{k}\n{'ACGT' * 5}\n+\n{'F' * 20}\n")
        pos = 10 if k % 3 else 610
        sams.append(f":CB_{cb}:UB_{umi}:r{k}\t0\tchr1\t{pos}\t255\t20M\t*\t0\t0\t{'ACGT' * 5}\t{'F' * 20}\tNH:i:1")
    files = [write(tmp_path / "1.fastq", "".join(one)), write(tmp_path / "2.fastq", "".join(two))]
    metrics = commands.merge_fastq(spark, files, "Drop-seq-polyT", str(tmp_path / "merged"), str(tmp_path / "counts.tsv"))
    assert {r["metric"]: r["value"] for r in metrics.collect()}["read_pass"] == 600
    annotation = write(tmp_path / "a.gtf", GTF)
    tagged = commands.tag_bam(spark, write(tmp_path / "x.sam", "\n".join(sams) + "\n"), annotation, str(tmp_path / "tagged"))
    assert {r["xt"]: r["count"] for r in tagged.groupBy("xt").count().collect()} == {"id1": 400, "id2": 200}
    store = str(tmp_path / "store")
    tables = commands.count_umi(spark, tagged, annotation, store, str(tmp_path / "out"), str(tmp_path / "counts.tsv"), expect_cell=6)
    assert tables["read_in_cell"].agg(F.sum("n_read")).first()[0] == 600
    total = tables["molecular_info"].agg(F.sum("depth")).first()[0]
    assert 590 <= total <= 600
    counts = mtx.read_mtx(spark, str(tmp_path / "out_read.mtx"))
    assert counts.agg(F.sum("count")).first()[0] == total
    assert commands.down_sample(spark, store, str(tmp_path / "down"), mean_read=(20, 50, 5000)) == [20, 50]
    assert mtx.read_mtx(spark, str(tmp_path / "down_sample_50_read.mtx")).agg(F.sum("count")).first()[0] == int(total / 600 * 300 + 0.5)
    drawn = commands.down_sample_cell(spark, store, str(tmp_path / "cells"), expect_read=50)
    assert drawn.groupBy("cell").count().count() == 6


def test_streamed_counts_equal_batch(spark, tmp_path, sf_dir):
    from cytolith.plans import fixtures

    parsed = R.kept(R.parse_reads(fixtures.tuples(spark, sf_dir), compile_template(fixtures.STRUCTURE))).select("cb", "umi")
    parsed.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = barcode_stream.stream_tuples(spark, str(tmp_path / "in"), parsed.schema)
    barcode_stream.write_counts(barcode_stream.count_barcodes(stream, 6), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["cb"]: (r["cb_count"], r["t_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["cb"]: (r["cb_count"], r["t_count"]) for r in R.barcode_counts(parsed, 6).collect()}
