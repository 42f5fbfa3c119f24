"""SAM text and BAM readers: one row an alignment."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from glob import glob

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "aln_id long, qname string, flag int, chrom string, start long, end long, cigar string, tags array<string>"
_BASES = "MIDNSHP=X"


def shaped(raw: DataFrame, feature_tag: str = "XT:Z") -> DataFrame:
    """The columns that counting needs: of a tag such as XT:Z the first two characters are its name."""
    tag = lambda name: F.expr(f"substring(get(filter(tags, t -> startswith(t, '{name[:2]}:')), 0), 6)")
    flag = lambda bit: F.col("flag").bitwiseAND(bit) != 0
    return raw.select(
        "aln_id", "qname", flag(4).alias("is_unmapped"), F.col("chrom").alias("reference_name"), "chrom", "start", "end", F.when(flag(16), "-").otherwise("+").alias("strand"),
        tag("NH").try_cast("int").alias("nh"), tag(feature_tag).alias("xt"), tag("XS").alias("xs"),
    )


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that a CIGAR covers."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"([0-9]+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def read_sam(spark: SparkSession, path: str, feature_tag: str = "XT:Z") -> DataFrame:
    """SAM text from any store that Spark reads; aln_id is the line's number."""
    lines = spark.createDataFrame(spark.sparkContext.textFile(path).zipWithIndex(), "line string, aln_id long").filter(~F.col("line").startswith("@") & (F.col("line") != ""))
    f = F.split("line", "\t")
    start = F.get(f, F.lit(3)).try_cast("long")
    raw = lines.select("aln_id", F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).try_cast("int").alias("flag"), F.when(F.get(f, F.lit(2)) != "*", F.get(f, F.lit(2))).alias("chrom"), start.alias("start"), (start + F.greatest(reference_length(F.get(f, F.lit(5))), F.lit(1)) - 1).alias("end"), F.slice(f, 12, 100000).alias("tags"))
    return shaped(raw, feature_tag)


def bam_records(stream) -> Iterator[tuple]:
    """Records of a decompressed BAM stream (the public format: header, references, then blocks)."""
    if stream.read(4) != b"BAM\x01":
        raise ValueError("not a BAM stream")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        names.append(stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode())
        stream.read(4)
    k = 0
    while head := stream.read(4):
        block = stream.read(struct.unpack("<i", head)[0])
        ref, pos, l_name, _, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", block)
        at = 32
        qname = block[at : at + l_name - 1].decode()
        at += l_name
        ops = struct.unpack_from(f"<{n_cigar}I", block, at)
        at += 4 * n_cigar + (l_seq + 1) // 2 + l_seq
        covered = sum(x >> 4 for x in ops if _BASES[x & 15] in "MDN=X")
        cigar = "".join(f"{x >> 4}{_BASES[x & 15]}" for x in ops) or "*"
        yield k, qname, flag, names[ref] if ref >= 0 else None, pos + 1, pos + max(covered, 1), cigar, list(_bam_tags(block, at))
        k += 1


def _bam_tags(block: bytes, at: int) -> Iterator[str]:
    sizes = {"c": ("<b", 1), "C": ("<B", 1), "s": ("<h", 2), "S": ("<H", 2), "i": ("<i", 4), "I": ("<I", 4), "f": ("<f", 4)}
    while at < len(block):
        name, kind = block[at : at + 2].decode(), chr(block[at + 2])
        at += 3
        if kind == "A":
            yield f"{name}:A:{chr(block[at])}"
            at += 1
        elif kind in "ZH":
            end = block.index(0, at)
            yield f"{name}:{kind}:{block[at:end].decode()}"
            at = end + 1
        elif kind == "B":
            sub, n = chr(block[at]), struct.unpack_from("<i", block, at + 1)[0]
            at += 5 + n * sizes[sub][1]
        else:
            fmt, size = sizes[kind]
            yield f"{name}:{'f' if kind == 'f' else 'i'}:{struct.unpack_from(fmt, block, at)[0]}"
            at += size


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = sorted(glob(options["path"].removeprefix("file://")))
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with gzip.open(partition.path) as f:  # a BGZF file is a row of gzip members
            yield from bam_records(f)


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str, feature_tag: str = "XT:Z") -> DataFrame:
    """BAM files, one partition each."""
    spark.dataSource.register(BamDataSource)
    return shaped(spark.read.format("bam").load(path), feature_tag)


def read_alignments(spark: SparkSession, path: str, feature_tag: str = "XT:Z") -> DataFrame:
    """SAM or BAM by the file's name."""
    return (read_sam if path.endswith(".sam") else read_bam)(spark, path, feature_tag)
