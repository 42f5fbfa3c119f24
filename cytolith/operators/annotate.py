"""Alignments to genes by overlap with exons: a range join on binned positions.

Of each alignment only none, one or several genes matter. So the annotation is cut at all ends of genes' stretches into
segments, each with the first and the last (by name) of its genes, and neighbours alike are joined: an alignment hits one
gene if the first and the last over its segments are the same. A read meets a segment or two however many exons lie there.

Exons of one gene that touch are one stretch, and a stretch is kept as blocks of powers of two, of which a place is in one
of each size, and its ends: no pairs of all segments and exons, however deep they lie. A bin of the annotation is one row with its segments,
so a read of a bin or two is looked up by a left join that needs no grouping after it, and none of its rows is shuffled
twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .molecules import AMBIGUOUS

BIN = 1 << 14
NEAR = 1 << 10  #: least width of bins that short alignments are looked up in
FAR = 1 << 12  #: and that longer ones are cut by
ENDS = 1 << 10  #: most places of a bin in which ends of stretches are met one by one
SMALL = 100_000  #: segments (about 10 MB) that every executor may hold


def _bins(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))))


def overlaps(alignments: DataFrame, annotation: DataFrame, strand: int = 1, width: int = BIN) -> DataFrame:
    """(aln_id, gene_id) of alignments (aln_id, chrom, start, end, strand) and exons (gene_id, chrom, start, end, strand).

    Positions are inclusive. strand: 0 any, 1 the same, 2 the other. An overlap is taken in the first bin that both
    share, so a pair comes once however many bins it spans; equality on (chrom, bin) keeps it a hash or merge join.
    """
    a = _bins(alignments.select("aln_id", "chrom", "start", "end", "strand"), width).alias("a")
    e = _bins(annotation.select("gene_id", "chrom", "start", "end", "strand").distinct(), width).alias("e")
    near = (F.col("a.chrom") == F.col("e.chrom")) & (F.col("a._bin") == F.col("e._bin")) & (F.col("a.start") <= F.col("e.end")) & (F.col("a.end") >= F.col("e.start"))
    once = F.col("a._bin") == F.expr(f"greatest(a.start, e.start) div {width}")
    if strand:
        near = near & ((F.col("a.strand") == F.col("e.strand")) if strand == 1 else (F.col("a.strand") != F.col("e.strand")))
    return a.join(e, near & once).select("a.aln_id", "e.gene_id").distinct()


def _like_length(df: DataFrame) -> int:
    """A power of two near the mean length of intervals: few bins an interval, few intervals a bin."""
    mean = df.agg(F.avg(F.col("end") - F.col("start") + 1)).first()[0] or 1.0
    return min(max(1 << round(math.log2(max(mean, 1.0))), 64), 1 << 20)


def _stretches(annotation: DataFrame, stranded: bool) -> DataFrame:
    """gene_id, chrom, strand, start, end: a gene's exons, those that overlap or touch as one."""
    side = F.col("strand") if stranded else F.lit(".")
    exons = annotation.select("gene_id", "chrom", side.alias("strand"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("start <= end and gene_id is not null")
    along = Window.partitionBy("chrom", "strand", "gene_id").orderBy("start", "end")  # one gene's exons
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    run = exons.withColumn("_new", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int"))
    run = run.withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("chrom", "strand", "gene_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def segments(annotation: DataFrame, stranded: bool = True) -> DataFrame:
    """chrom, strand ('.' if it doesn't matter), start, end, low, high: stretches without a change of genes, with the first and last gene by name; stretches without a gene are left out."""
    held = checkpointed(_stretches(annotation, stranded))
    ends = held.select("chrom", "strand", F.col("start").alias("at")).union(held.select("chrom", "strand", (F.col("end") + 1).alias("at"))).distinct()
    along = Window.partitionBy("chrom", "strand").orderBy("at")  # an annotation's places on one chromosome
    cut = ends.select("chrom", "strand", F.col("at").alias("start"), (F.lead("at").over(along) - 1).alias("end")).filter(F.col("end").isNotNull())
    # bins as wide as segments are on average: a stretch is whole blocks of bins, and its ends
    wide = held.groupBy("chrom", "strand").agg((F.max("end") - F.min("start") + 1).alias("span"), F.max(F.col("end") - F.col("start") + 1).alias("longest"), F.count("*").alias("n"))
    span, longest, n = wide.agg(F.sum("span"), F.max("longest"), F.sum("n")).first()
    top = (longest or 1).bit_length() - 1
    least = min((span or 1) // (2 * (n or 1)), ENDS).bit_length() - 1 if n else 0
    least = min(max(least, 0), top)
    # the fewest blocks [i * 2^k, (i + 1) * 2^k) from that size on: two of each size at most
    blocks = held.withColumn("_k", F.explode(F.sequence(F.lit(least), F.lit(top)))).withColumns({"_from": F.expr("-shiftright(-start, _k)"), "_to": F.expr("shiftright(end + 1, _k)")}).filter("_from < _to")
    blocks = blocks.select("chrom", "strand", "gene_id", "_k", F.explode(F.expr("array(if(_from % 2 <> 0, _from, null), if(_to % 2 <> 0, _to - 1, null))")).alias("_i")).filter("_i is not null")
    blocks = blocks.groupBy("chrom", "strand", "_k", "_i").agg(F.min("gene_id").alias("low"), F.max("gene_id").alias("high"), F.lit(None).cast("long").alias("_start"), F.lit(None).cast("long").alias("_end"))
    tips = held.withColumns({"_from": F.expr(f"shiftright(start, {least})"), "_to": F.expr(f"shiftright(end, {least})")})
    cut_short = f"shiftleft(_from, {least}) < start or (_from = _to and shiftright(end + 1, {least}) = _to)", f"_from < _to and shiftright(end + 1, {least}) = _to"
    tips = tips.withColumn("_i", F.explode(F.expr(f"array(if({cut_short[0]}, _from, null), if({cut_short[1]}, _to, null))"))).filter("_i is not null")
    parts = blocks.unionByName(tips.select("chrom", "strand", F.lit(-1).alias("_k"), "_i", F.col("gene_id").alias("low"), F.col("gene_id").alias("high"), F.col("start").alias("_start"), F.col("end").alias("_end")))
    # a segment lies wholly in a stretch or outside of it: its first place tells
    cut = cut.withColumn("_k", F.explode(F.concat(F.array(F.lit(-1)), F.sequence(F.lit(least), F.lit(top))))).withColumn("_i", F.expr(f"shiftright(start, greatest(_k, {least}))"))
    held_by = [cut[x] == parts[x] for x in ("chrom", "strand", "_k", "_i")] + [F.coalesce(cut["start"].between(parts["_start"], parts["_end"]), F.lit(True))]
    named = cut.join(parts, held_by).groupBy(cut["chrom"], cut["strand"], cut["start"], cut["end"]).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    order = Window.partitionBy("chrom", "strand").orderBy("start")
    same = (F.lag("end").over(order) == F.col("start") - 1) & (F.lag("low").over(order) == F.col("low")) & (F.lag("high").over(order) == F.col("high"))
    run = named.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(order))
    return run.groupBy("chrom", "strand", "_run", "low", "high").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def _side(strand: int) -> Column:
    """The strand of segments that an alignment meets."""
    return F.lit(".") if strand == 0 else F.col("strand") if strand == 1 else F.when(F.col("strand") == "+", "-").when(F.col("strand") == "-", "+")


def genes_hit(alignments: DataFrame, table: DataFrame, strand: int = 1) -> DataFrame:
    """aln_id, low, high: the first and the last gene by name that each alignment overlaps, where there is one. table: segments. strand as in overlaps."""
    width = max(_like_length(table), FAR)
    a = _bins(alignments.select("aln_id", "chrom", _side(strand).alias("strand"), "start", "end"), width).alias("a")
    s = _bins(table, width).alias("s")
    met = (F.col("a.chrom") == F.col("s.chrom")) & (F.col("a.strand") == F.col("s.strand")) & (F.col("a._bin") == F.col("s._bin")) & (F.col("a.start") <= F.col("s.end")) & (F.col("a.end") >= F.col("s.start"))
    return a.join(s, met).groupBy("a.aln_id").agg(F.min("s.low").alias("low"), F.max("s.high").alias("high"))


def _by_bin(table: DataFrame, width: int, name: str) -> DataFrame:
    """_chrom, _side, _bin and as name the segments that lie in this bin or the next."""
    seen = table.withColumn("_bin", F.explode(F.sequence(F.expr(f"start div {width} - 1"), F.expr(f"end div {width}"))))
    return seen.groupBy(F.col("chrom").alias("_chrom"), F.col("strand").alias("_side"), "_bin").agg(F.collect_list(F.struct("start", "end", "low", "high")).alias(name))


def annotate(alignments: DataFrame, annotation: DataFrame, strand: int = 1, introns: DataFrame | None = None, multi_mapping: bool = False) -> DataFrame:
    """alignments (aln_id: one a row) with xt and xs: the one gene that is hit, or the ambiguity mark if several are; else both null.

    introns: whole transcripts, tried where no exon is hit. Without multi_mapping, alignments with nh above 1 get none.
    """
    tables = [checkpointed(segments(x, strand != 0)) for x in (annotation, introns) if x is not None]
    width = max(NEAR, *map(_like_length, tables))
    names = [f"_segments{k}" for k in range(len(tables))]
    bins = _by_bin(tables[0], width, names[0])
    for t, name in zip(tables[1:], names[1:]):
        bins = bins.join(_by_bin(t, width, name), ["_chrom", "_side", "_bin"], "full")
    bins = checkpointed(bins)
    if (bins.agg(F.sum(sum(F.coalesce(F.size(x), F.lit(0)) for x in names))).first()[0] or 0) <= SMALL:
        bins = F.broadcast(bins)

    rows = alignments.drop("xt", "xs")
    counts = F.lit(True) if multi_mapping else F.coalesce("nh", F.lit(1)) <= 1
    placed = counts & F.col("chrom").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    far = F.coalesce(placed & F.expr(f"end div {width} - start div {width} > 1"), F.lit(False))
    # rows that hit nothing have no bin; their ids spread them
    near = rows.filter(~far).withColumns({"_chrom": F.when(placed, F.col("chrom")).otherwise(F.col("aln_id").cast("string")), "_side": _side(strand), "_bin": F.when(placed, F.expr(f"start div {width}"))})
    near = near.join(bins, ["_chrom", "_side", "_bin"], "left")
    near = near.withColumns({x: F.filter(x, lambda s: (s["start"] <= F.col("end")) & (s["end"] >= F.col("start"))) for x in names})
    near = near.withColumns({x: F.coalesce(*(f(F.col(name)[x]) for name in names)) for x, f in (("low", F.array_min), ("high", F.array_max))})

    columns = ["aln_id", *(c for c in rows.columns if c != "aln_id"), "low", "high"]
    out, rest = near.select(columns), rows.filter(far)
    if not rest.isEmpty():  # else a read of them less
        found = genes_hit(rest, tables[0], strand)
        for t in tables[1:]:
            found = found.unionByName(genes_hit(rest.join(found, "aln_id", "left_anti"), t, strand))
        out = out.union(rest.join(found, "aln_id", "left").select(columns))
    return out.withColumns({"xt": F.when(F.col("low") == F.col("high"), F.col("low")), "xs": F.when(F.col("low") != F.col("high"), F.lit(AMBIGUOUS))}).drop("low", "high")
