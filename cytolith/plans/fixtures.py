"""The inputs of the registered queries: the driver's tables read as barcoded sequencing data, in Spark and in SQL.

``bc(k, n)`` writes a key as a DNA string of n bases, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bc(key: Column, n: int) -> Column:
    return F.translate(F.substring(F.md5(key.cast("string")), 1, n), HEX, BASES)


def bc_sql(key: str, n: int) -> str:
    return f"translate(substr(md5(cast({key} as varchar)),1,{n}),'{HEX}','{BASES}')"


# -- read tuples from events: one barcode and UMI read with poly-T, one cDNA read
STRUCTURE = {1: {"CB1": [1, 8], "UMI": [9, 14], "polyT": [15, 19]}, 2: {"cDNA": []}}


def tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    tail = F.when(e % 5 == 0, "TTGGT").when(e % 7 == 0, "TTTGT").otherwise("TTTTT")
    seq1 = F.concat(bc(F.col("user_id"), 8), bc(e, 6), tail, F.when(e % 17 == 0, "AX").otherwise("AC"))
    seq2 = F.when(e % 11 == 0, "").otherwise(bc(e * 7, 20))
    rows = table(spark, sf_dir, "events").select(e.alias("record_id"), F.concat(F.lit("r"), e.cast("string")).alias("name1"), seq1.alias("seq1"), seq2.alias("seq2"))
    return rows.select("record_id", "name1", "seq1", F.repeat(F.lit("F"), F.length("seq1")).alias("qual1"), F.col("name1").alias("name2"), "seq2", F.repeat(F.lit("F"), F.length("seq2")).alias("qual2"))


TUPLES = f"""tuples as (select event_id as record_id,
  {bc_sql('user_id', 8)} as cb, {bc_sql('event_id', 6)} as umi,
  case when event_id % 5 = 0 then 'TTGGT' when event_id % 7 = 0 then 'TTTGT' else 'TTTTT' end as polyt,
  event_id % 17 <> 0 as fits, event_id % 11 = 0 as empty_cdna,
  case when event_id % 11 = 0 then '' else {bc_sql('event_id * 7', 20)} end as seq2 from events),
kept as (select * from tuples where fits and length(replace(polyt, 'T', '')) <= 1)"""


# -- barcodes by lineitem's parts, with a steep rank curve
def skewed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.floor(F.lit(2000).cast("double") / (1 + F.col("l_partkey") % 500).cast("double")).cast("long") + 1
    return table(spark, sf_dir, "lineitem").groupBy(bc(F.col("l_partkey"), 8).alias("cb")).agg(F.sum(share).alias("cb_count"))


SKEWED = f"""counts as (select {bc_sql('l_partkey', 8)} as cb,
  cast(sum(cast(floor(cast(2000 as double) / cast(1 + l_partkey % 500 as double)) as bigint) + 1) as bigint) as cb_count from lineitem group by 1)"""


# -- molecules from lineitem
def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(
        bc(F.col("l_suppkey"), 6).alias("cell"), F.concat(F.lit("G"), (F.col("l_partkey") % 10).cast("string")).alias("gene"), bc(F.col("l_orderkey") % 64, 4).alias("umi")
    ).agg(F.sum(F.col("l_quantity").cast("long") % 7 + 1).alias("depth"))


MOLECULES = f"""molecules as (select {bc_sql('l_suppkey', 6)} as cell, concat('G', cast(l_partkey % 10 as varchar)) as gene,
  {bc_sql('l_orderkey % 64', 4)} as umi, cast(sum(cast(l_quantity as bigint) % 7 + 1) as bigint) as depth from lineitem group by 1, 2, 3)"""

COLLAPSED = f"""{MOLECULES},
limits as (select cell, gene, greatest(least(max(depth) * cast(0.1 as double), 5), 2) as t from molecules group by 1, 2),
marked as (select m.*, m.depth > l.t as parent from molecules m join limits l using (cell, gene)),
chosen as (select n.cell, n.gene, n.umi, n.depth, p.umi as pumi,
  row_number() over (partition by n.cell, n.gene, n.umi order by p.depth desc nulls last, p.umi) as rn
  from (select * from marked where not parent) n left join (select * from marked where parent) p
  on n.cell = p.cell and n.gene = p.gene and hamming(n.umi, p.umi) <= 1),
collapsed as (select cell, gene, umi, cast(sum(depth) as bigint) as depth from
  (select cell, gene, umi, depth from marked where parent union all select cell, gene, coalesce(pumi, umi), depth from chosen where rn = 1) group by 1, 2, 3)"""


# -- alignments from lineitem: an order is a read, its items are its alignments
def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("l_orderkey")
    cb = F.concat_ws("-", bc(o % 40, 6), F.when(o % 9 == 0, F.concat(bc(o % 7, 4), F.lit("NN"))).otherwise(bc(o % 7, 6)))
    umi = F.when(o % 23 == 0, "AAAA").when(o % 29 == 0, "ACNT").otherwise(bc(o, 4))
    unassigned = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 3 == 0)
    rows = table(spark, sf_dir, "lineitem").select((o * 8 + F.col("l_linenumber")).alias("aln_id"), o.alias("read"), F.concat(F.lit(":CB_"), cb, F.lit(":UB_"), umi, F.lit(":r"), o.cast("string")).alias("qname"), "l_partkey", "l_linenumber", unassigned.alias("un"))
    return rows.select(
        "aln_id", "read", "qname", (o_unmapped := F.col("read") % 31 == 0).alias("is_unmapped"), F.lit("chr1").alias("reference_name"),
        F.when(o_unmapped, 0).otherwise(1 + F.col("l_linenumber") % 2).alias("nh"),
        F.when(~F.col("un"), F.concat(F.lit("id"), (F.col("l_partkey") % 12).cast("string"))).alias("xt"),
        F.when(F.col("un"), F.lit("Unassigned_Ambiguity")).alias("xs"),
    )


def gene_map(spark: SparkSession) -> DataFrame:
    """Ids 0 to 9 are known; 10 and 11 are not."""
    return spark.range(10).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("gene_id"), F.concat(F.lit("id"), F.col("id").cast("string"), F.lit("_G"), (F.col("id") % 6).cast("string")).alias("gene"))


def cell_map(parsed: DataFrame) -> DataFrame:
    """Cells whose first component begins with A, C or G correct to themselves."""
    return parsed.select("cb").distinct().filter(F.substring("cb", 1, 1) != "T").select("cb", F.col("cb").alias("cell"))


ALIGNED = f"""aln as (select l_orderkey * 8 + l_linenumber as aln_id, l_orderkey as rd,
  concat({bc_sql('l_orderkey % 40', 6)}, '-', case when l_orderkey % 9 = 0 then concat({bc_sql('l_orderkey % 7', 4)}, 'NN') else {bc_sql('l_orderkey % 7', 6)} end) as cb,
  case when l_orderkey % 23 = 0 then 'AAAA' when l_orderkey % 29 = 0 then 'ACNT' else {bc_sql('l_orderkey', 4)} end as umi,
  l_orderkey % 31 = 0 as unmapped, l_returnflag = 'R' and l_linenumber % 3 = 0 as amb,
  case when l_orderkey % 31 = 0 then 0 else 1 + l_linenumber % 2 end as nh,
  case when not (l_returnflag = 'R' and l_linenumber % 3 = 0) and l_partkey % 12 < 10 then concat('id', cast(l_partkey % 12 as varchar), '_G', cast((l_partkey % 12) % 6 as varchar)) end as gene
  from lineitem),
reads as (select rd, min(cb) as cb, min(umi) as umi, bool_or(unmapped) as flag_unmapped, arg_min(nh, aln_id) as nh, arg_min(amb, aln_id) as first_amb, count(*) as n_aln,
  bool_or(amb) as any_amb, count(distinct gene) as n_gene, min(gene) as gene from aln group by rd),
checked as (select *, case when substr(cb, 1, 1) <> 'T' then cb end as cell, coalesce(nh, 0) = 0 as is_unmapped,
  (length(split_part(cb, '-', 1)) - length(replace(split_part(cb, '-', 1), 'N', '')) <= 1) and (length(split_part(cb, '-', 2)) - length(replace(split_part(cb, '-', 2), 'N', '')) <= 1)
   and (length(cb) - length(replace(cb, 'N', '')) <= 2) as n_rule,
  umi not like '%N%' and umi <> repeat(substr(umi, 1, 1), length(umi)) as umi_ok from reads),
judged as (select *, coalesce(not is_unmapped and n_rule and cell is not null and umi_ok and not any_amb and n_gene = 1, false) as counted from checked)"""


# -- expression: order prices by customer nation (sample) and month (gene)
def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.concat(F.lit("M"), F.month("o_orderdate").cast("string"))
    return rows.groupBy(F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("sample"), month.alias("gene")).agg(F.round(F.avg(F.col("o_totalprice")), 4).alias("value"))


EXPRESSION = """expr as (select concat('P', cast(c_nationkey as varchar)) as sample, concat('M', cast(month(o_orderdate) as varchar)) as gene, round(avg(o_totalprice), 4) as value
  from orders join customer on o_custkey = c_custkey group by 1, 2)"""


# -- known barcodes: the suppliers'
def known_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(bc(k, 6).alias("barcode"), F.concat_ws("-", bc(k % 50, 6), bc(k, 5)).alias("composite"))


KNOWN = f"sup as (select {bc_sql('s_suppkey', 6)} as barcode, concat({bc_sql('s_suppkey % 50', 6)}, '-', {bc_sql('s_suppkey', 5)}) as composite from supplier)"


# -- barcode counts with T counts, of the parts
def flagged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite barcodes, some with N, with counts of reads and of T at two positions."""
    k = F.col("p_partkey")
    last = F.when(k % 9 == 0, F.concat(bc(k, 4), F.lit("N"))).when(k % 11 == 0, F.concat(bc(k, 3), F.lit("NN"))).otherwise(bc(k, 5))
    n = 100 + k % 37
    rows = table(spark, sf_dir, "part").select(F.concat_ws("-", bc(k % 50, 6), last).alias("cb"), n.alias("n"), F.floor(n * (k % 100) / 101.0).alias("t1"), F.floor(n / 2).alias("t2"))
    return rows.groupBy("cb").agg(F.sum("n").alias("cb_count"), F.array(F.sum("t1"), F.sum("t2")).alias("t_count"))


FLAGGED = f"""flagged as (select concat({bc_sql('p_partkey % 50', 6)}, '-', case when p_partkey % 9 = 0 then concat({bc_sql('p_partkey', 4)}, 'N') when p_partkey % 11 = 0 then concat({bc_sql('p_partkey', 3)}, 'NN') else {bc_sql('p_partkey', 5)} end) as cb,
  cast(sum(100 + p_partkey % 37) as bigint) as cb_count, cast(sum(((100 + p_partkey % 37) * (p_partkey % 100)) // 101) as bigint) as t1, cast(sum((100 + p_partkey % 37) // 2) as bigint) as t2 from part group by 1)"""

#: Composite barcodes that pass the N rule, with the correction of their second component to the suppliers' barcodes of five bases.
REFINED = f"""{FLAGGED}, {KNOWN}, targets as (select distinct split_part(composite, '-', 2) as target from sup),
  ruled as (select * from flagged where length(split_part(cb, '-', 2)) - length(replace(split_part(cb, '-', 2), 'N', '')) <= 1),
  second as (select distinct split_part(cb, '-', 2) as c from ruled),
  near as (select c, min(target) as t, count(target) as n, bool_or(target = c) as own from second left join targets on hamming(c, target) <= 1 group by 1),
  refined as (select r.*, concat(split_part(cb, '-', 1), '-', case when own then c else t end) as corrected from ruled r join near on split_part(cb, '-', 2) = c where own or n = 1)"""


# -- gene densities, weighed: stand-ins for fitted distributions
def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, sample, p_down, p_neutral, p_up, share, mu: normal densities around each gene's mean, with shares by its name's length."""
    rows = expression(spark, sf_dir)
    g = rows.groupBy("gene").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    x = rows.join(g, "gene").filter("s > 0")
    at = lambda k: F.exp(-0.5 * F.pow((F.col("value") - F.col("m") - F.lit(float(k)) * F.col("s")) / F.col("s"), F.lit(2.0)))
    n = F.length("gene").cast("double")
    share = F.array(0.1 + 0.01 * n, 0.7 - 0.02 * n, 0.2 + 0.01 * n)
    return x.select("gene", "sample", at(-1).alias("p_down"), at(0).alias("p_neutral"), at(1).alias("p_up"), share.alias("share"), F.array(F.col("m") - F.col("s"), F.col("m"), F.col("m") + F.col("s")).alias("mu"))


DENSITIES = f"""{EXPRESSION}, gs as (select gene, avg(value) as m, stddev_samp(value) as s from expr group by 1),
  dens as (select gene, sample, value, m, exp(cast(-0.5 as double) * pow((value - m + s) / s, 2)) as p_down, exp(cast(-0.5 as double) * pow((value - m) / s, 2)) as p_neutral, exp(cast(-0.5 as double) * pow((value - m - s) / s, 2)) as p_up,
   cast(0.1 as double) + cast(0.01 as double) * length(gene) as s0, cast(0.7 as double) - cast(0.02 as double) * length(gene) as s1, cast(0.2 as double) + cast(0.01 as double) * length(gene) as s2 from expr join gs using (gene) where s > 0)"""
