"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from .fixtures import ALIGNED, COLLAPSED, DENSITIES, EXPRESSION, FLAGGED, KNOWN, MOLECULES, REFINED, SKEWED, TUPLES, bc_sql

T_SUMS = ", ".join(f"cast(count(*) filter (where substr(umi, {i}, 1) = 'T') as bigint) as t{i}" for i in range(1, 7))
COUNTED = f"{TUPLES}, counted as (select cb, count(*) as cb_count, {T_SUMS} from kept group by cb)"
T_NAMES = ", ".join(f"t{i}" for i in range(1, 7))
BARCODES = f"bars as (select p_partkey as id, {bc_sql('p_partkey', 6)} as barcode, concat({bc_sql('p_partkey % 50', 6)}, '-', {bc_sql('p_partkey', 5)}) as composite from part)"
RANKED = f"{SKEWED}, ranked as (select cb, cb_count, row_number() over (order by cb_count desc, cb) as rank, cast(sum(cb_count) over (order by cb_count desc, cb rows unbounded preceding) as bigint) as cumulative from counts)"
SLOTS = "slots as (select cell, gene, umi, slot, md5(concat({seed}, '|', cell, '|', gene, '|', umi, '|', cast(slot as varchar))) as h from (select cell, gene, umi, unnest(range(1, depth + 1)) as slot from molecules))"
PAIRS = f"""{BARCODES}, {KNOWN}, known as (select distinct {{known}} as target from sup)"""

MATRIX = f"{MOLECULES}, matrix as (select cell, gene, cast(sum(depth) as bigint) as count from molecules group by 1, 2)"
CLUSTERS = f"clusters as (select {bc_sql('s_suppkey', 6)} as cell, min(concat('c', cast(s_nationkey % 4 as varchar))) as cluster from supplier group by 1)"
SCORES = f"""{MATRIX}, {CLUSTERS}, markers(cell_type, gene, sign) as (values ('T', 'G0', '+'), ('T', 'G1', '-'), ('B', 'G2', '+'), ('B', 'G3', '+'), ('B', 'G4', '-'), ('N', 'G5', '-'), ('M', 'G6', '+')),
  totals as (select cell, sum(count) as total from matrix group by 1), sums as (select t.cell, t.total, k.cell_type,
   coalesce(sum(case when k.sign = '+' then m.count end), 0) as pos, coalesce(sum(case when k.sign = '-' then m.count end), 0) as neg, count(*) filter (where k.sign = '+') as n_pos
   from totals t cross join markers k left join matrix m on m.cell = t.cell and m.gene = k.gene group by 1, 2, 3),
  scores as (select cell, cell_type, round(ln(1 + greatest(0, cast(case when n_pos > 0 then pos - neg else max(neg) over (partition by cell_type) - neg end as double) / total * 10000)), 9) as score from sums)"""
AUCS = f"""{SCORES}, joined as (select s.*, c.cluster from scores s join clusters c using (cell)),
  ranked as (select *, rank() over (partition by cell_type order by score) + (count(*) over (partition by cell_type, score) - 1) / 2.0 as r from joined),
  auc as (select cell_type, cluster, round((sum(r) - cast(count(*) as double) * (count(*) + 1) / 2) / (cast(count(*) as double) * (max(n) - count(*))), 6) as auc
   from (select *, count(*) over (partition by cell_type) as n from ranked) group by 1, 2),
  assigned as (select cluster, cell_type, auc from (select *, row_number() over (partition by cluster order by auc desc, cell_type) as rn from auc) where rn = 1)"""
MUTATIONS = """mut as (select concat('P', cast(o_orderkey % 25 as varchar)) as sample, concat('M', cast(1 + o_orderkey % 997 as varchar)) as hgnc_symbol,
  (['HOMD', 'HLAMP', 'MISSENSE', 'NONSENSE', 'FRAMESHIFT', 'SYNONYMOUS', 'SPLICE'])[1 + o_orderkey % 7] as variant_type from orders)"""
EDGES = """edges as (select concat('M', cast(1 + p_partkey % 12 as varchar)) as gene, concat('M', cast(1 + (p_partkey // 12) % 12 as varchar)) as neighbour, max(cast(p_partkey * 37 % 100 as double) / 100) as weight from part group by 1, 2)"""

PART_COUNTS = f"counted as (select {bc_sql('p_partkey', 6)} as cb, cast(sum(p_partkey % 13 + 1) as bigint) as cb_count from part group by 1)"
MERGES = "len(near) = 0 or len(near) = 1 and cb_count > near[1].n / cast(10 as double)"
ABSORBS = "len(near) = 0"
FLAGS = f"flags as (select cb, cb_count, {' + '.join(f'(case when cast(t{i} as double) / cb_count > cast(0.8 as double) or cast(t{i} as double) / cb_count < cast(0.005 as double) then 1 else 0 end)' for i in (1, 2))} as n_flags from counts)"
CALLED = """kept as (select * from flagged where not regexp_matches(split_part(cb, '-', 1), '^(N+|G+)$')), rk as (select *, row_number() over (order by cb_count desc, cb) as rank from kept),
  th as (select (quantile_cont(cb_count, 0.75) * cast(2.5 as double) - quantile_cont(cb_count, 0.25) * cast(1.5 as double)) / 10 as t from rk where rank <= 150), called as (select kept.* from kept, th where cb_count > t)"""
STANDARD = f"{EXPRESSION}, std as (select sample, gene, coalesce((value - avg(value) over (partition by gene)) / nullif(stddev_samp(value) over (partition by gene), 0), 0) as z from expr)"
PARTS = tuple(tuple(f"cast({v} as double)" for v in part) for part in ((0.2, -1.0, 0.8), (0.5, 0.0, 0.5), (0.3, 1.5, 1.2)))
SEQ1 = "concat(cb, umi, polyt, case when fits then 'AC' else 'AX' end)"
CONSTRAINED = f"""{BARCODES}, {KNOWN}, known as (select distinct composite from sup),
        parts as (select distinct 1 as pos, composite, split_part(composite, '-', 1) as target from known union all select distinct 2, composite, split_part(composite, '-', 2) from known),
        members as (select distinct pos, target from parts), asked as (select distinct composite as whole, 1 as pos, split_part(composite, '-', 1) as c from bars union all select distinct composite, 2, split_part(composite, '-', 2) from bars),
        near as (select a.whole, a.pos, a.c, m.target from asked a join members m on a.pos = m.pos and hamming(a.c, m.target) <= 1),
        exact as (select whole, pos, bool_or(c = target) as own from near group by 1, 2),
        cand as (select n.whole, n.pos, n.target from near n join exact e using (whole, pos) where not e.own or n.c = n.target),
        d as (select c.whole, c.pos, c.target, min(hamming(c.whole, p.composite)) as d from cand c join parts p on p.pos = c.pos and p.target = c.target group by 1, 2, 3),
        r as (select *, rank() over (partition by whole, pos order by d) as rk from d),
        best as (select whole, pos, min(target) as target from r where rk = 1 group by 1, 2 having count(*) = 1),
        fixed as (select whole, concat(max(case when pos = 1 then target end), '-', max(case when pos = 2 then target end)) as corrected from best group by whole having count(*) = 2)"""
EVIDENCE = f"""{DENSITIES}, {MUTATIONS}, {EDGES}, sw as (select sample, avg(p_neutral * s1 / (p_down * s0 + p_neutral * s1 + p_up * s2)) as sw from dens group by 1),
  rws as (select h.gene, h.sample, h.sw, e.neighbour, e.weight, d.value, d.m, d.p_down, d.p_neutral, d.p_up from (select distinct mut.sample, hgnc_symbol as gene, sw from mut join sw on sw.sample = mut.sample) h
   join edges e on e.gene = h.gene and e.gene <> e.neighbour join dens d on d.sample = h.sample and d.gene = e.neighbour),
  sides as (select gene, neighbour, median(p_down / greatest(p_down + p_up, cast(1e-300 as double))) as q, avg(case when value < m then cast(1 as double) else 0 end) as below, count(*) as n, max(weight) as weight from rws group by 1, 2),
  ws as (select gene, neighbour, case when n <= 3 then cast(0.5 as double) else greatest(q, 1 - q) * weight end as w, case when n <= 3 or (q > 0.5 and below < 0.5) or (q < 0.5 and below > 0.5) then cast(0.5 as double) else q end as h from sides),
  evidence as (select gene, sample, neighbour, pow(greatest(p_down, cast(1e-300 as double)), w * sw) as p_down, pow(greatest(p_neutral, cast(1e-300 as double)), w * sw) as p_neutral, pow(greatest(p_up, cast(1e-300 as double)), w * sw) as p_up, h from rws join ws using (gene, neighbour))"""


def _lse(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(1 + exp(-abs(({a}) - ({b})))))"


def _mix(x: float, y: float, z: float) -> str:
    return f"cast({x} as double) * a + cast({y} as double) * b + cast({z} as double) * c"


def _greedy(source: str, name: str, accepts: str) -> str:
    """A pass over source (cb, cb_count) by falling count that carries along what it has accepted; name_done has cbs."""
    near = "list_filter(w.acc, lambda x: length(x.cb) = length(r.cb) and hamming(x.cb, r.cb) <= 1)"
    return f"""{name}_ranked as (select cb, cb_count, row_number() over (order by cb_count desc, cb) as rn from {source}),
        {name}_walk(rn, acc) as (select cast(0 as bigint), cast([] as struct(cb varchar, n bigint)[]) union all
          select rn, case when {accepts} then list_append(acc, {{'cb': cb, 'n': cb_count}}) else acc end from (select w.rn + 1 as rn, w.acc, r.cb, r.cb_count, {near} as near from {name}_walk w join {name}_ranked r on r.rn = w.rn + 1)),
        {name}_done as (select list_transform(acc, lambda x: x.cb) as cbs from {name}_walk order by rn desc limit 1)"""


ORACLES: dict[str, str] = {
    "gene_name_reset": """with g as (select p_partkey as pos, concat('E', cast(p_partkey as varchar), '_', replace(p_name, ' ', '_')) as gene from part), n as (select *, regexp_replace(gene, '^[^_]*_', '') as short from g)
        select pos, gene, case when row_number() over (partition by short order by pos) > 1 then gene else short end as name from n""",
    "marker_score": f"with {SCORES} select cell, cell_type, round(score, 6) as score from scores",
    "marker_auc": f"with {AUCS} select * from auc",
    "rank_auc": """with r as (select l_returnflag, l_linestatus = 'O' as label, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as r from lineitem),
        s as (select l_returnflag, sum(r) filter (where label) as r1, cast(count(*) filter (where label) as double) as a, cast(count(*) as double) as n from r group by 1)
        select l_returnflag, round(case when a = 0 or a = n then 0.5 else (r1 - a * (a + 1) / 2) / (a * (n - a)) end, 6) as auc from s""",
    "assign_cluster": f"with {AUCS} select * from assigned",
    "merged_auc": f"""with {AUCS}, m as (select j.cell_type, j.score, a.cell_type = j.cell_type as label from joined j join assigned a using (cluster) where j.cell_type in (select cell_type from assigned)),
        k as (select *, rank() over (partition by cell_type order by score) + (count(*) over (partition by cell_type, score) - 1) / 2.0 as r from m),
        s as (select cell_type, sum(r) filter (where label) as r1, cast(count(*) filter (where label) as double) as a, cast(count(*) as double) as n from k group by 1)
        select cell_type, round(case when a = 0 or a = n then 0.5 else (r1 - a * (a + 1) / 2) / (a * (n - a)) end, 6) as auc from s""",
    "average_auc": f"with {AUCS}, t as (select cell_type, avg(auc) as m, count(*) as n from assigned group by 1) select round(case when sum(n) >= 2 * count(*) then 0.0 else sum(m - cast(0.7 as double)) end, 6) as score from t",
    "split_markers": """with m as (select distinct concat('t', cast(p_partkey % 7 as varchar)) as cell_type, concat('A-', cast(p_partkey % 31 as varchar)) as gene, case when p_partkey % 5 = 0 then '-' else '+' end as sign from part)
        select * from m where sign = '-' union all select * from m where sign = '+' and not exists (select 1 from m x where x.sign = '-' and x.cell_type = m.cell_type and x.gene = m.gene)""",
    "top_markers": """with t as (select l_orderkey * 8 + l_linenumber as pos, concat('k', cast(l_suppkey % 9 as varchar)) as cluster, case when l_partkey % 6 = 0 then 'RPL1' when l_partkey % 11 = 0 then 'MALAT1' else concat('GENE', cast(l_partkey as varchar)) end as gene,
        l_discount as p, l_quantity / 50 as pct_1, l_tax as pct_2 from lineitem),
        f as (select *, row_number() over (partition by cluster order by pos) as r from t where p <= cast(0.01 as double) and not regexp_matches(gene, 'MALAT1|^MTRNR') and pct_2 <= 1)
        select cluster, round(count(*) / cast(15 as double), 6) as ratio from f where r <= 15 and not regexp_matches(gene, '^MT-|^RPL|^RPS|^MRPS|^MRPL') and pct_1 > cast(0.25 as double) group by 1 having count(*) / cast(15 as double) > cast(0.7 as double)""",
    "mito_filter": f"""with {MATRIX}, r as (select cell, cast(sum(count) as bigint) as total, cast(coalesce(sum(count) filter (where gene in ('G0', 'G1')), 0) as double) / sum(count) as ratio from matrix group by 1),
        q as (select quantile_cont(ratio, 0.75) + 3 * (quantile_cont(ratio, 0.75) - quantile_cont(ratio, 0.25)) as f, max(ratio) as top from r)
        select cell, total, round(ratio, 9) as ratio from r, q where ratio <= case when f <= cast(0.02 as double) then greatest(top / 2, f) else f end""",
    "mito_ratio": f"with {MATRIX} select cell, cast(sum(count) as bigint) as total, round(cast(coalesce(sum(count) filter (where gene in ('G7', 'G8')), 0) as double) / sum(count), 9) as ratio from matrix group by 1",
    "log_normalised": f"with {MATRIX} select cell, gene, round(ln(1 + count / cast(sum(count) over (partition by cell) as double) * 10000), 6) as value from matrix",
    "expressed_cells": f"""with {MOLECULES}, m as (select cell, gene, cast(sum(depth) as bigint) as count from molecules where depth > 14 group by 1, 2)
        select * from m where gene in (select gene from m group by 1 having count(*) >= 60) and cell in (select cell from m group by 1 having count(*) >= 8)""",
    "rank_sum_tests": f"""with {MATRIX}, {CLUSTERS}, v as (select cell, gene, ln(1 + count / cast(sum(count) over (partition by cell) as double) * 10000) as value from matrix),
        grid as (select c.cell, c.cluster, g.gene, coalesce(v.value, 0) as value from clusters c cross join (select distinct gene from v) g left join v on v.cell = c.cell and v.gene = g.gene),
        r as (select *, rank() over (partition by gene order by value) + (count(*) over (partition by gene, value) - 1) / cast(2 as double) as rk, count(*) over (partition by gene) as n from grid),
        tie as (select gene, sum(cast(t as double) * t * t - t) as tie from (select gene, value, count(*) as t from grid group by 1, 2) group by 1),
        s as (select cluster, gene, sum(rk) as r, cast(count(*) as double) as n1, cast(max(n) - count(*) as double) as n2, cast(max(n) as double) as n, cast(count(*) filter (where value > 0) as double) as k from r group by 1, 2),
        w as (select *, sum(k) over (partition by gene) as k_all from s)
        select cluster, gene, round((r - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))), 5) as z, round(k / n1, 6) as pct_1, round((k_all - k) / n2, 6) as pct_2 from w join tie using (gene)""",
    "gene_set_intersection": f"with {EXPRESSION}, {MUTATIONS} select distinct gene from expr where gene in (select hgnc_symbol from mut)",
    "na_fraction": f"with {EXPRESSION} select gene, count(*) filter (where (length(sample) + length(gene) + cast(floor(value) as integer)) % 3 = 0) as n_missing, count(*) as n from expr group by 1",
    "quantile_norm": f"""with {EXPRESSION}, r as (select *, row_number() over (partition by sample order by value, gene) as r from expr), m as (select r, avg(value) as m from r group by 1)
        select sample, gene, round(avg(m) over (partition by sample, value), 4) as value from r join m using (r)""",
    "ideal_fourths": """with x as (select o_orderpriority as gene, list_sort(list(o_totalprice)) as l, count(*) as n from orders group by 1), j as (select *, cast(floor(n / cast(4 as double) + cast(5 as double) / 12) as bigint) as j from x),
        g as (select *, n / cast(4 as double) + cast(5 as double) / 12 - j as g from j) select gene, n, round((1 - g) * l[j] + g * l[j + 1], 4) as ql, round((1 - g) * l[n - j + 1] + g * l[n - j], 4) as qu from g""",
    "boxplot_outliers": """with v as (select l_orderkey, l_linenumber, l_returnflag as gene, pow(l_extendedprice, 9) as value from lineitem), x as (select gene, list_sort(list(value)) as l, count(*) as n from v group by 1),
        j as (select *, cast(floor(n / cast(4 as double) + cast(5 as double) / 12) as bigint) as j from x), g as (select *, n / cast(4 as double) + cast(5 as double) / 12 - j as g from j),
        q as (select gene, (1 - g) * l[j] + g * l[j + 1] as ql, (1 - g) * l[n - j + 1] + g * l[n - j] as qu from g)
        select l_orderkey, l_linenumber, gene from v join q using (gene) where value < ql - cast(1.5 as double) * (qu - ql) or value > qu + cast(1.5 as double) * (qu - ql)""",
    "complex_mutation": f"""with {MUTATIONS}, p as (select *, count(*) over (partition by sample, hgnc_symbol) as c from mut where variant_type not in ('HOMD', 'HLAMP')),
        u as (select sample, hgnc_symbol, case when c > 1 then 'COMPLEX' else variant_type end as variant_type from p union all select * from mut where variant_type in ('HOMD', 'HLAMP')) select sample, hgnc_symbol, variant_type, count(*) as n from u group by 1, 2, 3""",
    "strong_mutations": f"with {EXPRESSION}, {MUTATIONS} select distinct * from mut where variant_type in ('HOMD', 'HLAMP', 'NONSENSE', 'FRAMESHIFT', 'SPLICE') and sample in (select sample from expr)",
    "top_edges": f"""with {EDGES}, e as (select *, row_number() over (partition by gene order by weight desc, neighbour) as r, count(*) over (partition by gene) as n from edges where weight >= cast(0.4 as double) and gene <> neighbour)
        select gene, neighbour, weight from e where n >= 5 and r <= 8""",
    "network_filter": f"""with {EDGES}, w as (select concat('M', cast(n_nationkey + 1 as varchar)) as gene, n_nationkey % 4 / cast(4 as double) + cast(0.2 as double) as weight from nation),
        e as (select e.*, row_number() over (partition by e.gene order by e.weight desc, neighbour) as r, count(*) over (partition by e.gene) as n from edges e where e.weight >= cast(0.4 as double) and e.gene <> neighbour and neighbour in (select gene from w where weight >= cast(0.4 as double)))
        select gene, neighbour, weight from e where n >= 2 and r <= 5""",
    "network_expansion": f"with {EXPRESSION}, {MUTATIONS}, {EDGES} select * from edges where gene <> neighbour and gene in (select hgnc_symbol from mut) and neighbour in (select gene from expr)",
    "bh_adjust": """with p as (select l_orderkey, l_linenumber, l_partkey as gene, l_extendedprice / 200000 * (l_discount + cast(0.01 as double)) as p from lineitem),
        r as (select *, row_number() over (partition by gene order by p) as r, count(*) over (partition by gene) as n from p)
        select l_orderkey, l_linenumber, round(least(1, min(p * n / r) over (partition by gene order by r desc rows unbounded preceding)), 6) as q from r""",
    "z_scores": f"with {EXPRESSION} select sample, gene, round(greatest(cast(-1.5 as double), least(cast(1.5 as double), coalesce((value - avg(value) over (partition by gene)) / nullif(stddev_samp(value) over (partition by gene), 0), 0))), 5) as value from expr",
    "parsed_reads": f"with {TUPLES} select record_id, cb, umi, seq2 from kept",
    "read_filter_metrics": f"""with {TUPLES}, m as (select count(*) filter (where fits and length(replace(polyt, 'T', '')) <= 1) as a, count(*) filter (where fits) as b,
        count(*) filter (where fits and length(replace(polyt, 'T', '')) <= 1) as c, count(*) as d from tuples)
        select 'read_pass' as metric, a as value from m union all select 'read_pass_barcode', b from m union all select 'read_pass_polyt', c from m union all select 'read_total', d from m""",
    "barcode_counts": f"with {COUNTED} select * from counted",
    "merged_barcode_counts": f"with {COUNTED} select * from counted",
    "top_barcodes": f"with {COUNTED} select cb, cb_count from counted order by cb_count desc, cb limit 50",
    "t_frequency": f"with {COUNTED} select cb, {', '.join(f'round(cast(t{i} as double) / cb_count, 6) as r{i}' for i in range(1, 7))} from counted",
    "indel_flags": f"with {COUNTED} select cb, cast({' + '.join(f'(case when cast(t{i} as double) / cb_count > cast(0.8 as double) or cast(t{i} as double) / cb_count < cast(0.005 as double) then 1 else 0 end)' for i in range(1, 7))} as bigint) as n_flags from counted",
    "tagged_fastq": f"with {TUPLES} select concat('@:CB_', cb, ':UB_', umi, ':r', cast(record_id as varchar), chr(10), seq2, chr(10), '+', chr(10), repeat('F', length(seq2))) as value from kept where not empty_cdna",
    "polyt_filter": f"with {TUPLES} select record_id, length(replace(polyt, 'T', '')) <= 1 as keep from tuples",
    "value_filter": f"""with r as (select event_id as record_id, {bc_sql('user_id', 8)} as c1, case when event_id % 3 = 0 then 'CATAACTG' when event_id % 3 = 1 then concat('GGAGGTA', {bc_sql('event_id', 1)}) else {bc_sql('event_id', 8)} end as c2,
        {bc_sql('event_id', 8)} as c3, {bc_sql('event_id + 1', 6)} as umi from events),
        f as (select *, case when hamming(c2, 'CATAACTG') <= 1 then 'CATAACTG' when hamming(c2, 'GGAGGTAA') <= 1 then 'GGAGGTAA' end as fixed from r)
        select record_id, concat(c1, '-', c2, '-', c3) as cb_raw, concat(c1, '-', fixed, '-', c3) as cb, umi from f where fixed is not null""",
    "n_filter": f"with {ALIGNED} select distinct cb, cast(length(split_part(cb, '-', 1)) - length(replace(split_part(cb, '-', 1), 'N', '')) as bigint) as n1, cast(length(split_part(cb, '-', 2)) - length(replace(split_part(cb, '-', 2), 'N', '')) as bigint) as n2, n_rule as keep from checked",
    "umi_filter": f"with {ALIGNED} select distinct umi, umi_ok as keep from checked",
    "uniform_filter": f"select concat('ACGT-', {bc_sql('p_partkey', 4)}) as cb, p_partkey as cb_count from part where p_partkey % 3 = 1",
    "fuzzy_correct": f"""with {PAIRS.format(known='barcode')}, c as (select b.id, b.barcode, min(k.target) as t, count(k.target) as n, bool_or(k.target = b.barcode) as own from bars b left join known k on hamming(b.barcode, k.target) <= 1 group by 1, 2)
        select id, barcode, case when own then barcode when n = 1 then t end as corrected from c""",
    "composite_correct": f"""with {BARCODES}, {KNOWN}, known as (select distinct split_part(composite, '-', 2) as target from sup),
        c as (select b.id, b.composite, min(k.target) as t, count(k.target) as n, bool_or(k.target = split_part(b.composite, '-', 2)) as own from bars b left join known k on hamming(split_part(b.composite, '-', 2), k.target) <= 1 group by 1, 2)
        select id, composite, case when own then composite when n = 1 then concat(split_part(composite, '-', 1), '-', t) end as corrected from c""",
    "fuzzy_constrained": f"with {CONSTRAINED} select b.id, b.composite, f.corrected from bars b left join fixed f on b.composite = f.whole",
    "chosen_correction": f"with {CONSTRAINED} select whole as cb, corrected as cell from fixed",
    "near_pairs": f"with {BARCODES}, d as (select distinct barcode from bars) select x.barcode as a, y.barcode as b from d x join d y on x.barcode < y.barcode and hamming(x.barcode, y.barcode) <= 1",
    "component_index": f"""with {BARCODES}, p as (select distinct composite, unnest([0, 1]) as position, unnest(string_split(composite, '-')) as component from bars)
        select cast(position as bigint) as position, component, string_agg(composite, ',' order by composite) as composites from p group by 1, 2""",
    "primer_merge": f"""with pr as (select {bc_sql('p_partkey', 4)} as dt, {bc_sql('p_partkey + 1000', 4)} as rnd from part), t as (select dt as query, dt as target from pr union select rnd, dt from pr)
        select query, min(target) as target from t group by query having count(distinct target) = 1""",
    "umi_runs": f"with {ALIGNED} select aln_id, cast(dense_rank() over (order by rd) as bigint) as run from aln",
    "molecule_counts": f"with {ALIGNED} select cell, gene, umi, count(*) as depth from judged where counted group by 1, 2, 3",
    "reads_per_cell": f"with {ALIGNED} select cell, count(*) as n_read from judged where cell is not null group by 1",
    "map_info": f"""with {ALIGNED}, first as (select j.*, (select 1) as one from judged j),
        lost as (select *, (not is_unmapped and n_rule and cell is null and not flag_unmapped) or (not is_unmapped and n_rule and cell is not null and not umi_ok)
          or (not is_unmapped and n_rule and cell is not null and umi_ok and first_amb) or (not is_unmapped and n_rule and cell is not null and umi_ok and not first_amb and not counted) as l from first)
        select 'num_alignment' as metric, cast(sum(n_aln) as bigint) as value from lost union all select 'num_unique_read', count(*) from lost union all select 'num_unmapped_read', count(*) filter (where is_unmapped) from lost
        union all select 'num_barcode_with_na', count(*) filter (where l) from lost union all select 'num_count_read', count(*) filter (where counted) from lost""",
    "gene_join": """select l_orderkey * 8 + l_linenumber as aln_id, case when l_returnflag = 'R' and l_linenumber % 3 = 0 then 'chr1' else concat('id', cast(l_partkey % 12 as varchar)) end as feature,
        case when not (l_returnflag = 'R' and l_linenumber % 3 = 0) and l_partkey % 12 < 10 then concat('id', cast(l_partkey % 12 as varchar), '_G', cast((l_partkey % 12) % 6 as varchar)) end as gene from lineitem""",
    "depth_filter": "select l_orderkey, l_linenumber, cast(floor(l_extendedprice / 30000 + cast(0.5 as double)) as bigint) as depth from lineitem where l_extendedprice / 30000 >= cast(0.95 as double)",
    "range_annotate": """with a as (select o_orderkey as aln_id, concat('c', cast(o_orderkey % 3 as varchar)) as chrom, o_orderkey * 97 % 200000 as s, o_orderkey * 97 % 200000 + 90 as e, case when o_orderkey % 2 = 0 then '+' else '-' end as strand, o_orderkey % 5 = 0 as multi from orders),
        x as (select concat('g', cast(p_partkey % 400 as varchar)) as gene_id, concat('c', cast(p_partkey % 3 as varchar)) as chrom, p_partkey * 211 % 200000 as s, p_partkey * 211 % 200000 + 100 + p_partkey % 7 * 3000 as e, case when p_partkey % 4 < 2 then '+' else '-' end as strand from part),
        h as (select a.aln_id, count(distinct x.gene_id) as n, min(x.gene_id) as g from a join x on a.chrom = x.chrom and a.strand = x.strand and a.s <= x.e and a.e >= x.s where not a.multi group by 1)
        select a.aln_id, case when n = 1 then g end as xt, case when n > 1 then 'Unassigned_Ambiguity' end as xs from a left join h using (aln_id)""",
    "umi_collapse": f"with {COLLAPSED} select * from collapsed",
    "read_counts": f"with {COLLAPSED} select cell, gene, cast(sum(depth) as bigint) as count from collapsed group by 1, 2",
    "transcript_counts": f"with {COLLAPSED} select cell, gene, count(*) as count from collapsed group by 1, 2",
    "deep_transcript_counts": f"with {COLLAPSED} select cell, gene, count(*) as count from collapsed where depth >= 5 group by 1, 2",
    "padded_matrix": f"""with {MOLECULES}, part_of as (select * from molecules where gene <> 'G3' and cell < 'C'), n as (select cell, gene, cast(sum(depth) as bigint) as count from part_of group by 1, 2)
        select * from n union all select (select min(cell) from part_of), gene, 0 from (select distinct gene from molecules) g where gene not in (select gene from n) and exists (select 1 from n)""",
    "mtx_coords": f"""with {MOLECULES}, g as (select gene, row_number() over (order by gene) as gene_idx from (select distinct gene from molecules)),
        c as (select cell, row_number() over (order by cell) as cell_idx from (select cell from molecules where depth >= 5 union select min(cell) from molecules)),
        n as (select cell, gene, count(*) as count from molecules where depth >= 5 group by 1, 2) select gene_idx, cell_idx, count from n join g using (gene) join c using (cell)""",
    "knee_curve": f"with {RANKED} select cb, cb_count, rank, round(log10(cast(cumulative as double)), 6) as log_cumulative from ranked",
    "cell_threshold": f"""with {RANKED}, n as (select count(*) filter (where log10(cast(cumulative as double)) <= log10(cast((select sum(cb_count) from counts) as double)) * cast(0.8 as double)) as n_top from ranked),
        q as (select n_top, quantile_cont(cb_count, 0.75) as a, quantile_cont(cb_count, 0.25) as b, quantile_cont(cb_count, 0.99) as c from ranked, n where rank <= n_top group by n_top)
        select n_top, round(case when n_top <= 500 then (a + (a - b) * 1.5) / 10 else c / 10 end, 6) as threshold from q""",
    "called_cells": f"with {RANKED}, q as (select quantile_cont(cb_count, 0.99) / 10 as t from ranked where rank <= 700) select cb, cb_count from counts, q where cb_count > t",
    "forced_cells": f"with {RANKED} select cb, cb_count from counts where cb_count > coalesce((select cb_count from ranked where rank = 101), -1)",
    "whitelist_remove": f"with {BARCODES}, {KNOWN}, m as (select distinct concat(substr(barcode, 1, 5), 'N') as b from sup) select distinct barcode from bars where exists (select 1 from m where hamming(m.b, bars.barcode) <= 1)",
    "detected_cells": f"with {BARCODES}, {KNOWN} select distinct barcode as cb from bars where barcode not in (select barcode from sup)",
    "greedy_merge": f"with recursive {PART_COUNTS}, {_greedy('counted', 'g', MERGES)} select unnest(cbs) as cb from g_done",
    "greedy_absorb": f"with recursive {PART_COUNTS}, {_greedy('counted', 'g', ABSORBS)} select unnest(cbs) as cb from g_done",
    "refined_barcodes": f"with {REFINED} select cb, cb_count, corrected from refined",
    "regrouped_counts": f"with {REFINED} select corrected as cb, cast(sum(cb_count) as bigint) as cb_count, cast(sum(t1) as bigint) as t1, cast(sum(t2) as bigint) as t2 from refined group by 1",
    "merged_whitelist": f"""with recursive raw as (select {bc_sql('p_partkey', 6)} as cb, cast(sum(p_partkey % 13 + 10) as bigint) as cb_count, min(p_partkey) as k from part group by 1),
        counts as (select cb, cb_count, cb_count * (case when k % 5 = 0 then 9 else 3 end) // 10 as t1, cb_count // 2 as t2 from raw), {FLAGS},
        whole as (select cb, cb_count from flags where n_flags = 0), short as (select cb, cb_count from flags where n_flags = 1), {_greedy('whole', 'w', MERGES)}, {_greedy('short', 's', ABSORBS)},
        listed as (select unnest(cbs) as cb from w_done), heads as (select unnest(cbs) as cb from s_done), gone as (select cb from listed where exists (select 1 from heads h where hamming(concat(substr(h.cb, 1, length(h.cb) - 1), 'N'), listed.cb) <= 1))
        select cb, 'listed' as kind from listed union all select cb, 'listed' from heads union all select cb, 'removed' from gone""",
    "candidate_cells": f"""with recursive {REFINED.replace('select * from flagged where', 'select * from called where').replace(', targets as', f', {CALLED}, targets as')},
        counts as (select corrected as cb, cast(sum(cb_count) as bigint) as cb_count, cast(sum(t1) as bigint) as t1, cast(sum(t2) as bigint) as t2 from refined group by 1), {FLAGS},
        whole as (select cb from flags where n_flags = 0), short as (select cb, cb_count from flags where n_flags = 1), {_greedy('short', 's', ABSORBS)}, heads as (select unnest(cbs) as cb from s_done),
        gone as (select cb from whole where exists (select 1 from heads h where length(h.cb) = length(whole.cb) and hamming(concat(substr(h.cb, 1, length(h.cb) - 1), 'N'), whole.cb) <= 1))
        select cb from (select cb from whole union select cb from heads) where cb not in (select cb from gone)""",
    "fastq_scan": f"with {TUPLES} select row_number() over (order by record_id) - 1 as record_id, concat('r', cast(record_id as varchar)) as name, {SEQ1} as seq, repeat('F', length({SEQ1})) as qual from tuples",
    "mate_scan": f"with {TUPLES} select row_number() over (order by record_id) - 1 as record_id, concat('r', cast(record_id as varchar)) as name1, {SEQ1} as seq1, seq2 from tuples",
    "sam_scan": f"""with a as (select concat(':CB_', {bc_sql('l_orderkey % 40', 6)}, '-', case when l_orderkey % 9 = 0 then concat({bc_sql('l_orderkey % 7', 4)}, 'NN') else {bc_sql('l_orderkey % 7', 6)} end,
          ':UB_', case when l_orderkey % 23 = 0 then 'AAAA' when l_orderkey % 29 = 0 then 'ACNT' else {bc_sql('l_orderkey', 4)} end, ':r', cast(l_orderkey as varchar)) as qname, l_orderkey % 31 = 0 as is_unmapped, 'chr1' as reference_name, '+' as strand,
          cast(case when l_orderkey % 31 = 0 then 0 else 1 + l_linenumber % 2 end as integer) as nh, l_returnflag = 'R' and l_linenumber % 3 = 0 as un, l_partkey, (l_orderkey * 8 + l_linenumber) % 1000 + 1 as s from lineitem)
        select qname, is_unmapped, reference_name, strand, nh, case when not un then concat('id', cast(l_partkey % 12 as varchar)) end as xt, case when un then 'Unassigned_Ambiguity' end as xs, s as start, s + 34 as end, count(*) as n from a group by all""",
    "gtf_genes": "select concat('id', cast(p_partkey as varchar)) as gene_id, concat('id', cast(p_partkey as varchar), '_n', cast(p_partkey % 50 as varchar)) as gene from part where p_partkey % 3 <> 0 and p_partkey % 7 <> 0",
    "barcode_file": f"with {KNOWN} select barcode from sup",
    "count_table": f"with {COUNTED} select * from counted",
    "molecule_store": f"""with {MOLECULES} select cell, gene, umi, depth from molecules union all select 'feature', '', '', count(distinct gene) from molecules union all select 'read_in_cell', '', '', count(distinct cell) from molecules""",
    "packaged_expression": f"with {EXPRESSION} select s.sample, g.gene, e.value from (select distinct sample from expr) s cross join (select distinct gene from expr) g left join expr e on e.sample = s.sample and e.gene = g.gene",
    "regulation_heatmap": f"""with {DENSITIES}, r as (select gene, sample, p_down * s0 as d, p_neutral * s1 as n, p_up * s2 as u from dens)
        select gene, sample, round(sign(u - d) * greatest(u, d) / (d + n + u), 6) as value from r""",
    "gauss_e_step": f"with {STANDARD}, d as (select sample, gene, {', '.join(f'{s} / {g} * exp(cast(-0.5 as double) * pow((z - ({m})) / {g}, 2)) as d{k}' for k, (s, m, g) in enumerate(PARTS))} from std) select sample, gene, {', '.join(f'round(d{k} / (d0 + d1 + d2), 6) as p{k}' for k in range(3))} from d",
    "student_e_step": f"with {STANDARD}, d as (select sample, gene, {', '.join(f'{s} / {g} * pow(1 + pow((z - ({m})) / {g}, 2) / 4, cast(-2.5 as double)) as d{k}' for k, (s, m, g) in enumerate(PARTS))} from std) select sample, gene, {', '.join(f'round(d{k} / (d0 + d1 + d2), 6) as p{k}' for k in range(3))} from d",
    "impute_knn": f"""with {EXPRESSION}, known as (select * from expr where (length(sample) + length(gene) + cast(floor(value) as integer)) % 7 <> 0),
        miss as (select s.sample, g.gene from (select distinct sample from known) s cross join (select distinct gene from known) g where not exists (select 1 from known k where k.sample = s.sample and k.gene = g.gene)),
        d as (select a.gene as g, b.gene as o, sqrt(avg(pow(a.value - b.value, 2))) as dist from known a join known b on a.sample = b.sample and a.gene <> b.gene group by 1, 2),
        near as (select m.gene, m.sample, k.value, row_number() over (partition by m.gene, m.sample order by d.dist, d.o) as r from miss m join d on d.g = m.gene join known k on k.gene = d.o and k.sample = m.sample),
        filled as (select gene, sample, avg(value) as v from near where r <= 3 group by 1, 2), means as (select sample, avg(value) as m from known group by 1)
        select sample, gene, round(value, 4) as value from known union all select m.sample, m.gene, round(coalesce(f.v, means.m), 4) from miss m left join filled f on f.gene = m.gene and f.sample = m.sample join means on means.sample = m.sample""",
    "flat_copy_number": f"with {EXPRESSION} select sample, gene, round(value - median(value) over (partition by gene), 4) as value from expr",
    "edge_tests": f"""with {EXPRESSION}, {MUTATIONS}, {EDGES}, net as (select * from edges where gene <> neighbour and neighbour in (select gene from expr)), v as (select n.gene, n.neighbour, e.sample, e.value from net n join expr e on e.gene = n.neighbour),
        size as (select gene, count(distinct neighbour) as c from net group by 1), whole as (select v.gene, v.sample from v join size using (gene) group by 1, 2, c having count(distinct neighbour) = c),
        m as (select v.*, exists (select 1 from mut where mut.sample = v.sample and mut.hgnc_symbol = v.gene) as hit from v join whole using (gene, sample))
        select gene, neighbour, count(*) filter (where hit) as n1, count(*) filter (where not hit) as n0, round(avg(value) filter (where hit) - avg(value) filter (where not hit), 1) as difference,
         round((coalesce(var_pop(value) filter (where hit) * count(*) filter (where hit), 0) + coalesce(var_pop(value) filter (where not hit) * count(*) filter (where not hit), 0)) / nullif(count(*) - 2, 0) / 1000, 1) as s2 from m group by 1, 2""",
    "driver_evidence": f"with {EVIDENCE} select gene, sample, neighbour, round(p_down, 6) as p_down, round(p_neutral, 6) as p_neutral, round(p_up, 6) as p_up, round(h, 6) as h from evidence",
    "driver_e_step": f"""with {EVIDENCE}, c as (select gene, sample, greatest(least(h, 1 - cast(2.220446049250313e-16 as double)), cast(2.220446049250313e-16 as double)) as h, p_down as a, p_neutral as b, p_up as c from evidence),
        by_pair as (select gene, sample, ln({_mix(0.2, 0.6, 0.2)}) as f0, ln(h * ({_mix(0.6, 0.2, 0.2)}) + (1 - h) * ({_mix(0.1, 0.3, 0.6)})) as f1 from c),
        by_sample as (select gene, sample, sum(f0) as f0, sum(f1) as f1 from by_pair group by 1, 2),
        s as (select *, {_lse('ln(cast(0.9 as double)) + f0', 'ln(cast(0.1 as double)) + f1')} as s0, {_lse('ln(cast(0.2 as double)) + f0', 'ln(cast(0.8 as double)) + f1')} as s1 from by_sample),
        t as (select gene, sum(s0) + ln(cast(0.7 as double)) as t0, sum(s1) + ln(cast(0.3 as double)) as t1 from s group by 1),
        d as (select s.*, t0, t1, {_lse('ln(cast(0.9 as double)) + t0 - s0', 'ln(cast(0.2 as double)) + t1 - s1')} + f0 as e0, {_lse('ln(cast(0.1 as double)) + t0 - s0', 'ln(cast(0.8 as double)) + t1 - s1')} + f1 as e1 from s join t using (gene))
        select sample, gene as hgnc_symbol, round(1 / (1 + exp(e0 - e1)), 5) as p_effect, round(1 / (1 + exp(t0 - t1)), 5) as p_driver from d""",
    "driver_priors": f"""with {DENSITIES}, g as (select distinct gene, s0, s1, s2 from dens), m as (select avg(s0) as m0, avg(s1) as m1, avg(s2) as m2, coalesce(stddev_samp(s0), 0) as d0, coalesce(stddev_samp(s1), 0) as d1, coalesce(stddev_samp(s2), 0) as d2 from g),
        e as (select *, greatest(m0 + 5 * d0, m2 + 5 * d2) / (m0 + 5 * d0 + m1 + m2 + 5 * d2) as top, m0 + m1 + d1 + m2 as w from m)
        select 0 as state, round(m0 / w, 6) as p_down, round((m1 + d1) / w, 6) as p_neutral, round(m2 / w, 6) as p_up from e union all select 1, round(top, 6), round((1 - top) / 2, 6), round((1 - top) / 2, 6) from e union all select 2, round((1 - top) / 2, 6), round((1 - top) / 2, 6), round(top, 6) from e""",
    "integrated_prior": """with b as (select p_partkey as gene, cast(1 + p_partkey % 17 as double) as a, cast(2 + p_partkey % 5 as double) as b from part), l as (select *, lgamma(a + b) - lgamma(a) - lgamma(b) - lgamma(1 + a + b) as c from b)
        select gene, round(c + lgamma(1 + a) + lgamma(b), 6) as log_p0, round(c + lgamma(1 + b) + lgamma(a), 6) as log_p1 from l""",
    "replicated_tables": "select state, p0, p1, p_partkey as name from (values ('none', cast(0.9 as double), cast(0.1 as double)), ('effect', cast(0.2 as double), cast(0.8 as double))) t(state, p0, p1) cross join (select distinct p_partkey from part)",
    "trimmed_values": "select p_partkey, p_name as name, p_partkey % 4 <> 2 as missing from part",
    "cluster_sizes": f"with {CLUSTERS} select cluster, count(*) as n from clusters group by 1",
    "down_sample": f"with {MOLECULES}, {SLOTS.format(seed=3)}, r as (select *, row_number() over (order by h, cell, gene, umi, slot) as rn from slots) select cell, gene, umi, count(*) as depth from r where rn <= 5000 group by 1, 2, 3",
    "down_sample_cell": f"""with {MOLECULES}, {SLOTS.format(seed=0)}, d as (select cell, cast(sum(depth) as bigint) as d from molecules group by 1),
        w as (select cell, least(d, cast(floor(cast(500 as double) * d / (d + 10) + 0.5) as bigint)) as n from d where d + 10 >= 500),
        r as (select s.*, n, row_number() over (partition by cell order by h, cell, gene, umi, slot) as rn from slots s join w using (cell)) select cell, gene, umi, count(*) as depth from r where rn <= n group by 1, 2, 3""",
    "choose_cells": f"with {MOLECULES} select * from molecules where cell < 'G' and cell not like 'A%'",
}
