"""Operators against plain Python on small inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cytolith.functions import stats
from cytolith.functions.dna import hamming, neighbours
from cytolith.operators import annotate, cells, clustering, collapse, driver_model, expression, filters, fuzzy, graph, markers, matrix, mixture, molecules, network, ranks, reads, sample
from cytolith.operators.template import STRUCTURES, compile_template, read_config
from cytolith.sources import packaged


def distance(a, b):
    return sum(x != y for x, y in zip(a, b, strict=False))


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def frame(spark, values, schema):
    return spark.createDataFrame(values, schema)


# -- barcodes


def test_hamming_and_neighbours(spark):
    rng = random.Random(1)
    pairs = [(dna(rng, rng.randrange(1, 9)), dna(rng, rng.randrange(1, 9))) for _ in range(50)]
    got = frame(spark, pairs, "a string, b string").select(hamming(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [distance(a, b) for a, b in pairs]
    for d in (1, 2):
        found = set(frame(spark, [("ACG",)], "b string").select(neighbours(F.col("b"), d)).first()[0])
        assert found == {"".join(x) for x in itertools.product("ACGTN", repeat=3) if distance(x, "ACG") <= d}


@pytest.mark.parametrize("d", [1, 2])
def test_dictionary_is_the_hamming_join(spark, d):
    rng = random.Random(2)
    known = [dna(rng, 4) for _ in range(12)]
    asked = sorted({dna(rng, 4, "ACGTN") for _ in range(200)} | set(known))
    got = {r["q"]: r["corrected"] for r in fuzzy.correct(frame(spark, [(a,) for a in asked], "q string"), "q", frame(spark, [(k,) for k in known], "barcode string"), d).collect()}
    for a in asked:
        near = {k for k in known if distance(a, k) <= d}
        assert got[a] == (a if a in known else near.pop() if len(near) == 1 else None)


def test_primer_merge_reversed(spark):
    pairs = frame(spark, [("AA", "CC"), ("GG", "GG")], "dt string, random string")
    assert {tuple(r) for r in fuzzy.merge_primers(pairs).collect()} == {("AA", "AA"), ("CC", "AA"), ("GG", "GG")}
    assert {tuple(r) for r in fuzzy.merge_primers(pairs, True).collect()} == {("GG", "GG")}


# -- reads


def test_all_structures_compile():
    for name, structure in STRUCTURES.items():
        t = compile_template(structure)
        assert t.n_reads == len(structure) and t.umi_length >= 6, name
    with pytest.raises(ValueError):
        compile_template(STRUCTURES["10X"], 3)
    with pytest.raises(ValueError):
        compile_template({1: {"CB1": [1, 4]}, 2: {"cDNA": []}})
    with pytest.raises(ValueError):
        read_config({"a": {"num_read": 2, "read1": {}}}, "a")


def test_gaps_tails_and_components(spark):
    structure = {1: {"cDNA": []}, 2: {"UMI": [2, 4], "CB2": [7, 8], "CB1": [10, 11]}}
    rows = [(0, "r0", "ACGT", "FFFF", "ATTTCCGGACA", "F" * 11), (1, "r1", "A", "F", "XTTTCCGGACA", "F" * 11), (2, "r2", "", "", "ATTTCCGGACAX", "F" * 12), (3, "r3", "A", "F", "ATTTCCGGAC", "F" * 10), (4, "r4", "", "", "ATTTCCGGACAT", "F" * 12)]
    tuples = frame(spark, [(i, n, s1, q1, s2, q2) for i, n, s1, q1, s2, q2 in rows], "record_id long, name1 string, seq1 string, qual1 string, seq2 string, qual2 string")
    template = compile_template(structure)
    parsed = reads.parse_reads(tuples, template)
    got = {r["record_id"]: (r["cb"], r["umi"]) for r in reads.kept(parsed).collect()}
    assert got == {0: ("CA-GG", "TTT"), 4: ("CA-GG", "TTT")}
    assert [r["value"] for r in reads.tagged_fastq(parsed, template).collect()] == ["@:CB_CA-GG:UB_TTT:r0\nACGT\n+\nFFFF"]
    metrics = {r["metric"]: r["value"] for r in reads.read_metrics(parsed, False).collect()}
    assert metrics == {"read_pass": 2, "read_pass_barcode": 2, "read_pass_polyt": 0, "read_total": 5}


# -- molecules


def state_machine(rows, genes, cells_of):
    """The read-by-read counter that the aggregate restates."""
    depth, seen = {}, []
    for name, run in itertools.groupby(rows, key=lambda r: r["read"]):
        run = list(run)
        first = run[0]
        if first["nh"] == 0:
            continue
        parts = first["cb"].split("-")
        n = [p.count("N") for p in parts]
        if max(n) > 1 or sum(n) > len(parts):
            continue
        cell = cells_of.get(first["cb"])
        if cell is None:
            continue
        seen.append(cell)
        umi = first["umi"]
        if "N" in umi or len(set(umi)) == 1:
            continue
        found, bad = set(), False
        for r in run:
            bad |= r["xt"] is None and r["xs"] == "Unassigned_Ambiguity"
            g = genes.get(r["xt"] or r["reference_name"])
            found |= {g} - {None}
        if not bad and len(found) == 1:
            key = (cell, found.pop(), umi)
            depth[key] = depth.get(key, 0) + 1
    return depth, seen


def test_molecules_equal_the_state_machine(spark):
    rng = random.Random(3)
    rows, k = [], 0
    for read in range(400):
        cb, umi, unmapped = rng.choice(["AC-GT", "AN-GT", "NN-GT", "AN-GN", "TT-TT"]), rng.choice(["ACG", "AAA", "ANG", "CCG"]), rng.random() < 0.1
        for _ in range(rng.choice([1, 1, 2, 3])):
            xt = rng.choice(["g1", "g1", "g2", "g9", None])
            rows.append({"read": read, "aln_id": (k := k + 1), "cb": cb, "umi": umi, "is_unmapped": unmapped, "reference_name": rng.choice(["chr1", "g3"]), "nh": 0 if unmapped else rng.choice([1, 2]), "xt": xt, "xs": rng.choice(["Unassigned_Ambiguity", None]) if xt is None else None})
    genes, cells_of = {"g1": "G1", "g2": "G2", "g3": "G1"}, {"AC-GT": "AC-GT", "AN-GT": "AC-GT", "AN-GN": "X", "NN-GT": "Y"}
    depth, seen = state_machine(rows, genes, cells_of)
    aln = frame(spark, [tuple(r.values()) for r in rows], "read long, aln_id long, cb string, umi string, is_unmapped boolean, reference_name string, nh int, xt string, xs string").repartition(3)
    read = molecules.reads(aln, frame(spark, list(genes.items()), "gene_id string, gene string"), frame(spark, list(cells_of.items()), "cb string, cell string"), by="read")
    assert {(r["cell"], r["gene"], r["umi"]): r["depth"] for r in molecules.molecules(read).collect()} == depth
    info = {r["metric"]: r["value"] for r in molecules.map_info(read).collect()}
    assert info["num_alignment"] == len(rows) and info["num_unique_read"] == 400 and info["num_count_read"] == sum(depth.values())


def test_runs_of_names_across_ranges(spark):
    rng = random.Random(4)
    names = [n for _ in range(300) for n in [rng.choice("abc")] * rng.randrange(1, 4)]
    ids = [k * 700 for k in range(len(names))]  # over several ranges of ids
    runs = [sum(names[j] != names[j - 1] for j in range(1, k + 1)) + 1 for k in range(len(names))]
    df = frame(spark, list(zip(ids, names, strict=True)), "aln_id long, qname string").repartition(5)
    assert [r["run"] for r in molecules.read_runs(df).orderBy("aln_id").collect()] == runs


def test_collapse_keeps_sums_and_joins_neighbours(spark):
    rng = random.Random(5)
    table = {}
    for cell, gene in itertools.product("ab", "xyz"):
        for _ in range(25):
            table[cell, gene, dna(rng, 3)] = rng.choice([1, 1, 1, 2, 3, 10, 60])
    got = {(r["cell"], r["gene"], r["umi"]): r["depth"] for r in collapse.collapse_umis(frame(spark, [(*k, v) for k, v in table.items()], "cell string, gene string, umi string, depth long")).collect()}
    wanted = {}
    for cell, gene in itertools.product("ab", "xyz"):
        own = {u: d for (c, g, u), d in table.items() if (c, g) == (cell, gene)}
        limit = min(max(0.1 * max(own.values()), 2), 5)
        parents = {u: d for u, d in own.items() if d > limit}
        for u, d in own.items():
            near = sorted((-pd, p) for p, pd in parents.items() if distance(u, p) <= 1) if u not in parents else []
            key = (cell, gene, near[0][1] if near else u)
            wanted[key] = wanted.get(key, 0) + d
    assert got == wanted and sum(got.values()) == sum(table.values())


def test_sampling_is_exact(spark):
    mol = frame(spark, [("c", "g", f"u{k}", k % 5 + 1) for k in range(100)], "cell string, gene string, umi string, depth long")
    for n in (0, 1, 150, 300, 999):
        rows = sample.down_sample_to(mol, n, 7).collect()
        assert sum(r["depth"] for r in rows) == min(n, 300)
        assert all(r["depth"] <= int(r["umi"][1:]) % 5 + 1 for r in rows)
    drawn = sample.down_sample(mol, 400, 2, (50, 100, 1000))
    assert list(drawn) == [50, 100] and drawn[50].agg(F.sum("depth")).first()[0] == 75


def test_axes_and_coordinates(spark):
    mol = frame(spark, [("b", "g2", "u", 3), ("a", "g1", "u", 1), ("c", "g1", "v", 1)], "cell string, gene string, umi string, depth long")
    assert {tuple(r) for r in matrix.cell_axis(mol, 2).collect()} == {("a", 1), ("b", 2)}
    genes = matrix.gene_axis(frame(spark, [("g1",), ("g2",), ("g3",)], "gene string"))
    done = matrix.coordinates(matrix.transcript_counts(mol, 2), genes, matrix.cell_axis(mol, 2))
    assert [tuple(r) for r in done.collect()] == [(2, 2, 1)]


# -- cells


def _near(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True)) <= 1


def merge_in_order(rows):
    """One after the other, by falling count."""
    accepted = {}
    for cb, count in sorted(rows, key=lambda x: (-x[1], x[0])):
        near = [a for a in accepted if _near(cb, a)]
        if not near or len(near) == 1 and count > accepted[near[0]] / 10:
            accepted[cb] = count
    return set(accepted)


def absorb_in_order(rows):
    left, heads = sorted(rows, key=lambda x: (-x[1], x[0])), set()
    while left:
        heads.add(left[0][0])
        left = [x for x in left[1:] if not _near(left[0][0], x[0])]
    return heads


@pytest.mark.parametrize("n", [0, 150, 700])
def test_greedy_passes_equal_one_pass(spark, n):
    rng = random.Random(6)
    rows = [(b, rng.choice([rng.randrange(1, 200), 10 ** rng.randrange(4)])) for b in sorted({dna(rng, 5) for _ in range(n)})]
    df = frame(spark, rows, "cb string, cb_count long")
    assert {r["cb"] for r in cells.greedy_merge(df).collect()} == merge_in_order(rows)
    assert {r["cb"] for r in cells.greedy_absorb(df).collect()} == absorb_in_order(rows)


def test_cell_threshold_equals_percentiles(spark):
    rng = random.Random(7)
    counts = [int(5000 / (k + 1) ** 0.5) + rng.randrange(3) for k in range(900)]
    df = frame(spark, [(f"b{k}", c) for k, c in enumerate(counts)], "cb string, cb_count long")
    ordered = np.array(sorted(counts, reverse=True))
    logs = np.log10(np.cumsum(ordered))
    n = int((logs <= 0.8 * logs[-1]).sum())
    q75, q25 = np.percentile(ordered[:n], [75, 25])
    assert cells.cell_threshold(df).first()["threshold"] == pytest.approx((q75 + 1.5 * (q75 - q25)) / 10)
    assert cells.cell_threshold(df, 600).first()["threshold"] == pytest.approx(np.percentile(ordered[:600], 99) / 10)
    assert cells.call_cells(df, 2000, force_cell=True).count() == 900


def test_candidates_pipeline(spark):
    rows = [(dna(random.Random(k), 6), 1000 + k, [300, 300]) for k in range(20)] + [("GGGGGG", 5000, [1, 1]), ("ACGTNN", 900, [200, 200])]
    listed, removed = cells.candidates(frame(spark, rows, "cb string, cb_count long, t_count array<long>"), [], 15)
    found = {r["cb"] for r in cells.detected(listed, removed).collect()}
    assert "GGGGGG" not in found and "ACGTNN" not in found and len(found) >= 15


# -- annotation


@pytest.mark.parametrize("strand", [0, 1, 2])
def test_overlaps_equal_the_nested_loop(spark, strand):
    rng = random.Random(8)
    aln = [(k, rng.choice("xy"), s := rng.randrange(60_000), s + rng.randrange(40_000), rng.choice("+-")) for k in range(60)]
    exon = [(f"g{k % 9}", rng.choice("xy"), s := rng.randrange(60_000), s + rng.randrange(30_000), rng.choice("+-")) for k in range(40)]
    ok = {0: lambda a, b: True, 1: lambda a, b: a == b, 2: lambda a, b: a != b}[strand]
    wanted = {(a[0], e[0]) for a in aln for e in exon if a[1] == e[1] and a[2] <= e[3] and a[3] >= e[2] and ok(a[4], e[4])}
    got = annotate.overlaps(frame(spark, aln, "aln_id long, chrom string, start long, end long, strand string"), frame(spark, exon, "gene_id string, chrom string, start long, end long, strand string"), strand)
    assert {tuple(r) for r in got.collect()} == wanted


@pytest.mark.parametrize("strand", [0, 1, 2])
def test_annotation_equals_the_nested_loop(spark, strand):
    rng = random.Random(9)
    aln = [(k, rng.choice("xy"), s := rng.randrange(3000), s + rng.randrange(rng.choice([1, 50, 800])), rng.choice("+-"), 1 + (k % 7 == 0)) for k in range(400)]
    exon = [(f"g{k % 13}", rng.choice("xy"), s := rng.randrange(3000), s + rng.randrange(200), rng.choice("+-")) for k in range(60)]
    ok = {0: lambda a, b: True, 1: lambda a, b: a == b, 2: lambda a, b: a != b}[strand]
    got = annotate.annotate(frame(spark, aln, "aln_id long, chrom string, start long, end long, strand string, nh int"), frame(spark, exon, "gene_id string, chrom string, start long, end long, strand string"), strand)
    for r in got.collect():
        a = aln[r["aln_id"]]
        hit = {e[0] for e in exon if a[1] == e[1] and a[2] <= e[3] and a[3] >= e[2] and ok(a[4], e[4])} if a[5] == 1 else set()
        assert (r["xt"], r["xs"]) == (next(iter(hit)) if len(hit) == 1 else None, "Unassigned_Ambiguity" if len(hit) > 1 else None)


def test_segments_of_an_annotation(spark):
    exon = [("a", "x", 10, 20, "+"), ("b", "x", 15, 30, "+"), ("a", "x", 31, 40, "+"), ("a", "x", 41, 45, "+"), ("c", "x", 100, 100, "-")]
    got = annotate.segments(frame(spark, exon, "gene_id string, chrom string, start long, end long, strand string"))
    assert sorted((r["start"], r["end"], r["low"], r["high"], r["strand"]) for r in got.collect()) == [(10, 14, "a", "a", "+"), (15, 20, "a", "b", "+"), (21, 30, "b", "b", "+"), (31, 45, "a", "a", "+"), (100, 100, "c", "c", "-")]


ALN, EXON = "aln_id long, chrom string, start long, end long, strand string, nh int", "gene_id string, chrom string, start long, end long, strand string"


def joined_rows(spark, run):
    """Rows that the joins of run() put out."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total, done = 0, store.executionsList()
    for x in {done.apply(k).executionId() for k in range(done.size())} - before:
        nodes, values = store.planGraph(x).allNodes(), store.executionMetrics(x)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size()) if "Join" in node.name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


@pytest.mark.parametrize("genes", [6, 600])
def test_deep_annotation_makes_no_pairs(spark, genes):
    rng = random.Random(12)
    exon = [(f"g{k % genes}", "x", s := rng.randrange(3000), s + 900 + rng.randrange(100), "+") for k in range(600)]
    got = []
    made = joined_rows(spark, lambda: got.extend(annotate.segments(frame(spark, exon, EXON)).collect()))
    assert 0 < made < 40 * len(exon)  # of pairs there are some 150,000
    at = {p: (r["low"], r["high"]) for r in got for p in range(r["start"], r["end"] + 1)}
    assert len(at) == sum(r["end"] - r["start"] + 1 for r in got)
    for p in range(4100):
        held = [e[0] for e in exon if e[2] <= p <= e[3]]
        assert at.get(p) == ((min(held), max(held)) if held else None)


def test_short_alignments_are_not_shuffled(spark):
    exon = frame(spark, [("a", "x", 10, 20, "+"), ("b", "x", 15, 30, "+")], EXON)
    aln = frame(spark, [(1, "x", 5, 12, "+", 1), (2, "x", 18, 19, "+", 1), (3, "x", 31, 40, "+", 1)], ALN)
    got = annotate.annotate(aln, exon)
    assert {r["aln_id"]: (r["xt"], r["xs"]) for r in got.collect()} == {1: ("a", None), 2: (None, "Unassigned_Ambiguity"), 3: (None, None)}
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [0, 100_000])
def test_exons_then_introns_equal_the_nested_loop(spark, small, monkeypatch):
    monkeypatch.setattr(annotate, "SMALL", small)
    rng = random.Random(13)
    aln = [(k, rng.choice("xy"), s := rng.randrange(30_000), s + rng.randrange(rng.choice([1, 90, 9000])), rng.choice("+-"), 1 + (k % 7 == 0)) for k in range(300)] + [(300, None, None, None, "+", 1), (301, "x", 5, 900, None, None)]
    whole = [(f"g{k}", rng.choice("xy"), s := rng.randrange(30_000), s + 300 + rng.randrange(3000), rng.choice("+-")) for k in range(25)]
    exon = [(g, c, p := s + rng.randrange(e - s - 60), p + rng.randrange(60), side) for g, c, s, e, side in whole for _ in range(3)]
    hit = lambda a, table: {x[0] for x in table if a[1] == x[1] and a[4] == x[4] and a[2] <= x[3] and a[3] >= x[2]} if a[1] and (a[5] or 1) == 1 else set()
    got = annotate.annotate(frame(spark, aln, ALN), frame(spark, exon, EXON), introns=frame(spark, whole, EXON)).collect()
    assert sorted(r["aln_id"] for r in got) == list(range(302))
    for r in got:
        genes = hit(aln[r["aln_id"]], exon) or hit(aln[r["aln_id"]], whole)
        assert (r["xt"], r["xs"]) == (next(iter(genes)) if len(genes) == 1 else None, "Unassigned_Ambiguity" if len(genes) > 1 else None)


def test_sums_below_by_ranges(spark):
    rng = random.Random(10)
    rows = sorted({(rng.choice("ab"), round(float(rng.choice([rng.random(), rng.randrange(5)])), 3)) for _ in range(500)})
    held = [(g, v, rng.randrange(9), rng.randrange(3)) for g, v in rows]
    got = ranks.below(frame(spark, held, "g string, v double, n long, m long"), ["g"], "v", ["n", "m"], parts=7).collect()
    assert len(got) == len(held)
    for r in got:
        assert (r["_below_n"], r["_below_m"]) == tuple(sum(x[k] for x in held if x[0] == r["g"] and x[1] < r["v"]) for k in (2, 3))


def test_auc_of_sets_of_clusters(spark):
    rng = random.Random(11)
    scored = [(f"c{k}", t, float(rng.randrange(12))) for k in range(90) for t in "TB"]
    placed = {f"c{k}": rng.choice("xyz") for k in range(90)}
    pairs = markers.PairAuc(frame(spark, scored, "cell string, cell_type string, score double"), frame(spark, list(placed.items()), "cell string, cluster string"))
    for t in "TB":
        for mine, among in (({"x"}, {"x", "y", "z"}), ({"x", "z"}, {"x", "y", "z"}), ({"y"}, {"y", "z"})):
            a = [s for c, u, s in scored if u == t and placed[c] in mine]
            b = [s for c, u, s in scored if u == t and placed[c] in among - mine]
            assert pairs.auc(t, mine, among) == pytest.approx(sum((x > y) + 0.5 * (x == y) for x in a for y in b) / (len(a) * len(b)))
    assert pairs.auc("T", {"x"}, {"x"}) == 0.5 and pairs.auc("none", {"x"}, {"x", "y"}) == 0.5


def test_components_of_all_genes_are_those_of_the_covariance(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 40)) * np.array([5.0]) + rng.standard_normal((60, 40))
    x = np.where(x > 0, x, 0.0)
    rows = [(f"c{i:02}", f"g{j:02}", float(x[i, j])) for i in range(60) for j in range(40) if x[i, j]]
    values = frame(spark, rows, "cell string, gene string, value double")
    got = {r["cell"]: r["pc"].toArray() for r in clustering.components(values, values.select("gene").distinct(), 3, rounds=12).collect()}
    scaled = x / x.std(0, ddof=1)
    u, s, vt = np.linalg.svd(scaled - scaled.mean(0), full_matrices=False)
    wanted, pc = u[:, :3] * s[:3], np.stack([got[f"c{i:02}"] for i in range(60)])
    pc = pc - pc.mean(0)
    for k in range(3):
        assert abs(np.corrcoef(wanted[:, k], pc[:, k])[0, 1]) > 0.9999 and np.linalg.norm(pc[:, k]) == pytest.approx(s[k], rel=1e-3)


def test_blocks_do_not_change_imputation(spark):
    rng = random.Random(13)
    rows = [(f"s{i}", f"g{j:02}", None if rng.random() < 0.15 else rng.gauss(j, 1)) for i in range(15) for j in range(25)]
    df = frame(spark, rows, "sample string, gene string, value double")
    named = lambda block: {(r["sample"], r["gene"]): r["value"] for r in expression.impute_knn(df, 4, block=block).collect()}
    one, many = named(1000), named(4)
    assert one.keys() == many.keys() == {(s, g) for s, g, _ in rows} and all(math.isclose(one[k], many[k]) for k in one)


def test_a_weighted_fit_is_that_of_repeated_values():
    rng = np.random.default_rng(14)
    x = np.sort(np.round(np.concatenate([rng.normal(2, 0.3, 60), rng.normal(4, 0.2, 300)]), 1))
    values, n = np.unique(x, return_counts=True)
    (a, cut_a), (b, cut_b) = mixture.fit_totals(x), mixture.fit_totals(values, weight=n)
    assert cut_a == pytest.approx(cut_b) and a.mu == pytest.approx(b.mu, rel=1e-6) and a.loglik == pytest.approx(b.loglik, rel=1e-9)


def test_moderated_tests_equal_those_of_the_matrix(spark):
    rng = random.Random(15)
    samples = [f"s{k}" for k in range(30)]
    expr = frame(spark, [(s, g, rng.gauss(0, 1) + (2 if g == "n0" and k < 8 else 0)) for k, s in enumerate(samples) for g in ("n0", "n1", "n2")], "sample string, gene string, value double")
    mut = frame(spark, [(s, "m", "MISSENSE") for s in samples[:8]], "sample string, hgnc_symbol string, variant_type string")
    edges = frame(spark, [("m", f"n{k}", 1.0) for k in range(3)], "gene string, neighbour string, weight double")
    rows = {r["neighbour"]: r for r in network.edge_tests(edges, expr, mut).collect()}
    values = {(r["sample"], r["gene"]): r["value"] for r in expr.collect()}
    for g, r in rows.items():
        a, b = (np.array([values[s, g] for s in part]) for part in (samples[:8], samples[8:]))
        assert r["difference"] == pytest.approx(a.mean() - b.mean()) and r["s2"] == pytest.approx((a.var() * 8 + b.var() * 22) / 28)
    p = {r["neighbour"]: r["p"] for r in network.differential_edges(edges, expr, mut).collect()}
    assert p["n0"] < 0.01 < min(p["n1"], p["n2"])


def test_leaf_order_puts_like_rows_together():
    x = np.array([[0.0, 0.1], [5.0, 5.2], [0.1, 0.0], [5.1, 5.0], [9.0, 9.0]])
    order = stats.leaf_order(x)
    assert order[0] in (0, 2) and set(order[:2]) == {0, 2} and order[2] == 4 and stats.leaf_order(x[:1]) == [0]


def test_dirichlet_draws_repeat(spark):
    names = frame(spark, [(f"n{k}",) for k in range(2000)], "name string")
    draw = lambda parts: {r["name"]: r["share"] for r in driver_model.dirichlet_draws(names.repartition(parts), [2.0, 5.0, 1.0], 3).collect()}
    a, b = draw(1), draw(5)
    assert a == b and np.allclose(np.array(list(a.values())).mean(0), np.array([2, 5, 1]) / 8, atol=0.02)


def test_packages_of_files(spark, tmp_path):
    for name, text in {"expr": "s,A,B.1\np1,1.5,NA\np2,2,3\n", "cna.logr": "s,A\np1,0.1\n", "cna.call": "s,A\np1,-2\n", "mut": "sample,hgnc_symbol,variant_type,x\np1,A,HOMD,1\n", "net": "gene,neighbour,weight\nA,B,0.5\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = {k: sorted(map(tuple, df.collect()), key=str) for k, df in packaged.read_package(spark, str(tmp_path)).items()}
    assert got == {"expr": [("p1", "A", 1.5), ("p1", "B.1", None), ("p2", "A", 2.0), ("p2", "B.1", 3.0)], "cna.logr": [("p1", "A", 0.1)], "cna.call": [("p1", "A", -2)], "mut": [("p1", "A", "HOMD")], "net": [("A", "B", 0.5)]}


def test_neighbours_and_communities(spark):
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(c, 0.3, (25, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    points = spark.createDataFrame([(f"c{i:02}", Vectors.dense(v)) for i, v in enumerate(x)], ["cell", "pc"])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    wanted = {(f"c{i:02}", f"c{j:02}") for i in range(75) for j in np.argsort(d[i], kind="stable")[:6]}
    near = graph.nearest(points, 6, block=20)
    assert {(r["cell"], r["near"]) for r in near.collect()} == wanted
    edges = graph.shared_neighbours(near)
    sets = {f"c{i:02}": {b for a, b in wanted if a == f"c{i:02}"} | {f"c{i:02}"} for i in range(75)}
    for r in edges.collect():
        assert r["weight"] == pytest.approx(len(sets[r["a"]] & sets[r["b"]]) / len(sets[r["a"]] | sets[r["b"]]))
    found = {r["node"]: r["community"] for r in graph.communities(edges, 0.3, 4, 2).collect()}
    groups = [{found[f"c{i:02}"] for i in range(k, k + 25)} for k in (0, 25, 50)]
    assert not groups[0] & groups[1] and not groups[0] & groups[2] and not groups[1] & groups[2]


def test_communities_raise_modularity(spark):
    rng = random.Random(17)
    names = [f"n{k}" for k in range(40)]
    weight = {}
    for i in range(40):
        for j in range(i):
            if rng.random() < (0.6 if i // 10 == j // 10 else 0.05):
                weight[names[i], names[j]] = weight[names[j], names[i]] = rng.random()
    found = {r["node"]: r["community"] for r in graph.communities(frame(spark, [(a, b, w) for (a, b), w in weight.items()], "a string, b string, weight double"), 1.0, 5, 2).collect()}
    total = sum(weight.values())
    degree = {n: sum(w for (a, _), w in weight.items() if a == n) for n in names}

    def modularity(of):
        return sum(w for (a, b), w in weight.items() if of[a] == of[b]) / total - sum(sum(degree[n] for n in names if of.get(n) == c) ** 2 for c in set(of.values())) / total**2

    assert modularity(found) >= modularity({n: k // 10 for k, n in enumerate(names)}) - 0.02


def test_copy_number_is_taken_off(spark):
    rng = random.Random(18)
    cna = [(f"s{k}", g, float(rng.choice([-2, -1, 0, 1, 2])) if g == "a" else 0.0) for k in range(40) for g in "ab"]
    expr = [(s, g, 3 * c + rng.gauss(0, 0.2) + 10) for s, g, c in cna]
    for kind in ("gp", "svm"):
        got = {(r["sample"], r["gene"]): r["value"] for r in expression.remove_copy_number(frame(spark, expr, "sample string, gene string, value double"), frame(spark, cna, "sample string, gene string, value double"), kind).collect()}
        a = np.array([got[s, g] for s, g, _ in cna if g == "a"])
        assert a.std() < 0.25 * np.std([v for _, g, v in expr if g == "a"]), kind
        b = np.array([v for _, g, v in expr if g == "b"])
        assert np.allclose([got[s, g] for s, g, _ in cna if g == "b"], b - np.median(b))


def test_support_vector_regression_follows_the_levels():
    rng = np.random.default_rng(21)
    x = rng.integers(-2, 3, 60).astype(float)
    y = np.sin(x) * 3 + rng.normal(0, 0.3, 60)
    residual = expression._support_vector_residual(x, y, tolerance=1e-6)
    by_level = [residual[x == v] for v in np.unique(x)]
    # within a level all values share one prediction, inside or at the edge of most of its values
    assert all(abs(np.median(r)) < 0.5 for r in by_level) and all(np.ptp(y[x == v] - residual[x == v]) < 1e-9 for v in np.unique(x))


def test_densities_are_those_of_the_fitted_parts(spark):
    rng = random.Random(19)
    expr = [(f"s{k:02}", "g", rng.gauss(5, 1) + (4 if k < 5 else 0)) for k in range(40)]
    for kind in ("student", "gauss"):
        rows = sorted(expression.distributions(frame(spark, expr, "sample string, gene string, value double"), None, kind).collect(), key=lambda r: r["sample"])
        m = mixture.fit_expression(np.array([v for _, _, v in expr]), None, kind == "student")
        assert rows[0]["mu"] == pytest.approx(m.mu.tolist())
        wanted = np.exp(m.log_density(np.array([v for _, _, v in expr])))
        assert np.allclose([[r["p_down"], r["p_neutral"], r["p_up"]] for r in rows], wanted)


def test_expression_weights_by_direct_fit(spark):
    rng = random.Random(20)
    rows = [(s, f"g{k:03}", rng.gauss(0, 0.5) if k < 40 else rng.gauss(6, 0.8)) for k in range(120) for s in range(12)]
    got = {r["gene"]: r["weight"] for r in expression.expression_weights(frame(spark, rows, "sample long, gene string, value double")).collect()}
    q = np.array([np.quantile([v for _, g, v in rows if g == f"g{k:03}"], 0.9) for k in range(120)])
    low, high = stats.boxplot_fences(np.sort(q))
    inside = (q >= low) & (q <= high)
    y = np.sort(q[inside])
    th = np.quantile(y, 0.3)
    parts = (y[y <= th], y[y > th])
    m = mixture.fit(y, [0.3, 0.7], [p.mean() for p in parts], [p.std(ddof=1) for p in parts], 2)
    for k in np.flatnonzero(inside):
        assert got[f"g{k:03}"] == pytest.approx(m.responsibilities(q[k : k + 1])[0, 1], abs=1e-6)
    assert np.mean([got[f"g{k:03}"] for k in range(120) if k >= 40 and f"g{k:03}" in got]) > 0.9


# -- statistics


def test_kernels():
    x = np.array([[0.0, -1.0], [-700.0, -701.0]])
    assert stats.log_sum_exp(x, 1) == pytest.approx([math.log(1 + math.exp(-1)), -700 + math.log(1 + math.exp(-1))])
    assert stats.log_sum_exp(np.array([-np.inf, -np.inf])) == -np.inf
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and stats.t_two_sided(1.96, 1e12) == pytest.approx(0.0499958, abs=1e-6)
    assert stats.digamma(1.0) == pytest.approx(-0.5772156649) and stats.trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert stats.trigamma(stats.trigamma_inverse(0.3)) == pytest.approx(0.3)
    assert stats.minimise(lambda v: (v - 2) ** 2, 0, 5) == pytest.approx(2, abs=1e-4)
    assert stats.benjamini_hochberg(np.array([0.01, 0.04, np.nan, 0.03])) == pytest.approx([0.03, 0.04, np.nan, 0.04], nan_ok=True)


@pytest.mark.parametrize("student", [False, True])
@pytest.mark.parametrize("equal", [False, True])
def test_mixtures_climb_and_find_parts(student, equal):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(-4, 1, 200), rng.normal(3, 1, 300)])
    m = mixture.fit(x, k=2, student=student, equal_sigma=equal)
    assert m.posterior.sum(1) == pytest.approx(1)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(m.trace, m.trace[1:], strict=False))
    assert sorted(m.mu) == pytest.approx([-4, 3], abs=0.5) and min(m.share) == pytest.approx(0.4, abs=0.05)


def test_expression_start_and_errors():
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, 60)
    mutated = np.zeros(60)
    x[:6] += 5
    mutated[:6] = 1
    share, mu, sigma = mixture.three_part_start(x, mutated)
    assert share.sum() == pytest.approx(1) and mu[2] > mu[1] > mu[0]
    with pytest.raises(ValueError):
        mixture.three_part_start(x[:19])
    with pytest.raises(ValueError):
        mixture.three_part_start(np.ones(30))


def test_low_counts_are_cut(spark):
    rng = np.random.default_rng(11)
    totals = np.concatenate([10 ** rng.normal(1.5, 0.2, 60), 10 ** rng.normal(4, 0.2, 400)]).astype(int) + 1
    kept = filters.low_count_filter(frame(spark, [(f"c{k}", "g", int(v)) for k, v in enumerate(totals)], "cell string, gene string, count long"), 0.1)
    assert 395 <= kept.count() <= 405


def test_auc_symmetry_and_one_class(spark):
    rng = random.Random(12)
    rows = [("g", float(rng.randrange(5)), rng.random() < 0.4) for _ in range(200)]
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    wanted = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    schema = "g string, score double, label boolean"
    assert markers.rank_auc(frame(spark, rows, schema), ["g"]).first()["auc"] == pytest.approx(wanted)
    assert markers.rank_auc(frame(spark, [(g, -s, y) for g, s, y in rows], schema), ["g"]).first()["auc"] == pytest.approx(1 - wanted)
    assert markers.rank_auc(frame(spark, [("g", 1.0, True)], schema), ["g"]).first()["auc"] == 0.5


def test_clusters_get_their_types(spark):
    rng = random.Random(13)
    counts, clusters = [], []
    for k in range(90):
        kind = "TBM"[k % 3]
        clusters.append((f"c{k}", f"k{k % 3}"))
        counts += [(f"c{k}", g, rng.randrange(1, 4) + 20 * (g == kind)) for g in "TBM"] + [(f"c{k}", "X", 50)]
    table = frame(spark, [("t cell", "T", "+"), ("b cell", "B", "+"), ("m cell", "M", "+")], "cell_type string, gene string, sign string")
    auc, labels = markers.annotate_clusters(frame(spark, counts, "cell string, gene string, count long"), frame(spark, clusters, "cell string, cluster string"), table)
    assert {r["cluster"]: r["label"] for r in labels.collect()} == {"k0": "t cell", "k1": "b cell", "k2": "m cell"}
    assert all(r["auc"] > 0.99 for r in auc.collect())


@pytest.mark.parametrize("method", ["graph", "kmeans"])
def test_cells_of_different_types_cluster_apart(spark, method):
    rng = random.Random(14)
    counts = [(f"c{k}", f"g{j}", rng.randrange(1, 3) + 30 * (j % 2 == k % 2)) for k in range(60) for j in range(12)]
    done = clustering.cluster_cells(frame(spark, counts, "cell string, gene string, count long"), 0.2, 3, method=method, neighbours=10, rounds=4, levels=2)
    mixed = done.groupBy("cluster").agg(F.count_distinct(F.expr("int(substring(cell, 2)) % 2")).alias("n"))
    found = [r["n"] for r in mixed.collect()]
    assert len(found) >= 2 and set(found) == {1}
    assert clustering.silhouette(done) > 0.3
    assert clustering.extract_best([{"n": 2, "silhouette": 0.9, "auc": 1}, {"n": 4, "silhouette": 0.1, "auc": 0.2}, {"n": 5, "silhouette": 0.3, "auc": 0.1}]) == (2, 1)


def test_differential_edges_find_the_shifted_neighbour(spark):
    rng = np.random.default_rng(15)
    expr = [(f"s{k}", g, float(rng.normal(5 * (g == "n1" and k < 8), 1))) for k in range(40) for g in ("n1", "n2", "n3")]
    edges = frame(spark, [("m", n, 0.5) for n in ("n1", "n2", "n3")] + [("q", "n1", 0.5)], "gene string, neighbour string, weight double")
    mut = frame(spark, [(f"s{k}", "m") for k in range(8)] + [("s0", "q")], "sample string, hgnc_symbol string")
    rows = {(r["gene"], r["neighbour"]): r["p"] for r in network.differential_edges(edges, frame(spark, expr, "sample string, gene string, value double"), mut).collect()}
    assert rows["m", "n1"] < 1e-6 < rows["m", "n2"] and math.isnan(rows["q", "n1"] if rows["q", "n1"] is not None else math.nan)


def test_imputation_fills_from_near_genes(spark):
    rows = [(f"s{j}", f"g{k}", None if (k, j) == (0, 2) else float(10 * (k // 3) + j)) for k in range(6) for j in range(6)]
    got = {(r["gene"], r["sample"]): r["value"] for r in expression.impute_knn(frame(spark, rows, "sample string, gene string, value double"), 2).collect()}
    assert got["g0", "s2"] == pytest.approx(2.0) and len(got) == 36


# -- the mutation model


def enumerated(p, h, t):
    """Posteriors of one gene by summing over all states."""
    m, n, _ = p.shape
    joint = {}
    for d in (0, 1):
        for f in itertools.product((0, 1), repeat=m):
            value = t.p_d[d]
            for i in range(m):
                value *= t.p_df[d, f[i]]
                for j in range(n):
                    if f[i] == 0:
                        value *= t.p_fg[0] @ p[i, j]
                    else:
                        value *= h[j] * (t.p_fg[1] @ p[i, j]) + (1 - h[j]) * (t.p_fg[2] @ p[i, j])
            joint[d, f] = value
    total = sum(joint.values())
    effect = [sum(v for (_, f), v in joint.items() if f[i]) / total for i in range(m)]
    df = np.zeros((2, 2))
    for (d, f), v in joint.items():
        for i in range(m):
            df[d, f[i]] += v / total
    return math.log(total), sum(v for (d, _), v in joint.items() if d) / total, effect, df


def tables():
    return driver_model.Tables(np.array([0.7, 0.3]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[0.1, 0.8, 0.1], [0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]), np.full(2, 2.0), np.full((2, 2), 2.0), np.full((3, 3), 2.0), 0.7)


def test_inference_equals_enumeration():
    rng = np.random.default_rng(16)
    for _ in range(5):
        p, h, t = rng.uniform(0.05, 1, (3, 4, 3)), rng.uniform(0.1, 0.9, 4), tables()
        got = driver_model.infer_gene(p, h, t)
        loglik, driver, effect, df = enumerated(p, h, t)
        assert got["loglik"] == pytest.approx(loglik) and got["p_d"][1] == pytest.approx(driver)
        assert got["p_effect"] == pytest.approx(effect) and got["df"] == pytest.approx(df)
        assert got["fg"].sum() == pytest.approx(12) and got["p_g"].sum(2) == pytest.approx(np.ones((3, 4)))
        assert ((got["p_up"] > 0) & (got["p_up"] < 1)).all()


def test_learning_climbs(spark):
    rng = np.random.default_rng(17)
    rows = [(f"g{g}", f"s{s}", f"n{n}", *map(float, rng.uniform(0.1, 1, 3)), float(rng.uniform(0.2, 0.8))) for g in range(6) for s in range(4) for n in range(3)]
    data = frame(spark, rows, driver_model.EVIDENCE)
    learned, trace = driver_model.learn(data, tables(), 6)
    assert len(trace) >= 2 and trace[1] >= trace[0] - 1e-6
    assert learned.p_fg.sum(1) == pytest.approx(1) and learned.p_d.sum() == pytest.approx(1)
    out = driver_model.posterior_table(driver_model.infer(data, learned)).collect()
    assert len(out) == 24 and all(0 <= r["p_driver"] <= 1 and 0 <= r["p_effect"] <= 1 for r in out)
