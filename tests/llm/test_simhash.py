import random
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cytolith.llm import op7_simhash_golay as op
from cytolith.llm.common import materialise, spread_join


def fingerprint(text):
    """By the contract, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """doc -> smallest doc reachable, over all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)] + ["Wörter", "É", "a\x1cb"]
    texts = [None, "", "  \n", "one", "ONE", "two words", " "]
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            texts.append("\t".join(near))
    return dict(enumerate(texts))


def test_against_brute_force(documents):
    texts = corpus()
    fps = {k: fingerprint(t) for k, t in texts.items()}
    rows = {r["doc_id"]: r for r in op.near_duplicates(documents(texts)).collect()}
    assert {k: r["fingerprint"] for k, r in rows.items()} == {k: f"{f:016x}" for k, f in fps.items()}
    assert {k: r["component_id"] for k, r in rows.items()} == components(fps)


def test_golay_code_is_perfect():
    patterns = op.error_patterns()
    assert np.bitwise_count(patterns[:, 0]).max() == 3
    assert all(op.syndrome(p[p >= 0]).tolist() == [s] * int((p >= 0).sum()) for s, p in enumerate(patterns))
    counts = (patterns[:, 1:] >= 0).sum(1)
    assert set(counts[np.bitwise_count(patterns[:, 0]) == 3]) == {5} and set(counts[np.bitwise_count(patterns[:, 0]) < 3]) == {0}


def test_every_close_pair_shares_a_key():
    rng = random.Random(8)
    for _ in range(5000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(4)):
            b ^= 1 << bit
        x, y = (np.array([v], np.uint64).view(np.int64) for v in (a, b))
        assert set(op.keys_of(x)[0].tolist()) & set(op.keys_of(y)[0].tolist())


def test_links_and_components_of_chains(spark):
    rng = random.Random(9)
    value, chain = rng.getrandbits(64), []
    for k in range(20):  # a chain whose ends are far apart
        value ^= 0b111 << (3 * k)
        chain.append(value)
    far = [rng.getrandbits(64) for _ in range(50)]
    signed = [v - (1 << 64) if v >> 63 else v for v in chain + far]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {(r["a"], r["b"]) for r in op.links(df).collect()}
    wanted = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert found == wanted and len(found) == 19
    roots = {r["node"]: r["root"] for r in op.components(op.links(df)).collect()}
    assert len(roots) == 20 and set(roots.values()) == {min(signed[:20])}


def test_one_of_each_group_stays(documents):
    words = " ".join(f"w{k}" for k in range(60))
    docs = documents([(5, words), (3, words), (9, words.upper()), (4, "other text of its own"), (4, "other text of its own"), (None, words), (7, None), (8, "")])
    kept = op.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 7), (True, 0)]


def test_empty_and_null_ids(documents):
    assert op.near_duplicates(documents([])).count() == 0
    assert op.representatives(documents([])).count() == 0
    rows = op.near_duplicates(documents([(None, "a b c d"), (None, "a b c d")])).collect()
    assert [r["component_id"] for r in rows] == [None, None]


def jaccard(a, b):
    """Of the 5-word shingles, by plain sets."""
    x, y = ({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_stage_groups_by_five_word_similarity(documents):
    rng = random.Random(11)
    texts, vocabulary = [None, "", "  ", "one two", "ONE  two", "one three"], [f"w{k}" for k in range(500)]
    for size in [*(rng.randrange(5) for _ in range(40)), 60]:
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 250))]
        texts.append(" ".join(words))
        for _ in range(size):
            near = list(words)
            for _ in range(rng.randrange(1, 9)):
                near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    ids = dict(enumerate(texts))
    root = {k: k for k in ids}
    for a in ids:
        for b in ids:
            if a < b and jaccard(ids[a] or "", ids[b] or "") >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    docs = documents(ids)
    assert {r["doc_id"]: r["component_id"] for r in op.similar_groups(docs).collect()} == root
    assert {r["doc_id"] for r in op.representatives(docs).collect()} == set(root.values())
    # the query's link alone leaves many of these apart
    assert {r["doc_id"]: r["component_id"] for r in op.near_duplicates(docs).collect()} != root


def test_a_dense_ball_of_fingerprints(spark):
    """Its links aren't all listed, but join all that they should."""
    rng = random.Random(12)
    centre = rng.getrandbits(63)
    ball = {centre ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(1, 6))) for _ in range(600)}
    df = spark.createDataFrame([(v,) for v in ball], "fp long")
    found = op.links(df)
    assert found.count() < 20 * len(ball)
    roots = {r["node"]: r["root"] for r in op.components(found).collect()}
    wanted = components({v: v for v in ball})
    assert {v: roots.get(v, v) for v in ball} == wanted


def test_a_prevalent_key_is_dealt_out(spark):
    left = spark.range(5000).selectExpr("if(id % 3 = 0, null, if(id % 2 = 0, 7, id)) as k", "id").select(F.col("k").cast("long"), "id")
    right = spark.range(4000).selectExpr("id as k", "id * 2 as v")
    for how in ("inner", "left"):
        rows = sorted(map(tuple, spread_join(left, right, "k", how).collect()), key=str)
        assert rows == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)


def test_long_texts_in_blocks(monkeypatch):
    rng = random.Random(13)
    text = " ".join(rng.choice(["a", "Bc", "déf", "\x1c", "x" * 50]) for _ in range(3000))
    whole = op.fingerprint(text), op.shingle_set(text)
    assert whole[0] == fingerprint(text)
    monkeypatch.setattr(op, "BLOCK", 97)
    assert op.fingerprint(text) == whole[0] and np.array_equal(op.shingle_set(text), whole[1])
    assert [op.fingerprint(t) for t in (" ", "a", "a b", "x" * 300)] == [fingerprint(t) for t in (" ", "a", "a b", "x" * 300)]


def test_very_long_text(documents):
    docs = documents({1: "some words of a text " * 500_000, 2: "x" * 10_000_000, 3: "some words of a text " * 500_000 + "more"})
    got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    assert {r["doc_id"] for r in op.representatives(docs).collect()} == {1, 2}


def codewords():
    """All words of the Golay code, by multiplying with its generator."""
    words = []
    for message in range(1 << 12):
        word = 0
        for k in range(12):
            if message >> k & 1:
                word ^= op.GENERATOR << k
        words.append(word)
    return np.array(words)


def near_copies(rng, count):
    """Sets of hashes in pairs of a similarity of 0.8: 8 of 10, 9 of them in each."""
    for _ in range(count):
        size = rng.randrange(1, 40)
        drawn = np.array([rng.getrandbits(64) for _ in range(10 * size)], np.uint64)
        yield drawn[: 9 * size], np.concatenate([drawn[: 8 * size], drawn[9 * size :]])


def test_stage_fingerprints_bit_by_bit():
    rng = random.Random(14)
    for size in (1, 2, 5, 254, 255, 256, 700):
        shingles = np.array([rng.getrandbits(64) for _ in range(size)], np.uint64)
        hashes = np.array([op._mixed(h + op._multipliers()[0]) for h in shingles])
        wanted = [sum(1 << b for b in range(64) if 2 * int((hashes[:, k] >> np.uint64(b) & np.uint64(1)).sum()) > size) for k in range(op.PLANES)]
        assert op.wide_fingerprint(shingles).tolist() == wanted


def test_stage_keys_are_nearest_codewords():
    rng = np.random.default_rng(15)
    code = codewords()
    wide = rng.integers(0, 1 << 63, (3, op.PLANES), np.uint64)
    bits = np.unpackbits(wide.view(np.uint8), axis=1).reshape(3, op.PLANES, 64)
    for turn in (0, 1, 3):
        keys = op.wide_keys(wide, turn)
        for row in range(3):
            for w in range(64):
                word = sum(int(bits[row, k, (w + turn * k) % 64]) << k for k in range(op.PLANES))
                nearest = code[np.bitwise_count(code ^ word).argmin()]
                assert keys[row, w] == (turn * 64 + w) << 12 | nearest >> 11


def test_stage_similar_sets_share_keys_and_are_near():
    shared = []
    for a, b in near_copies(random.Random(16), 1000):
        x, y = op.wide_fingerprint(a), op.wide_fingerprint(b)
        assert np.bitwise_count(x[: op.CHECK_PLANES] ^ y[: op.CHECK_PLANES]).sum() <= op.CHECK_DISTANCE
        shared.append(sum(int((op.wide_keys(x[None], t) == op.wide_keys(y[None], t)).sum()) for t in range(op.TURNS)))
    assert min(shared) >= 1 and np.mean(shared) > 14


def test_stage_groups_of_a_bucket(monkeypatch):
    """Chains and dense groups, all at once and from their ends."""
    rng = np.random.default_rng(17)
    checks = [rng.integers(0, 1 << 63, op.CHECK_PLANES, np.uint64)]
    for k in range(80):  # chains that start anew, and their like
        step = np.zeros(op.CHECK_PLANES * 64, np.uint8)
        step[rng.choice(step.size, 50, replace=False)] = 1
        checks.append(rng.integers(0, 1 << 63, op.CHECK_PLANES, np.uint64) if k % 9 == 0 else checks[-1] ^ np.packbits(step).view(np.uint64))
    checks = np.array(checks)[rng.permutation(len(checks))]
    near = np.bitwise_count(checks[:, None] ^ checks[None]).sum(2) <= op.CHECK_DISTANCE
    root = list(range(len(checks)))
    for a, b in zip(*np.nonzero(near), strict=True):
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    for at_once in (512, 3):
        monkeypatch.setattr(op, "AT_ONCE", at_once)
        assert op.near_groups(checks).tolist() == root
    assert op.near_groups(checks[:1]).tolist() == [0] and op.near_groups(checks[:0]).tolist() == []


def test_stage_candidates_come_from_golay_keys(documents):
    """Groups of texts that share a nearest codeword and are near each other, over all turns; texts near no other have none."""
    rng = random.Random(18)
    texts = ["", "one two"]
    for k in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 30, 150]))]
        texts.append(" ".join(words))
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    nodes = materialise(op.with_wide(documents(texts)), "nodes")
    rows = nodes.collect()
    wide = {r["node"]: np.frombuffer(r["wide"], np.uint64) for r in rows}
    few = {r["node"] for r in rows if r["few"]}
    assert len(few) > 20
    wanted = set()
    for a in wide:
        for b in wide:
            if a < b and np.bitwise_count(wide[a][: op.CHECK_PLANES] ^ wide[b][: op.CHECK_PLANES]).sum() <= op.CHECK_DISTANCE:
                turns = op.FEW_TURNS if {a, b} <= few else op.TURNS
                if any((op.wide_keys(wide[a][None], t) == op.wide_keys(wide[b][None], t)).any() for t in range(turns)):
                    wanted.add((a, b))
    groups, sizes = {}, set()
    for r in op.candidates(nodes).collect():
        groups.setdefault(r["key"], set()).add(r["node"])
        sizes.add((r["key"], r["n"]))
    assert sizes == {(k, len(g)) for k, g in groups.items()}
    assert sorted(tuple(sorted(g)) for g in groups.values()) == sorted(wanted) and len(wanted) >= 20


def known_of(sets, hubs, roots):
    """A row of KNOWN for each set."""
    rows = []
    for mine, hub, root in zip(sets, hubs, roots, strict=True):
        delta = np.setxor1d(mine, sets[hub], assume_unique=True)
        (bits, excess), (own, own_excess) = op.delta_bitmap(delta), op.delta_bitmap(mine)
        rows.append([root, hub, mine.size, delta.size, excess, own_excess, *bits.tolist(), *own.tolist()])
    return np.array(rows, np.int64)


def families(rng, count):
    """Sets of shingles: copies of a base with 5 to 49 of 300 changed, and unlike ones."""
    base = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    sets = []
    for k in range(count):
        new = rng.randrange(5, 50) if k % 5 else 300
        kept = rng.sample(range(300), 300 - new)
        sets.append(np.unique(np.concatenate([base[kept], np.array([rng.getrandbits(64) for _ in range(new)], np.uint64)])))
    return sets


def similarity(a, b):
    both = np.intersect1d(a, b).size
    return both / (a.size + b.size - both)


def test_stage_bounds_lose_no_pair():
    rng = random.Random(19)
    sets = families(rng, 60)
    known = known_of(sets, [rng.randrange(3) for _ in sets], range(60))
    i, j = np.nonzero(np.ones((60, 60)))
    can = op.may_link(known[i], known[j])
    similar = np.array([similarity(sets[a], sets[b]) >= 0.8 for a, b in zip(i, j, strict=True)])
    assert can[similar].all() and 200 < similar.sum() and can[~similar].mean() < 0.5


def test_stage_pairs_left_open_by_a_bucket():
    """All pairs of different components that are near and may link, once each, whichever component is the largest."""
    rng = random.Random(20)
    sets = families(rng, 60)
    node = np.array(rng.sample(range(-1000, 1000), 60))
    check = np.array([op.wide_fingerprint(s)[: op.CHECK_PLANES] for s in sets])
    for roots in ([k % 4 for k in range(60)], [0] * 50 + [1] * 10, list(range(60)), [7] * 60):
        known = known_of(sets, [k % 2 for k in range(60)], roots)
        found = [p for a, b in op.pairs_apart(node, check, known) for p in zip(a.tolist(), b.tolist(), strict=True)]
        wanted = set()
        for a in range(60):
            for b in range(60):
                if node[a] < node[b] and roots[a] != roots[b] and np.bitwise_count(check[a] ^ check[b]).sum() <= op.CHECK_DISTANCE and op.may_link(known[[a]], known[[b]])[0]:
                    wanted.add((int(node[a]), int(node[b])))
        assert sorted(found) == sorted(wanted)
        missed = {(a, b) for a in range(60) for b in range(60) if node[a] < node[b] and roots[a] != roots[b] and similarity(sets[a], sets[b]) >= 0.8} - {(a, b) for a in range(60) for b in range(60) if (node[a], node[b]) in wanted}
        assert not missed


def test_stage_joins_a_row_for_each_text(documents, monkeypatch):
    """Of a large group of near copies that hubs leave open a text has one row in what is joined, not one for each key."""
    rng = random.Random(21)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(80):
        words = list(base)
        for _ in range(rng.randrange(2, 9)):
            words[rng.randrange(200)] = f"x{rng.getrandbits(30)}"
        texts.append(" ".join(words))
    written, write = [], op.materialise

    def counted(df, label):
        done = write(df, label)
        written.append((label, done.count()))
        return done

    monkeypatch.setattr(op, "materialise", counted)
    rows = {r["doc_id"]: r["component_id"] for r in op.similar_groups(documents(texts)).collect()}
    root = {k: k for k in rows}
    for a in rows:
        for b in rows:
            if a < b and jaccard(texts[a], texts[b]) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert rows == root
    most = {label: n for label, n in sorted(written, key=lambda x: x[1])}
    assert most["shared"] > 5 * len(texts) and most["across"] > 0
    assert {label for label, n in most.items() if n > 2 * len(texts)} <= {"together", "shared"}, most


def shuffled_bytes(spark):
    """Of the files of each shuffle that are there."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(k) for k in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled_bytes(spark), spark.conf.get(name, "false")
    table = materialise(spark.range(100_000).select("id", F.xxhash64("id").alias("x")).repartition(4, "x"), "dealt")
    end = time.time() + 20
    while (left := sum(n for f, n in shuffled_bytes(spark).items() if f not in before)) and time.time() < end:
        time.sleep(0.2)
    assert left == 0 and table.count() == 100_000 and spark.conf.get(name, "false") == setting
