"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: 64 bits, each 1 if it is set in more than half of the XXH64 values (UTF-8, seed 42) of the text's 3-word
shingles. Fingerprints link at MAX_DISTANCE (3) or fewer differing bits.

Candidates. A fingerprint is cut into four segments of 16 bits, each padded to a word of the perfect binary Golay code (23
bits, distance 7). Of three errors over four segments, some three segments hold at most two, in different segments
(pigeonhole). If two words differ in one bit, the codeword nearest to the first (at distance 3 or less) lies within
distance 4 of the second, and such codewords are few: the nearest one, and five more if the nearest is at distance 3. So
of the two segments with an error, one is met by what is near the first fingerprint, the other by what is near the second:
each fingerprint has, for every three segments, the key of the nearest codeword indices and those with one of the
three replaced by another near index (4 x 16 keys at most, of 36 bits and the number of the three). Fingerprints that
link share a key. Exact copies are one fingerprint before that.

Links. Within a key's bucket each fingerprint is compared with the smallest one. Of what that leaves in different
components every pair is compared; so a dense ball of fingerprints gives as many links as it has members and not all its
pairs, no bucket is cut and no link between components is lost.

The pipeline's stage (representatives) has a link of its own: a Jaccard similarity of SIMILAR (0.8) or more of the sets
of 5-word shingles. It is found by the same method with a longer fingerprint, as at that similarity 64 bits differ in ten:
a SimHash of those sets with PLANES * WORDS (1472) bits is read as 64 words of the Golay code, 23 bits each, one from every
plane; a turn reads it anew with the planes turned against each other, so no two words share more than one bit. A text's
keys are the codewords nearest to its words. At a similarity of 0.8 some 0.15 of the bits differ and two words have one
nearest codeword with a chance of 0.12, so of the 128 words of two turns pairs share 15.5 on average (measured variance
15.5), none with a chance of 2 in ten million, closer pairs with less. Texts of few shingles, whose bits are often ties,
have four turns. From 2^24 texts on keys get raw bits as well, and turns for the chance these take, so buckets grow slowly.
In a bucket the first CHECK_PLANES * WORDS (192) bits of the fingerprints are compared: at CHECK_DISTANCE or fewer differing
bits (6 standard deviations above those of a similarity of 0.8) two texts are near, and what a chain of near texts joins goes
on together; a text near no other is done.

An exact check follows. Each text is first compared with its hub, the text that most others are near to, exactly and on
whole texts. Two texts of one hub that are not yet in one component differ by what their differences from the hub don't
share: they link only if these differences share so many shingles, and a bitmap of DELTA_BITS bits of each difference bounds
that from above. So does such a bitmap of the sets for two texts of any hubs. Pairs beyond a bound, or of too unlike sizes,
are none; the few others of different components are compared exactly. Buckets are met anew for the hubs and for these bounds,
which are applied within a bucket: a text has a row for each key in a shuffle, and in no join.

Components: alternating large-star and small-star rounds on the links, each written to the shared folder, the last one
deleted. Only what has a link takes part; the rest are their own component.

Defined results: null and empty texts have fingerprint zero and are one component with whatever links to zero. The
component of rows whose ids are all null is null. Repeated rows are copies of each other; extra columns are ignored; an
empty table gives an empty result. A very long text is read in blocks of words; for the stage its distinct shingles are
held at once. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, discard, materialise, small_batches, spread_join, tidy

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Shift and width of the segments, and how many of them a key holds.
SEGMENTS = ((0, 16), (16, 16), (32, 16), (48, 16))
AGREEING = 3
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: The stage's shingles, and the Jaccard similarity of their sets that links.
STAGE_SHINGLE = 5
SIMILAR = 0.8
#: The stage's fingerprint: a Golay word has a bit from each plane, a plane a bit for each word.
PLANES, WORDS = 23, 64
#: How often it is read as words, and how often for sets of FEW shingles at most.
TURNS, FEW_TURNS, FEW = 2, 4, 40
#: Texts from which keys have a raw bit besides, one more for twice as many, and the chance that a similar pair agrees in one.
MANY, AGREE = 1 << 24, 0.8485
#: Planes of the bits that are compared in a bucket, and how many of them differ at most.
CHECK_PLANES, CHECK_DISTANCE = 3, 60
#: Rows of a task that compares buckets, and the texts of one that are compared all at once.
BUCKET_ROWS, AT_ONCE = 250_000, 512
DELTA_BITS = 1024
#: What is known of a text once it is compared with its hub.
KNOWN = ("root", "hub", "size", "delta", "excess", "own_excess", *(f"{name}{k}" for name in ("bits", "own_bits") for k in range(DELTA_BITS // 64)))
Found = Callable[..., Iterable[tuple[np.ndarray, ...]]]
CACHED_WORDS = 50_000
#: Bits of the map of texts that are compared, at most (8 MB).
MOST_BITS = 1 << 26
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 22


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, A-Z in lower case, some at a time; bytes.lower and bytes.split know ASCII alone."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").lower(), 0
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[at:end].split()
        at = end


def _runs(text: str | None, size: int) -> Iterator[list[bytes]]:
    """Words in blocks that overlap by one less than a shingle; the whole sequence if it is shorter than one."""
    held: list[bytes] = []
    whole = False
    for words in word_blocks(text):
        held += words
        if len(held) >= size:
            yield held
            held, whole = held[len(held) - size + 1 :], True
    if not whole and held:
        yield held


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text, unsigned."""
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    for words in _runs(text, SHINGLE):
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        for low in range(0, max(len(words) - SHINGLE + 1, 1), 50_000):
            first = starts[: max(len(words) - SHINGLE + 1, 1)][low : low + 50_000].tolist()
            last = ends[SHINGLE - 1 :][low : low + 50_000].tolist() or [len(joined)]
            h = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], ">u8")
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            n += h.size
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big") if n else 0


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where((words >> bit) & 1, GENERATOR << (bit - 11), 0)
    return words


@cache
def error_patterns() -> np.ndarray:
    """By syndrome: the error of weight 3 or less, then the errors of weight 4 (or -1) that lead to another codeword."""
    patterns = np.full((2048, 6), -1, np.int64)
    bits = [1 << b for b in range(23)]
    light = np.array([sum(c) for k in range(4) for c in combinations(bits, k)], np.int64)
    patterns[syndrome(light), 0] = light
    heavy = np.array([sum(c) for c in combinations(bits, 4)], np.int64)
    of = syndrome(heavy)
    order = np.argsort(of, kind="stable")
    of, heavy = of[order], heavy[order]
    nth = np.arange(of.size) - np.searchsorted(of, of)
    # of syndromes whose leader has weight 3, each has 5 errors of weight 4
    patterns[of, 1 + nth] = heavy
    return patterns


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For 23-bit words: indices (upper 12 bits) of the codewords within distance 4, the nearest first, -1 where there are fewer."""
    errors = error_patterns()[syndrome(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and the row that each belongs to."""
    u = fps.view(np.uint64)
    found = [codeword_indices(((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64)) for s, w in SEGMENTS]
    all_rows = np.arange(fps.size)
    keys, rows = [], []
    for k, chosen in enumerate(combinations(range(len(SEGMENTS)), AGREEING)):
        nearest = [found[c][:, 0] for c in chosen]
        tag = k << 12 * AGREEING
        keys.append(tag + sum(x << 12 * i for i, x in enumerate(nearest)))
        rows.append(all_rows)
        for i, c in enumerate(chosen):
            row, column = np.nonzero(found[c][:, 1:] >= 0)
            other = [x[row] if j != i else found[c][row, column + 1] for j, x in enumerate(nearest)]
            keys.append(tag + sum(x << 12 * j for j, x in enumerate(other)))
            rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def buckets(fps: DataFrame) -> DataFrame:
    """key, node (the fingerprint) for every key of the distinct fingerprints in column fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).to_numpy(zero_copy_only=False)[start : start + 20_000].astype(np.int64)
                keys, rows = keys_of(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "node"])

    return fps.select("fp").mapInArrow(run, "key long, node long")


def _near(a: str | Column, b: str | Column) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b)) <= MAX_DISTANCE


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root (its component's smallest node) for every node of the edges (a, b).

    A round is a large-star and a small-star step: every node's larger, then smaller neighbours are tied to its smallest
    neighbour. It takes a number of rounds that grows as the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    now = materialise(edges.select("a", "b"), "links")
    before = None
    for _ in range(max_rounds):
        last = WRITTEN[-1]
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(both, least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a0"), F.col("m").alias("b0")).filter("a0 <> b0").distinct()
        down = large.select(F.greatest("a0", "b0").alias("u"), F.least("a0", "b0").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("x"), F.col("m").alias("y"))
            .union(low.select(F.col("u").alias("x"), F.col("m").alias("y")))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        now = materialise(small, "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        discard(spark, [last])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def links(fps: DataFrame) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in column fp that differ in MAX_DISTANCE bits at most and join all that such pairs join.

    Only verified pairs leave a join: keys are many, and by chance most are shared in a large corpus.
    """
    keyed = buckets(fps)
    dealt = keyed.repartition("key")
    met = dealt.join(dealt.groupBy("key").agg(F.min("node").alias("low")), "key")
    first = materialise(_pairs(met.filter((F.col("node") != F.col("low")) & _near("node", "low")), "node", "low"), "first")
    rooted = keyed.join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    x, y = rooted.alias("x"), rooted.alias("y")
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _near(F.col("x.node"), F.col("y.node"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return first.union(rest)


def _labels(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """node, component_id (the least id reachable) of nodes (node, least_id)."""
    least = roots.join(nodes, roots["node"] == nodes[node]).groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_linked = roots.join(least, "root").select(F.col("node").alias(node), "component_id")
    return nodes.join(of_linked, node, "left").select(node, F.coalesce("component_id", "least_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable over links) of each row of docs."""
    own = materialise(with_fingerprints(docs), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    labels = _labels(distinct, components(links(distinct)), "fp")
    return spread_join(own, labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


class Hashed(dict):
    """XXH64 of words, kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


@cache
def _words() -> Hashed:
    return Hashed()


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd numbers for the planes, and for the words within a shingle."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, PLANES + STAGE_SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[:PLANES], odd[PLANES:]


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's 5-word shingles, sorted; of a shorter text, that of all its words."""
    known, factors, parts = _words(), _multipliers()[1], []
    for words in _runs(text, STAGE_SHINGLE):
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(h.size - STAGE_SHINGLE + 1, 1)
        total = np.full(n, min(h.size, STAGE_SHINGLE), np.uint64)
        for k in range(min(STAGE_SHINGLE, h.size)):
            total += h[k : k + n] * factors[k]
        total = (total ^ (total >> np.uint64(31))) * factors[0]
        parts.append(np.unique(total ^ (total >> np.uint64(29))))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.zeros(1, np.uint64)] if not parts else parts))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers whose every bit depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles, a number for each plane: a bit is 1 if it is set in over half the shingles' hashes."""
    total = np.zeros(PLANES * WORDS, np.int64)
    for start in range(0, shingles.size, 255):
        hashes = _mixed(shingles[start : start + 255, None] + _multipliers()[0])
        total += np.unpackbits(hashes.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * total > shingles.size).view(np.uint64)


def wide_keys(wide: np.ndarray, turn: int, raw: int = 0) -> np.ndarray:
    """Keys of fingerprints (a row each) in one turn, a column for each word: the word's number, its nearest codeword's, raw bits of another word."""
    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(wide), -1), axis=1).reshape(len(wide), PLANES, WORDS)
    words = np.zeros((len(wide), WORDS), np.int64)
    for plane in range(PLANES):
        words |= np.roll(bits[:, plane], -turn * plane, axis=1).astype(np.int64) << plane
    nearest = (words ^ error_patterns()[syndrome(words.ravel()), 0].reshape(words.shape)) >> 11
    return ((turn * WORDS + np.arange(WORDS)) << 12 | nearest) << raw | np.roll(words, WORDS // 2, axis=1) & ((1 << raw) - 1)


def near_groups(checks: np.ndarray) -> np.ndarray:
    """For the fingerprints (a row each) of a bucket: the first of those that a chain of near ones joins it with, itself if there is none."""
    first, rest = np.arange(len(checks)), np.arange(len(checks))

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(x[:, None, k] ^ y[None, :, k]).astype(np.uint8) for k in range(CHECK_PLANES)) <= CHECK_DISTANCE

    if len(checks) <= AT_ONCE:
        rest = np.flatnonzero(near(checks, checks).sum(1) > 1)
    while rest.size > 1:
        start, front, rest = rest[0], rest[:1], rest[1:]
        while front.size and rest.size:
            met, step = np.zeros(rest.size, bool), max(1_000_000 // rest.size, 1)
            for low in range(0, front.size, step):
                met |= near(checks[front[low : low + step]], checks[rest]).any(0)
            front, rest = rest[met], rest[~met]
            first[front] = start
    return first


def _node() -> Column:
    """A text's number; equal texts have one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def with_wide(docs: DataFrame) -> DataFrame:
    """doc_id, node, wide (the stage's fingerprint, 8 bytes a plane) and few (of FEW shingles at most) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            wide = pa.array([wide_fingerprint(x).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), wide, pa.array([x.size <= FEW for x in sets])], ["doc_id", "node", "wide", "few"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _node().alias("node"), "text").mapInArrow(run, f"doc_id {kind}, node long, wide binary, few boolean")


def _members(first: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each of near_groups' groups of several."""
    size, order = np.bincount(first), np.argsort(first, kind="stable")
    for n, end in zip(size[size > 1].tolist(), np.cumsum(size)[size > 1].tolist(), strict=True):
        yield order[end - n : end]


def in_buckets(nodes: DataFrame, turn: int, words: range, rows: int, raw: int, found: Found, result: tuple[str, ...], also: tuple[str, ...] = ()) -> DataFrame:
    """Rows (longs, named by result) that found makes of the buckets of some words of one turn; rows is how many nodes there are.

    found gets a bucket's nodes, the fingerprints' bits that are compared (a row each) and the columns also (longs, a row each).
    """
    names = ["key", "node", *(f"check{k}" for k in range(CHECK_PLANES)), *also]
    schema, ddl = pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} long" for n in names)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, binary, *more = batch.columns
            wide = np.frombuffer(b"".join(binary.to_pylist()), np.uint64).reshape(-1, PLANES)
            keys = wide_keys(wide, turn, raw)[:, words]
            own = [node.to_numpy(zero_copy_only=False), *(wide[:, k].view(np.int64) for k in range(CHECK_PLANES)), *(c.to_numpy(zero_copy_only=False) for c in more)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(x, len(words))) for x in own)], names)
        tidy()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, *own = (c.to_numpy() for c in pa.Table.from_batches(batches, schema).columns)
        order = np.argsort(key, kind="stable")
        key, node, check = key[order], node[order], np.stack([c[order].view(np.uint64) for c in own[:CHECK_PLANES]], 1)
        more = np.stack([c[order] for c in own[CHECK_PLANES:]], 1) if also else None
        edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1, append=key[-1:] + 1)) if key.size else key
        parts: list[tuple[np.ndarray, ...]] = []
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if high - low > 1:
                parts += found(node[low:high], check[low:high], *([more[low:high]] if also else []))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], list(result))
        tidy()

    # a task gets so many bytes, and fewer of wider rows
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * len(words) * len(names) // (BUCKET_ROWS * (2 + CHECK_PLANES)) + 1)
    return nodes.select("node", "wide", *also).mapInArrow(keyed, ddl).repartition(tasks, "key").mapInArrow(met, ", ".join(f"{n} long" for n in result))


def over_turns(nodes: DataFrame, found: Found, result: tuple[str, ...], also: tuple[str, ...] = ()) -> DataFrame:
    """The rows of in_buckets over all turns; texts of few shingles have more of them. nodes (node, wide, few, also) is a written table.

    Wide rows go a part of the words at a time, so that no shuffle holds much.
    """
    total, few = nodes.agg(F.count("*"), F.count(F.when(F.col("few"), 1))).first()
    raw = max((total // MANY).bit_length(), 0)
    turns = int(np.ceil(TURNS / AGREE**raw))
    step = WORDS // (1 if len(also) < 10 else 4)
    parts = [range(low, low + step) for low in range(0, WORDS, step)]
    rows = [materialise(in_buckets(nodes, turn, words, total, raw, found, result, also), "together") for turn in range(turns) for words in parts]
    if few:
        short = nodes.filter("few")
        rows += [materialise(in_buckets(short, turn, words, few, raw, found, result, also), "together") for turn in range(turns, turns * FEW_TURNS // TURNS) for words in parts]
    return reduce(DataFrame.union, rows)


def candidates(nodes: DataFrame) -> DataFrame:
    """key, node, n: groups of nodes (node, wide, few) that share a key and are near each other, and their sizes; a group that several keys have once. nodes is a written table."""

    def found(node: np.ndarray, check: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for at in _members(near_groups(check)):
            # a group is named by what nodes it has
            name = _mixed(_mixed(node[at].view(np.uint64)).sum(keepdims=True)).view(np.int64)
            yield np.repeat(name, at.size), node[at], np.full(at.size, at.size)

    return materialise(over_turns(nodes, found, ("key", "node", "n")).distinct(), "shared")


def hubs_of(near: DataFrame) -> DataFrame:
    """node, hub of nodes (node, wide, few, n) that are near others: of the members of its groups that with the greatest n. near is a written table.

    Buckets are met again, here and in left_open: only a row for each text is kept between, not one for each key of each text.
    """

    def found(node: np.ndarray, check: np.ndarray, more: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for at in _members(near_groups(check)):
            hub = at[np.lexsort((node[at], more[at, 0]))[-1]]
            yield node[at], np.repeat(more[hub], at.size), np.repeat(node[hub], at.size)

    met = over_turns(near, found, ("node", "n", "hub"), ("n",))
    return met.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("hub")).select("node", F.col("hub.hub").alias("hub"))


def may_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two texts with what KNOWN names (a row each) can be similar.

    Sets of sizes p and q are similar if their difference is at most (p + q) / 9: it is delta + delta - 2 common for the
    differences from one hub, p + q - 2 common for the sets.
    """
    at = {name: k for k, name in enumerate(KNOWN)}

    def most(bits: str, excess: str, size: str) -> np.ndarray:
        first = at[f"{bits}0"]
        shared = sum(np.bitwise_count((x[:, k] & y[:, k]).view(np.uint64)).astype(np.int64) for k in range(first, first + DELTA_BITS // 64))
        return np.minimum(shared + np.minimum(x[:, at[excess]], y[:, at[excess]]), np.minimum(x[:, at[size]], y[:, at[size]]))

    p, q = x[:, at["size"]], y[:, at["size"]]
    by_hub = 9 * (x[:, at["delta"]] + y[:, at["delta"]] - 2 * most("bits", "excess", "delta")) <= p + q
    by_sets = 9 * most("own_bits", "own_excess", "size") >= 4 * (p + q)
    return (10 * p >= 8 * q) & (10 * q >= 8 * p) & ((x[:, at["hub"]] != y[:, at["hub"]]) | by_hub) & by_sets


def pairs_apart(node: np.ndarray, check: np.ndarray, more: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket's nodes that are near, of different components (root) and may link."""
    root = more[:, KNOWN.index("root")]
    if (root == root[0]).all():
        return
    for at in _members(near_groups(check)):
        roots, n = np.unique(root[at], return_counts=True)
        main = roots[n.argmax()]
        # of each pair one is outside the largest component
        rest = at[root[at] != main]
        step = max(100_000 // at.size, 1)
        for low in range(0, rest.size, step):
            x = rest[low : low + step, None]
            once = (root[x] != root[at]) & ((root[at] == main) | (node[x] < node[at]))
            differ = sum(np.bitwise_count(check[x, k] ^ check[at, k]) for k in range(CHECK_PLANES))
            i, j = np.nonzero(once & (differ <= CHECK_DISTANCE))
            i, j = x[i, 0], at[j]
            can = may_link(more[i], more[j])
            i, j = i[can], j[can]
            yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])


def left_open(near: DataFrame) -> DataFrame:
    """Pairs a < b of nodes (node, wide, few, KNOWN) that share a bucket, are of different components and may link. near is a written table."""
    return over_turns(near, pairs_apart, ("a", "b"), KNOWN).distinct()


def with_sets(texts: DataFrame) -> DataFrame:
    """node, shingles (their sorted hashes, 8 bytes each) of texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def delta_bitmap(delta: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmap (as signed longs) of a set of shingles, and by how many it has fewer bits than the set has members."""
    bits = np.zeros(DELTA_BITS, np.uint8)
    bits[((delta >> np.uint64(20)) % np.uint64(DELTA_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64), delta.size - int(bits.sum())


COMPARED = "a long, b long, size long, delta long, excess long, own_excess long, bits array<long>, own_bits array<long>, similar boolean"


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes: a's size, the size of the two sets' difference, bitmaps of that and of a's set, and whether they are similar. pairs is a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                mine, other = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                delta = np.setxor1d(mine, other, assume_unique=True)
                both = mine.size + other.size
                (bitmap, excess), (own, own_excess) = delta_bitmap(delta), delta_bitmap(mine)
                # similarity (both - delta) / (both + delta), in whole numbers
                rows.append((a, b, mine.size, delta.size, excess, own_excess, bitmap, own, 10 * (both - delta.size) >= 8 * (both + delta.size)))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[6:8]), pa.array(columns[8], pa.bool_())], [x.split()[0] for x in COMPARED.split(", ")])
        tidy()

    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"{n}_set")) for n in "ab")
    # a's set goes along as it is joined first; a hub's set is repeated for the parts that its many rows are dealt over
    met = spread_join(pairs, y, "b").join(x, "a")
    return met.select("a", "b", "a_set", "b_set").mapInArrow(run, COMPARED)


def _likely(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of texts whose node may be asked for, so that a join with asked need not shuffle the others.

    A bitmap of sixteen bits for each node asked for, MOST_BITS at most, goes to all tasks; a node's bit is its hash.
    """
    size = min(1 << max(16 * asked.count(), 64).bit_length(), MOST_BITS)
    spot = lambda node: F.col(node).bitwiseAND(F.lit(size - 1).cast("long"))
    word = lambda node: F.shiftright(spot(node), 6).cast("int")
    bit = lambda node: F.call_function("shiftleft", F.lit(1).cast("long"), spot(node).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    held = asked.groupBy(word("asked").alias("word")).agg(F.bit_or(bit("asked")).alias("bits"))
    every = asked.sparkSession.range(size >> 6).select(F.col("id").cast("int").alias("word")).join(held, "word", "left")
    bitmap = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bitmap"))
    # a filter, not a join: the optimizer would put the exact join before it
    return texts.filter(F.get(bitmap.scalar(), word("node")).bitwiseAND(bit("node")) != 0)


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over similar texts) of each row of docs."""
    own = materialise(with_wide(docs), "wide")
    nodes = materialise(own.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("wide").alias("wide"), F.first("few").alias("few")), "nodes")
    central = candidates(nodes).groupBy("node").agg(F.sum("n").alias("n"))
    near = materialise(nodes.join(central, "node"), "near")
    mine = materialise(hubs_of(near), "hubs")
    # the text of a node is that of its row with the least id: copies are not met again
    asked = mine.join(nodes.select("node", "least_id"), "node").select(F.col("node").alias("asked"), "least_id")
    asked = materialise(asked, "asked")
    texts = _likely(docs.select("doc_id", _node().alias("node"), F.coalesce("text", F.lit("")).alias("text")), asked)
    texts = texts.join(asked, (texts["node"] == asked["asked"]) & texts["doc_id"].eqNullSafe(asked["least_id"]), "left_semi")
    sets = materialise(with_sets(texts).dropDuplicates(["node"]), "sets")
    met = materialise(compared(materialise(mine.select(F.col("node").alias("a"), F.col("hub").alias("b")), "pairs"), sets), "compared")
    found = materialise(_pairs(met.filter("similar"), "a", "b"), "similar")
    bits = [F.col(name)[k].alias(f"{name}{k}") for name in ("bits", "own_bits") for k in range(DELTA_BITS // 64)]
    known = met.select(F.col("a").alias("node"), F.col("b").alias("hub"), "size", "delta", "excess", "own_excess", *bits)
    rooted = near.select("node", "wide", "few").join(known, "node").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    across = materialise(left_open(materialise(rooted, "rooted")), "across")
    more = materialise(_pairs(compared(across, sets).filter("similar"), "a", "b"), "more")
    labels = _labels(nodes.select("node", "least_id"), components(found.union(more).distinct()), "node")
    return spread_join(own.select("doc_id", "node"), labels, "node").select("doc_id", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those whose doc_id isn't their component's (of similar texts).

    Rows without an id stay; of rows that repeat id and text one stays. What goes is written first: Spark then knows its
    size, and broadcasts it or shuffles accordingly, so texts are shuffled only where many of them go.
    """
    before = len(WRITTEN)
    found = materialise(similar_groups(docs), "components")
    discard(docs.sparkSession, WRITTEN[before:-1])
    gone = materialise(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    repeated = materialise(found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__repeated")), "repeated")
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    once = left.join(repeated, left["doc_id"] == repeated["__repeated"], "left_anti")
    return once.unionByName(left.join(repeated, left["doc_id"] == repeated["__repeated"], "left_semi").dropDuplicates(["doc_id", "text"]))
