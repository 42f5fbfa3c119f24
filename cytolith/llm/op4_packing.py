"""Packing along a space-filling curve.

Every document becomes token ids, and a hashed vector of them: ids fall into HASHED buckets with a sign, and a fixed
random matrix projects the buckets to three dimensions. The Hilbert key of the quantised point orders the documents by
range partitions, so neighbours along the curve, which have like vocabulary, share sequences. Each partition is
one stream of ids that is cut every 2048; what is left at its end is cut into powers of two, so nothing is padded.

A first pass tokenizes and writes ids to the shared folder (two bytes an id where the vocabulary allows), so neither
the range sampling nor a lost executor tokenizes again. Tokenization splits at white space, which the tokenizer drops
and never merges over, and keeps the ids of each distinct chunk; a full store keeps the chunks that came more than once.
There are as many ranges as the bytes of ids ask for, and no fewer than the session's shuffle partitions.

Defined results: null and empty texts are the end id alone, one piece of length 1. Repeated rows are packed one by one;
null ids are kept as they are; extra columns are ignored; an empty table gives an empty result. Order on the curve is by
key, then doc_id (nulls first), then a hash of the ids, then the row as read, so equal rows can be split between ranges. A
very long text is a batch of its own, and a row; it is cut into as many sequences as it takes.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, discard, materialise, small_batches

LENGTH = 2048
END_ID = 1
HASHED = 1024
BITS = 10
#: Half the width of the cube that the curve fills, in units of a projected mean.
SPREAD = 0.6
CACHED_WORDS = 300_000
ENCODED_AT_ONCE = 4000
#: The distinct chunks of so many bytes of text are looked up together.
BATCH_CHARS = 2_500_000
MARKS = (".", ",")
#: Bytes of ids that a range of the curve holds on average, at most.
RANGE_BYTES = 128 << 20
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _spaced(text: str) -> str:
    """The text with blanks for white space, and lower-cased where that is what the tokenizer does to it.

    Below U+0100 no character composes with another, and lower case is the same letter by letter.
    """
    if "<|" not in text and (text.isascii() or _is_latin(text)):
        text = text.lower()
    return text.replace("\n", " ").replace("\t", " ")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _is_word(chunk: str) -> bool:
    """Whether a chunk is one pre-token that the tokenizer's normaliser leaves alone."""
    return chunk.isalpha() and (chunk.isascii() or _is_latin(chunk)) and chunk == chunk.lower()


class Numbered(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs of these starts and sizes, one after the other."""
    last = np.cumsum(sizes)
    return np.repeat(starts - (last - sizes), sizes) + np.arange(last[-1] if last.size else 0)


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, with room for so many elements."""
    return array if array.size >= size else np.concatenate((array, np.zeros(max(size - array.size, array.size), array.dtype)))


class Encoder:
    """Token ids of many texts at once, by a store of the ids of distinct chunks between white space.

    Arrow splits a batch and numbers its distinct chunks, so that Python looks up each of them once. A full stop or
    comma after a letter or digit at a chunk's end is a token by itself: it is taken off, and its id put back.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for words that are one pre-token each; the model is shared
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.wide = size > 65536
        self.ends_word = np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends_word[number] = token.endswith("</w>")
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in MARKS}
        rng = np.random.default_rng(20)
        matrix = rng.standard_normal((HASHED, 3)).astype(np.float32)
        hashed = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        self.vectors = matrix[(hashed % HASHED).astype(np.int64)] * np.where((hashed >> np.uint64(20)) & np.uint64(1), 1, -1).astype(np.float32)[:, None]
        self.known, self.filled = Numbered(), 0
        self.known[""]  # number 0, without ids
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts, self.sizes, self.used = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keep the chunks that came more than once, if they aren't too many, with their ids."""
        used = self.used[: len(self.known)]
        keep = np.flatnonzero(used > 1) if np.count_nonzero(used > 1) < CACHED_WORDS // 2 else np.zeros(0, np.int64)
        keep = np.concatenate(([0], keep[keep > 0]))
        chunks, sizes = list(self.known), self.sizes[keep]
        flat = self.ids[_places(self.starts[keep], sizes)]
        self.known = Numbered((chunks[k], n) for n, k in enumerate(keep.tolist()))
        self.ids[: flat.size], self.filled = flat, flat.size
        self.sizes[: keep.size], self.starts[: keep.size] = sizes, np.cumsum(sizes) - sizes
        self.used[:] = 0

    def _store(self, numbers: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = _grown(self.ids, self.filled + flat.size)
        self.ids[self.filled : self.filled + flat.size] = flat
        self.sizes[numbers], self.starts[numbers] = sizes, self.filled + np.cumsum(sizes) - sizes
        self.filled += flat.size

    def _learn(self, chunks: list[str]) -> None:
        """Store the ids of new chunks, which have the last numbers. Many are encoded as one text: words are told apart by their last tokens, others by offsets."""
        first = len(self.known) - len(chunks)
        self.starts, self.sizes, self.used = (_grown(x, len(self.known)) for x in (self.starts, self.sizes, self.used))
        word = np.fromiter(map(_is_word, chunks), bool, len(chunks))
        for plain in (True, False):
            which = np.flatnonzero(word == plain)
            for low in range(0, which.size, ENCODED_AT_ONCE):
                own = which[low : low + ENCODED_AT_ONCE]
                part = [chunks[k] for k in own.tolist()]
                if plain:
                    flat = np.array(self.of_words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                    sizes = np.diff(np.flatnonzero(self.ends_word[flat]), prepend=-1)
                else:
                    done = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
                    flat = np.array(done.ids, np.uint32)
                    lengths = np.fromiter(map(len, part), np.int64, len(part)) + 1
                    at = np.searchsorted(np.cumsum(lengths), np.array([o for o, _ in done.offsets], np.int64), "right")
                    sizes = np.bincount(at, minlength=len(part))
                self._store(first + own, flat, sizes)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other and each with END_ID, and how many each text has."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        split = pc.split_pattern(pa.array([_spaced(t or "") for t in texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        marked = pc.match_substring_regex(coded.dictionary, rf"[\p{{L}}\p{{N}}][{''.join(MARKS)}]$")
        bare = pc.if_else(marked, pc.utf8_rtrim(coded.dictionary, "".join(MARKS)), coded.dictionary).dictionary_encode()
        before = len(self.known)
        chunks = bare.dictionary.to_pylist()
        numbers = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        own = numbers[bare.indices.to_numpy()]
        # the batch's own chunks, then the end: ids one after the other, each with its mark
        sizes = self.sizes[own]
        flat, of = self.ids[_places(self.starts[own], sizes)], np.cumsum(sizes)
        for mark, ids in self.marks.items():
            have = np.flatnonzero(pc.and_(marked, pc.ends_with(coded.dictionary, mark)).to_numpy(zero_copy_only=False))
            flat = np.insert(flat, np.repeat(of[have], len(ids)), np.tile(np.array(ids, np.uint32), have.size))
            sizes[have] += len(ids)
            of = np.cumsum(sizes)
        codes, ends = coded.indices.to_numpy(), split.offsets.to_numpy()[1:]
        self.used[: len(self.known)] += np.bincount(own, np.bincount(codes, minlength=own.size), len(self.known)).astype(np.int64)
        # 32 bits are enough for places but for a very long text, and half the memory to move
        kind = np.int32 if sizes[codes].sum() + ends.size < 1 << 31 else np.int64
        flat, sizes, starts = np.append(flat, np.uint32(END_ID)), np.append(sizes, 1).astype(kind), np.append(of - sizes, flat.size).astype(kind)
        codes = np.insert(codes, ends, own.size)
        per_chunk = sizes[codes]
        last = np.cumsum(per_chunk, dtype=kind)
        places = np.repeat(starts[codes] - (last - per_chunk), per_chunk)
        places += np.arange(places.size, dtype=kind)
        return flat[places], np.diff(last[ends + np.arange(ends.size)], prepend=0).astype(np.int64)

    def keys(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hilbert keys of the texts' mean projected vectors."""
        starts = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(self.vectors[ids], starts, dtype=np.float64) / sizes[:, None]
        side = 1 << BITS
        return hilbert(np.clip(((mean / SPREAD + 1) / 2 * side), 0, side - 1).astype(np.int64))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n x d), by transposing the curve's axes bit by bit."""
    x, d = points.T.copy(), points.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


@cache
def encoder(path: str) -> Encoder:
    """One to a worker process, so that its store serves all its tasks."""
    return Encoder(path)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, curve (Hilbert key), n_ids, ids (little-endian binary of 16 or 32 bits an id) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in small_batches(batches, 1, BATCH_CHARS):
            ids, sizes = enc.encode(batch.column(1).to_pylist())
            keys = enc.keys(ids, sizes)
            raw = ids.astype("<u4" if enc.wide else "<u2").tobytes()
            ends = np.concatenate(([0], np.cumsum(sizes))) * (4 if enc.wide else 2)
            binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(sizes), pa.array([enc.wide] * len(sizes)), binary], ["doc_id", "curve", "n_ids", "wide", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, curve long, n_ids long, wide boolean, ids binary")


def ends_of_rest(rest: int) -> list[int]:
    """Lengths, falling powers of two, that a last part of a stream is cut into."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of one partition's stream. The ids of one sequence at most are held back."""
    base = TaskContext.get().partitionId() << 40
    names = ["doc_id", *(x.split()[0] for x in PIECES.split(", "))]
    held: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the sequence that isn't full
    held_ids, sequence = 0, 0
    kind = None

    def cut(parts: list[tuple], lengths: list[int]) -> list[tuple]:
        """Lay the held parts into sequences of these lengths."""
        nonlocal sequence
        out, room, offset, left = [], lengths[0], 0, list(lengths)
        for doc_id, start, ids, total in parts:
            while ids.size:
                take = min(room, ids.size)
                out.append((doc_id, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), total, base + sequence, offset))
                start, ids, room, offset = start + take, ids[take:], room - take, offset + take
                if not room:
                    sequence += 1
                    left.pop(0)
                    room, offset = (left[0] if left else 0), 0
        return out

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

    for batch in batches:
        kind = batch.schema.field(0).type
        rows = []
        for doc_id, total, wide, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            ids, start = np.frombuffer(raw, "<u4" if wide else "<u2"), 0
            while held_ids + ids.size >= length:
                take = length - held_ids
                rows += cut([*held, (doc_id, start, ids[:take], total)], [length])
                held, held_ids, start, ids = [], 0, start + take, ids[take:]
            if ids.size:
                held.append((doc_id, start, ids, total))
                held_ids += ids.size
        if rows:
            yield emit(rows)
    if held_ids:
        yield emit(cut(held, ends_of_rest(held_ids)))


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of the rows of docs, written: doc_id and the columns of PIECES."""
    before = len(WRITTEN)
    ids = materialise(tokenized(docs, path).withColumn("row", F.monotonically_increasing_id()), "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("curve"), F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("row")]
    total = ids.agg(F.sum(F.col("n_ids") * F.when(F.col("wide"), 4).otherwise(2))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    along = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = materialise(along.select("doc_id", "n_ids", "wide", "ids").mapInArrow(lambda batches: _pack(batches, length), f"doc_id {kind}, {PIECES}"), "pieces")
    discard(docs.sparkSession, WRITTEN[before:-1])
    return done
