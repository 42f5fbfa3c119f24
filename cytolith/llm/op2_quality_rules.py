"""Quality rules from a suffix array over a document's words.

The suffix array and its longest common prefixes (LCP) find the maximal repeated substrings: an interval of suffixes
with a common prefix of ``min_repeat`` words or more is a repeat, its span is every occurrence of that prefix, and the
union of the spans gives the covered share of the words. A document is kept if the base rules hold, the covered share
is at most ``max_covered`` and the longest repeat has at most ``max_repeat`` words.

Suffixes are ranked by prefix doubling over whole batches of documents, in numpy; only suffixes whose rank is still
shared take part in the next round. Ranks of every round are kept, so the LCP of two neighbours is the sum of the
rounds' lengths at which their ranks agree. One pass, no shuffle.

Defined results: null text has no words and fails the base rules, as does an empty one. Repeated rows are judged one
by one, extra columns are ignored, an empty table gives an empty result. A text longer than a batch is a batch of its
own; memory follows the longest text: a few words of 4 bytes for each of its words, and one more for each doubling of the
length up to that of its longest repeat, for the words inside such repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE, small_batches

WORD = re.compile(rf"[^{SPACE}]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MIN_REPEAT = 8
MAX_COVERED = 0.2
MAX_REPEAT = 100
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def common_prefixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and LCP with the suffix before it (0 for the first). No two suffixes may be equal."""
    n = ids.size
    kind = np.int32 if n < 1 << 31 else np.int64
    dense = np.unique(ids, return_inverse=True)[1]
    held = np.bincount(dense)
    rank = (np.cumsum(held) - held)[dense].astype(kind)  # of a suffix: how many are smaller
    # by level: the suffixes whose rank was still shared (ascending), and their ranks then
    levels, length = [], 1
    while True:
        shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1).astype(kind)
        if not shared.size:
            break
        levels.append((shared, rank[shared]))
        after = shared.astype(np.int64) + length
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[shared]))
        a, b = rank[shared][order], second[order]
        group = np.concatenate(([True], a[1:] != a[:-1]))
        split = group | np.concatenate(([True], b[1:] != b[:-1]))
        at = np.arange(order.size, dtype=kind)
        rank[shared[order]] = a + np.maximum.accumulate(np.where(split, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        length *= 2
    order = np.empty(n, kind)
    order[rank] = np.arange(n, dtype=kind)
    del rank
    left, right = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    lcp = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # a suffix whose rank was its own has no common prefix of this length with another
        shared, ranks = levels.pop()
        x, y = (np.minimum(np.searchsorted(shared, v), shared.size - 1) for v in (left, right))
        step = ((shared[x] == left) & (shared[y] == right) & (ranks[x] == ranks[y])) * (1 << k)
        left += step
        right += step
        lcp[1:] += step
    return order, lcp


def _covered(reach: np.ndarray) -> np.ndarray:
    """Positions inside [i, i + reach[i]) of any i."""
    at = np.arange(reach.size)
    return np.maximum.accumulate(np.where(reach > 0, at + reach, 0)) > at


def repeats(texts_words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: words in repeated windows of WINDOW words, words in repeats of MIN_REPEAT words or more, longest repeat."""
    sizes = np.array([len(w) for w in texts_words], np.int64)
    known: dict[str, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for words in texts_words for w in words], np.int64)
    owner = np.repeat(np.arange(sizes.size), sizes)
    # an own end mark after each text keeps common prefixes inside it, and only occurrences of the same text count
    ids = np.empty(flat.size + sizes.size, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(ids.size, bool)
    inner[ends] = False
    # words of different texts are different letters: no repeat is found across texts
    ids[inner] = np.unique(owner * (len(known) + 1) + flat, return_inverse=True)[1] if flat.size else flat
    ids[~inner] = flat.size + 1 + np.arange(sizes.size)
    zero = np.zeros(sizes.size, np.int64)
    if not flat.size:
        return zero, zero, zero
    order, lcp = common_prefixes(ids)
    longest = np.empty(ids.size, np.int64)
    longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    doc = np.repeat(np.arange(sizes.size), sizes + 1)
    windows = _covered(np.where(longest >= WINDOW, WINDOW, 0)) & inner
    spans = _covered(np.where(longest >= MIN_REPEAT, longest, 0)) & inner
    top = zero.copy()
    np.maximum.at(top, doc, longest)
    return np.bincount(doc[windows], minlength=sizes.size), np.bincount(doc[spans], minlength=sizes.size), top


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def judge(texts: list[str | None], max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> list[np.ndarray]:
    """Columns of SCHEMA for a batch of texts."""
    texts = [t or "" for t in texts]
    words = [WORD.findall(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    repeat, covered, longest = repeats(words)
    failed = (n < MIN_WORDS) | (100 * repeat > 20 * n)
    kept = ~failed & (covered <= max_covered * n) & (longest <= max_repeat)
    return [
        n, np.array([sum(map(len, w)) for w in words], np.int64), np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        np.array([_duplicate_lines(t) for t in texts], np.int64), repeat.astype(np.int64), failed, kept, covered.astype(np.int64), longest,
    ]


def quality(docs: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id and the columns of SCHEMA for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            columns = judge(batch.column(1).to_pylist(), max_covered, max_repeat)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
