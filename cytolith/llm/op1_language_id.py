"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is the list of a text's most frequent letter n-grams (1 to 3 letters, words padded with one separator on
either side), by falling count, ties by key. A document gets the language whose profile has the smallest sum of
``|rank in document - rank in language|``; an n-gram that the language's profile lacks costs the profile size.

Defined results: null text, or a text without a letter, gives ``und`` with score 0; so does any text when there is no
training row. Equal distances go to the language that sorts first. Repeated rows are predicted one by one, extra
columns are ignored, an empty table gives an empty result. A very long text is counted in blocks; memory follows its
distinct n-grams.

Bound on what is learned from: about ``train_docs`` documents of each language (a hash of doc_id picks them), each read
whole; no language is left out. The model that the driver and the workers hold is ``size`` n-grams for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

PROFILE = 400
TRAIN_DOCS = 2000
#: Code points that n-grams are counted of at a time.
BLOCK = 4_000_000
#: Score under which a filter rejects a document as being in none of the languages.
LEAST_SCORE = 0.2
UNKNOWN = "und"
_SEPARATOR = 32
_HASH_RANGE = 1 << 30


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _keys(code: np.ndarray, starts: int) -> np.ndarray:
    """Keys of the n-grams that begin at the first places of some code points, which others follow."""
    letter = code != _SEPARATOR
    two = (code[:-1] << 21) | code[1:]
    three = (two[:-1] << 21) | code[2:]
    return np.concatenate((code[:starts][letter[:starts]], two[:starts][(letter[:-1] | letter[1:])[:starts]], three[:starts][letter[1:-1][:starts]]))


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts."""
    if not keys.size:
        return keys, keys
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, keys.size)) if counts is None else np.add.reduceat(counts, first)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys (ascending) and counts of a text's n-grams; a key packs up to three code points of 21 bits."""
    low = f" {(text or '').lower()} "
    parts = []
    for start in range(0, len(low), BLOCK):
        code = np.frombuffer(low[start : start + BLOCK + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        parts.append(_counted(_keys(np.where(_letters()[code], code, _SEPARATOR).astype(np.int64), BLOCK)))
    return parts[0] if len(parts) == 1 else _counted(*map(np.concatenate, zip(*parts, strict=True)))


def _top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    falling = counts.max(initial=0) - counts
    if falling.max(initial=0) < 65536:
        falling = falling.astype(np.uint16)  # radix sort
    return keys[np.argsort(falling, kind="stable")[:size]]


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, size: int = PROFILE, train_docs: int = TRAIN_DOCS) -> dict[str, list[int]]:
    """Profiles by language, from the rows of docs (doc_id, text, lang) with a language and not held out."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    # a written table of counts, joined: however many values lang has, they stay with the executors
    share = materialise(rows.groupBy("lang").agg(F.least(F.lit(1.0), train_docs / F.count("*")).alias("share")).withColumnRenamed("lang", "of"), "langs")
    drawn = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(17)), F.lit(_HASH_RANGE))
    # narrow first: what no share can hold goes before the join
    most = share.agg(F.max("share")).first()[0] or 0.0
    sample = rows.filter(drawn < most * _HASH_RANGE).join(share, F.col("lang") == F.col("of")).filter(drawn < F.col("share") * _HASH_RANGE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, []).append(ngram_counts(text))
            for lang, parts in found.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                sums = np.bincount(inverse, weights=np.concatenate([c for _, c in parts]), minlength=keys.size)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * keys.size, pa.string()), pa.array(keys, pa.int64()), pa.array(sums.astype(np.int64))], ["lang", "ngram", "n"])

    ranked = (
        sample.select("text", "lang").mapInArrow(count, "lang string, ngram long, n long")
        .groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")))
        .filter(F.col("rank") <= size)
    )
    profiles: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").collect():  # the model: size rows for each language
        profiles.setdefault(r["lang"], []).append(r["ngram"])
    return profiles


class Model:
    """Profiles laid out for lookup: sorted n-grams, and for each the languages that have it with their ranks."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        sizes = [len(profiles[x]) for x in self.langs]
        flat = np.array([g for x in self.langs for g in profiles[x]], np.int64)
        order = np.argsort(flat, kind="stable")
        self.lang = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.rank = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes] or [np.zeros(0, np.int32)])[order]
        self.ngrams, starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(starts, flat.size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: one less the share of the largest possible distance."""
        top = _top(*ngram_counts(text), self.size)
        if not top.size or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.ngrams, top), self.ngrams.size - 1)
        known = np.flatnonzero(self.ngrams[at] == top)
        starts, sizes = self.starts[at[known]], self.starts[at[known] + 1] - self.starts[at[known]]
        last = np.cumsum(sizes)
        places = np.repeat(starts - (last - sizes), sizes) + np.arange(last[-1] if last.size else 0)
        # what each language saves of the distance of a text that has none of its n-grams
        saved = self.size - np.abs(self.rank[places] - np.repeat(known, sizes))
        distance = self.size * top.size - np.bincount(self.lang[places], saved, len(self.langs))
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * top.size)


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs; only its text takes part in the prediction."""
    model = Model(profiles, size)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, profiles: dict[str, list[int]], least_score: float = LEAST_SCORE, size: int = PROFILE) -> DataFrame:
    """The rows of docs, all columns, whose language is known and has this score at least."""
    model, at = Model(profiles, size), docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at):
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found]))

    return docs.mapInArrow(choose, docs.schema)
