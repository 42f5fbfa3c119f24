"""Token counts of a unigram tokenizer without its tokens: Viterbi over Aho-Corasick matches.

The automaton lists all vocabulary pieces that end at each character, longest first. The dynamic programme keeps, for
each end, the best score, the number of pieces on that path and whether its last piece is unknown. Tie rules are the
tokenizer's: a path replaces another only if its score is strictly higher, so of equal scores the earliest start (the
longest last piece) stays; a character that no piece of its own covers is unknown at the least score less 10, and comes
after the pieces. Unknown characters count their UTF-8 bytes if the vocabulary falls back to bytes, else a run of them
counts one.

Text is taken as the usual word-marking pre-tokenizer takes it: blanks become the mark, a text without a leading mark
gets one, and each mark begins a word that is counted by itself. Where all scores are whole numbers (sums are exact) a
word is also cut at characters that occur in no piece. The count of each distinct word is computed once.

Defined results: null and empty texts have no tokens. Repeated rows are counted one by one, extra columns are ignored,
an empty table gives an empty result. A very long text is a batch of its own; of a word, however long, the programme holds
as many ends as the longest piece has characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 500_000


class Counter:
    """Piece counts under a vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not any(p for p, _ in pieces)
        self.longest = max((len(p) for p, _ in pieces), default=0)
        self.bytes = byte_fallback
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        inside = {c for p, _ in pieces for c in p}
        whole = all(float(s).is_integer() for _, s in pieces)
        self.marked_inside = any(MARK in p[1:] for p, _ in pieces)
        # with byte fallback a character outside all pieces is a token sequence of its own
        self.apart = re.compile(f"[^{''.join(map(re.escape, sorted(inside)))}]") if whole and byte_fallback and inside else None
        self.known: dict[str, int] = {}

    def viterbi(self, word: str) -> int:
        """Number of pieces on the best path through a word."""
        n = len(word)
        # ends by their remainder: no match reaches back further than the longest piece
        size = max(self.longest, 1) + 1
        score: list[float | None] = [None] * size
        count, unknown = [0] * size, [False] * size
        score[0] = 0.0
        matches = iter([]) if self.empty else self.automaton.iter(word)
        ahead = next(matches, None)
        for end in range(1, n + 1):
            own, best, single = end % size, None, False
            ways, is_unknown = 0, False
            while ahead is not None and ahead[0] == end - 1:
                length, piece = ahead[1]
                single |= length == 1
                from_ = (end - length) % size
                if score[from_] is not None and (best is None or score[from_] + piece > best):
                    best, ways, is_unknown = score[from_] + piece, count[from_] + 1, False
                ahead = next(matches, None)
            before = (end - 1) % size
            if not single and (best is None or score[before] + self.unknown > best):
                best = score[before] + self.unknown
                more = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else 0 if unknown[before] else 1
                ways, is_unknown = count[before] + more, True
            score[own], count[own], unknown[own] = best, ways, is_unknown
        return count[n % size]

    def _word(self, word: str) -> int:
        if self.apart is None:
            return self.viterbi(word)
        parts, outside = self.apart.split(word), self.apart.findall(word)
        return sum(self.viterbi(p) for p in parts if p) + sum(len(c.encode("utf-8", "surrogatepass")) for c in outside)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, out = self.known, np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            marked = text.replace(" ", MARK)
            words = marked.split(MARK)
            # the first part is empty if the text begins with a mark; otherwise it gets one, like all others
            total = 0
            for word in words[1:] if not words[0] else words:
                n = known.get(word)
                if n is None:
                    n = known[word] = self._word(MARK + word)
                total += n
            out[k] = total
        return out


@cache
def sentencepiece_counter(path: str) -> Counter:
    """Counter for the pieces and scores of a sentencepiece model file; control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Counter(pieces, any(model.is_byte(i) for i in ids))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = sentencepiece_counter(path)
        for batch in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.count(batch.column(1).to_pylist()))], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")
