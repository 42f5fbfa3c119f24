import itertools
import random

import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from cytolith.llm import op8_token_counts as op
from cytolith.llm.common import table
from cytolith.llm.queries import UNIGRAM_TOKENIZER, tokenizer_path

PATH = tokenizer_path(UNIGRAM_TOKENIZER)
ODD = ["", " ", "  a  b ", "▁a ▁b", "x\ny\tz\r\n", "中文漢字 한글 😀", "İstanbul ß ﬁ", "a" * 3000, "\x00\x01", "tokens,tokens;tokens", "é" * 50 + " " * 20]


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = []
    for i in range(model.get_piece_size()):
        special = model.is_control(i) or model.is_unknown(i)
        pieces.append((f"\x00special{i}", -1e9) if special else (model.id_to_piece(i), -1e9 if model.is_byte(i) else model.get_score(i)))
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_against_the_library(library, documents, spark, sf_dir):
    texts = dict(enumerate(ODD)) | {1000 + r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in op.token_counts(documents(texts), PATH).collect()}
    assert got == {k: library(t) for k, t in texts.items()}


def best_counts(word, vocabulary, unknown):
    """All segmentations of the best score; the one that the tie rule picks is found by its own definition, from the end."""
    best = {0: 0.0}
    back = {}
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            if piece in vocabulary:
                score = best[start] + vocabulary[piece]
            elif end - start == 1:
                score = best[start] + unknown
            else:
                continue
            if end not in best or score > best[end]:
                best[end], back[end] = score, start
    pieces, at = [], len(word)
    while at:
        pieces.append(word[back[at] : at])
        at = back[at]
    return pieces[::-1]


def test_ties_and_unknown_runs():
    rng = random.Random(2)
    for fallback in (True, False):
        vocabulary = {"".join(p): float(-rng.randrange(1, 4)) for n in (1, 2, 3) for p in itertools.product("ab▁", repeat=n) if rng.random() < 0.5}
        counter = op.Counter(list(vocabulary.items()), fallback)
        for _ in range(300):
            word = "▁" + "".join(rng.choice("abcé") for _ in range(rng.randrange(12)))
            pieces = best_counts(word, vocabulary, min(vocabulary.values()) - 10)
            known = [p in vocabulary for p in pieces]
            if fallback:
                wanted = sum(1 if k else len(p.encode()) for p, k in zip(pieces, known, strict=True))
            else:
                wanted = sum(k or j == 0 or known[j - 1] for j, k in enumerate(known))
            assert counter.viterbi(word) == wanted


def test_null_empty_and_repeated_rows(documents):
    rows = op.token_counts(documents([(1, "a b"), (1, "a b"), (None, None), (2, "")]), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 0), (1, 2), (1, 2), (2, 0)]
    assert op.token_counts(documents([]), PATH).count() == 0


def test_a_full_store_changes_nothing(monkeypatch):
    texts = [f"word{k} other{k} again" for k in range(50)]
    wanted = op.sentencepiece_counter(PATH).count(texts).tolist()
    monkeypatch.setattr(op, "CACHED_WORDS", 3)
    assert [int(op.sentencepiece_counter(PATH).count([t])[0]) for t in texts] == wanted


def test_very_long_texts(documents):
    from cytolith.llm.queries import UNIGRAM_TOKENIZER, tokenizer_path

    path = tokenizer_path(UNIGRAM_TOKENIZER)
    docs = documents({1: "some words " * 900_000, 2: "xyz" * 300_000, 3: "some words", 4: "xyz"})
    rows = {r["doc_id"]: r["n_tokens"] for r in op.token_counts(docs, path).collect()}
    assert rows[1] >= 900_000 * rows[3] and rows[2] > 0
