import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cytolith.llm import op4_packing as op
from cytolith.llm.common import table
from cytolith.llm.queries import PACKING_TOKENIZER, tokenizer_path

PATH = tokenizer_path(PACKING_TOKENIZER)
ODD = [None, "", "  ", "Don't I'LL 123 4½ ﬁ ΣΑΣ ς İstanbul 😀😀", "á ẹ́ J̌ Ǆ\n\t中文 한글", "a<|startoftext|>b <|ENDOFTEXT|> x<|endoftext|>", "end. And, so... \"quote\". 3. x_. y.,\nz", "É" * 5000, "word " * 5000]


def check(rows, texts):
    """Every id in exactly one piece; sequences gapless, full or a power of two."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == ids.size
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == ids.size
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= op.LENGTH and at & (at - 1) == 0


def test_pieces_of_odd_texts(documents):
    texts = dict(enumerate(ODD))
    check(op.pack(documents(texts), PATH).collect(), texts)


def test_pieces_of_the_small_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check(op.pack(docs, PATH).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_a_full_store_changes_nothing(monkeypatch):
    texts = [f"{a} alpha{k} beta, gamma{k}." for k in range(300) for a in ("x", "y")]
    plain = op.Encoder(PATH).encode(texts)
    monkeypatch.setattr(op, "CACHED_WORDS", 20)
    small = op.Encoder(PATH)
    got = [small.encode(texts[k : k + 7]) for k in range(0, len(texts), 7)]
    assert np.array_equal(plain[0], np.concatenate([g[0] for g in got])) and np.array_equal(plain[1], np.concatenate([g[1] for g in got]))


def test_hilbert_curve_is_one_walk():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = op.hilbert(grid, 3)
    assert sorted(key) == list(range(side**3))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_neighbours_share_vocabulary(documents):
    texts = {k: " ".join((["alpha", "beta", "gamma"], ["uno", "dos", "tres"])[k % 2] * 40) for k in range(40)}
    rows = op.tokenized(documents(texts), PATH).collect()
    low = {r["doc_id"] % 2 for r in sorted(rows, key=lambda r: r["curve"])[:20]}
    assert len(low) == 1


def test_rest_is_cut_into_powers_of_two():
    assert op.ends_of_rest(1300) == [1024, 256, 16, 4] and op.ends_of_rest(1) == [1]


def test_empty_repeated_and_null_rows(documents):
    assert op.pack(documents([]), PATH).count() == 0
    rows = op.pack(documents([(1, "a b"), (1, "a b"), (None, None)]), PATH).collect()
    assert sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == [1, 3, 3]
    assert sum(r["length"] for r in rows) == 7


@pytest.mark.parametrize("text", ["", "plain words. And more, here"])
def test_spacing_changes_no_ids(text):
    tokenizer = Tokenizer.from_file(PATH)
    assert tokenizer.encode(op._spaced(text), add_special_tokens=False).ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_very_long_texts(documents):
    texts = {1: "some words, here. " * 600_000, 2: "x" * 3_000_000, 3: "a"}
    check(op.pack(documents(texts), PATH).collect(), texts)
