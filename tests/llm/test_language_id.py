import zlib

import numpy as np
import pytest

from cytolith.llm import op1_language_id as op
from cytolith.llm.common import table

ENGLISH = ["the cat and the dog went to the house with this thing", "that was the best of them and there is nothing else in the other one", "when they think of this the others have been there with that"]
GERMAN = ["der hund und die katze sind nicht mit dem mann gegangen", "das ist eine schöne geschichte und wir haben sie nicht gehört", "ich weiß nicht was soll es bedeuten dass ich so traurig bin"]


@pytest.fixture(scope="module")
def corpus(documents):
    texts, langs = {}, {}
    for k in range(120):
        texts[k], langs[k] = ((ENGLISH, "en"), (GERMAN, "de"))[k % 2][0][k // 2 % 3] + f" {'xyz'[k % 3]}", ("en", "de")[k % 2]
    texts |= {900: None, 901: "", 902: "12 % 34", 903: "the thing and the other", 904: "und nicht mit der"}
    langs |= {900: "en", 901: "de", 902: "en", 903: None, 904: None}
    return documents(texts, langs), texts, langs


def reference_counts(text):
    """n-grams of a text by the definition, one at a time."""
    counts = {}
    word = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = f" {word} "
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            g = padded[k : k + n]
            if n == 1 and g != " " or n == 2 and g != "  " or n == 3 and g[1] != " ":
                counts[g] = counts.get(g, 0) + 1
    return counts


def test_ngrams_are_those_of_the_definition():
    for text in ["Ab  c'd ß!", "x", "the end. Über 9"]:
        keys, counts = op.ngram_counts(text)
        # keys put a separator as code 32 and shorter n-grams in lower bits
        named = {}
        for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
            s = ""
            while key:
                s = chr(key & 0x1FFFFF) + s
                key >>= 21
            named[s] = n
        assert named == reference_counts(text)


def test_prediction_is_out_of_place_distance(corpus):
    docs, texts, _ = corpus
    profiles = op.learn(docs)
    assert sorted(profiles) == ["de", "en"]
    model = op.Model(profiles)
    for text in [*ENGLISH, *GERMAN, "mixed und the nicht this"]:
        keys, counts = op.ngram_counts(text)
        top = [k for k, _ in sorted(zip(keys.tolist(), counts.tolist(), strict=True), key=lambda x: (-x[1], x[0]))][: op.PROFILE]
        distance = {lang: sum(abs(i - p.index(g)) if g in p else op.PROFILE for i, g in enumerate(top)) for lang, p in profiles.items()}
        lang, score = model.predict(text)
        assert lang == min(sorted(distance), key=distance.get)
        assert score == pytest.approx(1 - min(distance.values()) / (op.PROFILE * len(top)))


def test_results_and_held_out_rows(corpus):
    docs, texts, langs = corpus
    rows = {r["doc_id"]: r for r in op.identify(docs, op.learn(docs)).collect()}
    assert set(rows) == set(texts)
    for k, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    assert [rows[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3
    assert rows[903]["lang_pred"] == "en" and rows[904]["lang_pred"] == "de"
    assert all(rows[k]["lang_pred"] == langs[k] for k in range(120))


def test_held_out_rows_are_not_learned_from(documents):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2][:5]
    assert op.learn(documents(dict.fromkeys(held, "some words here"))) == {}


def test_empty_and_repeated_rows(documents):
    empty = documents([])
    assert op.identify(empty, op.learn(empty)).count() == 0
    twice = documents([(1, "a word"), (1, "a word"), (None, "more words")])
    assert op.identify(twice, {}).count() == 3
    assert {r["lang_pred"] for r in op.identify(twice, {}).collect()} == {"und"}


def test_filter_keeps_columns_and_clean_rows(corpus):
    docs, texts, _ = corpus
    kept = op.accepted(docs, op.learn(docs))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(texts) - {900, 901, 902}


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = op.identify(docs, op.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.95


def test_blocks_give_the_same_counts(monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abÜ ß\n1x"), 5000))
    whole = op.ngram_counts(text)
    for size in (1, 7, 4999, 5002):
        monkeypatch.setattr(op, "BLOCK", size)
        assert all(np.array_equal(x, y) for x, y in zip(op.ngram_counts(text), whole, strict=True))


def test_equal_distances_go_to_the_first_language():
    same = op.ngram_counts("the same")[0].tolist()
    assert op.Model({"b": same, "a": same, "c": same[:3]}).predict("the same")[0] == "a"


def test_no_language_is_left_out(documents):
    made = {k: f"w{chr(97 + k % 26)}{chr(97 + k // 26)} only here" for k in range(676)}
    docs = documents(made, {k: f"l{k:03}" for k in made})
    profiles = op.learn(docs)
    assert len(profiles) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in made)


def test_very_long_text(corpus, documents):
    docs = documents({1: " ".join(ENGLISH) * 70_000, 2: "x" * 10_000_000, 3: "1 " * 5_000_000})
    got = {r["doc_id"]: r["lang_pred"] for r in op.identify(docs, op.learn(corpus[0])).collect()}
    assert got[1] == "en" and got[3] == "und"
