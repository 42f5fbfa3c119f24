import math
import random
import re

import pytest

from cytolith.llm import op10_decontamination as op
from cytolith.llm.common import table

ITEMS = "item_id long, text string, doc_id string"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [
            (1, "A train leaves Boston at 10 and travels 60 km in 2 hours before Anna stops it there", "x"),
            (2, "One two three", "x"),
            (3, None, "x"),
            (4, "The farmer, Tom, sold 12 apples to Tom and 15 pears to Mary on the market day", "x"),
            (5, "plain words of a passage that has neither names nor numbers in it at all", "x"),
        ],
        ITEMS,
    )


def found(docs, items):
    return {(r["doc_id"], r["item_id"]) for r in op.contaminations(docs, items).collect()}


def test_parameters_change_but_slots_must_agree(documents, items):
    docs = documents({
        1: "Intro words here. A train leaves Chicago at 17 and travels 95 km in 3 hours before Lucy stops it there. The end",
        2: "x one two three y", 3: None, 4: "",
        5: "so the farmer, Bob, sold 7 apples to Bob and 9 pears to Sue on the market day",
        6: "so the farmer, Bob, sold 7 apples to Jim and 9 pears to Sue on the market day",
        7: "Plain WORDS of a passage, that has neither names nor numbers in it at all!", 8: "plain words of a passage about something else", 9: "clean text without any of it",
        10: "plain  words\nof a\tpassage that has neither names nor numbers in other places",
    })
    assert found(docs, items) == {(1, 1), (2, 2), (5, 4), (7, 5), (10, 5)}


def test_a_large_benchmark_is_joined_by_shuffle(documents, items, spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(op.contaminations(docs, bench)) == rows(op.contaminations(docs, bench, broadcast_windows=0))
    odd = documents([(1, "one two three"), (1, "one two three"), (None, None), (2, "x")])
    assert rows(op.contaminations(odd, items, broadcast_windows=0)) == rows(op.contaminations(odd, items))


def test_long_texts_repeats_and_null_ids(documents, items):
    filler = " ".join(f"w{k}" for k in range(30_000))
    docs = documents([(1, f"{filler} plain words of a passage that has neither names nor numbers in it at all {filler}"), (1, "other"), (None, "one two three"), (2, "x" * 200_000)])
    assert found(docs, items) == {(1, 5), (None, 2)}


def test_empty_tables(documents, items):
    assert found(documents([]), items) == found(documents(["one two three"]), items.limit(0)) == set()


def test_filter_keeps_columns_and_clean_rows(documents, items):
    docs = documents([(1, "one two three"), (2, "clean"), (None, None), (3, "clean too")])
    kept = op.clean(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, None, 3}


def test_tokens_keep_their_places(documents):
    rng = random.Random(4)
    parts = ["Anna", "12", "5kg", "5", "kg", "...", "<b>", ">", "3.5%", "word,", "Ünal", " ", "\n", "\t", "$7", "_", "(x)"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", "\n "]) for _ in range(40)) for _ in range(200)]
    from pyspark.sql import functions as F

    rows = documents(texts).select(op.raw_tokens(F.col("text")).alias("r"), op.canonical_tokens(F.col("text")).alias("c")).collect()
    assert all(len(r["r"]) == len(r["c"]) for r in rows)


def plain_matches(texts, items):
    """Items without slots: covered share of tokens by equal windows, compared directly."""
    out = set()
    for d, text in texts.items():
        t = (text or "").lower().replace(".", "").replace(",", "").split()
        windows = {tuple(t[k : k + op.WINDOW]) for k in range(len(t) - op.WINDOW + 1)}
        for i, item in items.items():
            w = item.lower().replace(".", "").replace(",", "").split()
            covered = {j for k in range(len(w) - op.WINDOW + 1) if tuple(w[k : k + op.WINDOW]) in windows for j in range(k, k + op.WINDOW)}
            if len(covered) >= op.COVERED * len(w):
                out.add((d, i))
    return out


def test_planted_passages_of_the_small_tables(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    wanted = plain_matches({r["doc_id"]: r["text"] for r in docs.collect()}, {r["item_id"]: r["text"] for r in bench.collect()})
    assert wanted and found(docs, bench) == wanted


def test_main_path_is_native(documents, items):
    plan = op.contaminations(documents(["a"]), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_slots_agree_by_occurrence(documents, items):
    exact = "The farmer, Tom, sold 12 apples to Tom and 15 pears to Mary on the market day"
    other = "The farmer, Bob, sold 7 apples to Bob and 9 pears to Sue on the market day"
    odd = "The farmer, Bob, sold 7 apples to Jim and 9 pears to Sue on the market day"
    docs = documents({1: f"{exact} then {other}", 2: f"{odd} {exact}", 3: f"{odd} {odd}", 4: "The farmer, Tom, sold 12 apples to Tom and 15 pears, well, to Mary on the market day"})
    assert found(docs, items) == {(1, 4), (2, 4), (4, 4)}


def test_windows_of_few_literal_tokens_match_verbatim(documents, spark):
    items = spark.createDataFrame([(1, "Sort 5 3 9 1 7 2 8", "x"), (2, "7 4 1 9 3 8 2 6 5 0 11 12 13", "x")], ITEMS)
    docs = documents({1: "please sort 5 3 9 1 7 2 8, thanks", 2: "please sort 5 3 9 1 7 2 4 thanks", 3: "so 7 4 1 9 3 8 2 6 5 0 11 12 13 it is", 4: "so 7 4 1 9 3 8 3 7 5 0 11 12 13 it is"})
    assert found(docs, items) == {(1, 1), (3, 2)}
    assert found(docs, items) == {(r["doc_id"], r["item_id"]) for r in op.contaminations(docs, items, broadcast_windows=0).collect()}


def plain_tokens(text):
    """(canonical token, raw word) of each word, by the definition's steps in Python."""
    canonical = re.sub(r"(?<=[^\W_] |[,;] )[A-ZÄÖÜ][^\W\d_'-]*", "<name>", text.replace("<", "(").replace(">", ")"))
    canonical = re.sub(op.NUMBER, "<num>", canonical.lower())
    canonical = re.sub(rf"(?:(?<=<num>)|(?<=<num>[ -]))(?:{op.UNITS})(?![^\W_]|<)", "<unit>", canonical)
    canonical = re.sub(r"(?<=[^\W\d_>])[^\w<>\s]+(?=\s|$)", "", canonical)
    return list(zip(canonical.split(), text.split(), strict=True))


def bare(word):
    return word.lower().strip(".,;:!?()")


def directly(texts, items):
    """(doc, item) pairs by comparing all windows of all pairs, one by one."""
    found = set()
    for d, text in texts.items():
        doc = plain_tokens(text)
        for i, item in items.items():
            want = plain_tokens(item)
            size, alignments = min(op.WINDOW, len(want)), {}
            for p in range(len(want) - size + 1):
                a = want[p : p + size]
                literal = sum("<" not in c for c, _ in a)
                for q in range(len(doc) - size + 1):
                    b = doc[q : q + size]
                    if [c for c, _ in a] != [c for c, _ in b] or literal < math.ceil(op.LITERAL * size) and [bare(w) for _, w in a] != [bare(w) for _, w in b]:
                        continue
                    binds = frozenset((bare(w), bare(v)) for (c, w), (_, v) in zip(a, b, strict=True) if re.search(op.SLOT, c))
                    key = (q - p, bool(binds))
                    places, held, n = alignments.get(key, (set(), set(), 0))
                    alignments[key] = (places | {p}, held | binds, n + 1)
            one = lambda x: len({u for u, _ in x}) == len({v for _, v in x}) == len(x)
            units = {}
            for places, binds, n in alignments.values():
                if one(binds):
                    units.setdefault(frozenset(binds), (set(), []))[0].update(places)
                    units[frozenset(binds)][1].append(n)
            order = sorted(((not b, len(p), sum(n), sorted(p), sorted(b)) for b, (p, n) in units.items()), reverse=True)
            best = 0
            for seed in order:
                places, binds = set(seed[3]), set(seed[4])
                for unit in order:
                    if unit is not seed and one(binds | set(unit[4])):
                        places, binds = places | set(unit[3]), binds | set(unit[4])
                best = max(best, len({x for p in places for x in range(p, p + size)}))
            if best >= math.ceil(op.COVERED * len(want)):
                found.add((d, i))
    return found


def questions():
    """Items with slots in every window, and documents of copies, variants and contradictions of them in any order."""
    rng = random.Random(17)
    verbs, nouns = ["sold", "bought", "gave", "lost", "counted"], ["apples", "pears", "books", "stamps", "coins"]
    names, filler = ["Tom", "Mary", "Bob", "Sue", "Ann", "Jim"], "and so the day went on with nothing more to say of it".split()
    shapes = [(rng.choice(verbs), rng.choice(nouns), rng.choice(verbs), rng.choice(nouns)) for _ in range(25)]

    def said(shape, values):
        a, b, x, y = values
        return f"the farmer, {a}, {shape[0]} {x} {shape[1]} to {b} and then {a} {shape[2]} {y} {shape[3]} in {x} days"

    def values():
        return (*rng.sample(names, 2), *rng.sample(range(2, 90), 2))

    items = {k: (said(s, values()), s) for k, s in enumerate(shapes)}
    texts = {}
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            text, shape = items[rng.randrange(len(items))]
            kind = rng.randrange(5)
            if kind == 0:
                parts.append(text)
            elif kind == 1:
                parts.append(said(shape, values()))
            elif kind == 2:  # a contradiction
                parts.append(re.sub(r"in [0-9]+ days", f"in {rng.randrange(90, 99)} days", text))
            elif kind == 3:  # two values become one
                parts.append(said(shape, ("Tom", "Tom", 7, 7)))
            else:
                words = text.split()
                parts.append(" ".join([*words[: rng.randrange(len(words))], *rng.sample(filler, 3)]))
        parts += [" ".join(rng.sample(filler, rng.randrange(1, 10))) for _ in range(rng.randrange(1, 3))]
        rng.shuffle(parts)
        texts[d] = " ".join(parts)
    return texts, {k: text for k, (text, _) in items.items()}


def test_slots_against_a_direct_comparison(documents, spark):
    texts, plain = questions()
    wanted = directly(texts, plain)
    items = spark.createDataFrame([(k, t, "x") for k, t in plain.items()], ITEMS)
    assert len(texts) * len(plain) >= 1000 and len(wanted) > 20
    assert found(documents(texts), items) == wanted


def test_two_values_do_not_become_one(documents, items):
    docs = documents({1: "so the farmer, Bob, sold 7 apples to Bob and 9 pears to Bob on the market day", 2: "so the farmer, Bob, sold 7 apples to Bob and 7 pears to Sue on the market day"})
    assert found(docs, items) == set()


def test_very_long_texts(documents, items):
    filler = "plain words of no passage at all in many places " * 200_000
    docs = documents({1: filler + "plain words of a passage that has neither names nor numbers in it at all", 2: filler, 3: "x" * 5_000_000})
    assert found(docs, items) == {(1, 5)}


def test_windows_of_many_items(documents, spark):
    """A phrase that all items share names none of them, but where it is most of an item."""
    phrase = "choose the best of the answers that are given below and explain your choice"
    rng = random.Random(19)
    own = [" ".join(rng.choice("abcdefghijklmnop") * 3 + rng.choice("xyz") for _ in range(rng.choice((3, 40)))) for _ in range(30)]
    plain = {k: f"{phrase} {t}" for k, t in enumerate(own)}
    texts = {k: f"so {phrase} then" for k in range(5)} | {10 + k: f"x {t} y" for k, t in plain.items()} | {100: own[0], 101: " ".join(own[:6])}
    items = spark.createDataFrame([(k, t, "x") for k, t in plain.items()], ITEMS)
    wanted = directly(texts, plain)
    assert found(documents(texts), items) == wanted and {i for d, i in wanted if d == 0} == {k for k, t in enumerate(own) if len(t.split()) == 3}
