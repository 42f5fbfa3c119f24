import random
import re

import numpy as np

from cytolith.llm import op2_quality_rules as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """Base columns by the contract, and repeats of MIN_REPEAT words by comparing all pairs of places."""
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    seen = {}
    for k in range(n - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    inside = {j for places in seen.values() if len(places) > 1 for k in places for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    covered, longest = set(), 0
    for a in range(n):
        for b in range(a + 1, n):
            m = 0
            while b + m < n and w[a + m] == w[b + m]:
                m += 1
            longest = max(longest, m)
            if m >= op.MIN_REPEAT:
                covered |= set(range(a, a + m)) | set(range(b, b + m))
    failed = n < 10 or 100 * len(inside) > 20 * n
    kept = not failed and len(covered) <= op.MAX_COVERED * n and longest <= op.MAX_REPEAT
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed, kept, len(covered), longest


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "one", "a b c d e f g h i j", "a a a a a a a a a a a a", "x y z\nx y z\n\nq #*$\n \n", "w v u\x1ct " * 7]
    for k in range(60):
        words = [rng.choice("abcdefgh"[: 2 + k % 7]) for _ in range(rng.randrange(1, 60))]
        if k % 3 == 0:
            words += [f"u{j}" for j in range(120)]
        if k % 2:
            words += words[: rng.randrange(30)]
        out.append("".join(x + rng.choice([" ", " ", "\n", "\t ", "\r"]) for x in words))
    return out


def test_against_brute_force(documents):
    made = texts()
    rows = {r["doc_id"]: r for r in op.quality(documents(made)).collect()}
    names = [x.split()[0] for x in op.SCHEMA.split(", ")]
    for k, text in enumerate(made):
        assert tuple(rows[k][c] for c in names) == brute(text), (k, text)


def test_suffix_order_and_lcp():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 200):
        ids = np.append(rng.integers(0, 3, n), 99)
        order, lcp = op.common_prefixes(ids)
        suffixes = [ids[k:].tolist() for k in range(n + 1)]
        assert order.tolist() == sorted(range(n + 1), key=lambda k: suffixes[k])
        for r in range(1, n + 1):
            a, b = suffixes[order[r - 1]], suffixes[order[r]]
            m = 0
            while m < min(len(a), len(b)) and a[m] == b[m]:
                m += 1
            assert lcp[r] == m


def test_long_repeat_is_rejected_and_long_clean_text_is_kept(documents):
    unique = " ".join(f"word{k}" for k in range(2000))
    passage = " ".join(f"p{k}" for k in range(op.MAX_REPEAT + 1))
    rows = {r["doc_id"]: r for r in op.quality(documents([unique, f"{unique} {passage} middle {passage}", "x" * 300_000])).collect()}
    assert rows[0]["kept"] and not rows[1]["base_failed"] and not rows[1]["kept"] and rows[1]["longest_repeat"] == op.MAX_REPEAT + 1
    assert rows[2]["n_words"] == 1


def test_empty_and_repeated_rows(documents):
    assert op.quality(documents([])).count() == 0
    assert op.quality(documents([(1, "a"), (1, "a"), (None, None)])).count() == 3


def test_very_long_texts(documents):
    once = " ".join(f"w{k}" for k in range(1_000_000))
    docs = documents({1: once, 2: "a b c d e f g h " * 150_000, 3: "x" * 5_000_000, 4: f"{once[:2_000_000]} {once[:2_000_000]}"})
    rows = {r["doc_id"]: r for r in op.quality(docs).collect()}
    assert (rows[1]["kept"], rows[1]["n_repeat_words"], rows[2]["kept"], rows[3]["base_failed"]) == (True, 0, False, True)
    assert rows[2]["longest_repeat"] == 1_200_000 - 8 and rows[4]["n_repeat_words"] == rows[4]["covered_words"] > 500_000
